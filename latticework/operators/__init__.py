"""Graph, record, time-series and evaluation operators."""
