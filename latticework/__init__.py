"""Covariate selection over building knowledge graphs, time-series preparation and corpus operators, on Spark."""
