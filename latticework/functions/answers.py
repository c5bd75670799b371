"""Tolerant parsing of a selector's answer: a fenced JSON object, or what follows the last opening brace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PULL = "struct<anchor: string, expand: string, point_class: string, reason: string>"
PICKED = f"struct<pulls: array<{PULL}>, summary: string>"
AUDITED = f"struct<verdict: string, add: array<{PULL}>, drop: array<string>, note: string>"


def blob(content: Column) -> Column:
    """The JSON text of an answer, null if there is none that parses: as found, else cut at its last closing brace."""
    # Fixed value: the fence of an answer.
    fence = F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    tail = F.when(F.contains(content, F.lit("{")), F.concat(F.lit("{"), F.substring_index(content, "{", -1)))
    found = F.when(fence != "", fence).otherwise(tail)
    cut = F.regexp_extract(found, r"(?s)^(.*\})", 1)
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(parses(found), found).when((cut != "") & parses(cut), cut)


def parse(content: Column, schema: str = PICKED) -> Column:
    return F.from_json(blob(content), schema)
