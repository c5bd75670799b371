"""Column expressions over URIs and relation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inverse relation names and their canonical forms.
INVERSES = {"isPointOf": "hasPoint", "isPartOf": "hasPart", "isFedBy": "feeds", "hasLocation": "isLocationOf"}
CANONICAL = ("hasPoint", "hasPart", "feeds", "isLocationOf")
POINT_RELATIONS = ("hasPoint", "global_hasPoint")
STRUCTURAL_RELATIONS = ("feeds", "hasPart", "isLocationOf")


def fragment(uri: Column) -> Column:
    """After the first '#', else after the last '/'."""
    return F.when(F.contains(uri, F.lit("#")), F.substring(uri, F.instr(uri, F.lit("#")) + 1, F.length(uri))).otherwise(F.substring_index(uri, "/", -1))


def short(uri: Column, size: int = 14) -> Column:
    """The last dotted segment of the fragment, cut to size."""
    return F.substring(F.substring_index(fragment(uri), ".", -1), 1, size)


def dotted_prefix(uri: Column) -> Column:
    """All but the last dotted segment of the fragment; the whole fragment without a dot."""
    own = fragment(uri)
    return F.when(F.contains(own, F.lit(".")), F.regexp_extract(own, r"^(.*)[.][^.]*$", 1)).otherwise(own)


def canonical(relation: Column) -> Column:
    """The canonical name of an inverse relation; others stay."""
    out = relation
    for inverse, name in INVERSES.items():
        out = F.when(relation == inverse, name).otherwise(out)
    return out


def is_global(relation: Column) -> Column:
    return F.startswith(relation, F.lit("global_"))


def base_relation(relation: Column) -> Column:
    return F.regexp_replace(relation, "^global_", "")
