"""Mixing sources to target weights by Poisson replication.

Each source's target is a share of the output's characters, in proportion to its weight. A document of a source is
repeated k times, k drawn from the Poisson distribution whose mean is the source's target over its characters; the draw
inverts the distribution at a number hashed from the seed, the document's id and its text, so that it is the same in every
run, order and retry. A mean over MAX_MEAN is split into equal parts that are drawn on their own and added, which leaves
the distribution as it is. The copies are then dealt out and sorted by a hash of seed, document and copy: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

MAX_MEAN = 500.0
#: More sources than this are joined by a shuffle instead of a broadcast.
MAX_SOURCES = 10_000


def _chance(*parts):
    """A number from 0 to 1, exclusive of 1, from a hash: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, ratio: float = 1.0) -> DataFrame:
    """source, mean, parts, steps (cumulative probabilities of one part) of each source of docs(text, source).

    weights: of sources; without them all sources weigh the same; a source missing in them is left out of the mix. ratio:
    characters out for each one in. A null source is a source like others (its weight's key is None). A text counts one
    character more than it has, so that empty texts have a size.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items() if w > 0], "name string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    if weights is not None:
        whole = docs.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("all_size")).join(whole.select("all_weight"))
    mean = F.lit(float(ratio)) * F.col("all_size").cast("double") * F.col("weight") / F.col("all_weight") / F.col("size").cast("double")
    table = sizes.join(F.broadcast(whole)).select("source", mean.alias("mean")).withColumn("parts", F.ceil(F.col("mean") / MAX_MEAN).cast("int"))
    part = F.col("mean") / F.col("parts")
    last = F.ceil(part + 12 * F.sqrt(part) + 20).cast("int")
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("c"), F.array(F.exp(-part)).alias("all"))

    def step(acc, k):
        p = acc["p"] * part / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return table.withColumn("steps", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"]))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, ratio: float = 1.0, seed: int = 17, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The columns of docs(doc_id, text, source, ..), once for each copy, with copy (from 1), n_copies and mix_key, in the
    order of mix_key within and at random across partitions.

    Rows equal in id and text are repeated alike; null ids and texts are hashed as such; columns of docs named like a result
    are replaced, other names are free; an empty table gives an empty one.
    """
    docs = docs.drop("copy", "n_copies", "mix_key")
    table = rates(docs, weights, ratio)
    source, parts, steps, name, u = fresh(docs, "own_source", "parts", "steps", "own_name", "draw")
    table = table.select(F.col("source").alias(source), F.col("parts").alias(parts), F.col("steps").alias(steps))
    many = docs.select("source").distinct().limit(max_sources + 1).count()
    own = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    key = docs.withColumn(name, own).join(F.broadcast(table) if many <= max_sources else table, F.col("source").eqNullSafe(F.col(source)))
    drawn = F.aggregate(F.sequence(F.lit(0), F.col(parts) - 1), F.lit(0), lambda a, j: a + F.size(F.filter(steps, lambda c: _chance(F.col(name), j.cast("string")) >= c)))
    first = F.size(F.filter(F.transform(steps, lambda c: c <= F.col(u)), lambda hit: hit))
    counted = key.withColumn(u, _chance(F.col(name), F.lit("0"))).withColumn("n_copies", F.when(F.col(parts) == 1, first).otherwise(drawn).cast("long"))
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    dealt = copies.withColumn("mix_key", F.md5(F.concat_ws("|", name, F.lit("copy"), F.col("copy").cast("string")).cast("binary")))
    return dealt.select(*[f"`{c}`" for c in docs.columns], "copy", "n_copies", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def mix_sql(seed: int = 17, ratio: float = 1.0) -> str:
    """mix with equal weights over documents, for means up to MAX_MEAN."""
    return f"""
    with recursive s as (select source, sum(length(coalesce(text, '')) + 1) size from documents group by 1),
    m as (select source, {ratio!r}::double * (select sum(size) from s)::double * 1.0 / (select count(*) from s)::double / size::double mean from s),
    c as (select source, mean, 0 k, exp(-mean) p, exp(-mean) c from m
      union all select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from c where k + 1 <= ceil(mean + 12 * sqrt(mean) + 20)),
    t as (select source, list(c order by k) steps from c group by 1),
    o as (select d.*, concat_ws('|', '{seed}', coalesce(cast(doc_id as varchar), 'null'), md5(coalesce(text, ''))) own from documents d),
    u as (select o.*, ('0x' || substr(md5(own || '|0'), 1, 13))::bigint::double / 4503599627370496.0 u from o),
    n as (select u.* exclude (u), (select count(*) from c where c.source is not distinct from u.source and c.c <= u.u) n_copies from u)
    select doc_id, text, lang, source, n_chars, copy, n_copies, md5(own || '|copy|' || copy) mix_key
    from (select *, unnest(range(1, n_copies + 1)) copy from n where n_copies > 0)"""
