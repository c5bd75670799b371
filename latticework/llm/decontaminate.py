"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Tokens are the runs of letters and digits of the lower-cased text. A mask such as 11101011 laid over consecutive tokens
hashes those under a 1 and ignores those under a 0. Benchmark items and texts are hashed at every position with the same
masks; equal hashes align an item with a text, and the alignment is verified token by token: an item is found where, among
some 13 consecutive tokens of it, at most 2 differ from the text's (of an item of 8 to 12 tokens, at most 1; of one of 4 to 7,
none). MASKS is chosen so that any 2 substitutions in 13 tokens leave one of the masks untouched at some position: no
such overlap is missed. Items under 4 tokens say too little and match nothing.

The benchmark is broadcast while its seeds number at most max_seeds; a larger one meets the texts' seeds in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

MASKS = ("11101011", "1011000111")
#: For items shorter than WINDOW.
SHORT_MASK = "1111"
WINDOW = 13
MAX_SEEDS = 1_000_000
#: Findings (a text and an item) that are broadcast to the documents; more are joined by a shuffle.
MAX_FOUND = 500_000
#: Positions that a text is cut into at a time, and tokens that a window around a seed can reach.
_CHUNK = 64
_REACH = 2 * WINDOW - 1


def tokens(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits; that of an empty string may stand at either end."""
    words = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: str, at: Column, masks: dict[int, str]) -> Column:
    """One hash for each mask laid at a position; null past the end."""
    each = []
    for number, mask in masks.items():
        under = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
        each.append(F.when(at + (len(mask) - 1) < F.size(words), F.xxhash64(F.lit(number), *under)))
    return F.array(*each)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, size: distinct items with enough tokens."""
    empty = F.xxhash64(F.lit(""))
    words = F.filter(tokens("text"), lambda w: w != empty)
    return benchmark.select("item_id", words.alias("words")).withColumn("size", F.size("words")).where("size >= 4").distinct()


def _item_seeds(items: DataFrame, masks: dict[int, str]) -> DataFrame:
    """seed, item_id, q, around and size for every position q and mask of every item.

    around: the item's tokens from WINDOW - 1 before q on, as many as a window that holds the seed can reach; nulls outside.
    The short mask is laid only where an item is short.
    """
    out = items.select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("q"))
    around = F.transform(F.sequence(F.lit(1 - WINDOW), F.lit(_REACH - WINDOW)), lambda i: F.when(F.col("q") + i >= 0, F.get("words", F.col("q") + i)))
    out = out.select("item_id", "size", "q", around.alias("around"), F.posexplode(_seeds("words", F.col("q"), masks)).alias("mask", "seed"))
    return out.where(F.col("seed").isNotNull() & ((F.col("mask") != len(MASKS)) | (F.col("size") < WINDOW))).drop("mask")


def _hits(docs: DataFrame, seeds: DataFrame, masks: dict[int, str], broadcast: bool) -> DataFrame:
    """key, item_id, size, bits: for each seed in common, which of the item's tokens around it the text repeats.

    Texts are cut into chunks with a margin on either side, so that a row stays small however long the text is.
    """
    chunks = docs.select("key", tokens("text").alias("all")).select("key", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(_CHUNK))).alias("base"))
    first = F.col("base") - (WINDOW - 1)
    padded = F.concat(F.array_repeat(F.lit(None).cast("long"), F.greatest(-first, F.lit(0))), F.slice("all", F.greatest(first, F.lit(0)) + 1, F.lit(_CHUNK + _REACH) + F.least(first, F.lit(0))))
    chunks = chunks.select("key", "base", padded.alias("words"))
    # position i of a chunk stands at words[i + WINDOW - 1]
    at = chunks.select("key", "words", F.explode(F.sequence(F.lit(WINDOW - 1), F.least(F.size("words"), F.lit(_CHUNK + WINDOW - 1)) - 1)).alias("p"))
    found = at.select("key", "words", "p", F.explode(_seeds("words", F.col("p"), masks)).alias("seed")).where(F.col("seed").isNotNull())
    if broadcast:
        found = found.join(F.broadcast(seeds), "seed")
    else:
        found = found.select("key", "seed", F.slice("words", F.col("p") - (WINDOW - 2), _REACH).alias("words"), F.lit(WINDOW - 1).alias("p")).join(seeds, "seed")
    start = F.col("p") - (WINDOW - 1)
    same = lambda w, i: F.when(w == F.get("words", start + i), "1").otherwise("0")
    return found.select("key", "item_id", "size", F.array_join(F.transform("around", same), "").alias("bits")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The columns of docs(text, ..) and contaminated, n_items, items (ids, sorted, comma-joined), best_match (most tokens
    that WINDOW consecutive tokens of an item, or all of a shorter one, share with the text; 0 if none is found).

    One row for each row of docs: repeated rows and null or repeated ids are fine, as texts are told apart by their digest. A
    null or empty text is clean; null items are ignored; an empty benchmark finds nothing. Columns of docs named like a
    result are replaced, other names are free.
    """
    names = ["contaminated", "n_items", "items", "best_match"]
    docs = docs.drop(*names)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    items = _items(benchmark.select("item_id", "text").where(F.col("text").isNotNull()))
    sizes = items.agg(F.min("size").alias("least")).first()
    masks = dict(enumerate(MASKS)) | ({len(MASKS): SHORT_MASK} if sizes.least is not None and sizes.least < WINDOW else {})
    seeds = _item_seeds(items, masks)
    hits = _hits(docs.select(digest.alias("key"), "text"), seeds, masks, seeds.count() <= max_seeds)
    span = F.least("size", F.lit(WINDOW))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(_REACH + 1) - span), lambda s: F.length(F.replace(F.col("bits").substr(s, span), F.lit("0"), F.lit("")))))
    allowed = F.when(F.col("size") >= WINDOW, 2).when(F.col("size") >= 8, 1).otherwise(0)
    found = hits.withColumn("best", most).where(F.col("best") >= span - allowed)
    key, own, ids, most = fresh(docs, "text_digest", "found_digest", "found_ids", "found_most")
    found = stored(found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias(ids), F.max("best").alias(most)), "found").withColumnRenamed("key", own)
    few = (found.agg(F.sum(F.size(ids))).first()[0] or 0) <= MAX_FOUND
    out = docs.withColumn(key, digest).join(F.broadcast(found) if few else found, F.col(key) == F.col(own), "left")
    return out.select(
        *[f"`{c}`" for c in docs.columns], F.col(ids).isNotNull().alias("contaminated"), F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col(ids).cast("array<string>"), ","), F.lit("")).alias("items"), F.coalesce(most, F.lit(0)).cast("long").alias("best_match"),
    )


def find_sql() -> str:
    """The result of find over documents and benchmark, columns doc_id and those found, by comparing all token pairs."""
    return f"""
    with d as (select doc_id, text, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') ws from documents),
    dt as (select md5(coalesce(text, '')) k, unnest(ws) w, generate_subscripts(ws, 1) p from (select distinct text, ws from d)),
    b as (select distinct item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') ws from benchmark where text is not null),
    bt as (select item_id, len(ws) n, unnest(ws) w, generate_subscripts(ws, 1) q from b where len(ws) >= 4),
    m as (select k, item_id, n, p - q dg, q from dt join bt using (w)),
    c as (select k, item_id, n, count(*) over (partition by k, item_id, n, dg order by q range between current row and {WINDOW - 1} following) c from m),
    f as (select k, item_id, max(c) best, max(n) n from c where c >= least(n, {WINDOW}) - case when n >= {WINDOW} then 2 when n >= 8 then 1 else 0 end group by all),
    g as (select k, string_agg(distinct cast(item_id as varchar), ',') x, list_sort(list(distinct item_id)) ids, max(best) best from f group by k)
    select doc_id, ids is not null contaminated, coalesce(len(ids), 0)::bigint n_items, coalesce(array_to_string(ids, ','), '') items, coalesce(best, 0)::bigint best_match
    from d left join g on md5(coalesce(d.text, '')) = g.k"""
