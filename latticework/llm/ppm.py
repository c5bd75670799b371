"""LM scoring: prediction by partial matching over bytes.

Training counts, for every position of every training text, the byte that follows each context of up to
four bytes (a trie of depth five, held as sorted arrays). A text is the bytes of its UTF-8, preceded by
four and closed by one byte 0xFF, which no UTF-8 holds: it marks start and end. Scoring blends the orders
as PPM does: in a context with t occurrences and d different successors, a seen byte with n occurrences has
n / (t + d) and the escape d / (t + d) (method C); after an escape, the bytes of the longer context are
excluded from the shorter one's counts; below order 0, the bytes left share the rest evenly.

The model is static, so that a text's score does not depend on the order of rows, tasks or retries, and a byte's
probability depends on the ORDER bytes before it and itself alone: its gram. So every gram of the texts is rated once.

Size: all counted contexts are kept, whatever their number, and no process holds them all. Each block of texts (a partition
as read) lists its own distinct grams with their training counts; the sums over the blocks are dealt out by the last two
bytes of the context, so that a share holds all counts of order 2 and more that its grams need (order 1 and 0 are at most
2^16 counts and are sent to all); the rated grams are joined back to the blocks that hold them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored, texts, utf8

MARK = 0xFF
ORDER = 4
MAX_FREQUENT = 200_000
#: Grams of one share, about.
SHARE = 500_000
_FLUSH = 1_000_000
_CHUNK = 1 << 21


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each between ORDER marks and one, and where each one's marks begin."""
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER + 1)])
    out = np.full(starts[-1], MARK, np.uint8)
    body = data[offsets[0] : offsets[-1]]
    out[np.arange(len(body)) + np.repeat((ORDER + 1) * np.arange(len(sizes)) + ORDER, sizes)] = body
    return out, starts[:-1]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _CHUNK bytes."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        yield at, to
        at = to


def _across(starts: np.ndarray) -> np.ndarray:
    """Of the windows of ORDER + 1 bytes over framed texts, those that reach into the next text's marks."""
    return (starts[1:, None] - np.arange(1, ORDER + 1)).reshape(-1)


def _windows(seq: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each byte from ORDER on and it, as one number."""
    keys = np.zeros(len(seq) - ORDER, np.int64)
    for j in range(ORDER + 1):
        keys <<= 8
        keys |= seq[j : len(seq) - ORDER + j]
    return keys


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its n."""
    if not len(keys):
        return keys.astype(np.int64), n.astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, n): the strings of ORDER + 1 bytes in the texts of rows (block, text, held_out) and how often they stand
    in texts that aren't held out; a string may be listed more than once."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(block: int) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*kept[block], strict=True)))

    def out(block: int) -> pa.RecordBatch:
        k, n = merged(block)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.array(k), pa.array(n)], ["block", "gram", "n"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            own = batch.filter(pa.array(blocks == block))
            data, offsets = utf8(own.column(1))
            learnt = ~own.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in _slices(offsets):
                seq, starts = framed(data, offsets[a : b + 1])
                keep, n = np.ones(len(seq) - ORDER, bool), np.repeat(learnt[a:b], np.diff(np.append(starts, len(seq))))[ORDER:]
                keep[_across(starts)] = False
                part = _summed(_windows(seq)[keep], n[keep].astype(np.int64))
                kept.setdefault(block, []).append(part)
                size += len(part[0])
                if size > 4 * _FLUSH:
                    kept = {x: [merged(x)] for x in kept}
                    size = sum(len(x[0][0]) for x in kept.values())
                    if size > 2 * _FLUSH:
                        yield from map(out, kept)
                        kept, size = {}, 0
    yield from map(out, kept)


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Rates:
    """The logs of sorted grams, looked up at a hashed place; grams that share one are searched for."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.grams, self.logs = grams, logs
        self.shift = np.uint64(64 - min(max(len(grams).bit_length() + 3, 8), 22))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(grams)] = np.arange(len(grams))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def sums(self, seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sum of the logs of each framed text's grams, all of which must be there."""
        keys = _windows(seq)
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.grams[at] != keys)
        at[other] = np.minimum(np.searchsorted(self.grams, keys[other]), len(self.grams) - 1)
        each = self.logs[at]
        each[_across(starts)] = 0.0
        return np.add.reduceat(each, starts)


class Model:
    """log10 probability of the last byte of grams after the others, from counts of byte strings.

    For each order, sorted: the strings of context and next byte with their counts, and the contexts with their occurrences
    and different successors. As what follows a context follows each shorter one, the bytes excluded from an order are
    exactly those seen in the context one longer; so a context also holds what is left of the next shorter one's counts
    when its own bytes are excluded.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], one: tuple[np.ndarray, np.ndarray] | None = None):
        """counts: for orders 2 to ORDER, strings of context and next byte with their counts; one: those of order 1, taken from
        order 2 where not given (counts then hold all grams)."""
        two = tuple(np.asarray(x, np.int64) for x in counts[0])
        one = _summed(two[0] & 0xFFFF, two[1]) if one is None else one
        self.orders: list[tuple[np.ndarray, ...]] = []
        for order, (keys, n) in enumerate([(one[0] & 0xFF, one[1]), one, *counts]):
            keys, n = _summed(np.asarray(keys, np.int64), np.asarray(n, np.int64))
            contexts, first = np.unique(keys >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(keys) else n
            seen = np.diff(np.append(first, len(keys)))
            left = more = np.zeros(0, np.int64)
            if order and len(keys):
                k, m, c, t, d = self.orders[-1][:5]
                up = _place(c, contexts & ((1 << 8 * (order - 1)) - 1))[0]
                left = t[up] - np.add.reduceat(m[_place(k, keys & ((1 << 8 * order) - 1))[0]], first)
                more = d[up] - seen
            self.orders.append((keys, n, contexts, total, seen, left, more))

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        grams = np.asarray(grams, np.int64)
        out = np.zeros(len(grams))
        todo, longer = np.arange(len(grams)), np.full(len(grams), -1)  # grams not found yet, and their context one longer
        for order in range(ORDER, -1, -1):
            keys, n, contexts, total, seen = self.orders[order][:5]
            own = grams[todo] & ((1 << 8 * (order + 1)) - 1)
            c, known = _place(contexts, own >> 8)
            todo_known, c, via = todo[known], c[known], longer[known]
            if len(c):
                t, d = total[c], seen[c]
                if order < ORDER:
                    above, rest = self.orders[order + 1][5:], via >= 0
                    t[rest], d[rest] = above[0][via[rest]], above[1][via[rest]]
                d = np.where(seen[c] == 256, 0, d)  # nothing is left to escape to
                at, found = _place(keys, own[known])
                whole = np.log10(np.maximum(t + d, 1))
                out[todo_known] += np.where(found, np.log10(n[at]), np.where(t > 0, np.log10(np.maximum(d, 1)), 0.0)) - np.where(t > 0, whole, 0.0)
                longer[known] = c
                open_ = ~known
                open_[np.flatnonzero(known)[~found]] = True
                todo, longer = todo[open_], longer[open_]
        out[todo] -= np.log10(256 - (self.orders[0][4][0] if len(self.orders[0][0]) else 0)) if len(todo) else 0.0
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included."""
        out = [np.zeros(0)]
        for a, b in _slices(offsets):
            seq, starts = framed(data, offsets[a : b + 1])
            grams = np.unique(_windows(seq))
            out.append(Rates(grams, self.logs(grams)).sums(seq, starts))
        return np.concatenate(out)


def rated(counts: DataFrame) -> DataFrame:
    """(gram, log): log10 probability of each gram of counts(gram, n) under the model of all those with n > 0."""
    spark = counts.sparkSession
    low = counts.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    one = spark.sparkContext.broadcast((low.column("gram").to_numpy(), low.column("n").to_numpy()))  # at most 2^16
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if not own:
            return
        table = pa.Table.from_batches(own)
        grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        keys, m = grams[n > 0], n[n > 0]
        model = Model([(keys & ((1 << 8 * (order + 1)) - 1), m) for order in range(2, ORDER + 1)], one.value)
        for a in range(0, len(grams), _FLUSH):
            yield pa.RecordBatch.from_arrays([pa.array(grams[a : a + _FLUSH]), pa.array(model.logs(grams[a : a + _FLUSH]))], ["gram", "log"])

    return counts.select("gram", "n").repartition(shares, F.shiftright("gram", 8).bitwiseAND(0xFFFF)).mapInArrow(run, "gram long, log double")


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition's texts; the empty word stands for a text's end."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts(batch.column(0)):
            seen.update(text.translate(LOWER).split())
            if len(seen) > _FLUSH:
                yield out()
                seen.clear()
        seen[b""] += batch.num_rows
    yield out()


def score(docs: DataFrame, held_out, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: Boolean Column; the rows where it holds are scored but not learnt from. base_score: log10 probability under
    add-one word frequencies (words are what stands between spaces, A-Z lower-cased; the end of a text is a token).
    score: log10 probability of the text's bytes and end under PPM. A null text counts as empty; an empty text has the one
    token end; repeated rows and null ids each give a row; with no training rows, every byte has 1/256. Other columns of
    docs are ignored.

    Words among the max_frequent commonest are looked up in a broadcast dictionary; the others go through a shuffled join
    on the word, keyed by the text's digest and listed once a partition, so that copies of a text make no hot key.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = stored(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.spark_partition_id().alias("block")), "texts")
    learnt = docs.where(~F.col("held_out")).select("text")
    grams = stored(docs.select("block", "text", "held_out").mapInArrow(gram_counts, "block int, gram long, n long"), "grams")
    by_gram = rated(stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "counts"))
    blocks = (docs.agg(F.max("block")).first()[0] or 0) + 1
    counts = stored(learnt.mapInArrow(word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2(F.col("n")) * 8)
    by_level = sorted(counts.where("n > 0").groupBy(level.alias("l")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect(), reverse=True)
    total, distinct, floor, many = sum(r.n for r in by_level), sum(r.v for r in by_level), 10_000, 0
    for r in by_level:  # at most 8 * 63 rows
        if (many := many + r.v) > max_frequent:
            break
        floor = r.l
    usual = counts.where((level >= floor) & (F.col("n") > 0) | (F.length("word") == 0)).toArrow()
    frequent = dict(zip(usual.column("word").to_pylist(), usual.column("n").to_pylist(), strict=True))
    known = sc.broadcast((frequent, total, distinct))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, word, times, first) of a partition's distinct texts; first: 1 in one row of each text listed, else 0."""
        common, seen = known.value[0], set()
        keys, words, times, first = [], [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array(first, pa.int64())], ["key", "word", "times", "first"])

        for batch in batches:
            for text in texts(batch.column(0)):
                own = Counter(w for w in text.translate(LOWER).split() if w not in common)
                key = hashlib.md5(text).digest() if own else b""
                if not own or key in seen:
                    continue
                if len(seen) > _FLUSH // 2:
                    seen.clear()
                seen.add(key)
                keys += [key] * len(own)
                words += own.keys()
                times += own.values()
                first += [1] + [0] * (len(own) - 1)
                if len(words) > _FLUSH // 2:
                    yield out()
                    keys, words, times, first = [], [], [], []
        yield out()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, n_all, v_all = known.value
        logs = {w: float(np.log10((c + 1) / (n_all + v_all + 1))) for w, c in common.items()}
        asked, logged, rates = [], [], None
        for batch in batches:
            if rates is None:
                answers = batch.filter(pc.is_valid(batch.column(3)))
                asked.append(answers.column(3).to_numpy())
                logged.append(answers.column(4).to_numpy())
            batch = batch.filter(pc.is_null(batch.column(3)))
            if not batch.num_rows:
                continue
            if rates is None:  # the block's grams came first
                own, at = np.unique(np.concatenate(asked), return_index=True)
                rates = Rates(own, np.concatenate(logged)[at])
            rows, keys, tokens, hits, base, total = texts(batch.column(1)), [], [], [], [], [np.zeros(0)]
            for text in rows:
                words = text.translate(LOWER).split()
                words.append(b"")
                own = Counter(words)
                keys.append(hashlib.md5(text).digest())
                tokens.append(len(words))
                inside = [(t, logs[w]) for w, t in own.items() if w in logs]
                hits.append(sum(t for t, _ in inside) - (common.get(b"", 0) == 0 and b"" in logs))
                base.append(sum(t * x for t, x in inside))
            data, offsets = utf8(batch.column(1))
            for a, b in _slices(offsets):
                seq, starts = framed(data, offsets[a : b + 1])
                total.append(rates.sums(seq, starts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(total))],
                ["doc_id", "held_out", "key", "n_tokens", "n_known", "base", "score"],
            )

    id_type = docs.schema["doc_id"].dataType
    blank = lambda kind: F.lit(None).cast(kind)
    answers = grams.select("block", "gram").join(by_gram, "gram").select(blank(id_type).alias("doc_id"), blank("string").alias("text"), blank("boolean").alias("held_out"), "gram", "log", "block")
    both = docs.select("doc_id", "text", "held_out", blank("long").alias("gram"), blank("double").alias("log"), "block").union(answers)
    both = both.repartitionById(blocks, F.col("block")).sortWithinPartitions(F.isnull("gram")).drop("block")  # one block in each, its grams first
    rows = both.mapInArrow(scored, f"doc_id {id_type.simpleString()}, held_out boolean, key binary, n_tokens long, n_known long, base double, score double")
    each = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))
    rare = (
        docs.select("text").mapInArrow(rare_words, "key binary, word binary, times long, first long")
        .join(counts.where(level < floor), "word", "left")
        .groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"), F.sum(F.col("times") * each).alias("rare_base"), F.sum("first").alias("listed"))
        .select("key", F.expr("coalesce(rare_known, 0) div listed").alias("rare_known"), (F.col("rare_base") / F.col("listed")).alias("rare_base"))
    )
    return rows.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


__all__ = ["MARK", "ORDER", "Model", "framed", "gram_counts", "rated", "score", "word_counts"]
