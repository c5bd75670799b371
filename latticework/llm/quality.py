"""Quality rules: word and line counts, and a log-likelihood ratio of hashed n-grams.

Every run of four bytes of a text is hashed into one of 2^16 bins. Two multinomials over the bins, both with add-one
smoothing, are counted: the raw one over all texts, the trusted one over labelled good texts. A text's score is the mean,
over its n-grams, of log2(trusted / raw): length-normalised, so that long and short texts meet the same threshold. The
ratios are rounded to multiples of 2^-16 and summed as integers, so that the verdict on a text does not depend on
floating-point order; a text is kept if its sum is at least threshold times its n-grams and no base rule fails.

The threshold comes from the labels: it is the score that a fixed share (LOSS) of the trusted texts fall short of, each scored
with its own n-grams taken out of the trusted counts, as a text that was not labelled would be.

The trusted texts are a bounded sample of the labels (max_trusted, those with the smallest hashed ids); the raw counts cover
all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, texts, utf8

BINS = 1 << 16
GRAM = 4
#: Labelled good texts that the trusted counts are taken from, at most.
MAX_TRUSTED = 20_000
#: Share of trusted texts, scored without themselves, that the threshold may reject.
LOSS = 0.01
#: Fewer trusted texts than this give no threshold.
MIN_SCORED = 100
#: Least mean log2 ratio of a kept text, in multiples of 2^-16, where the labels give none.
THRESHOLD = -round(0.5 * 65_536)
SYMBOLS = b"#*$%&|<>"
_CHUNK = 1 << 21


def bins(data: np.ndarray) -> np.ndarray:
    """The bin of each n-gram that starts in data."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    wide = data.astype(np.uint32)
    key = wide[: len(data) - GRAM + 1].copy()
    for j in range(1, GRAM):
        key = (key << np.uint32(8)) | wide[j : len(data) - GRAM + 1 + j]
    return ((key ^ (key >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(16)


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bin, raw, trusted) of a partition's rows (text, trusted)."""
    raw, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, flag in zip(offsets[:-1], offsets[1:], flags, strict=True):
            for at in range(a, b, _CHUNK):
                own = bins(data[at : min(b, at + _CHUNK + GRAM - 1)])
                raw += np.bincount(own, minlength=BINS)
                if flag:
                    good += np.bincount(own, minlength=BINS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bin", "raw", "trusted"])


def _flagged(docs: DataFrame, labels: DataFrame | None, max_trusted: int) -> DataFrame:
    """(text, trusted); labels(doc_id, quality, toxic): trusted are the ids with quality 1 and not toxic."""
    if labels is None:
        return docs.select("text", F.lit(False).alias("trusted"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def _ratio(trusted: np.ndarray, n_trusted: int, raw: np.ndarray, n_raw: int) -> np.ndarray:
    """log2(trusted / raw) in multiples of 2^-16, from counts in bins and in all."""
    return np.rint(65_536 * (np.log2((trusted + 1) / (n_trusted + BINS)) - np.log2((raw + 1) / (n_raw + BINS)))).astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame | None, max_trusted: int = MAX_TRUSTED) -> tuple[np.ndarray, int]:
    """log2(trusted / raw) of each bin in multiples of 2^-16, and the least mean of a kept text.

    All ratios are 0 where no trusted text is found. The threshold is THRESHOLD where fewer than MIN_SCORED trusted texts
    pass the base rules.
    """
    flagged = _flagged(docs, labels, max_trusted)
    table = flagged.mapInArrow(counts, "bin long, raw long, trusted long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, trusted = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    at = table.column("bin").to_numpy()
    raw[at], trusted[at] = table.column("raw").to_numpy(), table.column("trusted").to_numpy()
    if not trusted.any():
        return np.zeros(BINS, np.int64), THRESHOLD
    shipped = docs.sparkSession.sparkContext.broadcast((raw, trusted))

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = shipped.value
        n_raw, n_trusted = int(raw.sum()), int(trusted.sum())
        for batch in batches:
            means = []
            for text in texts(batch.column(0)):
                own = bins(np.frombuffer(text, np.uint8))
                if len(own) and not _failed(*(np.array([x]) for x in measure(text)[::4]))[0]:
                    at, n = np.unique(own, return_counts=True)
                    means.append(int((_ratio(trusted[at] - n, n_trusted - len(own), raw[at], n_raw) * n).sum()) // len(own))
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.int64())], ["mean"])

    least = flagged.where("trusted").select("text").mapInArrow(without_itself, "mean long")
    least = least.agg(F.count("*").alias("n"), F.expr(f"percentile_disc({LOSS}) within group (order by mean)").alias("at")).first()
    return _ratio(trusted, int(trusted.sum()), raw, int(raw.sum())), int(least["at"]) if least["n"] >= MIN_SCORED else THRESHOLD


def _failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or over 20 % of the words repeated."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more, the first included."""
    n = len(words)
    if n < 6:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, n)
    key = np.zeros(n - 4, np.uint64)
    for j in range(5):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - 4 + j] + np.uint64(1)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 4, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    edge[: n - 4] += twice
    edge[5 : n + 1] -= twice
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, SPACES)
    chars = len(solid.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(solid) - len(solid.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def assess(docs: DataFrame, labels: DataFrame | None, max_trusted: int = MAX_TRUSTED, threshold: int | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr (mean log2 ratio), then the other columns of docs.

    base_failed: fewer than 10 words, or over 20 % of the words repeated. A null text counts as empty and fails; a text
    without n-grams has llr 0. Columns of docs that are named like a result, in any case, are left out. No labels, or none of the ids in
    them among docs: every ratio is 0 and the base rules decide. threshold: the least mean in multiples of 2^-16 instead of that
    from the labels.
    """
    ratio, least = fitted(docs, labels, max_trusted)
    least = least if threshold is None else threshold
    shipped = docs.sparkSession.sparkContext.broadcast(ratio)
    found = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    names = [f.split()[0] for f in found.split(", ")]
    rest = [c for c in docs.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shipped.value
        where = rest.index("text")
        for batch in batches:
            rows = texts(batch.column(where))
            cells = np.array([measure(t) for t in rows], np.int64).reshape(-1, 5)
            total, many = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for i, t in enumerate(rows):
                own = bins(np.frombuffer(t, np.uint8))
                total[i], many[i] = ratio[own].sum(), len(own)
            failed = _failed(cells[:, 0], cells[:, 4])
            kept = ~failed & (total >= least * many)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in cells.T), pa.array(failed), pa.array(kept), pa.array(total / np.maximum(many, 1) / 65_536)], [*rest, *names]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    out = docs.select([F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{schema}, {found}")
    return out.select("doc_id", *names, *[f"`{c}`" for c in rest if c != "doc_id"])
