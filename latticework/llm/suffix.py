"""Suffix-array dedup of byte strings, through a run-length index.

A string of LENGTH bytes that starts at two places is repeated; every byte that a repeated string covers is removed.

Placing: each string is assigned to an anchor, the last of the least hashes of its GRAM-byte grams. Equal strings choose
equal grams, so they meet where regions (maximal runs of strings with one anchor) are dealt by the gram's hash. Every string
lies in one region, so no string ever meets itself. Regions whose gram occurs once are left out; equal regions repeat whole,
and one of them stands for all where others have the same gram.

Passages: strings of PASSAGE bytes, shorter than what is removed, are found the same way and only counted.

Index: the regions of a share are written one after the other; of their Burrows-Wheeler transform the runs are kept,
with the suffix-array samples at each run's ends. The longest match of a suffix with its neighbour in suffix order is measured
at the run ends only; going through the text, a match shortens by one byte a step until the next sample (the matching
statistics of the text against itself). Positions with LENGTH or more start a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shares, stored, texts

LENGTH = 400
GRAM = 100
#: Bytes of a passage of some fifty words: repeated ones are counted beside what is removed.
PASSAGE = 250
#: Texts with spans that are broadcast to the texts' partitions.
MAX_SPANNED = 200_000
#: Regions that one task sorts, about.
_REGIONS = 1_000_000
#: Bytes of regions indexed together, unless one gram has more; bytes hashed together.
SHARE = 2_000_000
_SEGMENT = 1 << 19
_LOW = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = 0xFF  # in no UTF-8

_up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full((1 << 21) - 1, np.uint64(_BASE))]))
_down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full((1 << 21) - 1, np.uint64(pow(_BASE, -1, 1 << 64)))]))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each window of values."""
    n = len(values)
    whole = np.full(-(-n // window) * window, np.uint64(2**64 - 1))
    whole[:n] = values
    rows = whole.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, 1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - window + 1], ahead[window - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts in a row (at most 2^21 bytes): gram hash, content hash, text number, start in data, bytes, of each region."""
    if len(data) < length:
        return tuple(np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(5))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _up[: len(data)], dtype=np.uint64)])
    hashes = mix((sums[gram:] - sums[:-gram]) * _down[: len(data) - gram + 1])
    least = _least((hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64)), length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    long = np.diff(offsets) >= length
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    first = np.zeros(len(least), bool)
    first[offsets[:-1][long]] = True
    start = np.flatnonzero(inside & (first | np.concatenate([[True], least[1:] != least[:-1]])))
    text = np.searchsorted(offsets, start, "right") - 1
    last = offsets[text + 1] - length
    last[:-1] = np.minimum(last[:-1], start[1:] - 1)
    anchor = (_LOW - (least[start] & _LOW)).astype(np.int64)
    return hashes[anchor], (sums[last + length] - sums[start]) * _down[start], text, start, last + length - start


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, eight bytes at each position as a number), by doubling; only suffixes still tied are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    depth = 8
    while len(tied):
        own = order[tied]
        after = own + depth
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[own] * (n + 1) + second
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[tied] = own
        head = np.concatenate([[True], both[1:] != both[:-1]])
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(own)))
        rank[own] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order, key


class RunIndex:
    """The runs of a text's Burrows-Wheeler transform and the suffixes at their ends."""

    def __init__(self, text: np.ndarray):
        order, self.key = suffix_array(text)
        self.n = len(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbols = before[heads]
        self.lengths = np.diff(np.append(heads, self.n))
        self.first, self.last = order[heads], order[np.append(heads[1:], self.n) - 1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        depth = 0
        while len(live):
            x, y = a[live] + depth, b[live] + depth
            room = self.n - np.maximum(x, y)
            inside = room > 0
            live, x, y, room = live[inside], x[inside], y[inside], room[inside]
            other = self.key[x] ^ self.key[y]
            lead = np.where(other == 0, 8, 0)
            for j in range(1, 8):
                lead = np.where((other != 0) & (other < np.uint64(1 << (64 - 8 * j))), j, lead)
            lead = np.minimum(lead, room)
            out[live] += lead
            live = live[lead == 8]
            depth += 8
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string from there on that also starts elsewhere."""
        out = np.zeros(self.n, np.int64)
        if len(self.first) < 2:
            return out
        common = self._common(self.last[:-1], self.first[1:])
        at = np.arange(self.n)
        for samples in (self.first[1:], self.last[:-1]):
            reach = np.zeros(self.n, np.int64)
            reach[samples] = common + samples
            np.maximum(out, np.maximum.accumulate(reach) - at, out=out)
        return out


def repeated(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each region, whether the strings that start in it occur more than once among all of them."""
    text = np.frombuffer(b"".join(c + bytes([_SEPARATOR]) for c in contents), np.uint8)
    hit = RunIndex(text).matching_statistics() >= length
    ends = np.cumsum([len(c) + 1 for c in contents])
    return [hit[e - 1 - len(c) : e - length] for e, c in zip(ends, contents, strict=True)]


def _runs(flags: np.ndarray, length: int) -> np.ndarray:
    """(start, end) of the bytes covered by the strings that start where flags hold."""
    at = np.flatnonzero(flags)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], at[1:] > at[:-1] + length])
    cut = np.flatnonzero(new)
    return np.stack([at[cut], at[np.append(cut[1:], len(at)) - 1] + length], 1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans, those that touch or overlap as one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0])]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    cut = np.flatnonzero(new)
    return np.stack([spans[cut, 0], far[np.append(cut[1:], len(spans)) - 1]], 1)


def repeats(source: DataFrame, length: int = LENGTH, gram: int = GRAM, known: DataFrame | None = None) -> DataFrame:
    """(key, spans): of source(key, text), a key for each different text, the bytes that strings of length bytes cover which also
    start in another place of these texts, copies of a whole text left aside. spans: int64 pairs, sorted and disjoint.

    known (key, spans): bytes that count as covered already; where no region of a gram has others, the gram is left out.
    """
    spark = source.sparkSession
    long = source.where(F.octet_length("text") >= length).select("key", "text")
    spanned = long.withColumn("spans", F.lit(None).cast("binary"))
    if known is not None:
        few = known.limit(MAX_SPANNED + 1).count() <= MAX_SPANNED
        spanned = long.join(F.broadcast(known.select("key", "spans")) if few else known.select("key", "spans"), "key", "left")
    n_bytes = long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = shares(spark, 2 * n_bytes // (length - gram + 1), _REGIONS)
    buckets = 8 * parts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, blob): rows gram hash, content hash, key, start, bytes, open (not within a known span) of the regions of a
        partition's distinct texts."""
        seen: set[int] = set()
        held: list[np.ndarray] = []
        covered: dict[int, np.ndarray] = {}
        size = 0

        def closed(keys: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
            inside = np.zeros(len(keys), bool)
            for key in covered.keys() & set(keys.tolist()):
                own, spans = np.flatnonzero(keys == key), covered[key]
                at = np.searchsorted(spans[:, 0], start[own], "right") - 1
                inside[own] = (at >= 0) & (spans[at, 1] >= start[own] + n[own])
            return inside

        def out() -> pa.RecordBatch:
            every = np.concatenate(held)
            bucket = (every[:, 0] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            every, bucket = every[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([every[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "blob"])

        def add(pieces: list[tuple[int, int, bytes]]) -> int:
            data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
            ends = np.cumsum([0] + [len(p[2]) for p in pieces])
            h, c, text, start, n = regions(data, ends, length, gram)
            keys = np.array([p[0] for p in pieces], np.int64).astype(np.uint64)
            shift = np.array([p[1] for p in pieces], np.int64) - ends[:-1]
            start = start + shift[text]
            open_ = ~closed(keys[text].astype(np.int64), start, n) if covered else np.ones(len(h), bool)
            held.append(np.stack([h, c, keys[text], start.astype(np.uint64), n.astype(np.uint64), open_.astype(np.uint64)], 1))
            return len(h)

        for batch in batches:
            pieces, bytes_ = [], 0
            for key, text, spans in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                if spans:
                    covered[key] = np.frombuffer(spans, np.int64).reshape(-1, 2)
                for at in range(0, len(text) - length + 1, _SEGMENT):
                    piece = text[at : at + _SEGMENT + length - 1]
                    if bytes_ + len(piece) > 2 * _SEGMENT and pieces:
                        size += add(pieces)
                        pieces, bytes_ = [], 0
                    pieces.append((key, at, piece))
                    bytes_ += len(piece)
            if pieces:
                size += add(pieces)
            covered.clear()
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of grams that occur more than once: (key, fetch) regions to index as rows (gram hash, content, start, bytes),
        (content, key, starts) of all their regions, and (content, whole) the bytes of those that occur twice."""
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        names = ["key", "fetch", "content", "starts", "whole"]
        for bucket in list(held):
            rows = np.frombuffer(b"".join(held.pop(bucket)), np.uint64).reshape(-1, 6)
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 4], rows[:, 1], rows[:, 0]))]
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]  # equal texts from several partitions
            new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.append(np.flatnonzero(new), len(rows)))
            rows = rows[np.repeat((sizes > 1) & (np.add.reduceat(rows[:, 5], np.flatnonzero(new)) > 0), sizes)]
            if not len(rows):
                continue
            content = mix(rows[:, 0] ^ mix(rows[:, 1] + rows[:, 4])).astype(np.int64)
            gram_ = np.cumsum(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) - 1
            first = np.concatenate([[True], (rows[1:, [0, 1, 4]] != rows[:-1, [0, 1, 4]]).any(1)])
            at = np.flatnonzero(first)
            alone = np.diff(np.append(at, len(rows))) == 1
            # regions that occur twice repeat whole; an index is needed where others share their gram with different ones
            whole = at[~alone]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.binary()), pa.array(content[whole]), pa.nulls(len(whole), pa.binary()), pa.array(rows[whole, 4].astype(np.int64))], names)
            open_alone = np.bincount(gram_[at], alone & (rows[at, 5] > 0)) > 0
            wanted = at[(open_alone & (np.bincount(gram_[at]) > 1))[gram_[at]]]
            by_key = wanted[np.argsort(rows[wanted, 2], kind="stable")]
            if len(by_key):
                cut = np.flatnonzero(np.concatenate([[True], rows[by_key[1:], 2] != rows[by_key[:-1], 2]]))
                asked = np.stack([rows[:, 0], content.astype(np.uint64), rows[:, 3], rows[:, 4]], 1)
                fetch = [asked[g].tobytes() for g in np.split(by_key, cut[1:])]
                keys = rows[by_key[cut], 2].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fetch, pa.binary()), *(pa.nulls(len(keys), t) for t in (pa.int64(), pa.binary(), pa.int64()))], names)
            cut = np.flatnonzero(first | np.concatenate([[True], rows[1:, 2] != rows[:-1, 2]]))
            starts = [s.tobytes() for s in np.split(rows[:, 3], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows[cut, 2].astype(np.int64)), pa.nulls(len(cut), pa.binary()), pa.array(content[cut]), pa.array(starts, pa.binary()), pa.nulls(len(cut), pa.int64())], names)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, text, fetch) -> (bucket, gram, content, start, key, region)."""
        done: set[tuple[int, bytes]] = set()
        for batch in batches:
            out: list[tuple] = []
            for key, text, fetch in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                mark = (key, hashlib.blake2b(fetch, digest_size=8).digest())
                if mark in done:
                    continue
                done.add(mark)
                rows = np.frombuffer(fetch, np.uint64).reshape(-1, 4)
                signed = rows.astype(np.int64)
                out += ((int(h % np.uint64(buckets)), g, c, s, key, text[s : s + n]) for h, (g, c, s, n) in zip(rows[:, 0], signed.tolist(), strict=True))
            if out:
                b, g, c, s, k, r = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.int64()), pa.array(r, pa.binary())], ["bucket", "gram", "content", "start", "key", "region"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(content, spans): bytes of a region that repeated strings cover, from the index of its share."""
        held: dict[int, dict[tuple[int, int, int], tuple[int, bytes]]] = {}
        for batch in batches:
            for g, c, s, k, r in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                held.setdefault(g, {})[(c, k, s)] = (c, r)
        share: list[tuple[int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = {}
            for (c, _), flags in zip(share, repeated([r for _, r in share], length), strict=True):
                if flags.any():
                    found[c] = _runs(flags, length).tobytes()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["content", "spans"])

        for g in list(held):
            own = [*held.pop(g).values()]
            if len(own) > 1:
                share += own
                size += sum(len(r) for _, r in own)
            if size > SHARE:
                yield out()
                share, size = [], 0
        if share:
            yield out()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, starts, spans or whole) -> (key, spans) at the text's offsets."""
        for batch in batches:
            spans = []
            for starts, some, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = np.frombuffer(starts, np.uint64).astype(np.int64)
                own = np.array([[0, n]], np.int64) if some is None else np.frombuffer(some, np.int64).reshape(-1, 2)
                spans.append(merged((at[:, None, None] + own[None]).reshape(-1, 2)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary())], ["key", "spans"])

    placed = spanned.select("key", "text", "spans").mapInArrow(place, "bucket int, blob binary").repartition(parts, "bucket")
    chosen = stored(placed.mapInArrow(choose, "key long, fetch binary, content long, starts binary, whole long"), "chosen")
    fetch = chosen.where("fetch is not null").select("key", "fetch")
    cut = long.join(fetch, "key").select("key", "text", "fetch")
    cut = cut.mapInArrow(cut_out, "bucket int, gram long, content long, start long, key long, region binary").repartition(parts, "bucket")
    judged = stored(cut.mapInArrow(judge, "content long, spans binary"), "judged")
    where = chosen.where("starts is not null").select("key", "content", "starts")
    twice = where.join(chosen.where("whole is not null").select("content", "whole").distinct(), "content").select("key", "starts", F.lit(None).cast("binary").alias("spans"), "whole")
    where = where.join(judged, "content").select("key", "starts", "spans", F.lit(None).cast("long").alias("whole")).union(twice)
    spans = where.mapInArrow(spread, "key long, spans binary").groupBy("key").agg(F.array_join(F.transform(F.collect_list("spans"), lambda x: F.hex(x)), "").alias("spans"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, spans) with the spans merged."""
        for batch in batches:
            every = [merged(np.frombuffer(b, np.int64).reshape(-1, 2)).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.binary())], ["key", "spans"])

    return stored(spans.select("key", F.unhex("spans").alias("spans")).mapInArrow(whole, "key long, spans binary"), "spans")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, passage: int | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are bytes of UTF-8 and are judged as they came in; matches never cross texts. A null text counts as empty: 0 bytes,
    the hash of nothing. Rows with equal texts of at least length bytes repeat each other whole, repeated rows too. Ids play
    no part. keep_text adds the column kept: the remaining bytes (binary). Other columns are left out.

    passage (at most length): adds n_repeated, the bytes that strings of so many bytes cover which also start in another place;
    none of them is removed for that. What is removed repeats, so these bytes count, and only others are searched for.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    least = passage or length
    copies = source.where(F.octet_length("text") >= least).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("twice"))
    long = repeats(source, length, gram)
    marks = copies.join(long, "key", "full_outer")
    if passage:
        short = repeats(source, passage, max(8, gram * passage // length * 24 // 25), long)
        marks = marks.join(short.select("key", F.col("spans").alias("passages")), "key", "full_outer")
    else:
        marks = marks.withColumn("passages", F.lit(None).cast("binary"))
    marks = stored(marks, "marks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = lambda text, spans, twice, n: np.array([[0, len(text)]]) if twice and len(text) >= n else np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
        for batch in batches:
            many, gone, runs, digests, kept, again = [], [], [], [], [], []
            for text, spans, passages, twice in zip(texts(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                cut = spans_of(text, spans, twice, length)
                rest, done = [], 0
                for a, b in cut.tolist():
                    rest.append(text[done:a])
                    done = b
                left = b"".join([*rest, text[done:]])
                many.append(len(text))
                gone.append(len(text) - len(left))
                runs.append(len(cut))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
                both = merged(np.concatenate([cut, spans_of(text, passages, twice, least)])) if passage else cut
                again.append(int(np.diff(both, axis=1).sum()))
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (many, gone, runs)), pa.array(digests, pa.string())]
            columns += [pa.array(kept, pa.binary())] * keep_text + [pa.array(again, pa.int64())] * bool(passage)
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text, *["n_repeated"] * bool(passage)]
    both = source.join(marks, "key", "left").select("doc_id", "text", "spans", "passages", F.coalesce("twice", F.lit(False)).alias("twice"))
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text + ", n_repeated long" * bool(passage)
    return both.mapInArrow(finish, schema)
