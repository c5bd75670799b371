"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

Equal sets are one from the start. Shingles have a fixed order: by hash, those common to many sets last. Sets x and y that
link share one of the first |x| - ceil(0.75 |x|) + 1 shingles of x, and likewise of y, so sets meet in the tiles of those
shingles. Within a tile, sets stand in order of size, and only sizes within 3/4 of each other (a band) are paired, if enough
shingles are left from the shared one on, which a link's first shared shingle always has. A pair is then held against the
bitmaps of its sets, hashed into at least eight bits a shingle: x has at least as many shingles that y lacks as x's bitmap
has bits that y's lacks, which bounds the overlap from above. (In tiles of LONG and more sets this is done on the spot, so
that a tile gives few pairs.) What is left meets the exact intersection of the sorted arrays.

All pairs of a tile are too many where near copies abound. So, first, a tile's sets of about one size are paired only with
one of them, the one with the smallest key, which near copies share in most of their tiles, so that a large group gives few
different pairs; their links give components. Tiles within one component are then done with. In the others, up to ROUNDS times, each
set is paired with the next one of another component, and with one of the tile's largest component that a hash draws, at no
more than two pairs a row. Last, the sets of tiles that still hold several components are paired across these, for which alone
the bitmaps are fetched: no link is lost, as any two sets that are not compared are already joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh, mix, shares, stored, texts
from .graph import components, joined

WORDS = 5
#: A shingle counts as common from so many distinct sets in one partition, and so many over all; at most MAX_COMMON are ordered last.
LOCAL_COMMON, COMMON, MAX_COMMON = 4, 16, 200_000
#: Tiles of so many sets get the bitmaps.
LONG = 16
#: More keys than this are joined by a shuffle instead of a broadcast.
MAX_KEYS = 500_000
_TOKENS = 1_500_000
_CACHE = 60_000
_PAIRS = 500_000
#: Rounds that join a tile's components by few pairs before all pairs across them: at most so many, and another one only after
#: more links than this.
ROUNDS, MANY_LINKS = 3, 10_000
#: Of the other component in a tile, so many sets are tried until one may link.
_NEXT = 4
_PLACE = 32
#: Prefix entries of one partition of tiles, about.
_SHARE = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of fewer words, one for all; of none, none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for j in range(WORDS):
        out = mix(out ^ h[j : n + j]) + np.uint64(j + 1)
    return np.unique(out)


def set_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), len(found))).astype(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    """One bit for each hash, in 64 to 16384 bits, at least eight a shingle where that suffices."""
    bits = 1 << min(14, max(6, int(8 * len(found) - 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(found & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No intersection of sets with these bitmaps and sizes is larger."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), 0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), 0)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def linked(overlap: int, n_a: int, n_b: int) -> bool:
    return 100 * overlap >= 75 * (n_a + n_b - overlap)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key) -> (doc_id, text_key, key, n, bitmap), and (key: shingle, n: sets) of common ones where bitmap is null."""
    seen: set[int] = set()
    pool: list[np.ndarray] = []
    size, ids = 0, None
    names = ["doc_id", "text_key", "key", "n", "bitmap"]

    def common() -> pa.RecordBatch:
        tokens = np.sort(np.concatenate([*pool, np.zeros(0, np.uint64)]))
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        many = np.diff(np.append(at, len(tokens)))
        keep = many >= LOCAL_COMMON
        k = tokens[at][keep].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.nulls(len(k), ids), pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(many[keep].astype(np.int64)), pa.nulls(len(k), pa.binary())], names)

    for batch in batches:
        ids = batch.schema.field(0).type
        keys, sizes, maps = [], [], []
        for text in texts(batch.column(2)):
            found = shingles(text)
            key = set_key(found)
            keys.append(key)
            sizes.append(len(found))
            maps.append(bitmap(found))
            if key not in seen:
                seen.add(key)
                pool.append(found)
                size += len(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names)
        if size > _TOKENS:
            yield common()
            pool, size = [], 0
    if pool:
        yield common()


def _records(blobs) -> np.ndarray:
    """Rows (shingle, key, size and position of the shingle in the set's order)."""
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 3)


def _may_link(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sizes are in band and enough shingles are left, if this one is the first in common."""
    n_a, n_b = place_a >> _PLACE, place_b >> _PLACE
    left = np.minimum(n_a - (place_a & ((1 << _PLACE) - 1)), n_b - (place_b & ((1 << _PLACE) - 1)))
    return (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)) & (7 * left >= 3 * (n_a + n_b))


def _bands(sizes: np.ndarray) -> np.ndarray:
    """Sizes by powers of 4/3: those that may link are in one band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(4 / 3)).astype(np.int64)


def _star_pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (shingle, key, place) in the order of shingle and place: each row's number and that of its tile's row with the
    smallest key in the band, and those of such rows in neighbouring bands, where they may link."""
    place = rows[:, 2].astype(np.int64)
    band = _bands(place >> _PLACE)
    order = np.lexsort((rows[:, 1], band, rows[:, 0]))
    shingle, band = rows[order, 0], band[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (band[1:] != band[:-1])])
    heads = np.flatnonzero(new)
    head = heads[np.cumsum(new) - 1]
    left, right = np.flatnonzero(~new), head[~new]
    beside = np.flatnonzero((shingle[heads[1:]] == shingle[heads[:-1]]) & (band[heads[1:]] == band[heads[:-1]] + 1))
    left, right = order[np.concatenate([left, heads[beside + 1]])], order[np.concatenate([right, heads[beside]])]
    ok = _may_link(place[left], place[right])
    return left[ok], right[ok]


def _run_pairs(begin: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's number with those from begin to end (of each row), _PAIRS or so at a time."""
    many = np.maximum(ends - begin, 0)
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        counts = many[at:stop]
        if counts.sum():
            left = np.repeat(np.arange(at, stop), counts)
            yield left, np.repeat(begin[at:stop], counts) + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = stop


def _cross_pairs(components: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a tile's row numbers in different components: what is outside the largest one with all."""
    _, label, many = np.unique(components, return_inverse=True, return_counts=True)
    order = np.lexsort((np.arange(len(label)), label, -many[label]))  # the largest component first
    starts = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
    ends = np.repeat(starts, np.diff(np.append(starts, len(order))))  # rows before a row's own component
    for left, right in _run_pairs(np.zeros(len(order), np.int64), ends):
        yield order[left], order[right]


def _next_pairs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (shingle, key, place, component) in the order of shingle and place: each row's number and that of the first row
    of the tile's next other component that may link, where there is one."""
    change = np.flatnonzero((rows[1:, [0, 3]] != rows[:-1, [0, 3]]).any(1)) + 1
    at = np.arange(len(rows))
    begin = np.append(change, len(rows))[np.searchsorted(change, at, "right")]
    left, right = [], []
    for step in range(_NEXT):
        some = begin + step < len(rows)
        at, begin = at[some], begin[some]
        to = begin + step
        ok = (rows[at, 0] == rows[to, 0]) & (rows[at, 3] != rows[to, 3]) & _may_link(rows[at, 2], rows[to, 2])
        left.append(at[ok])
        right.append(to[ok])
        at, begin = at[~ok], begin[~ok]
    return np.concatenate(left), np.concatenate(right)


def _probe_pairs(rows: np.ndarray, starts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (shingle, key, place, component) of tiles that start at starts: the number of each row outside its tile's largest
    component and that of a member of this one, drawn by hash, that may link, where one of _NEXT draws is such a member."""
    tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    order = np.lexsort((rows[:, 3], tile))
    new = np.concatenate([[True], (tile[order][1:] != tile[order][:-1]) | (rows[order, 3][1:] != rows[order, 3][:-1])])
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(rows)))
    by_size = np.lexsort((many, tile[order][begin]))
    largest = by_size[np.append(np.flatnonzero(np.diff(tile[order][begin][by_size])), len(by_size) - 1)]  # a run for each tile
    own = np.empty(len(rows), np.int64)
    own[order] = np.cumsum(new) - 1
    at = np.flatnonzero(own != largest[tile])
    left, right = [], []
    for step in range(_NEXT):
        run = largest[tile[at]]
        draw = mix(rows[at, 1].astype(np.uint64) ^ mix(rows[at, 0].astype(np.uint64) + np.uint64(salt * _NEXT + step)))
        to = order[begin[run] + (draw % many[run].astype(np.uint64)).astype(np.int64)]
        ok = _may_link(rows[at, 2], rows[to, 2])
        left.append(at[ok])
        right.append(to[ok])
        at = at[~ok]
    return np.concatenate(left), np.concatenate(right)


def _mixed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (shingle, a, place, component): those of tiles with several components, in the order of shingle, place and a;
    and where each tile starts."""
    own = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches]
    rows = np.concatenate([*own, np.zeros((0, 4), np.int64)])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    mixed = np.minimum.reduceat(rows[:, 3], starts) != np.maximum.reduceat(rows[:, 3], starts)
    many = np.diff(np.append(starts, len(rows)))
    return rows[np.repeat(mixed, many)], np.concatenate([[0], np.cumsum(many[mixed])[:-1]]).astype(np.int64) if mixed.any() else np.zeros(0, np.int64)


class _Bitmaps:
    """Bitmaps of a tile's sets, as matrices folded to each width."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray):
        self.maps, self.sizes = maps, sizes
        self.widths = np.array([len(m) for m in maps])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.folded:
            rows = np.zeros((len(self.maps), width), np.uint8)
            for i in np.flatnonzero(self.widths >= width):
                rows[i] = np.bitwise_or.reduce(np.frombuffer(self.maps[i], np.uint8).reshape(-1, width), 0)
            rows = rows.view(np.uint64)
            self.folded[width] = rows, np.bitwise_count(rows).sum(1, dtype=np.int64)
        return self.folded[width]

    def may_link(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        width = np.minimum(self.widths[left], self.widths[right])
        for w in np.unique(width):
            rows, ones = self._at(int(w))
            own = np.flatnonzero(width == w)
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                a, b = left[part], right[part]
                both = np.bitwise_count(rows[a] & rows[b]).sum(1, dtype=np.int64)
                most = both + np.minimum(self.sizes[a] - ones[a], self.sizes[b] - ones[b])
                out[part] = 7 * most >= 3 * (self.sizes[a] + self.sizes[b])
        return out


def _unique_pairs(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = rows[left, 1].astype(np.int64), rows[right, 1].astype(np.int64)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def _with_rows(pairs: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs and tile rows as (shingle, a, b, place, component): shingle is null for pairs, b for rows."""
    names = ["shingle", "a", "b", "place", "component"]
    if len(pairs):
        nothing = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, *_pair_batch(pairs).columns, nothing, nothing], names)
    for at in range(0, len(rows), _PAIRS):
        shingle, a, place, component = (pa.array(np.ascontiguousarray(c)) for c in rows[at : at + _PAIRS].T)
        yield pa.RecordBatch.from_arrays([shingle, a, pa.nulls(len(a), pa.int64()), place, component], names)


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join(docs: DataFrame, marks: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest id reachable by links).

    Texts without words, empty and null ones have no shingles and link with nothing: their component_id is their own id.
    Rows with equal sets are linked, repeated rows and rows that share an id too. A null id is never the smallest; a
    component of null ids only has none. Other columns are ignored. marks adds text_key (hash of the text) and chosen (whether
    a row stands for its component).
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    signed = stored(source.mapInArrow(_signatures, f"doc_id {id_type}, text_key long, key long, n long, bitmap binary"), "signatures")
    rows = signed.where("bitmap is not null")
    common = signed.where("bitmap is null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MAX_COMMON).toArrow()
    shingle, count = common.column("key").to_numpy().astype(np.uint64), common.column("n").to_numpy()
    order = np.argsort(shingle)
    last = sc.broadcast((shingle[order], count[order]))
    parts = shares(spark, (rows.agg(F.sum("n")).first()[0] or 0) // 4, _SHARE)
    buckets = 8 * parts

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = last.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate([*held, np.zeros((0, 3), np.uint64)])
            bucket = (every[:, 0] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            every, bucket = every[by], bucket[by]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([every[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for text in texts(batch.column(0)):
                found = shingles(text)
                key = set_key(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                n = len(found)
                if len(late):
                    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
                    places = np.where(late[at] == found, rank[at], 0)
                    if places.any():
                        found = found[np.argsort(places, kind="stable")]
                own = np.empty((n - -(-3 * n // 4) + 1, 3), np.uint64)
                own[:, 0], own[:, 1], own[:, 2] = found[: len(own)], np.int64(key).astype(np.uint64), (n << _PLACE) + np.arange(len(own))
                held.append(own)
                size += len(own)
            if size > _TOKENS // 3:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition's buckets: pairs (a, b) with each tile's smallest key, and the rows of shared shingles as (shingle, a, place)."""
        names = ["shingle", "a", "b", "place"]
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        for bucket in list(held):
            every = _records(held.pop(bucket))
            every = every[np.lexsort((every[:, 1], every[:, 2], every[:, 0]))]
            every = every[np.concatenate([[True], (every[1:] != every[:-1]).any(1)])]  # equal sets from several partitions
            starts = np.flatnonzero(np.concatenate([[True], every[1:, 0] != every[:-1, 0]]))
            many = np.diff(np.append(starts, len(every)))
            every = every[np.repeat(many > 1, many)]
            if not len(every):
                continue
            p = _unique_pairs(every, *_star_pairs(every))
            nothing = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, *_pair_batch(p).columns, nothing], names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in every[:, :2].T), pa.nulls(len(every), pa.int64()), pa.array(every[:, 2].astype(np.int64))], names)

    dealt = docs.select(F.col("text").cast("string")).mapInArrow(prefixes, "bucket int, blob binary").repartition(parts, "bucket")
    tiles = stored(dealt.mapInArrow(stars, "shingle long, a long, b long, place long"), "tiles")
    sets = stored(rows.where("n > 0").groupBy("key").agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")), "sets")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, x, y = (c.to_pylist() for c in batch.columns)
            keep = np.array([linked(bound(x[i], y[i], n_a[i], n_b[i]), n_a[i], n_b[i]) for i in range(len(a))], bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(2)], ["a", "b"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())], ["key", "found"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], ["a", "b"])

    fetched: list[DataFrame] = []

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link. The arrays of sets asked for before are not made again."""
        side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bitmap_{s}"))
        if pairs.isEmpty():
            return pairs
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
        near = stored(near.mapInArrow(bounded, "a long, b long"), "near")
        wanted = near.select(F.col("a").alias("key")).union(near.select("b")).distinct().join(sets.select("key", "text_key"), "key")
        for known in fetched:
            wanted = wanted.join(known.select("key"), "key", "left_anti")
        wanted = stored(wanted, "wanted")
        found = source.select("text_key", "text").join(_few(wanted, MAX_KEYS), "text_key").select("key", "text").mapInArrow(arrays, "key long, found binary")
        fetched.append(stored(found.dropDuplicates(["key"]), "arrays"))
        every = reduce(DataFrame.union, fetched)
        both = near.join(every.select(F.col("key").alias("a"), F.col("found").alias("x")), "a").join(every.select(F.col("key").alias("b"), F.col("found").alias("y")), "b")
        return stored(both.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"), "links")

    def beside(salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(shingle, a, place, component) -> of mixed tiles, pairs (a, b) of sets in different components, and the rows."""
            tile, starts = _mixed(batches)
            if len(tile):
                found = zip(_next_pairs(tile), _probe_pairs(tile, starts, salt), strict=True)
                yield from _with_rows(_unique_pairs(tile, *map(np.concatenate, found)), tile)

        return run

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, a, place, component) -> of short mixed tiles, pairs (a, b) across components; of long ones, the rows."""
        rows, starts = _mixed(batches)
        many = np.diff(np.append(starts, len(rows)))
        some = rows[np.repeat(many < LONG, many)]
        ends = np.searchsorted(some[:, 0], some[:, 0], "right")
        for left, right in _run_pairs(np.arange(len(some)) + 1, ends):
            ok = (some[left, 3] != some[right, 3]) & _may_link(some[left, 2], some[right, 2])
            yield from _with_rows(_unique_pairs(some, left[ok], right[ok]), rows[:0])
        yield from _with_rows(np.zeros((0, 2), np.int64), rows[np.repeat(many >= LONG, many)])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shingle, a, place, component, bitmap) of long tiles -> pairs across components that may link by their bitmaps."""
        table = pa.Table.from_batches(list(batches), pa.schema([("shingle", pa.int64()), ("a", pa.int64()), ("place", pa.int64()), ("component", pa.int64()), ("bitmap", pa.binary())]))
        if not len(table):
            return
        order = np.lexsort([table.column(i).to_numpy() for i in (1, 2, 0)])
        rows = np.stack([table.column(i).to_numpy()[order] for i in range(4)], 1)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        for at, end in zip(starts, np.append(starts[1:], len(rows)), strict=True):
            tile = rows[at:end]
            held = _Bitmaps([table.column(4)[int(i)].as_py() for i in order[at:end]], tile[:, 2] >> _PLACE)
            for left, right in _cross_pairs(tile[:, 3]):
                ok = _may_link(tile[left, 2], tile[right, 2])
                left, right = left[ok], right[ok]
                ok = held.may_link(left, right)
                yield _pair_batch(_unique_pairs(tile, left[ok], right[ok]))

    def grouped(tiles: DataFrame, part: DataFrame) -> DataFrame:
        """The tiles' rows with their component so far, a tile in one partition."""
        own = tiles.where("shingle is not null").select("shingle", "a", "place").join(part.select(F.col("node").alias("a"), "component"), "a", "left")
        return own.select("shingle", "a", "place", F.coalesce("component", "a").alias("component")).repartition(parts, "shingle")

    pairs = lambda df: df.where("shingle is null").select("a", "b").distinct()
    asked = stored(pairs(tiles), "pairs")
    part = stored(components(links(asked)), "components")
    for salt in range(ROUNDS):
        tiles = stored(grouped(tiles, part).mapInArrow(beside(salt), "shingle long, a long, b long, place long, component long"), "tiles")
        more = stored(pairs(tiles).join(asked, ["a", "b"], "left_anti"), "pairs")
        found = links(more)
        part, asked = joined(part, found), asked.union(more)
        if found.count() <= MANY_LINKS:
            break
    tiles = stored(grouped(tiles, part).mapInArrow(sifted, "shingle long, a long, b long, place long, component long"), "tiles")
    long = tiles.where("shingle is not null").join(sets.select(F.col("key").alias("a"), "bitmap"), "a").select("shingle", "a", "place", "component", "bitmap")
    others = long.repartition(parts, "shingle").mapInArrow(across, "a long, b long").union(tiles.where("shingle is null").select("a", "b")).distinct()
    whole = joined(part, links(stored(others.join(asked, ["a", "b"], "left_anti"), "pairs")))
    least = rows.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")).join(whole.withColumnRenamed("node", "key"), "key", "left")
    least = least.select("key", "least", F.coalesce("component", "key").alias("component"))
    names = least.groupBy("component").agg(F.min("least").alias("best"))
    known = least.join(names, "component").select(F.col("key").alias("_key"), "best")
    out = rows.join(known, (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    chosen = F.coalesce(F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & F.col("best.text_key").eqNullSafe(F.col("text_key")), F.lit(True))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", F.when(F.col("n") > 0, chosen).otherwise(F.lit(True)).alias("chosen"))
    return out if marks else out.drop("text_key", "chosen")


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ..) without near duplicates: of each component, one row with its smallest id (and, among
    rows of that id, smallest text hash); all rows without shingles stay, but for repeated ones. Any other column names do."""
    own_id, own_text, key = fresh(docs, "own_id", "own_text", "text_hash")
    chosen = join(docs, marks=True).where("chosen").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_text)).distinct()
    chosen = stored(chosen, "chosen")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(_few(chosen, MAX_KEYS), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_text)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)


def join_sql() -> str:
    """join over documents, by counting the shared shingles of all pairs that share one."""
    space = r"[^\x20\x09-\x0D]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with recursive w as (select doc_id, regexp_extract_all({lower}, '{space}') ws from documents),
    s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh, len(ws) < 5 few from w),
    x as (select doc_id, len(sh) n, few, unnest(sh) t from s),
    p as (select a.doc_id a, b.doc_id b from x a join x b on a.t = b.t and a.few = b.few and a.doc_id < b.doc_id group by 1, 2
      having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    e as (select a, b from p union all select b, a from p),
    r as (select doc_id, doc_id c from s union select e.b, r.c from r join e on e.a = r.doc_id where r.c < e.b)
    select s.doc_id, len(s.sh)::bigint n_shingles, min(r.c) component_id from s join r using (doc_id) group by 1, 2"""
