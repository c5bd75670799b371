"""WARC fixity audit with Merkle trees.

An archive is records at byte offsets. Its tree: a record's leaf is the SHA-256 of its bytes; a node of the lowest level is a
range of consecutive records, those whose ids share all but the last RANGE_BITS bits, and hashes, in order of offset, their
distances from the range's start, lengths and hashes; a node of a higher level hashes the numbers and hashes of up to FANOUT
nodes of the level below; the root covers all. As ranges are aligned by id and hash distances, a record that is cut short or lost
in one replica, which shifts the offsets of all that follow, changes its own range and the nodes above it only.

Two replicas whose roots are equal are equal. Otherwise only the children of nodes that differ are compared, level by level,
and in the end only the records of the ranges that differ.

Ids may repeat or be null, even for a third of all records: a range of more than HEAVY records is dealt into shares by the
records' hashes, with a tree of their own below the range, so that no task gathers more than some HEAVY records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, stored

RANGE_BITS, FAN_BITS = 6, 4
FANOUT = 1 << FAN_BITS
HEAVY = 4_096
#: More heavy ranges than this are joined by a shuffle instead of a broadcast.
MAX_HEAVY = 100_000
_NULLS = -(1 << 62)  # the range of null ids
_MANIFEST = "record_id long, offset long, length long, digest string"


def payload(page_id: str, url: str, body: Column) -> Column:
    """The bytes of a page's resource record; nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(page_id), F.lit(">\r\nWARC-Target-URI: "), text(url), F.lit("\r\nContent-Length: "))
    return F.concat(head, F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).cast("binary")


def records(data: bytes) -> Iterator[tuple[int | None, int, int, str]]:
    """(record_id, offset, length, digest) of the records in a WARC file, plain or one gzip member a record.

    record_id is the number that ends the WARC-Record-ID, null where none does. Bytes that are no whole record end the file: they
    are one record without an id.
    """
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            try:
                whole = unzip.decompress(data[at:])
            except zlib.error:
                whole = b""
            end = len(data) - len(unzip.unused_data) if unzip.eof else len(data)
        else:
            whole, end = data[at:], None
        head = whole.find(b"\r\n\r\n")
        fields = dict(x.split(b":", 1) for x in whole[:head].lower().split(b"\r\n")[1:] if b":" in x) if head >= 0 and whole.startswith(b"WARC/") else {}
        size = fields.get(b"content-length", b"").strip()
        if end is None:
            end = at + head + 8 + int(size) if size.isdigit() and at + head + 8 + int(size) <= len(data) else len(data)
        digits = fields.get(b"warc-record-id", b"").strip().rstrip(b">").rpartition(b":")[2]
        yield int(digits) if digits.isdigit() and len(digits) < 19 else None, at, end - at, hashlib.sha256(data[at:end]).hexdigest()
        at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The manifest (file, record_id, offset, length, digest) of the WARC files at a path; a task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(records(data))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *columns], ["file", "record_id", "offset", "length", "digest"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {_MANIFEST}")


def offsets(records: DataFrame) -> DataFrame:
    """records(record_id, digest, length) and offset: where each starts if they follow each other by id, then digest, null ids first.

    Records are dealt into ranges of about equal number; the ranges' sizes, one number each, are summed on the driver. Equal
    records may fall into several ranges: which of them comes first makes no difference.
    """
    order = [F.asc_nulls_first("record_id"), F.asc("digest"), F.asc("nth")]
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = stored(records.select("record_id", "digest", "length", F.monotonically_increasing_id().alias("nth")), "records")
    dealt = stored(numbered.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    begin, starts = 0, []
    for r in dealt.groupBy("part").agg(F.sum("length").alias("size")).orderBy("part").collect():  # a row for each partition
        starts.append((r.part, begin))
        begin += r.size
    first = F.broadcast(records.sparkSession.createDataFrame(starts, "part int, begin long"))
    before = F.sum("length").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("inside", F.coalesce(before, F.lit(0))).join(first, "part").select("record_id", (F.col("begin") + F.col("inside")).alias("offset"), "length", "digest")


def ranged(a: DataFrame, b: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """Both replicas with node (number of a record's range) and sub (its share, 0 unless the range is heavy in either)."""
    node = F.coalesce(F.shiftright("record_id", RANGE_BITS), F.lit(_NULLS)).alias("node")
    many = lambda v: v.groupBy(node).agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    crowds = stored(many(a).union(many(b)).groupBy("node").agg(F.max("n").alias("n")), "heavy")
    crowds = F.broadcast(crowds) if crowds.limit(MAX_HEAVY + 1).count() <= MAX_HEAVY else crowds
    share = F.coalesce(F.pmod(F.xxhash64("digest", "length"), F.ceil(F.col("n") * FANOUT / heavy)), F.lit(0)).cast("long").alias("sub")
    return tuple(v.select("*", node).join(crowds, "node", "left").select("node", share, "record_id", "offset", "length", "digest") for v in (a, b))


def _hashed(parts: Column, line) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(parts), line), "\n").cast("binary"), 256)


def tree(replica: DataFrame, steps: list[str]) -> list[DataFrame]:
    """The levels (node, sub, hash) of a replica (node, sub, offset, length, digest), from the ranges up to the root, after steps:
    "sub" or "node" is the number that the next level leaves FAN_BITS bits of out."""
    start = F.min("offset")
    line = lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])
    own = replica.groupBy("node", "sub").agg(start.alias("start"), F.collect_list(F.struct("offset", "length", "digest")).alias("rows"))
    # equal records of a share may stand anywhere in the range: shares hash no distances
    shift = lambda x: F.struct(F.when(F.col("sub") == 0, x["offset"] - F.col("start")).otherwise(0).alias("offset"), x["length"].alias("length"), x["digest"].alias("digest"))
    levels = [stored(own.select("node", "sub", _hashed(F.transform("rows", shift), line).alias("hash")), "merkle")]
    for step in steps:
        line = lambda x: F.concat_ws(":", x["node"].cast("string"), x["sub"].cast("string"), x["hash"])
        up = {"node": F.col("node"), "sub": F.col("sub")} | {step: F.shiftright(step, FAN_BITS)}
        above = levels[-1].groupBy(up["node"].alias("up"), up["sub"].alias("up_sub")).agg(_hashed(F.collect_list(F.struct("node", "sub", "hash")), line).alias("hash"))
        levels.append(stored(above.select(F.col("up").alias("node"), F.col("up_sub").alias("sub"), "hash"), "merkle"))
    return levels


def _steps(a: DataFrame, b: DataFrame) -> list[str]:
    """What it takes until every number is 0 or, below 0, -1."""
    far = a.select("node", "sub").union(b.select("node", "sub")).agg(F.max("sub").alias("sub"), F.max("node").alias("high"), F.min("node").alias("low")).first()
    bits = lambda x: x.bit_length()
    nodes = max(bits(max(far.high or 0, 0)), bits(-min(far.low or 0, 0) - 1 if (far.low or 0) < 0 else 0))
    return ["sub"] * -(-bits(far.sub or 0) // FAN_BITS) + ["node"] * -(-nodes // FAN_BITS)


def audit(a: DataFrame, b: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Where two replicas (record_id, offset, length, digest) differ: record_id, status, offset_a, offset_b, length_a, length_b,
    digest_a, digest_b, leaf (number of the range).

    Records of equal id, length and digest are the same wherever they stand, as often as they stand in both. Of what is left of
    an id, the first ones by offset of either replica are modified into each other; then come missing (only in a) or extra
    (only in b) ones. Null ids are one id. Ranges in which only distances differ give no rows, nor do equal replicas, empty ones
    included.
    """
    a, b = (stored(v, "manifest") for v in ranged(a, b, heavy))
    steps = _steps(a, b)
    wrong = None
    for k, (x, y) in reversed([*enumerate(zip(tree(a, steps), tree(b, steps), strict=True))]):
        if wrong is not None:
            up = {"node": F.col("node"), "sub": F.col("sub")} | {steps[k]: F.shiftright(steps[k], FAN_BITS)}
            x, y = (v.join(wrong, (up["node"] == F.col("bad")) & (up["sub"] == F.col("bad_sub")), "left_semi") for v in (x, y))
        both = x.withColumnRenamed("hash", "hash_a").join(y.withColumnRenamed("hash", "hash_b"), ["node", "sub"], "full_outer")
        wrong = stored(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(F.col("node").alias("bad"), F.col("sub").alias("bad_sub")), "wrong")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("offset"))
    pick = lambda v: v.join(wrong, (F.col("node") == F.col("bad")) & (F.col("sub") == F.col("bad_sub")), "left_semi").withColumn("copy", nth("node", "sub", "record_id", "length", "digest"))
    x, y = pick(a), pick(b)
    alike = lambda s, t: F.col(f"{s}.record_id").eqNullSafe(F.col(f"{t}.record_id")) & (F.col(f"{s}.digest") == F.col(f"{t}.digest")) & (F.col(f"{s}.length") == F.col(f"{t}.length")) & (F.col(f"{s}.copy") == F.col(f"{t}.copy"))
    only = lambda s, t: s.alias("s").join(t.alias("t"), alike("s", "t"), "left_anti").withColumn("place", nth("record_id")).select("record_id", "offset", "length", "digest", F.col("node").alias("leaf"), "place")
    x, y = stored(only(x, y), "only").alias("x"), stored(only(y, x), "only").alias("y")
    both = x.join(y, F.col("x.record_id").eqNullSafe(F.col("y.record_id")) & (F.col("x.place") == F.col("y.place")), "full_outer")
    status = F.when(F.col("x.place").isNull(), "extra").when(F.col("y.place").isNull(), "missing").otherwise("modified")
    each = [F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in ("offset", "length", "digest") for s, t in (("x", "a"), ("y", "b"))]
    return both.select(F.coalesce("x.record_id", "y.record_id").alias("record_id"), status.alias("status"), *each, F.coalesce("x.leaf", "y.leaf").alias("leaf"))


def damaged(body: str, record_id: str) -> Column:
    """What a second replica holds for a page, for trials: of the pages whose crc32(id) mod 97 is 0 the last character is
    another, of those with 1 half is cut off; null: with 2, the record is gone."""
    r = F.crc32(F.coalesce(F.col(record_id).cast("string"), F.lit("")).cast("binary")) % 97
    whole = F.coalesce(F.col(body), F.lit(""))
    flipped = F.concat(F.expr(f"left(coalesce({body}, ''), greatest(length(coalesce({body}, '')) - 1, 0))"), F.lit("\x1a"))
    return F.when(r == 0, flipped).when(r == 1, F.expr(f"left(coalesce({body}, ''), length(coalesce({body}, '')) div 2)")).when(r == 2, None).otherwise(whole)


def manifest(bytes_: DataFrame) -> DataFrame:
    """(record_id, offset, length, digest) of records(record_id, payload) that follow each other by id."""
    return offsets(bytes_.select("record_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("length")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """audit of the archive of pages(page_id, url, html) against its damaged replica, each at offsets of its own.

    Null ids, urls and bodies, repeated rows, empty tables and other columns (left out) are fine; a body is held whole.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    held = pages.withColumn("html", damaged("html", "page_id")).where(F.col("html").isNotNull())
    both = (v.select(F.col("page_id").alias("record_id"), payload("page_id", "url", F.col("html")).alias("payload")) for v in (pages, held))
    return audit(*map(manifest, both))


def audit_sql() -> str:
    """The rows of audit_pages over pages."""
    body = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
    side = lambda t: f"select page_id, strlen(p) n, sha256(p) d from (select page_id, {body} p from {t})"
    placed = lambda t: f"select *, (coalesce(sum(n) over (order by page_id nulls first, d rows between unbounded preceding and 1 preceding), 0))::bigint o, row_number() over (partition by page_id, n, d order by 1) c from ({side(t)})"
    left = lambda s, t: f"select *, row_number() over (partition by page_id order by o) k from {s} where not exists (select 1 from {t} where {t}.page_id is not distinct from {s}.page_id and {t}.n = {s}.n and {t}.d = {s}.d and {t}.c = {s}.c)"
    return f"""
    with w as (select page_id, url, coalesce(html, '') html, crc from (select *, {crc32_sql("coalesce(page_id::varchar, '')")} crc from pages)),
    h as (select page_id, url, case crc % 97 when 0 then substr(html, 1, greatest(length(html) - 1, 0)) || chr(26) when 1 then substr(html, 1, length(html) // 2) else html end html from w where crc % 97 <> 2),
    a as ({placed('w')}), b as ({placed('h')}), x as ({left('a', 'b')}), y as ({left('b', 'a')})
    select coalesce(x.page_id, y.page_id) record_id, case when x.k is null then 'extra' when y.k is null then 'missing' else 'modified' end status, x.o offset_a, y.o offset_b,
      x.n::bigint length_a, y.n::bigint length_b, x.d digest_a, y.d digest_b, (coalesce(x.page_id, y.page_id) >> {RANGE_BITS})::bigint leaf
    from x full join y on x.page_id is not distinct from y.page_id and x.k = y.k"""

