"""The folder that driver and executors share, tables written to it to cut lineage, numbers for rows in order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir. Where that is unset, a temporary folder under a local master (tests),
    which goes when Python ends; an error on a cluster, whose executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="latticework-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at := f"file://{folder}")
    return f"{at.rstrip('/')}/latticework-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back; a lost executor costs no recomputation of what is before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; DataFrames that read them no longer work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the rows' numbers from 1 in an order without ties, as the first column; no task sees more than a range of it.
    order: columns of df by name, or what is made of them.

    Ranges of about equal size are sorted, numbered as they are written and read back after the rows of those before, whose counts
    (a number for each partition) pass through the driver; so rows are dealt out once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [c if isinstance(c, str) else f"_key_{i}" for i, c in enumerate(order)]
    dealt = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True) if not isinstance(c, str)]).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the upper bits of such a number are the partition's, the lower 33 the row's within it
    dealt = stored(dealt.select(*df.columns, F.monotonically_increasing_id().alias("_at")), "ranges").withColumn("_range", F.shiftright("_at", 33))
    done, starts = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], done))
        done += r["count"]
    before = F.broadcast(spark.createDataFrame(starts, "_range long, _before long"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(before, "_range").select((F.col("_before") + nth).alias(name), *df.columns)


def drawn(*parts: Column) -> Column:
    """A number from 0 to 2^52 - 1 hashed from the parts, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def drawn_sql(text: str) -> str:
    """drawn, for DuckDB, of parts joined by | already."""
    return f"('0x' || substr(md5({text}), 1, 13))::bigint"
