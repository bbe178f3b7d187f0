"""Helpers that several of these operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A-Z to a-z, every other byte unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set and one machine does all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


BATCH = 4 << 20  # bytes of a batch of texts or sets that goes to Python, but for one longer row


@contextmanager
def small_batches(spark: SparkSession):
    """What Spark runs meanwhile sends Python batches of BATCH bytes at most, and not the session's (64 MB).

    A task holds each batch several times: as vectors and as a stream in the JVM, as vectors and as objects in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts its lineage and gives joins a true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_texts(df: DataFrame) -> DataFrame:
    """settle() of what Python makes of whole texts or sets, in small batches."""
    with small_batches(df.sparkSession):
        return settle(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark).removeprefix("file://")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/settled-" in name and folder in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` distinct rows of df, those whose hash is least; only hashes are sorted."""
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    least = hashed.select("_h").distinct().orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
    return hashed.where(F.lit(False) if least is None else F.col("_h") <= least).dropDuplicates(["_h"]).orderBy("_h").drop("_h")


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: at least the session's, more as the rows grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


HOT = 1000  # a key that is broadcast is that of one in so many rows, at least


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows (key and other columns) with the columns of table (key, weight and others) beside them, all keys being in table.

    weight says how many of the total rows have a key. The keys of one in HOT rows and more, HOT of them at most, come by
    broadcast; the others by a shuffle in which rows already served get keys of their own, so that they do not meet in
    one task.
    """
    names = [c for c in table.columns if c not in (key, weight)]
    beside = F.struct(*names)
    often = F.col(weight) * HOT >= total
    hot = table.where(often).select(F.col(key).alias("_hot_key"), beside.alias("_hot"))
    cold = table.where(~often).select(F.col(key).alias("_cold_key"), beside.alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    kind = rows.schema[key].dataType
    other = F.xxhash64(*[c for c in rows.columns if c != key]).cast("string").cast(kind)
    met = met.withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(other))
    out = met.join(cold.hint("shuffle_merge"), "_cold_key", "left").withColumn("_m", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *(F.col("_m")[c].alias(c) for c in names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root being its smallest node.

    First every partition contracts its own edges to a forest (a union-find no larger than the partition).
    Then large-star and small-star rounds run until nothing changes; each round is two grouped minima joined
    back to the edges, so no node's neighbours are ever collected. Null ends and loops are dropped; no edges
    give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = settle(edges.mapInPandas(_contract, "u long, v long").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = settle(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        then = _mark(following)
        discard(now)
        now = following
        if then == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.sum((F.xxhash64("v", "u") % 998_244_353).cast("long"))).first())


def _contract(batches):
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x):
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while (p := parent[x]) != top:
            parent[x], x = top, p
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            p, q = find(u), find(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pd.DataFrame({"u": some, "v": [find(x) for x in some]})
