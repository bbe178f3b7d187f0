"""Reading reports and recordings, listing sessions, writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.scalars import clamp01, safe_double, safe_name

RECORDING = T.StructType([
    T.StructField("session", T.StructType([T.StructField("session_id", T.StringType()), T.StructField("duration_sec", T.DoubleType())])),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("t", T.DoubleType()), T.StructField("time", T.DoubleType()), T.StructField("delay_ms", T.LongType()), T.StructField("type", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("action", T.StringType()), T.StructField("key", T.StringType()), T.StructField("button", T.StringType()), T.StructField("dx", T.DoubleType()), T.StructField("dy", T.DoubleType())]))),
])


def read_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Exploded events of JSON recordings, and the files whose event list is missing, empty or unreadable."""
    files = spark.read.schema(RECORDING).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())
    good = F.coalesce(F.size("events"), F.lit(0)) > 0
    session = F.coalesce("session.session_id", safe_name(F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)))
    rows = files.where(good).select(session.alias("session_id"), F.posexplode("events").alias("seq", "e")).select("session_id", "seq", "e.*", F.coalesce("e.key", "e.button").alias("code"))
    return rows, files.where(~good).select("file", F.lit("no events").alias("reason"))


def read_reports(spark: SparkSession, path: str, schema: T.StructType, rows: str) -> DataFrame:
    """Nested stage reports with the array `rows` exploded; a report without rows gives one of nulls, an empty folder none."""
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("session_id"), F.explode_outer(rows).alias("r")).select("session_id", "r.*")


def normalize_events(raw: DataFrame) -> DataFrame:
    """Canonical events of rows with any of the known names; what a table lacks counts as null."""
    null = F.lit(None).cast("string")
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns], null)
    micros = lambda c: F.round(c.cast("double") * 1_000_000).cast("long")
    return raw.select(
        "session_id", "event_id", first("source_module", "source").alias("source"), first("event_type", "event").alias("event_type"),
        micros(first("time", "timestamp_sec", "start_time", "death_time", "respawn_time")).alias("t"), micros(first("end_time", "respawn_time")).alias("end_t"),
        clamp01(first("confidence", "final_spawn_score", "top_confidence")).alias("confidence"), F.upper(F.coalesce(first("status", "result"), F.lit("UNKNOWN"))).alias("status"),
    )


def list_sessions(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files under path with the extension, by path, with stable session names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(path).select("path", "length", "modificationTime")
    ranked = files.withColumn("n", F.row_number().over(W.orderBy("path")))  # names of files only: the listing is the driver's anyway
    return ranked.select(F.format_string("session_%04d_%s", "n", safe_name(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1))).alias("session_id"), "path", "length")


def write_tables(tables: dict[str, DataFrame], folder: str, partition: str | None = "session_id", form: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(form)
        (writer.partitionBy(partition) if partition and partition in df.columns else writer).save(f"{folder}/{name}")


def markdown(df: DataFrame, title: str, columns: list[str], order: list[str]) -> DataFrame:
    """session_id, line_no, line: a Markdown table of each session's rows, headed by the title and the number of rows.

    A line is a row, so a long session is no large value; write them sorted, by session.
    """
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    body = df.select("session_id", (F.row_number().over(W.partitionBy("session_id").orderBy(*order)) + 3).cast("long").alias("line_no"), row.alias("line"))
    head = df.groupBy("session_id").agg(F.count("*").alias("n"))
    said = [F.format_string(f"# {title}: %d", "n"), F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "-|" * len(columns))]
    heads = head.select("session_id", F.posexplode(F.array(*said)).alias("p", "line")).select("session_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    return heads.unionByName(body)


def write_markdown(lines: DataFrame, folder: str) -> None:
    """One folder of text per session, lines in order."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "line_no").select("session_id", "line").write.mode("overwrite").partitionBy("session_id").text(folder)


def lineage(configs: DataFrame) -> DataFrame:
    """One hash over all config files (path, content), in order of path."""
    each = configs.select("path", F.sha2("content", 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat_ws("=", x["path"], x["h"])), "\n"), 256).alias("config_hash"))


__all__ = ["read_recordings", "read_reports", "normalize_events", "list_sessions", "write_tables", "lineage", "safe_double"]
