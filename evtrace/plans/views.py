"""Views of the given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import diff_hash

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Temporary views of every table and of the shapes below, for SQL; returns their names."""
    shapes = {"session_events": events, "readings": readings, "states": states, "positions": positions, "actions": actions, "document_hashes": document_hashes}
    names = []
    for name, make in [*((t, None) for t in TABLES), *shapes.items()]:
        (make(spark, sf_dir) if make else table(spark, sf_dir, name)).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with time in microseconds, k of their properties, a confidence, a source and a side."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session_id"), "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), k.alias("k"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("source"), F.when(k % 2 == 0, "left").otherwise("right").alias("side"),
    )


def readings(spark, sf_dir) -> DataFrame:
    """Readings of two channels per session."""
    return events(spark, sf_dir).select("session_id", F.col("side").alias("channel"), F.col("event_id").alias("id"), "t", F.floor(F.col("value") / 25).alias("value"), ((F.col("k") + 1) / 100).alias("confidence"))


def states(spark, sf_dir) -> DataFrame:
    """One state and its score per reading."""
    state = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "purchase", "overlay").otherwise("up")
    return events(spark, sf_dir).select("session_id", F.col("event_id").alias("id"), "t", state.alias("state"), F.least(F.lit(1.0), 0.5 + F.col("value") / 200).alias("score"))


def positions(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("session_id", F.col("event_id").alias("id"), "t", (F.col("k") * 19.8).alias("x"), (F.least(F.col("value"), F.lit(100.0)) * 6.54).alias("y"))


def actions(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("role") == "user", "key_down").when(F.col("role") == "assistant", "key_up").otherwise("mouse_click")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") * 500).alias("t_ms"), kind.alias("kind"), ((F.col("conv_id") + F.col("turn")) % 3).alias("code"), F.lit(None).cast("long").alias("duration_ms"))


def document_hashes(spark, sf_dir) -> DataFrame:
    """64-bit difference hash over 65 word-bucket counts of each text of 20 words and more.

    Words are rows that are counted by text and bucket before the shuffle, so a text sends 65 counts at most.
    """
    texts = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), F.lower("text").alias("text"))
    words = texts.select("row", "grp", "id", F.explode(F.split("text", "[^a-z0-9]+")).alias("w")).where("w <> ''")
    bucket = (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 4), 16, 10).cast("int") % 65).alias("b")
    counts = words.groupBy("row", "grp", "id", bucket).agg(F.count("*").alias("c"))
    told = counts.groupBy("row", "grp", "id").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"), F.sum("c").alias("words")).where("words >= 20")
    values = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return told.select("grp", "id", values.alias("v")).select("grp", "id", diff_hash(F.col("v")).alias("h"))


#: The same views for DuckDB.
SQL_EVENTS = """
ev AS (
  SELECT event_id, user_id AS session_id, event_type, value, epoch_us(ts) AS t, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k,
    least(1.0, value / 100) AS confidence, CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS source,
    CASE WHEN regexp_extract(props, '([0-9]+)', 1)::INTEGER % 2 = 0 THEN 'left' ELSE 'right' END AS side
  FROM events)"""
SQL_READINGS = SQL_EVENTS + """,
rd AS (SELECT session_id, side AS channel, event_id AS id, t, floor(value / 25)::BIGINT AS value, (k + 1) / 100 AS confidence FROM ev)"""
SQL_STATES = SQL_EVENTS + """,
st AS (SELECT session_id, event_id AS id, t, CASE event_type WHEN 'error' THEN 'down' WHEN 'purchase' THEN 'overlay' ELSE 'up' END AS state, least(1.0, 0.5 + value / 200) AS score FROM ev)"""
SQL_POSITIONS = SQL_EVENTS + """,
po AS (SELECT session_id, event_id AS id, t, k * 19.8::DOUBLE AS x, least(value, 100.0) * 6.54::DOUBLE AS y FROM ev)"""
SQL_ACTIONS = """
ac AS (SELECT conv_id AS session_id, turn * 500 AS t_ms, CASE role WHEN 'user' THEN 'key_down' WHEN 'assistant' THEN 'key_up' ELSE 'mouse_click' END AS kind, (conv_id + turn) % 3 AS code FROM conversations)"""
