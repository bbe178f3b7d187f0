"""Best-fit packing planned on the histogram of lengths.

Texts become token ids, an end id follows, and what is longer than a sequence is
cut. Only the counts per length, at most one per token of capacity, reach the driver. There best fit runs over
counts: runs of equally filled sequences take equally long pieces at once. The plan says which ranks of a
length go to which sequences; pieces take their places by joining on their rank within their length. Ranks are
counted in salted parts of each length, so a length that holds a third of all rows is not one task's work.

Defined results: a null text is empty, and an empty text is the end id alone; repeated rows are packed as often
as they occur; rows with equal ids, texts and pieces are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import parts, settle_texts

CAPACITY = 2048
SLOT = "length long, lo long, hi long, sequence long, per long, used long"


def _encoder(ranks_path: str, tokenizer_path: str, pattern: str):
    """text -> token ids as the tokenizers library gives them for the tokenizers file.

    The rank file holds the same vocabulary, and its library is several times as fast; texts that hold the string
    of an added token, which becomes that token's id, or a run of white space so long that the pattern engine
    gives up go to the library itself.
    """
    import json
    import re
    from functools import cache

    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import read_ranks

    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    slow = cache(lambda: Tokenizer.from_file(tokenizer_path))  # read only where a text needs it
    with open(tokenizer_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    apart = re.compile("|".join([r"\s{5000}", *map(re.escape, added)]))
    return lambda text: slow().encode(text, add_special_tokens=False).ids if apart.search(text) else fast.encode_ordinary(text)


def _pieces(tokenizer: tuple[str, str, str], capacity: int, end_id: int):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = _encoder(*tokenizer)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                n = len(ids)
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    for x, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: rows of SLOT.

    Pieces of rank lo..hi-1 of a length go to sequences from `sequence`, `per` to each, the first at offset
    `used`. A run is (free, first sequence, sequences); each step changes whole runs and splits at most one, so
    there are at most two runs a length and the plan does not grow with the number of pieces.
    """
    free: list[tuple[int, int, int]] = []  # by free tokens
    slots, fresh = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, (length, -1, -1))
            if at < len(free):
                room, first, many = free.pop(at)
            else:
                room, first = capacity, fresh
                many = -(-left // (capacity // length))
                fresh += many
            per = room // length
            whole = min(many, left // per)
            if whole:
                slots.append((length, rank, rank + whole * per, first, per, capacity - room))
                if room > per * length:
                    insort(free, (room - per * length, first, whole))
                rank, left, first, many = rank + whole * per, left - whole * per, first + whole, many - whole
            if many and left:  # fewer pieces than one sequence takes
                slots.append((length, rank, rank + left, first, per, capacity - room))
                if room > left * length:
                    insort(free, (room - left * length, first, 1))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                insort(free, (room, first, many))
    return slots


def _slots(spark: SparkSession, slots: list[tuple[int, ...]]) -> DataFrame:
    """The plan as a table, by Arrow: from a list of rows it would take Python workers of another kind on the executors."""
    import pyarrow as pa

    names = [c.split()[0] for c in SLOT.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([s[i] for s in slots], pa.int64()) for i in range(len(names))], names))


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: paths of the rank file and of the tokenizers file of one vocabulary, and its pattern.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle_texts(texts.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    salts = parts(spark, sum(counts.values()), 500_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(before.hint("shuffle_merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    places = _slots(spark, slots).hint("broadcast" if len(slots) <= 100_000 else "shuffle_merge")
    step = F.col("rank") - F.col("lo")
    placed = ranked.join(places, "length").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(step / F.col("per"))).cast("long").alias("sequence_id"), (F.col("used") + step % F.col("per") * F.col("length")).cast("long").alias("offset"))
