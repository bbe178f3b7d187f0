"""Importance resampling towards a target collection, over hashed runs of words.

A feature is a run of one to three consecutive words; its bucket is the CRC of its bytes modulo BUCKETS. A first pass
finds the head: words and pairs of words that make up at least one in HEAD of all, so there are at most HEAD of each,
whatever the size of the table. The head is broadcast with the exact CRC states of its words (alone and behind a space)
and the states and buckets of its pairs. Runs of head words get their CRC from those states by shifting a state over the
bytes that follow, whole arrays at a time; a run that holds an unseen word continues its CRC over the word's own bytes.
Either way every feature lands in its exact bucket: the head decides how fast, never what. Bucket totals of both
collections are sums of arrays of BUCKETS counts, a bounded result that reaches the driver; the gain of each bucket
follows from them, a document's weight is the sum of its features' gains, and Gumbel noise from its id makes the
highest scores a sample without replacement.

Defined results: a null or wordless text has no features and weight 0; a text is cut into windows of WINDOW bytes that
overlap by two words, so runs across windows count once; repeated rows count as often as they occur and get ranks of
their own; a null id takes the noise of an empty id and ranks after equal scores; ties go to the smaller id. Any other
columns, whatever their names, are ignored. Empty tables give no rows, and without a target all of its counts are 0.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.order import numbered
from .common import settle

BUCKETS = 10_000
HEAD = 1 << 18  # a word or pair of the head makes up one in so many of all, at least
LONGEST = 63  # bytes of a word of the head, at most
STRETCH = 300_000  # words worked on at a time
WINDOW = 2_000_000  # bytes of a text that are split into words at a time
FEW = 20  # words that a document needs to be drawn

#: Every byte to what it is for words: A-Z lowered, digits, letters and bytes of other scripts kept, all else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _windows(raw: bytes):
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= WINDOW else raw.rfind(b" ", at, at + WINDOW)
        if end <= at:  # one word fills the window
            end = raw.find(b" ", at + WINDOW)
            end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end + 1


def _stretches(texts: list[bytes | None]):
    """Words of many texts at a time: words, the text of each, its place behind the stretch's start of that text, whether it is new."""
    words, pieces = [], []
    for d, text in enumerate(texts):
        last: list[bytes] = []
        for window in _windows(text.translate(WORD_BYTES)) if text else ():
            own = last + window.split()
            pieces.append((d, len(own), len(last)))
            words += own
            last = own[-2:]
            if len(words) >= STRETCH:
                yield _placed(words, pieces)
                words, pieces = [], []
    if words:
        yield _placed(words, pieces)


def _placed(words, pieces):
    d, n, old = np.array(pieces, np.int64).T
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    return words, np.repeat(d, n), place, place >= np.repeat(old, n)


def _frequent(batches):
    """Words (word) and pairs (word, next) that make up one in HEAD of a stretch, with their counts there; all words' number under null.

    What makes up one in HEAD of all makes up as much of some stretch, so nothing frequent is missed.
    """
    import pyarrow as pa

    for batch in batches:
        for words, _, place, new in _stretches(batch.column("text").to_pylist()):
            ids: dict[bytes, int] = {}
            code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            name, least = list(ids), max(2, len(words) // HEAD)
            count = np.bincount(code[new], minlength=len(name))
            often = np.flatnonzero(count >= least)
            second = np.flatnonzero(new & (place > 0))
            pairs, times = np.unique(code[second - 1] << 32 | code[second], return_counts=True)
            pairs, times = pairs[times >= least], times[times >= least]
            one = [None] + [name[i] for i in often] + [name[i] for i in (pairs >> 32)]
            two = [None] * (1 + len(often)) + [name[i] for i in (pairs & 0xFFFFFFFF)]
            c = np.r_[[int(new.sum())], count[often], times]
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(c, pa.int64())], ["word", "next", "c"])


def find_head(docs: DataFrame) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """Frequent words and pairs of frequent words of docs (text), most frequent last; at most HEAD of each."""
    found = settle(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_frequent, "word binary, next binary, c long").groupBy("word", "next").agg(F.sum("c").alias("c")))
    total = found.where("word is null").agg(F.sum("c")).first()[0] or 0
    often = found.where((F.col("c") * HEAD >= total) & (F.length("word") <= LONGEST) & (F.coalesce(F.length("next"), F.lit(0)) <= LONGEST))
    rows = sorted((r["c"], bytes(r["word"]), None if r["next"] is None else bytes(r["next"])) for r in often.where("next is null").collect())
    words = [w for _, w, _ in rows]
    known = set(words)
    rows = sorted((r["c"], bytes(r["word"]), bytes(r["next"])) for r in often.where("next is not null").collect())
    return words, [(a, b) for _, a, b in rows if a in known and b in known]


class Head:
    """CRC states of frequent words and pairs, and how a state moves on over following bytes."""

    SLOTS = 20  # bits of a pair's slot

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.ids = {w: i for i, w in enumerate(words)}
        self.alone = np.array([crc32(w) for w in words], np.uint32)
        self.behind = np.array([crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        # a state moved over n bytes is linear in its four bytes
        self.shift = np.zeros((LONGEST + 2, 4, 256), np.uint32)
        for n in set(self.length.tolist()):
            zeros = bytes(n)
            none = crc32(zeros)
            for k in range(4):
                self.shift[n, k] = [crc32(zeros, b << 8 * k) ^ none for b in range(256)]
        # one pair a slot, of those that meet there the most frequent
        self.pair, self.pair_state = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, np.uint32)
        if pairs:
            key = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], np.int64)
            for (a, b), k, at in zip(pairs, key.tolist(), self._slot(key).tolist()):
                self.pair[at], self.pair_state[at] = k, crc32(b" " + b, crc32(a))
        self.pair_bucket = self.pair_state % BUCKETS

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _moved(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        n, out = self.length[word], self.behind[word].copy()
        for k in range(4):
            out ^= self.shift[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def buckets(self, words: list[bytes], place: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every feature that ends at a new word: the word's index and the feature's bucket."""
        m = len(words)
        code = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, m)
        seen = code >= 0
        one, two, three = np.empty(m, np.uint32), np.zeros(m, np.uint32), np.zeros(m, np.uint32)
        one[seen] = self.alone[code[seen]]
        rest = np.flatnonzero(~seen).tolist()
        one[rest] = [crc32(words[i]) for i in rest]

        second = place >= 1
        both = second.copy()
        both[1:] &= seen[1:] & seen[:-1]
        bucket_two = np.zeros(m, np.uint32)
        i = np.flatnonzero(both)
        key = code[i - 1] << 32 | code[i]
        slot = self._slot(key)
        held = self.pair[slot] == key
        two[i[held]] = self.pair_state[slot[held]]
        two[i[~held]] = self._moved(one[i[~held] - 1], code[i[~held]])
        tail = np.flatnonzero(second & ~both)
        two[tail] = _direct(words, tail, one[tail - 1])
        bucket_two = two % BUCKETS
        bucket_two[i[held]] = self.pair_bucket[slot[held]]

        third = place >= 2
        all_ = third.copy()
        all_[1:] &= both[1:] & both[:-1]
        i = np.flatnonzero(all_)
        three[i] = self._moved(two[i - 1], code[i])
        tail = np.flatnonzero(third & ~all_)
        three[tail] = _direct(words, tail, two[tail - 1])

        at = [np.flatnonzero(new), np.flatnonzero(new & second), np.flatnonzero(new & third)]
        return np.concatenate(at), np.concatenate([one[at[0]] % BUCKETS, bucket_two[at[1]], three[at[2]] % BUCKETS])


def _direct(words, at: np.ndarray, state: np.ndarray) -> list[int]:
    return [crc32(b" " + words[i], s) for i, s in zip(at.tolist(), state.tolist())]


def _totals(shared):
    def run(batches):
        import pyarrow as pa

        head, total = Head(*shared.value), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, _, place, new in _stretches(batch.column("text").to_pylist()):
                total += np.bincount(head.buckets(words, place, new)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "c"])

    return run


def bucket_totals(docs: DataFrame, shared) -> np.ndarray:
    """How many features of all texts lie in each bucket; BUCKETS rows reach the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_totals(shared), "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r["bucket"]] = r["c"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles."""
    import math

    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _scores(shared, gains: np.ndarray, seed: int):
    def run(batches):
        import hashlib
        import math

        import pyarrow as pa

        head = Head(*shared.value)
        for batch in batches:
            n = batch.num_rows
            words_of, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for words, doc, place, new in _stretches(batch.column("text").to_pylist()):
                at, bucket = head.buckets(words, place, new)
                words_of += np.bincount(doc[new], minlength=n)
                features += np.bincount(doc[at], minlength=n)
                weight += np.bincount(doc[at], gains[bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53
            noise = []
            for i in batch.column("doc_id").to_pylist():
                h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
                noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words_of, features, weight, weight + np.array(noise, np.int64)))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs (doc_id, text), drawn towards target (text).

    The floor(percent N / 100) highest scores among the N rows of FEW words and more have ranks 1, 2, 3 ...; others none.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(find_head(docs))
    gains = bucket_gains(bucket_totals(docs, shared), bucket_totals(target, shared))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = settle(texts.mapInArrow(_scores(shared, gains, seed), "doc_id long, n_words long, n_features long, weight long, score long"))
    many = scored.where(F.col("n_words") >= FEW)
    drawn = percent * many.count() // 100
    ranks = numbered(many, F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", name="rank")
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.unionByName(scored.where(F.col("n_words") < FEW).withColumn("rank", F.lit(None).cast("long")))
