"""Alignment of two tokenizers over the exact distinct texts of a collection.

Texts are grouped by their full text (counted before they are shuffled), so every distinct text is tokenised and aligned
once, however many copies it has. A text is cut where no token of either vocabulary can cross, and the parts seen before
keep their ids, groups and links. The distinct id pairs of a text, with how often it links them, are kept beside its
measures; pair counts over the collection are sums weighted by the copies of each text. Pairs that make up one in HEAD of
all those counted are at most HEAD, whatever the input: they are broadcast and looked up where the texts lie. Rarer pairs
are joined by a shuffle, which no frequent pair can make uneven. Measures reach the documents by the digest of the text;
the few texts with very many copies come by broadcast, all others by a shuffle (spread_join).

Tokens are those of " " + text: ids of a rank file (A), and pieces of a sentencepiece model (B), which adds that space.
Byte offsets where tokens of both end cut them into groups; every A token of a group is linked with each of its B tokens.

Defined results: a null or empty text, and one whose joined tokens differ from " " + text in either vocabulary, has no
tokens: zeros and an empty groups_sha256. Control and added tokens are never recognised inside texts. Repeated rows and
rows that share an id are documents of their own. Any other columns, whatever their names, are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import settle, spread_join
from .tokens import word_parts

HEAD = 1 << 20  # a pair that is broadcast makes up one in so many of all counted pairs, at least
KEPT = 250_000  # parts that a worker keeps before it starts anew
SHORT = 200  # characters of a part that is kept
LARGE = 10_000  # links of a group whose equal ids are counted before they are paired
BITS = 16  # bits of an id in a pair
TEXTS = "key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, copies long, pairs binary, times binary"


class Aligner:
    """Parts of texts with their groups and links; paths of A's rank file and tokenizers file and of B's model, and A's pattern."""

    def __init__(self, ranks_path: str, tokenizer_path: str, model_path: str, pattern: str):
        import re

        import sentencepiece
        import tiktoken

        from .bpe import read_ranks

        ranks = read_ranks(ranks_path)
        self.a_length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_length[list(ranks.values())] = list(map(len, ranks))
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow, self.tokenizer_path = None, tokenizer_path
        self.apart = re.compile(r"\s{5000}")  # the pattern engine gives up on longer runs
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        self.text = list(map(str, range(max(len(self.a_length), len(pieces)))))
        #: no piece holds a space behind something else, so a cut before a space crosses none
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        if len(self.text) > 1 << BITS:
            raise ValueError(f"vocabularies of more than {1 << BITS} ids")
        self._clear()

    def _clear(self):
        from array import array

        self.kept: dict[str, int] = {}
        self.groups: list[str] = []  # empty where the bytes differ
        self.sizes = array("q")  # of each part the tokens of A, of B, groups, links; no tokens where the bytes differ
        self.first = array("q", [0])  # where the pairs of each part begin
        self.pairs, self.times = array("q"), array("q")

    def _ids_a(self, part: str) -> list[int]:
        if not self.apart.search(part):
            return self.fast.encode_ordinary(part)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.tokenizer_path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(part, add_special_tokens=False).ids

    def _add(self, parts: list[str], b_ids: list[list[int]]) -> None:
        """Align many parts at once: their bytes lie one after another, and every part's end is one of both vocabularies."""
        a_ids = list(map(self._ids_a, parts))
        b_bytes = self.b_bytes
        good = np.array([b"".join([b_bytes[i] for i in b]) == x.encode() for x, b in zip(parts, b_ids)], bool)
        many_a, many_b = (np.where(good, list(map(len, ids)), 0) for ids in (a_ids, b_ids))
        a = np.array([i for ids, g in zip(a_ids, good) if g for i in ids], np.int64)
        b = np.array([i for ids, g in zip(b_ids, good) if g for i in ids], np.int64)
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        if len(a) and end_a[-1] != end_b[-1]:
            raise ValueError("tokens of the rank file do not give the text back")
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)  # the group of each token
        size_a, size_b = (np.bincount(g, minlength=len(common)) for g in (in_a, in_b))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        part_of = np.repeat(np.arange(len(parts)), many_a)[first_a]  # the part of each group
        many_groups = np.bincount(part_of, minlength=len(parts))
        links = np.bincount(part_of, size_a * size_b, minlength=len(parts)).astype(np.int64)

        # every A token with every B token of its group; of large groups the distinct ids with their counts
        large = size_a * size_b > LARGE
        keep = ~large[in_a]
        times = np.where(keep, size_b[in_a], 0)
        at = np.repeat(np.arange(len(a)), times)
        step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        key = part_of[in_a[at]] << 2 * BITS | a[at] << BITS | b[first_b[in_a[at]] + step]
        key, count = np.unique(key, return_counts=True)
        for g in np.flatnonzero(large).tolist():
            x, c = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
            y, d = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
            key = np.r_[key, (part_of[g] << 2 * BITS | x[:, None] << BITS | y[None, :]).ravel()]
            count = np.r_[count, (c[:, None] * d[None, :]).ravel()]
        if large.any():
            key, back = np.unique(key, return_inverse=True)
            count = np.bincount(back, count, minlength=len(key)).astype(np.int64)
        of = key >> 2 * BITS
        ends = np.searchsorted(of, np.arange(1, len(parts) + 1)) + len(self.pairs)
        self.pairs.frombytes((key & (1 << 2 * BITS) - 1).tobytes())
        self.times.frombytes(count.astype(np.int64).tobytes())
        self.first.frombytes(ends.astype(np.int64).tobytes())
        self.sizes.frombytes(np.stack([many_a, many_b, many_groups, links], axis=1).astype(np.int64).tobytes())

        text, a, b = self.text, a.tolist(), b.tolist()
        told = [
            f"{text[a[i]]}|{text[b[j]]}" if m == n == 1 else ",".join([text[x] for x in a[i : i + m]]) + "|" + ",".join([text[x] for x in b[j : j + n]])
            for i, j, m, n in zip(first_a.tolist(), first_b.tolist(), size_a.tolist(), size_b.tolist())
        ]
        upto = 0
        for n in many_groups.tolist():
            self.groups.append(";".join(told[upto : upto + n]) if n != 1 else told[upto])
            upto += n

    def parts(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of its parts, good until the next call."""
        if len(self.groups) > KEPT:
            self._clear()
        split, new = [], {}
        for text in texts:
            if self.cuts:
                head, *rest = word_parts(" " + text)
                found = ([head] if head else []) + [" " + x for x in rest]
            else:
                found = [" " + text]
            split.append(found)
            for x in found:
                if x not in self.kept:
                    new[x] = None
        fresh = dict(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        if new:
            pieces = self.b.encode([x[1:] for x in new], num_threads=1)
            self._add(list(new), [[self.space] if x == " " else b for x, b in zip(new, pieces)])
        numbers = [[self.kept[x] if x in self.kept else fresh[x] for x in found] for found in split]
        self.kept.update((x, i) for x, i in fresh.items() if len(x) <= SHORT)
        return numbers


def _measured(aligner: Aligner, texts: list[str]):
    """Digests of texts and of their groups, sizes, and their distinct pairs (one text after another, parted at ends)."""
    import hashlib

    numbers = aligner.parts(texts)
    many = np.array(list(map(len, numbers)), np.int64)
    doc, part = np.repeat(np.arange(len(texts)), many), np.array([i for x in numbers for i in x], np.int64)
    own = np.frombuffer(aligner.sizes, np.int64).reshape(-1, 4)[part]
    bad = np.bincount(doc[own[:, 0] == 0], minlength=len(texts)) > 0
    bad |= np.array([not t for t in texts], bool)
    sizes = np.stack([np.bincount(doc, c, minlength=len(texts)).astype(np.int64) for c in own.T], axis=1)
    sizes[bad] = 0
    groups = aligner.groups
    digest = ["" if b else hashlib.sha256(";".join([groups[i] for i in x]).encode()).hexdigest() for b, x in zip(bad.tolist(), numbers)]
    good = ~bad[doc]
    key, often = np.unique(doc[good] << 32 | part[good], return_counts=True)
    first = np.frombuffer(aligner.first, np.int64)
    part = key & 0xFFFFFFFF
    size = first[part + 1] - first[part]
    at = np.arange(size.sum()) + np.repeat(first[part] - np.cumsum(size) + size, size)
    pair, back = np.unique(np.repeat(key >> 32, size) << 32 | np.frombuffer(aligner.pairs, np.int64)[at], return_inverse=True)
    times = np.bincount(back, np.repeat(often, size) * np.frombuffer(aligner.times, np.int64)[at], minlength=len(pair))
    ends = np.searchsorted(pair, np.arange(len(texts) + 1) << 32)
    keys = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    return keys, digest, sizes, (pair & 0xFFFFFFFF).astype("<u4"), times.astype("<u4"), ends


def _align(tokenizers: tuple[str, str, str, str]):
    def run(batches):
        import pyarrow as pa

        aligner = Aligner(*tokenizers)
        for batch in batches:
            texts, copies = batch.column("text").to_pylist(), batch.column("copies")
            at = 0
            while at < len(texts):  # some texts at a time, a bounded amount of characters
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) < 500_000):
                    size += len(texts[upto])
                    upto += 1
                some = texts[at:upto]
                key, digest, sizes, pairs, times, ends = _measured(aligner, some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        *(pa.array(x) for x in sizes.T),
                        pa.array(digest),
                        copies.slice(at, upto - at),
                        pa.array([pairs[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()),
                        pa.array([times[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()),
                    ],
                    [x.split()[0] for x in TEXTS.split(", ")],
                )
                at = upto

    return run


def _counts(batches):
    """Pairs of some texts at a time, counted once per copy of each text."""
    import pyarrow as pa

    kept, weight, size = [], [], 0

    def told():
        pair, back = np.unique(np.concatenate(kept), return_inverse=True)
        count = np.bincount(back, np.concatenate(weight), minlength=len(pair)).astype(np.int64)  # whole numbers below 2^53
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(count)], ["pair", "c"])

    for batch in batches:
        for raw, copies in zip(batch.column("pairs").to_pylist(), batch.column("copies").to_pylist()):
            own = np.frombuffer(raw, "<u4")
            kept.append(own)
            weight.append(np.full(len(own), copies))
            size += len(own)
            if size > 2_000_000:
                yield told()
                kept, weight, size = [], [], 0
    if size:
        yield told()


def _looked_up(shared):
    """Sums over the frequent pairs of each text, and its rarer pairs."""

    def run(batches):
        import pyarrow as pa

        pairs, counts, best = shared.value
        for batch in batches:
            n = batch.num_rows
            own = [np.frombuffer(x, "<u4") for x in batch.column("pairs").to_pylist()]
            text = np.repeat(np.arange(n), list(map(len, own)))
            pair = np.concatenate(own) if own else np.empty(0, "<u4")
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            t, k = text[known], at[known]
            n_best = np.bincount(t, times[known] * best[k], minlength=n).astype(np.int64)
            count_sum = np.zeros(n, np.int64)
            np.add.at(count_sum, t, times[known] * counts[k])
            ends = np.r_[0, np.cumsum(np.bincount(text[~known], minlength=n))].astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(pair[~known].astype(np.int64)), pa.array(times[~known])], ["pair", "times"])
            arrays = [batch.column("row"), pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(pa.array(ends), rare)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_best", "count_sum", "rare"])

    return run


def align(docs: DataFrame, tokenizers: tuple[str, str, str, str]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs (doc_id, text).

    tokenizers: paths of A's rank file, A's tokenizers file and B's model, and A's pattern; up to 65,536 ids each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    distinct = rows.groupBy("text").agg(F.count("*").alias("copies"))
    texts = settle(distinct.mapInArrow(_align(tokenizers), TEXTS).withColumn("row", F.monotonically_increasing_id()))

    counted = texts.select("pairs", "copies").mapInArrow(_counts, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    most = F.max("c").over(W.partitionBy(F.shiftright("pair", BITS)))  # at most one row per B id
    counts = settle(counted.select("pair", "c", (F.col("c") == most).alias("best")))
    total = counts.agg(F.sum("c")).first()[0] or 0
    frequent = F.col("c") * HEAD >= total
    head = counts.where(frequent).toPandas().sort_values("pair")  # at most HEAD rows
    shared = spark.sparkContext.broadcast((head["pair"].to_numpy("u4"), head["c"].to_numpy("i8"), head["best"].to_numpy(bool)))
    told = settle(texts.select("row", "pairs", "times").mapInArrow(_looked_up(shared), "row long, n_best long, count_sum long, rare array<struct<pair: long, times: long>>"))
    rare = told.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.where(~frequent).hint("shuffle_merge"), "pair")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_rest"), F.sum(F.col("times") * F.col("c")).alias("sum_rest"))
    sums = told.select("row", "n_best", "count_sum").join(rest.hint("shuffle_merge"), "row", "left")
    sums = sums.select("row", (F.col("n_best") + F.coalesce("best_rest", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_rest", F.lit(0))).alias("count_sum"))
    measures = settle(texts.drop("pairs", "times").join(sums.hint("shuffle_merge"), "row").drop("row"))

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    many = measures.agg(F.sum("copies")).first()[0] or 0
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("key"))
    return spread_join(keyed, measures.select("key", "copies", *names), "key", "copies", many).select("doc_id", *names)
