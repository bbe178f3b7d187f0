"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of one pattern match each are sorted into buckets by length; a bucket is a matrix of token ids, padded
on the right. Each round, every row merges its leftmost pair of least rank, found in a hashed table of pairs;
rows then close their gap, and rows without a pair left leave the matrix. Pieces over LONG bytes, for which
rounds over a matrix would cost the square of the length, merge the same pairs in the same order from a heap.

Defined results: a null text is empty; an empty text has no ids. Special tokens are ordinary text. Repeated
rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tokens import KEPT, word_parts

LONG = 1024
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Token bytes by id, and the rank of each pair of ids whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = self._fill(np.array(keys, np.uint64), np.array(values, np.int32))

    def _slot(self, keys):
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys, values) -> int:
        slot, mask, probes = self._slot(keys), (1 << self.bits) - 1, 0
        empty = np.uint64(2**64 - 1)
        while len(keys):
            probes += 1
            free = self.keys[slot] == empty
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & mask
        return probes

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the two are no token or a side is padding (-1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, keys = out.reshape(-1), keys.reshape(-1)
        slot, mask = self._slot(keys[todo]), (1 << self.bits) - 1
        for _ in range(self.probes):
            if not len(todo):
                break
            there = self.keys[slot]
            hit = there == keys[todo]
            flat[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (there != np.uint64(2**64 - 1))
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > LONG:
                out[i] = self._from_heap(p)
            else:
                buckets.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 1_000_000 // width)
            for at in range(0, len(rows), step):
                self._merge([pieces[i] for i in rows[at : at + step]], rows[at : at + step], width, out)
        return out

    def _merge(self, pieces, rows, width, out):
        rows = np.array(rows)
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        cols = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of equals
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                ended = ids[done]
                ends = np.cumsum((ended >= 0).sum(axis=1)).tolist()
                flat, start = ended[ended >= 0].tolist(), 0
                for r, end in zip(rows[done].tolist(), ends):
                    out[r], start = flat[start:end], end
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = best
            move = np.minimum(cols + (cols > at[:, None]), width - 1)
            last = np.take_along_axis(ids, move, 1)
            last[:, -1] = -1
            ids = last
            ranks = np.take_along_axis(ranks, move, 1)
            ranks[:, -1] = NONE
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            there = ids[every, at]
            left = self.pair_ranks(np.where(at > 0, ids[every, before], -1), there)
            ranks[every, before] = np.where(at > 0, left, ranks[every, before])
            ranks[every, at] = self.pair_ranks(there, np.where(at + 1 < width, ids[every, after], -1))
            used = int((ids >= 0).any(axis=0).sum())
            if used <= width // 2 and width > 2:
                width = max(2, used)
                ids, ranks, cols = ids[:, :width].copy(), ranks[:, :width].copy(), cols[:width]
                ranks[:, -1] = NONE

    def _from_heap(self, piece: bytes) -> list[int]:
        import heapq

        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank = lambda i, j: self.ranks.get(self.bytes[ids[i]] + self.bytes[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank(x, y)) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t, live in zip(ids, alive) if live]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextCodec:
    """Encodes texts, keeping the ids of parts seen before."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.kept: dict[str, tuple[str, int, bytes]] = {}

    def parts(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text its parts: ids as text, number of ids, decoded bytes."""
        split = []
        for text in texts:
            found = [x for x in word_parts(text)]
            found[1:] = [" " + x for x in found[1:]]
            split.append(found)
        new = list(dict.fromkeys(x for found in split for x in found if x not in self.kept))
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(dict.fromkeys(x for found in split for x in found))
        pieces = [self.pattern.findall(x) for x in new]
        distinct = list(dict.fromkeys(p for ps in pieces for p in ps))
        ids = dict(zip(distinct, self.vocabulary.encode([p.encode() for p in distinct])))
        for x, ps in zip(new, pieces):
            own = [i for p in ps for i in ids[p]]
            self.kept[x] = (",".join(map(str, own)), len(own), self.vocabulary.decode(own))
        return [[self.kept[x] for x in found if x] for found in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for s, _, _ in self.parts([text])[0] for i in s.split(",")]


def _run(ranks_path: str, pattern: str, digest: bool):
    def run(batches):
        import hashlib

        import pyarrow as pa

        codec = TextCodec(Vocabulary(read_ranks(ranks_path)), pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            docs = batch.column("doc_id")
            at = 0
            while at < len(texts):  # some texts at a time, a bounded amount of characters
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1_000_000):
                    size += len(texts[upto])
                    upto += 1
                n, one, two = [], [], []
                for found in codec.parts(texts[at:upto]):
                    n.append(sum(x[1] for x in found))
                    ids, raw = ",".join([x[0] for x in found]), b"".join([x[2] for x in found])
                    one.append(hashlib.sha256(ids.encode()).hexdigest() if digest else [int(i) for i in ids.split(",") if i])
                    two.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode())
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([docs.slice(at, upto - at), pa.array(n, pa.int64()), pa.array(one, pa.string() if digest else pa.list_(pa.int32())), pa.array(two, pa.string())], names)
                at = upto

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Ids of every text of docs (doc_id, text) and the text decoded from them, or the digests of both."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return texts.mapInArrow(_run(ranks_path, pattern, digest), f"doc_id long, n_tokens long, {shape}")
