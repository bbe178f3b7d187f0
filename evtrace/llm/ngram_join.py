"""Exact set-similarity join of word n-grams by T-occurrence search.

A text's set is its distinct word shingles, as 64-bit hashes; texts with equal sets are one class. A class A can only
link with a class that lies on at least T(A) = ceil(similarity |A|) of the inverted lists of A's shingles. That bound is
used three times, each exact (no candidate is capped, estimated or sampled away):

1. Hashes of all texts go to fragments of the hash space, which tell how many of a class's shingles any other class has.
   Classes with fewer than T(A) of those go no further; most texts are unique, so few remain, and only their sets are
   built and moved.
2. Remaining classes gather round the most central class that they share a list with (in blocks of BLOCK, each with its
   own copy of the centre) and every block is searched wholly. This only connects early what is alike: families of
   copies become one component, and everything in step 3 looks at lists that hold several components alone.
3. What still has T(A) shingles on such lists is searched by DivideSkip over the whole collection: of A's lists the L
   longest are set aside, the shorter ones are merged from a heap, classes met at least T(A) - L times are candidates,
   and A's long lists are probed for them by binary search in the candidate's own sorted set. Long lists are never
   moved, and a list is sent only to classes for which it is short, in parts of PART members.

Both searches skip pairs that are in one component already: the result is the components, not all pairs of copies.

Defined results: a null or blank text has an empty set, n_shingles 0, and is its own component; a text with fewer words
than a shingle is one shingle of all its words; equal sets always link; rows that share an id are nodes of their own; a
null id takes the smallest id of its component, null if there is none. Ties are broken by class number, which does not
change results. Any other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.order import numbered
from .common import components, discard, settle, spread_join

WINDOW = 200_000  # bytes of texts that are hashed at a time
CHUNK = 1_000_000  # shingles dealt to fragments at a time
FRAGMENT, FRAGMENTS = 4_000_000, 32  # shingles that a fragment holds, about; fragments at least
BLOCK = 1024  # classes of a block
SAMPLED = 16  # one shingle in so many serves to find central classes
PART = 4096  # members of a part of an inverted list
MU = 0.08  # weight of probing against merging: of a query's lists, T / (MU log2(longest) + 1) are long
HEAP = 4000  # entries merged from a heap; longer inputs are sorted at once


def least_overlap(n: int, similarity: int) -> int:
    """How many shingles of a set of n any set that links with it has."""
    return -(-similarity * n // 100)


def _key(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


#: Every byte to what it is for words: A-Z lowered, white space a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


class Shingler:
    """Sets of 64-bit hashes of the k-word shingles of texts, many texts at a time.

    A word's hash is a polynomial of its bytes, taken from running sums over a whole window of texts and mixed; a
    shingle's combines those of its words in order.
    """

    BASE = 0x9E3779B97F4A7C15 | 5

    def __init__(self, k: int):
        self.k, self.power, self.inverse = k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, WINDOW + 4096)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.BASE, np.uint64)])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(self.BASE, -1, 1 << 64), np.uint64)])

    def _words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of raw begin, which starts and ends with a space, and their hashes."""
        x = np.frombuffer(raw, np.uint8)
        self._grow(len(x))
        edge = np.flatnonzero(np.diff(x == 32))
        start, end = edge[::2] + 1, edge[1::2] + 1
        total = np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.power[: len(x)])
        return start, _mixed((total[end - 1] - total[start - 1]) * self.inverse[start] + (end - start).astype(np.uint64))

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        """Hashes of all runs of k words."""
        n = len(h) - self.k + 1
        out = h[: max(n, 0)].copy()
        for i in range(1, self.k):
            out = _mixed(out) + h[i : n + i]
        return _mixed(out)

    def _whole(self, h: np.ndarray) -> np.ndarray:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = _mixed(out) + x
        return _mixed(out)

    def sets(self, texts):
        """The sorted set of each text (an iterable of texts and nulls), in order."""
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode().translate(WORD_BYTES) if text else b""
            if len(raw) > WINDOW:
                yield from self._some(waiting)
                waiting, size = [], 0
                yield self._long(raw)
                continue
            if size + len(raw) > WINDOW:
                yield from self._some(waiting)
                waiting, size = [], 0
            waiting.append(raw)
            size += len(raw) + 1
        yield from self._some(waiting)

    def _some(self, raws: list[bytes]):
        if not raws:
            return
        at, h = self._words(b" " + b" ".join(raws) + b" ")
        ends = np.searchsorted(at, np.cumsum([len(r) + 1 for r in raws]) + 1)
        every = self._shingles(h)
        first = 0
        for end in ends.tolist():
            yield np.unique(every[first : end - self.k + 1]) if end - first >= self.k else self._whole(h[first:end]) if end > first else np.empty(0, np.uint64)
            first = end

    def _long(self, raw: bytes) -> np.ndarray:
        words, at = [], 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= WINDOW else raw.rfind(b" ", at, at + WINDOW)
            if end <= at:  # one word fills the window
                end = raw.find(b" ", at + WINDOW)
                end = len(raw) if end < 0 else end
            words.append(self._words(b" " + raw[at:end] + b" ")[1])
            at = end + 1
        h = np.concatenate(words)
        return np.unique(self._shingles(h)) if len(h) >= self.k else self._whole(h) if len(h) else np.empty(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _texts(column):
    """The texts of an Arrow column, some at a time."""
    for at in range(0, len(column), 500):
        yield from column.slice(at, 500).to_pylist()


def _signed(k: int):
    def run(batches):
        import pyarrow as pa

        shingler = Shingler(k)
        for batch in batches:
            n, key = [], []
            for s in shingler.sets(_texts(batch.column("text"))):
                n.append(len(s))
                key.append(_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(key, pa.binary())], ["doc_id", "h", "n", "key"])

    return run


def _of_texts(k: int):
    """Sets of texts under the first eight bytes of their keys, which are their labels too."""

    def read(batches):
        shingler = Shingler(k)
        for batch in batches:
            for s in shingler.sets(_texts(batch.column("text"))):
                if len(s):
                    i = int.from_bytes(_key(s)[:8], "big", signed=True)
                    yield i, i, s

    return read


def _of_sets(batches):
    for batch in batches:
        for i, label, s in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("s").to_pylist()):
            yield i, label, np.frombuffer(s, np.uint64)


def _fragments(read, fragments: int):
    """Hashes of sets, dealt to fragments of the hash space: per fragment the sets, how many hashes each has there, their low halves."""
    names = ["fragment", "ids", "labels", "sizes", "hashes"]

    def dealt(ids, labels, sets):
        import pyarrow as pa

        h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        low, owner = h[order].astype(np.uint32), owner[order]
        ends = np.searchsorted(at[order], np.arange(fragments + 1))
        ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
        out = [[], [], [], [], []]
        for p, (i, j) in enumerate(zip(ends, ends[1:])):
            if i < j:
                first = i + np.flatnonzero(np.r_[True, owner[i + 1 : j] != owner[i : j - 1]])
                who = owner[first]
                for x, v in zip(out, (p, ids[who].tobytes(), labels[who].tobytes(), np.diff(np.r_[first, j]).astype("<u4").tobytes(), low[i:j].tobytes())):
                    x.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names)

    def run(batches):
        ids, labels, sets, size = [], [], [], 0
        for i, label, s in read(batches):
            ids.append(i)
            labels.append(label)
            sets.append(s)
            size += len(s)
            if size >= CHUNK:
                yield dealt(ids, labels, sets)
                ids, labels, sets, size = [], [], [], 0
        if sets:
            yield dealt(ids, labels, sets)

    return run


def _shared(table):
    """How many hashes of each set in a fragment a set of another label has too."""
    import pyarrow as pa

    joined = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    sizes = joined("sizes", "<u4")
    set_ids, set_labels = joined("ids", np.int64), joined("labels", np.int64)
    owner, h = np.repeat(np.arange(len(sizes)), sizes), joined("hashes", np.uint32)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    label = set_labels[owner]
    several = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(h)]))
    keep = several[run]
    run, ids = run[keep], set_ids[owner[keep]]
    order = np.lexsort((run, ids))  # copies of one set count once
    run, ids = run[order], ids[order]
    once = np.r_[True, (ids[1:] != ids[:-1]) | (run[1:] != run[:-1])] if len(ids) else np.empty(0, bool)
    told, c = np.unique(ids[once], return_counts=True)
    return pa.table([pa.array(told, pa.int64()), pa.array(c, pa.int64())], ["id", "c"])


def shared_counts(rows: DataFrame, read, shingles: int) -> DataFrame:
    """id, c: for each set how many of its shingles lie on lists of several labels; rows hold about so many shingles."""
    fragments = max(FRAGMENTS, -(-shingles // FRAGMENT))
    shape = "fragment int, ids binary, labels binary, sizes binary, hashes binary"
    dealt = rows.mapInArrow(_fragments(read, fragments), shape)
    return dealt.groupBy("fragment").applyInArrow(_shared, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        shingler = Shingler(k)
        for batch in batches:
            out = [[], []]
            for i, key, s in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), shingler.sets(_texts(batch.column("text")))):
                if _key(s) == key:
                    out[0].append(i)
                    out[1].append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["id", "s"])

    return run


def _exploded(sampled: int):
    """Rows (s, id) of sets, of one shingle in `sampled`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("s").to_pylist()]
            if sampled > 1:
                sets = [s[s % np.uint64(sampled) == 0] for s in sets]
            ids = np.repeat(batch.column("id").to_numpy(), list(map(len, sets)))
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            for at in range(0, len(ids), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(values[at : at + 200_000]), pa.array(ids[at : at + 200_000])], ["s", "id"])

    return run


def occurrences(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `least` of the sorted lists, and on how many each lies."""
    if sum(map(len, lists)) <= HEAP:
        told = [(i, c) for i, g in groupby(heapq.merge(*(x.tolist() for x in lists))) if (c := sum(1 for _ in g)) >= least]
        return np.array([i for i, _ in told], np.int64), np.array([c for _, c in told], np.int64)
    ids, c = np.unique(np.concatenate(lists), return_counts=True)
    return ids[c >= least], c[c >= least]


def long_lists(t: int, longest: int) -> int:
    """How many of a query's longest lists are probed instead of merged."""
    return min(t - 1, int(t / (MU * np.log2(max(longest, 2)) + 1)))


def search(sets: list[np.ndarray], labels: np.ndarray, centre: int, similarity: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that connect all sets linked by any: a spanning forest, not all pairs."""
    m, found = len(sets), []
    size = np.array(list(map(len, sets)), np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    label = np.unique(labels, return_inverse=True)[1]

    def link(a: int, others: np.ndarray, overlap: np.ndarray):
        good = 100 * overlap >= similarity * (size[a] + size[others] - overlap)
        for b in others[good].tolist():
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                found.append((a, b))

    held = sets[centre]
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    link(centre, np.arange(m), np.bincount(owner[held[at] == values], minlength=m))
    if (label == label[0]).all():
        return found
    order = np.argsort(values, kind="stable")
    values, members = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    length = np.diff(np.r_[first, len(values)])
    # the lists of each set: those of several members
    run = np.repeat(np.arange(len(first)), length)
    own, of = run[length[run] > 1], members[length[run] > 1]
    order = np.argsort(of, kind="stable")
    own, ends = own[order], np.searchsorted(of[order], np.arange(m + 1))
    main = np.bincount(label).argmax()
    for a in np.flatnonzero(label != main).tolist():
        mine, t = own[ends[a] : ends[a + 1]], least_overlap(int(size[a]), similarity)
        if len(mine) < t:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        many = long_lists(t, int(length[mine[-1]]))
        lists = [members[first[x] : first[x] + length[x]] for x in mine.tolist()]
        ids, c = occurrences(lists[: len(lists) - many], t - many)
        other = label[ids] != label[a]
        ids, c = ids[other], c[other]
        for long in lists[len(lists) - many :] if len(ids) else ():
            p = np.minimum(np.searchsorted(long, ids), len(long) - 1)
            c = c + (long[p] == ids)
        link(a, ids, c)
    return found


def _block(similarity: int):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        centre = min(int(np.searchsorted(ids, table.column("hub")[0].as_py())), len(ids) - 1)
        found = search(sets, np.arange(len(ids)), centre, similarity) if len(ids) > 1 else []
        return pa.table([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

    return run


def _blocks(sets: DataFrame, central: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) inside blocks of classes round the most central class (central: id, rank) that they share lists with."""
    entries = settle(sets.mapInArrow(_exploded(SAMPLED), "s long, id long").join(central.hint("shuffle_hash"), "id"))
    lists = entries.groupBy("s").agg(F.max(F.struct("rank", "id")).alias("top"), F.count("*").alias("c")).where("c > 1")
    meets = entries.select("s", "id").join(lists.select("s", F.col("top.id").alias("hub")).hint("shuffle_merge"), "s")
    best = meets.groupBy("id", "hub").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", "hub")).alias("b"))
    chosen = settle(best.select("id", F.col("b.hub").alias("hub")))
    sizes = chosen.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = chosen.where("id <> hub").join(sizes.hint("shuffle_hash"), "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    centres = sizes.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = members.unionByName(centres).join(sets.hint("shuffle_hash"), "id")
    links = settle(placed.groupBy("hub", "block").applyInArrow(_block(similarity), "a long, b long"))
    discard(entries)
    return links


def _packed(batches):
    """Sorted numbers of members as one byte for the width of a step and the steps: near members take a byte each."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for x in batch.column("members").to_pylist():
            step = np.diff(np.array(x, np.int64), prepend=0)
            width = 1 if step.max() < 1 << 8 else 2 if step.max() < 1 << 16 else 4 if step.max() < 1 << 32 else 8
            out.append(bytes([width]) + step.astype(f"<u{width}").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("least"), pa.array(out, pa.binary())], ["a", "least", "members"])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{raw[0]}", offset=1), dtype=np.int64)


def _merge(table):
    """Candidates of one query: members met on enough of its short lists."""
    import pyarrow as pa

    a, least = table.column("a")[0].as_py(), table.column("least")[0].as_py()
    ids, c = occurrences([_unpacked(x) for x in table.column("members").to_pylist()], least)
    return pa.table([pa.array(np.full(len(ids), a), pa.int64()), pa.array(ids), pa.array(c)], ["a", "b", "c"])


def _probe(similarity: int):
    """Links among candidates: c short lists are shared, and the long ones are probed in the other's sorted set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for c, n, long, s in zip(*(batch.column(x).to_pylist() for x in ("c", "n", "long", "s"))):
                s, long = np.frombuffer(s, np.uint64), np.array(long or [], np.int64).view(np.uint64)
                both = c + int((s[np.minimum(np.searchsorted(s, long), len(s) - 1)] == long).sum())
                good.append(100 * both >= similarity * (n + len(s) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _divide_skip(sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between sets (id, label, n, s) of different labels, over all of them.

    Sets are numbered by size, and a pair is asked for by its smaller number: what it must share is what sets of equal
    size must, and what a list sends is its members behind the asking one.
    """
    sets = settle(numbered(sets.select("id", "label", "n", "s"), "n", "id", name="p"))
    about = sets.select("p", "id", "label", "n")
    entries = sets.select(F.col("p").alias("id"), "s").mapInArrow(_exploded(1), "s long, id long").withColumnRenamed("id", "p")
    entries = settle(entries.join(about.drop("id").hint("shuffle_hash"), "p"))
    lists = entries.groupBy("s").agg(F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("s", "df")
    of = W.partitionBy("p")
    own = entries.join(lists.hint("shuffle_merge"), "s").withColumn("k", F.count("*").over(of)).where(F.col("k") * 100 >= similarity * F.col("n"))
    t = F.ceil(F.lit(2 * similarity) * F.col("n") / (100 + similarity)).cast("int")
    ranked = own.withColumn("t", t).withColumn("r", F.row_number().over(of.orderBy("df", "s"))).withColumn("longest", F.max("df").over(of))
    many = F.least(F.col("t") - 1, F.floor(F.col("t") / (F.lit(MU) * F.log2("longest") + 1)).cast("int"))
    ranked = settle(ranked.withColumn("many", many))
    asking = ranked.where(F.col("k") >= F.col("t"))
    is_short = F.col("r") <= F.col("k") - F.col("many")
    part = F.pmod(F.xxhash64("p"), F.ceil(F.col("df") / PART)).cast("int")
    index = ranked.groupBy("s", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("p", "label", "n"))).alias("members"))
    asked = asking.where(is_short).select("s", F.col("p").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), (F.col("t") - F.col("many")).alias("least"))
    others = F.expr(f"transform(filter(members, m -> m.p > a and m.label <> la and 100 * na >= {similarity} * m.n), m -> m.p)")
    sent = asked.join(index.hint("shuffle_merge"), "s").select("a", "least", others.alias("members")).where("size(members) > 0")
    packed = sent.mapInArrow(_packed, "a long, least int, members binary")
    found = settle(packed.groupBy("a").applyInArrow(_merge, "a long, b long, c long"))
    long = asking.where(~is_short).groupBy(F.col("p").alias("a")).agg(F.collect_list("s").alias("long"))
    long = about.select(F.col("p").alias("a"), F.col("id").alias("a_id"), "n").join(long.hint("shuffle_hash"), "a", "left")
    other = sets.select(F.col("p").alias("b"), F.col("id").alias("b_id"), "s")
    probed = found.join(long.hint("shuffle_hash"), "a").join(other.hint("shuffle_hash"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "c", "n", "long", "s")
    links = settle(probed.mapInArrow(_probe(similarity), "a long, b long"))
    for x in (entries, ranked, sets):
        discard(x)
    return links


def similar_components(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); similarity in hundredths."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(texts.withColumn("h", F.xxhash64("text")).mapInArrow(_signed(words), "doc_id long, h long, n long, key binary"))
    grouped = signed.where("key is not null").groupBy("key").agg(F.min("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h")).alias("row"))
    classes = settle(grouped.select("key", "n", "copies", "first", "row", F.monotonically_increasing_id().alias("id")))
    rows, shingles = signed.agg(F.count("*"), F.sum("n")).first()
    need = F.lit(similarity)

    told = shared_counts(texts.select("text"), _of_texts(words), shingles or 0).withColumnRenamed("id", "k8")
    k8 = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    open_ = classes.withColumn("k8", k8).join(told.hint("shuffle_hash"), "k8").where((F.col("c") * 100 >= need * F.col("n")) & (F.col("n") * 100 >= need * (F.col("n") + 1)))
    open_ = settle(open_.select("id", "n", "c", "key", "row"))
    wanted = open_.select("id", "key", F.col("row.doc_id").alias("rd"), F.col("row.h").alias("h"))
    chosen = texts.withColumn("h", F.xxhash64("text")).join(wanted.hint("shuffle_hash"), ["h"]).where(F.col("doc_id").eqNullSafe(F.col("rd")))
    sets = settle(chosen.dropDuplicates(["h", "id"]).select("id", "key", "text").mapInArrow(_sets(words), "id long, s binary"))

    links = _blocks(sets, open_.select("id", F.floor(F.col("c") * 1000 / F.col("n")).alias("rank")), similarity)
    roots = settle(components(links))
    labelled = settle(sets.join(open_.select("id", "n").hint("shuffle_hash"), "id").join(roots.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").select("id", "n", F.coalesce("root", "id").alias("label"), "s"))
    rest = shared_counts(labelled, _of_sets, open_.agg(F.sum("n")).first()[0] or 0)
    left = settle(labelled.join(rest.hint("shuffle_hash"), "id").where(F.col("c") * 100 >= need * F.col("n")).drop("c"))
    if not left.isEmpty():
        more = _divide_skip(left, similarity)
        if not more.isEmpty():
            roots = settle(components(links.unionByName(more)))

    rooted = classes.join(roots.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    keyed = rooted.select("key", "copies", "root").join(least.hint("shuffle_merge"), "root")
    keyed = settle(keyed.select("key", "copies", "component"))
    for x in (sets, labelled, left):
        discard(x)
    out = spread_join(signed.where("key is not null").select("doc_id", "n", "key"), keyed, "key", "copies", rows).select("doc_id", "n", "component")
    out = out.unionByName(signed.where("key is null").select("doc_id", "n", F.col("doc_id").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
