"""MinHash near-duplicate detection with an LSH forest.

Every distinct shingle set gets a MinHash signature. The forest holds several sorted orders of the signatures, each
starting at another hash. Rows whose longest common prefix in an order has at least LEAST hashes lie in one region;
a region of more than THIN rows is split by longer prefixes until its parts are that small, and all rows of a part
are candidates of each other, besides the next rows in the order. Candidates whose signatures agree are confirmed
on full shingle sets, likely ones first and the others only where their ends are still in different components.

What the descent leaves out is searched exactly: regions that had to be split and whose rows are still in several
components. First each row meets the region's central rows (those nearest to the most frequent hashes, so the
centre of a star is among them); then rows outside the largest component meet all rows of the region, in cells of
BLOCK rows by BLOCK that count overlaps of full sets and pass on a spanning forest of the links, never all pairs.
A pair at the similarity therefore is missed only if it shares no region in any order, which for 0.8 has the
probability (1 - 0.8**3)**12 = 0.0002, or if under LIKELY of its hashes agree.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; a text
with fewer words than a shingle is one shingle of all its words; rows with equal texts or equal sets are one
class and always linked; rows that share a doc_id count as one node; a null doc_id takes the component of its
class, null if there is none. Any other columns, whatever their names, are ignored (keep_first keeps them). Ties in
an order are broken by id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import ASCII_LOWER, components, discard, parts, settle, settle_texts

TREES, DEPTH, LEAST = 12, 8, 3  # orders, hashes that an order sorts by, least common prefix of a region
THIN, NEAR = 32, 2  # most rows of a region that is compared wholly, neighbours compared in any region
BLOCK = 1024  # rows of a region that one task compares with as many others
CENTRAL = 32  # central rows of a region that all its rows meet
HASHES = TREES * DEPTH
LIKELY = 0.58  # least share of equal hashes; five standard deviations under 0.8


def _words(text: str | None) -> list[bytes]:
    return text.encode().translate(ASCII_LOWER).split() if text else []


class _Hasher(dict):
    """64-bit hash of each word; starts anew before it gets large."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(words: list[bytes], k: int, hasher: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hasher.__getitem__, words), np.uint64, n)
    step = np.uint64(0x9E3779B97F4A7C15)
    if n < k:
        out = np.array([n], np.uint64)
        for x in h:
            out = (out ^ x) * step
            out ^= out >> np.uint64(29)
        return out
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out *= step
        out ^= out >> np.uint64(29)
        out += h[i : n - k + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _signatures(k: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        rng = np.random.default_rng(20)
        mul = rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
        add = rng.integers(0, 2**32, HASHES, dtype=np.uint32)
        hasher = _Hasher()
        for batch in batches:
            size, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(_words(text), k, hasher)
                size.append(len(s))
                if not len(s):
                    key.append(None)
                    sig.append(None)
                    continue
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                top = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
                for at in range(0, len(s), 512):
                    hashed = mul[:, None] * top[None, at : at + 512]
                    hashed += add[:, None]
                    np.minimum(low, hashed.min(axis=1), out=low)
                sig.append(low.astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "key", "sig"])

    return run


def _trees(batches):
    """A row per order: its hashes, and one byte of every hash of the signature."""
    import pyarrow as pa

    for batch in batches:
        ids, ns = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        sigs = batch.column("sig").to_pylist()
        order = [s[t * DEPTH * 4 : (t + 1) * DEPTH * 4] for t in range(TREES) for s in sigs]
        short = [s[3::4] for s in sigs] * TREES
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), len(ids))), pa.array(order, pa.binary()), pa.array(np.tile(ids, TREES)), pa.array(np.tile(ns, TREES)), pa.array(short, pa.binary())], ["tree", "path", "id", "n", "sig"])


class _Order:
    """Consecutive rows of the sorted orders: tree, path, id, n, sig as columns."""

    def __init__(self, table):
        self.tree, self.ids, self.ns = (table.column(c).to_numpy() for c in ("tree", "id", "n"))
        self.raw, self.short = table.column("path").to_pylist(), table.column("sig").to_pylist()
        m = len(self.ids)
        self.path = np.frombuffer(b"".join(self.raw), ">u4").reshape(m, DEPTH)
        self.sig = np.frombuffer(b"".join(self.short), np.uint8).reshape(m, HASHES)
        same = (self.tree[1:] == self.tree[:-1])[:, None] & (self.path[1:] == self.path[:-1])
        #: hashes that each row shares with the next
        self.common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        self.run = np.cumsum(np.r_[True, self.common < LEAST]) - 1
        sizes = []
        for d in range(LEAST, DEPTH + 1):
            run = np.cumsum(np.r_[True, self.common < d]) - 1
            sizes.append(np.bincount(run)[run])
        self.sizes = np.array(sizes)

    def region(self, i: int) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(bytes([self.tree[i]]) + self.raw[i][: 4 * LEAST]) >> 1

    def pairs(self, need: int, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates a < b and their share of equal hashes; rows marked in `out` take no part."""
        found, m, least = [], len(self.ids), self.common
        for j in range(1, min(THIN, m)):
            if j > 1:  # the prefix that two rows share is the least between them
                least = np.minimum(least[:-1], self.common[j - 1 :])
            take = least >= LEAST
            if j > NEAR:
                take &= self.sizes[np.maximum(least - LEAST, 0), np.arange(m - j)] <= THIN
            if out is not None:
                take &= ~out[j:] & ~out[:-j]
            small, large = np.minimum(self.ns[j:], self.ns[:-j]), np.maximum(self.ns[j:], self.ns[:-j])
            take &= (small * 100 >= large * need) & (self.ids[j:] != self.ids[:-j])
            i = np.flatnonzero(take)
            if not len(i) and j > NEAR and not (least >= LEAST).any():
                break
            for at in range(0, len(i), 20_000):
                some = i[at : at + 20_000]
                share = (self.sig[some] == self.sig[some + j]).mean(axis=1)
                good = share >= LIKELY
                found.append((self.ids[some][good], self.ids[some + j][good], share[good]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        a, b, share = map(np.concatenate, zip(*found))
        return np.minimum(a, b), np.maximum(a, b), share


FOUND = "what int, a long, b long, region long, tree int, path binary, id long, n long, sig binary"
PAIR, MAYBE, DENSE, BORDER, MARK = range(5)  # what a row of FOUND is: likely pairs and others, rows of split regions, rows of regions that end a range, those of split ones


def _forest(a, b, order) -> np.ndarray:
    """Which pairs, taken in order, join what earlier ones left apart."""
    parent: dict[int, int] = {}
    first = np.zeros(len(a), bool)

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for i in order.tolist():
        p, q = find(int(a[i])), find(int(b[i]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            first[i] = True
    return first


def _told(order: _Order, need: int, dense: np.ndarray, border: np.ndarray, marks: list[int]):
    import pyarrow as pa

    a, b, share = order.pairs(need, border)
    first = _forest(a, b, np.lexsort((b, a, -share)))
    heads = {int(r): order.region(int(i)) for i in np.r_[np.flatnonzero(dense), np.flatnonzero(border)] for r in (order.run[i],)} if len(order.ids) else {}
    d, e = np.flatnonzero(dense), np.flatnonzero(border)
    regions = [heads[int(order.run[i])] for i in np.r_[d, e]] + marks
    p, k = len(a), len(regions)
    rest = k - len(marks)
    pick = np.r_[d, e]
    none = lambda n, t: pa.nulls(n, t)
    keep = lambda values, t: pa.concat_arrays([none(p, t), pa.array(values, t), none(len(marks), t)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[np.where(first, PAIR, MAYBE), np.full(len(d), DENSE), np.full(len(e), BORDER), np.full(len(marks), MARK)].astype(np.int32)),
            pa.concat_arrays([pa.array(a), none(k, pa.int64())]),
            pa.concat_arrays([pa.array(b), none(k, pa.int64())]),
            pa.concat_arrays([none(p, pa.int64()), pa.array(regions, pa.int64())]),
            keep(order.tree[pick], pa.int32()),
            keep([None] * len(d) + [order.raw[i] for i in e], pa.binary()),
            keep(order.ids[pick], pa.int64()),
            keep(order.ns[pick], pa.int64()),
            keep([None] * len(d) + [order.short[i] for i in e], pa.binary()),
        ],
        [c.split()[0] for c in FOUND.split(", ")],
    )


def _search(need: int):
    """What one range of the orders holds; its first and last region may go on in other ranges."""

    def run(batches):
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        order = _Order(pa.Table.from_batches(rows))
        ends = (order.run == 0) | (order.run == order.run[-1])
        dense = order.sizes[0] > THIN
        marks = [order.region(int(i)) for i in {0, len(order.ids) - 1} if dense[i]]
        yield _told(order, need, dense, ends & ~dense, marks)

    return run


def _border(need: int):
    """The same for a region that ends a range, of its rows that are not in the midst of it."""

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = pc.any(pc.equal(table.column("what"), MARK)).as_py()
        rows = table.filter(pc.equal(table.column("what"), BORDER))
        if rows.num_rows:
            order = _Order(rows.sort_by([("path", "ascending"), ("id", "ascending")]))
            dense = np.full(rows.num_rows, marked) | (order.sizes[0] > THIN)
            return pa.Table.from_batches([_told(order, need, dense, np.zeros(rows.num_rows, bool), [])])
        return pa.table([pa.nulls(0, f.type) for f in table.schema], table.schema.names)

    return run


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        hasher = _Hasher()
        for batch in batches:
            sets = [shingle_set(_words(t), k, hasher).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "s"])

    return run


def _confirm(need: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= need * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _central(table):
    """The rows of a block of a region whose signatures are nearest to its most frequent hashes."""
    import pyarrow as pa

    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    usual = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], np.uint8)
    score = (sig == usual).sum(axis=1)
    top = np.lexsort((table.column("id").to_numpy(), -score))[: CENTRAL // 4]
    return pa.table([table.column("region").take(top), table.column("id").take(top), table.column("n").take(top), table.column("sig").take(top), pa.array(score[top])], ["region", "id", "n", "sig", "score"])


def _meet(need: int):
    """Each row with the two likeliest of its region's central rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for i, n, s, centre in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "sig", "centre"))):
                some = [c for c in centre if c["id"] != i and min(n, c["n"]) * 100 >= max(n, c["n"]) * need]
                if some:
                    share = (np.frombuffer(b"".join(c["sig"] for c in some), np.uint8).reshape(-1, HASHES) == np.frombuffer(s, np.uint8)).mean(axis=1)
                    for at in np.argsort(-share, kind="stable")[:2]:
                        if share[at] >= LIKELY:
                            a.append(min(i, some[at]["id"]))
                            b.append(max(i, some[at]["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets xs with all sets ys, each of distinct values."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    tx, ty = np.concatenate(xs), np.concatenate(ys)
    rx, ry = np.repeat(np.arange(len(xs)), list(map(len, xs))), np.repeat(np.arange(len(ys)), list(map(len, ys)))
    known = np.intersect1d(tx, ty)
    if not len(known):
        return out

    def placed(t, r):
        c = np.minimum(np.searchsorted(known, t), len(known) - 1)
        own = known[c] == t
        order = np.argsort(c[own], kind="stable")
        return c[own][order], r[own][order]

    (cx, rx), (cy, ry) = placed(tx, rx), placed(ty, ry)
    dx, dy = np.bincount(cx, minlength=len(known)), np.bincount(cy, minlength=len(known))
    rare = dx * dy <= 64
    # values of few rows: their pairs one by one; others: by products of matrices of zeros and ones
    own = np.flatnonzero(rare[cx])
    many = dy[cx[own]]
    left = np.repeat(rx[own], many)
    begin = np.r_[0, np.cumsum(dy)[:-1]]
    step = np.arange(len(left)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]] if len(many) else many, many)
    right = ry[np.repeat(begin[cx[own]], many) + step]
    out += np.bincount(left * len(ys) + right, minlength=out.size).reshape(out.shape)
    often = np.flatnonzero(~rare)
    place = np.full(len(known), -1)
    place[often] = np.arange(len(often))
    px, py = place[cx], place[cy]
    for at in range(0, len(often), 2048):
        x, y = np.zeros((len(xs), 2048), np.float32), np.zeros((len(ys), 2048), np.float32)
        for m, p, r in ((x, px, rx), (y, py, ry)):
            some = (p >= at) & (p < at + 2048)
            m[r[some], p[some] - at] = 1
        out += x @ y.T
    return out


def _cell(need: int):
    """A spanning forest of the links in one cell: two blocks of a region, or one with itself."""

    def run(table):
        import pyarrow as pa

        ids, roots, sides = (table.column(c).to_numpy() for c in ("id", "root", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("s").to_pylist()]
        x = np.flatnonzero(sides == 0)
        y = np.flatnonzero(sides == 1) if (sides == 1).any() else x
        if not len(x):
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        both = overlaps([sets[i] for i in x], [sets[i] for i in y])
        size = np.array(list(map(len, sets)), np.float64)
        linked = (100 * both >= need * (size[x][:, None] + size[y][None, :] - both)) & (roots[x][:, None] != roots[y][None, :])
        i, j = np.nonzero(linked)
        first = _forest(roots[x[i]], roots[y[j]], np.arange(len(i)))
        a, b = ids[x[i[first]]], ids[y[j[first]]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    """Regions (of rows region, id, root) in several components, with their largest one and how many blocks it and the rest make."""
    per = rows.groupBy("region", "root").agg(F.count("*").alias("c")).groupBy("region").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"))
    return per.where("k > 1").select("region", F.col("top.root").alias("top"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("mains"))


def _cells(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Rows once per cell: i, j, side. Rows of a region's largest component meet all others, and the others meet each other."""
    placed = rows.join(several.hint("shuffle_merge"), "region").withColumn("main", F.col("root") == F.col("top"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # blocks of the largest component are numbered after the others
    mains = "transform(sequence(0, mains - 1), x -> named_struct('i', block, 'j', others + x, 'side', 0))"
    cells = F.when(F.col("main"), F.expr("transform(sequence(0, others - 1), x -> named_struct('i', x, 'j', others + block, 'side', 1))")).otherwise(
        F.expr(f"concat({mains}, transform(sequence(0, others - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'side', int(x < block))))")
    )
    return placed.select("region", "id", "root", F.explode(cells).alias("cell")).select("region", "id", "root", "cell.*")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("id"), "root").hint("shuffle_hash"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _rest(dense: DataFrame, classes: DataFrame, roots: DataFrame, set_of, confirm, need: int) -> DataFrame:
    """Components (node, root) when split regions (dense: region, id) that lie in several components are searched exactly."""
    rows = settle(_rooted(dense, roots))
    several = settle(_sizes(rows))
    if several.isEmpty():
        return roots
    open_ = settle(rows.join(several.hint("shuffle_merge"), "region").withColumn("blocks", F.col("others") + F.col("mains")).select("region", "id", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("others") + F.col("mains")).cast("int").alias("block")))
    wanted = open_.select("id").distinct()
    sets = settle_texts(set_of(wanted))
    short = classes.select("id", "n", F.expr(f"unhex(array_join(transform(sequence(0, {HASHES - 1}), i -> hex(substring(sig, i * 4 + 4, 1))), ''))").alias("sig")).join(wanted.hint("shuffle_hash"), "id", "left_semi")
    about = settle(open_.join(short.hint("shuffle_hash"), "id"))
    central = about.select("region", "block", "id", "n", "sig").groupBy("region", "block").applyInArrow(_central, "region long, id long, n long, sig binary, score long")
    best = central.withColumn("r", F.row_number().over(W.partitionBy("region").orderBy(F.desc("score"), "id"))).where(F.col("r") <= CENTRAL)
    centres = best.groupBy("region").agg(F.collect_list(F.struct("id", "n", "sig")).alias("centre")).join(several.select("region", (F.col("others") + F.col("mains")).alias("blocks")).hint("shuffle_merge"), "region")
    centres = settle(centres.select("region", "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    met = about.join(centres.hint("shuffle_hash"), ["region", "block"]).select("id", "n", "sig", "centre").mapInArrow(_meet(need), "a long, b long").distinct()
    links = settle_texts(confirm(settle(met), sets))
    joined = lambda links: settle(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
    if not links.isEmpty():
        roots = joined(links)
    rows = settle(_rooted(open_.select("region", "id"), roots))
    cells = settle(_cells(rows, _sizes(rows)))
    if not cells.isEmpty():
        found = cells.join(sets.hint("shuffle_hash"), "id").groupBy("region", "i", "j").applyInArrow(_cell(need), "a long, b long")
        links = settle(found.distinct())
        if not links.isEmpty():
            roots = joined(links)
    for x in (several, about, centres, sets, cells):
        discard(x)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); similarity in hundredths."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle_texts(texts.mapInArrow(_signatures(words), "doc_id long, n long, key binary, sig binary"))
    # classes: equal sets, once; the smallest id stands for them
    first = F.min(F.struct(F.col("doc_id").alias("id"), "n", "sig"))
    classes = settle(signed.where("key is not null and doc_id is not null").groupBy("key").agg(first.alias("f")).select("key", "f.id", "f.n", "f.sig"))
    orders = classes.select("id", "n", "sig").mapInArrow(_trees, "tree int, path binary, id long, n long, sig binary")
    at = parts(spark, classes.count() * TREES, 200_000)
    ordered = orders.repartitionByRange(at, "tree", "path", "id").sortWithinPartitions("tree", "path", "id")
    found = settle(ordered.mapInArrow(_search(similarity), FOUND))
    ends = settle(found.where(F.col("what").isin(BORDER, MARK)).groupBy("region").applyInArrow(_border(similarity), FOUND))
    found = found.unionByName(ends)
    pairs = settle(found.where(F.col("what").isin(PAIR, MAYBE)).groupBy("a", "b").agg(F.min("what").alias("what")))

    def set_of(ids: DataFrame) -> DataFrame:
        chosen = texts.withColumnRenamed("doc_id", "id").join(ids.hint("shuffle_hash"), "id").select("id", "text")
        return chosen.mapInArrow(_sets(words), "id long, s binary").dropDuplicates(["id"])

    def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        x, y = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
        return pairs.join(x.hint("shuffle_merge"), "a").join(y.hint("shuffle_merge"), "b").select("a", "b", "x", "y").mapInArrow(_confirm(similarity), "a long, b long")

    # likely pairs that span what they join first; then only pairs whose ends are still apart need their sets compared
    sets = settle_texts(set_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    links = settle_texts(confirm(pairs.where(F.col("what") == PAIR).select("a", "b"), sets))
    roots = settle(components(links)).hint("shuffle_merge")
    apart = pairs.where(F.col("what") == MAYBE).select("a", "b")
    apart = apart.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    more = settle_texts(confirm(apart.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), sets))
    if not more.isEmpty():
        roots = settle(components(links.unionByName(more)))
    roots = _rest(found.where(F.col("what") == DENSE).select("region", "id"), classes, roots, set_of, confirm, similarity)
    keyed = classes.select("key", "id").join(roots.select(F.col("node").alias("id"), "root").hint("shuffle_merge"), "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    out = signed.select("doc_id", "n", "key").join(keyed.hint("shuffle_merge"), "key", "left")
    component = F.coalesce("root", "doc_id")
    for x in (found, pairs, sets, links, more):
        discard(x)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """docs without the rows whose document is not the first of its component; of rows sharing a doc_id all stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), words, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
