"""Exact top-k search by inner product with cover trees over queries and data.

A bounded sample gives the top nodes, chosen farthest first; every query and every vector belongs to its
nearest top node, so both share the top of the index. Each node's vectors are dealt into blocks of bounded
size by id, and each task builds the lower levels of a block: a node's children are chosen farthest first until they
cover it with half its radius, or until there is one for every eight of its rows. A query group is the queries of one
top node.

For a query node (centre c, radius r) and a data node (d, s) no score exceeds c.d + |c| s + |d| r + r s. A
first round searches each group against blocks of its own node and gives every query a kth score to beat; the
second joins only the groups and blocks whose bound reaches the group's worst kth score, and prunes node pairs
below them in the same way. Equal vectors are reduced to the k + 1 smallest ids first, which is exact: no
query can use more. Blocks of data meet query groups in superblocks, so neither side is collected whole.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or as
candidate; shorter vectors count as padded with zeros, so an empty one scores 0; a query is never its own
candidate (rows that repeat its id are not either); repeated rows are one candidate; ties go to the smaller id;
a null id takes no part. Scores are exact 64-bit integers. Other columns, whatever their names, are ignored; no queries, no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import bounded_sample, parts, settle

SAMPLE, NODES = 4096, 128  # rows that the top nodes are chosen from; top nodes
BLOCK, GROUP, LEAF = 4096, 256, 48  # vectors of a block, queries of a group, vectors of a leaf
GROUPS = 32  # query groups that meet a block in one task


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the floor of scale times each component, of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def _matrix(rows) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Indices of centres, then each point's centre and distance; stops once all are within radius."""
    centres, owner = [0], np.zeros(len(points), np.int64)
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(centres) < most and gap.max() > radius:
        c = int(gap.argmax())
        new = np.sqrt(((points - points[c]) ** 2).sum(axis=1))
        closer = new < gap
        owner[closer], gap[closer] = len(centres), new[closer]
        centres.append(c)
    return centres, owner, gap


class Node:
    """Rows of a matrix within `radius` of `centre`; a leaf has no children."""

    __slots__ = ("centre", "norm", "radius", "rows", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, leaf: int = LEAF):
        own = points[rows]
        gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
        self.centre, self.norm, self.radius, self.rows, self.children = centre, float(np.sqrt((centre**2).sum())), float(gap.max()), rows, []
        if len(rows) > leaf and self.radius > 0:
            centres, owner, _ = farthest_first(own, max(2, len(rows) // 8), self.radius / 2)
            if len(centres) > 1:
                self.children = [Node(points, rows[owner == i], own[c], leaf) for i, c in enumerate(centres)]


def bound(c, cn, r, d, dn, s):
    """No inner product between balls about c and d exceeds this; lifted over rounding."""
    x = c @ d + cn * s + dn * r + r * s
    return x + 1e-9 * (np.abs(x) + cn * dn) + 1e-6


class Search:
    """Best k (score, id) of each query, kept sorted."""

    def __init__(self, q_ids, q, k, floor):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.score = np.full((len(q_ids), k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((len(q_ids), k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor  # what each query's kth score is known to be at least

    def worst(self, rows):
        return np.maximum(self.score[rows, -1], self.floor[rows]).min()

    def run(self, query: Node, data: Node, d_ids, d):
        top = bound(query.centre, query.norm, query.radius, data.centre, data.norm, data.radius)
        stack = [(top, query, data)]
        while stack:
            top, a, b = stack.pop()
            if top < self.worst(a.rows):
                continue
            if not a.children and not b.children:
                self._compare(a.rows, b.rows, d_ids, d)
                continue
            split = b.children and (not a.children or b.radius >= a.radius)
            pairs = [(a, x) for x in b.children] if split else [(x, b) for x in a.children]
            new = [(bound(x.centre, x.norm, x.radius, y.centre, y.norm, y.radius), x, y) for x, y in pairs]
            stack.extend(sorted(new, key=lambda p: p[0]))  # the most promising pair comes off first

    def _compare(self, rows, others, d_ids, d):
        x, y = self.q[rows], d[others]
        small = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2**52
        scores = (x.astype(float) @ y.astype(float).T).astype(np.int64) if small else x @ y.T
        ids = np.broadcast_to(d_ids[others], scores.shape)
        scores = np.where(ids == self.q_ids[rows][:, None], np.iinfo(np.int64).min, scores)
        ids = np.where(scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids)
        scores, ids = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, ~scores), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _nearest(centres: np.ndarray):
    """Adds each row's top node and its distance to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column("v").to_pylist()
            x = _fit(_matrix(rows), max(centres.shape[1], max(map(len, rows), default=0))).astype(float)
            c = _fit(centres, x.shape[1]).astype(float)
            far = np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * x @ c.T, 0)
            node = far.argmin(axis=1) if len(x) else np.empty(0, np.int64)
            gap = np.sqrt(((x - c[node]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(node, pa.int32()), pa.array(gap)], ["vec_id", "v", "node", "gap"])

    return run


def _group_nodes(centres: np.ndarray, radii: dict[int, float]):
    """For each query group the top nodes that may hold one of its k best."""
    nodes = np.array(sorted(radii), np.int64)

    def run(batches):
        import pandas as pd

        far = np.array([radii[n] for n in nodes])
        c = centres.astype(float)
        norm = np.sqrt((c**2).sum(axis=1))
        for pdf in batches:
            out = []
            for g, n, r, least in zip(pdf["g"], pdf["node"], pdf["radius"], pdf["least"]):
                top = bound(c[nodes], norm[nodes], far, c[n], norm[n], r)
                out.append(pd.DataFrame({"g": g, "node": nodes[top >= least].astype(np.int32)}))
            yield pd.concat(out) if out else pd.DataFrame({"g": np.empty(0, np.int64), "node": np.empty(0, np.int32)})

    return run


def _dual(k: int):
    """One data block against its query groups."""

    def run(key, queries, data):
        import pandas as pd

        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        if not len(queries) or not len(data):
            return empty
        d = _matrix(data["v"].tolist())
        q = _matrix(queries["v"].tolist())
        width = max(d.shape[1], q.shape[1])
        d, q = _fit(d, width), _fit(q, width)
        d_ids, q_ids = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        df, qf = d.astype(float), q.astype(float)
        search = Search(q_ids, q, k, queries["least"].to_numpy())
        tree = Node(df, np.arange(len(d)), df[((df - df.mean(axis=0)) ** 2).sum(axis=1).argmin()])
        for _, rows in queries.groupby("g").indices.items():
            search.run(Node(qf, rows, qf[rows[0]], 32), tree, d_ids, d)
        i, j = np.nonzero(search.score > np.iinfo(np.int64).min)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": search.id[i, j], "score": search.score[i, j]})

    return run


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of `vectors` (vec_id, v array<long>) for each row where is_query holds."""
    spark = vectors.sparkSession
    every = settle(vectors.select("vec_id", "v"))
    # the k + 1 smallest ids of each vector; ties beyond them never show
    once = every.distinct().withColumn("i", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("i") <= k + 1).drop("i")
    sample = bounded_sample(every.select("v"), SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = _matrix(sample["v"].tolist())
    centres = points[farthest_first(points.astype(float), NODES)[0]]
    shape = "vec_id long, v array<long>, node int, gap double"
    data = settle(once.mapInArrow(_nearest(centres), shape))
    queries = settle(every.where(is_query).distinct().mapInArrow(_nearest(centres), shape))
    # at most NODES rows
    sizes = {r["node"]: r for r in data.groupBy("node").agg(F.count("*").alias("n"), F.max("gap").alias("far")).collect()}
    radii = {n: r["far"] * (1 + 1e-9) + 1e-6 for n, r in sizes.items()}
    blocks = {n: -(-r["n"] // BLOCK) for n, r in sizes.items()}
    many = {r["node"]: -(-r["count"] // GROUP) for r in queries.groupBy("node").count().collect()}
    by_node = lambda d: F.element_at(F.create_map(*[F.lit(x) for p in sorted(d.items()) for x in p]), F.col("node")) if d else F.lit(1)
    first = dict(zip(sorted(many), np.cumsum([0, *[many[n] for n in sorted(many)]]).tolist()))
    g = by_node(first) + F.pmod(F.xxhash64("vec_id"), by_node(many))
    queries = queries.withColumn("g", g.cast("long"))
    data = data.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), by_node(blocks)).cast("int"))
    out = "query_id long, vec_id long, score long"
    at = parts(spark, sum(r["n"] for r in sizes.values()), BLOCK)

    def meet(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs: g, node, block."""
        pairs = settle(pairs.select("g", "node", "block", F.floor(F.col("g") / GROUPS).alias("s")))
        blocks = pairs.select("node", "block", "s").distinct().toDF("node", "block", "t")
        left = queries.select("g", "vec_id", "v", "least").join(pairs.hint("shuffle_merge"), "g").repartition(at, "node", "block", "s")
        right = data.select("node", "block", "vec_id", "v").join(blocks.hint("shuffle_merge"), ["node", "block"]).repartition(at, "node", "block", "t")
        return left.groupBy("node", "block", "s").cogroup(right.groupBy("node", "block", "t")).applyInPandas(_dual(k), out)

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    nothing = F.lit(-(2**63)).cast("long")
    home = queries.select("g", "node").distinct().where(F.col("node").isin(sorted(blocks))).withColumn("block", F.lit(0))
    seen = best(meet(queries.withColumn("least", nothing), home))
    floors = seen.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    known = settle(queries.join(floors.hint("shuffle_merge"), "vec_id", "left").withColumn("least", F.coalesce("least", nothing)))
    groups = known.groupBy("g", "node").agg((F.max("gap") * (1 + 1e-9) + 1e-6).alias("radius"), F.min("least").alias("least"))
    near = groups.mapInPandas(_group_nodes(centres, radii), "g long, node int")
    pairs = near.withColumn("block", F.explode(F.sequence(F.lit(0), (by_node(blocks) - 1).cast("int")))) if blocks else near
    return best(meet(known, pairs)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
