"""Matching against references, dictionaries and hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.settle import settle
from .chunks import each_run

#: Rows of a block of hashes, and of those how many are compared with another block at once.
TILE, STRIPE = 16_384, 32


def _vectors(values) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, and their lengths: -1 for a null list; one that holds a null or NaN has NaN there."""
    lists = values.to_pylist()
    size = np.array([-1 if v is None else len(v) for v in lists])
    out = np.zeros((len(lists), max(1, size.max(initial=0))))
    for i, v in enumerate(lists):
        if v is not None:
            out[i, : len(v)] = v
    return out, size


def _best(k: int):
    """Of a tile's queries (side 0) the references (side 1) that may be among their k best, with the exact cosine."""

    def decide(table):
        import pyarrow as pa

        side = table.column("side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)).sort_by("id")
        (q, nq), (r, nr), m = _vectors(a.column("v")), _vectors(b.column("v")), min(k, b.num_rows)
        width = max(q.shape[1], r.shape[1])
        q, r = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, r))
        ids, refs = a.column("id").to_numpy(), b.column("id").to_numpy()

        def norm(x):
            total = np.zeros(len(x))
            for d in range(width):  # in the order of a plain sum
                total += x[:, d] * x[:, d]
            return np.sqrt(total)

        lq, lr = norm(q), norm(r)
        with np.errstate(all="ignore"):
            for s in range(0, len(q) if m else 0, 256):
                x, l = q[s : s + 256], lq[s : s + 256]
                about = (x @ r.T) / (l[:, None] * lr[None, :])
                about[(nq[s : s + 256, None] != nr[None, :]) | (nq[s : s + 256, None] < 0) | ~np.isfinite(about)] = -9.0
                kth = np.partition(about, about.shape[1] - m, axis=1)[:, about.shape[1] - m]
                i, j = np.nonzero(about >= kth[:, None] - 3e-6)  # scores are told to six places
                known = about[i, j] > -9
                dot = np.zeros(len(i))
                for d in range(width):
                    dot += x[i, d] * r[j, d]
                score = np.where(known, dot / (l[i] * lr[j]), -9.0)
                order = np.lexsort((refs[j], -score, i))  # of equal scores the k smallest ids are enough
                i, j, score = i[order], j[order], score[order]
                start = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (score[1:] != score[:-1])])
                keep = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
                i, j, score = i[keep], j[keep], score[keep]
                yield pa.table([pa.array(ids[s + i]), pa.array(refs[j]), pa.array(score, mask=score == -9)], ["q_id", "r_id", "score"])

    return decide


def nearest_reference(queries: DataFrame, references: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """The k references (r_id, r_v) most similar in cosine to each query (q_id, q_v), of the query's class; a query without class has none.

    Scores are rounded to six places, ties go to the smaller id; vectors that are null, zero, of unlike lengths or hold
    no number have a null score, behind all others. Every query is compared with every reference of its class, by
    matrix products of about `block` queries and references at a time; what may be among the k best is then scored
    term by term, so the product's rounding decides nothing. Only these go on to the final order.
    """
    def dealt(df, id, v):
        rows = df.where("class is not null").select("class", F.col(id).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
        sizes = settle(rows.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("n")))
        return rows, sizes, "broadcast" if sizes.count() <= 100_000 else "shuffle_merge"

    (q, nq, hq), (r, nr, hr) = dealt(queries, "q_id", "q_v"), dealt(references, "r_id", "r_v")
    own = lambda df, n, how: df.join(n.hint(how), "class").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    other = lambda df, n, how: df.join(n.hint(how), "class").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    at = ["class", "i", "j"]
    left = other(own(q, nq, hq), nr, hr).select("class", F.col("k").alias("i"), F.col("o").alias("j"), F.lit(0).alias("side"), "id", "v")
    right = other(own(r, nr, hr), nq, hq).select("class", F.col("o").alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"), "id", "v")
    tasks = 4 * queries.sparkSession.sparkContext.defaultParallelism
    tiles = left.unionByName(right).repartition(tasks, *at).sortWithinPartitions(*at)
    found = tiles.mapInArrow(each_run(_best(k), at, ["q_id", "r_id", "score"]), "q_id long, r_id long, score double")
    order = W.partitionBy("q_id").orderBy(F.desc("score"), "r_id")
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "r_id", "score", "rank")


def fuzzy_match(queries: DataFrame, entries: DataFrame, least: float = 0.55, least_reading: float = 0.25, block: int = 1000) -> DataFrame:
    """Best dictionary entry (entry) for each query (q_id, name, confidence): q_id, entry, score, confidence, status.

    The score is 1 where one name holds the other, else the edit ratio; of equal ones the first entry by name. Status
    is low_reading under least_reading of the query's confidence, low_match under `least` of the score, else ok; the
    confidence blends both where it is ok and is their product elsewhere. Every query meets every entry: entries come
    in blocks of `block`, sent along where they are few, so no pair is lost and none is a row. A query without letters
    and digits has no row, one that nothing resembles (score 0) no entry; a null confidence counts as 0.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    b = entries.select("entry", plain(F.col("entry")).alias("e")).where("e <> ''").distinct()
    blocks = max(1, -(-b.count() // block))
    known = b.groupBy(F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("entry", "e")).alias("known"))
    a = queries.select("q_id", plain(F.col("name")).alias("q"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c")).where("q <> ''")
    dealt = a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.join(known.hint("broadcast" if blocks <= 20 else "shuffle_merge"), "block")

    def scored(x):
        ratio = 1 - F.levenshtein(F.col("q"), x["e"]) / F.greatest(F.length("q"), F.length(x["e"]))
        score = F.when(F.contains(F.col("q"), x["e"]) | F.contains(x["e"], F.col("q")), F.lit(1.0)).otherwise(ratio)
        return F.struct((-F.round(score, 9)).alias("s"), x["entry"].alias("entry"))

    best = pairs.select("q_id", "c", F.array_min(F.transform("known", scored)).alias("m")).groupBy("q_id").agg(F.first("c").alias("c"), F.min("m").alias("m"))
    score = -F.col("m.s")
    status = F.when(F.col("c") < least_reading, "low_reading").when(score < least, "low_match").otherwise("ok")
    blend = F.when(status == "ok", 0.55 * F.col("c") + 0.45 * score).otherwise(F.col("c") * score)
    return best.select("q_id", F.when(score > 0, F.col("m.entry")).alias("entry"), score.alias("score"), blend.alias("confidence"), status.alias("status"))


def apply_labels(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """frames (frame, slot, side) with `label`: the digits of the last label (frame, key, value, seq) for their slot, else for their side."""
    digits = F.regexp_replace(F.col("value").cast("string"), "[^0-9]", "")
    last = labels.select("frame", "key", digits.alias("digits"), "seq").where("digits <> '' and key <> ''").groupBy("frame", "key").agg(F.max_by("digits", "seq").alias("digits"))
    by = lambda name: last.select("frame", F.col("key").alias(name), F.col("digits").alias(f"_{name}")).hint("shuffle_merge")
    out = frames.join(by("slot"), ["frame", "slot"], "left").join(by("side"), ["frame", "side"], "left")
    return out.withColumn("label", F.coalesce("_slot", "_side")).select(*frames.columns, "label")


def exact_duplicates(df: DataFrame, key, order: str) -> DataFrame:
    """First row by `order` of every key, with the number of rows that share it."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("rows"))


def _dealt(rows: DataFrame, side: str) -> DataFrame:
    """rows with their block (k_<side>) among the blocks (n_<side>) of their group, of about TILE rows each."""
    sizes = settle(rows.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n")))
    how = "broadcast" if sizes.count() <= 100_000 else "shuffle_merge"
    return rows.select("grp", "id", "h").join(sizes.hint(how), "grp").withColumns({f"n_{side}": F.col("n"), f"k_{side}": F.pmod(F.xxhash64("h"), F.col("n")).cast("int")}).drop("n")


def _tiles(left: DataFrame, right: DataFrame, decide, names: list[str], shape: str) -> DataFrame:
    """What `decide` says of every tile: a block (i, side 0) of left beside one (j, side 1) of right, both with grp, i, j, id, h."""
    at = ["grp", "i", "j"]
    rows = left.select(*at, F.lit(0).alias("side"), "id", "h").unionByName(right.select(*at, F.lit(1).alias("side"), "id", "h"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, *at).sortWithinPartitions(*at).mapInArrow(each_run(decide, at, names), shape)


def _sides(table):
    """Ids and hashes of both sides of a tile; those of the second by id."""
    side, ids, h = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "id", "h"))
    h = h.astype(np.int64).view(np.uint64)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b[np.argsort(ids[b], kind="stable")]
    return ids[a], h[a], ids[b], h[b]


def _near(most: int):
    """Of a tile its pairs within `most` bits, the smaller id first, some rows at a time."""

    def decide(table):
        import pyarrow as pa

        ida, ha, idb, hb = _sides(table)
        same, kind = table.column("i")[0] == table.column("j")[0], table.schema.field("id").type
        for s in range(0, len(ha), STRIPE):
            d = np.bitwise_count(ha[s : s + STRIPE, None] ^ hb[None, :])
            p, q = np.nonzero(d <= most)
            x, y, d = ida[s + p], idb[q], d[p, q]
            if same:
                keep = x < y
                x, y, d = x[keep], y[keep], d[keep]
            if len(x):
                yield pa.table([pa.repeat(table.column("grp")[0], len(x)), pa.array(np.minimum(x, y), kind), pa.array(np.maximum(x, y), kind), pa.array(d, pa.int32())], ["grp", "a", "b", "distance"])

    return decide


def _first(most: int):
    """Of a tile the smallest id of the second side within `most` bits of each row of the first that has one."""

    def decide(table):
        import pyarrow as pa

        ida, ha, idb, hb = _sides(table)
        kind = table.schema.field("id").type
        for s in range(0, len(ha) if len(hb) else 0, STRIPE):
            near = np.bitwise_count(ha[s : s + STRIPE, None] ^ hb[None, :]) <= most
            at = near.argmax(axis=1)
            p = np.flatnonzero(near[np.arange(len(at)), at])
            if len(p):
                yield pa.table([pa.array(ida[s + p], kind), pa.array(idb[at[p]], kind)], ["id", "rep"])

    return decide


def hash_pairs(hashes: DataFrame, most: int = 8) -> DataFrame:
    """Pairs (grp, a, b, distance) of distinct hashes of a group at most `most` bits apart, exactly; equal hashes count once.

    Every two hashes of a group are compared: its hashes are dealt to blocks of about TILE, two blocks meet in one tile,
    and a tile compares in arrays some rows at a time. So a task's memory is bounded however alike the hashes are, and no
    bits have to be even; comparisons grow with the square of a group (about 3 ns each). hashes: grp, id, h.
    """
    once = settle(hashes.groupBy("grp", "h").agg(F.min("id").alias("id")))
    rows, kind = _dealt(once, "l"), dict(once.dtypes)
    left = rows.select("grp", F.col("k_l").alias("i"), F.explode(F.sequence("k_l", F.col("n_l") - 1)).alias("j"), "id", "h")
    right = rows.select("grp", F.explode(F.sequence(F.lit(0), "k_l")).alias("i"), F.col("k_l").alias("j"), "id", "h")
    return _tiles(left, right, _near(most), ["grp", "a", "b", "distance"], f"grp {kind['grp']}, a {kind['id']}, b {kind['id']}, distance int")


def first_near(hashes: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """Each row (grp, id, h) that lies within `most` bits of a known one of its group, with the smallest such id: id, rep."""
    a, b, kind = _dealt(hashes, "l"), _dealt(known, "r"), dict(hashes.dtypes)["id"]
    blocks = lambda df, n: df.groupBy("grp").agg(F.first(n).alias(n))
    few = lambda df, of, n: df.join(blocks(of, n).hint("broadcast" if df.select("grp").distinct().count() <= 100_000 else "shuffle_merge"), "grp")
    left = few(a, b, "n_r").select("grp", F.col("k_l").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)).alias("j"), "id", "h")
    right = few(b, a, "n_l").select("grp", F.explode(F.sequence(F.lit(0), F.col("n_l") - 1)).alias("i"), F.col("k_r").alias("j"), "id", "h")
    return _tiles(left, right, _first(most), ["id", "rep"], f"id {kind}, rep {kind}").groupBy("id").agg(F.min("rep").alias("rep"))
