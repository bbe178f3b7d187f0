"""Document fingerprints by winnowing, in DataFrame functions only.

A text's lower-cased words, split at white space, are hashed once each; the hash of K words in a row is rolled from
them by a cyclic polynomial (rotate and exclusive or), the hashes of 2, 4, ... words from those of half as many. Of
every WINDOW gram hashes in a row the least is kept, of equal ones the rightmost, with its position (the number of the
gram's first word); window minima double in the same way. Two texts that share K + WINDOW - 1 words in a row therefore
share a fingerprint hash. A text with fewer words than a gram is one gram, one with fewer grams than a window one
window. The fingerprint is the list position:hash, comma-joined; likeness of two is the Jaccard share of their
distinct hashes.

Defined results: a null text is empty; a text without words has the empty fingerprint, and two empty ones have
likeness 1, one empty and one not 0. The next document is the next row by doc_id, then by text; after the last
comes the first, so a single row is followed by itself. Repeated rows follow each other. Rows with a null
doc_id come first. Positions beyond 2^24 words are given modulo that. Other columns, whatever their names, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, WINDOW = 4, 6
ROWS = 4000  # rows of a range of ids
RANGES = 100_000  # most ranges, whose bounds and first rows pass through the driver; beyond 400 million rows ranges grow
_PLACES = (1 << 24) - 1
STEP = 300


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _rotated(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r))


def _pairwise(first: str, second: str, step: int, many: Column, f) -> Column:
    """f of element i of first and element i + step of second, for `many` i."""
    return F.zip_with(F.slice(first, F.lit(1), many), F.slice(second, F.lit(step + 1), many), f)


def _doubled(df: DataFrame, start: str, size: Column, length: int, f) -> DataFrame:
    """df with `_run<length>`: f over runs of `length` elements of column start (size of them), for each place where one fits; f(a, b, m) joins a run and one of m elements behind it."""
    whole = lambda m: F.greatest(size - (m - 1), F.lit(0))  # noqa: E731  runs of m elements
    name = lambda m: start if m == 1 else f"_run{m}"
    made = {1}

    def make(df, m):
        if m in made:
            return df
        half = 1 << ((m - 1).bit_length() - 1)  # the greatest power of two below m
        df = make(make(df, half), m - half)
        made.add(m)
        # one projection each, so that an array is computed once and not once per element that reads it
        return df.withColumn(name(m), _pairwise(name(half), name(m - half), half, whole(m), lambda a, b: f(a, b, m - half)))

    return make(df, length)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`: what the windows select of the column text, each once, in order.

    A selected gram is 39 bits of its hash, then 24 bits that fall as its position (modulo 2^24) rises.
    """
    own = df.columns
    none = F.array().cast("array<long>")
    n = F.size("_h")
    step = df.withColumn("_words", _words(F.col(text))).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    step = _doubled(step, "_h", n, K, lambda a, b, m: _rotated(a, m).bitwiseXOR(b))
    short = F.when(n == 0, none).otherwise(F.array(F.aggregate("_h", F.lit(0).cast("long"), lambda a, x: _rotated(a, 1).bitwiseXOR(x))))
    marked = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 25), 24).bitwiseOR((F.lit(_PLACES) - i % (_PLACES + 1)).cast("long"))
    step = step.select(*own, F.when(n < K, short).otherwise(F.col(f"_run{K}")).alias("_g")).withColumn("_grams", F.transform("_g", marked)).drop("_g")
    m = F.size("_grams")
    step = _doubled(step, "_grams", m, WINDOW, lambda a, b, _: F.least(a, b))
    few = F.when(m == 0, none).otherwise(F.array(F.array_min("_grams")))
    return step.select(*own, F.array_distinct(F.when(m < WINDOW, few).otherwise(F.col(f"_run{WINDOW}"))).alias(name))


def written(picked: Column) -> Column:
    place = lambda x: F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES).cast("long"))
    return F.array_join(F.transform(picked, lambda x: F.concat(place(x).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(x, 24))))), ",")


def likeness(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.transform(c, lambda v: F.shiftright(v, 24))) for c in (a, b))
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _range_of(id: Column, h: Column, cuts: list[int], nulls: int) -> Column:
    """Number of the range of a row: ranges of ids end at the sorted cuts; ids that hold several cuts, and null ones, are split by hash."""
    apart = 4 * RANGES
    share = lambda many: F.floor((h / 2.0**64 + 0.5) * many)  # noqa: E731  of a hash, in its order
    none = share(F.lit(max(1, min(RANGES, nulls // ROWS)))) - apart
    if not cuts:
        return F.when(id.isNull(), none).otherwise(F.lit(0)).cast("long")
    single = sorted(set(cuts))
    below = lambda some: F.size(F.filter(some, lambda c: c < id))
    coarse = below(F.lit(single[::STEP]))
    start = F.greatest(coarse - 1, F.lit(0)) * STEP
    at = (start + below(F.slice(F.lit(single), start + 1, STEP))).cast("long") * apart
    heavy = {c: n for c, n in Counter(cuts).items() if n > 1}
    if heavy:
        many = F.element_at(F.create_map(*[F.lit(x) for c, n in heavy.items() for x in (c, n)]), id)
        at = at + F.when(many.isNotNull(), F.least(share(many), many - 1) + 1).otherwise(0)
    return F.when(id.isNull(), none).otherwise(at).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text, own with next_text and next_own: those of the next row by doc_id; own is the fingerprint.

    Rows go to ranges of ids, and the first row of each range also to the range before it (of the first range
    to the last), so each text is shuffled once and every range finds its own followers.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stats = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    many = max(1, min(RANGES, stats["n"] // ROWS))
    cuts = rows.select("doc_id").where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 10 * many).alias("c")).first()["c"] if many > 1 and stats["ids"] else []
    at = _range_of(F.col("doc_id"), F.xxhash64("text"), sorted(cuts), stats["n"] - stats["ids"])
    ranged = rows.withColumn("range", at)
    firsts = {r["range"]: r["k"] for r in ranged.groupBy("range").agg(F.min(key).alias("k")).collect()}  # a row per range
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    if not order:
        return with_fingerprint(rows, "text", "own").withColumns({"next_text": F.lit(""), "next_own": F.col("own")})
    table = docs.sparkSession.createDataFrame([(r, k["doc_id"], k["h"], before[r], r == order[0]) for r, k in firsts.items()], "range long, f_id long, f_h long, before long, wraps boolean")
    marked = ranged.join(F.broadcast(table), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.xxhash64("text") == F.col("f_h"))
    here, guest = F.struct(F.col("range").alias("r"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("r"), F.lit(True).alias("guest"))
    dealt = with_fingerprint(marked.withColumn("places", F.when(is_first, F.array(here, guest)).otherwise(F.array(here))).select("doc_id", "text", "places"), "text", "own")
    dealt = dealt.select("doc_id", "text", "own", F.explode("places").alias("p")).select("doc_id", "text", "own", "p.*")
    w = W.partitionBy("r").orderBy("guest", "doc_id", F.xxhash64("text"))
    followed = dealt.withColumns({"next_text": F.lead("text").over(w), "next_own": F.lead("own").over(w)})
    return followed.where(~F.col("guest")).select("doc_id", "text", "own", "next_text", "next_own")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as many code points from the start of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "changed")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
