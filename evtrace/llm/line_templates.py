"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has fixed depth: a line goes by its number of tokens, then by its first LEADING tokens, with tokens that hold
digits generalised to <*>. In a node the most frequent token of each place makes the node's pattern; lines that agree
with it, in at least `agree` of their places behind the leading tokens that are not generalised and in SAME of them at
least, are one template, whose other places are variable fields. The lines left go one level down, each by the token
that most lines of the node share with it (one that not all of them have), so that every template of a leaf gets a
node of its own; there are LEVELS levels. Lines that agree nowhere keep their own masked line as template, and lines
with fewer than FIXED tokens free of digits their exact line: rows of numbers and short list items are not generalised.

A template that recurs across documents, in at least `least` of them (`least_long` for lines of LONG tokens and more:
whole passages), is dropped everywhere but in its first document by doc_id; within a document repeats stay.

Texts are not shuffled with their lines: lines travel as hashes, only nodes with several distinct lines are compared
place by place, and each document receives the numbers of its lines to drop. The most frequent templates, at most
HOT of them, are sent to the lines; only lines of the others are dealt by template, so a line that a third of all
documents have is not one task's work.

Defined results: a null text stays null, an empty one empty; blank lines and lines under `shortest` tokens are
never dropped; of documents that share a template the smallest doc_id keeps it (null ids come last), and rows
that share a doc_id and text keep or lose lines alike; equally frequent tokens: the greater one, at the first place.
Long texts take time that grows with their lines. All columns stay, whatever their names; n_lines and n_dropped are
added and take the place of columns of these names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle

LEADING, LONG = 3, 50
FIXED, SAME = 4, 3  # tokens without digits of a line that may be generalised; places behind the leading ones that must agree
LEVELS = 3
HOT, FEW = 1000, 10_000  # templates are hot from a 1/HOT share of all lines, and FEW lines, on: at most HOT are
SMALL = 100_000  # rows of places up to which they are broadcast
ANY = "<*>"


def _tokens(line) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def _masked(lines: DataFrame) -> DataFrame:
    """lines with `masked`, the tokens of column line, those with digits generalised; worked out once, whatever reads it."""
    general = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"(?<!\S)[^\s0-9]*+[0-9]\S*+", ANY)).otherwise(F.col("line"))
    return lines.withColumn("masked", F.explode(F.array(_tokens(general))))  # a filter is not pushed below this


def _votes(lines: DataFrame) -> DataFrame:
    """How many lines (n) and distinct ones (k) of each node have a token at a place behind the leading ones."""
    places = lines.select("node", "n", F.posexplode("masked").alias("place", "token")).where(F.col("place") >= LEADING)
    return places.groupBy("node", "place", "token").agg(F.sum("n").alias("n"), F.count("*").alias("k"))


def _templates(lines: DataFrame, agree: float) -> DataFrame:
    """leaf, own, general of the lines (leaf, own, n, masked) that agree with the pattern of a node."""
    rest, found = lines.withColumn("node", F.col("leaf")), None
    tail = F.slice("masked", LEADING + 1, F.size("masked"))
    free = F.size(F.filter(tail, lambda t: t != ANY))
    same = F.aggregate(F.zip_with(tail, "pattern", lambda a, b: ((a == b) & (a != ANY)).cast("int")), F.lit(0), lambda s, x: s + x)
    for level in range(LEVELS):
        usual = _votes(rest).groupBy("node", "place").agg(F.max(F.struct("n", "token")).alias("v"))
        pattern = usual.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v.token"))), lambda x: x["token"]).alias("pattern"))
        told = settle(rest.join(pattern.hint("shuffle_merge"), "node").withColumn("agrees", (same >= agree * free) & (same >= SAME)).drop("pattern"))
        own = told.where("agrees").select("leaf", "own", F.xxhash64(F.lit("pattern"), F.lit(level), "node").alias("general"))
        found = own if found is None else found.unionByName(own)
        rest = told.where("not agrees").drop("agrees")
        if level == LEVELS - 1 or rest.isEmpty():
            break
        # each line's most shared token that not all of its node have
        every = rest.groupBy("node").agg(F.count("*").alias("all"))
        shared = _votes(rest).where("k > 1").join(every.hint("shuffle_merge"), "node").where("k < all").select("node", "place", "token", F.col("n").alias("votes"))
        places = rest.select("node", "own", F.posexplode("masked").alias("place", "token")).where(F.col("place") >= LEADING)
        best = places.join(shared.hint("shuffle_hash"), ["node", "place", "token"]).groupBy("node", "own").agg(F.max(F.struct("votes", (-F.col("place")).alias("p"), "token")).alias("b"))
        rest = settle(rest.join(best.hint("shuffle_merge"), ["node", "own"]).withColumn("node", F.xxhash64("node", "b.p", "b.token")).drop("b"))
    return found


def line_templates(docs: DataFrame, shortest: int = 4, least: int = 3, least_long: int = 2, agree: float = 0.75) -> DataFrame:
    """doc_id, text_hash, line_no, n_tokens, template (a hash) of every line with enough tokens."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))
    lines = _masked(texts.select("doc_id", "text_hash", F.posexplode_outer("lines").alias("line_no", "line"))).withColumn("n_tokens", F.size("masked"))  # outer: lines are not split twice
    plain = F.when(F.col("n_tokens") >= FIXED, F.size(F.array_remove("masked", ANY)) >= FIXED).otherwise(False)
    leaf = F.when(plain, F.xxhash64(F.col("n_tokens"), F.slice("masked", 1, LEADING)))
    own = F.when(plain, F.xxhash64(F.lit("masked"), "masked")).otherwise(F.xxhash64(F.lit("exact"), _tokens("line")))
    keyed = settle(lines.where(F.col("n_tokens") >= shortest).select("doc_id", "text_hash", "line_no", "n_tokens", leaf.alias("leaf"), own.alias("own")))
    # leaves in which different lines meet, and one place of each such line; a leaf of one line is that line's template
    leafy = keyed.where("leaf is not null")
    kinds = leafy.groupBy("leaf", "own").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "line_no")).alias("at"))
    mixed = leafy.groupBy("leaf").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n"), F.max("n_tokens").alias("size"))
    mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("n") >= F.when(F.col("size") >= LONG, least_long).otherwise(least)) & (F.col("size") >= LEADING + SAME))
    chosen = settle(kinds.join(mixed.select("leaf").hint("shuffle_merge"), "leaf", "left_semi").select("leaf", "own", "n", "at.*"))
    # only documents that hold such a place are read again, and only those lines split
    places = settle(chosen.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", "leaf", "own", "n")).alias("places")))
    small = places.count() <= SMALL and chosen.count() <= 4 * SMALL
    found = texts.join(places.hint("broadcast" if small else "shuffle_hash"), (texts["doc_id"].eqNullSafe(places["doc_id"])) & (texts["text_hash"] == places["text_hash"]))
    spread = found.select("lines", F.explode("places").alias("p")).select("p.leaf", "p.own", "p.n", F.get("lines", F.col("p.line_no")).alias("line"))
    split = settle(_masked(spread).drop("line").dropDuplicates(["leaf", "own"]))
    joined = keyed.join(_templates(split, agree).hint("shuffle_hash"), ["leaf", "own"], "left")
    return joined.select("doc_id", "text_hash", "line_no", "n_tokens", F.coalesce("general", "own").alias("template"))


def drop_recurring_lines(docs: DataFrame, shortest: int = 4, least: int = 3, least_long: int = 2, agree: float = 0.75) -> DataFrame:
    """docs with recurring template lines taken out of text, and n_lines and n_dropped (of the text as it was)."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = settle(line_templates(docs, shortest, least, least_long, agree))
    per = lines.groupBy("template", "doc_id", "text_hash").agg(F.first("n_tokens").alias("n_tokens"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    spread = per.groupBy("template").agg(F.count("*").alias("n"), F.max("n_tokens").alias("size"), first.alias("f"))
    recurring = settle(spread.where(F.col("n") >= F.when(F.col("size") >= LONG, least_long).otherwise(least)).select("template", "n", "f"))
    often = F.col("n") >= max(FEW, lines.count() // HOT)
    hot, others = recurring.where(often).drop("n"), recurring.where(~often).drop("n")
    rest = lines.join(F.broadcast(hot.select("template")), "template", "left_anti").join(others.hint("shuffle_merge"), "template")
    hit = lines.join(F.broadcast(hot), "template").unionByName(rest).where(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))))
    gone = hit.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "gone")
    text = F.col("a.text").cast("string")
    out = docs.alias("a").join(gone.alias("b").hint("shuffle_hash"), F.col("a.doc_id").cast("long").eqNullSafe(F.col("b._d")) & (F.xxhash64(text) == F.col("b._h")), "left")
    # each text is split once, not once a line
    out = out.withColumn("_every", F.split(text, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_every") - 1), "b.gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_every", i)), "\n")
    cleaned = F.when(F.col("b.gone").isNull(), text).otherwise(kept)
    return out.select(*[cleaned.alias("text") if c == "text" else F.col(f"a.`{c}`").alias(c) for c in docs.columns], F.when(text.isNull(), 0).otherwise(F.size("_every")).cast("long").alias("n_lines"), F.when(F.col("b.gone").isNull(), 0).otherwise(F.size("b.gone")).cast("long").alias("n_dropped"))
