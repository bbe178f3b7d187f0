"""Language identification by Bayesian fusion of evidence.

Four sources speak about a document's language: its text (naive Bayes over hashed byte trigrams, fitted on labelled
rows, of each language at most SAMPLE, the least by hash), the language its markup declares, the suffix of its
address (com, fr, de ...), and its host. What a declaration or suffix is worth is measured on all rows: a grouped
aggregation counts how often each goes with each language the text alone points to. The host's prior is smoothed
hierarchically: host counts over suffix counts over global counts. The log posterior is the sum; a document is
rejected where its text has no letters or no language reaches `least`.

Whole texts are read, in fitting too; a text is scored once, and the scored table is written out before its groups
are counted. The classifier knows the LABELS most frequent labels (of equals the first by name), so what passes through
the driver is bounded: a row of trigrams and one of counts for each of them. Counts by language are rows and arrays,
never columns. Pairs of declaration and host that are one in HOT rows come to the rows by broadcast, others by a shuffle.

Defined results: a null or letterless text is rejected, with the language null and posterior 0; a null or unknown
declaration or address adds nothing; ties go to the alphabetically first language; repeated rows and rows that share
an id count each; very long texts are scored piece by piece; with no labelled rows every document is rejected; an
empty table gives no rows. All columns of the input stay, whatever their names; the added ones are those in ADDED
and take the place of columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .common import settle, settle_texts

LABELS = 1024  # languages that are told apart, at most
HOT = 1000  # a pair of declaration and host that is broadcast is one in so many rows, at least
SAMPLE = 1000  # labelled rows of each language that the text model is fitted on
BITS = 15
TRUST = 0.25  # each byte trigram counts for so much: neighbours overlap
SMOOTH = 20.0  # rows that a prior counts as
LEAST = 0.6
ADDED = ("language", "posterior", "rejected")


def _codes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def _bytes(text: str | None) -> bytes:
    return f" {(text or '').lower()} ".encode()


def _trigrams(batches):
    """How often each hashed trigram stands in the texts of each label, batch by batch."""
    import pyarrow as pa

    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        for text, label in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
            c = counts.setdefault(label, np.zeros(1 << BITS, np.int64))
            c += np.bincount(_codes(_bytes(text)), minlength=1 << BITS)
        labels, codes, n = [], [], []
        for label, c in counts.items():
            own = np.flatnonzero(c)
            labels += [label] * len(own)
            codes.append(own)
            n.append(c[own])
        whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), whole(codes), whole(n)], ["l", "code", "n"])


def _fitted(table):
    """One label's counts as log likelihoods of all trigrams."""
    import pyarrow as pa

    counts = np.zeros(1 << BITS)
    np.add.at(counts, table.column("code").to_numpy(), table.column("n").to_numpy())
    told = np.log((counts + 0.1) / (counts.sum() + 0.1 * (1 << BITS))).astype(np.float32)
    return pa.table([pa.array([table.column("l")[0].as_py()]), pa.array([told.tobytes()], pa.binary())], ["l", "told"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log likelihoods of trigrams (a row per language), from labelled rows (text, label).

    At most LABELS languages, of each at most SAMPLE distinct rows.
    """
    labelled = docs.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("text").alias("t"), F.lower("label").alias("l"))
    known = labelled.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(LABELS).select("l")
    hashed = labelled.withColumn("h", F.xxhash64("t", "l"))
    ranked = hashed.select("l", "h").distinct().join(F.broadcast(known), "l").withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h"))).where(F.col("r") <= SAMPLE)
    last = settle(ranked.groupBy("l").agg(F.max("h").alias("last")))  # a row per language
    chosen = hashed.join(F.broadcast(last), "l").where(F.col("h") <= F.col("last")).dropDuplicates(["l", "h"]).select("t", "l")
    rows = chosen.mapInArrow(_trigrams, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n"))
    fitted = sorted((r["l"], r["told"]) for r in rows.groupBy("l").applyInArrow(_fitted, "l string, told binary").collect())
    table = [np.frombuffer(told, np.float32) for _, told in fitted]
    return [name for name, _ in fitted], np.stack(table) if table else np.zeros((0, 1 << BITS), np.float32)


def log_likelihoods(table: np.ndarray, text: str) -> np.ndarray:
    """Of a whole text under each language."""
    raw, total = _bytes(text), np.zeros(len(table))
    for at in range(0, len(raw) - 2, 1 << 16):
        total += table[:, _codes(raw[at : at + (1 << 16) + 2])].sum(axis=1, dtype=np.float64)
    return total * TRUST


def _score(table: np.ndarray, text: str, told: str):
    """Puts the log likelihoods of column text into column told; null for a text without letters."""

    def run(batches):
        import re

        import pyarrow as pa

        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            out = [log_likelihoods(table, t).tolist() if t and letter.search(t) else None for t in batch.column(text).to_pylist()]
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(out, pa.list_(pa.float64()))], [*kept, told])

    return run


def host_of(address):
    """Host of an address, null if there is none."""
    rest = F.regexp_extract(address.cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(rest != "", F.lower(rest))


def suffix_of(host):
    """Last label of a host that has several."""
    last = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(last != "", last)


def declared_in(html):
    """Language that a page's markup declares: the lang attribute of its html tag."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(found != "", found)


def _evidence(counted: DataFrame, n: int) -> DataFrame:
    """said, host, rows and known, from counts (said, host, suffix, l, n), l being a language's place among n: for each
    language the log of its prior at the host times what the declaration is worth."""
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def counts(*keys: str) -> DataFrame:
        """keys and c, an array of the languages' counts."""
        each = counted.groupBy(*keys, "l").agg(F.sum("n").alias("n"))
        found = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("m"))
        return found.select(*keys, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("c"))

    seen = {r["l"]: r["n"] for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # a row per language
    overall = [seen.get(i, 0) for i in range(n)]
    base = F.lit([(c + 1) / (sum(overall) + n) for c in overall])
    every = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    smoothed = lambda prior: F.zip_with("c", prior, lambda c, p: (c + SMOOTH * p) / (F.col("_every") + SMOOTH))
    suffixes = counts("suffix").withColumn("_every", every).select("suffix", smoothed(base).alias("by_suffix"))
    hosts = counts("host", "suffix").withColumn("_every", every).join(suffixes.hint("shuffle_merge"), "suffix").select("host", smoothed(F.col("by_suffix")).alias("by_host"))
    # P(said | language); saying nothing is no evidence
    among = F.lit([c + 0.5 * (n + 1) for c in overall])
    worth = F.zip_with("c", among, lambda c, a: F.when(F.col("said") == "", 0.0).otherwise(F.log((c + 0.5) / a)))
    said = counts("said").select("said", worth.alias("by_said"))
    pairs = counted.groupBy("said", "host").agg(F.sum("n").alias("rows"))
    joined = pairs.join(said.hint("shuffle_merge"), "said").join(hosts.hint("shuffle_merge"), "host")
    return joined.select("said", "host", "rows", F.zip_with("by_host", "by_said", lambda p, w: F.log(p) + w).alias("known"))


def identify(docs: DataFrame, labelled: DataFrame, declared=None, address=None, text=None, least: float = LEAST, drop: str | None = None) -> DataFrame:
    """docs with language, posterior and rejected.

    labelled (text, label) has the rows that the text model may be fitted on; declared and address are columns of
    docs (or None), the declared language and the address or host; text is the text's column; drop is a column
    that may serve as evidence and is not returned.
    """
    docs = docs.drop(*ADDED)
    own = [c for c in docs.columns if c != drop]
    mark = "_"
    while any(c.lower().startswith(mark) for c in own):  # names of ours that no column has
        mark += "_"
    said, host, suffix, told, known, joint, read, hot, lone = (mark + x for x in ("said", "host", "suffix", "told", "known", "joint", "read", "hot", "lone"))
    string = lambda c: (F.lit(None) if c is None else c).cast("string")
    names, table = fit(labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label")))
    if not names:
        return docs.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(0.0), "rejected": F.lit(True)})
    at = F.coalesce(host_of(string(address)), F.lit(""))
    facts = docs.withColumns({said: F.coalesce(F.lower(string(declared)), F.lit("")), host: at, suffix: F.coalesce(suffix_of(at), F.lit("")), read: string(F.col("text") if text is None else text)})
    facts = facts.drop(drop) if drop else facts
    shape = T.StructType([f for f in facts.schema if f.name != read] + [T.StructField(told, T.ArrayType(T.DoubleType()))])
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int")
    scored = settle_texts(facts.mapInArrow(_score(table, read, told), shape))
    guess = scored.where(F.col(told).isNotNull()).select(F.col(said).alias("said"), F.col(host).alias("host"), F.col(suffix).alias("suffix"), (best(F.col(told)) - 1).alias("l"))
    counted = settle(guess.groupBy("said", "host", "suffix", "l").agg(F.count("*").alias("n")))
    evidence = settle(_evidence(counted, len(names)).select(F.col("said").alias(said), F.col("host").alias(host), "rows", F.col("known").alias(known)))
    often = F.col("rows") * HOT >= (counted.agg(F.sum("n")).first()[0] or 0)
    fused = scored.join(F.broadcast(evidence.where(often).select(said, host, F.col(known).alias(hot))), [said, host], "left")
    # rows already served, or in need of nothing, get hosts that nothing has, so that they do not meet in one task
    apart = [F.col(f"`{f.name}`") for f in docs.schema if f.name != drop and isinstance(f.dataType, (T.NumericType, T.StringType))]
    alone = F.concat(F.lit("\0"), F.xxhash64(F.col(told), *apart).cast("string"))
    fused = fused.withColumn(lone, F.when(F.col(told).isNotNull() & F.col(hot).isNull(), F.col(host)).otherwise(alone))
    rare = evidence.where(~often).select(said, F.col(host).alias(lone), known)
    fused = fused.join(rare.hint("shuffle_merge"), [said, lone], "left").withColumn(known, F.coalesce(hot, known))
    fused = fused.withColumn(joint, F.when(F.col(known).isNull(), F.col(told)).otherwise(F.zip_with(told, known, lambda a, b: a + b)))
    top = F.array_max(joint)
    weight = F.aggregate(joint, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    posterior = F.coalesce(1 / weight, F.lit(0.0))
    return fused.select(*[F.col(f"`{c}`") for c in own], F.when(F.col(joint).isNotNull(), F.element_at(F.lit(names), best(F.col(joint)))).alias("language"), posterior.alias("posterior"), (posterior < least).alias("rejected"))


def of_documents(docs: DataFrame) -> DataFrame:
    """identify() over documents: the model is fitted on their own labels (lang), which are no evidence besides; source is the host."""
    return identify(docs, docs.select("text", F.col("lang").alias("label")), None, F.col("source"))


#: What a browser would not show of a page: raw elements, then tags.
_RAW, _TAGS = r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<[^>]*>"


def of_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """identify() over web pages (url, html), without html: the html tag declares, the url has suffix and host, the text is the page without tags."""
    text = F.regexp_replace(F.regexp_replace("html", _RAW, " "), _TAGS, " ")
    return identify(pages, labelled, declared_in(F.col("html")), F.col("url"), text, drop="html")
