"""Language identification: held-out accuracy, the posterior against brute force, odd rows."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from evtrace.llm import language, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def labelled(docs):
    return docs.select("text", F.col("lang").alias("label"))


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = language.of_documents(docs).toPandas()
    assert (told.language == told.lang).mean() > 0.95 and not told.rejected.any()
    # fitted on half of the rows, scored on the others by text alone
    rest = language.identify(docs.where("doc_id % 2 = 1"), labelled(docs.where("doc_id % 2 = 0"))).toPandas()
    assert (rest.language == rest.lang).mean() > 0.93


def test_pages_by_text_markup_suffix_and_host(spark):
    got = queries.op10_language(spark, SF).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    truth = pages.set_index("page_id").url.str.extract(r"/(en|fr|de|es)/")[0]
    assert len(got) == len(pages) and (got.language.loc[truth.index] == truth).mean() > 0.97


def test_posterior_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    rows = [(i, r["text"], [None, "fr", "en", "xx"][i % 4], ["http://a.example.fr/x", "https://b.example.com", "http://a.example.fr/y", None, "c.de"][i % 5]) for i, r in enumerate(docs.collect())] + [(900, "12 ...", "en", "c.de"), (901, None, "fr", None)]
    df = spark.createDataFrame(rows, "id long, text string, said string, url string")
    names, table = language.fit(labelled(docs))
    got = {r["id"]: r for r in language.identify(df, labelled(docs), F.col("said"), F.col("url")).collect()}

    def host(url):
        return re.sub(r"^https?://", "", url or "").split("/")[0]

    def suffix(url):
        return host(url).rsplit(".", 1)[1] if "." in host(url) else ""

    likely = {i: language.log_likelihoods(table, t) for i, t, *_ in rows if t and re.search("[a-zA-Z]", t)}
    guess = {i: names[int(np.argmax(v))] for i, v in likely.items()}
    by = {r[0]: r for r in rows}
    count = lambda l, of: sum(guess[i] == l and of(by[i]) for i in guess)
    for i, v in likely.items():
        _, _, said, url = by[i]
        joint = []
        for k, l in enumerate(names):
            base = (count(l, lambda r: True) + 1) / (len(guess) + len(names))
            p = base
            for same in (lambda r: suffix(r[3]) == suffix(url), lambda r: host(r[3]) == host(url)):
                p = (count(l, same) + language.SMOOTH * p) / (sum(same(by[j]) for j in guess) + language.SMOOTH)
            w = math.log((count(l, lambda r: r[2] == said) + 0.5) / (count(l, lambda r: True) + 0.5 * (len(names) + 1))) if said else 0.0
            joint.append(v[k] + math.log(p) + w)
        best = max(joint)
        assert got[i]["language"] == names[joint.index(best)]
        assert abs(got[i]["posterior"] - 1 / sum(math.exp(x - best) for x in joint)) < 1e-9
    assert all(got[i]["rejected"] and got[i]["language"] is None and got[i]["posterior"] == 0 for i in (900, 901))


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    long = docs.first()["text"] * 3000
    odd = [(-1, None, "en", "s"), (-2, "12 34", None, None), (-3, "", "xx", ""), (-4, long, None, None), (-4, long, None, None), (-5, "\u4e00 \u4e8c", None, "S")]
    rows = docs.unionByName(spark.createDataFrame(odd, DOCS))
    clash = rows.withColumns({c: F.lit("mine") for c in ("language", "_known", "_said", "_host", "_told", "__x", "label", "l", "n0", "known", "said", "host")})
    out = language.of_documents(clash).where("doc_id < 0").collect()
    assert set(out[0].asDict()) == set(clash.columns) | {"posterior", "rejected"} and all(r["_known"] == r["__x"] == r["host"] == "mine" for r in out)
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 6 and all(by[i]["rejected"] and by[i]["language"] is None and by[i]["posterior"] == 0 for i in (-1, -2, -3)) and by[-4]["language"] == docs.first()["lang"]
    none = spark.createDataFrame([], DOCS)
    assert language.of_documents(none).count() == 0
    unlabelled = language.identify(docs, labelled(none)).collect()
    assert len(unlabelled) == docs.count() and all(r["rejected"] for r in unlabelled)


def test_each_label_has_its_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    docs = spark.createDataFrame([(i, f"the word {i} of many", "en", "s") for i in range(400)] + [(1000 + i, f"le mot {i} parmi tant", "fr", "s") for i in range(3)], DOCS)
    names, table = language.fit(labelled(docs))
    assert names == ["en", "fr"] and table.shape == (2, 1 << language.BITS)


def test_many_labels_and_hosts(spark, monkeypatch):
    # 600 languages of a word each; hosts of one in three rows and rare ones; the least frequent labels are unknown
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 30, f"l{i:04d}", f"http://h{i % 3}.example/") for i in range(600)] + [(i, "zq " * 9, "rest", f"http://x{i}.example/") for i in range(600, 640)]
    docs = spark.createDataFrame(rows, "id long, text string, label string, url string")
    monkeypatch.setattr(language, "HOT", 20)
    got = {r["id"]: r["language"] for r in language.identify(docs, docs.select("text", "label"), None, F.col("url")).collect()}
    assert len(got) == 640 and sum(got[i] == label for i, _, label, _ in rows) >= 630
    monkeypatch.setattr(language, "LABELS", 5)
    names, table = language.fit(docs.select("text", "label"))
    assert names == ["l0000", "l0001", "l0002", "l0003", "rest"] and len(table) == 5


def test_hosts_and_suffixes(spark):
    url = spark.createDataFrame([("http://u@www.Example.FR:80/x",), ("src0",), ("",), (None,)], "u string").select(language.host_of(F.col("u")).alias("h"), language.suffix_of(language.host_of(F.col("u"))).alias("s")).collect()
    assert [tuple(r) for r in url] == [("www.example.fr", "fr"), ("src0", None), (None, None), (None, None)]
