"""The pipeline stage by stage against plain versions on what the stage before it left, and on odd tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from evtrace.llm import language, near_dedup, packing, personal, queries

SF = "/root/testdata/sf0.001"
STAGES = dict(p.STAGES)


def sql(docs, text):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(text).df()


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """What every stage gives, written and read again."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_five_stages_in_their_order():
    assert [n for n, _ in p.STAGES] == ["language", "line dedup", "near dedup", "personal data", "packing"]


def test_columns_and_counts_stay_true(runs):
    given = runs[0]
    for docs in runs[1:5]:
        assert docs.columns == given.columns and [t for _, t in docs.dtypes] == [t for _, t in given.dtypes]
        assert docs.where("n_chars <> length(text)").count() == 0


def test_language_stage(runs):
    told = language.of_documents(runs[0]).where("not rejected").toPandas().set_index("doc_id")
    got = runs[1].toPandas().set_index("doc_id")
    assert got.lang.sort_index().tolist() == told.language.sort_index().tolist() and got.text.sort_index().tolist() == told.text.sort_index().tolist()


def test_line_stage_equals_its_sql(runs):
    want = sql(runs[1].select("doc_id", "text").toPandas(), queries.oracle_sql()["op9_line_dedup"])
    got = runs[2].toPandas()
    assert Counter(zip(got.doc_id, got.text)) == Counter(zip(want.doc_id, want.text))


def test_near_stage_equals_all_pairs(runs):
    five = queries.OP2.replace("w[i : i + 3]", "w[i : i + 4]").replace("len(w) - 3", "len(w) - 4")
    kept = sql(runs[2].select("doc_id", "text").toPandas(), five)
    assert sorted(kept[kept.kept].doc_id) == sorted(r["doc_id"] for r in runs[3].select("doc_id").collect())


def test_personal_stage_masks_every_span(runs):
    field = personal.fit_on(runs[3].select("text"))
    got = {r["doc_id"]: r["text"] for r in runs[4].collect()}
    for r in runs[3].collect():
        text, at, out = r["text"], 0, []
        for k, a, b in sorted(personal.all_spans(text, field)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert got[r["doc_id"]] == "".join(out) + text[at:]


def test_packing_stage_and_run(spark, runs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.packing_tokenizer()[1])
    packed = runs[5].toPandas()
    for r in runs[4].collect():
        ids = np.array([*lib.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        own = packed[packed.doc_id == r["doc_id"]].sort_values("piece")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist() and own.length.sum() == len(ids)
    for _, seq in packed.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048
    again = p.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again[key].to_numpy().tolist())) == sorted(map(tuple, packed[key].to_numpy().tolist()))


ODD = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n ", None, "s", 3), (4, "the same words stand here twice and more", None, None, None), (4, "the same words stand here twice and more", None, None, None), (None, "words without an id stand here as well", "en", "s", 9), (5, "the end of the tale of the old house " * 9000, "xx", "s", 1), (6, "12 34", "en", "s", 5), (7, "call +1 (212) 555-0147 now or write to the house", "en", "s", 5)]


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_tables(spark, name):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = given.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long"))
    clash = odd.withColumns({c: F.lit(1) for c in ("language", "gone", "key", "root", "spans", "salt", "template", "_told", "kept")})
    out = STAGES[name](spark, clash, SF)
    assert name == "packing" or out.columns == clash.columns
    texts = Counter((r["doc_id"], r["text"]) for r in out.where("doc_id is null or doc_id < 8").collect()) if name != "packing" else None
    mine = Counter((i, t) for i, t, *_ in ODD)
    if name == "language":
        assert {i for i, t in texts if (i, t) in mine} <= {4, None, 5, 7} and texts[4, ODD[3][1]] == 2
    elif name == "line dedup":
        assert sum(texts[x] for x in mine) >= 8 and texts[1, None] == texts[2, ""] == 1
    elif name == "near dedup":
        assert all(texts[x] == n for x, n in mine.items())
    elif name == "personal data":
        assert texts[7, "call [PHONE] now or write to the house"] == 1 and texts[1, None] == 1
    else:
        assert out.where("doc_id in (1, 2) and piece = 0 and length = 1").count() == 2  # the null and the empty text
        assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 4 and piece = 0").count() == 1 + 2
    assert STAGES[name](spark, clash.where("false"), SF).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """No text step holds a whole partition (here 13 MB) in one batch, and the session's setting stays as it was."""

    def watched(make):
        def made(*args):
            run = make(*args)

            def checked(batches):
                def each():
                    for b in batches:
                        if b.nbytes > 5_000_000:
                            raise ValueError(f"a batch of {b.nbytes} bytes")
                        yield b

                yield from run(each())

            return checked

        return made

    for module, names in ((language, ["_score"]), (near_dedup, ["_signatures", "_confirm"]), (personal, ["_mask"]), (packing, ["_pieces"])):
        for name in names:
            monkeypatch.setattr(module, name, watched(getattr(module, name)))
    # pairs of near copies, no two of which share a line
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.translate(F.xxhash64(F.floor(F.col("id") / 2), i).cast("string"), "-0123456789", "abcdefghijk")), F.col("id").cast("string"))
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    counts = {stage: STAGES[stage](spark, docs, SF).count() for stage in ("language", "near dedup", "personal data")}
    assert counts == {"language": 400, "near dedup": 200, "personal data": 400}
    assert STAGES["packing"](spark, docs, SF).select("doc_id").distinct().count() == 400
    assert spark.conf.get(name) == before


def test_packing_plan_needs_no_python_workers(spark):
    from pyspark.sql import types as T

    got = packing._slots(spark, [(3, 0, 2, 0, 1, 0)])
    assert [(f.name, f.dataType) for f in got.schema] == [(n, T.LongType()) for n in ("length", "lo", "hi", "sequence", "per", "used")]
    assert [tuple(r) for r in got.collect()] == [(3, 0, 2, 0, 1, 0)] and packing._slots(spark, []).count() == 0
    assert "PythonRDD" not in got._jdf.toJavaRDD().toDebugString()
