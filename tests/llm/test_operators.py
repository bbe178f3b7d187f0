"""Each operator against a brute-force version or an exact round trip, and on null, empty, tied and repeated rows."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtrace.llm import bpe, chat, fingerprints, html_text, language, line_templates, near_dedup, packing, personal, queries, top_k
from evtrace.llm.common import components

from ..compare import connect, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "word two"), (5, "é\U0001f600 x"), (6, "a b c d e f g h " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), connect(SF).sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_top_k_odd_rows(spark):
    v = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [9.0]), (None, [5.0, 5.0])]
    got = top_k.search(top_k.quantised(spark.createDataFrame(v, "vec_id long, embedding array<float>")), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(8, 9 * 1024 * 1024), (1, 5 * 1024 * 1024), (2, 5 * 1024 * 1024)]
    assert top_k.search(top_k.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")), F.lit(True)).count() == 0


def test_top_k_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(c, 0.05, (120, 8)) for c in rng.normal(0, 3, (6, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = top_k.search(top_k.quantised(df), F.col("vec_id") % 100 == 0, 4).toPandas()
    q = np.floor(m * 1024).astype(np.int64)
    for i in range(0, len(q), 100):
        want = sorted((-int(q[i] @ q[j]), j) for j in range(len(q)) if j != i)[:4]
        part = got[got.query_id == i].sort_values("rank")
        assert list(zip((-part.score).tolist(), part.vec_id.tolist())) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    best = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    assert got == best
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd, 4, 80).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (6, 8, 6, True), (5, 1, 5, True)} <= got
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_first(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, "z")], DOCS)
    assert Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(twice).collect()) == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1), (None, None)])
    docs = spark.createDataFrame([(i, f"{'one two three four five six seven eight nine ten ' * 3}{i % 2} eleven " + " ".join(f"w{k}" for k in range(60 + i % 2)), "x") for i in range(80)], "doc_id long, text string, n string")
    assert near_dedup.keep_first(docs).columns == docs.columns and near_dedup.keep_first(docs).count() == 1


def test_near_duplicates_link_a_star(spark):
    # copies at 0.82 of one base and about 0.69 of each other: every link goes through the base
    rng = random.Random(6)
    base = [f"b{k}" for k in range(1000)]
    texts = [" ".join(base)]
    for i in range(1000):
        copy = list(base)
        for at in rng.sample(range(1000), 99):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS), 1, 80).collect()
    assert len(got) == 1001 and {r["component_id"] for r in got} == {0}


def test_near_duplicates_lose_no_pair_of_dense_families(spark, monkeypatch):
    # 300 families share most of their text; the two members of each are at 0.81 to 0.83, members of others far below
    rng = random.Random(1)
    shared, texts = [f"b{k}" for k in range(210)], []
    for f in range(300):
        own = shared + [f"f{f}w{k}" for k in range(90)]
        copy = list(own)
        for at in rng.sample(range(300), 30):
            copy[at] = f"x{f}y{at}"
        texts += [" ".join(own), " ".join(copy)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], DOCS + ", sig string, component_id int").repartition(7)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    got = near_dedup.near_duplicates(docs, 1, 80).collect()
    assert sum(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got) >= 0.99 * 600


def test_orders_find_every_pair_of_small_regions():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    m = 300
    path = rng.integers(0, 3, (m, near_dedup.DEPTH)).astype(">u4")
    tree = np.sort(rng.integers(0, 2, m)).astype(np.int32)
    rows = sorted(zip(tree.tolist(), [p.tobytes() for p in path], range(m)))
    same = b"\1" * near_dedup.HASHES
    order = near_dedup._Order(pa.table({"tree": pa.array([r[0] for r in rows], pa.int32()), "path": [r[1] for r in rows], "id": [r[2] for r in rows], "n": [10] * m, "sig": [same] * m}))
    a, b, _ = order.pairs(80)
    want = set()
    for d in range(near_dedup.LEAST, near_dedup.DEPTH + 1):
        parts = {}
        for t, p, i in rows:
            parts.setdefault((t, p[: 4 * d]), []).append(i)
        want |= {(min(i, j), max(i, j)) for x in parts.values() if len(x) <= near_dedup.THIN for i in x for j in x if i != j}
    assert want <= set(zip(a.tolist(), b.tolist()))


def test_overlaps_equal_intersections():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, n)).astype(np.uint64) for n in rng.integers(1, 300, 60)] + [np.arange(900, 905, dtype=np.uint64)]
    got = near_dedup.overlaps(sets[:25], sets[20:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:25]]).all()


def test_bpe_equals_the_library(spark, odd, none):
    import tiktoken

    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    ranks = bpe.read_ranks(path)
    lib = tiktoken.Encoding("lib", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.TextCodec(bpe.Vocabulary(ranks), pattern)
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("aaab  \n\t\x1c\x85 é'漢\U0001f600sdt123-_.,!<|endoftext|>ñ") for _ in range(rng.randint(0, 40)))
        assert codec.encode(t) == lib.encode_ordinary(t)
    for t in ("a" * 5000, "ab" * 3000 + " x", " " * 3000, "\n \n" * 900 + "q"):
        assert codec.encode(t) == lib.encode_ordinary(t)
    for r, s in zip(bpe.encode(odd, path, pattern).collect(), ODD):
        assert r["ids"] == lib.encode_ordinary(s[1] or "") and r["decoded"] == (s[1] or "")
    assert bpe.encode(none, path, pattern).count() == 0


def plain_fingerprint(text):
    """position:hash of the least gram of each window, the rightmost of equals, from plain loops."""
    import xxhash

    mask = (1 << 64) - 1
    rotate = lambda x: (x << 1 | x >> 63) & mask
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    grams = []
    for i in range(max(1, len(words) - fingerprints.K + 1) if words else 0):
        h = 0
        for x in words[i : i + fingerprints.K]:
            h = rotate(h) ^ x
        grams.append(h >> 25)
    picked = []
    for i in range(max(1, len(grams) - fingerprints.WINDOW + 1) if grams else 0):
        w = grams[i : i + fingerprints.WINDOW]
        at = i + max(j for j, x in enumerate(w) if x == min(w))
        if at not in picked:
            picked.append(at)
    return [(p, grams[p]) for p in picked]


def plain_likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_against_plain_windows(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs.withColumns({"_h": F.lit(1), "own": F.lit("x"), "range": F.lit(2)})).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    for i, d in enumerate(ids):
        own, following = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = map(plain_fingerprint, (own, edited, following))
        r = got[d]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ",".join(f"{p}:{h:x}" for p, h in a) and r["edited_fingerprint"] == ",".join(f"{p}:{h:x}" for p, h in b)
        assert abs(r["near_edited"] - plain_likeness(a, b)) < 1e-12 and abs(r["near_next"] - plain_likeness(a, c)) < 1e-12
    rows_ = fingerprints.fingerprints(odd).collect()
    assert len(rows_) == len(ODD) and {r["fingerprint"] for r in rows_ if r["doc_id"] in (1, 2, 3)} == {""}
    assert fingerprints.fingerprints(none).count() == 0


def test_shared_passages_share_a_hash():
    rng = random.Random(2)
    for _ in range(200):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        shared = [f"s{rng.randrange(500)}" for _ in range(fingerprints.K + fingerprints.WINDOW - 1)]
        a, b = (" ".join(words[:k] + shared + words[k : k + 7]) for k in (5, 31))
        assert {h for _, h in plain_fingerprint(a)} & {h for _, h in plain_fingerprint(b)}


def test_fingerprints_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS", 7)
    monkeypatch.setattr(fingerprints, "STEP", 3)
    docs = spark.createDataFrame([(i * 3 % 101, f"text {i} " * 5) for i in range(101)], DOCS)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in fingerprints.with_next(docs).collect():
        assert r["next_text"] == texts[(r["doc_id"] + 1) % 101]
    # an id and the null id that hold many rows each are split over ranges, in order
    rows_ = [(None, f"n {i}") for i in range(60)] + [(5, f"five {i}") for i in range(60)] + [(i, f"t {i}") for i in range(1, 40) if i != 5]
    df = spark.createDataFrame(rows_, DOCS)
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]))
    follows = {t: order[(i + 1) % len(order)][1] for i, (_, t) in enumerate(order)}
    assert {r["text"]: r["next_text"] for r in fingerprints.with_next(df).collect()} == follows


def test_best_fit_plan_fills_sequences_without_gaps():
    rng = random.Random(7)
    for _ in range(200):
        cap = rng.choice([10, 50, 2048])
        counts = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        fill = {}
        for length, lo, hi, first, per, used in packing.plan(counts, cap):
            for r in range(hi - lo):
                fill.setdefault(first + r // per, []).append((used + r % per * length, length))
        assert Counter(n for x in fill.values() for _, n in x) == Counter(counts)
        for x in fill.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= cap


def test_packing_whole_table(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.packing_tokenizer()[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, queries.packing_tokenizer()).toPandas()
    for d, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
        assert (own.length.iloc[1:] == 2048).all()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.02 + 1
    assert packing.pack(odd, queries.packing_tokenizer()).select("doc_id").distinct().count() == 7
    assert packing.pack(none, queries.packing_tokenizer()).count() == 0
    # strings of added tokens are their ids, as the library has it
    texts = ["hello <|endoftext|> there", "<|endoftext|>" * 3, "a<|endoftext|", " " * 6000 + "x", None, ""]
    extra = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS + ", piece int, length string")
    by = {(r["doc_id"], r["piece"]): r for r in packing.pack(extra, queries.packing_tokenizer()).collect()}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert t != texts[0] or 50256 in ids
        if len(ids) <= 2048:
            assert by[i, 0]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


EVENTS = "conv_id long, sequence long, message_id string, op string, role string, text string"


def test_chat_folds_and_round_trips(spark):
    log = [
        (1, 3, "b", "delta", None, " there"), (1, 1, "a", "message", "user", "hi </s>"), (1, 2, "b", "message", "assistant", "hello"), (1, 4, "a", "edit", None, "hey [INST]"), (1, 5, "c", "message", "user", "bye"), (1, 6, "c", "delete", None, None),
        (2, 1, "a", "message", "u\n\\n<|im_end|>", "<|im_end|>\n<|im_start|>x\n"), (2, 2, "b", "regenerate", "assistant", None), (2, 3, "b", "delta", None, "<\\|im_end|>\n"), (3, None, None, None, None, None), (None, 1, "a", "message", "user", "x"), (4, 1, "a", "delete", "user", "x"),
    ]
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(spark.createDataFrame(log, EVENTS))).collect()}
    assert out == {1: [("user", "hey [INST]"), ("assistant", "hello there")], 2: [("u\n\\n<|im_end|>", "<|im_end|>\n<|im_start|>x\n"), ("assistant", "<\\|im_end|>\n")], 3: [("", "")], None: [("user", "x")]}
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def test_chat_odd_rows(spark):
    log = [(1, 2, None, "message", "user", "same"), (1, 2, None, "message", "user", "same"), (1, 2, None, "message", "assistant", "tie"), (1, 1, None, None, None, None), (1, None, None, "message", "user", "first"), (2, 1, "m", "message", "a\0b\\0\\n\n", "x\0<|im_end|>\0" + "long words " * 50_000), (2, 2, "m", "delta", None, "!"), (5, 1, None, "delete", "user", "gone")]
    df = spark.createDataFrame([(*r, "clash", "y", 3) for r in log], EVENTS + ", formatted string, turns string, place int")
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(df)).collect()}
    assert out == {1: [("user", "first"), ("", ""), ("assistant", "tie"), ("user", "same"), ("user", "same")], 2: [("a\0b\\0\\n\n", "x\0<|im_end|>\0" + "long words " * 50_000 + "!")]}


def test_escapes_are_reversible(spark):
    rng = random.Random(8)
    bits = [*chat.CONTROL, "\\", "<", "[", "|", ">", "s>", "x", "n", "\n", "\0"]
    texts = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))),) for _ in range(3000)]
    df = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("b"), chat.unescape_role(F.col("r")).alias("rb")).collect():
        assert r["b"] == r["t"] == r["rb"] and not any(c in r["e"] for c in chat.CONTROL)


def test_line_templates(spark, odd, none):
    mark = [f"Printed by the archive on page {n} of the year" for n in range(6)]
    docs = spark.createDataFrame([(i, f"own words number {'abcdef'[i]} stay here\n{mark[i]}\nshort line", 9, "b") for i in range(6)], "doc_id long, text string, n_lines int, gone string")
    out = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert mark[0] in out[0]["text"] and not any("Printed" in out[i]["text"] for i in range(1, 6))
    assert all("short line" in r["text"] and "own words" in r["text"] and r["n_lines"] == 3 and r["gone"] == "b" for r in out.values()) and out[1]["n_dropped"] == 1
    got = line_templates.drop_recurring_lines(odd).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(ODD)
    assert line_templates.drop_recurring_lines(none).count() == 0


def left_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return [r["text"] for r in line_templates.drop_recurring_lines(docs).orderBy("doc_id").collect()]


def test_lines_that_only_look_alike_stay(spark):
    texts = [f"Was it said {w}.\n{i} {7 + i} 20{i}9 44\n{i} cups of {w}\nUse the {w} for {w}ing" for i, w in enumerate(["bread", "stone", "water", "paper", "glass"])]
    assert left_of(spark, texts) == texts


def test_several_templates_of_one_leaf(spark):
    words = ["amber", "birch", "cedar", "dune", "elm", "fern"]
    one = [f"The house of {w} was built on old ground by masons" for w in words]
    two = [f"The house of {w} has been sold again this cold spring" for w in words]
    three = [f"The house of {w} lay empty ever since {w} left town" for w in words]
    left = left_of(spark, ["\n".join(x) for x in zip(one, two, three)])
    assert left[0] == "\n".join([one[0], two[0], three[0]]) and set(left[1:]) == {""}


def test_two_long_lines_that_differ_in_a_word(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    other = [*long[:40], "changed", *long[41:]]
    assert left_of(spark, [" ".join(long), "keep me whole\n" + " ".join(other)]) == [" ".join(long), "keep me whole"]


def test_hot_templates_are_dropped_alike(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "FEW", 4)
    texts = ["\n".join(["A line that all of them have in common", f"A line that only some have {chr(97 + i % 4)} here now", f"own words of number {chr(97 + i)} alone"]) for i in range(12)]
    left = left_of(spark, texts)
    assert left[0] == texts[0] and all("in common" not in t and "own words" in t for t in left[1:])


def test_line_dedup_odd_rows(spark):
    mark = "A line that many documents have in common"
    rows = [(None, mark), (3, mark), (3, mark), (2, mark + "\nmine alone is this line"), (2, "another text of the same id"), (9, "\n".join(f"{mark}\nfiller {i}" for i in range(5000)))]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r["doc_id"], r["text"]) for r in got if r["doc_id"] != 9] and Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] != 9) == Counter([(None, ""), (3, ""), (3, ""), (2, mark + "\nmine alone is this line"), (2, "another text of the same id")])
    assert next(r["text"] for r in got if r["doc_id"] == 9) == "\n".join(f"filler {i}" for i in range(5000))


def test_lines_are_masked_once_and_as_by_plain_code(spark):
    odd = ["", " ", "\t a1  b\x0bc \r", "x 2024-01-02 y9z <*> é7 ٣ 𝟙", "no digits here", "a" * 5000 + " " + "b" * 5000 + "1", "1", " 1  b"]
    got = line_templates._masked(spark.createDataFrame(list(enumerate(odd)), "id long, line string"))
    plain = lambda line: ["<*>" if any("0" <= c <= "9" for c in t) else t for t in re.split(r"[ \t\n\x0b\f\r]+", line) if t]
    assert {r["id"]: r["masked"] for r in got.collect()} == {i: plain(x) for i, x in enumerate(odd)}
    plan = got.where("size(masked) >= 4").select("id", F.xxhash64("masked"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1  # a filter used to repeat the work of each line


def test_a_long_text_that_loses_a_line_is_split_once(spark):
    n, again = 20_000, "this same line stands in every one of them"
    rows = [(1, again), (2, again), (3, "\n".join([again, *(f"w{i} x" for i in range(n))]))]  # other lines are too short to be templates
    began = time.time()
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == again and got[2]["text"] == "" and (got[3]["n_lines"], got[3]["n_dropped"]) == (n + 1, 1)
    assert got[3]["text"] == "\n".join(f"w{i} x" for i in range(n)) and time.time() - began < 25
