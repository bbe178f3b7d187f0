"""The exact similarity join against all pairs of plain sets."""

import random
from collections import Counter

import numpy as np
import pytest

from evtrace.llm import ngram_join as J

DOCS = "doc_id long, text string"


def shingles(text, k):
    w = (text or "").encode().translate(J.WORD_BYTES).split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)) if w else frozenset()


def plain(docs, k, need):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= need * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def got(spark, docs, k, need, parts=5):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS + ", key string, label int").repartition(parts)
    return Counter(tuple(r) for r in J.similar_components(df, k, need).collect())


def edited(rng, words, n, mark):
    copy = list(words)
    for at in rng.sample(range(len(words)), n):
        copy[at] = f"{mark}{at}"
    return copy


@pytest.fixture(scope="module")
def mixed():
    """Families, chains, shared passages, copies, short and odd texts."""
    rng, docs = random.Random(8), []
    passage = [f"p{k}" for k in range(60)]
    for f in range(12):
        own = [f"f{f}w{rng.randrange(300)}" for _ in range(rng.choice([8, 40, 150]))]
        own[3:3] = passage if f % 3 == 0 else []
        last = own
        for c in range(rng.choice([1, 3, 8])):
            last = edited(rng, last if f % 2 else own, rng.randrange(0, 2 + len(own) // 40), f"e{f}x{c}y")
            docs.append(" ".join(last))
    docs += ["a b c d", "a b c d", "a b c", "A  b\tc d", "é É", None, "", " \n ", "q " * 300, "q " * 200]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(3, "again the same id here now"), (3, "again the same id here now"), (None, docs[0]), (None, "z y x w v u")]


@pytest.mark.parametrize("k, need", [(5, 80), (3, 60), (1, 80), (2, 100)])
def test_equals_all_pairs(spark, mixed, k, need):
    assert got(spark, mixed, k, need) == plain(mixed, k, need)


def test_small_blocks_parts_and_fragments(spark, mixed, monkeypatch):
    for name, value in {"CHUNK": 500, "FRAGMENT": 400, "BLOCK": 2, "PART": 2, "SAMPLED": 1, "HEAP": 20}.items():
        monkeypatch.setattr(J, name, value)
    assert got(spark, mixed, 2, 70) == plain(mixed, 2, 70)


def test_a_star_links_through_its_centre(spark):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(300)]
    docs = list(enumerate(" ".join(edited(rng, base, 29, f"c{i}x") if i != 7 else base) for i in range(600)))
    told = got(spark, docs, 1, 80)
    assert {r[2] for r in told} == {0} and told == plain(docs, 1, 80)


def test_dense_families_are_searched_exactly(spark):
    # 120 families share 70 % of their text; the members of each are at 0.81 to 0.83, those of others far below
    rng = random.Random(1)
    shared, docs = [f"b{k}" for k in range(210)], []
    for f in range(120):
        own = shared + [f"f{f}w{k}" for k in range(90)]
        docs += [" ".join(own), " ".join(edited(rng, own, 30, f"x{f}y"))]
    docs = list(enumerate(docs))
    assert got(spark, docs, 1, 80) == Counter((i, 300, i - i % 2) for i, _ in docs)


def test_without_blocks_the_last_search_finds_all(spark, mixed, monkeypatch):
    monkeypatch.setattr(J, "_blocks", lambda sets, central, similarity: spark.createDataFrame([], "a long, b long"))
    assert got(spark, mixed, 2, 60) == plain(mixed, 2, 60)
    for name, value in {"PART": 3, "HEAP": 20}.items():
        monkeypatch.setattr(J, name, value)
    assert got(spark, mixed, 1, 80) == plain(mixed, 1, 80)


def test_search_connects_what_links():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(400, 60, replace=False)
        sets = [np.unique(np.r_[base[rng.random(60) < rng.choice([0.7, 0.95])], rng.choice(2000, 5)]).astype(np.uint64) for _ in range(25)]
        found = J.search(sets, np.arange(25), int(rng.integers(25)), 80)
        docs = [(i, " ".join(map(str, s))) for i, s in enumerate(sets)]
        root = list(range(25))
        for a, b in found:
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        want = plain(docs, 1, 80)
        assert Counter((i, len(sets[i]), min(j for j in range(25) if root[j] == root[i])) for i in range(25)) == want


def test_empty_tables(spark):
    assert got(spark, [], 5, 80) == Counter()
    assert got(spark, [(1, None), (None, "")], 5, 80) == Counter([(1, 0, 1), (None, 0, None)])


def test_sets_of_many_texts_at_once_are_those_of_each(monkeypatch):
    monkeypatch.setattr(J, "WINDOW", 37)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\té漢AB\x0b") for _ in range(rng.randint(0, 200))) for _ in range(300)] + [None, "", "x" * 90]
    for k in (1, 2, 5):
        plain_sets, sets = [shingles(t, k) for t in texts], list(J.Shingler(k).sets(texts))
        assert list(map(len, plain_sets)) == list(map(len, sets))
        assert len(frozenset().union(*plain_sets)) == len(np.unique(np.concatenate(sets)))


def test_lists_are_packed_without_loss():
    import pyarrow as pa

    lists = [[1], [5, 6, 300], [7, 70_000], [1, 1 << 40], list(range(1, 2000, 3))]
    batch = pa.RecordBatch.from_pydict({"a": [1] * len(lists), "least": [1] * len(lists), "members": lists})
    assert [J._unpacked(x).tolist() for x in next(J._packed([batch])).column("members").to_pylist()] == lists
