"""Importance resampling against plain loops, and the head's arithmetic against the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evtrace.llm import resampling as R

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain(docs, target, percent=5, seed=42):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    many = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = many[: percent * len(many) // 100]
    ranked = Counter((*r, k + 1) for k, r in enumerate(drawn))
    rest = Counter(out) - Counter(drawn)
    return ranked + Counter({(*r, None): c for r, c in rest.items()})


def made(rng, n):
    usual, words = ["the", "of", "and", "naïve", "x1"], [f"w{k}" for k in range(400)] + ["ÉCOLE", "漢字", "A-B", "\x00", "é" * 200]
    return [(i, " ".join(rng.choice(usual if rng.random() < 0.6 else words) for _ in range(rng.choice([0, 1, 2, 19, 20, 60, 200])))) for i in range(n)]


def test_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAD", 64)  # so that words, pairs and tails all occur
    rng = random.Random(3)
    docs = made(rng, 240) + [(None, None), (300, ""), (301, " .,;\n"), (7, "the of " * 30), (7, "the of " * 30), (None, "the of and " * 9)]
    target = [x for _, x in made(rng, 20)] + [None, ""]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in docs], DOCS + ", score int, bucket string").repartition(5)
    got = R.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), 20, 7)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, target, 20, 7)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(R, "WINDOW", 50)
    monkeypatch.setattr(R, "STRETCH", 30)
    rng = random.Random(5)
    texts = [x for _, x in made(rng, 30)] + ["q" * 300 + " a", "z" * 120, None, "a b " + "y" * 99 + " c d"]
    words = [w.encode() for w in ("the", "of", "and")]
    head = R.Head(words, [(words[0], words[1]), (words[1], words[1])])
    got = [Counter() for _ in texts]
    for w, doc, place, new in R._stretches([None if t is None else t.encode() for t in texts]):
        at, b = head.buckets(w, place, new)
        for d, x in zip(doc[at].tolist(), b.tolist()):
            got[d][x] += 1
    assert got == [Counter(map(bucket, features(t)[1])) for t in texts]


def test_states_move_as_the_library_has_them():
    words = [b"a", b"the", "naïve".encode(), b"x" * R.LONGEST]
    head = R.Head(words, [(a, b) for a in words for b in words])
    state = np.random.default_rng(1).integers(0, 2**32, 200, dtype=np.uint32)
    for k, w in enumerate(words):
        assert head._moved(state, np.full(200, k)).tolist() == [zlib.crc32(b" " + w, s) for s in state.tolist()]


@pytest.mark.parametrize("docs, target", [([], []), ([], ["a"]), ([(1, "a " * 25)], []), ([(1, None)], [None])])
def test_empty_tables(spark, docs, target):
    got = R.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(x,) for x in target], "text string"), 100)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, target, 100)
