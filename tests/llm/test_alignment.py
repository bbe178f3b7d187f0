"""Alignment of two tokenizers against whole encodings by their libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from evtrace.llm import alignment as A, common, queries

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def paths():
    return (*(queries.tokenizer_path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")), queries.pattern())


@pytest.fixture(scope="module")
def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[1]), sentencepiece.SentencePieceProcessor(model_file=paths[2])
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(v): v for v in visible} | {chr(256 + k): v for k, v in enumerate(v for v in range(256) if v not in visible)}

    def encode(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        pieces = b.encode(text)
        one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in pieces]
        return one, two

    return encode


def groups(encode, text):
    """Groups of (A ids, B ids); none without tokens."""
    if not text:
        return []
    one, two = encode(text)
    raw = (" " + text).encode()
    if b"".join(b for _, b in one) != raw or b"".join(b for _, b in two) != raw:
        return []
    ends = []
    for tokens in (one, two):
        at, own = 0, []
        for _, b in tokens:
            own.append(at := at + len(b))
        ends.append(own)
    common, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in common:
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append(([t for t, _ in one[i:k]], [t for t, _ in two[j:m]]))
        i, j = k, m
    return out


def plain(encode, docs):
    told = {x: groups(encode, x) for _, x in docs}
    links = {x: Counter((a, b) for g in v for a in g[0] for b in g[1]) for x, v in told.items()}
    count = Counter(p for _, x in docs for p in links[x])
    most = defaultdict(int)
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    out = []
    for i, x in docs:
        g, k = told[x], links[x]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(c for (a, b), c in k.items() if count[a, b] == most[a])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(k.values()), best, sum(c * count[p] for p, c in k.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return Counter(out)


ALPHABET = [*"aab  \n\t\x1c\x85　 é'漢\U0001f600sdt123-_.,!ñ\x00", "<|endoftext|>", "<s>", "<0x41>", "  ", "   ", " the", " world", "é́", "ﬁ", "'ll", "====", "\r\n"]


def test_parts_are_whole_encodings(paths, libraries):
    rng = random.Random(2)
    aligner = A.Aligner(*paths)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30)))
        numbers = aligner.parts([text])[0]
        got = ";".join(aligner.groups[i] for i in numbers)
        assert got == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups(libraries, text)), text


@pytest.mark.parametrize("head, hot, kept", [(A.HEAD, common.HOT, A.KEPT), (40, 5, 3), (1, 1, 100)])
def test_equals_plain_loops(spark, monkeypatch, paths, libraries, head, hot, kept):
    monkeypatch.setattr(A, "LARGE", 10_000 if head > 1 else 2)
    monkeypatch.setattr(A, "HEAD", head)
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(A, "KEPT", kept)
    rng = random.Random(head)
    docs = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(120)]
    docs += [(200 + i, "the same world again") for i in range(90)]
    docs += [(1, None), (2, ""), (3, " "), (4, "a▁b"), (None, "the world"), (5, "x "), (6, "\n"), (7, "the world"), (7, "the world"), (8, "ab" * 20000 + " " * 6000 + "q"), (9, "= " * 9000)]
    df = spark.createDataFrame([(i, x, "k", 3) for i, x in docs], DOCS + ", key string, copies int").repartition(6)
    assert Counter(tuple(r) for r in A.align(df, paths).collect()) == plain(libraries, docs)


def test_empty_table(spark, paths):
    assert A.align(spark.createDataFrame([], DOCS), paths).count() == 0
    assert [tuple(r) for r in A.align(spark.createDataFrame([(1, None)], DOCS), paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
