"""Personal data: patterns against the contract's expressions, the field against brute force and held-out lines, odd rows."""

import hashlib
import itertools
import math
import random
import re
import sys
import time
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
import pytest

from evtrace.llm import personal

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (4, "1.2.3.4"), (None, "call +1 (212) 555-0147"), (5, "\u00e9\U0001f600 1.2.3.\u00b2"), (6, "10.0.0.\u2460 a@b.c " * 2000)]


def slow_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    o = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    o += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))]
    return o + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def field():
    return personal.fit([*map(personal._seed, personal.SEEDS + personal.made_lines())])


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("ab@..--0123 9+()%\u00e9\u00b2\n@.5") for _ in range(rng.randint(0, 60)))
        assert slow_spans(t) == personal.base_spans(t)
    assert personal.base_spans("9" * 200_000) == [] and personal.base_spans("a" * 200_000 + "@") == []


def test_no_character_of_unicode_fails(field):
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (c.isdigit() or c.isnumeric() or unicodedata.category(c)[0] in "NZ")]
    odd += [chr(c) for c in range(0, sys.maxunicode, 997) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(odd), 40):
        some = odd[at : at + 40]
        text = " ".join(f"1.2.3.{c} +1{c}5550 4111{c}1111 token={c}{c}9 {c}@{c}.{c} GB29{c}" for c in some)
        base, spans = personal.all_spans(text, field)
        assert base == slow_spans(text) and set(base) <= set(spans)


def test_zones_hold_every_trigger_and_whole_words():
    rng = random.Random(5)
    for _ in range(400):
        t = "".join(rng.choice(["word ", "x", " 12", "@", "\n", "password ", "a1b2 "]) for _ in range(rng.randint(0, 60)))
        found = personal.zones(t)
        for m in re.finditer("[0-9@]|password", t):
            inside = m[0] != "password" or re.search(r"(?<!\w)password(?!\w)", t[max(0, m.start() - 1) : m.end() + 1])
            assert not inside or any(a <= m.start() and m.end() <= b for a, b in found)
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(found))
        assert all((not a or t[a - 1].isspace()) and (b == len(t) or t[b].isspace()) for a, b in found)


def every_cut(n, segments):
    """All sets of disjoint segments of n tokens."""


    def grow(at):
        yield ()
        for s, (i, j) in enumerate(segments):
            if i >= at:
                for rest in grow(j):
                    yield (s, *rest)

    return grow(0)


def slow_mix(text: str) -> int:
    """Which sorts of characters a run without spaces mixes, 1 to 9, the last four for the long ones."""
    lower, upper, digit = (any(map(f, text)) for f in (str.islower, str.isupper, str.isdigit))
    other = not text.isalnum()
    sort = 5 if other and (lower or upper) and digit else 4 if lower and upper and digit else 3 if (lower or upper) and digit else 2 if digit else 1
    return sort + 4 if len(text) >= 12 and sort > 1 else sort


class SlowZone:
    """Segments and features by plain loops."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = personal._TOKEN.findall(text)
        self.at = [0, *accumulate(map(len, self.tokens))]
        self.kind = [personal._kind_of(t) for t in self.tokens]
        #: by token: the cue among the last eight tokens (7 without), and whether : or = came after it
        self.cue, last, since, told = [], 7, 99, 0
        for t, k in zip(self.tokens, self.kind):
            self.cue.append((last, told) if since < 8 else (7, 0))
            found = personal.CUES.get(t.lower()) if 2 <= k <= 5 else None
            if found is not None:
                last, since, told = found, 0, 0
            else:
                since += 1
                told = told or int(k == 12)

    def segments(self) -> list[tuple[int, int]]:
        """Candidate segments (first token, end), by end, shorter ones first."""
        found: set[tuple[int, int]] = set()
        kind, tokens, at, n = self.kind, self.tokens, self.at, len(self.tokens)
        for i in range(n):
            k = kind[i]
            if k == 0:
                continue
            limit = min(n, i + personal.TOKENS)
            if k in (1, 6, 7):  # numbers with their separators
                digits = 0
                for j in range(i, limit):
                    if kind[j] == 1:
                        digits += len(tokens[j])
                        if digits > 24 and j > i:
                            break
                        if digits >= 4:
                            found.add((i, j + 1))
                    elif not (kind[j] == 6 and j == i or tokens[j] in personal._BREAKS):
                        break
            if k in (1, 3) and personal._CODE.match(tokens[i]):  # codes in groups
                for j in range(i, limit):
                    if not (tokens[j] == " " or kind[j] in (1, 3, 4)) or at[j + 1] - at[i] > 44:
                        break
                    if kind[j]:
                        found.add((i, j + 1))
            said = self.cue[i][0] == 4
            digit = False
            if k in (1, 2, 3, 4, 5) or said or tokens[i] in personal._JOINS:  # keys, addresses, what stands after a cue
                at_sign = 0
                for j in range(i, limit):
                    if kind[j] == 0 or at[j + 1] - at[i] > personal.LENGTH and j > i:
                        break
                    digit = digit or kind[j] in (1, 3)
                    at_sign += kind[j] == 11
                    if at_sign > 1 or not said and kind[j] > 5 and kind[j] != 11 and tokens[j] not in personal._JOINS:
                        break
                    if at_sign and j - i > 0 and kind[j] != 11 or said or digit and at[j + 1] - at[i] >= 8:
                        found.add((i, j + 1))
        return sorted(found, key=lambda s: (s[1], -s[0]))

    def features(self, i: int, j: int) -> list[int]:
        """One feature of each template for the whole segment tokens[i:j]."""
        text = self.text[self.at[i] : self.at[j]]
        kind, tokens = self.kind, self.tokens
        inside = kind[i:j]
        groups = [len(t) for t, k in zip(tokens[i:j], inside) if k == 1]
        digits = sum(map(str.isdigit, text))
        before, after = (kind[i - 1] if i else 0), (kind[j] if j < len(kind) else 0)
        cue, told = self.cue[i]
        bare = text.replace(" ", "").replace("-", "")
        plain = bare.isascii()
        mail = text.count("@")
        values = (
            0,
            inside[0],
            inside[-1],
            before,
            after,
            personal._bucket(len(text)),
            personal._bucket(digits),
            personal._bucket(j - i),
            cue * 2 + told,
            0 if not mail else 1 if mail == 1 and i < j - 1 and "." in text.split("@")[1].strip(".") and text[-1].isalnum() and text[0].isalnum() else 2,
            1 if len(groups) == 4 and inside.count(9) == 3 and j - i == 7 and all(map(personal._octet, text.split("."))) else 0,
            (1 if personal.luhn(bare) else 2) if plain and bare.isdigit() and 12 < len(bare) < 20 else 0,
            personal._iban(bare) if plain and personal._CODE.match(bare) else 0,
            1 if personal._SSN.match(text) else 0,
            1 + zlib.crc32(bytes(groups[:16])) % 61 if groups and max(groups) < 256 and 15 not in inside else 0,
            (1 if text[0] == "+" else 2 if text[0] == "(" else 0) + 3 * (8 in inside) + 6 * (0 in inside),
            slow_mix(text) if j - i == 1 or not mail and 0 not in inside else 0,
            (before not in (0, 13) and before < 6) + 2 * (after not in (0, 13) and after < 6) + 4 * (after in (9, 10, 11, 14) and j + 1 < len(kind) and kind[j + 1] in (1, 2, 3, 4, 5)),
        )
        return [b + v for b, v in zip(personal._BASES, values)]


BITS = "1 22 333 4444 - . : = @ a b.c Ab12 GB29 NWBK60161331926819 +1 ( ) / _ password token= \u00e9 \u00b2 \u24d0 \t 4111111111111111 10.0.0.1 123-45-6789 \" x@y.zz , ABCD DE89 3704 300".split(" ") + [" "] * 12


def test_segments_and_features_equal_plain_loops():
    rng = random.Random(1)
    seen = 0
    for _ in range(1500):
        line = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 40)))
        slow, zone = SlowZone(line), personal.Zone(line)
        segments = zone.segments()
        assert segments == slow.segments()
        if segments:
            assert zone.features(*np.array(segments).T).tolist() == [slow.features(*s) for s in segments]
        seen += len(segments)
    assert seen > 20_000


def test_spans_of_many_texts_and_across_blocks_are_those_of_one_cut(field, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "token=" + "-1a" * 300]
    whole = []
    for t in texts:
        out = []
        for a, b in personal.zones(t):
            zone = personal.Zone(t[a:b])
            segments = zone.segments()
            score = field.scores(zone.features(*np.array(segments).T)) if segments else []
            out += [(personal.KINDS[k], a + int(zone.at[i]), a + int(zone.at[j])) for i, j, k in field.decode(len(zone.tokens), segments, score)]
        whole.append(out)
    assert sum(map(len, whole)) > 300
    for starts, size in ((7, 100), (2048, 10**6)):
        monkeypatch.setattr(personal, "STARTS", starts)
        monkeypatch.setattr(personal, "ZONES", size)
        assert list(field.spans_of(texts)) == whole


def test_figures_and_marks_take_time_that_grows_with_their_length(field):
    for text in ("1-" * 20_000, "password=.-_" * 3_000, "AA11 " * 8_000):
        begun = time.monotonic()
        field.spans(text)
        assert time.monotonic() - begun < 15  # a millisecond a character would be 36 seconds or more


def test_dynamic_program_and_sums_against_all_cuts():
    rng = np.random.default_rng(2)
    k = len(personal.KINDS)
    tried = 0
    for line in ["t=1a2 5.5.5.5", "+1 555 0147", "x@y.z 12345", "pwd: ab!", "GB29 1234", "77 88-99 1"]:
        zone = personal.Zone(line)
        segments, n = zone.segments(), len(zone.tokens)
        cuts = sorted(set(every_cut(n, segments)))
        assert len(cuts) > 1 and sum(7 ** len(c) for c in cuts) < 200_000
        for _ in range(3):
            f = personal.Field(rng.normal(0, 0.4, (personal.FEATURES, k)), rng.normal(0, 0.5, (k + 1, k)))
            score = f.scores(zone.features(*np.array(segments).T))
            best, total = (-math.inf, ()), []
            for cut in cuts:
                for kinds in itertools.product(range(k), repeat=len(cut)):
                    v, last = 0.0, 0
                    for s, x in zip(cut, kinds):
                        v, last = v + score[s, x] + f.after[last, x], x + 1
                    total.append(v)
                    best = max(best, (v, tuple((*segments[s], x) for s, x in zip(cut, kinds))))
            assert tuple(f.decode(n, segments, score)) == best[1] or best[0] <= 0 and not f.decode(n, segments, score)
            sums = personal._Sums([(zone, {})])
            like, slope, after = sums.step(f)
            assert like == pytest.approx(-np.log(np.sum(np.exp(total))))
            for w, g in ((f.weights, slope), (f.after, after)):
                at = np.unravel_index(np.abs(g).argmax(), g.shape)
                w[at] += 1e-5
                assert (sums.step(f)[0] - like) / 1e-5 == pytest.approx(g[at], abs=1e-3)
                w[at] -= 1e-5
            tried += 1
    assert tried == 18


def test_field_finds_held_out_lines_of_every_kind(field):
    right, every, wrong = {}, {}, 0
    for text, spans in map(personal._seed, personal.made_lines(400, 77)):
        got = set(field.spans(text))
        wrong += len(got - set(spans))
        for s in spans:
            every[s[0]] = every.get(s[0], 0) + 1
            right[s[0]] = right.get(s[0], 0) + (s in got)
    assert set(every) == set(personal.KINDS) and wrong <= 6
    assert all(right[k] >= 0.9 * n for k, n in every.items() if k != "secret") and right["secret"] >= 0.7 * every["secret"]
    held = ["password: {secret correcthorsestaple} was", "ssn {ssn 219-09-9999} here", "iban {iban FR1420041010050500013M02606} due", "mail {email x.y@mail2.example.net} soon", "call {phone (415) 555-2671} please", "in 2015 we had 31 of 90", "the secret of the garden"]
    assert sum(set(field.spans(t)) == set(s) for t, s in map(personal._seed, held)) >= 6


def test_query_and_redaction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = personal.find(docs).toPandas().set_index("doc_id")
    for r in docs.collect():
        want = slow_spans(r["text"])
        assert got.at[r["doc_id"], "base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got.at[r["doc_id"], "spans"].split(","))
    clean = personal.redact(docs)
    assert clean.columns == docs.columns and not any(slow_spans(r["text"]) for r in clean.collect())


def test_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "x", 7) for r in ODD], DOCS + ", spans string, n_ip int")
    got = personal.find(odd).collect()
    assert len(got) == len(ODD) and got[0].asDict() | {"base_sha256": ""} == {"doc_id": 1, "n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_sha256": "", "spans": "", "n_spans": 0}
    assert [r["n_ip"] for r in got] == [0, 0, 0, 0, 0, 1, 0, 0, 0] and [r["n_email"] for r in got][-1] == 2000 and got[6]["spans"] == "phone:5:22"
    out = personal.redact(odd)
    assert out.columns == odd.columns and [r["text"] for r in out.collect()][:7] == [None, "", " \n\t ", "word", "word", "[IP]", "call [PHONE]"]
    none = spark.createDataFrame([], DOCS)
    assert personal.find(none).count() == 0 and personal.redact(none).count() == 0


def test_long_keys_are_one_span_and_redacted_whole(spark):
    keys = [hashlib.sha512(f"k{i}".encode()).hexdigest()[: 32 + 8 * (i % 2)] for i in range(12)]
    docs = spark.createDataFrame([(i, f'the token = "{k}" was used') for i, k in enumerate(keys)], DOCS)
    assert {r["text"] for r in personal.redact(docs).collect()} == {'the token = "[SECRET]" was used'}
    assert all(personal.expressible(*personal._seed(line)) for line in personal.SEEDS + personal.made_lines())
    with pytest.raises(ValueError):
        personal.fit([("a " * 200 + "1", [("secret", 0, 401)])])


def test_added_spans_never_touch_base_spans(field):
    rng = random.Random(9)
    bits = ["4111111111111111 ", "x@y.example.com", "+1 (212) 555-0147", " 10.0.0.1", " token=ab12cd34ef56 ", "-", " 123-45-6789 ", "GB29NWBK60161331926819 "]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        base, spans = personal.all_spans(t, field)
        want = [s for s in field.spans(t) if not any(a < s[2] and s[1] < b for _, a, b in base)]
        assert sorted(spans) == sorted(base + want)
