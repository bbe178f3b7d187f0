"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field that adds to them.

Base spans come from four patterns with their checks (base_spans). The field works on zones: the words around
digits, at-signs and words such as "password". A zone's tokens (a run of letters and digits is one token, however
long) are cut into segments. Every candidate segment is scored as a whole for each kind by features of its full
span (shape, groups of digits, checksums, cue words, neighbours), a kind is also scored against the kind of the
entity before it, and dynamic programming finds the boundaries and kinds that are best together. A segment has at
most TOKENS tokens and LENGTH characters unless it is one token. Weights maximise the penalised likelihood of
labelled zones (log-partition and expected counts by forward and backward sums over segments); those are seed
lines, lines made by rule, and at most SAMPLE zones of the table, the least by hash, that the patterns label.
Added spans that overlap a base span are dropped: base spans always stay.

Defined results: a null text is empty; a text without findings has zero counts and empty strings; of equally
good cuts a shorter last segment counts, then the earlier kind; very long texts are searched whole, in time that
grows with their length; rows that repeat or share a doc_id each have their result; an empty table gives no
rows. Positions are code points, ends exclusive. Other columns, whatever their names, are ignored by `find` and
kept by `redact`.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_sample, discard, settle_texts

BASE = ("email", "ip", "card", "phone")  # kinds of the patterns
KINDS = (*BASE, "secret", "iban", "ssn")
LENGTH = 254  # characters of the longest segment of several tokens: the longest address that mail can have
TOKENS = 48  # tokens of the longest segment
NEAR = 4  # words on either side of a trigger that its zone holds
SAMPLE = 250  # zones of the table that weights are fitted on
STARTS = 2048  # tokens whose segments are scored at once
ZONES = 500_000  # characters of zones whose tokens are held at once; a longer text is held alone
FITTED = 60  # tokens of the longest zone among them

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits passes Luhn's check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str):
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            least = m.end()
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans (kind, start, end), by kind as in BASE, then start."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    # a run of digits is taken whole: no match begins inside one
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


# --- zones, tokens and candidate segments

_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_WORD = re.compile(r"\S+")
#: Words that announce a kind (0 to 6: its place in KINDS).
CUES = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "secret": 4, "token": 4, "key": 4, "apikey": 4, "credential": 4, "credentials": 4,
    "iban": 5, "account": 5, "ssn": 6, "social": 6, "phone": 3, "tel": 3, "fax": 3, "call": 3, "mobile": 3, "card": 2, "visa": 2, "paid": 2,
    "host": 1, "ip": 1, "server": 1, "mail": 0, "email": 0, "write": 0,
}
_TRIGGER = re.compile(r"[0-9@]|(?i:\b(?:password|passwd|passphrase|pwd|secret|token|api[_ ]?key|credentials?)\b)")
_CODE = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*\Z")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")
_JOINS = frozenset("._-+/=%")
_BREAKS = frozenset(" -.()/")


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words that hold every trigger with the NEAR words on either side of its own."""
    first = _TRIGGER.search(text)
    if not first:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[list[int]] = []
    i = 0
    for m in _TRIGGER.finditer(text):
        while words[i][1] <= m.start():
            i += 1
        lo, hi = max(0, i - NEAR), min(len(words), i + NEAR + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(words[lo][0], words[hi - 1][1]) for lo, hi in out]


def _kind_of(token: str) -> int:
    """Shape of a token, 0 to 15."""
    c = token[0]
    if c.isspace():
        return 0
    if token.isascii() and token.isdigit():
        return 1
    if c.isalnum():
        return 3 if any(map(str.isdigit, token)) else 4 if token.isupper() else 5 if token.islower() else 2
    return {"+": 6, "(": 7, ")": 8, ".": 9, "-": 10, "@": 11, ":": 12, "=": 12, '"': 13, "'": 13, "_": 14}.get(c, 15)


def _before(counts: np.ndarray) -> np.ndarray:
    """Running sums, with 0 in front."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)  # one byte's step of CRC-32
COUNTS = ("digits", "numbers", "long", "octets", "dots", "ats", "other", "closing", "spaces", "lower", "upper", "alnum", "numeric", "capitals")
_CAPITALS = re.compile(r"[A-Z0-9]+\Z")


class Zone:
    """Tokens of one or more stretches of text, end to end, and the arrays that segments and features are read from.
    No segment reaches from one stretch into the next."""

    def __init__(self, *texts: str):
        self.text = "".join(texts)
        self.tokens: list[str] = []
        self.first = [0]  # of each stretch, its first token, and the end
        cues = []
        for text in texts:
            last, since, told = 7, 99, 0
            own = _TOKEN.findall(text)
            for t in own:
                # the cue among the last eight tokens (7 without), and whether : or = came after it
                cues.append(last * 2 + told if since < 8 else 14)
                found = CUES.get(t.lower()) if t[0].isalnum() else None
                if found is not None:
                    last, since, told = found, 0, 0
                else:
                    since += 1
                    told = told or int(t in (":", "="))
            self.tokens += own
            self.first.append(len(self.tokens))
        tokens = self.tokens
        n = len(tokens)
        flag = lambda of: np.fromiter(of, bool, n)
        self.kind = kind = np.fromiter(map(_kind_of, tokens), np.int64, n)
        self.size = np.fromiter(map(len, tokens), np.int64, n)
        self.at = _before(self.size)
        self.cue = np.array(cues, np.int64)
        stretch = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.begin, self.stop = np.array(self.first)[stretch], np.array(self.first)[stretch + 1]
        number = kind == 1
        self.digit = np.where(number, self.size, 0)
        mixed = np.flatnonzero(kind == 3)
        self.digit[mixed] = [sum(map(str.isdigit, tokens[i])) for i in mixed]
        self.breaks, self.joins, self.space = (flag(t in of for t in tokens) for of in (_BREAKS, _JOINS, (" ",)))
        self.code = np.zeros(n, bool)
        self.code[mixed] = [bool(_CODE.match(tokens[i])) for i in mixed]
        self.alnum = flag(t[0].isalnum() for t in tokens)
        lower = flag(t != t.upper() if t.isascii() else any(map(str.islower, t)) for t in tokens)
        upper = flag(t != t.lower() if t.isascii() else any(map(str.isupper, t)) for t in tokens)
        gap = (kind == 10) | flag(not t.strip(" ") for t in tokens)  # hyphens and plain spaces
        capitals = gap | flag(bool(_CAPITALS.match(t)) for t in tokens)
        self.octet = flag(k and _octet(t) for t, k in zip(tokens, number))
        #: counts before each token, a column each as in COUNTS
        told = (self.digit, number, number & (self.size > 255), self.octet, kind == 9, kind == 11, kind == 15, kind == 8, kind == 0, lower, upper, self.alnum, number | gap, capitals)
        self.counts = np.zeros((n + 1, len(told)), np.int32)
        np.cumsum(np.stack(told, axis=1), axis=0, out=self.counts[1:])
        place = np.arange(n)
        self.last_at = np.maximum.accumulate(np.where(kind == 11, place, -1)) if n else place
        self.dot_before = np.maximum.accumulate(np.where(kind != 9, place, -1)) if n else place  # last token up to here that is no dot
        self.dot_after = np.minimum.accumulate(np.where(kind != 9, place, n)[::-1])[::-1] if n else place  # first from here on
        # CRC-32 of the sizes of 1 to 16 numbers in a row from each number on
        sizes = np.concatenate([self.size[number], np.zeros(16, np.int64)])
        count = int(number.sum())
        self.crc = np.zeros((count, 17), np.uint8)
        state = np.full(count, 0xFFFFFFFF, np.uint32)
        for x in range(16):
            state = _CRC[(state ^ sizes[x : x + count].astype(np.uint32)) & 255] ^ (state >> np.uint32(8))
            self.crc[:, x + 1] = (state ^ np.uint32(0xFFFFFFFF)) % 61
        # digit sums for Luhn's check, the digits at even or odd places doubled
        run = np.frombuffer("".join(t for t, k in zip(tokens, number) if k).encode(), np.uint8).astype(np.int64) - 48
        twice = np.where(run > 4, run * 2 - 9, run * 2)
        odd = np.arange(len(run)) % 2 == 1
        self.luhn = np.stack([_before(np.where(odd, twice, run)), _before(np.where(odd, run, twice))])
        self.figures = _before(self.size * number)

    def candidates(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidate segments (first token, end) that begin at tokens lo to hi - 1."""
        i = np.arange(lo, hi)
        k = self.kind[i]
        told = self.cue[i] // 2 == 4
        numbers = (k == 1) | (k == 6) | (k == 7)
        groups = self.code[i]
        keys = ((k >= 1) & (k <= 5) | told | self.joins[i]) & (k != 0)  # keys, addresses, what stands after a cue
        digits, ats, digit = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        starts, ends = [], []
        for d in range(TOKENS):
            alive = (numbers | groups | keys) & (i + d < self.stop[i])
            if not alive.all():
                i, told, numbers, groups, keys, digits, ats, digit = (x[alive] for x in (i, told, numbers, groups, keys, digits, ats, digit))
            if not len(i):
                break
            j = i + d
            k, size = self.kind[j], self.at[j + 1] - self.at[i]
            number = k == 1
            some = number | (k == 3)
            digits = digits + np.where(number, self.size[j], 0)
            numbers = numbers & np.where(number, (digits <= 24) | (d == 0), self.breaks[j] | (k == 6) & (d == 0))
            groups = groups & (self.space[j] | some | (k == 4)) & (size <= 44)
            digit = digit | some
            ats = ats + (k == 11)
            keys = keys & (k != 0) & ((size <= LENGTH) | (d == 0)) & (ats < 2) & (told | (k <= 5) | (k == 11) | self.joins[j])
            out = numbers & number & (digits >= 4) | groups & (k != 0)
            out |= keys & ((ats > 0) & (k != 11) & (d > 0) | told | digit & (size >= 8))
            starts.append(i[out])
            ends.append(j[out] + 1)
        return (np.concatenate(starts), np.concatenate(ends)) if starts else (i[:0], i[:0])

    def segments(self) -> list[tuple[int, int]]:
        """All candidate segments (first token, end), by end, shorter ones first."""
        i, j = self.candidates(0, len(self.tokens))
        order = np.lexsort((-i, j))
        return list(zip(i[order].tolist(), j[order].tolist()))

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A row for each whole segment tokens[i:j]: one feature of each template."""
        kind, n = self.kind, len(self.tokens)
        count = dict(zip(COUNTS, np.ascontiguousarray((self.counts[j] - self.counts[i]).T)))
        many, size = j - i, self.at[j] - self.at[i]
        padded = np.append(kind, [0, 0])
        before = np.where(i > self.begin[i], kind[i - 1], 0)
        after = np.where(j < self.stop[i], padded[j], 0)
        second = np.where(j + 1 < self.stop[i], padded[np.minimum(j + 1, n)], 0)
        mail = count["ats"]
        where = self.last_at[j - 1]  # of the one at-sign, where there is one
        lo, hi = self.dot_after[np.minimum(where + 1, n - 1)], self.dot_before[j - 1]
        dots = self.counts[:, COUNTS.index("dots")]
        dotted = (lo < hi) & (where < hi) & (dots[np.maximum(hi, 0)] > dots[np.minimum(lo, n)])
        address = (mail == 1) & (many > 1) & dotted & self.alnum[i] & self.alnum[j - 1]
        four = (count["octets"] == 4) & (count["numbers"] == 4) & (count["dots"] == 3) & (many == 7)
        length = count["digits"]
        a, b = self.figures[i], self.figures[j]
        card = (count["numeric"] == many) & (length > 12) & (length < 20)
        plain = (b - 1) % 2
        right = (self.luhn[plain, b] - self.luhn[plain, a]) % 10 == 0
        iban = np.zeros(len(i), np.int64)
        for s in np.flatnonzero((count["capitals"] == many) & (count["upper"] > 0)):
            bare = self.text[self.at[i[s]] : self.at[j[s]]].replace(" ", "").replace("-", "")
            iban[s] = _iban(bare) if _CODE.match(bare) else 0
        last = np.minimum(i + 2, n - 1), np.minimum(i + 4, n - 1)
        ssn = (many == 5) & (kind[i] == 1) & (kind[last[0]] == 1) & (kind[last[1]] == 1) & (self.size[i] == 3) & (self.size[last[0]] == 2) & (self.size[last[1]] == 4)
        ssn &= (kind[np.minimum(i + 1, n - 1)] == 10) & (kind[np.minimum(i + 3, n - 1)] == 10)
        grouped = np.zeros(len(i), np.int64)
        own = (count["numbers"] > 0) & (count["long"] == 0) & (count["other"] == 0)
        grouped[own] = 1 + self.crc[self.counts[i[own], COUNTS.index("numbers")], np.minimum(count["numbers"][own], 16)]
        sorts = count["lower"] + count["upper"] > 0
        sort = np.select([(count["alnum"] < many) & sorts & (length > 0), (count["lower"] > 0) & (count["upper"] > 0) & (length > 0), sorts & (length > 0), length > 0], [5, 4, 3, 2], 1)
        sort = np.where((size >= 12) & (sort > 1), sort + 4, sort)
        touches = lambda k: (k != 0) & (k < 6)
        values = (
            0,
            kind[i],
            kind[j - 1],
            before,
            after,
            _SIZE[np.minimum(size, 48)],
            _SIZE[np.minimum(length, 48)],
            _SIZE[np.minimum(many, 48)],
            self.cue[i],
            np.where(mail == 0, 0, np.where(address, 1, 2)),
            four,
            np.where(card, np.where(right, 1, 2), 0),
            iban,
            ssn,
            grouped,
            np.where(kind[i] == 6, 1, np.where(kind[i] == 7, 2, 0)) + 3 * (count["closing"] > 0) + 6 * (count["spaces"] > 0),
            np.where((many == 1) | (mail == 0) & (count["spaces"] == 0), sort, 0),
            touches(before) + 2 * touches(after) + 4 * (np.isin(after, (9, 10, 11, 14)) & (second >= 1) & (second <= 5)),
        )
        out = np.empty((len(i), len(_BASES)), np.int16)
        for x, (b, v) in enumerate(zip(_BASES, values)):
            out[:, x] = v
            out[:, x] += b
        return out


#: Values of each template, in the order of Zone.features.
_SIZES = (1, 16, 16, 16, 16, 10, 10, 10, 16, 3, 2, 3, 3, 2, 62, 12, 10, 8)
_BASES = tuple(accumulate(_SIZES[:-1], initial=0))
FEATURES = sum(_SIZES)


def _bucket(n: int) -> int:
    return n if n < 2 else 2 if n < 4 else 3 if n < 8 else 4 if n < 12 else 5 if n < 16 else 6 if n < 20 else 7 if n < 32 else 8 if n < 48 else 9


_SIZE = np.array([_bucket(n) for n in range(49)])


def _iban(bare: str) -> int:
    if not 15 <= len(bare) <= 34:
        return 2
    return 1 if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1 else 2


# --- the field


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


_MIX = np.random.default_rng(7).integers(1, 2**62, len(_SIZES)) | 1


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the place of each row among them (all rows, should two of them share a key)."""
    with np.errstate(over="ignore"):
        key = (rows * _MIX).sum(axis=1)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    one = rows[first]
    return (one, back) if (one[back] == rows).all() else (rows, np.arange(len(rows)))


class Field:
    """weights[feature, kind] and after[kind of the entity before or 0 for none, kind]."""

    def __init__(self, weights: np.ndarray | None = None, after: np.ndarray | None = None):
        k = len(KINDS)
        self.weights = np.zeros((FEATURES, k)) if weights is None else weights
        self.after = np.zeros((k + 1, k)) if after is None else after

    def scores(self, features: np.ndarray) -> np.ndarray:
        """A row per segment, a column per kind."""
        one, back = _distinct(features)
        out = np.empty((len(one), len(KINDS)))
        for at in range(0, len(one), 4096):
            out[at : at + 4096] = self.weights[one[at : at + 4096]].sum(axis=1)
        return out[back]

    def gains(self) -> np.ndarray:
        """By kind, the most that an entity can add to a cut beside its own score, wherever it is put."""
        after = self.after
        changed = (after[1:, None, :] - after[None, :, :]).max(axis=2)  # by kind and state before it: what the next entity wins
        return (after.T + np.maximum(changed, 0.0)).max(axis=1)

    def decode(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The best disjoint segments (first token, end, kind) of n tokens; tokens between them are outside and score 0."""
        if not len(segments):
            return []
        walk = _Walk(self, n)
        i, j = np.array(segments).T
        walk.on(i, j, scores, np.zeros(len(i), np.int64), n)
        return walk.found().get(0, [])

    def spans(self, *texts: str) -> list[tuple[str, int, int]]:
        """Entities (kind, start, end) of all zones of a text, by start."""
        return next(self.spans_of(texts), [])

    def spans_of(self, texts):
        """The entities of each text. Segments are scored some thousands at a time; of them only those are kept that can
        be in a best cut: what an entity adds is at most its score and its gain, and without one of less than 0 a cut
        is better."""
        held: list[tuple[list, list[str]]] = []
        size = 0
        for text in texts:
            found = zones(text)
            held.append(([a for a, _ in found], [text[a:b] for a, b in found]))
            size += sum(b - a for a, b in found)
            if size > ZONES or len(held) >= 1024:
                yield from self._spans(held)
                held, size = [], 0
        yield from self._spans(held)

    def _spans(self, held):
        zone = Zone(*(z for _, own in held for z in own))
        n, gains, walk = len(zone.tokens), self.gains(), _Walk(self, len(zone.tokens))
        stretch = np.repeat(np.arange(len(zone.first) - 1), np.diff(zone.first))
        for lo in range(0, n, STARTS):
            hi = min(lo + STARTS, n)
            i, j = zone.candidates(lo, hi)
            if len(i):
                scores = self.scores(zone.features(i, j))
                can = (scores + gains).max(axis=1) > -1e-9
                i, j, scores = i[can], j[can], scores[can]
                order = np.lexsort((-i, j))
                i, j, scores = i[order], j[order], scores[order]
                walk.on(i, j, scores, stretch[i], hi)
            else:
                walk.on(i, j, np.empty((0, len(KINDS))), i, hi)
        found, z = walk.found(), 0
        for starts, own in held:
            out = []
            for a in starts:
                shift = a - int(zone.at[zone.first[z]])
                out += [(KINDS[k], shift + int(zone.at[s]), shift + int(zone.at[e])) for s, e, k in found.get(z, ())]
                z += 1
            yield out


class _Walk:
    """The dynamic program over the tokens of many stretches, some at a time. Only places where segments begin or end
    are visited; segments that end later are held for the next call."""

    def __init__(self, field: Field, n: int):
        k = len(KINDS)
        self.after = field.after
        self.enter = np.empty((n + 1, k))  # best before an entity of each kind that begins here
        self.come = np.empty((n + 1, k), np.int8)  # the state before it
        self.back = np.zeros((n + 1, k), np.int32)  # tokens of the entity of each kind that ends here in the best cut, or 0
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, k)), np.empty(0, np.int64))
        self.now, self.best = -1, np.empty(k + 1)  # stretch, and best by kind of the last entity
        self.ends: dict[int, tuple[int, int]] = {}  # of each stretch, its last visited place and the state there
        self.kinds = np.arange(k)

    def _turn(self, z: int) -> None:
        if z != self.now:
            self.best[:] = -np.inf
            self.best[0] = 0.0
            self.now = z

    def on(self, i: np.ndarray, j: np.ndarray, scores: np.ndarray, stretch: np.ndarray, hi: int) -> None:
        """Take segments [i, j) that begin before hi, by end, and go on to place hi."""
        starts, first = np.unique(i, return_index=True)
        begun = dict(zip(starts.tolist(), stretch[first].tolist()))
        if len(self.held[0]):
            i, j, scores, stretch = (np.concatenate(x) for x in zip(self.held, (i, j, scores, stretch)))
            order = np.argsort(j, kind="stable") if not len(starts) else np.lexsort((-i, j))
            i, j, scores, stretch = i[order], j[order], scores[order], stretch[order]
        done = int(np.searchsorted(j, hi, side="right"))
        self.held = (i[done:], j[done:], scores[done:], stretch[done:])
        ends, cut = np.unique(j[:done], return_index=True)
        cut = [*cut.tolist(), done]
        ended = {p: x for x, p in enumerate(ends.tolist())}
        best, enter, after, kinds = self.best, self.enter, self.after, self.kinds
        for p in sorted(begun.keys() | ended.keys()):
            x = ended.get(p)
            if x is not None:
                a, b = cut[x], cut[x + 1]
                self._turn(int(stretch[a]))
                if b - a == 1:
                    value, size = enter[i[a]] + scores[a], p - i[a]
                else:
                    sums = enter[i[a:b]] + scores[a:b]
                    pick = sums.argmax(axis=0)
                    value, size = sums[pick, kinds], p - i[a:b][pick]
                better = value > best[1:]
                if better.any():
                    self.back[p] = np.where(better, size, 0)
                    np.maximum(best[1:], value, out=best[1:])
                    self.ends[self.now] = (p, int(best.argmax()))
            if p in begun:
                self._turn(begun[p])
                step = best[:, None] + after
                self.come[p] = came = step.argmax(axis=0)
                enter[p] = step[came, kinds]

    def found(self) -> dict[int, list[tuple[int, int, int]]]:
        """By stretch, the entities (first token, end, kind) of the best cut."""
        out = {}
        for z, (j, state) in self.ends.items():
            own = []
            while state:
                while not self.back[j, state - 1]:
                    j -= 1
                i = j - int(self.back[j, state - 1])
                own.append((i, j, state - 1))
                state, j = int(self.come[i, state - 1]), i
            if own:
                out[z] = own[::-1]
        return out


class _Sums:
    """Forward and backward sums over the segments of many zones at once."""

    def __init__(self, known: list[tuple[Zone, dict[tuple[int, int], int]]]):
        joined = Zone(*(zone.text for zone, _ in known))
        segments = np.array(joined.segments()).reshape(-1, 2)
        self.features = joined.features(*segments.T)
        self.zone = np.searchsorted(joined.first, segments[:, 0], side="right") - 1
        self.start, self.end = (segments - np.array(joined.first)[self.zone][:, None]).T
        gold = [known[z][1].get(s, -1) for z, s in zip(self.zone, zip(self.start.tolist(), self.end.tolist()))]
        self.before = np.zeros((len(KINDS) + 1, len(KINDS)))
        for _, truth in known:
            state = 0
            for s in sorted(truth):
                self.before[state, truth[s]] += 1
                state = truth[s] + 1
        self.gold = np.zeros((len(gold), len(KINDS)))
        has = np.array(gold) >= 0
        self.gold[has, np.array(gold)[has]] = 1
        self.zones, self.n = len(known), max(len(z.tokens) for z, _ in known)
        self.by_end, self.by_start = self._grouped(self.end), self._grouped(self.start)

    def _grouped(self, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By place: its segments in order of zone, where each zone's begin, and those zones."""
        order = np.lexsort((self.zone, place))
        cut = np.searchsorted(place[order], np.arange(self.n + 2))
        out = []
        for a, b in zip(cut, cut[1:]):
            own = order[a:b]
            z = self.zone[own]
            first = np.flatnonzero(np.r_[True, z[1:] != z[:-1]]) if len(z) else z
            out.append((own, first, z[first]))
        return out

    @staticmethod
    def _reduce(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(values, first)
        per = np.repeat(top, np.diff(np.r_[first, len(values)]), axis=0)
        return np.log(np.add.reduceat(np.exp(values - per), first)) + top

    def step(self, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood and its gradients in the weights."""
        k, score = len(KINDS), field.weights[self.features].sum(axis=1)
        ahead = np.full((self.n + 1, self.zones, k + 1), -np.inf)
        ahead[0, :, 0] = 0.0
        enter = np.empty((self.n + 1, self.zones, k))
        for j in range(self.n + 1):
            if j:
                ahead[j] = ahead[j - 1]
                own, first, z = self.by_end[j]
                if len(own):
                    come = self._reduce(enter[self.start[own], self.zone[own]] + score[own], first)
                    ahead[j, z, 1:] = np.logaddexp(ahead[j, z, 1:], come)
            enter[j] = _logsum(ahead[j][:, :, None] + field.after, 1)
        total = _logsum(ahead[self.n], 1)
        behind = np.zeros((self.n + 1, self.zones, k + 1))
        leave = np.full((self.n + 1, self.zones, k), -np.inf)
        for j in range(self.n - 1, -1, -1):
            behind[j] = behind[j + 1]
            own, first, z = self.by_start[j]
            if len(own):
                leave[j, z] = self._reduce(score[own] + behind[self.end[own], self.zone[own]][:, 1:], first)
                behind[j, z] = np.logaddexp(behind[j, z], _logsum(field.after[None] + leave[j, z][:, None, :], 2))
        chance = np.exp(enter[self.start, self.zone] + score + behind[self.end, self.zone][:, 1:] - total[self.zone][:, None])
        moved = np.exp(ahead[:, :, :, None] + field.after + leave[:, :, None, :] - total[None, :, None, None]).sum(axis=(0, 1))
        rest = self.gold - chance
        flat = self.features.ravel()
        weights = np.stack([np.bincount(flat, np.repeat(rest[:, x], self.features.shape[1]), FEATURES) for x in range(k)], axis=1)
        like = float((score * self.gold).sum() + (field.after * self.before).sum() - total.sum())
        return like, weights, self.before - moved


def expressible(text: str, spans: list[tuple[str, int, int]]) -> bool:
    """Whether every span is a candidate segment."""
    zone = Zone(text)
    at = {p: i for i, p in enumerate(zone.at.tolist())}
    known = set(zone.segments())
    return all((at.get(a), at.get(b)) in known for _, a, b in spans)


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, penalty: float = 0.05) -> Field:
    """The field of greatest penalised likelihood, by Adam over all examples, for texts with their spans (kind, start, end)."""
    known = []
    for text, spans in examples:
        if not expressible(text, spans):
            raise ValueError(f"no segments of the field are the labelled spans {spans} of {text!r}")
        zone = Zone(text)
        at = {p: i for i, p in enumerate(zone.at.tolist())}
        known.append((zone, {(at[a], at[b]): KINDS.index(k) for k, a, b in spans}))
    sums, field = _Sums(known), Field()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (field.weights, field.after)]
    for t in range(1, rounds + 1):
        _, *slopes = sums.step(field)
        for w, g, (m, v) in zip((field.weights, field.after), slopes, moments):
            g = g - penalty * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return field


#: Lines with their entities between braces, kind first.
SEEDS = [
    "write to {email jane.doe@mail.example.org} today", "mail {email a_b+c@x-y.example.com}, please", "host {ip 10.0.12.7} is down", "from {ip 192.168.100.200} at 12:30", "card {card 4111 1111 1111 1111} was used", "paid with {card 5500-0000-0000-0004} on 2020-01-02", "number {card 378282246310005} here",
    "call {phone +1 (212) 555-0147} now", "tel {phone +44 20 7946 0958} or later", "ring {phone (212) 555-0147} first", "fax {phone 212-555-0147} and wait", "phone {phone 020 7946 0958} here", "password={secret b7db7aa4a5fcc78305} and so on", "token = \"{secret 1beb58b8af68854f0e01b4ad40cdbb6a}\" set", "api_key: {secret sk9f8e7d6c5b4a39281706} in use", "secret={secret hunter2hunter2} kept",
    "password: {secret correcthorsebattery} was told", "my passphrase is {secret purplemonkeydishwasher}, see", "pwd={secret Tr0ub4dor&3} again", "iban {iban GB29NWBK60161331926819} please", "to account {iban DE89 3704 0044 0532 0130 00} by friday", "ssn {ssn 123-45-6789} on file", "social security number {ssn 078-05-1120} given",
    "in 1998 there were 12 of 340 left", "page 42, line 7", "it cost 1,250.00 in all", "version 3.11.2 is out", "on 2021-03-04 at 10:15:00", "chapter 12.3.4 and 5", "see @home for more", "about 1000000 people", "order 12345678 shipped", "GNU General Public License, version 3.", "at 3 @ 5 each", "build 20210304 of 7", "isbn 978 3 16 148410 0 listed", "sum 4111 1111 1111 1112 wrong",
    "the password is needed to go on", "a secret that nobody keeps", "each token of the text counts", "the key to the door was lost", "password reset by mail", "forgot your password? ask the office", "token = the smallest unit", "a secret: nobody knows", "part no. AB12 and C3PO were there", "flight LH1234 at gate B22", "sections 3-12-2020 to 4",
]


def _seed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans = "", []
    for part in re.split(r"(\{\w+ [^}]*\})", line):
        if part.startswith("{"):
            kind, _, value = part[1:-1].partition(" ")
            spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += part
    return text, spans


def made_lines(n: int = 160, start: int = 11) -> list[str]:
    """More lines like SEEDS, made by rule; another start makes others."""
    import random

    rng = random.Random(start)
    pick = lambda of, k: "".join(rng.choice(of) for _ in range(k))
    digits = lambda k: pick("0123456789", k)
    word = lambda a=2, b=8: pick("abcdefghijklmnoprstuvw", rng.randint(a, b))

    def card():
        body = rng.choice("3456") + digits(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        gap = rng.choice(["", "", " ", "-"])
        return gap.join(full[i : i + 4] for i in range(0, 16, 4))

    def iban():
        land, body = rng.choice([("GB", pick("ABCDEFGHKLMNOPRSTW", 4) + digits(14)), ("DE", digits(18)), ("ES", digits(20)), ("NL", pick("ABCDEFGHKLMNOPRSTW", 4) + digits(10)), ("FR", digits(22) + "K" + digits(2))])
        full = next(f"{land}{c:02d}{body}" for c in range(2, 99) if _iban(f"{land}{c:02d}{body}") == 1)
        return " ".join(full[i : i + 4] for i in range(0, len(full), 4)) if rng.random() < 0.4 else full

    def secret():
        value = rng.choice([lambda: word() + digits(rng.randint(6, 12)) + word(), lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: word(9, 22), lambda: word(3, 6) + rng.choice("!$&#") + word(2, 6) + digits(2), lambda: pick("ABCDEFGHabcdefgh0123456789", 24)])()
        lead = rng.choice(["password=", "secret: ", "token = ", "api_key: ", "passwd ", "credentials: ", 'token = "'])
        return f"{lead}{{secret {value}}}" + ('"' if lead.endswith('"') else "")

    shapes = [
        lambda: f"{{email {word()}.{word()}{rng.choice(['', digits(2)])}@{word()}{rng.choice(['', digits(1)])}.{word()}.com}}",
        lambda: "{ip " + ".".join(str(rng.randint(1, 255)) for _ in range(4)) + "}",
        lambda: f"{{card {card()}}}",
        lambda: "{phone " + rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}"]) + "}",
        secret,
        lambda: rng.choice(["iban ", "account ", ""]) + f"{{iban {iban()}}}",
        lambda: rng.choice(["ssn ", "ssn: ", "number ", ""]) + f"{{ssn {digits(3)}-{digits(2)}-{digits(4)}}}",
        lambda: rng.choice([f"in {rng.randint(1900, 2030)}", f"{digits(rng.randint(1, 5))} items", f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", f"{digits(2)}:{digits(2)}", f"no. {digits(rng.randint(5, 9))}", f"{digits(3)}.{digits(2)}", f"{rng.randint(1990, 2030)}-{digits(2)}-{digits(2)}"]),
        lambda: rng.choice(["the password", "a secret", "one token", "this key", "our credentials"]) + " " + rng.choice(["of", "that", "and", "is", "was"]),
    ]
    return [" ".join([word(), rng.choice(shapes)(), word(), *([rng.choice(shapes)()] if rng.random() < 0.3 else []), word()]) for _ in range(n)]


def _sample_zones(batches):
    import pyarrow as pa

    for batch in batches:
        out = [z for t in batch.column("text").to_pylist() if t for z in (t[a:b] for a, b in zones(t)) if len(_TOKEN.findall(z[: FITTED * 40])) <= FITTED and len(z) < FITTED * 40]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["zone"])


def labelled(zone: str) -> list[tuple[str, int, int]] | None:
    """What the patterns say of a zone, and keys after a cue; None where patterns overlap or a span is no segment."""
    spans = sorted(base_spans(zone), key=lambda s: s[1])
    if any(a[2] > b[1] for a, b in zip(spans, spans[1:])):
        return None
    keys = [("secret", m.start(1), m.end(1)) for m in re.finditer(r"(?i)(?:password|passwd|secret|token|api_?key)\s*[=:]\s*\"?([0-9a-z]{12,})", zone)]
    spans += [c for c in keys if not any(a < c[2] and c[1] < b for _, a, b in spans)]
    return spans if expressible(zone, spans) else None


def fit_on(texts: DataFrame) -> Field:
    """The field for a table of texts (column text): seeds, and SAMPLE zones labelled by the patterns."""
    found = settle_texts(texts.mapInArrow(_sample_zones, "zone string").distinct())
    rows = bounded_sample(found, SAMPLE).collect()
    discard(found)
    told = [(zone, labelled(zone)) for (zone,) in rows]
    return fit([*map(_seed, SEEDS + made_lines()), *((z, s) for z, s in told if s is not None)])


def _together(text: str, found: list) -> tuple[list, list]:
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    reach = list(accumulate((b for _, b in taken), max))  # how far the base spans up to each one go
    added, i = [], 0
    for s in found:
        while i < len(taken) and taken[i][0] < s[2]:
            i += 1
        if not i or reach[i - 1] <= s[1]:
            added.append(s)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and all spans: base ones and what the field adds."""
    return _together(text, field.spans(text))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(field: Field):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            cols = [[] for _ in range(7)]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for text, found in zip(texts, field.spans_of(texts)):
                base, spans = _together(text, found)
                kinds = [k for k, _, _ in base]
                for c, v in zip(cols, [*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)]):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all spans) of every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = fit_on(texts.select("text"))
    return texts.mapInArrow(_find(field), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def _mask(field: Field):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            for text, found in zip(texts, field.spans_of(t or "" for t in texts)):
                if text is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for kind, a, b in sorted(_together(text, found)[1], key=lambda s: (s[1], -s[2])):
                    if b > at:
                        parts += [text[at : max(at, a)], f"[{kind.upper()}]" if a >= at else ""]
                        at = b
                out.append("".join([*parts, text[at:]]))
            cols = [pa.array(out, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; all columns stay."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_mask(fit_on(docs.select("text"))), T.StructType(docs.schema.fields))
