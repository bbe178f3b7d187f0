"""Images written by hand, their features against plain loops over pixels."""

import colorsys
import math
import random
import struct

import numpy as np
import pytest

from evtrace.sources import images as I


def bmp(path, rows):
    """rows of (r, g, b) as a 24-bit bitmap."""
    h, w = len(rows), len(rows[0])
    line = lambda row: (b := b"".join(bytes((p[2], p[1], p[0])) for p in row)) + b"\0" * (-len(b) % 4)
    body = b"".join(map(line, reversed(rows)))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)


def picture(seed, h, w):
    rng = random.Random(seed)
    tones = [(0, 0, 0), (255, 255, 255), (40, 90, 220), (230, 150, 60), (20, 200, 30), (128, 128, 128), (10, 10, 12)]
    return [[rng.choice(tones) if rng.random() < 0.7 else tuple(rng.randrange(256) for _ in range(3)) for _ in range(w)] for _ in range(h)]


def plain(rows, levels=I.Levels()):
    """The features by loops over pixels."""
    h, w = len(rows), len(rows[0])
    luma = [[(r * 4899 + g * 9617 + b * 1868 + 8192) >> 14 for r, g, b in row] for row in rows]
    flat = [v for row in luma for v in row]
    mean = sum(flat) / len(flat)

    def tone(p):
        hue, _, _ = colorsys.rgb_to_hsv(*p)
        top, low = max(p), min(p)
        return round(hue * 180) % 180, round(255 * (top - low) / top) if top else 0, top

    tones = [[tone(p) for p in row] for row in rows]
    within = lambda t, c: c[0] <= t[0] <= c[1] and t[1] >= c[2] and t[2] >= c[3]
    share = lambda lo, hi, c: sum(within(t, c) for row in tones for t in row[lo:hi]) / (h * (hi - lo))
    at = lambda y, x: luma[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]

    def strong(y, x):
        gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
        return abs(gx) + abs(gy) >= levels.edge

    left, right = max(1, int(w * 0.46)), min(w - 1, int(w * 0.54))
    part = lambda f: sum(map(f, flat)) / len(flat)
    return [
        part(lambda v: v > 185), part(lambda v: v < 35), sum(t[1] > 70 for row in tones for t in row) / (h * w), part(lambda v: v > 20), math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat)) / 128, mean / 255,
        sum(strong(y, x) for y in range(h) for x in range(w)) / (h * w), share(0, left, I.BLUE), share(0, left, I.WARM), share(right, w, I.BLUE), share(right, w, I.WARM),
    ]


@pytest.fixture
def folder(tmp_path):
    for n in range(4):
        bmp(tmp_path / "one" / f"frame_{n:03d}.bmp", picture(n, 20, 31))
    bmp(tmp_path / "one" / "frame_004.bmp", picture(9, 8, 9))  # another size
    bmp(tmp_path / "two" / "still.bmp", picture(5, 16, 18))
    (tmp_path / "two" / "broken7.bmp").write_bytes(b"BMnothing")
    return tmp_path


def test_unreadable_files_are_set_aside(spark, folder):
    rows, bad = I.read_images(spark, str(folder), "bmp")
    assert sorted((r["session_id"], r["frame_index"], r["height"], r["width"]) for r in rows.select("session_id", "frame_index", "height", "width").collect() if r["session_id"] == "one") == [("one", 0, 20, 31), ("one", 1, 20, 31), ("one", 2, 20, 31), ("one", 3, 20, 31), ("one", 4, 8, 9)]
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["broken7.bmp"] and rows.where("session_id = 'two' and frame_index is null").count() == 1


def test_features_equal_plain_loops(spark, folder):
    rows, _ = I.read_images(spark, str(folder), "bmp")
    regions = {"whole": (0, 0, 10_000, 10_000), "corner": (2, 3, 14, 12), "outside": (500, 500, 600, 600)}
    got = {(r["session_id"], r["frame_index"], r["region"]): r for r in I.frame_features(rows, regions).collect()}
    assert len(got) == 18
    for n in range(4):
        rows_of = picture(n, 20, 31)
        assert [got["one", n, "whole"][c] for c in I.FEATURES] == pytest.approx(plain(rows_of), abs=1e-9)
        assert [got["one", n, "corner"][c] for c in I.FEATURES] == pytest.approx(plain([row[2:14] for row in rows_of[3:12]]), abs=1e-9)
        assert got["one", n, "outside"]["dark_ratio"] == 1.0 and got["one", n, "outside"]["hash"] is None
        if n:
            flat = lambda k: [v for row in picture(k, 20, 31) for p in row for v in p]
            want = math.sqrt(sum((a - b) ** 2 for a, b in zip(flat(n), flat(n - 1))) / (20 * 31 * 3))
            assert got["one", n, "whole"]["rmsd"] == pytest.approx(want)
    assert got["one", 0, "whole"]["rmsd"] is None and got["one", 4, "whole"]["rmsd"] is None


def test_hash_tells_which_cells_grow_brighter():
    rising = np.tile(np.arange(0, 90, dtype=np.uint8), (16, 1))
    assert I.image_hash(rising) == -1 and I.image_hash(rising[:, ::-1]) == 0
    half = np.vstack([rising[:8], rising[:8, ::-1]])
    assert I.image_hash(half) == -(1 << 32)


def test_no_images(spark, tmp_path):
    rows, bad = I.read_images(spark, str(tmp_path), "bmp")
    assert rows.count() == 0 and bad.count() == 0 and I.frame_features(rows).count() == 0
