"""Still images of sessions and numeric features of their regions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.timeline import with_previous

#: Weights of a pixel's brightness, in 1/16384 of blue, green and red.
LUMA = (1868, 9617, 4899)
#: Hue (0 to 180) from and to, least saturation and least value of the two colours that are told apart.
BLUE, WARM = (85, 125, 45, 75), (5, 35, 35, 70)


@dataclass(frozen=True)
class Levels:
    """Thresholds of the features, of 255."""

    bright: int = 185
    dark: int = 35
    black: int = 20
    saturated: int = 70
    edge: int = 140
    left: float = 0.46  # share of the width that is the left side
    right: float = 0.54  # where the right side begins


def read_images(spark: SparkSession, path: str, extension: str = "*") -> tuple[DataFrame, DataFrame]:
    """Images below path (session_id, path, frame_index, height, width, channels, data) and unreadable files (path, reason).

    The session is the folder's name, the frame index the last number in the file's name (null without one); data holds
    rows of blue, green, red bytes. Files that are no image are set aside, not an error; an empty folder gives no rows.
    """
    files = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}" if extension != "*" else "*").load(path).select("image.*")
    name = F.regexp_extract("origin", r"([^/]+)/([^/]+)$", 2)
    number = F.regexp_extract(name, r"(\d+)\D*$", 1)
    good = F.col("height") > 0
    rows = files.where(good).select(
        F.regexp_extract("origin", r"([^/]+)/([^/]+)$", 1).alias("session_id"), F.col("origin").alias("path"), F.when(number != "", number.cast("long")).alias("frame_index"),
        "height", "width", F.col("nChannels").alias("channels"), "data",
    )
    return rows, files.where(~good).select(F.col("origin").alias("path"), F.lit("unreadable").alias("reason"))


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3 bytes: blue, green, red."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def gray(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) @ np.array(LUMA) + 8192) >> 14).astype(np.uint8)


def hsv(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue of 180, saturation and value of 255."""
    b, g, r = (x[:, :, k].astype(np.float64) for k in range(3))
    top, low = x.max(axis=2).astype(np.float64), x.min(axis=2).astype(np.float64)
    span = np.where(top > low, top - low, 1.0)
    hue = np.where(top == r, 60 * (g - b) / span, np.where(top == g, 120 + 60 * (b - r) / span, 240 + 60 * (r - g) / span))
    hue = np.where(top > low, np.rint(np.where(hue < 0, hue + 360, hue) / 2), 0) % 180
    return hue, np.where(top > 0, np.rint(255 * (top - low) / np.where(top > 0, top, 1)), 0), top


def _cells(n: int, parts: int) -> np.ndarray:
    """Weights of n pixels in each of `parts` equal stretches."""
    edges = np.arange(parts + 1) * n / parts
    at = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, 1) * parts / n


def image_hash(g: np.ndarray, size: int = 8) -> int:
    """Bit by bit, row by row, whether a cell of size x (size + 1) mean cells is brighter than the one before; a signed long."""
    small = np.rint(_cells(g.shape[0], size) @ g @ _cells(g.shape[1], size + 1).T)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def edge_density(g: np.ndarray, level: int) -> float:
    """Share of pixels where the sum of both Sobel gradients is at least level: an approximation of an edge detector."""
    p = np.pad(g.astype(np.int64), 1, mode="edge")
    row, column = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:], p[:-2] + 2 * p[1:-1] + p[2:]
    return float(((np.abs(row[2:] - row[:-2]) + np.abs(column[:, 2:] - column[:, :-2])) >= level).mean())


FEATURES = "bright_ratio dark_ratio saturation_ratio non_black_ratio contrast mean_luma edge_density left_blue left_warm right_blue right_warm".split()


def features(x: np.ndarray, levels: Levels = Levels()) -> list[float]:
    """FEATURES of one region's pixels; an empty region is dark and has nothing else."""
    if not x.size:
        return [0.0, 1.0, *[0.0] * (len(FEATURES) - 2)]
    g, (hue, saturation, value) = gray(x), hsv(x)
    width = x.shape[1]
    colour = lambda c: (hue >= c[0]) & (hue <= c[1]) & (saturation >= c[2]) & (value >= c[3])
    left, right = slice(0, max(1, int(width * levels.left))), slice(min(width - 1, int(width * levels.right)), None)
    blue, warm = colour(BLUE), colour(WARM)
    ratio = lambda m: float(m.mean())
    return [
        ratio(g > levels.bright), ratio(g < levels.dark), ratio(saturation > levels.saturated), ratio(g > levels.black), float(g.std() / 128), float(g.mean() / 255), edge_density(g, levels.edge),
        ratio(blue[:, left]), ratio(warm[:, left]), ratio(blue[:, right]), ratio(warm[:, right]),
    ]


def _measure(regions: dict[str, tuple[int, int, int, int]], levels: Levels, names: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in names]
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row].as_py() for c in ("session_id", "path", "frame_index", "height", "width", "channels", "data", "prev")}
                x, before = pixels(of["data"], of["height"], of["width"], of["channels"]), of["prev"]
                rmsd = None
                if before is not None and (before["height"], before["width"]) == (of["height"], of["width"]):
                    step = x.astype(np.int32) - pixels(before["data"], before["height"], before["width"], before["channels"])
                    rmsd = float(np.sqrt(np.mean(step**2)))
                for name, (x1, y1, x2, y2) in regions.items() or [("whole", (0, 0, of["width"], of["height"]))]:
                    part = x[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
                    told = [of["session_id"], of["path"], of["frame_index"], name, *features(part, levels), image_hash(gray(part)) if part.size else None, rmsd]
                    for column, value in zip(out, told):
                        column.append(value)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.float64()] * len(FEATURES), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def frame_features(images: DataFrame, regions: dict[str, tuple[int, int, int, int]] | None = None, levels: Levels = Levels()) -> DataFrame:
    """Features of every region (name to x1, y1, x2, y2, cut to the image; the whole image without any) of every image.

    images: what read_images gives. Gives session_id, path, frame_index, region, FEATURES, hash (null for an empty
    region) and rmsd: the root mean square difference of the whole image from the one before in its session, in order of
    frame_index, then path; null for the first and where sizes differ. Images without an index come first. A batch holds
    as many images as spark.sql.execution.arrow.maxRecordsPerBatch says: keep it small for large images.
    """
    placed = images.withColumn("_at", F.coalesce("frame_index", F.lit(-1)))
    seen = with_previous(placed, ["session_id"], "_at", "path", ["height", "width", "channels", "data"], width=1000).drop("_at")
    names = ["session_id", "path", "frame_index", "region", *FEATURES, "hash", "rmsd"]
    shape = "session_id string, path string, frame_index long, region string, " + ", ".join(f"{c} double" for c in FEATURES) + ", hash long, rmsd double"
    return seen.mapInArrow(_measure(regions or {}, levels, names), shape)
