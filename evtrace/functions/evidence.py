"""Scores that rest on the features of image regions (sources.images.FEATURES and text_like_density)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values. Of each score its terms (feature, weight, full at: the value that counts as 1, None for the value itself),
#: the factor of their sum and the most that it may be. Contrast counts up to 1 where no other full value is given.
LADDERS = {
    "display": ([("edge_density", 0.35, 0.12), ("contrast", 0.25, 0.45), ("bright_ratio", 0.20, 0.12), ("saturation_ratio", 0.20, 0.25)], 1.0, 1.0),
    "aim": ([("edge_density", 0.45, 0.08), ("bright_ratio", 0.35, 0.08), ("contrast", 0.20, 0.35)], 1.0, 1.0),
    "signal": ([("text_like_density", 1.8, None), ("edge_density", 1.1, None), ("bright_ratio", 0.7, None), ("saturation_ratio", 0.4, None), ("contrast", 0.3, 1.0)], 1.7, 0.78),
    "medal": ([("bright_ratio", 0.9, None), ("saturation_ratio", 0.9, None), ("edge_density", 0.7, None), ("contrast", 0.5, 1.0)], 1.35, 0.76),
    "panel": ([("dark_detail", 0.35, None), ("text_like_density", 2.8, None), ("edge_density", 1.8, None), ("bright_ratio", 0.8, None), ("contrast", 0.35, 1.0)], 1.0, 0.80),
    "return": ([("text_like_density", 1.0, None), ("edge_density", 0.9, None), ("bright_ratio", 0.6, None), ("contrast", 0.2, 1.0)], 1.4, 0.72),
    "cue": ([("text_like_density", 5.0, None), ("edge_density", 0.8, None), ("contrast", 0.5, 1.0)], 1.0, 1.0),
    "bar": ([("text_like_density", 4.0, None), ("edge_density", 1.2, None), ("bright_ratio", 1.0, None)], 1.0, 1.0),
}
#: Fixed values. A dark region shows a panel only with some detail in it: over one of these.
DETAIL = {"text_like_density": 0.010, "edge_density": 0.015, "bright_ratio": 0.010}


def ladder(name: str, of: dict[str, Column], most: float | None = None) -> Column:
    """One of LADDERS over the features `of` (missing and null ones count 0), in 0..`most`, the ladder's own unless given."""
    terms, factor, own = LADDERS[name]
    value = lambda c: F.coalesce(of[c].cast("double"), F.lit(0.0)) if c in of else F.lit(0.0)
    detail = F.lit(False)
    for c, least in DETAIL.items():
        detail = detail | (value(c) > least)
    total = F.lit(0.0)
    for feature, weight, full in terms:
        x = F.when(detail, value("dark_ratio")).otherwise(0.0) if feature == "dark_detail" else value(feature)
        total = total + weight * (x if full is None else F.least(F.lit(1.0), x / full))
    return F.greatest(F.lit(0.0), F.least(F.lit(own if most is None else most), total * factor))


def panel_structure(upper_bright: Column, upper_edges: Column, lower_dark: Column, lower_mean: Column) -> Column:
    """Score of bright marks over a dark, even lower part (its mean of 255); null where a region is not of that kind."""
    fits = (upper_bright >= 0.020) & (upper_edges >= 0.030) & (lower_dark >= 0.850) & (lower_mean <= 65.0)
    return F.when(fits, F.least(F.lit(0.82), 0.45 + 5.0 * upper_bright + 2.5 * upper_edges + 0.15 * lower_dark))


def down_score(panel: dict[str, Column], cue: dict[str, Column], *bars: dict[str, Column]) -> Column:
    """struct<score, cue, display> of being down: a panel, a central cue and no bars of the display."""
    shown = sum((ladder("bar", b) for b in bars), F.lit(0.0)) / max(1, len(bars))
    seen = ladder("cue", cue)
    return F.struct(F.least(F.lit(1.0), 0.30 * ladder("panel", panel, 1.0) + 0.50 * seen + 0.20 * (1.0 - shown)).alias("score"), seen.alias("cue"), shown.alias("display"))
