"""Functions of the library by name in SQL, beside the views of plans.views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession, functions as F

#: Functions that Catalyst puts into the plan in place of their call.
SCALARS = {
    "clamp01": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('inf') THEN 0D ELSE greatest(0D, least(1D, x)) END",
    "angle_delta": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN pmod(b - a + 180D, 360D) - 180D",
    "hash_distance": "(a BIGINT, b BIGINT) RETURNS INT RETURN coalesce(bit_count(a ^ b), 999)",
}


def stable_vote(value: pd.Series, confidence: pd.Series, t: pd.Series, id: pd.Series) -> str:
    """The value most often read and its mean confidence as "value:confidence:votes"; of equals the one seen first; null without values.

    An aggregate over a whole group: group by something that bounds it, such as a session's day.
    """
    seen = sorted((a, b, v, c) for v, c, a, b in zip(value.tolist(), confidence.tolist(), t.tolist(), id.tolist()) if v is not None and v == v)
    votes: dict[float, list] = {}
    for _, _, v, c in seen:
        votes.setdefault(v, []).append(c)
    if not votes:
        return None
    best = max(votes, key=lambda v: len(votes[v]))  # values stand in order of first sight
    return f"{int(best)}:{sum(votes[best]) / len(votes[best]):.12f}:{len(votes[best])}"


class ExpandAction:
    """A press or click as a down and, duration_ms (30 without) later, an up; any other action as itself; nothing for a null kind."""

    def eval(self, kind: str, t_ms: int, duration_ms: int):
        if kind in ("key_press", "mouse_click"):
            device = kind.split("_")[0]
            yield t_ms, device + "_down"
            yield t_ms + (30 if duration_ms is None else duration_ms), device + "_up"
        elif kind is not None:
            yield t_ms, kind


def register_functions(spark: SparkSession) -> list[str]:
    """Make the scalar functions, the aggregate stable_vote and the table function expand_action known to SQL; returns their names."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("stable_vote", F.pandas_udf(stable_vote, "string"))
    spark.udtf.register("expand_action", F.udtf(ExpandAction, returnType="at_ms: bigint, action: string"))
    return [*SCALARS, "stable_vote", "expand_action"]
