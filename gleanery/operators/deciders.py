"""A user's decider over undecided pairs; what it raises is confined to the pair that made it raise."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import pair_key

Decider = Callable[[pd.DataFrame], pd.Series]
ANSWER = "answer boolean, error string"


def answers(frame: pd.DataFrame, decider: Decider) -> pd.DataFrame:
    """Answers for a batch; one that raises is halved until the pairs that raise stand alone: false, with the reason."""
    out: list[tuple[bool, str | None]] = [(False, None)] * len(frame)
    stack = [(0, len(frame))]
    while stack:
        lo, hi = stack.pop()
        if lo == hi:
            continue
        try:
            got = list(decider(frame.iloc[lo:hi].reset_index(drop=True)))
            if len(got) != hi - lo:
                raise ValueError(f"{len(got)} answers to {hi - lo} pairs")
            out[lo:hi] = [(False if pd.isna(a) else bool(a), None) for a in got]
        except Exception as e:  # noqa: BLE001  whatever a user's code raises
            if hi - lo == 1:
                out[lo] = False, f"{type(e).__name__}: {e}"[:300]
            else:
                mid = (lo + hi) // 2
                stack += [(lo, mid), (mid, hi)]
    return pd.DataFrame(out, columns=["answer", "error"]).astype({"answer": bool, "error": object})


def decide_rest(decided: DataFrame, records: DataFrame, fields: list[str], decider: Decider) -> DataFrame:
    """Pairs with ``matched`` and ``error``; only pairs without a decision reach the decider.

    The decider gets a frame with ``left_*`` and ``right_*`` of the fields, a row a
    pair, and returns a series of booleans; a missing answer is false.
    """
    done = decided.filter("decision is not null").select("left_id", "right_id", F.col("decision").alias("matched"), F.lit(None).cast("string").alias("error"))
    side = lambda s: records.select(F.col("id").alias(f"{s}_id"), *[F.col(f).alias(f"{s}_{f}") for f in fields])
    open_ = decided.filter("decision is null").select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    names = [f"{s}_{f}" for s in ("left", "right") for f in ("id", *fields)]

    @F.pandas_udf(ANSWER)
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        return answers(pairs, decider)

    asked = open_.select("left_id", "right_id", run(F.struct(*names)).alias("_a"))
    return done.unionByName(asked.select("left_id", "right_id", F.col("_a.answer").alias("matched"), F.col("_a.error").alias("error"))).withColumn("pair_key", pair_key(F.col("left_id"), F.col("right_id")))
