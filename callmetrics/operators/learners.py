"""Margin perceptrons over bounded samples of labelled rows.

A perceptron is order-dependent, so its rows are taken in order of hashes, and their number is bounded by a parameter. Scoring,
unlike fitting, covers all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows a tool's policy and the global one are fitted on at most.
MOST_ROWS, MOST_ALL = 200, 20_000
EPOCHS, RATE, MARGIN, MINED = 6, 0.05, 1.0, 48


def trained(weights: np.ndarray, x: np.ndarray, y: np.ndarray, importance: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, margin: float = MARGIN) -> np.ndarray:
    """Rows within the margin move the weights by the rate, their importance and how far they fall short, in order."""
    w = weights.astype(float).copy()
    for _ in range(epochs):
        for row, label, much in zip(x, y, importance):
            got = label * float(row @ w)
            if got < margin:
                w += rate * max(much, 0.1) * min(margin - got, margin + 2.0) * label * row
    return w


def mined(weights: np.ndarray, x: np.ndarray, y: np.ndarray, importance: np.ndarray, margin: float = MARGIN, most: int = MINED) -> tuple[np.ndarray, np.ndarray]:
    """Rows that fall short of the margin, worst first, at most ``most``, with more importance; the two worst if none does."""
    got = y * (x @ weights)
    order = np.argsort(got, kind="stable")
    short = order[got[order] < margin]
    if len(short):
        return short[:most], np.maximum(importance[short[:most]] * 1.75, importance[short[:most]] + 0.5)
    return order[:2], np.maximum(importance[order[:2]] * 1.4, importance[order[:2]] + 0.25)


def policy(start: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after training, and after training again with the mined rows."""
    even = np.ones(len(y))
    first = trained(start, x, y, even)
    again, much = mined(first, x, y, even)
    return first, trained(first, np.r_[x, x[again]], np.r_[y, y[again]], np.r_[even, much])


def rows_of(names: list[str], start: np.ndarray, x, y) -> pd.DataFrame:
    first, last = policy(start, np.stack(x), np.asarray(y))
    return pd.DataFrame({"feature": names, "initial": start, "trained": np.round(first, 6), "refined": np.round(last, 6)})


def global_policy(rows: DataFrame, weights: dict[str, float], most: int = MOST_ALL) -> DataFrame:
    """(feature, initial, trained, refined) from at most ``most`` rows (k, label, x) in order of k. Without rows the weights stay."""
    names, start = list(weights), np.array(list(weights.values()))
    t = rows.orderBy("k").limit(most).select("x", "label").toPandas()
    out = rows_of(names, start, t["x"], t["label"]) if len(t) else pd.DataFrame({"feature": names, "initial": start, "trained": start, "refined": start})
    return rows.sparkSession.createDataFrame(out, "feature string, initial double, trained double, refined double")


def tool_policies(rows: DataFrame, weights: dict[str, float], most: int = MOST_ROWS) -> DataFrame:
    """(tool_id, feature, initial, trained, refined) of each tool with rows of both labels, from at most ``most`` of them.

    Rows are first cut within sixteen hashed parts of a tool, so that no tool is ordered as a whole.
    """
    names, start = list(weights), np.array(list(weights.values()))
    part = rows.withColumn("part", F.substring("k", 1, 1))
    few = part.withColumn("i", F.row_number().over(Window.partitionBy("tool_id", "part").orderBy("k"))).where(F.col("i") <= most)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("tool_id").orderBy("k"))).where(F.col("i") <= most)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        if group["label"].nunique() < 2:
            return pd.DataFrame(columns=["tool_id", "feature", "initial", "trained", "refined"])
        out = rows_of(names, start, group["x"], group["label"])
        out.insert(0, "tool_id", group["tool_id"].iloc[0])
        return out

    return few.select("tool_id", "k", "label", "x").groupBy("tool_id").applyInPandas(fit, "tool_id string, feature string, initial double, trained double, refined double")
