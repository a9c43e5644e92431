"""Scans and folds give the same result whether or not keys are split."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from worldstate.operators.boxes import point_box_pairs
from worldstate.operators.folds import chained_fold
from worldstate.operators.ordered import Ordered, last_row, number_in_order, with_segments

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; times are uneven, some values are missing."""
    rng = np.random.default_rng(7)
    n = 3000
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 200, n))
    pdf = pd.DataFrame(
        {"k": keys, "t": (rng.random(n) ** 3 * 1e6).astype("int64"), "i": np.arange(n), "v": rng.normal(size=n) * 10}
    )
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(F.col("i") % 5 != 0, F.col("v"))).cache()


def _scan(df, rows_per_task):
    return (
        Ordered(df, ["k"], ["t", "i"], rows_per_task)
        .lag("before", F.col("i"))
        .lead("after", F.col("i"))
        .last_known("known", F.col("v"))
        .running_max("top", F.col("i"))
        .row_number("n")
        .running_sum("total", F.col("i"))
        .result()
        .toPandas()
        .sort_values("i", ignore_index=True)
    )


def test_split_scan_equals_pandas(skewed):
    got = _scan(skewed, 50)
    want = skewed.toPandas().sort_values(["k", "t", "i"])
    g = want.groupby("k")
    want["before"], want["after"] = g["i"].shift(1), g["i"].shift(-1)
    want["known"], want["top"] = g["v"].ffill(), g["i"].cummax()
    want["n"], want["total"] = g.cumcount() + 1, g["i"].cumsum()
    want = want.sort_values("i", ignore_index=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)


def test_unsplit_scan_equals_split(skewed):
    pd.testing.assert_frame_equal(_scan(skewed, 10**6), _scan(skewed, 20))


SHAPES = {
    "outlier": "if(id = 0, -1000000000000, id)",
    "instant": "7L",
    "prefix": "concat('the same beginning ', lpad(string(id), 6, '0'))",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_segments_are_even(spark, shape):
    df = spark.range(6000).select(F.lit("a").alias("k"), F.expr(SHAPES[shape]).alias("t"), "id")
    few = df.filter("id < 20").withColumn("k", F.lit("b"))
    sizes = with_segments(df.union(few), ["k"], ["t", "id"], 200).groupBy("k", "_segment", "_segments").count().toPandas()
    hot = sizes[sizes.k == "a"]
    assert hot["count"].sum() == 6000 and hot["count"].max() <= 400 and len(hot) >= 25 and set(hot._segments) == {2}
    assert sizes[sizes.k == "b"][["_segment", "_segments", "count"]].values.tolist() == [[0, 1, 20]]


def test_any_number_of_keys_is_split(spark):
    df = spark.range(3000).select((F.col("id") % 30).alias("k"), F.col("id").alias("t"))
    cut = with_segments(df, ["k"], ["t"], 50)
    assert cut.filter("_segments = 2").count() == 3000 and cut.groupBy("k", "_segment").count().agg(F.max("count")).first()[0] <= 100


def test_scan_without_keys(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    out = Ordered(df, [], ["id"], 40).running_sum("s", F.col("v")).result().orderBy("id").toPandas()
    assert out["s"].tolist() == out["v"].cumsum().tolist()
    assert list(out.columns) == ["id", "v", "s"]


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    got = sorted((r["place"], r["v"]) for r in number_in_order(df, ["v"]).collect())
    assert [p for p, _ in got] == list(range(1, 1001)) and [v for _, v in got] == sorted(v for _, v in got)


def test_last_row(skewed):
    got = {r["k"]: r["i"] for r in last_row(skewed, ["k"], ["t", "i"]).collect()}
    want = skewed.toPandas().sort_values(["t", "i"]).groupby("k")["i"].last().to_dict()
    assert got == want


def _threshold(state, rows):
    marks = np.zeros(len(rows), dtype=bool)
    for i, v in enumerate(rows["i"].tolist()):
        if state is None or v - state >= 97:
            marks[i], state = True, v
    return state, {"mark": marks}


@pytest.mark.parametrize("rows_per_task", [10**6, 100, 15])
def test_fold_equals_sequential(skewed, rows_per_task):
    df = skewed.select("k", "t", "i")
    out = chained_fold(df, ["k"], ["t", "i"], _threshold, "mark boolean", rows_per_task).toPandas()
    assert len(out) == 3000
    for _, rows in out.sort_values(["k", "t", "i"]).groupby("k"):
        _, want = _threshold(None, rows)
        assert rows["mark"].tolist() == want["mark"].tolist()


def test_fold_that_never_forgets(spark):
    """A running total: every segment depends on all before it, the slowest case for guessing."""

    def step(state, rows):
        values = rows["i"].cumsum() + (state or 0)
        return int(values.iloc[-1]), {"s": values.to_numpy()}

    df = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    out = chained_fold(df, ["k"], ["i"], step, "s bigint", 60).orderBy("i").toPandas()
    assert out["s"].tolist() == out["i"].cumsum().tolist()


def test_point_box_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    points = pd.DataFrame({"p": range(300), "x": rng.normal(size=300) * 50, "y": rng.normal(size=300), "z": rng.normal(size=300) * 9})
    lo = rng.normal(size=(60, 3)) * 40
    size = np.abs(rng.normal(size=(60, 3))) * np.array([30, 5, 0.5])
    size[::7, 1] = 1e12  # unbounded axis
    size[::11, 0] = 1e12
    boxes = pd.DataFrame({"b": range(60)})
    for i, a in enumerate("xyz"):
        boxes[f"lo{a}"] = np.where(size[:, i] > 1e11, -5e11, lo[:, i])
        boxes[f"hi{a}"] = boxes[f"lo{a}"] + size[:, i]
    inside = None
    for a in "xyz":
        c = (F.col(f"lo{a}") <= F.col(a)) & (F.col(a) < F.col(f"hi{a}"))
        inside = c if inside is None else inside & c
    got = point_box_pairs(
        spark.createDataFrame(points), spark.createDataFrame(boxes), [F.col(a) for a in "xyz"],
        [F.col(f"lo{a}") for a in "xyz"], [F.col(f"hi{a}") for a in "xyz"], inside,
    )
    pairs = sorted((r["p"], r["b"]) for r in got.collect())
    want = sorted(
        (p.p, b.b) for p in points.itertuples() for b in boxes.itertuples()
        if all(getattr(b, f"lo{a}") <= getattr(p, a) < getattr(b, f"hi{a}") for a in "xyz")
    )
    assert pairs == want and want
