import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import packing


@pytest.mark.parametrize("sizes", [[], [5], [2048, 2049, 4096, 0, None, -3], [1] * 300, [1025] * 9 + [1023] * 9, [700, 700, 700, 600, 100, 2000, 48]])
def test_edges(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n bigint").selectExpr("id", "n", "1 AS box", "2 AS size")
    got = packing.pack(df, "id", "n").toPandas()
    check(got, dict(enumerate(sizes)))


def check(got, sizes, capacity=2048):
    assert not got.duplicated(["id", "start"]).any()
    whole = {k: n for k, n in sizes.items() if n and n > 0}
    assert got.groupby("id")["size"].sum().to_dict() == whole
    if len(got):
        assert got.groupby("box")["size"].sum().max() <= capacity
    parts = got.groupby("id").size()
    assert all(parts[k] == 1 for k, n in whole.items() if n <= capacity)


def test_fill_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(packing, "SWEEP", 150)  # several ranges, so that what they leave over must meet
    sizes = np.random.default_rng(2).lognormal(6, 1, 600).astype(int).clip(1, 6000)
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "n": sizes}))
    got = packing.pack(df, "id", "n").toPandas()
    check(got, dict(enumerate(sizes.tolist())))
    assert got["box"].nunique() <= 1.03 * np.ceil(sizes.sum() / 2048)


def test_a_repeated_row_counts_once(spark):
    rows = [(1, 5000), (1, 5000), (2, 700), (2, 700), (2, 700), (3, 900), (3, 40)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, n bigint"), "id", "n").toPandas()
    check(got, {1: 5000, 2: 700, 3: 900})


def test_meetings_follow_the_stack():
    assert packing._meetings([(0, 0, 2), (1, 1, 1), (2, 3, 0)]) == [(1, 0, 0, 0, 1), (2, 0, 1, 0, 1), (2, 1, 0, 1, 1)]
