"""Merged profiles of loads against dataframe models of the whole table."""

import numpy as np
import pandas as pd
import pytest

from insightspark.operators import profile_states as ps

SCHEMA = "id bigint, price double, name string, odd double"


@pytest.fixture(scope="module")
def loads(spark):
    chance = np.random.default_rng(3)
    frames = []
    for size, scale in ((3000, 1.0), (1, 5.0), (9000, 100.0)):
        frames.append(
            pd.DataFrame(
                {
                    "id": np.arange(size) + 10_000 * len(frames),
                    "price": np.where(chance.random(size) < 0.1, np.nan, chance.lognormal(2, 1, size) * scale),
                    "name": [None if x < 0.2 else f"n{int(x * x * 40)}" for x in chance.random(size)],
                    "odd": np.full(size, np.nan),
                }
            )
        )
    rows = [f.astype(object).where(f.notna(), None).values.tolist() for f in frames]
    return pd.concat(frames), [spark.createDataFrame([tuple(x) for x in r], SCHEMA).repartition(3) for r in rows]


def test_merged_states_are_the_whole_profile_within_bounds(spark, loads, tmp_path):
    frame, tables = loads
    folder = str(tmp_path / "states")
    for i in (2, 0, 1, 0):  # one load comes again
        ps.write_states(tables[i], f"load {i}", folder)
    states = ps.read_states(spark, folder)
    assert states.count() == 12
    found = {r.column: r for r in ps.merged_profile(states).collect()}
    for name in frame.columns:
        values, row = frame[name], found[name]
        assert row.null_count == values.isna().sum() and row.null_pct == round(values.isna().sum() / len(frame) * 100, 2)
        assert abs(row.unique_count - values.nunique()) <= 0.03 * values.nunique()
    for name in ("id", "price"):
        values, row = frame[name].dropna(), found[name]
        assert [row["count"], row["mean"], row["std"], row["min"], row["max"]] == pytest.approx(
            [len(values), values.mean(), values.std(), values.min(), values.max()], abs=0.0101
        )
        for p, q in ((0.25, row.p25), (0.5, row.p50), (0.75, row.p75)):
            assert (values < q - 0.01).mean() <= p + 0.01 and (values <= q + 0.01).mean() >= p - 0.01
    assert found["odd"]["count"] is None and found["odd"].p50 is None and found["odd"].unique_count == 0
    counts = frame["name"].value_counts()
    model = sorted(((k, int(v)) for k, v in counts.items()), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r.value, r.n) for r in ps.merged_top_values(states).orderBy("rank").collect()] == model


def test_order_of_loads_does_not_matter(spark, loads):
    _, tables = loads
    parts = [ps.load_states(t, str(i)) for i, t in enumerate(tables)]
    ways = [parts[0].unionByName(parts[1]).unionByName(parts[2]), parts[2].unionByName(parts[0]).unionByName(parts[1])]
    one, two = (sorted(map(tuple, ps.merged_profile(w).drop("p25", "p50", "p75").collect())) for w in ways)
    assert one == two


def test_columns_come_and_change_and_loads_may_be_empty(spark):
    first = ps.load_states(spark.createDataFrame([(1, "a"), (2, None)], "x int, y string"), "1")
    second = ps.load_states(spark.createDataFrame([(1.5, 3)], "x double, z int"), "2")
    empty = ps.load_states(spark.createDataFrame([], "x int, y string"), "3")
    found = {r.column: r for r in ps.merged_profile(first.unionByName(second).unionByName(empty)).collect()}
    assert found["x"].dtype == "float64" and found["x"]["count"] == 3 and found["x"].mean == 1.5
    assert (found["y"].null_count, found["z"].null_count) == (2, 2)
    assert found["z"].std is None and found["z"].p50 == 3.0
    assert ps.merged_top_values(empty).count() == 0
    assert ps.merged_profile(empty).where("null_count <> 0").count() == 0
