"""Stored moment states: merged parts against the profile of the whole."""

import math

import pytest

from tabweave.operators.profile import profile, with_positives
from tabweave.operators.states import merge_states, moment_states, profile_of_states, store_state, stored_states

COLS = ["steady", "far", "odd", "gaps"]


def rows(spark):
    made = [(7.3, 1e7 + (i * i) % 11, float((i * 37) % 101) ** 3 - 5e4 if i % 7 else 0.0,
             None if i % 3 else float("nan") if i % 2 else -0.0 if i % 4 else float(i), i) for i in range(500)]
    return spark.createDataFrame(made, "steady double, far double, odd double, gaps double, i long")


def table_of(found):
    return {r["col_name"]: r.asDict() for r in found.collect()}


def assert_same(merged, whole):
    assert merged.keys() == whole.keys()
    for name, row in whole.items():
        for field, value in row.items():
            found = merged[name][field]
            if isinstance(value, float):
                assert math.isclose(found, value, rel_tol=1e-7, abs_tol=1e-9), (name, field, found, value)
            else:
                assert found == value, (name, field, found, value)


@pytest.mark.parametrize("bias", ["population", "sample"])
def test_parts_of_any_size_add_up(spark, bias):
    df = rows(spark)
    parts = [df.where(c) for c in ("i < 3", "i = 3", "i between 4 and 100", "i > 100", "i < 0")]
    states = [moment_states(p, COLS) for p in parts]
    first = merge_states(states[0].unionByName(states[1]).unionByName(states[4]))
    rest = merge_states(states[2].unionByName(states[3]))
    merged = profile_of_states(merge_states(rest.unionByName(first)), bias=bias)
    assert_same(table_of(merged), table_of(with_positives(df, COLS, bias=bias)))


def test_no_rows_and_no_columns(spark):
    df = rows(spark)
    empty = moment_states(df.limit(0), COLS)
    merged = profile_of_states(merge_states(empty.unionByName(empty)))
    assert_same(table_of(merged), table_of(profile(df.limit(0), COLS)))
    assert profile_of_states(merge_states(moment_states(df.select(), []))).count() == 0


def test_a_stored_part_is_replaced_and_later_columns_count_their_rows(spark, tmp_path):
    df, folder = rows(spark), str(tmp_path / "states")
    store_state(moment_states(df.where("i < 200"), COLS[:2]), folder, "2024-01")
    store_state(moment_states(df, COLS), folder, "2024-02")
    store_state(moment_states(df.where("i >= 200"), COLS), folder, "2024-02")
    found = table_of(profile_of_states(merge_states(stored_states(spark, folder))))
    assert_same({c: found[c] for c in COLS[:2]}, table_of(with_positives(df, COLS[:2])))
    assert found["odd"]["n_rows"] == 300
    with pytest.raises(ValueError):
        store_state(moment_states(df, COLS), folder, "a/b")


def test_many_distinct_values_are_estimated(spark):
    df = spark.range(30_000).selectExpr("id * 1.5D as x", "id % 10 as few", "id % 11 as more")
    thirds = [moment_states(df.where(f"x % 3 = {i}")) for i in (0.0, 1.5)]
    found = table_of(profile_of_states(merge_states(thirds[0].unionByName(thirds[1]))))
    assert abs(found["x"]["unique_count"] - 30_000) < 2_000
    assert (found["few"]["is_binary"], found["more"]["is_binary"]) == (True, False)
    assert (found["few"]["unique_count"], found["more"]["unique_count"]) == (10, 11)
