"""Dense labels from bitmaps against counting by hand, and what the plan moves."""

import random

import pytest

from tessera.operators.label_bitmaps import relabelled

SCHEMA = "id long, x string"


def by_hand(labels, gone):
    left = sorted(x for x in labels if x not in gone)
    return {(i, f"x{old}") for i, old in enumerate(left)}, len(labels) - len(left)


@pytest.mark.parametrize("most", [0, 64_000_000])
def test_labels_with_gaps_below_zero_and_over_many_buckets(spark, most):
    r = random.Random(5)
    labels = sorted({r.randrange(-100_000, 400_000) for _ in range(3000)} | {-32769, -32768, -1, 0, 7, 8, 32767, 32768, 65535, 65536})
    gone = [x for x in labels if r.random() < 0.4]
    rows = spark.createDataFrame([(x, f"x{x}") for x in labels], SCHEMA).repartition(5)
    lost = spark.createDataFrame([(x,) for x in gone + gone[:9] + [999_999, None]], "other long")
    left, removed = relabelled(rows, lost, "id", most)
    wanted, n = by_hand(labels, set(gone))
    got = [tuple(x) for x in left.collect()]
    assert set(got) == wanted and len(got) == len(wanted) and removed.first()[0] == n


def test_empty_tables_all_gone_nulls_and_clashing_names(spark):
    none = spark.createDataFrame([], "id long")
    rows = spark.createDataFrame([(5, "x5"), (None, "lost"), (2, "x2")], SCHEMA)
    assert {tuple(r) for r in relabelled(rows, none, "id")[0].collect()} == {(0, "x2"), (1, "x5")}
    assert relabelled(rows, rows.select("id"), "id")[0].collect() == [] and relabelled(rows, rows.select("id"), "id")[1].first()[0] == 2
    assert relabelled(rows.limit(0), rows.select("id"), "id")[0].collect() == []
    clash = spark.createDataFrame([(3, 1, 2, 4), (1, 5, 6, 7)], "id int, bucket int, bits int, before int")
    left, _ = relabelled(clash, none, "id")
    assert {tuple(r) for r in left.collect()} == {(1, 1, 2, 4), (0, 5, 6, 7)} and left.schema == clash.schema


def test_rows_pass_through_no_exchange(spark):
    rows = spark.createDataFrame([(x, f"x{x}") for x in range(100)], SCHEMA)
    left, _ = relabelled(rows, rows.where("id < 10").select("id"), "id")
    above = []  # (indentation, line) of the operators over the current one
    for line in left._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        above = [x for x in above if x[0] < depth]
        assert not ("x#" in line and any("Exchange" in x[1] for x in above)), line
        above.append((depth, line))
    assert left.count() == 90
