"""Router, normalizer and update strategy against rows taken one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import flows


def test_router(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50), (3, 50)], "id int, x int")
    got = sorted(tuple(r) for r in flows.route(rows, {"odd": F.col("id") % 2 == 1, "big": F.col("x") > 10}).collect() if r["x"] is not None)
    assert got == [(1, 5, "odd"), (3, 50, "big"), (3, 50, "big"), (3, 50, "odd"), (3, 50, "odd")]
    assert [r["group"] for r in flows.route(rows, {"big": F.col("x") > 10}).where("x is null").collect()] == ["DEFAULT"]
    assert {r["group"] for r in flows.route(rows, {}).collect()} == {"DEFAULT"} and flows.route(rows.limit(0), {"a": F.lit(True)}).isEmpty()
    with pytest.raises(ValueError, match="new column"):
        flows.route(rows, {}, "x")


def test_normalizer(spark):
    rows = spark.createDataFrame([("a", 1, 2, None, "x", None, None), ("b", None, None, None, None, None, None)], "id string, q1 int, q2 int, q3 int, n1 string, n2 string, n3 string")
    made = {"q": ["q1", "q2", "q3"], "n": ["n1", "n2", "n3"]}
    assert sorted(tuple(r) for r in flows.normalize(rows, ["id"], made).drop("gk").collect()) == [("a", 1, 1, "x"), ("a", 2, 2, None)]
    whole = flows.normalize(rows, ["id"], made, keep_empty=True)
    assert whole.count() == 6 and whole.select("gk").distinct().count() == 2
    with pytest.raises(ValueError, match="same number"):
        flows.normalize(rows, ["id"], {"q": ["q1"], "n": ["n1", "n2"]})


@pytest.mark.parametrize("seed", range(3))
def test_update_strategy(spark, seed):
    rng = np.random.default_rng(seed)
    table = {int(k): f"t{k}" for k in rng.choice(20, 8, replace=False)}
    changes = [(None if rng.random() < 0.05 else int(rng.integers(20)), f"c{k}", k, None if rng.random() < 0.05 else int(rng.integers(5))) for k in range(150)]
    want, rejected = dict(table), []
    for key, value, k, flag in changes:
        if flag not in (0, 1, 2):
            rejected.append((k, "flagged"))
        elif key is None:
            rejected.append((k, "no key"))
        elif (flag == 0) == (key in want):
            rejected.append((k, "present" if flag == 0 else "absent"))
        elif flag == 2:
            del want[key]
        else:
            want[key] = value
    held = spark.createDataFrame([*table.items(), (None, "nameless")], "id int, v string")
    made = spark.createDataFrame([changes[k] for k in rng.permutation(150)], "id int, v string, at int, flag int")
    new, out = flows.apply_changes(held, made, ["id"], "flag", [F.col("at")])
    assert {tuple(r) for r in new.collect()} == {*want.items(), (None, "nameless")} and new.count() == len(want) + 1
    assert sorted((r["at"], r["reason"]) for r in out.collect()) == sorted(rejected)
    assert flows.apply_changes(held, made.limit(0), ["id"], "flag", [F.col("at")])[0].count() == held.count()
