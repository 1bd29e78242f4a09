"""Ordered steps and quantiles against brute force, with hot series and ties."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins
from tidewatch.operators.ordered import Ordered
from tidewatch.operators.quantiles import exact_quantiles, exact_ranks, from_ordered_bits, with_ordered_bits


def series(rows, hot, seed):
    """(key, ts, id, value): `hot` of the rows share one key; some times repeat; some keys are null."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.2 else rng.randint(-50, 50)
        out.append((key, rng.randint(0, rows // 3), i, value))
    return out


def brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for rs in groups.values():
        rs.sort(key=lambda r: (r[1], r[2]))
        total, before = None, None
        for i, r in enumerate(rs):
            if r[3] is not None:
                total = (total or 0) + r[3]
            prev = [rs[i - j][2] if i >= j else None for j in range(1, n + 1)]
            later = next((x[3] for x in rs[i + 1 :] if x[3] is not None), None)
            out[r[2]] = (prev, total, before, later)
            if r[3] is not None:
                before = r[3]
    return out


@pytest.mark.parametrize(("width", "hot"), [(None, 0.35), (0.5, 0.35), (3, 0.35), (50, 0.35), (3, 1.0)])
def test_steps_match_brute_force(spark, width, hot):
    rows = series(600, hot, seed=3)
    df = spark.createDataFrame(rows, "key string, ts bigint, id bigint, value bigint")
    got = (
        Ordered(df, ["key"], ["ts", "id"], width)
        .lag(["id"], 3)
        .running_sum(F.col("value"), "total")
        .nearest_known(F.col("value"), "before")
        .nearest_known(F.col("value"), "later", after=True)
        .result()
        .collect()
    )
    want = brute(rows, 3)
    assert len(got) == len(rows)
    for r in got:
        prev = [r[f"_prev{i}"].id if r[f"_prev{i}"] else None for i in (1, 2, 3)]
        assert (prev, r.total, r.before, r.later) == want[r.id]


def test_no_key_and_label_order(spark, narrow):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    got = Ordered(df, [], ["x"]).running_sum(F.lit(1), "n").result().collect()
    assert all(r.n == r.x + 1 for r in got)
    rows = [(f"c{i % 3}", i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, ts bigint, v double").withColumn("k", F.lit("p"))
    got = Ordered(df, ["k"], ["label", "ts"]).lag(["label", "ts"]).result().collect()
    order = sorted(rows)
    before = {b[:2]: a[:2] for a, b in zip(order, order[1:])}
    for r in got:
        assert (tuple(r._prev1) if r._prev1 else None) == before.get((r.label, r.ts))


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0] * 1000,
        [float(i) for i in range(-700, 900)],
        [1e9 + i / 1000 for i in range(2000)] + [0.0, 1e15],
        [random.Random(1).lognormvariate(0, 4) * random.Random(i).choice([-1, 1]) for i in range(3000)],
        [0.0, 1e-12, 2e-12, -1e-12, 3.0, 3.0, 3.0, float("inf")],
        [1e9 + i * 1e-6 for i in range(4000)] + [1e300],  # a dense cluster and one outlier
    ],
)
def test_quantiles_are_exact(spark, values):
    probs = [0, 0.0001, 0.25, 0.5, 0.95, 0.9999, 1]
    rows = [("g", v) for v in values] + [("h", 1.0), ("h", None), ("h", float("nan")), ("h", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got["g"].n == len(values)
    finite = [v for v in values if not math.isinf(v)]
    if len(finite) == len(values):
        want = np.quantile(values, probs)
        assert np.allclose(got["g"].q, want, rtol=1e-12, atol=1e-12)
    else:
        assert got["g"].q[3] == pytest.approx(np.quantile(values, 0.5))
        assert got["g"].q[6] == math.inf
    assert got["h"].n == 2 and got["h"].q[3] == 2.5
    one = exact_quantiles(df.where("g = 'h'"), [], "v", [0.5]).collect()
    assert one[0].q == [2.5]


def test_bits_are_in_the_order_of_doubles(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf")]
    for k in range(-1074, 1024, 7):
        values += [2.0**k, math.nextafter(2.0**k, math.inf), -math.nextafter(2.0**k, 0)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    df = with_ordered_bits(df, "v", "bits")

    def bits(v):
        raw = struct.unpack("<q", struct.pack("<d", v + 0.0))[0]
        return raw if raw >= 0 else -(raw & (1 << 63) - 1) - 1

    rows = df.withColumn("back", from_ordered_bits(F.col("bits"))).collect()
    assert all(r.bits == bits(r.v) and r.back == r.v for r in rows)


def test_columns_are_ranked_together(spark, monkeypatch):
    rows = [(["g", None][i % 2], float(i * i), None if i % 5 else -float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(3)
    for most in (joins.BROADCAST_ROWS, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = {(r.g, r._col): r for r in exact_ranks(df, ["g"], ["a", "b"], [0.1, 0.5]).collect()}
        for g in ("g", None):
            for i in (0, 1):
                values = [r[1 + i] for r in rows if r[0] == g and r[1 + i] is not None]
                assert got[g, i].n == len(values) and np.allclose(got[g, i].q, np.quantile(values, [0.1, 0.5]))


def test_rows_are_neither_moved_for_ranks_nor_read_to_build(spark, tmp_path):
    """Ranks shuffle counts only; an ordered frame is built without a job and reads its input once."""
    spark.range(50_000).selectExpr("id", "cast(id % 3 as string) as k", "rand(7) as v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("== Initial")[0].splitlines() if " Exchange hashpartitioning" in x]
    assert exchanges and "SortMergeJoin" not in plan
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    steps = Ordered(df, ["k"], ["id"]).lag(["v"]).running_sum(F.col("v"), "total").result()
    assert len(tracker.getJobIdsForGroup()) == before
    steps.collect()
    plan = steps._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_bits_are_computed_once_and_skip_nan(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),), (-1.5,)], "v double")
    rows = with_ordered_bits(df, "v").where("_bits is not null")
    assert [r.v for r in rows.collect()] == [1.5, -1.5]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG2(") == 0 and plan.count("doubleToLongBits") == 1
