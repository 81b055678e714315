import math
import re
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.core import special
from tabweave.core.numeric import normal_cdf, pearson, sample_kurtosis, sample_skewness
from tabweave.core.quantile import grouped_stats, quantile_values
from tabweave.core.scan import carry_forward, row_numbers, running_totals


def test_tail_probabilities_match_closed_forms():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert special.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert special.chi2_upper(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert special.student_two_sided(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x), rel=1e-11)
        assert special.student_two_sided(x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-9)
        assert special.f_upper(x, 2, 7) == pytest.approx((1 + 2 * x / 7) ** -3.5, rel=1e-11)
    assert special.student_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, rel=1e-6)
    assert special.kolmogorov_upper(1.3581 / 1000, 1_000_000) == pytest.approx(0.05, abs=1e-3)


def test_normal_cdf_column(spark):
    xs = [-38.0, -9.0, -7.2, -3.0, -0.5, 0.0, 0.3, 1.96, 7.05, 7.1, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    assert np.allclose(got, want, rtol=1e-7, atol=1e-14)


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(pearson(F.col("a"), F.col("b"))).first()[0] is None
    assert df.agg(sample_skewness(F.col("a")), sample_kurtosis(F.col("a"))).first() == (None, None)


def test_moments_are_bias_adjusted(trips, trips_pd):
    skew, kurt = trips.agg(sample_skewness(F.col("Load")), sample_kurtosis(F.col("Load"))).first()
    load = trips_pd.Load.astype(float)
    assert skew == pytest.approx(load.skew(), abs=1e-9) and kurt == pytest.approx(load.kurt(), abs=1e-9)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("bound", [None, 10])
def test_running_totals(hot, keys, bound):
    counts = hot.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counts, ["v"], {"before": "n"}, keys, rows_bound=bound).toPandas().sort_values([*keys, "v"])
    sums = (got.groupby(keys).n if keys else got.n).cumsum() - got.n
    assert (got.before == sums).all() and len(got) == counts.count()


def test_running_totals_descending(hot):
    counts = hot.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = running_totals(counts, ["v"], {"above": "n"}, descending=True).toPandas().sort_values("v", ascending=False)
    assert (got.above == got.n.cumsum() - got.n).all()


def test_row_numbers_are_consecutive_despite_ties(hot):
    got = row_numbers(hot, [F.col("v").asc()], "i", 5).toPandas().sort_values("i")
    assert got.i.tolist() == list(range(5, 3005)) and got.v.is_monotonic_increasing
    assert sorted(got.id) == list(range(3000))


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_carry_forward_over_slots(hot, keys):
    got = carry_forward(hot, ["w"], [F.col("id").asc()], keys).toPandas().set_index("id").sort_index().w
    raw = hot.toPandas().set_index("id").sort_index()
    want = raw.groupby(keys).w.ffill() if keys else raw.w.ffill()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_carry_forward_keeps_leading_nulls_and_null_keys(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 5.0), (3, "a", None), (4, None, None)],
                               "i int, k string, v double")
    got = {r.i: r.v for r in carry_forward(df, ["v"], [F.col("i").asc()], ["k"]).collect()}
    assert got == {1: None, 2: 5.0, 3: None, 4: 5.0}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_scans_carry_values_over_batches(spark, batch):
    """Types, null and NaN keys, pieces that end and begin anywhere; sums of whole numbers stay exact."""
    r = np.random.RandomState(9)
    n = 700
    rows = [(i, [None, "a", "b"][r.randint(3)], [math.nan, 1.5, None][r.randint(3)], int(r.randint(-3, 9)) + 2**60 * (i % 97 == 0),
             None if r.rand() < 0.4 else float(r.randint(50)), None if r.rand() < 0.5 else f"s{i}",
             None if r.rand() < 0.5 else [i, None], None if r.rand() < 0.5 else Decimal(i) / 4) for i in range(n)]
    df = spark.createDataFrame(rows, "i int, k string, f double, m long, v double, s string, l array<int>, d decimal(10,2)").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        filled = carry_forward(df, ["v", "s", "l", "d"], [F.col("i").asc()], ["k", "f"]).collect()
        sums = running_totals(df, ["i"], {"sm": "m", "sv": "v", "sd": "d"}, ["k", "f"]).collect()
        plain = running_totals(df, ["i"], {"sm": "m", "sv": "v"}, ["k", "f"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last, total = {}, {}
    want_fill, want_sum = {}, {}
    for row in rows:
        key = (row[1], str(row[2]))
        last[key] = tuple(new if new is not None else old for new, old in zip(row[4:], last.get(key, (None,) * 4)))
        want_fill[row[0]] = last[key]
        want_sum[row[0]] = total.get(key, (0, 0.0, Decimal(0)))
        total[key] = tuple(a + (b or 0) for a, b in zip(want_sum[row[0]], (row[3], row[4], row[7])))
    assert {x.i: (x.v, x.s, x.l, x.d) for x in filled} == want_fill
    assert {x.i: (x.sm, x.sv, x.sd) for x in sums} == want_sum
    assert {x.i: (x.sm, x.sv) for x in plain} == {i: v[:2] for i, v in want_sum.items()}


@pytest.mark.parametrize("scan", ["sum", "fill", "number"])
def test_rows_move_once_in_a_scan(hot, scan):
    """Behind the sorted slots only summaries are exchanged."""
    rows = hot.withColumn("payload", F.col("id").cast("string"))
    if scan == "sum":
        out = running_totals(rows, ["id"], {"t": "id"}, ["g"])
    elif scan == "fill":
        out = carry_forward(rows, ["w"], [F.col("id").asc()], ["g"])
    else:
        out = row_numbers(rows, [F.col("v").asc()], "n")
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = plan.split("\n\n")
    assert not [x for x in nodes if re.match(r"\(\d+\) Exchange", x.strip()) and "payload" in x]
    assert [x for x in nodes if "payload" in x]


PROBS = [0.0, 0.01, 1 / 3, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("parts, fetched", [(1024, 20_000), (2, 0), (7, 10)])
def test_quantiles_by_scanning(hot, parts, fetched):
    got = quantile_values(hot, {"v": PROBS, "w": PROBS}, parts, fetched)
    pdf = hot.toPandas()
    assert np.allclose(got["v"], np.quantile(pdf.v, PROBS), rtol=1e-12)
    assert np.allclose(got["w"], np.quantile(pdf.w.dropna(), PROBS), rtol=1e-12)


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(float(x), None, 7.0) for x in (1e308, -1e308, 5e-324, 0.0, 3.0)] + [
        (math.inf, None, 7.0), (-math.inf, None, 7.0), (math.nan, None, None)], "a double, b double, c double")
    got = quantile_values(df, {"a": [0.0, 0.5, 4 / 6, 1.0], "b": [0.5], "c": [0.1, 0.9]}, 4, 0)
    assert got == {"a": [-math.inf, 5e-324, 3.0, math.inf], "b": None, "c": [7.0, 7.0]}


@pytest.mark.parametrize("small, tiny, targets", [(10**6, 10**4, 200), (10**6, 1, 200), (10**6, 1, 0), (1, 1, 0)])
def test_grouped_quantiles_on_every_path(hot, monkeypatch, small, tiny, targets):
    import tabweave.core.quantile as q
    monkeypatch.setattr(q, "SMALL_ROWS", 0)
    monkeypatch.setattr(q, "TINY_DISTINCT", tiny)
    monkeypatch.setattr(q, "SCANNED_TARGETS", targets)
    got = grouped_stats(hot, ["g"], [F.count("v").alias("n")], {"v": [0.25, 0.5], "w": [0.9]}, small).toPandas()
    want = hot.toPandas().groupby("g")
    got = got.set_index("g").sort_index()
    assert (got.n == want.v.count()).all()
    assert np.allclose(np.array(got.q_v.tolist())[:, 1], want.v.median())
    assert np.allclose(np.array(got.q_v.tolist())[:, 0], want.v.quantile(0.25))
    assert np.allclose([x[0] for x in got.q_w], want.w.quantile(0.9))


def test_brackets_read_the_group_once(spark):
    """A filter pushed below the group's number would repeat its cases in every bracket."""
    from tabweave.core import quantile

    df = spark.range(100).selectExpr("CASE WHEN id % 3 <=> 0 THEN 0 WHEN id % 3 <=> 1 THEN 1 END AS _g", "cast(id as double) AS _c0")
    cells = [("CASE WHEN _g = 0 AND _c0 BETWEEN 0D AND 50D THEN 0 WHEN _g = 1 AND _c0 BETWEEN 0D AND 99D THEN 1 END", "_c0")]
    rows = quantile._in_brackets(df, cells)
    counted = rows.groupBy("b", quantile._part([(0.0, 50.0), (0.0, 99.0)], 4).alias("part")).agg({"x": "count"})
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("<=> 0)") == 1
    assert rows.where("b is not null").count() == 17 + 33 and rows.where("b is null and x is not null").count() == 0
    got = {(r.b, r.part): r["count(x)"] for r in counted.collect() if r.b is not None}
    assert got == {(0, 0): 5, (0, 1): 4, (0, 2): 4, (0, 3): 4, (1, 0): 8, (1, 1): 9, (1, 2): 8, (1, 3): 8}
