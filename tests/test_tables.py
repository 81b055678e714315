import math
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave.functions.dates import datetime_diff, datetime_filter, extract_datetime_parts, set_datetime_index
from tabweave.functions.transforms import bin_column, bin_counts, log_transform, normalize, polynomial_features
from tabweave.operators.aggregate import crosstab, describe_by_group, group_aggregate
from tabweave.operators.columns import (apply_mapping, clip_bounds, clip_outliers, convert_dtype, create_column,
                                        replace_values, select_dtypes, string_clean)
from tabweave.operators.encode import frequency_encode, label_encode, one_hot_encode, target_encode
from tabweave.operators.missing import fill_missing
from tabweave.operators.modeling import train_test_split
from tabweave.operators.profile import get_column_profile, get_statistics, missing_patterns, quality_report
from tabweave.operators.relational import concat_dataframes, melt_dataframe, merge_dataframes, pivot_table
from tabweave.operators.rows import (drop_duplicates, drop_missing, filter_rows, get_head, get_tail, sample_data,
                                     split_by_hash)
from tabweave.plans.workbook_writer import workbook_bytes
from tabweave.sources.files import load_csv, save_csv
from tabweave.sources.records import column_names, ends_inside, records
from tabweave.sources.workbooks import load_excel, part_cells, read_workbooks, sheet_parts, workbook_cells


def column(df, name, order="i"):
    return [r[name.strip("`")] for r in df.orderBy(order).collect()]


# --- sources ----------------------------------------------------------------

def test_csv_round_trip_and_types(spark, trips, tmp_path):
    save_csv(trips, str(tmp_path / "p"))
    back = load_csv(spark, str(tmp_path / "p"))
    assert dict(back.dtypes) == {**dict(trips.dtypes), "i": "bigint"}
    assert back.orderBy("i").drop("i").collect() == trips.orderBy("i").drop("i").collect()


def test_csv_tokens_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a;b;c;d;e\n1;"two\nlines";True;NA;1.5\n2;"a ""b""; c";False;n/a;nan\n'
                                    '3;None;true;;-2e3\n99999999999999999999;x;false;NULL;.5\n')
    df = load_csv(spark, str(tmp_path / "x.csv"), ";")
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean"), ("d", "double"), ("e", "double")]
    rows = df.orderBy("a").collect()
    assert [r.b for r in rows] == ["two\nlines", 'a "b"; c', None, "x"]
    assert [r.e for r in rows] == [1.5, None, -2000.0, 0.5] and {r.d for r in rows} == {None}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_with_line_breaks_are_read_in_parts(spark, tmp_path, end):
    r = np.random.RandomState(8)
    words = ['plain', 'two\nlines', '"quoted"', 'a,b', '\n\n', ',"\n', '5" pipe', "", 'é\n"\n', "x" * 900, ('long "\n' * 700)]
    rows = [(k, *(words[i] for i in r.randint(0, len(words), 2))) for k in range(400)]
    frame = pd.DataFrame(rows, columns=["k", "a", 'b\n"c'])
    folder = tmp_path / "in"
    folder.mkdir()
    frame[:250].to_csv(folder / "1.csv", index=False, lineterminator=end)
    # a quote that opens nothing, blank lines, and no line end at the end
    text = frame[250:].to_csv(index=False, lineterminator=end) + f'900,5" x,y{end}{end}   {end}901,"p","q"'
    (folder / "2.csv").write_text(text, newline="")
    want = pd.concat([pd.read_csv(folder / n, keep_default_na=False, dtype=str) for n in ("1.csv", "2.csv")])
    want = want[want.k.str.strip() != ""]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = records(spark, str(folder))
        assert found.where("not first").select(F.spark_partition_id()).distinct().count() > 10
        got = load_csv(spark, str(folder), infer=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    key = lambda x: int(x[0])
    assert sorted((tuple(x or "" for x in r) for r in got), key=key) == sorted(map(tuple, want.values.tolist()), key=key)
    assert got[0].__fields__ == list(want.columns)


def test_line_states():
    for line, out in [("a,b", False), ('"a', True), ('a"', False), ('""', False), ('x,"y', True), ('"a""', True),
                      ('5" x,"', True), ('"a"b,"c"', False)]:
        assert ends_inside(line, ",", False) is out, line
    assert ends_inside('end"', ",", True) is False and ends_inside('end",', ",", True) is False
    assert ends_inside('end","next', ",", True) is True and ends_inside('a""b', ",", True) is True
    assert ends_inside('a"b;"c', ";", True) is True and column_names("a,,a,\"b\nc\"", ",") == ["a0", "_c1", "a2", "b\nc"]


def test_workbooks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xlsx").write_bytes(workbook_bytes(
            ["id", "text & more", "x"], [[k * 10 + j, f"<{j}>" if j else None, j / 4] for j in range(4)], "Data"))
    df = load_excel(spark, str(tmp_path), "Data").orderBy("id")
    assert df.dtypes == [("id", "bigint"), ("text & more", "string"), ("x", "double")]
    assert [r.id for r in df.collect()] == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert df.first()[1] is None and df.collect()[2][1] == "<2>"
    with pytest.raises(Exception, match="no sheet named"):
        load_excel(spark, str(tmp_path), "Other")


def test_workbook_types_and_headers(spark, tmp_path):
    when = datetime(2021, 3, 4, 5, 6, 7)
    lines = [[1, when, "x", 1.0, True, "1", None, "NA"], [2, None, "y", 2.5, False, "2", None, 7],
             [3, datetime(1999, 12, 31), "", None, None, "n/a", None, None]]
    header = ["k", "at", None, "v", "v", "v", None, "mixed"]
    for share in (False, True):
        (tmp_path / f"{share}.xlsx").write_bytes(workbook_bytes(header, lines, share_strings=share))
    df = load_excel(spark, str(tmp_path)).orderBy("k")
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["k", "at", "Unnamed: 2", "v", "v.1", "v.2", "Unnamed: 6", "mixed"]
    assert rows[::2] == rows[1::2] == [
        (1, when, "x", 1.0, True, "1", None, None), (2, None, "y", 2.5, False, "2", None, 7),
        (3, datetime(1999, 12, 31), None, None, None, None, None, None)]
    assert [t for _, t in df.dtypes] == ["bigint", "timestamp_ntz", "string", "double", "boolean", "string", "double", "bigint"]
    (tmp_path / "other.xlsx").write_bytes(workbook_bytes(["k", "at", "named", "v", "v", "v", None, "mixed"], lines))
    with pytest.raises(ValueError, match="disagree"):
        load_excel(spark, str(tmp_path))


def test_one_large_workbook_in_many_tasks(spark):
    lines = [[k, f"name {k % 50} <&>", k / 8] for k in range(60_000)]
    content = workbook_bytes(["k", "name", "v"], lines, share_strings=True)
    parts = list(sheet_parts(content, size=100_000))
    assert len(parts) > 10 and sum(len(list(part_cells(*p[1:]))) for p in parts) == 3 + 180_000
    # the same without numbers at rows and cells
    bare = [(p[0], p[1], p[2], re.sub(rb' r="[A-Z]*[0-9]+"', b"", p[3]), *p[4:]) for p in parts]
    assert [list(part_cells(*p[1:])) for p in bare[:3]] == [list(part_cells(*p[1:])) for p in parts[:3]]
    files = spark.createDataFrame([("one.xlsx", content)], "path string, content binary")
    cells = workbook_cells(files)
    assert cells.select(F.spark_partition_id()).distinct().count() > 1
    got = read_workbooks(files)
    assert got.dtypes == [("k", "bigint"), ("name", "string"), ("v", "double")]
    assert got.agg(F.count("name"), F.sum("k"), F.sum("v")).first() == (60_000, 1799970000, 1799970000 / 8)


def test_workbooks_written_anew_each_time_they_are_read(spark):
    def build(batches):
        for _ in batches:
            # another order of rows in every run
            rows = [[k, f"text {k}"] for k in np.random.default_rng().permutation(300).tolist()]
            yield pd.DataFrame({"path": ["one.xlsx"], "content": [workbook_bytes(["k", "text"], rows, share_strings=True)]})

    files = spark.range(1, numPartitions=1).mapInPandas(build, "path string, content binary")
    got = read_workbooks(files)
    assert got.count() == 300 and got.where("text = 'text ' || k").count() == 300


# --- joins and reshaping ----------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_match_null_keys(spark, how):
    left = pd.DataFrame({"k": [1, 1, None, 2, 5], "v": list("abcde"), "only": range(5)}, dtype=object)
    right = pd.DataFrame({"k": [1, None, None, 3, 2, 2], "v": list("uvwxyz")}, dtype=object)
    as_spark = lambda p, s: spark.createDataFrame(p.where(p.notna(), None).values.tolist(), s)
    got = merge_dataframes(as_spark(left, "k int, v string, only int"), as_spark(right, "k int, v string"), ["k"], how)
    want = pd.merge(left, right, on="k", how=how)
    assert got.columns == list(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    clean = want.astype(object).where(want.notna(), None).values.tolist()
    assert sorted(map(list, got.collect()), key=key) == sorted(clean, key=key)


def test_join_errors(trips):
    with pytest.raises(ValueError, match="not found"):
        merge_dataframes(trips, trips, ["nope"])
    with pytest.raises(ValueError, match="join type"):
        merge_dataframes(trips, trips, ["i"], "cross")


def test_pivot_melt_concat(trips, spark):
    wide = {r.Depot: (r.bus, r.ferry, r.tram) for r in pivot_table(trips, ["Depot"], "Line", "Hours").collect()}
    assert wide == {"north": (1.625, None, 3.5), "mill": (8.0, None, 4.0), "quay": (8.0, 6.625, 9.25),
                    "hill": (None, 12.0, 10.5)}
    assert melt_dataframe(trips.drop("i"), ["Line", "Depot"]).count() == 34
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(3.5,), (4.5,)], "x double")
    assert sorted(r.x for r in concat_dataframes([a, b]).collect()) == [1.0, 2.0, 3.5, 4.5]
    side = concat_dataframes([a, b.limit(1)], 1, [["x"], ["x"]])
    assert side.columns == ["x", "x_1"] and side.count() == 2


def test_pivot_refuses_too_many_values(spark):
    with pytest.raises(ValueError, match="more than 1000"):
        pivot_table(spark.range(2000).withColumn("g", F.lit(1)).withColumn("v", F.lit(1.0)), ["g"], "id", "v")


# --- rows -------------------------------------------------------------------

def test_filters(trips):
    count = lambda *a, **k: filter_rows(trips, *a, **k).count()
    assert count("Load", ">", "120") == 5 and count("Depot", "==", "north") == 5
    assert count("Depot", "!=", "north") == 12 and count("Line", "isin", "bus, ferry") == 11
    assert count("Line", "contains", "r") == 11 and count("Depot", "contains", "^[mq]") == 7
    assert count("Line", "contains", "^t", literal=True) == 0 and count("Hours", "isin", "3.5,8") == 5
    with pytest.raises(ValueError, match="not a number"):
        filter_rows(trips, "Hours", "==", "four")


def test_large_integers_are_told_apart(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big - 1,), (big,), (5,), (None,)], "`k.id` long")
    values = lambda *a: sorted(r[0] for r in filter_rows(df, "k.id", *a).collect() if r[0] is not None)
    assert values("==", big) == values("==", str(big)) == values("isin", f"{big}, 7.5") == [big]
    assert values(">", "5.5") == values(">=", 5.5) == [big - 1, big] and values("<", "5.5") == values("<=", 5.5) == [5]
    assert values("==", 5.5) == [] and filter_rows(df, "k.id", "!=", 5.5).count() == 4
    assert values("<", 10**30) == [5, big - 1, big] and values("isin", "1.5") == []
    replaced = replace_values(df, "k.id", big, 7)
    assert replaced.schema["k.id"].dataType.typeName() == "long" and 7 in column(replaced, "`k.id`", "`k.id`")
    filled = fill_missing(df, ["k.id"], "value", "-1")
    assert filled.schema["k.id"].dataType.typeName() == "long" and -1 in column(filled, "`k.id`", "`k.id`")
    assert drop_missing(df, ["k.id"]).count() == 3


def test_integer_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for args, sign in ((("==", "7"), "EqualTo(id,7)"), (("isin", "7, 8"), "In(id, [7,8])"), ((">", 6.5), "GreaterThan(id,6)")):
        assert sign in filter_rows(df, "id", *args)._jdf.queryExecution().executedPlan().toString()


def test_duplicates_and_missing(trips):
    plain = trips.drop("i")
    assert drop_duplicates(plain).count() == 14 and drop_duplicates(plain, keep="none").count() == 12
    first = drop_duplicates(trips, ["Depot"], "first", ["i"])
    last = drop_duplicates(trips, ["Depot"], "last", ["i"])
    assert {r.Depot: r.i for r in first.collect()} == {"north": 0, "mill": 1, "quay": 3, None: 5, "hill": 7}
    assert {r.Depot: r.i for r in last.collect()} == {"north": 16, "mill": 10, "quay": 15, None: 13, "hill": 14}
    assert drop_missing(plain).count() == 12 and drop_missing(plain, ["Load"]).count() == 14
    assert drop_missing(plain, how="all").count() == 17
    with pytest.raises(ValueError, match="order_by"):
        drop_duplicates(trips, ["Depot"])


def test_head_tail_sample(trips, hot):
    assert column(get_head(trips, ["i"], 3), "i") == [0, 1, 2] and column(get_tail(trips, ["i"], 2), "i") == [15, 16]
    assert sample_data(trips, 50).count() == 17
    for n in (10, 1500):
        a, b = sample_data(hot, n, key=["id"]), sample_data(hot, n, key=["id"])
        assert a.count() == n and sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert {r.id for r in sample_data(hot, 1500, 1, ["id"]).collect()} != {r.id for r in a.collect()}


def test_copies_are_sampled_and_split_like_other_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    copies = [sample_data(df, 300, seed).where("v = -1").count() for seed in range(4)]
    assert all(60 < n < 140 for n in copies)
    train, test = train_test_split(df, "v", 0.2)
    assert test.count() == 600 and 150 < test.where("v = -1").count() < 250
    assert train.unionAll(test).groupBy("v").count().exceptAll(df.groupBy("v").count()).isEmpty()
    again = train_test_split(df.repartition(5), "v", 0.2)[1]
    assert again.groupBy("v").count().exceptAll(test.groupBy("v").count()).isEmpty()


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_outer_joins_keep_hot_keys(spark, how):
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 1).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("a"))
    right = spark.range(30).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") * 20).alias("k"), F.col("id").alias("b"))
    got = merge_dataframes(left, right, ["k"], how).toPandas()
    want = left.toPandas().merge(right.toPandas(), on="k", how=how)
    show = lambda p: sorted(tuple(-1 if v != v or v is None else v for v in r) for r in p[["k", "a", "b"]].itertuples(index=False))
    assert show(got) == show(want)


@pytest.mark.parametrize("n", [0, 1, 700, 1500, 2999, 3000, 4000])
def test_split_is_exact_with_a_third_copies(hot, n):
    rows = hot.select("g", "v", "w")
    chosen, rest = split_by_hash(rows, {None: n}, None, None, 42)
    assert chosen.count() == min(n, 3000) and rest.count() == 3000 - min(n, 3000)
    assert chosen.unionAll(rest).exceptAll(rows).isEmpty()


# --- repair -----------------------------------------------------------------

def test_fill_strategies(trips, trips_pd):
    fill = lambda *a, **k: column(fill_missing(trips, *a, **k), "Load")
    load = trips_pd.Load.astype(float)
    assert fill(["Load"], "value", "0")[5] == 0.0
    assert fill(["Load"], "mean")[5] == pytest.approx(load.mean()) and fill(["Load"], "median")[8] == load.median() == 120.0
    assert column(fill_missing(trips, ["Depot"], "mode"), "Depot")[13] == "north"
    assert fill(["Load"], "ffill", order_by=["i"]) == load.ffill().tolist()
    assert fill(["Load"], "bfill", order_by=["i"]) == load.bfill().tolist()
    grouped = fill(["Load"], "ffill", order_by=["i"], partition_by=["Line"])
    want = trips_pd.assign(Load=load).groupby("Line").Load.ffill()
    assert grouped == want.tolist() and grouped[5] == 310.5 and grouped[10] == 205.0
    # the way for keys too large for one task gives the same
    assert grouped == fill(["Load"], "ffill", order_by=["i"], partition_by=["Line"], small_group=0)
    first = fill(["Load"], "bfill", order_by=["i"], partition_by=["Depot"])
    assert first[5] == first[8] == 72.5 and first[10] is None
    with pytest.raises(ValueError, match="order_by"):
        fill_missing(trips, ["Load"], "ffill")
    with pytest.raises(ValueError, match="strategy"):
        fill_missing(trips, ["Load"], "guess")


def test_clip(trips, trips_pd):
    q1, q3 = trips_pd.Load.astype(float).quantile([0.25, 0.75])
    assert clip_bounds(trips, "Load") == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    low, high = clip_bounds(trips, "Load", "quantile", 0.1, 0.9)
    got = [v for v in column(clip_outliers(trips, "Load", "quantile", 0.1, 0.9), "Load") if v is not None]
    assert min(got) == pytest.approx(low) and max(got) == pytest.approx(high) and len(got) == 14


def test_text_repair(spark, trips):
    df = spark.createDataFrame([(0, "\t o'neil mc-donald x2y \n"), (1, None)], "i int, s string")
    assert column(string_clean(df, "s", ["strip", "title"]), "s") == ["O'Neil Mc-Donald X2Y", None]
    assert column(string_clean(df, "s", ["strip", "upper", "replace"], "-", "."), "s")[0] == "O'NEIL MC.DONALD X2Y"
    assert column(replace_values(trips, "Depot", "quay", "pier"), "Depot").count("pier") == 4
    assert column(replace_values(trips, "Hours", "8", "3.5"), "Hours").count(3.5) == 5


def test_mapping_types(spark, trips):
    to_numbers = apply_mapping(trips, "Line", {"tram": "1", "bus": "2", "ferry": "3"})
    assert dict(to_numbers.dtypes)["Line"] == "bigint" and column(to_numbers, "Line")[:4] == [1, 2, 2, 3]
    partly = apply_mapping(trips, "Line", {"bus": "1.5"})
    assert column(partly, "Line")[:2] == ["tram", "1.5"]
    assert column(apply_mapping(trips, "Hours", {"8": "3"}), "Hours")[:3] == [3.5, 3.0, None]
    many = apply_mapping(trips, "Depot", {**{f"c{k}": "x" for k in range(1500)}, "mill": "L"})
    assert column(many, "Depot")[:2] == ["north", "L"]


def test_types(spark, trips):
    assert select_dtypes(trips, include=["number"]).columns == ["i", "Hours", "Load"]
    assert select_dtypes(trips, exclude=["object"]).columns == ["i", "Hours", "Load"]
    text = spark.createDataFrame([(0, "1"), (1, "x"), (2, None)], "i int, s string")
    assert column(convert_dtype(text, ["s"], "int", errors="null"), "s") == [1, None, None]
    with pytest.raises(Exception, match="(?i)cast"):
        convert_dtype(text, ["s"], "int").collect()
    assert column(create_column(trips, "y", "Load / (Hours + 1e-5)"), "y")[0] == pytest.approx(120 / 3.50001)


# --- transforms -------------------------------------------------------------

def test_scaling_and_logs(trips, trips_pd, spark):
    scaled = column(normalize(trips, ["Hours"]), "Hours")
    want = (trips_pd.Hours.astype(float) - 0.5) / 11.5
    assert scaled[2] is None and [v for v in scaled if v is not None] == pytest.approx(want.dropna().tolist())
    z = [v for v in column(normalize(trips, ["Hours"], "standard"), "Hours") if v is not None]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    flat = spark.createDataFrame([(i, 4.0) for i in range(3)], "i int, c double")
    for method in ("minmax", "standard", "robust"):
        assert column(normalize(flat, ["c"], method), "c") == [0.0, 0.0, 0.0]
    odd = spark.createDataFrame([(0, -2.0), (1, 0.0), (2, 9.0)], "i int, x double")
    assert column(log_transform(odd, ["x"], "log10"), "Log_x")[:2] == [None, None]
    assert column(log_transform(odd, ["x"]), "Log_x") == [None, 0.0, pytest.approx(2.302585093)]


def test_polynomials(trips):
    got = polynomial_features(trips, ["Hours", "Load"])
    assert got.columns[-3:] == ["Hours^2", "Hours_Load", "Load^2"]
    assert column(got, "Hours_Load")[5] == 0.0 and column(got, "Hours^2")[0] == 12.25
    assert polynomial_features(trips, ["Hours", "Load"], 2, True).columns[-1] == "Hours_Load"


def test_bins(trips, trips_pd, spark):
    sizes = lambda **k: sorted((r["n"] for r in bin_counts(trips, "Load", 3, **k).collect()), reverse=True)
    load = trips_pd.Load.astype(float)
    assert sizes(method="uniform") == sorted(pd.cut(load, 3).value_counts(), reverse=True)
    assert sizes() == sorted(pd.qcut(load, 3).value_counts(), reverse=True)
    edges = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 5, 10, 11])], "i int, v double")
    got = column(bin_column(edges, "v", [0, 5, 10], "custom"), "v_binned")
    assert got == ["[0, 5]", "[0, 5]", "[0, 5]", "(5, 10]", None]
    with pytest.raises(ValueError, match="labels"):
        bin_column(edges, "v", [0, 5, 10], "custom", ["one"])
    with pytest.raises(ValueError, match="increase"):
        bin_column(edges, "v", [5, 0], "custom")


def test_dates(spark):
    days = spark.range(30).select(F.col("id").cast("int").alias("i"), F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("date"))
    df = days.withColumn("end", F.expr("date + interval 31 days"))
    assert set(column(datetime_diff(df, "end", "date", "d"), "d")) == {31.0}
    assert datetime_filter(df, "date", "2024-01-05", "2024-01-15").count() == 11
    assert datetime_filter(df, "date", "2024-01-20").count() == 11 and datetime_filter(df, "date", end="2024-01-10").count() == 10
    parts = extract_datetime_parts(df, "date", ["dayofweek", "weekofyear", "is_weekend"]).orderBy("i").collect()
    assert [r.date_dayofweek for r in parts[:7]] == [0, 1, 2, 3, 4, 5, 6] and parts[5].date_is_weekend == 1
    text = df.select("i", F.date_format("date", "dd.MM.yyyy").alias("date"))
    assert column(extract_datetime_parts(text, "date", ["day"]), "date_day")[:3] == [1, 2, 3]
    assert set_datetime_index(text, "date").columns == ["date", "i"]


# --- encodings, aggregates, profiles ----------------------------------------

def test_encodings(trips):
    assert one_hot_encode(trips, ["Depot"]).columns[-3:] == ["Depot_mill", "Depot_north", "Depot_quay"]
    assert len(one_hot_encode(trips, ["Line"], drop_first=False).columns) == 7
    share = column(frequency_encode(trips, ["Depot"]), "Depot")
    assert share[0] == pytest.approx(5 / 14) and share[1] == pytest.approx(3 / 14) and share[5] is None
    assert column(label_encode(trips, ["Depot"]), "Depot")[:8] == [2, 1, 1, 3, 2, None, 3, 0]
    train, test = trips.where("i < 3"), trips.where("Line = 'ferry'")
    coded = target_encode(test, ["Line"], "Hours", fit_on=train)
    assert column(coded, "Line") == [pytest.approx((3.5 + 8) / 2)] * 5


def test_aggregates(trips, trips_pd):
    known = trips_pd.astype({"Load": float}).groupby("Depot").Load
    means = {r.Depot: r.Load_mean for r in group_aggregate(trips, ["Depot"], "Load").collect()}
    assert means == pytest.approx(known.mean().to_dict())
    assert group_aggregate(trips, ["Depot"], "Load", keep_null_groups=True).count() == 5
    assert {r.Depot: r.Load_sum for r in group_aggregate(trips, ["Depot"], "Load", "sum").collect()} == known.sum().to_dict()
    assert {r.Depot: (r.bus, r.ferry, r.tram) for r in crosstab(trips, "Depot", "Line").collect()} == {
        "north": (2, 0, 3), "mill": (2, 0, 1), "quay": (1, 2, 1), "hill": (0, 1, 1)}
    row = describe_by_group(trips, "Depot", ["Load"]).where("Depot = 'north'").first()
    assert (row["count"], row["median"], row["max"]) == (5, 120.0, 120.0)


def test_profiles(trips, trips_pd, spark):
    load = trips_pd.Load.astype(float)
    p = get_column_profile(trips, "Load").first()
    assert (p.missing, p.unique, p.median) == (3, 13, 120.0) and p.std == pytest.approx(load.std())
    q = {r.column: r for r in quality_report(trips.drop("i")).collect()}
    assert q["Depot"].missing == 3 and q["Depot"].unique == 4 and q["Depot"].duplicate_rows == 3
    empty = quality_report(trips.where("i < 0")).collect()
    assert {r.missing_pct for r in empty} == {0.0} and {r.duplicate_pct for r in empty} == {0.0}
    s = {(r.column, r.stat): r.value for r in get_statistics(trips.select("Load", "Depot")).collect()}
    assert s["Load", "25%"] == pytest.approx(load.quantile(0.25)) and s["Depot", "freq"] == 5.0
    patterns = missing_patterns(trips, ["Hours", "Load", "Depot"]).collect()
    assert sorted(r.n_rows for r in patterns) == [1, 1, 1, 2, 12]


def test_profiles_of_odd_columns(spark):
    rows = [(0.0, "a", b"x", [1, None], None), (-0.0, "b", b"y", [1, None], None), (math.nan, None, b"x", None, None),
            (math.nan, "a", None, [2], None), (None, "a", b"x", [1, None], None), (math.nan, "a", None, [2], None)]
    df = spark.createDataFrame(rows, "`f.x` double, s string, b binary, l array<int>, n string")
    got = {r.column: (r.missing, r.unique) for r in quality_report(df).collect()}
    assert got == {"f.x": (1, 2), "s": (1, 2), "b": (2, 2), "l": (1, 2), "n": (6, 0)}
    one = quality_report(df).first()
    assert (one.n_rows, one.duplicate_rows, one.missing_pct) == (6, 1, pytest.approx(100 / 6))
    rough = {r.column: (r.missing, r.unique) for r in quality_report(df.select("s", "b"), approx=True).collect()}
    assert rough == {"s": (1, 2), "b": (2, 2)}
    stats = {(r.column, r.stat): r.value if r.text is None else r.text for r in get_statistics(df.select("s", "n")).collect()}
    assert stats == {("s", "count"): 5, ("s", "unique"): 2, ("s", "top"): "a", ("s", "freq"): 4, ("n", "count"): 0,
                     ("n", "unique"): 0, ("n", "top"): None, ("n", "freq"): None}
    assert get_statistics(df.select("s").limit(0)).where("stat = 'count'").first().value == 0
