"""Semantics that are easy to get wrong, on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from tableprep.functions import exprs
from tableprep.operators import (balance, encode, engineer, filters, fuzzy, impute, merge, outliers, profile, quality, roles,
                                 scale, select)
from tableprep.plans import charts, prepare
from tableprep.sources import history, io


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(df):
    return df.first().asDict()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    clean = roles.nan_to_null(df)
    assert one(profile.missing_counts(clean).select("missing"))["missing"] == 2
    assert profile.moments(clean, ["x"])["x"]["mean"] == 1.0


def test_null_keys_match_each_other(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(None, "c"), (2, "d")], "k int, y string")
    assert rows(merge.merge(a, b, "k", "k"), "k", "x", "y") == [(None, "b", "c")]
    out = merge.merge(a, b, "k", "k", "outer", indicator=True)
    assert rows(out, "k", "x", "y", "_merge") == sorted(
        [(None, "b", "c", "both"), (1, "a", None, "left_only"), (2, None, "d", "right_only")], key=repr)


def test_merge_names_and_validation(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "c", 3)], "k int, v string, m int")
    assert merge.merge(a, b, "k", "k").columns == ["k", "v", "n", "v_right", "m"]
    assert merge.merge(a, b, "k", "k", suffixes=("_left", "_right")).columns == ["k", "v_left", "n", "v_right", "m"]
    merge.merge(a, b, "k", "k", validate="many_to_one")
    with pytest.raises(ValueError):
        merge.merge(a, b, "k", "k", validate="one_to_one")
    with pytest.raises(ValueError):
        merge.merge(a, b, "missing", "k")
    with pytest.raises(ValueError):
        merge.merge(a, b, how="cross")
    assert merge.choose_keys(a, b, "first") == (["k"], ["k"])
    ids = a.withColumnsRenamed({"k": "row_id", "v": "x"}), b.withColumnsRenamed({"k": "other_id", "v": "y"})
    assert merge.choose_keys(*ids, "id") == (["row_id"], ["other_id"])


def test_not_equal_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert filters.filter_compare(df, "x", "!=", "1").count() == 2
    assert filters.filter_compare(df, "x", "==", 1).count() == 1
    with pytest.raises(ValueError):
        filters.filter_compare(df, "x", "~", 1)


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert profile.modes(df, ["c"]) == {"c": "a"}
    assert impute.fill_categories(df).filter("c = 'a'").count() == 3


def test_all_null_category_becomes_the_constant(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    assert rows(impute.fill_categories(df), "c") == [("Unknown",), ("Unknown",)]


def test_boolean_mode(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "b boolean")
    assert impute.fill_categories(df).filter("b").count() == 3


def test_flat_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0), (5.0, 400.0)], "flat double, x double")
    assert {r["column"]: r["outliers"] for r in profile.iqr_outlier_counts(df).collect()}["flat"] == 0
    capped = outliers.outliers(df, "iqr", "cap")
    assert rows(capped, "flat") == [(5.0,)] * 4
    assert rows(scale.scale(df, "standard"), "flat") == [(0.0,)] * 4
    assert rows(scale.scale(df, "minmax"), "flat") == [(0.0,)] * 4
    assert rows(scale.scale(df, "robust"), "flat") == [(0.0,)] * 4
    assert select.select_variance(df).columns == ["x"]
    r = {(c["x"], c["y"]): c["r"] for c in profile.correlation_matrix(df).collect()}
    assert r["flat", "x"] is None and r["flat", "flat"] is None and r["x", "x"] == 1.0


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert one(profile.shape(empty)) == {"rows": 0, "columns": 2}
    assert profile.describe_numeric(empty).first()["mean"] is None
    assert one(profile.duplicate_rows(empty))["duplicates"] == 0
    assert quality.quality_score(empty).first()["rows"] == 0
    assert charts.histogram(empty, "x").count() == 0
    assert rows(profile.correlation_matrix(empty), "r") == [(None,)]
    single = spark.createDataFrame([(3.0, "a")], "x double, c string")
    d = profile.describe_numeric(single).first()
    assert d["q50"] == 3.0 and d["std"] is None
    assert charts.histogram(single, "x").first()["n"] == 1


def test_nulls_stay_out_of_bins_and_caps(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    assert sum(r["n"] for r in charts.histogram(df, "x", 5).collect()) == 10
    assert sum(r["n"] for r in charts.multi_histogram(df, ["x"], 5).collect()) == 10
    assert outliers.outliers(df, "iqr", "cap").filter("x IS NULL").count() == 1
    assert outliers.outliers(df, "iqr", "remove").filter("x IS NULL").count() == 1
    assert engineer.quantile_bins(df, ["x"], 5).filter("x_binned IS NULL").count() == 1


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0]], "x double")
    assert rows(engineer.quantile_bins(df, ["x"], 5), "x", "x_binned") == [(1.0, 0)] * 8 + [(2.0, 0), (3.0, 1)] or \
        rows(engineer.quantile_bins(df, ["x"], 5), "x", "x_binned") == [(1.0, 0)] * 8 + [(2.0, 1), (3.0, 1)]


def test_quantile_bins_equal_pandas(spark):
    import numpy as np
    import pandas as pd
    x = np.round(np.random.default_rng(3).exponential(10, 500), 1)
    got = engineer.quantile_bins(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], 5).toPandas()
    want = pd.qcut(got["x"], q=5, labels=False, duplicates="drop")
    assert (got["x_binned"] == want).all()


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, c string")
    assert rows(encode.encode_label(df, "c"), "id", "c") == [(1, 1), (2, 0), (3, 3), (4, 2)]
    assert rows(encode.encode_ordinal(df, "c"), "id", "c") == [(1, 1.0), (2, 0.0), (3, None), (4, 2.0)]
    assert encode.encode_onehot(df, "c").columns == ["id", "c_a", "c_b", "c_c"]
    assert encode.encode_onehot(df, "c", drop_first=True).columns == ["id", "c_b", "c_c"]
    assert rows(encode.encode_onehot(df, "c").filter("id = 3"), "c_a", "c_b", "c_c") == [(0, 0, 0)]
    # three values: the binary method leaves the column alone
    assert encode.encode(df, "binary").columns == ["id", "c"]
    with pytest.raises(ValueError):
        encode.encode_binary(df, "c")
    wide = encode.encode_onehot(df, "c", form="vector")
    assert rows(wide.select("id", "c_onehot.size", "c_onehot.one"), "id", "size", "one") == [(1, 3, 1), (2, 3, 0), (3, 3, None), (4, 3, 2)]
    log = []
    encode.encode(df, "onehot", max_categories=2, log=log)
    assert log == ["c not encoded: 3 categories"]
    # the limit sends few-valued columns to one-hot and many-valued ones to label
    assert encode.encode(df, "label", max_categories=10).schema["c"].dataType.simpleString() == "string"
    assert encode.encode(df, "label", max_categories=2).schema["c"].dataType.simpleString() == "bigint"


def test_polynomial_names_in_order(spark):
    df = spark.createDataFrame([(2.0, 3.0, "t")], "a double, b double, c string")
    out = engineer.polynomial_features(df, 2)
    assert out.columns == ["c", "a", "b", "a^2", "a b", "b^2"]
    assert tuple(out.first()) == ("t", 2.0, 3.0, 4.0, 6.0, 9.0)


def test_scalers_use_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert rows(scale.scale(df, "standard"), "x") == [(-1.0,), (1.0,)]
    assert math.isclose(profile.moments(df, ["x"])["x"]["std"], math.sqrt(2))


def test_chi2_refuses_negative_features(spark):
    df = spark.createDataFrame([(-1.0, "a"), (2.0, "b")], "x double, y string")
    with pytest.raises(ValueError):
        select.chi2_scores(df, "y").collect()


def test_balance_refuses_what_is_no_class(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, y double")
    with pytest.raises(ValueError):
        balance.balance(df, "y", "smote", "id")


def test_find_column(spark):
    df = spark.createDataFrame([(1, 2)], "alpha int, `beta gamma` int")
    assert roles.find_column(df, "1") == "beta gamma"
    assert roles.find_column(df, "GAMMA") == "beta gamma"
    with pytest.raises(ValueError):
        roles.find_column(df, "delta")


def test_prepare_skips_a_step_that_cannot_run(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, c string")
    spec = prepare.PrepSpec(reduce="lda", select="kbest", scaling="minmax")
    with pytest.raises(ValueError):
        prepare.prepare(df, spec)
    out, log = prepare.prepare(df, spec, on_error="skip")
    assert out.count() == 3 and out.filter("x IS NULL OR c IS NULL").count() == 0
    assert any("selection skipped" in line for line in log)
    assert "x: nulls became the mean" in log and "c: nulls became the mode" in log


def test_groups_keep_null_apart(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("null", 5.0), ("null", 7.0), ("n", 1.0), ("n", 3.0)], "g string, v double")
    assert set(rows(charts.box(df, "v", "g"), "grp", "n", "median")) == {(None, 2, 1.5), ("null", 2, 6.0), ("n", 2, 2.0)}
    assert {r["grp"] for r in charts.kde(df, "v", "g").collect()} == {None, "null", "n"}
    assert {r["grp"] for r in charts.violin(df, "v", "g").collect()} == {None, "null", "n"}
    plan = charts.kde(df, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_density_of_many_groups_is_the_same(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 1.5).alias("v"))
    shape = lambda f: sorted((r["grp"], r["i"], round(r["x"], 6), round(r["density"], 9)) for r in f.collect())
    few = shape(charts.kde(df, "v", "g", 20))
    monkeypatch.setattr(charts, "DENSITY_GROUPS", 1)
    assert shape(charts.kde(df, "v", "g", 20)) == few
    # groups in chunks of about seven rows, and a few rows a batch
    monkeypatch.setattr(charts, "DENSITY_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert shape(charts.kde(df, "v", "g", 20)) == few
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_modes_and_samples_go_by_the_own_order(spark):
    df = spark.createDataFrame([(9,), (9,), (10,), (10,)], "n int")
    assert profile.mode_values(df, ["n"]).first()["mode"] == "9"
    long = spark.range(1, 200).withColumnRenamed("id", "n")
    assert profile.column_info(long, ["n"]).first()["samples"] == "1|2|3|4|5"


def test_balancing_keeps_rows_without_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 9 else None, float(i)) for i in range(12)], "id long, c string, x double")
    for method in ("undersample", "oversample", "smote"):
        out = balance.balance(df, "c", method, "id", k=1)
        assert out.filter("c IS NULL").count() == 3, method
    assert balance.balance_undersample(df, "c", "id").count() == 9


def test_fuzzy_knows_all_scripts(spark):
    left = spark.createDataFrame([("Москва",), ("東京",), ("!!!",), ("Café",)], "a string")
    right = spark.createDataFrame([("Москва!",), ("大阪",), ("???",), ("café",)], "b string")
    got = {(r["left_value"], r["right_value"]) for r in fuzzy.fuzzy_pairs(left, right, "a", "b", 80).collect()}
    assert got == {("Москва", "Москва!"), ("Café", "café")}
    best = {(r["left_value"], r["right_value"], r["score"]) for r in fuzzy.best_values(left, right, "a", "b", 80).collect()}
    assert best == {("Москва", "Москва!", 100), ("Café", "café", 100)}


def test_pie_names_the_rest(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "x string")
    assert rows(charts.pie(df, "x", n=1), "name", "share", "is_rest") == [("a", 0.5, False), ("other", 0.5, True)]
    assert charts.pie(df, "x").count() == 3


def test_history_takes_a_frame(spark, tmp_path):
    path = str(tmp_path / "h")
    entry = spark.createDataFrame([("a", 3, True, "", "{}", 2)], "action string, rows long, success boolean, message string, params string, columns int")
    history.history_append(spark, path, entry.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")))
    assert spark.read.parquet(path).first()["rows"] == 3


def test_auto_set_shows_all_columns(spark):
    df = spark.range(30).select("id", *[(F.col("id") * i).cast("double").alias(f"n{i}") for i in range(1, 6)],
                                (F.col("id") % 4).cast("string").alias("c"))
    names = {r["chart"] for r in charts.auto_set(df, ["id"]).select("chart").distinct().collect()}
    assert {f"density n{i}" for i in range(1, 6)} <= names and "left out" not in names
    few = charts.auto_set(df, ["id"], columns=2)
    assert {r["x"] for r in few.filter("chart = 'left out'").collect()} == {"n2", "n3", "n4", "n5"}


def test_step_orders_differ(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, c string")
    app, _ = prepare.prepare(df, prepare.PrepSpec(scaling="minmax", encode="onehot"))
    api, _ = prepare.prepare(df, prepare.api_spec(scaling="minmax", encode="label"))
    assert app.columns == ["x", "c_b", "c_c"]
    assert rows(api, "x", "c") == [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)]


def test_relative_time_and_bytes(spark):
    df = spark.createDataFrame([("2024-01-10 11:59:30",), ("2024-01-10 11:58:00",), ("2024-01-10 10:59:00",), ("2024-01-09 11:00:00",),
                                ("2024-01-05 12:00:00",), ("2023-12-01 00:00:00",)], "t string")
    out = df.select(exprs.relative_time(F.col("t").cast("timestamp"), F.lit("2024-01-10 12:00:00")).alias("s"))
    assert [r["s"] for r in out.collect()] == ["Just now", "2 minutes ago", "1 hour ago", "Yesterday", "5 days ago", "Dec 01, 2023"]
    sizes = spark.createDataFrame([(0,), (5,), (1024,), (1536,), (3 * 1024 ** 3,)], "b long")
    assert [r["s"] for r in sizes.select(exprs.human_bytes(F.col("b")).alias("s")).collect()] == \
        ["0 Bytes", "5 Bytes", "1 KB", "1.5 KB", "3 GB"]


def test_files_and_history(spark, tmp_path):
    import datetime as dt
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,b\noops,c\n3,\n")
    (tmp_path / "in" / "b.exe").write_text("no")
    status = {r["name"]: r["status"] for r in io.check_files(spark, str(tmp_path / "in")).collect()}
    assert status == {"a.csv": "ok", "b.exe": "bad_extension"}
    schema = spark.createDataFrame([], "x int, y string").schema
    good, bad = io.read_csv_with_rejects(spark, str(tmp_path / "in" / "a.csv"), schema)
    assert rows(good, "x", "y") == [(1, "b"), (3, None)]
    assert good.select("y").count() == 2 and bad.count() == 1
    log = str(tmp_path / "log")
    for i in range(12):
        history.history_append(spark, log, [{"action": f"step_{i}", "params": {"k": i}, "shape": (i, 2),
                                             "timestamp": dt.datetime(2024, 1, 1, 0, i)}])
    recent = history.history_recent(spark.read.parquet(log))
    assert [r["action"] for r in recent.collect()] == [f"step_{i}" for i in range(11, 1, -1)]


def test_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 7.0), (4, None)], "id long, x double").coalesce(1).write.parquet(path)

    def pushed(df):
        return df._jdf.queryExecution().executedPlan().toString()

    above = io.read_parquet(spark, path, [("x", ">", 5)])
    assert rows(above, "id", "x") == [(3, 7.0)] and "GreaterThan(x,5.0)" in pushed(above)
    assert rows(io.read_parquet(spark, path, [("x", "!=", 7)]), "id", "x") == [(1, 1.0), (2, None), (4, None)]
    whole = filters.filter_compare(io.read_parquet(spark, path), "id", "==", 3)
    assert whole.count() == 1 and "EqualTo(id,3)" in pushed(whole)
    narrow = filters.filter_compare(io.read_parquet(spark, path), "id", ">=", 2).select("id")
    assert "struct<id:bigint>" in pushed(narrow)


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1.0, "u", 2.0), (2.0, "v", 2.5), (None, "u", 9.0), (4.0, None, 1.0)], "`a.b` double, `c d` string, `x^2` double")
    assert {r["column"]: r["missing"] for r in profile.missing_counts(df).collect()} == {"a.b": 1, "c d": 1, "x^2": 0}
    assert profile.describe_all(df).count() == 3 and profile.nunique(df).count() == 3
    assert profile.iqr_outlier_counts(df).count() == 2 and profile.duplicate_rows(df).first()[0] == 0
    assert quality.constant_columns(df).count() == 0 and charts.multi_histogram(df, ["a.b"]).count() == 3
    out, log = prepare.prepare(df, prepare.PRESETS["smart_clean"])
    assert out.columns == ["a.b", "x^2", "c d_v"] and not any("skipped" in line for line in log)
    assert engineer.quantile_bins(df, ["a.b"], 2).columns[-1] == "a.b_binned"
