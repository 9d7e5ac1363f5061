"""Operators without an SQL twin: properties that must hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.operators import balance, forest, impute, outliers, profile, reduce, select
from tableprep.plans import charts, prepare, report, routing
from tableprep.sources import inventory


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(10, 3, 3000), rng.normal(0, 1, 3000)
    pdf = pd.DataFrame({"a": a, "b": b, "c": 2 * a - 5 * b + 1})
    return pdf, spark.createDataFrame(pdf).withColumn("id", F.monotonically_increasing_id()).repartition(6)


def test_iterative_imputation_recovers_a_linear_rule(linear):
    _, df = linear
    holed = df.withColumn("c0", F.col("c")).withColumn("c", F.when(F.xxhash64("a") % 9 != 0, F.col("c"))) \
        .withColumn("b", F.when(F.xxhash64("b") % 11 != 0, F.col("b")))
    out = impute.impute_iterative(holed, ["a", "b", "c"])
    assert out.filter("b IS NULL OR c IS NULL").count() == 0
    gap = out.filter(F.xxhash64("a") % 9 == 0).select(F.avg(F.abs(F.col("c") - F.col("c0")))).first()[0]
    assert gap < 2.0  # the mean alone is off by about 6
    again = impute.impute_iterative(holed.repartition(2), ["a", "b", "c"])
    diff = out.join(again.withColumnRenamed("c", "c2"), "id").select(F.max(F.abs(F.col("c") - F.col("c2")))).first()[0]
    assert diff < 1e-3


def test_isolation_forest_does_not_depend_on_partitions(spark):
    df = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"))
    flags = [{r["id"] for r in forest.isolation_flags(df.repartition(n), ["x"], 0.05, trees=20).filter("_outlier").collect()} for n in (1, 4, 16)]
    assert flags[0] and flags[0] == flags[1] == flags[2]


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (3000, 2))
    x[:30] += 12
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "x": x[:, 0], "y": x[:, 1]}))
    flagged = forest.isolation_flags(df, ["x", "y"], contamination=0.05)
    assert flagged.filter("_outlier").count() == pytest.approx(150, abs=2)
    assert flagged.filter("_outlier AND id < 30").count() == 30
    kept = outliers.outliers(df, "isolation", "remove", ["x"], contamination=0.02)
    assert kept.count() == pytest.approx(2940, abs=2)


def test_expected_path():
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert forest.expected_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_power_transform_finds_the_likeliest_exponent(spark):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(0, 1, 2000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert abs(outliers.fit_power(df, ["x"], "box-cox")["x"]) < 0.1
    lam = outliers.fit_power(df, ["x"])["x"]

    def likelihood(v):
        y = np.log1p(x) if v == 0 else ((x + 1) ** v - 1) / v
        return -len(x) / 2 * np.log(y.var()) + (v - 1) * np.log1p(x).sum()

    assert all(likelihood(lam) >= likelihood(lam + d) - 1e-6 for d in (-0.05, -0.01, 0.01, 0.05))
    out = outliers.power_transform(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(out[0]) < 1e-9 and out[1] == pytest.approx(1)


def test_reductions_match_numpy(linear):
    pdf, df = linear
    x = pdf[["a", "b", "c"]].to_numpy()
    for wide in (6, 0):
        old, reduce.EXPRESSION_COLUMNS = reduce.EXPRESSION_COLUMNS, wide
        try:
            p = reduce.reduce_pca(df.drop("id"), 2).agg(F.var_pop("PCA_1"), F.var_pop("PCA_2"), F.avg("PCA_1")).first()
            s = reduce.reduce_svd(df.drop("id"), 2).agg(F.sum(F.col("SVD_1") ** 2), F.sum(F.col("SVD_2") ** 2)).first()
        finally:
            reduce.EXPRESSION_COLUMNS = old
        values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / len(x)
        assert np.allclose(p[:2], values[:2]) and abs(p[2]) < 1e-8
        assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:2] ** 2)


def test_lda_separates_classes(spark):
    rng = np.random.default_rng(4)
    c = rng.integers(0, 3, 3000)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(c * 4.0, 1), "y": rng.normal(0, 50, 3000), "k": [f"k{i}" for i in c]}))
    out = reduce.reduce_lda(df, "k", 5)
    assert out.columns == ["k", "LDA_1", "LDA_2"]
    between = out.groupBy("k").agg(F.avg("LDA_1").alias("m"), F.var_samp("LDA_1").alias("v")).toPandas()
    assert between["m"].max() - between["m"].min() > 7 and np.allclose(between["v"], 1, atol=0.2)


def test_importances_drop_noise(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 1500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "noise": rng.normal(0, 1, 1500), "y": np.where(x > 0, "p", "n")}))
    found = select.importances(df, "y", trees=20)
    assert sum(found.values()) == pytest.approx(1) and found["x"] > 0.8
    assert select.select_importance(df, "y", threshold=0.5, trees=20).columns == ["x", "y"]


def test_smote_points_lie_between_neighbours(spark):
    df = spark.range(500).select("id", (F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 10 == 0, "rare").otherwise("many").alias("c"))
    made = balance.balance_smote(df, "c", "id").filter("id IS NULL")
    assert made.count() == 400
    lo, hi = made.agg(F.min("x"), F.max("x")).first()
    assert 0 <= lo and hi <= 40


def test_full_preset(spark, linear):
    _, df = linear
    data = df.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a"))).withColumn("kind", F.when(F.col("id") % 2 == 0, "u").otherwise("v"))
    out, log = prepare.prepare(data.drop("id"), prepare.PRESETS["full"])
    assert out.columns == ["a", "b", "c", "kind_v"] and not any("skipped" in line for line in log)
    low, high = out.agg(F.min("a"), F.max("a")).first()
    assert (low, high) == (0.0, 1.0)


def test_every_chart_type_runs(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"),
                                 F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"))
    for kind in ("auto hist histogram distplot box violin scatter scatter3d line3d line area bar barh bar_polar count countplot pie sunburst "
                 "treemap funnel waterfall surface heatmap correlation density_contour contour jointplot kde kdeplot pairplot catplot").split():
        assert charts.chart(df, kind, n=20 if kind == "waterfall" else None).count() > 0, kind
    assert charts.chart(df, "scatter", "x", "y", color="c").columns == ["id", "x", "y", "c"]
    with pytest.raises(ValueError):
        charts.chart(df, "mesh")
    assert charts.auto_one(df.select("id"), ["id"])[0] == "histogram"
    assert charts.auto_one(df.select("c"), ["c"])[0] == "bar"
    assert charts.auto_one(df, ["id"], rule="api")[0] == "scatter"


def test_routing(spark):
    df = spark.createDataFrame([(1, "Please clean the data with KNN, z-score scaling and label encoding"),
                                (2, "Show all charts and a summary"), (3, None)], "id int, text string")
    flags = {r["id"]: r for r in routing.route_requests(df, "text").collect()}
    assert flags[1]["is_preprocess"] == 1 and flags[2]["is_plot_all"] == 1 and flags[2]["is_summary"] == 1 and flags[3]["is_plot"] == 0
    one = routing.route_prep_config(df, "text").filter("id = 1").first()
    assert (one["missing"], one["scaling"], one["outlier"], one["encode"]) == ("knn", "standard", "zscore", "label")


def test_inventory_and_report(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t1"))
    spark.range(5).selectExpr("id", "CASE WHEN id > 2 THEN 'a' END AS c").coalesce(1).write.parquet(str(tmp_path / "t2"))
    found = inventory.dataset_inventory(spark, {"t1": str(tmp_path / "t1"), "t2": str(tmp_path / "t2")})
    facts = {r["name"]: r for r in found.collect()}
    assert facts["t1"]["rows"] == 10 and facts["t2"]["missing"] == {"id": 0, "c": 3} and facts["t1"]["bytes"] > 0
    spark.range(0).write.parquet(str(tmp_path / "t3"))
    empty = inventory.dataset_inventory(spark, {"t3": str(tmp_path / "t3")}).first()
    assert facts["t2"]["first_row"] == '{"id":0,"c":null}' and empty["first_row"] is None and empty["rows"] == 0
    inventory.write_inventory(found, str(tmp_path / "inv"))
    assert spark.read.parquet(str(tmp_path / "inv")).count() == 2
    lines = report.report_lines(report.report_table({"t2": spark.read.parquet(str(tmp_path / "t2"))})).orderBy("part").collect()
    assert lines[0]["text"] == "# 1 dataset(s)" and "5 rows in 2 columns" in lines[1]["text"] and "3 empty cells (c=3)" in lines[1]["text"]


def test_snapshot_shows_first_rows(spark):
    df = spark.createDataFrame([(2, None, [1]), (1, "b", [2]), (1, "a", None), (3, "z", [4])], "k int, c string, l array<int>")
    got = {r["column"]: r["first"] for r in profile.snapshot(df, order_by=["k"]).collect()}
    assert got == {"k": ["1", "1", "2"], "c": ["a", "b", None], "l": [None, "[2]", "[1]"]}
    assert [r["first"] for r in profile.first_values(df.filter("k > 9"), ["k"]).collect()] == [[]] * 3


def test_facts_share_one_scan(spark):
    df = spark.createDataFrame([(1, 2.0, "ab"), (2, None, None), (3, 4.0, "c")], "a long, b double, c string")
    facts = profile.Facts(df).ask_missing().ask_bytes().ask_moments(["a", "b"])
    assert facts.rows == 3 and facts["missing", "b"] == 1 and facts["bytes", "c"] == 3 and facts["mean", "a"] == 2.0
    assert profile.moments(df, ["a", "b"], facts)["b"]["max"] == 4.0
    assert {r["column"]: r["missing"] for r in profile.missing_counts(df, facts=facts).collect()} == {"a": 0, "b": 1, "c": 1}
    assert [r["bytes"] for r in profile.memory_estimate(df, facts).collect()] == [24, 16, 3]
    assert facts.scans == 1
    empty = df.filter("a > 9")
    assert [tuple(r)[1:] for r in profile.missing_counts(empty, facts=profile.Facts(empty)).collect()] == [(0, None)] * 3
