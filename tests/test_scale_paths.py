"""Paths meant for tables that do not fit one task, forced on small data and checked by brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.operators import balance, encode, forest, fuzzy, impute, knn, lookup, merge, ordered, outliers, profile, quantiles


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 4000
    x = np.round(rng.exponential(50, n), 2)
    x[: n // 3] = 7.25  # one value holds a third of the rows
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abc"), n)), "x": x,
                        "y": rng.normal(0, 1, n)})
    pdf.loc[rng.choice(n, 300, replace=False), "x"] = np.nan
    df = spark.createDataFrame(pdf).select("id", "g", F.when(~F.isnan("x"), F.col("x")).alias("x"), "y").repartition(8)
    return pdf, df


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_bracketed_quantiles_are_exact(numbers):
    pdf, df = numbers
    got = quantiles.quantile_table(df, ["x", "y"], PROBS, direct_cells=0)
    for c in ("x", "y"):
        assert np.allclose(got[c], pdf[c].quantile(PROBS), rtol=1e-12)


def test_grouped_quantiles_are_exact(numbers):
    pdf, df = numbers
    got = {r["g"]: r["q"] for r in quantiles.grouped_quantiles(df, ["g"], "x", PROBS, direct_cells=0).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], part["x"].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(numbers, parts):
    pdf, df = numbers
    d = profile.describe_numeric(df.repartition(parts), ["x"]).first()
    assert d["count"] == pdf["x"].count() and np.isclose(d["mean"], pdf["x"].mean()) and np.isclose(d["std"], pdf["x"].std())
    r = {(c["x"], c["y"]): c["r"] for c in profile.correlation_matrix(df.repartition(parts), ["id", "x", "y"]).collect()}
    want = pdf[["id", "x", "y"]].corr()
    for (a, b), value in r.items():
        assert np.isclose(value, want.loc[a, b], atol=1e-12)


def test_positions_and_running_total(numbers):
    pdf, df = numbers
    got = ordered.with_position(df, ["x", "id"]).orderBy("_pos").toPandas()
    assert (got["_pos"] == np.arange(len(pdf))).all()
    key = got["x"].fillna(-np.inf)
    assert (key.diff().dropna() >= 0).all()
    run = ordered.running_total(df, ["id"], "x").orderBy("id").toPandas()["running_total"]
    assert np.allclose(run, pdf["x"].fillna(0).cumsum())


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_fills(numbers, backward, by):
    pdf, df = numbers
    got = ordered.fill_along(df, ["id"], ["x"], by, backward).orderBy("id").toPandas()["x"]
    source = pdf.groupby("g")["x"] if by else pdf["x"]
    want = source.bfill() if backward else source.ffill()
    assert np.allclose(got, want, equal_nan=True)


def test_fill_when_most_values_are_missing(spark):
    pdf = pd.DataFrame({"id": np.arange(1000), "x": [5.0 if i == 3 else 9.0 if i == 900 else None for i in range(1000)]})
    df = spark.createDataFrame(pdf.astype({"x": float})).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(8)
    got = ordered.fill_along(df, ["id"], ["x"]).orderBy("id").toPandas()["x"]
    assert np.allclose(got, pdf["x"].astype(float).ffill(), equal_nan=True)


def test_hash_rank(numbers):
    import hashlib
    pdf, df = numbers
    got = ordered.hash_ranked(df, ["g"], "id").toPandas()
    got["h"] = [hashlib.md5(f"{i}|42".encode()).hexdigest() for i in got["id"]]
    want = got.sort_values("h").groupby("g").cumcount()
    assert (got["_rank"] == want.reindex(got.index)).all()


@pytest.mark.parametrize("limit", [0, 10 ** 6])
def test_lookup_with_a_hot_key_and_nulls(spark, numbers, limit, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 2)
    pdf, df = numbers
    data = df.withColumn("g", F.when(F.col("id") % 10 != 0, F.col("g")))
    got = encode.encode_frequency(data, "g", broadcast_rows=limit).select("id", "g").toPandas().set_index("id")["g"]
    kept = pdf["g"].where(pdf["id"] % 10 != 0)
    want = kept.map(kept.value_counts(normalize=True))
    assert np.allclose(got.sort_index(), want, equal_nan=True)
    label = encode.encode_label(data, "g", broadcast_rows=limit).select("id", "g").toPandas().set_index("id")["g"].sort_index()
    levels = sorted(kept.fillna("nan").unique())
    assert (label == kept.fillna("nan").map(levels.index)).all()


def brute_force(q, d, feats, k, pay):
    out = {}
    for i, row in q.iterrows():
        gap = (d[feats] - row[feats].astype(float)) ** 2
        seen = gap.notna().sum(axis=1)
        dist = (gap.sum(axis=1) * len(feats) / seen.replace(0, np.nan)).dropna()
        near = pd.DataFrame({"d2": dist, "pay": d.loc[dist.index, pay]}).sort_values(["d2", "pay"])
        out[row["qid"]] = [(a, b) for a, b in near.head(k).to_numpy()]
    return out


@pytest.mark.parametrize("holes", [False, True])
def test_nearest_rows_equal_brute_force(spark, monkeypatch, holes):
    monkeypatch.setattr(knn, "DONORS_PER_CELL", 25)
    monkeypatch.setattr(knn, "DONORS_PER_CHUNK", 20)
    monkeypatch.setattr(knn, "QUERIES_PER_CHUNK", 7)
    rng = np.random.default_rng(11)
    d = pd.DataFrame({"a": rng.normal(0, 1, 400).round(1), "b": rng.normal(0, 1, 400), "c": rng.integers(0, 4, 400).astype(float),
                      "pay": rng.integers(0, 50, 400).astype(float)})
    d.loc[:130, ["a", "b", "c", "pay"]] = [0.5, 0.25, 2.0, 4.0]  # a third of the donors are equal
    q = pd.DataFrame({"qid": np.arange(60), "a": rng.normal(0, 1, 60).round(1), "b": rng.normal(0, 1, 60), "c": rng.integers(0, 4, 60).astype(float)})
    if holes:
        for f in "abc":
            d.loc[rng.choice(np.arange(131, 400), 40, replace=False), f] = np.nan
            q.loc[rng.choice(60, 15, replace=False), f] = np.nan
        q.loc[5, ["a", "b", "c"]] = np.nan
    clean = lambda p: spark.createDataFrame(p).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if p[c].dtype == float else F.col(c) for c in p.columns])
    got = knn.nearest_rows(clean(q), clean(d), ["a", "b", "c"], 5, "qid", "pay")
    found = {r["qid"]: [(n["d2"], n["pay"]) for n in r["near"]] for r in got.collect()}
    want = {i: v for i, v in brute_force(q, d, ["a", "b", "c"], 5, "pay").items() if v}
    assert found.keys() == want.keys()
    for i in want:
        assert np.allclose(found[i], want[i])


def test_nearest_rows_in_eight_equal_features_read_few_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "DONORS_PER_CELL", 16)
    rng = np.random.default_rng(3)
    names = list("abcdefgh")
    centres = rng.normal(0, 10, (60, 8))
    d = pd.DataFrame(np.repeat(centres, 40, axis=0) + rng.normal(0, 0.2, (2400, 8)), columns=names).assign(pay=np.arange(2400.0))
    q = pd.DataFrame(centres[:50] + rng.normal(0, 0.2, (50, 8)), columns=names).assign(qid=np.arange(50))
    visits = []
    got = knn.nearest_rows(spark.createDataFrame(q), spark.createDataFrame(d), names, 5, "qid", "pay", visits=visits)
    found = {r["qid"]: [(n["d2"], n["pay"]) for n in r["near"]] for r in got.collect()}
    want = brute_force(q, d, names, 5, "pay")
    assert all(np.allclose(found[i], want[i]) for i in range(50))
    cells = 2400 / 49  # the larger of 16 and the root of the donors
    assert visits[0] == 50 and sum(visits) < 50 * cells / 4


def test_nearest_rows_of_many_groups_share_trees(spark, monkeypatch):
    monkeypatch.setattr(knn, "DONORS_PER_CELL", 20)
    monkeypatch.setattr(knn, "TREES", 2)
    rng = np.random.default_rng(4)
    df = pd.DataFrame({"id": np.arange(600), "g": rng.integers(0, 9, 600).astype(str), "x": rng.normal(size=600).round(2), "y": rng.normal(size=600)})
    df.loc[::7, "y"] = np.nan
    frame = spark.createDataFrame(df).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = {r["id"]: [n["pay"] for n in r["near"]] for r in knn.nearest_rows(frame, frame, ["x", "y"], 3, "id", "id", "g", "id").collect()}
    for i, one in df.iterrows():
        same = df[(df.g == one.g) & (df.id != i)]
        gaps = np.stack([same.x - one.x, same.y - one.y], axis=1)
        seen = (~np.isnan(gaps)).sum(1)
        order = sorted(zip(np.nansum(gaps ** 2, axis=1) * 2 / seen, same.id))
        assert got[i] == [x for _, x in order[:3]]


def test_rows_with_one_feature_are_found_beside_it_on_its_line(spark, monkeypatch):
    """Slices of a few rows, values that many donors have, infinite ones, and squares that rounding makes equal."""
    monkeypatch.setattr(knn, "ROWS_PER_SLICE", 40)
    rng = np.random.default_rng(12)
    n = 600
    d = pd.DataFrame({"a": rng.normal(0, 3, n).round(1), "b": rng.exponential(9, n).round(), "pay": rng.integers(0, 90, n).astype(float), "g": rng.integers(0, 3, n)})
    d.loc[:200, ["a", "g"]] = [0.5, 1]
    d.loc[201:230, "b"] = rng.random(30)
    d.loc[231:233, "a"] = [np.inf, -np.inf, 1e200]
    d.loc[rng.choice(np.arange(240, n), 90, replace=False), "a"] = np.nan
    q = pd.DataFrame({"qid": np.arange(160), "a": rng.normal(0, 3, 160).round(1), "b": rng.exponential(9, 160).round(), "g": rng.integers(0, 4, 160)})
    q.loc[::2, "a"], q.loc[1::2, "b"] = np.nan, np.nan
    q.loc[:3, ["a", "b"]] = [[np.nan, 1e18], [np.inf, np.nan], [np.nan, np.nan], [1e180, np.nan]]
    clean = lambda p: spark.createDataFrame(p).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if p[c].dtype == float else F.col(c).cast("int").alias(c) for c in p.columns])
    for left, right, group in ((q[4:], d, "g"), (q, d, None), (q, d[:0], "g")):
        visits = []
        got = knn.nearest_rows(clean(left), clean(right) if len(right) else clean(d).limit(0), ["a", "b"], 5, "qid", "pay", group, visits=visits)
        found = {r["qid"]: [(x["d2"], x["pay"]) for x in r["near"]] for r in got.collect()}
        want = {}
        for i, one in left.iterrows():
            same = right[right.g == one.g] if group else right
            some = same[np.isfinite(same["a"] - one.a) if np.isnan(one.b) else np.isfinite(same["b"] - one.b)]
            with np.errstate(over="ignore"):
                gap = (some["a"] - one.a if np.isnan(one.b) else some["b"] - one.b) ** 2 * 2
            want[one.qid] = [x for x in sorted(zip(gap, some.pay)) if np.isfinite(x[0])][:5]
        assert found == {i: v for i, v in want.items() if v}
        assert bool(visits) == (group is None)  # the tree is asked for the rounded ones alone


def test_nearest_rows_leave_out_the_row_itself(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (2, 0.1, "a"), (3, 5.0, "a"), (4, 0.05, "b"), (5, 9.0, "b")], "id long, x double, c string")
    got = knn.nearest_rows(df, df, ["x"], 2, "id", "id", group="c", self_id="id")
    assert {r["id"]: [n["pay"] for n in r["near"]] for r in got.collect()} == {1: [2, 3], 2: [1, 3], 3: [2, 1], 4: [5], 5: [4]}


def test_impute_knn_without_a_shared_value_uses_the_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, None)], "x double, y double")
    assert (2.0 * 0 + 1.5, 2.0) in {tuple(r) for r in impute.impute_knn(df, k=1).collect()}


def test_full_preset_with_two_numbers_needs_no_tree(spark, monkeypatch):
    """Rows that lack one of two numbers have the other alone, also where the key is null or a row comes twice."""
    from dataclasses import replace

    from tableprep.plans import prepare

    monkeypatch.setattr(knn, "ROWS_PER_SLICE", 50)
    monkeypatch.setattr(knn, "_tree", lambda *x: pytest.fail("a row with one number was searched in the tree"))
    rng = np.random.default_rng(6)
    rows = [(None if i % 50 == 9 else i, None if i % 7 == 3 else float(rng.integers(0, 60)), None if i % 5 == 2 else int(rng.integers(0, 40)), "abc"[i % 3])
            for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id int, x double, y int, c string")
    out, _ = prepare.prepare(df, replace(prepare.PRESETS["full"], keep=("id",)))
    x, y = (np.array([np.nan if r[j] is None else r[j] for r in rows], dtype=float) for j in (1, 2))

    def filled(a, b):
        """The gaps of a: mean of the five nearest by b, else of all."""
        full = a.copy()
        for i in np.flatnonzero(np.isnan(a)):
            near = sorted((abs(b[j] - b[i]), a[j]) for j in range(len(a)) if not np.isnan(a[j]) and not np.isnan(b[j]))[:5] if not np.isnan(b[i]) else []
            full[i] = np.mean([v for _, v in near]) if near else np.nanmean(a)
        low, high = np.quantile(full, [0.25, 0.75])
        full = np.clip(full, low - 1.5 * (high - low), high + 1.5 * (high - low))
        return (full - full.min()) / (full.max() - full.min())

    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted([(r["id"], round(r["x"], 6), round(r["y"], 6)) for r in out.collect()], key=key)
    assert got == sorted([(r[0], round(u, 6), round(v, 6)) for r, u, v in zip(rows, filled(x, y).tolist(), filled(y, x).tolist())], key=key)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("minimum", [0.95, 0.8, 0.7, 0.55, 0.3])
def test_similar_texts_equal_brute_force(spark, monkeypatch, minimum):
    monkeypatch.setattr(fuzzy, "TEXTS_PER_CHUNK", 3)
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abc1 "), rng.integers(1, 14))).strip() for _ in range(80)} | {"", "a", "aaaaaaaa", "aaaaaaab"}
    other = {w[:-1] + "c" for w in words if w} | {"", "aaaaaaaa"}
    left = spark.createDataFrame([(w,) for w in sorted(words)], "a string")
    right = spark.createDataFrame([(w,) for w in sorted(other)], "b string")
    got = {(r["a"], r["b"]) for r in fuzzy.similar_texts(left, right, minimum).collect()}
    # empty texts are like nothing
    same = lambda a, b: 0.0 if not a or not b else 1 - edit(a, b) / max(len(a), len(b))
    assert got == {(a, b) for a in words for b in other if same(a, b) >= minimum - 1e-12}


@pytest.mark.parametrize("minimum", [0.95, 0.85, 0.7, 0.5])
def test_similar_texts_share_a_segment(spark, monkeypatch, minimum):
    monkeypatch.setattr(fuzzy, "TEXTS_PER_CHUNK", 3)
    rng = np.random.default_rng(8)
    words = {"".join(rng.choice(list("ab1é"), rng.integers(1, 12))) for _ in range(70)} | {"", "a", "aaaaaaaa", "name 00123", "name 01230"}
    other = {w[: len(w) // 2] + "c" + w[len(w) // 2 + 1:] for w in words} | {w[1:] + "b" for w in words} | {"", "aaaaaaaa", "name 00213", "name 0123"}
    frame = lambda texts, c: spark.createDataFrame([(w,) for w in sorted(texts)], f"{c} string")
    texts = fuzzy._Texts(frame(words, "a"), frame(other, "b"), minimum)
    texts.pairs = float("inf")
    texts._take(*fuzzy._segments(texts.left, texts.right, minimum, float("inf")))
    got = {(r["a"], r["b"]) for r in fuzzy._search(texts).collect()}
    assert got == {(a, b) for a in words for b in other if a and b and 1 - edit(a, b) / max(len(a), len(b)) >= minimum - 1e-12}


def test_numbered_names_meet_in_few_pairs(spark, monkeypatch):
    """Grams of numbers are in nearly all names; segments pair fewer."""
    monkeypatch.setattr(fuzzy, "MANY", 1_000)
    names = spark.range(1000).select(F.format_string("supplier %09d", F.col("id")).alias("a"))
    texts = fuzzy._Texts(names, names.toDF("b"), 0.85)
    assert texts.pairs < 1000 * 1000 * 0.6
    assert texts.counts.filter("s LIKE '18.2.%'").count() == texts.counts.count()


@pytest.mark.parametrize("many, searched", [(10 ** 7, {0, 1}), (3_000, {1}), (0, {1})])
def test_record_link_leaves_out_a_search_that_costs_more_than_it_saves(spark, monkeypatch, many, searched):
    monkeypatch.setattr(fuzzy, "MANY", many)
    monkeypatch.setattr(fuzzy, "FEW", 0)
    monkeypatch.setattr(fuzzy, "PAIRS_PER_TASK", 200)
    rng = random.Random(3)
    made = lambda n: [(f"Supplier#{rng.randrange(500):09d}", rng.choice(["Berlin", "Berlyn", "Madrid", "Oslo", "Lima", "Accra", "", None])) for _ in range(n)]
    a, b = made(40), made(60)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, name string, town string")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "j int, name string, town string")
    used, real = [], fuzzy._link_columns
    monkeypatch.setattr(fuzzy, "_link_columns", lambda *x: used.append(real(*x)) or used[-1])
    got = sorted((r["i"], r["j"]) for r in fuzzy.fuzzy_record_link(left, right, ["name", "town"], ["name", "town"], 0.8).collect())
    same = lambda x, y: x is not None and y is not None and (not (x or y) or 1 - edit(x, y) / max(len(x), len(y)) >= 0.8)
    plain = lambda t: None if t is None else t.lower().replace("#", " ")
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if all(same(plain(u), plain(v)) for u, v in zip(x, y)))
    assert len(got) > 40 and set(used[0][1]) == searched


def test_record_link_allows_misses_over_many_columns(spark):
    names = [f"c{i}" for i in range(7)]
    base = [f"value number {i}" for i in range(7)]
    left = spark.createDataFrame([tuple(base)], ", ".join(f"{n} string" for n in names))
    one_off, two_off = list(base), list(base)
    one_off[0] = "zzz"
    two_off[0] = two_off[1] = "zzz"
    right = spark.createDataFrame([tuple(one_off), tuple(two_off)], ", ".join(f"{n} string" for n in names))
    assert [r["matched"] for r in fuzzy.fuzzy_record_link(left, right, names, names).collect()] == [6]


@pytest.mark.parametrize("chunk, few", [(5_000, 100), (7, 0)])
def test_record_link_equals_brute_force(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(fuzzy, "TUPLES_PER_CHUNK", chunk)
    monkeypatch.setattr(fuzzy, "FEW", few)
    rng, names = random.Random(11), ["c0", "c1", "c2"]
    pool = [None, "", "red", "green house", "green  Mouse", "blue water", "blue waters", "stone", "old road", "new road"]
    made = lambda: [tuple(rng.choice(pool) if rng.random() < 0.3 else f"fixed value {i}" for i in range(3)) for _ in range(40)]
    a, b = made(), made()
    schema = ", ".join(f"{n} string" for n in names)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, " + schema)
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "j int, " + schema)
    plain = lambda t: None if t is None else " ".join(t.lower().split())

    def matched(x, y):
        pairs = [(plain(u), plain(v)) for u, v in zip(x, y) if u is not None and v is not None]
        return sum(not (u or v) or 1 - edit(u, v) / max(len(u), len(v)) >= 0.6 for u, v in pairs)

    want = sorted((i, j, matched(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if matched(x, y) >= 2)
    got = sorted((r["i"], r["j"], r["matched"]) for r in fuzzy.fuzzy_record_link(left, right, names, names, 0.6).collect())
    assert got == want and len(want) > 20


def test_record_link_takes_candidates_from_the_selective_column(spark, monkeypatch):
    """25 towns, named first, lead to a 25th of all rows, the names to one each."""
    monkeypatch.setattr(fuzzy, "FEW", 1)
    counts = []
    for rows in (100, 400):
        df = spark.range(rows).select(F.md5(F.col("id").cast("string")).alias("name"),
                                      F.concat(F.lit("town "), F.chr(65 + F.col("id") % 25), F.chr(66 + F.col("id") % 25)).alias("town"))
        on = ["town", "name"]
        keys = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
        other = df.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(on)])
        tuples, nears = fuzzy._link_columns(keys, other, ["_k0", "_k1"], ["_m0", "_m1"], 1, 0.85)
        led = [tuples.filter(F.array_contains("_use", i)).join(near, F.col(f"_k{i}") == F.col("a"))
               .join(other, F.col("b") == F.col(f"_m{i}")).count() for i, near in nears.items()]
        counts.append(sum(led))
    assert counts == [100, 400]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("limit", [20, 10 ** 6])
def test_merges_with_hot_keys(spark, monkeypatch, how, limit):
    monkeypatch.setattr(merge, "HOT_ROWS", limit)
    # key 1 is hot on both sides, null on the left, 5 on the right and 6 on the left alone
    left = pd.DataFrame({"k": [1.0] * 100 + [None] * 50 + [6.0] * 60 + [7.0, 8.0, 5.0], "x": range(213)})
    right = pd.DataFrame({"k": [1.0] * 70 + [None] * 2 + [5.0] * 40 + [7.0, 9.0] + [4.0] * 30, "y": range(144)})
    load = lambda p: spark.createDataFrame(p).withColumn("k", F.when(~F.isnan("k"), F.col("k")))
    got = merge.merge(load(left), load(right), "k", "k", how, indicator=True).toPandas()
    want = left.merge(right, on="k", how=how, indicator=True)
    key = lambda p: sorted(tuple(str(v) if pd.notna(v) else "" for v in r) for r in p[["k", "x", "y", "_merge"]].astype(
        {"x": float, "y": float, "_merge": str}).itertuples(index=False))
    assert key(got) == key(want)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merges_with_hot_keys_are_one_salted_join_of_two_reads(spark, monkeypatch, tmp_path, how):
    monkeypatch.setattr(merge, "HOT_ROWS", 20)
    spark.range(900).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS int) AS k", "id AS x").write.parquet(str(tmp_path / "l"))
    spark.range(60).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id + 880 END AS k", "id AS y").write.parquet(str(tmp_path / "r"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "lr")
    jobs = []
    real = merge._heavy
    monkeypatch.setattr(merge, "_heavy", lambda *a: jobs.append(a) or real(*a))
    got = merge.merge(left, right, "k", "k", how)
    plan = got._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert len(jobs) == 2 and initial.count("FileScan") == 2 and "Union" not in initial
    assert sum(initial.count(j) for j in ("SortMergeJoin", "ShuffledHashJoin")) + initial.count("BroadcastHashJoin") == 3
    want = left.toPandas().merge(right.toPandas(), on="k", how=how)
    rows = lambda p: sorted(tuple(-1.0 if pd.isna(v) else float(v) for v in r) for r in p[["k", "x", "y"]].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)


def test_sample_prefilter_changes_nothing(spark, numbers, monkeypatch):
    from tableprep.operators import filters
    _, df = numbers
    plain = filters.sample_rows(df, ["id"], 100).collect()
    monkeypatch.setattr(filters, "FILTER_FIRST", 50)
    assert filters.sample_rows(df, ["id"], 100).collect() == plain


@pytest.mark.parametrize("suspects", [0, 10 ** 6])
def test_duplicates_of_wide_rows(spark, monkeypatch, suspects):
    monkeypatch.setattr(profile, "SUSPECTS", suspects)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({c: rng.choice(["x", "y", None], 300) for c in "abcdef"})
    pdf.loc[:100] = ["x", None, "x", None, "y", "y"]  # hashes leave out nulls, rows must not
    df = spark.createDataFrame(pdf, ", ".join(f"{c} string" for c in pdf)).repartition(5)
    assert profile.duplicate_rows(df).first()["duplicates"] == pdf.duplicated().sum()


def test_balance_is_repeatable(spark):
    df = spark.range(2000).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                  F.when(F.col("id") % 10 == 0, "rare").otherwise("many").alias("c"))
    for method, size in (("undersample", 400), ("oversample", 3600), ("smote", 3600)):
        a = balance.balance(df, "c", method, "id")
        b = balance.balance(df.repartition(5), "c", method, "id")
        assert a.count() == size and a.exceptAll(b).count() == 0


def test_quantiles_of_a_crowded_bracket_are_selected(spark, monkeypatch):
    """A million values within one bracket, none of a column in one window."""
    x = np.random.default_rng(9).permutation(1_000_000) / 7.0
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(8)
    monkeypatch.setattr(quantiles, "BRACKET", 300)
    held = []
    real = quantiles._at_rank
    monkeypatch.setattr(quantiles, "_at_rank", lambda values, *rest: held.append(values) or real(values, *rest))
    got = quantiles.quantile_table(df, ["x"], [0.1, 0.5, 0.999], direct_cells=0)["x"]
    assert np.allclose(got, np.quantile(x, [0.1, 0.5, 0.999]), rtol=1e-12)
    # all values in one bracket: rank selection alone
    values = df.select(F.lit("x").alias("_k0"), F.lit(0).alias("_j"), F.col("x").alias("_v"), F.lit(2).cast("long").alias("_c"))
    for rank in (0, 1, 777_777, 1_999_999):
        ranks = spark.createDataFrame([("x", 1, 0, rank)], "w_k0 string, _n long, _j int, _rank long")
        assert [r["_v"] for r in real(values, ranks, ["_k0"], False).collect()] == [np.sort(x)[rank // 2]]


def test_forest_rows_come_in_their_shares_for_any_partitions(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(1, 51, 60_000).astype(float), np.full(600, 1000.0)])
    pools, flags = [], []
    for parts in (1, 4, 16):
        df = spark.createDataFrame(pd.DataFrame({"x": rng.permutation(x)})).repartition(parts)
        pools.append(np.sort(forest.draw_rows(df, ["x"], 25_600)[:, 0]))
        found = forest.isolation_flags(df, ["x"], 0.01).filter("_outlier").groupBy("x").count().collect()
        flags.append(sorted((r["x"], r["count"]) for r in found))
    assert all(np.array_equal(pools[0], p) for p in pools) and flags[0] == flags[1] == flags[2]
    values, counts = np.unique(pools[0], return_counts=True)
    assert len(pools[0]) == 25_600 and len(values) == 51
    want = np.array([np.mean(x == v) for v in values]) * 25_600
    assert np.all(np.abs(counts - want) < 5 * np.sqrt(want))
    # the quantile of the scores lies among ordinary rows, so few of them can go besides the planted ones
    assert dict(flags[0]).get(1000.0, 600) in (0, 600) and sum(n for v, n in flags[0] if v < 1000) < 0.05 * len(x)


def test_forest_rows_of_few_and_of_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 50 + [(None, 1.0), (3.0, 4.0)], "a double, b double")
    assert sorted(map(tuple, forest.draw_rows(df, ["a", "b"], 1000))) == [(1.0, 2.0)] * 50 + [(3.0, 4.0)]
    many = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.col("id") % 90_000).alias("a"))
    pool = forest.draw_rows(many, ["a"], 6_000)[:, 0]
    assert len(pool) == 6_000 and abs(np.mean(pool == 7.5) - 1 / 3) < 0.03


@pytest.mark.parametrize("lam,method", [(-7.0, "yeo-johnson"), (9.0, "yeo-johnson"), (-12.0, "box-cox"), (0.5, "yeo-johnson")])
def test_power_exponents_far_out_are_found(spark, lam, method):
    """Values whose transform is even about its middle: the likelihood on a dense grid in long doubles has the same best."""
    from statistics import NormalDist
    z = np.array([NormalDist().inv_cdf((i + 0.5) / 4000) for i in range(4000)])
    y = 1.0 + 0.1 * z if lam > 0 else (0.5 + 0.05 * z - 1) / lam  # lam * y + 1 stays above zero
    x = np.power(lam * y + 1, 1 / lam) - (1 if method == "yeo-johnson" else 0)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = outliers.fit_power(df, ["x"], method)["x"]
    assert abs(got - lam) < 0.1

    def likelihood(g):
        size = np.log1p(x.astype(np.longdouble)) if method == "yeo-johnson" else np.log(x.astype(np.longdouble))
        t = np.exp(g * size) / g
        return -len(x) / 2 * np.log(t.var()) + (g - 1) * size.sum()

    near = [got + d / 2048 for d in range(-40, 41)]
    assert abs(near[int(np.argmax([likelihood(g) for g in near]))] - got) <= 1 / 1024


def test_power_of_flat_mixed_and_missing_columns(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"flat": 3.0, "mixed": rng.normal(0, 5, 500), "big": rng.lognormal(300, 2, 500), "gone": np.nan})
    df = spark.createDataFrame(pdf).withColumn("gone", F.lit(None).cast("double"))
    got = outliers.fit_power(df, ["flat", "mixed", "big", "gone"])
    assert got["flat"] == 1.0 and got["gone"] == 1.0 and 0.7 < got["mixed"] < 1.3 and abs(got["big"]) < 0.2


def test_comparisons_on_floats_reach_the_scan(spark, tmp_path):
    from tableprep.operators import filters
    from tableprep.sources import io
    nan = float("nan")
    spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, 9.0)], "id long, x double").write.parquet(str(tmp_path / "t"))
    df = io.read_parquet(spark, str(tmp_path / "t"))
    for op, want in ((">", [4]), ("<=", [1]), ("!=", [1, 2, 3]), ("==", [4])):
        got = filters.filter_compare(df, "x", op, 9.0 if op in ("!=", "==") else 5)
        assert sorted(r["id"] for r in got.collect()) == want
        pushed = got._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
        assert op == "!=" or "(x," in pushed
    twice = filters.filter_compare(filters.filter_compare(df, "x", ">", 0), "id", "<", 4)
    assert [tuple(r) for r in twice.collect()] == [(1, 1.0)]
    assert "LessThan(id,4)" in twice._jdf.queryExecution().executedPlan().toString()
    assert [r["x"] for r in filters.filter_compare(df, "id", "==", 2).collect()] == [None]
