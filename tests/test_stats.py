"""Statistics against independent numpy, hand-made answers and planted effects."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

import dense
from assayloom.functions import scalar as S
from assayloom.operators import cells as C
from assayloom.operators import fits, imputation, missing, spectra, stats, transforms


def long(spark, matrix, value="value"):
    rows = [(f"f{i:03}", f"s{j:02}", None if v != v else float(v)) for i, r in enumerate(np.asarray(matrix, float)) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"feature string, sample string, {value} double").withColumn("block", F.lit("A1B1"))


def wide(df, value="value"):
    rows = df.select("feature", "sample", value).toPandas().pivot(index="feature", columns="sample", values=value)
    return rows.sort_index()[sorted(rows.columns)].to_numpy(float)


def test_numbers_of_texts(spark):
    said = ["1", " 2.5 ", "-3e2", ".5", "1d", "1_000", "0x1", "inf", "-Infinity", "", "NA", "1.", "abc", None, "\t7\n"]
    got = [r.v for r in spark.createDataFrame([(s,) for s in said], "t string").select(S.number(F.col("t")).alias("v")).collect()]
    inf = float("inf")
    assert got == [1, 2.5, -300, 0.5, None, None, None, inf, -inf, None, None, 1, None, None, 7]


def test_names(spark):
    df = spark.createDataFrame([("P1_T2_x",), ("plain",), ("_edge",), ("edge_",)], "c string")
    first, last = S.split_first(F.col("c"), "_"), S.split_last(F.col("c"), "_")
    got = [tuple(r) for r in df.select(*first, *last).collect()]
    assert got == [("P1", "T2_x", "P1_T2", "x"), (None,) * 4, (None,) * 4, (None,) * 4]
    assert [r[0] for r in spark.createDataFrame([("week 4",), ("-1.5 h",), ("none",)], "c string").select(S.label_number(F.col("c"))).collect()] == [4.0, -1.5, None]
    assert [r[0] for r in df.select(S.matches_glob(F.col("c"), "P?_*")).collect()] == [True, False, False, False]


def test_significant_digits(spark):
    xs = [123456.0, 0.00012345, -9.9999, 0.0, 5.0]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.significant(F.col("x"), 3)).collect()] == pytest.approx([123000, 0.000123, -10, 0, 5])


def test_pca_equals_svd(spark):
    y = np.random.default_rng(1).normal(size=(30, 8))
    scores, shares = spectra.components(spectra.Features(long(spark, y, "y")), 3)
    c = y - y.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(c.T, full_matrices=False)
    assert np.abs(scores) == pytest.approx(np.abs(u[:, :3] * s[:3])) and shares == pytest.approx(s[:3] ** 2 / (s**2).sum())
    assert all(scores[np.abs(scores[:, j]).argmax(), j] > 0 for j in range(3))


def test_permanova_finds_a_planted_batch():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(100, 12))
    codes = np.repeat([0, 1], 6)
    y[:, codes == 1] += 2
    c = y - y.mean(axis=1, keepdims=True)
    k = c.T @ c
    r2, f = dense.permanova(k, codes)
    plan = stats.exchange(codes, key="x")
    assert plan.whole and plan.n_distinct == 924 and len({tuple(r) for r in plan.of(codes).tolist()}) == 924
    p, least = plan.p_value(dense.permanova(k, plan.of(codes))[1], float(f[0]))
    assert r2[0] > 0.3 and p == pytest.approx(2 / 924) and least == pytest.approx(1 / 924)


def test_restricted_permutations():
    subject = ["a", "a", "b", "b", "c", "c"]
    v = np.array([0, 0, 1, 1, 1, 1])
    whole = stats.exchange(v, subject)
    assert whole.scheme == "subjects" and whole.n_distinct == 3 and len({tuple(r) for r in whole.of(v).tolist()}) == 3 and all(r[0] == r[1] and r[2] == r[3] for r in whole.of(v))
    v = np.array([0, 1, 0, 1, 0, 1])
    inside = stats.exchange(v, subject)
    assert inside.scheme == "within" and inside.n_distinct == 8 and len({tuple(r) for r in inside.of(v).tolist()}) == 8 and all(sorted(r[i : i + 2].tolist()) == [0, 1] for r in inside.of(v) for i in (0, 2, 4))
    v = np.arange(30) % 3
    many = stats.exchange(v, n=99)
    assert not many.whole and many.of(v).shape == (99, 30) and (many.of(v) == stats.exchange(v, n=99).of(v)).all() and all(sorted(m) == list(range(30)) for m in many.moves.tolist())


def test_orders_of_a_multiset():
    labels = np.array([2, 1, 1, 3])
    want = sorted(set(permutations(labels.tolist())))
    assert stats.arrangements(labels) == 12 and [tuple(r) for r in stats.nth_orders(labels, np.arange(12)).tolist()] == want


def test_association_guards():
    assert stats.association([1, 2, 3], ["a", "b", "a"], False)["status"] == "insufficient_data"
    assert stats.association([1, 1, 1, 1], ["1", "2", "3", "4"], True)["reason"] == "constant response"
    assert stats.association([1, 2, 3, 4, 5], ["a", "a", "b", "b", "c"], False)["reason"].startswith("smallest level")
    got = stats.association(list(range(12)), ["a"] * 6 + ["b"] * 6, False)
    assert got["status"] == "computed" and got["p"] < 0.01
    assert stats.association(list(range(12)), [str(x) for x in range(12)], True)["value"] == pytest.approx(1)


def test_modified_z_falls_back(spark):
    df = long(spark, [[1, 1, 1, 1, 5], [1, 2, 3, 4, 100], [2, 2, 2, 2, 2]], "y")
    z = wide(stats.with_modified_z(df, ["feature"], "y"), "z")
    assert z[0] == pytest.approx([0, 0, 0, 0, 4 / (1.253314 * 0.8)]) and z[1] == pytest.approx(0.6745 * np.array([-2, -1, 0, 1, 97])) and (z[2] == 0).all()


def test_detection_curve_recovers_the_slope(spark):
    rng = np.random.default_rng(5)
    m, n = rng.normal(10, 2, 3000), 24
    d = rng.binomial(n, 1 / (1 + np.exp(-(m - 9))))
    rows = lambda d: spark.createDataFrame([(f"f{i}", float(a), int(b)) for i, (a, b) in enumerate(zip(m, d))], "feature string, mean double, detected long")  # noqa: B905, E731
    b0, b1, _ = fits.detection_curve(rows(d), n)
    assert b1 == pytest.approx(1, abs=0.1) and b0 == pytest.approx(-9, abs=1)
    lo, hi = fits.interval(fits.detection_curve(rows(np.maximum(1, rng.binomial(n, 0.6, 400))), n, 50)[2])
    assert lo < 0 < hi


def test_local_regression_is_exact_on_polynomials():
    x = np.linspace(0, 9, 25)
    assert stats.local_regression(x, 3 - x + 0.5 * x**2) == pytest.approx(3 - x + 0.5 * x**2)


@pytest.mark.parametrize("span,degree", [(0.75, 2), (0.4, 1), (1.5, 2), (0.1, 2)])
def test_local_regression_by_weighted_least_squares(span, degree):
    rng = np.random.default_rng(3)
    x, y, at = rng.permutation(40).astype(float), rng.normal(size=40), np.linspace(0, 39, 23)
    got = stats.local_regression(x, y, at, span, degree)
    q = min(40, max(int(40 * span + 1e-9), degree + 1))
    for t, g in zip(at, got, strict=True):
        far = np.sort(np.abs(x - t))[q - 1] * max(1, span)
        w = np.clip(1 - (np.abs(x - t) / far) ** 3, 0, None) ** 1.5
        d = min(degree, (w > 0).sum() - 1)
        assert g == pytest.approx(np.linalg.lstsq(np.vander(x - t, d + 1, increasing=True) * w[:, None], y * w, rcond=None)[0][0], abs=1e-6)


def test_local_regression_of_few_points():
    assert len(stats.local_regression([], [])) == 0 and stats.local_regression([1.0], [5.0]) == pytest.approx([5.0]) and stats.local_regression([2, 2], [1, 3]) == pytest.approx([2, 2])


def test_median_of_large_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(g, None if rng.random() < 0.1 else float(np.round(v, 2))) for g, n in (("a", 5001), ("b", 4000), ("c", 1), ("d", 2)) for v in rng.normal(size=n)]
    got = {r.g: r.median for r in stats.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in "abcd":
        v = [x for k, x in rows if k == g and x is not None]
        assert not v or got[g] == pytest.approx(np.median(v))


def test_quantile_normalisation_by_hand(spark):
    x = np.array([[5, 4, 3], [2, 1, 4], [3, 4, 6], [4, 2, 8]], float)
    got = wide(transforms.normalize_quantile(long(spark, x)))
    ref = np.sort(x, axis=0).mean(axis=1)
    assert ref == pytest.approx([2, 3, 14 / 3, 17 / 3])
    assert got[:, 0] == pytest.approx([ref[3], ref[0], ref[1], ref[2]]) and got[0, 1] == got[2, 1] == pytest.approx((ref[2] + ref[3]) / 2)


def test_quantile_normalisation_with_gaps(spark):
    x = np.random.default_rng(3).normal(size=(20, 5)) + np.arange(5)
    x[3, 1] = x[7, 4] = np.nan
    got = wide(transforms.normalize_quantile(long(spark, x)))
    assert (np.isnan(got) == np.isnan(x)).all() and np.nanmedian(got, axis=0).std() < 0.15


def test_combat_removes_location_and_scale(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(10, 1, (80, 12))
    x[:, 6:] = (x[:, 6:] - 10) * 2 + 13
    x[0] = 4.0
    batches = spark.createDataFrame([(f"s{j:02}", "a" if j < 6 else "b") for j in range(12)], "sample string, batch string")
    got = wide(transforms.combat(long(spark, x), batches))
    assert abs((got[1:, :6].mean(axis=1) - got[1:, 6:].mean(axis=1)).mean()) < 0.1 and (got[0] == 4).all()
    assert got[1:, 6:].std(axis=1).mean() / got[1:, :6].std(axis=1).mean() == pytest.approx(1, abs=0.15)
    with pytest.raises(ValueError):
        transforms.combat(long(spark, np.where(np.arange(12) == 3, np.nan, x)), batches)


def test_drift_is_removed_where_values_are_in_a_row(spark):
    rng = np.random.default_rng(7)
    order = np.arange(24)
    x = rng.normal(0, 0.05, (6, 24)) + 0.1 * order + 0.01 * order**2
    x[5, ::3] = np.nan
    plan = spark.createDataFrame([(f"s{j:02}", float(j), "a") for j in range(24)], "sample string, run_order double, batch string")
    got = wide(transforms.drift_sample_loess(long(spark, x), plan))
    assert np.abs(np.polyfit(order, got[:5].T, 1)[0]).max() < 0.02 and np.nan_to_num(got[5]) == pytest.approx(np.nan_to_num(x[5]))
    qc = spark.createDataFrame([(f"s{j:02}",) for j in range(0, 24, 3)], "sample string")
    again = wide(transforms.drift_qc_loess(long(spark, x[:5]), plan.drop("batch"), qc))
    assert np.abs(np.polyfit(order, again.T, 1)[0]).max() < 0.06


def fitted_by_hand(x, y, at, span=0.75, degree=2):
    q, out = min(len(x), max(int(len(x) * span + 1e-9), degree + 1)), []
    for t in at:
        far = np.sort(np.abs(x - t))[q - 1] * max(1, span)
        w = np.clip(1 - (np.abs(x - t) / far) ** 3, 0, None) ** 1.5
        d = min(degree, len(set(x[w > 0])) - 1)
        out.append(np.linalg.lstsq(np.vander(x - t, d + 1, increasing=True) * w[:, None], y * w, rcond=None)[0][0] if d >= 0 else np.nan)
    return np.array(out)


@pytest.mark.parametrize("at_once, places", [(1 << 16, 32), (40, 3)])
def test_many_curves_of_uneven_lengths(monkeypatch, at_once, places):
    monkeypatch.setattr(stats, "AT_ONCE", at_once)
    monkeypatch.setattr(stats, "PLACES", places)
    rng = np.random.default_rng(31)
    n, p = [0, 1, 2, 9, 40, 3, 9, 25, 0, 12], [4, 2, 3, 0, 40, 7, 35, 1, 0, 12]
    xs, ats = [np.sort(rng.integers(0, 60, k)).astype(float) for k in n], [rng.uniform(0, 60, k) for k in p]
    ys = [rng.normal(size=k) for k in n]
    got = stats.local_regressions(np.concatenate(xs), np.concatenate(ys), n, np.concatenate(ats), p)
    assert np.isnan(got[:4]).all()
    assert got[4:] == pytest.approx(np.concatenate([fitted_by_hand(x, y, at) for x, y, at in zip(xs[1:], ys[1:], ats[1:], strict=True) if len(x)]), abs=1e-6, nan_ok=True)


def test_corrected_batches_of_many_features_are_fitted_together(spark):
    rng = np.random.default_rng(32)
    x = rng.normal(0, 1, (30, 24)) + 0.1 * np.arange(24)
    x[rng.random(x.shape) < 0.15] = np.nan
    plan = spark.createDataFrame([(f"s{j:02}", float(j), "ab"[j % 2]) for j in range(24)], "sample string, run_order double, batch string")
    df = transforms.correct_batch_effects(long(spark, x), plan, "mean", least=4)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # a call of Python for each feature and batch took hours at a gigabyte
    at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # curves that begin in one Arrow batch and end in another
    try:
        got = wide(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    want, stayed = x.copy(), 0
    for row in want:
        for half in (row[::2], row[1::2]):  # views
            seen = ~np.isnan(half)
            if max(map(len, "".join(" x"[v] for v in seen.astype(int)).split()), default=0) >= 4:
                fit = fitted_by_hand(np.flatnonzero(seen).astype(float), half[seen], np.flatnonzero(seen))
                half[seen] += fit.mean() - fit
            else:
                stayed += 1
        middle = np.nanmean(row)
        for half in (row[::2], row[1::2]):
            half += middle - np.nanmean(half)
    assert 0 < stayed < 30 and got == pytest.approx(want, abs=1e-6, nan_ok=True)


def test_a_long_curve_takes_little_memory():
    import tracemalloc

    x = np.arange(3000.0)
    tracemalloc.start()
    try:
        fit = stats.local_regression(x, x**2 / 1000)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert fit == pytest.approx(x**2 / 1000, abs=1e-6) and most < 50e6  # points x places took 72 MB an array


def test_cells_without_a_run_order_stay(spark):
    rng = np.random.default_rng(33)
    x = rng.normal(0, 1, (4, 13)) + np.arange(13)
    plan = spark.createDataFrame([(f"s{j:02}", float(j) if j != 5 else None, "a") for j in range(13)], "sample string, run_order double, batch string")
    df = transforms.drift_sample_loess(long(spark, x), plan)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # no call of Python for each feature
    at = np.delete(np.arange(13.0), 5)
    for row, got in zip(x, wide(df), strict=True):
        rest = np.delete(row, 5)
        fit = fitted_by_hand(at, rest, at)
        assert got[5] == row[5] and np.delete(got, 5) == pytest.approx(rest + fit.mean() - fit, abs=1e-6)


def test_qc_curves_are_fitted_together(spark):
    rng = np.random.default_rng(34)
    x = rng.normal(0, 1, (30, 24)) + 0.1 * np.arange(24)
    x[rng.random(x.shape) < 0.3] = np.nan
    qc = np.arange(3, 20, 2)  # what is before and behind them gets the fit at the ends
    plan = spark.createDataFrame([(f"s{j:02}", float(j)) for j in range(24)], "sample string, run_order double")
    df = transforms.drift_qc_loess(long(spark, x), plan, spark.createDataFrame([(f"s{j:02}",) for j in qc], "sample string"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # no call of Python for each feature
    want, stayed = x.copy(), 0
    for row in want:
        known = np.array([j for j in qc if not np.isnan(row[j])], float)
        if len(known) >= 5:
            y = row[known.astype(int)].copy()
            row += fitted_by_hand(known, y, known).mean() - fitted_by_hand(known, y, np.clip(np.arange(24.0), known[0], known[-1]))
        else:
            stayed += 1
    assert 0 < stayed < 30 and wide(df) == pytest.approx(want, abs=1e-6, nan_ok=True)


def test_batch_centre_keeps_flagged_cells_out_of_the_middle(spark):
    x = np.array([[1, 2, 90, 11, 12, 13]], float)
    batches = spark.createDataFrame([(f"s{j:02}", "a" if j < 3 else "b") for j in range(6)], "sample string, batch string")
    got = wide(transforms.batch_center(long(spark, x), batches, "mean", exclude=F.col("value") == 90))
    assert got[0, :2].mean() == pytest.approx(got[0, 3:].mean()) and got[0, 2] - got[0, 0] == pytest.approx(89)


@pytest.mark.parametrize("asked, at_once", [(4096, 512), (3, 2)])
def test_nearest_features_fill_gaps(spark, monkeypatch, asked, at_once):
    monkeypatch.setattr(imputation, "ASKED", asked)
    monkeypatch.setattr(imputation, "AT_ONCE", at_once)
    rng = np.random.default_rng(8)
    x = rng.normal(20, 1, (14, 6))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[3] = np.nan  # nothing is known of it: samples' means
    cells = long(spark, x).withColumn("unit", F.lit("u")).repartition(3)
    got = wide(imputation.knn(cells, ["unit"], 3))
    want = x.copy()
    for i, j in np.argwhere(np.isnan(x)):
        near = []
        for o in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if o != i and both.any() and not np.isnan(x[o, j]):
                near.append((np.sqrt(((x[i] - x[o])[both] ** 2).mean()), o))
        want[i, j] = np.mean([x[o, j] for _, o in sorted(near)[:3]]) if near else np.nanmean(x[:, j])
    assert got == pytest.approx(want)
    assert imputation.knn(long(spark, np.ones((2, 2))), []).count() == 4


def test_draws_below_a_sample(spark):
    x = np.random.default_rng(8).normal(20, 1, (400, 2))
    x[:150, 0] = np.nan
    x[1:, 1] = np.nan
    got, again = (wide(imputation.min_prob(long(spark, x).repartition(n), [])) for n in (1, 4))
    drawn = got[:150, 0]
    assert np.array_equal(got, again, equal_nan=True) and (got[150:, 0] == x[150:, 0]).all() and np.isnan(got[1:, 1]).all()
    assert drawn.mean() == pytest.approx(np.nanmean(x[:, 0]) - 1.8 * np.nanstd(x[:, 0], ddof=1), abs=0.1) and drawn.std() == pytest.approx(0.3, abs=0.08)


def test_ladder_and_policies(spark):
    x = np.random.default_rng(9).normal(size=(100, 10))
    x[:95, 0] = np.nan
    d, report = C.default_matrix(long(spark, x, "y"))
    assert report["q"] == 75 and report["n_features_used"] == 100 and d.select("sample").distinct().count() == 9
    with pytest.raises(ValueError):
        C.diagnostic_matrix(long(spark, x, "y"), "all_observed")


def test_structures(spark):
    df = lambda pairs: spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pairs)], "sample string, b string, d string")
    code = lambda pairs: stats.design_structure(df(pairs), "b", "d").first().structure
    assert code([("1", "x"), ("1", "x"), ("2", "y")]) == "confounded"
    assert code([("1", "x"), ("1", "y"), ("2", "z")]) == "nested"
    assert code([("1", "x"), ("1", "y"), ("2", "x"), ("2", "y")]) == "crossed_balanced"
    assert code([("1", "x"), ("1", "y"), ("2", "x"), ("2", "y"), ("2", "y")]) == "partially_confounded"
    assert code([("1", "x"), ("1", "y"), ("2", "x"), ("2", "y"), ("3", "z"), ("3", "w"), ("4", "z"), ("4", "w")]) == "confounded"


def test_clusters(spark):
    rng = np.random.default_rng(4)
    for n, p in ((2, 3), (9, 2), (40, 4)):
        y = rng.normal(size=(p, n))
        want = dense.complete_linkage(y.T - y.T.mean(axis=0))
        got = stats.clusters(stats.gram(long(spark, y, "y"))).orderBy("step").collect()
        assert [(r.a, r.b, r["size"]) for r in got] == [(a, b, s) for a, b, _, s in want] and [r.height for r in got] == pytest.approx([h for *_, h, _ in want])
    ties = stats.complete_linkage(np.abs(np.subtract.outer(np.arange(6.0), np.arange(6.0))))
    assert len(ties) == 5 and ties[-1][2:] == (5.0, 6) and sum(h == 1 for *_, h, _ in ties) == 3
    assert stats.complete_linkage(np.zeros((1, 1))) == [] and stats.clusters(stats.gram(long(spark, np.zeros((2, 2)), "y").limit(0))).count() == 0


def test_stack_and_unstack(spark):
    cells = spark.createDataFrame([(b, f, s, None if (f, s) == ("f1", "s0") else float(i)) for i, (b, f, s) in enumerate((b, f"f{k}", f"s{j}") for b in ("A1B2", "A1B1") for k in range(5) for j in range(3))], "block string, feature string, sample string, value double").repartition(3)
    rows, keys = C.stacked(cells)
    assert [tuple(r) for r in keys.orderBy("row").collect()] == [(i, b, f"f{k}") for i, (b, k) in enumerate((b, k) for b in ("A1B1", "A1B2") for k in range(5))]
    assert sorted(map(str, C.unstacked(rows, keys).collect())) == sorted(map(str, cells.collect()))
    assert C.unstacked(rows.where("row <> 3"), keys).count() == 27
    with pytest.raises(SparkRuntimeException):
        C.unstacked(rows, keys.where("row <> 3")).collect()
    assert C.stacked(cells.limit(0))[1].count() == 0


def test_identical_vectors(spark):
    x = np.array([[1, 1, 2], [0, -0.0, 5], [np.nan, np.nan, np.nan]])
    got = missing.identical_vectors(long(spark, x), "sample", "feature").collect()
    assert len(got) == 1 and got[0].members == ["s00", "s01"]


def test_clusters_in_run_order():
    order = list(range(30))
    assert stats.clustered_in_order([i in (10, 11, 12, 13) for i in order], order)["p"] < 0.02
    assert stats.clustered_in_order([i in (1, 9, 20, 28) for i in order], order)["p"] > 0.2
    assert stats.mean_spread([1, 2, 4]) == pytest.approx(2)


def test_variants_of_a_matrix(spark):
    x = np.random.default_rng(10).normal(5, 1, (60, 8))
    x[:5, :3] = x[:5].min(axis=1, keepdims=True) - 1
    x[20:, 7] = np.nan
    found = C.variants(long(spark, x, "value").withColumn("y", F.col("value")))
    sizes = {n: d.select("feature").distinct().count() for n, d, _ in found}
    assert sizes == {"base": 20, "exclude_floor": 15, "floor_censored": 15, "q75": 60, "q50": 60}
    told = C.sensitivity(found, lambda d: "many" if d.count() > 300 else "few")
    assert told["depends"] and not told["same_conclusion"]


def test_design_structure_of_many_levels(spark):
    pairs = spark.range(12_000).selectExpr("concat('b', id div 2) b", "concat('d', (id + 1) div 2) d")  # one chain of all levels
    assert stats.design_structure(pairs, "b", "d").first().structure == "partially_confounded"


def test_combat_by_iterating_whole_matrices(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(10, 1, (40, 15)) * rng.gamma(4, 0.25, (40, 1))
    batch = np.repeat([0, 1, 2], 5)
    x += rng.normal(0, 1, (40, 3))[:, batch]
    x[3, :5] = 7.0  # no variance in one batch: left alone
    got = wide(transforms.combat(long(spark, x), spark.createDataFrame([(f"s{j:02}", f"b{b}") for j, b in enumerate(batch)], "sample string, batch string")))
    use = np.delete(np.arange(40), 3)
    d = x[use]
    within = np.stack([d[:, batch == b].mean(axis=1) for b in range(3)], axis=1)
    scale = np.sqrt(((d - within[:, batch]) ** 2).mean(axis=1, keepdims=True))
    z, want = (d - d.mean(axis=1, keepdims=True)) / scale, d.copy()
    for b in range(3):
        zb = z[:, batch == b]
        g, t = zb.mean(axis=1), zb.var(axis=1, ddof=1)
        a, s = (2 * t.var(ddof=1) + t.mean() ** 2) / t.var(ddof=1), (t.mean() * t.var(ddof=1) + t.mean() ** 3) / t.var(ddof=1)
        shift, wide_, change = g, t, 1
        while change > 1e-4:
            new = (g.var(ddof=1) * 5 * g + wide_ * g.mean()) / (g.var(ddof=1) * 5 + wide_)
            spread = (0.5 * ((zb - new[:, None]) ** 2).sum(axis=1) + s) / (5 / 2 + a - 1)
            change = max(np.max(np.abs(new - shift) / np.abs(shift)), np.max(np.abs(spread - wide_) / wide_))
            shift, wide_ = new, spread
        want[:, batch == b] = (zb - shift[:, None]) / np.sqrt(wide_)[:, None] * scale + d.mean(axis=1, keepdims=True)
    assert got[use] == pytest.approx(want, abs=1e-9) and got[3] == pytest.approx(x[3])


@pytest.mark.parametrize("op", [
    lambda c, p: transforms.normalize_median(c), lambda c, p: transforms.normalize_quantile(c), lambda c, p: transforms.batch_center(c, p), lambda c, p: transforms.combat(c, p),
    lambda c, p: transforms.drift_sample_loess(c, p), lambda c, p: transforms.drift_qc_loess(c, p, p.where("run_order % 3 = 0").select("sample")), lambda c, p: transforms.correct_batch_effects(c, p),
    lambda c, p: transforms.log_transform(c),
])
def test_blocks_do_not_mix(spark, op):
    rng = np.random.default_rng(9)
    one = long(spark, rng.normal(12, 1, (6, 16)))
    two = long(spark, rng.normal(40, 5, (6, 16))).withColumn("block", F.lit("A1B2"))
    plan = spark.createDataFrame([(f"s{j:02}", float(j), "ab"[j % 2]) for j in range(16)], "sample string, run_order double, batch string")
    both = op(one.unionByName(two), plan)
    for alone in (one, two):
        name = alone.first().block
        assert wide(both.where(F.col("block") == name)) == pytest.approx(wide(op(alone, plan)))


def test_units_and_shared_keys(spark):
    rows = [(b, f, s, 1.0) for b, fs, ss in (("A1B1", "ab", "xy"), ("A1B2", "cd", "xy"), ("A2B1", "ab", "xy"), ("A2B2", "bc", "xy"), ("A3B1", "e", "xy"), ("A3B2", "f", "xz")) for f in fs for s in ss]
    cells = spark.createDataFrame(rows, "block string, feature string, sample string, value double")
    assert {r.block: r.unit for r in transforms.units(cells).collect()} == {"A1B1": "A1", "A1B2": "A1", "A2B1": "A2B1", "A2B2": "A2B2", "A3B1": "A3B1", "A3B2": "A3B2"}
    assert {(r.one, r.two): r.n for r in transforms.shared_keys(cells).collect()} == {("A1B1", "A2B1"): 2, ("A1B1", "A2B2"): 1, ("A1B2", "A2B2"): 1, ("A2B1", "A2B2"): 1}
    joined = transforms.with_units(cells)
    low = {r.unit: r.n for r in joined.groupBy("unit").agg(F.count("*").alias("n")).collect()}
    assert low["A1"] == 8 and transforms.violations(cells, cells).first().asDict() == {"lost": 0, "added": 0, "gap_changed": 0, "new_infinite": 0, "changed_outside": 0}
    moved = cells.withColumn("value", F.when(F.col("block") == "A1B1", 2.0).otherwise(F.col("value")))
    assert transforms.violations(cells, moved, touched=F.col("block") == "A1B1").first().changed_outside == 0 and transforms.violations(cells, moved, touched=F.col("block") == "A1B2").first().changed_outside == 4


def test_pairs_of_more_samples_than_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(5, 1, (30, 11))
    x[rng.random(x.shape) < 0.2] = np.nan
    cells = long(spark, x, "y").repartition(3)
    want = sorted((r.s1, r.s2, r.n, round(r.r, 9)) for r in stats.sample_pairs(cells).collect())
    monkeypatch.setattr(stats, "DENSE_SAMPLES", 4)
    assert sorted((r.s1, r.s2, r.n, round(r.r, 9)) for r in stats.sample_pairs(cells).collect()) == want and len(want) == 55
    for s1, s2, n, r in want:
        a, b = x[:, int(s1[1:])], x[:, int(s2[1:])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert n == both.sum() and r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-8)


def test_median_normalisation_of_an_empty_sample(spark):
    x = np.array([[1.0, np.nan], [2.0, np.nan]])
    with pytest.raises(SparkRuntimeException, match="no value"):
        transforms.normalize_median(long(spark, x)).collect()
    assert wide(transforms.normalize_median(long(spark, [[1.0, 5.0], [3.0, 9.0]]))) == pytest.approx(np.array([[3.0, 2.0], [5.0, 6.0]]))
