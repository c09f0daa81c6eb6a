"""Fits and spectra against dense linear algebra, closed forms and one process."""

import itertools

import numpy as np
import pytest

import dense as one_process
from assayloom.operators import fits, spectra, stats


def cells_of(spark, y, names=None, features=None):
    rows = [(f"f{i:04d}" if features is None else features[i], names[j] if names else f"s{j:05d}", float(v)) for i, row in enumerate(y) for j, v in enumerate(row) if v == v]
    return spark.createDataFrame(rows, "feature string, sample string, y double")


def reduced(y, labels):
    """Cells of equal labels: codes, sizes, means, squares within."""
    keys = sorted(set(labels))
    groups = [np.array([v for v, k in zip(y, labels, strict=True) if k == key]) for key in keys]
    return keys, np.array([len(g) for g in groups]), np.array([g.mean() for g in groups]), float(sum(((g - g.mean()) ** 2).sum() for g in groups))


def dense(theta, y, codes):
    """The restricted log-likelihood by N x N matrices."""
    v = theta[-1] * np.eye(len(y)) + sum(t * (c[:, None] == c[None, :]) for t, c in zip(theta, codes.T, strict=False))
    one = np.ones((len(y), 1))
    inverse = np.linalg.inv(v)
    m = one.T @ inverse @ one
    r = y - float((one.T @ inverse @ y)[0] / m[0, 0])
    return -0.5 * (np.linalg.slogdet(v)[1] + np.log(m[0, 0]) + r @ inverse @ r)


@pytest.mark.parametrize("seed, effect", [(0, 2.0), (1, 0.7), (2, 0.0)])
def test_one_way_fit_is_the_analysis_of_variance(seed, effect):
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(6), 5)
    y = rng.normal(size=6)[a] * effect + rng.normal(size=30)
    keys, n, mean, within = reduced(y, a.tolist())
    fit = fits.restricted_fit(np.array(keys)[:, None], n, mean, within)
    between = 5 * ((mean - y.mean()) ** 2).sum() / 5
    inside = within / 24
    if between > inside:
        assert fit.status == "fitted" and np.allclose(fit.variances, [(between - inside) / 5, inside], rtol=1e-6)
    else:
        assert fit.status == "singular" and np.allclose(fit.variances, [0, ((y - y.mean()) ** 2).sum() / 29], rtol=1e-6)


def test_balanced_crossed_fit_is_the_analysis_of_variance():
    rng = np.random.default_rng(3)
    a, b, r = 4, 3, 4
    la, lb = np.repeat(np.arange(a), b * r), np.tile(np.repeat(np.arange(b), r), a)
    y = rng.normal(size=a)[la] * 3 + rng.normal(size=b)[lb] * 2 + rng.normal(size=(a, b))[la, lb] * 1.5 + rng.normal(size=len(la)) * 0.5
    keys, n, mean, within = reduced(y, list(zip(la.tolist(), lb.tolist(), strict=True)))
    codes = np.array([(x, z, x * b + z) for x, z in keys])
    fit = fits.restricted_fit(codes, n, mean, within)
    grid = mean.reshape(a, b)
    ma, mb = grid.mean(axis=1), grid.mean(axis=0)
    msa, msb = b * r * ma.var(ddof=1), a * r * mb.var(ddof=1)
    msab = r * ((grid - ma[:, None] - mb[None, :] + grid.mean()) ** 2).sum() / ((a - 1) * (b - 1))
    mse = within / (a * b * (r - 1))
    assert fit.status == "fitted" and np.allclose(fit.variances, [(msa - msab) / (b * r), (msb - msab) / (a * r), (msab - mse) / r, mse], rtol=1e-6)


def test_unbalanced_fits_are_the_optimum_of_the_dense_likelihood():
    rng = np.random.default_rng(4)
    for seed in range(6):
        n = 24
        la, lb = rng.integers(0, 4, n), rng.integers(0, 3, n)
        y = rng.normal(size=4)[la] * rng.choice([0, 2]) + rng.normal(size=3)[lb] + rng.normal(size=n)
        keys, size, mean, within = reduced(y, list(zip(la.tolist(), lb.tolist(), strict=True)))
        fit = fits.restricted_fit(np.array([(a, b, a * 3 + b) for a, b in keys]), size, mean, within)
        codes = np.stack([la, lb, la * 3 + lb], axis=1)
        best = dense(fit.variances, y, codes)
        assert np.isclose(best, fit.value), seed
        for i, d in itertools.product(range(4), (1e-3, -1e-3, 0.1, -0.1)):
            trial = fit.variances.copy()
            trial[i] = max(0.0, trial[i] + d)
            assert trial[-1] <= 0 or dense(trial, y, codes) <= best + 1e-8


def test_what_a_fit_cannot_tell_apart():
    y = np.array([1.0, 2.0, 4.0, 3.0])
    codes = np.array([[0, 0, 0, 5], [0, 1, 0, 5], [1, 2, 1, 5], [1, 3, 1, 5]])  # a level for each observation, a copy of the first term, one level
    fit = fits.restricted_fit(codes, np.ones(4), y, 0.0)
    assert fit.status == "singular" and (fit.variances[1:4] == 0).all() and fit.variances[0] > 0
    assert fits.restricted_fit(codes, np.ones(4), np.ones(4), 0.0).status == "failed"
    assert fits.restricted_fit(codes[:2], np.ones(2), y[:2], 0.0).status == "failed"
    shares = fits.explained(codes, np.ones(4), y, 0.0)
    assert np.isclose(shares.sum(), 1) and shares[1] > shares[0]


def test_variance_fits_by_group(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in ("x", "y"):
        la, lb = rng.integers(0, 4, 40), rng.integers(0, 3, 40)
        y = rng.normal(size=4)[la] * 2 + rng.normal(size=40)
        rows += [(g, f"a{a}", f"b{b}", float(v)) for a, b, v in zip(la, lb, y, strict=True)] + [(g, None, "b0", None)]
        keys, n, mean, within = reduced(y, list(zip(la.tolist(), lb.tolist(), strict=True)))
        want[g] = fits.restricted_fit(np.array([(a, b, a * 3 + b) for a, b in keys]), n, mean, within)
    df = spark.createDataFrame(rows, "grp string, a string, b string, y double").repartition(3)
    got = {(r.grp, r.term): r for r in fits.variance_fits(df, ["grp"], ["a", "b"]).collect()}
    for g, fit in want.items():
        found = [got[g, t] for t in ("a", "b", "a:b", "residual")]
        assert np.allclose([r.variance for r in found], fit.variances, atol=1e-7) and {r.status for r in found} == {fit.status} and {r.n for r in found} == {40}
    assert fits.variance_fits(df.limit(0), ["grp"], ["a"]).count() == 0
    constant = spark.createDataFrame([("z", "a", 1.0), ("z", "b", 1.0), ("z", "b", 1.0)], "grp string, a string, y double")
    assert {r.status for r in fits.variance_fits(constant, ["grp"], ["a"]).collect()} == {"eta_squared"}


def test_components_find_the_batch(spark):
    rng = np.random.default_rng(6)
    batch, group = np.repeat(np.arange(3), 8), np.tile(np.arange(2), 12)
    y = rng.normal(size=(300, 24)) * 0.5 + rng.normal(size=(300, 3))[:, batch] + rng.normal(size=(300, 2))[:, group] * 0.3
    names = [f"s{j:02d}" for j in range(24)]
    samples = spark.createDataFrame([(s, f"b{b}", f"g{g}") for s, b, g in zip(names, batch, group, strict=True)], "sample string, batch string, grp string")
    got = {r.term: r for r in fits.variance_components(cells_of(spark, y, names), samples, ["batch", "grp"]).collect()}
    assert set(got) == {"batch", "grp", "batch:grp", "residual"} and sum(r.share for r in got.values()) == pytest.approx(1)
    assert got["batch"].share > 0.5 > got["grp"].share and got["batch"].n_fallback == 0
    # the same by dense algebra
    a = y - y.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(np.corrcoef(a.T))
    values, vectors = values[::-1] / values.sum(), vectors[:, ::-1]
    keep = max(3, int(np.searchsorted(np.cumsum(values), 0.6, "right")) + 1)
    total = np.zeros(4)
    for j in range(keep):
        keys, n, mean, within = reduced(vectors[:, j], list(zip(batch.tolist(), group.tolist(), strict=True)))
        v = fits.restricted_fit(np.array([(x, z, x * 2 + z) for x, z in keys]), n, mean, within).variances
        total += v / v.sum() * values[j]
    assert np.allclose([got[t].share for t in ("batch", "grp", "batch:grp", "residual")], total / total.sum(), atol=1e-6)


@pytest.mark.parametrize("n, k", [(1, 1), (5, 3), (300, 4), (300, 40)])
def test_top_against_eigh(n, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(2 * n, n)) * np.linspace(3, 1, n)
    m = x.T @ x
    values, vectors = spectra.top(lambda q: m @ q, n, k)
    want, w = np.linalg.eigh(m)
    want, w = want[::-1][:k], w[:, ::-1][:, :k]
    assert np.allclose(values, want, rtol=1e-9) and np.allclose(np.abs((vectors * w).sum(axis=0)), 1, atol=1e-8)
    low = x[:2].T @ x[:2]  # fewer directions than asked for
    assert np.allclose(spectra.top(lambda q: low @ q, n, k)[0], np.linalg.eigvalsh(low)[::-1][:k], atol=1e-8 * low.max())


def test_components_and_distances_equal_those_of_the_gram_matrix(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=(200, 30)) + rng.normal(size=(200, 3))[:, np.arange(30) % 3]
    cells = cells_of(spark, y).repartition(5)
    features = spectra.Features(cells)
    names, k = one_process.gram_matrix(stats.gram(cells))
    assert features.names == names
    for got, want in zip(spectra.components(features, 6), one_process.pca(k, 6), strict=True):
        assert np.allclose(got, want, atol=1e-8)
    codes = np.stack([np.arange(30) % 3, *(rng.permutation(30) % 3 for _ in range(20))])
    numbers = rng.normal(size=(7, 30))
    for small in (spectra.SIDE, 200):
        spectra.SIDE, kept = small, spectra.SIDE
        for got, want in zip(spectra.permanova(features, codes), one_process.permanova(k, codes), strict=True):
            assert np.allclose(got, want)
        for got, want in zip(spectra.permanova(features, numbers, True), one_process.permanova_numeric(k, numbers), strict=True):
            assert np.allclose(got, want)
        spectra.SIDE = kept
    use = [i for i in range(30) if i % 5]
    c = np.eye(len(use)) - 1 / len(use)
    for got, want in zip(spectra.permanova(features.only(use), codes[:, use]), one_process.permanova(c @ k[np.ix_(use, use)] @ c, codes[:, use]), strict=True):
        assert np.allclose(got, want)
    features.close()
    none = spectra.Features(cells.limit(0))
    assert none.names == [] and spectra.components(none, 3)[0].shape == (0, 0)


def test_many_samples(spark):
    """20,000 samples: their Gram matrix would have 400 million entries."""
    n, p = 20_000, 12
    cells = spark.range(n * p).selectExpr("concat('f', id % 12) as feature", "concat('s', lpad(cast(id div 12 as string), 6, '0')) as sample", f"sin(id % 12 + 1) * (id div 12) / {n} + cos((id div 12) * (id % 12 + 2)) as y")
    features = spectra.Features(cells)
    scores, shares = spectra.components(features, 3)
    j, i = np.arange(n)[:, None], np.arange(p)[None, :]
    y = np.sin(i + 1) * j / n + np.cos(j * (i + 2))
    y -= y.mean(axis=0)
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(shares, s[:3] ** 2 / (s**2).sum(), rtol=1e-9) and np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    r2, _ = spectra.permanova(features, np.arange(n) % 4)
    want = sum(y[np.arange(n) % 4 == g].sum(axis=0) @ y[np.arange(n) % 4 == g].sum(axis=0) / (n / 4) for g in range(4)) / (y**2).sum()
    assert np.isclose(r2[0], want)
    features.close()


def test_detection_curve_and_its_resamples(spark):
    rng = np.random.default_rng(8)
    n, m = 12, rng.normal(20, 2, 500)
    d = rng.binomial(n, 1 / (1 + np.exp(-(m - 19) * 0.8)))
    rows = [(f"f{i}", float(a), int(b)) for i, (a, b) in enumerate(zip(m, d, strict=True))] + [("none", None, 3)]
    df = spark.createDataFrame(rows, "feature string, mean double, detected long").repartition(4)
    b0, b1, many = fits.detection_curve(df, n, 6, seed=3)
    seen = d > 0
    assert np.allclose((b0, b1), one_process.detection_curve(m[seen], d[seen], n), rtol=1e-5)
    keys = {r.feature: r.k for r in df.selectExpr("feature", "xxhash64(feature) as k").collect()}
    w = fits.resampled(np.array([keys[f"f{i}"] for i in range(500)]), 6, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.1
    for r in range(6):
        at = np.repeat(np.flatnonzero(seen), w[seen, r + 1].astype(int))
        assert np.isclose(many[r], one_process.detection_curve(m[at], d[at], n)[1], rtol=1e-4)
    assert fits.detection_curve(df.repartition(1), n, 6, seed=3)[2] == pytest.approx(many, rel=1e-8)
    assert np.isnan(fits.detection_curve(df.limit(0), n, 2)[1])


def test_slopes_and_intervals(spark):
    rng = np.random.default_rng(9)
    x, keys = rng.normal(size=400), [f"f{i}" for i in range(400)]
    y = 1.5 * x + rng.normal(size=400) + 100
    df = spark.createDataFrame([*zip(keys, x.tolist(), y.tolist(), strict=True), ("gap", None, 1.0)], "feature string, x double, y double").repartition(3)
    slope, many = fits.slopes(df, "x", "y", n=300, seed=1)
    assert np.isclose(slope, np.polyfit(x, y, 1)[0])
    hashed = {r.feature: r.k for r in df.selectExpr("feature", "xxhash64(feature) as k").collect()}
    w = fits.resampled(np.array([hashed[k] for k in keys]), 300, 1)
    assert np.isclose(many[4], np.polyfit(x, y, 1, w=np.sqrt(w[:, 5]))[0])
    low, high = fits.interval(many)
    assert low < slope < high and 0.1 < high - low < 0.4  # four standard errors of about 0.05
    assert np.isnan(fits.slopes(df.limit(0), "x", "y", n=2)[0]) and np.isnan(fits.interval(np.array([np.nan]))[0])


@pytest.mark.parametrize("tile", [1024, 16])
def test_feature_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spectra, "TILE", tile)
    rng = np.random.default_rng(10)
    hubs = rng.normal(size=(9, 20))
    y = np.vstack([s * h + rng.normal(size=20) * 0.3 for h in hubs for s in (1, -1, 2, 0.5, 3, 1, 1, -2)] + [rng.normal(size=20) for _ in range(20)] + [np.full(20, 7.0)])
    names = [f"f{i:04d}" for i in range(len(y))]
    parent = spark.createDataFrame([(f, str(i // 8)) for i, f in enumerate(names)], "feature string, parent string")
    got = {(r.feature, r["rank"]): (r.other, r.same_parent, r.r) for r in spectra.feature_links(cells_of(spark, y, features=names), parent, 0.8, 3).collect()}
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(y)
    want = {}
    for i in range(len(y)):
        near = sorted((-abs(r[i, j]), names[j], j) for j in range(len(y)) if j != i and abs(r[i, j]) >= 0.8)
        want |= {(names[i], k): (f, i // 8 == j // 8, r[i, j]) for k, (_, f, j) in enumerate(near[:3], 1)}
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and np.isclose(got[k][2], want[k][2]) for k in want)
    assert spectra.feature_links(cells_of(spark, y[-1:]), parent, 0.8).count() == 0


def test_far_tiles_are_left_out():
    rng = np.random.default_rng(11)
    centres = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    reach = np.full(30, 0.2)
    z = np.vstack([c * np.cos(a) + np.linalg.qr(np.stack([c, rng.normal(size=30)], axis=1))[0][:, 1] * np.sin(a) for c in centres for a in (0.05, 0.2)])
    pairs = spectra.close_tiles(centres, reach, 0.9)
    assert pairs == [(i, i) for i in range(30)]
    wide = set(spectra.close_tiles(centres, reach, 0.3))
    near = np.abs(z @ z.T)
    assert all((min(i, j) // 2, max(i, j) // 2) in wide for i, j in np.argwhere(near >= 0.3))
