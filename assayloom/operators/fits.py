"""Fits over all features: likelihoods and resampled slopes by passes that return sums, and variance components by restricted likelihood."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectra import Features, correlation_components

# ---------------------------------------------------------------- resampling

#: How likely a Poisson number of mean 1 is at most 0, 1, 2, ...
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
#: Weights that a step of a pass holds, and the fewest rows that it takes.
_AT_ONCE, _ROWS = 1 << 16, 256


def resampled(keys: np.ndarray, n: int, seed: int, draws: np.ndarray | None = None) -> np.ndarray:
    """Weights (keys x n + 1): 1 in the first column, then how often each of n resamples draws each row: Poisson numbers of mean 1 from
    hashes of the row's key, so that a row has the same weights in any partition and on any attempt. draws: these columns alone."""
    draws = np.arange(n + 1) if draws is None else np.asarray(draws)
    h = keys.astype(np.uint64)[:, None] + draws.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.where(draws > 0, np.searchsorted(_AT_MOST, u, "right"), 1.0)


def _sums(rows: DataFrame, of, width: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """draws x width: of(weights, columns) added up over the rows; draw 0 is the rows as they are, the others are resamples.
    A task returns one small array; they are added in a tree."""
    step = max(_ROWS, _AT_ONCE // len(draws))

    def run(batches):
        total = np.zeros((len(draws), width))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = [c.to_numpy() for c in batch.slice(at, step).columns]
                total += of(resampled(part[0], 0, seed, draws), *part[1:])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["z"])

    parts = rows.mapInArrow(run, "z binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(len(draws), width))
    return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros((len(draws), width))


def slopes(rows: DataFrame, x: str, y: str, key: str = "feature", n: int = 0, seed: int = 0) -> tuple[float, np.ndarray]:
    """The least-squares slope of y on x over all rows, and the slopes of n resamples, in one pass (after one for the means)."""
    data = rows.select(F.xxhash64(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    a, b = data.agg(F.avg("x"), F.avg("y")).first()
    if a is None:
        return math.nan, np.full(n, math.nan)
    of = lambda w, x, y: w.T @ np.stack([np.ones(len(x)), x - a, y - b, (x - a) ** 2, (x - a) * (y - b)], axis=1)
    w, sx, sy, sxx, sxy = _sums(data, of, 5, np.arange(n + 1), seed).T
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (sxy - sx * sy / w) / (sxx - sx * sx / w)
    return float(found[0]), found[1:]


def interval(found: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """The percentile interval of resampled values that are finite."""
    found = found[np.isfinite(found)]
    cut = 50 * (1 - level)
    return tuple(float(v) for v in np.percentile(found, [cut, 100 - cut])) if len(found) else (math.nan, math.nan)


# ---------------------------------------------------------------- detection


def _detection(n: int):
    """Sums over features of log-likelihood, score and information of logit p = b0 + b1 x, of binomials of n that can't be 0, by draw and its
    point (b0, b1). Where all draws are at one point, a feature's terms are found once."""

    def of(points: np.ndarray, w: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        one = (points == points[0]).all()
        at, powers, d = points[:1] if one else points, np.stack([np.ones(len(x)), x, x * x]), d[:, None]
        eta = at[:, 0] + x[:, None] * at[:, 1]
        less = np.exp(-np.abs(eta))
        log = np.log1p(less)
        log_p, log_q = np.minimum(eta, 0) - log, -np.maximum(eta, 0) - log
        up = eta >= 0
        p, q = np.where(up, 1, less) / (1 + less), np.where(up, less, 1) / (1 + less)
        seen = -np.expm1(n * log_q)  # the chance of any detection
        expect = n * p / seen
        score, weight = d - expect, np.maximum(expect * q - expect * expect * (1 - seen), 1e-12)
        value = d * log_p + (n - d) * log_q - np.log(seen)
        if one:
            return w.T @ np.concatenate([value, score, score * x[:, None], weight * powers.T], axis=1)
        return np.concatenate([(w * value).sum(axis=0)[None], powers[:2] @ (w * score), powers @ (w * weight)]).T

    return of


def _climbed(data: DataFrame, of, at: np.ndarray, draws: np.ndarray, seed: int, passes: int) -> np.ndarray:
    """Points (draws x 2) where each draw's likelihood is greatest, from the points at on.

    Newton's steps for all draws together: a pass over the rows returns six sums for each that is still open, at its trial point; where
    the likelihood fell the step is halved, else the next one is taken. A likelihood that stays the same within rounding ends a draw.
    """
    at = at.copy()
    trial, best, step, scale, open_ = at.copy(), np.full(len(at), -np.inf), np.zeros_like(at), np.ones(len(at)), np.ones(len(at), bool)
    for _ in range(passes):
        now = np.flatnonzero(open_)
        points = trial[now]
        value, s0, s1, h00, h01, h11 = _sums(data, lambda w, x, d, points=points: of(points, w, x, d), 6, draws[now], seed).T
        with np.errstate(invalid="ignore"):
            still = np.isfinite(best[now]) & (np.abs(value - best[now]) <= 1e-12 * (1 + np.abs(best[now])))
            better = still | (value >= best[now])
            determinant = h00 * h11 - h01 * h01
            safe = np.where(determinant > 1e-12 * h00 * h11, determinant, np.inf)
            move = np.stack([(h11 * s0 - h01 * s1) / safe, (h00 * s1 - h01 * s0) / safe], axis=1)
        up = now[better]
        at[up], best[up], step[up], scale[up] = trial[up], value[better], move[better], 1.0
        scale[now[~better]] /= 2
        open_[now] = ~still & (scale[now] > 1e-7) & (np.abs(step[now]).max(axis=1) > 1e-13)
        if not open_.any():
            break
        trial = at + scale[:, None] * step
    return at


def detection_curve(features: DataFrame, n: int, resamples: int = 0, seed: int = 0, passes: int = 100) -> tuple[float, float, np.ndarray]:
    """(b0, b1, b1 of each resample) of logit p = b0 + b1 * mean over rows (feature, mean, detected), by the likelihood of features seen in at
    least one of n samples. The resamples climb from where the data's own likelihood is greatest. Features never leave their tasks.
    """
    data = features.where("detected > 0 and mean is not null").select(F.xxhash64("feature").alias("key"), F.col("mean").cast("double").alias("x"), F.col("detected").cast("double").alias("d")).persist()
    centre, share = data.agg(F.avg("x"), F.avg("d") / n).first()
    if centre is None:
        data.unpersist()
        return math.nan, math.nan, np.full(resamples, math.nan)
    share, of = min(max(share, 0.05), 0.95), _detection(n)
    centred = lambda points, w, x, d: of(points, w, x - centre, d)
    at = _climbed(data, centred, np.array([[math.log(share / (1 - share)), 0.0]]), np.zeros(1, int), seed, passes)
    drawn = _climbed(data, centred, np.tile(at, (resamples, 1)), np.arange(1, resamples + 1), seed, passes) if resamples else at[:0]
    data.unpersist()
    return float(at[0, 0] - at[0, 1] * centre), float(at[0, 1]), drawn[:, 1]


# ---------------------------------------------------------------- variance components


@dataclass
class Fit:
    """Variances of the terms and the residual, the restricted log-likelihood, and how the fit ended: fitted, singular (a variance at its
    bound 0) or failed."""

    variances: np.ndarray
    value: float
    status: str


def _likelihood(theta, same, n, mean, within, size):
    """Restricted log-likelihood of cell means and the sum of squares within cells, its gradient and expected information."""
    parts = [*same, np.diag(1 / n)]
    v = sum(t * m for t, m in zip(theta, parts, strict=True))
    inverse = np.linalg.inv(v)
    ones = inverse.sum(axis=1)
    p = inverse - np.outer(ones, ones) / ones.sum()
    py, free = p @ mean, size - len(n)
    value = -0.5 * (np.linalg.slogdet(v)[1] + math.log(ones.sum()) + mean @ py + free * math.log(theta[-1]) + within / theta[-1] + np.log(n).sum())
    pv = [p @ m for m in parts]
    gradient = np.array([-0.5 * (np.trace(a) - py @ m @ py) for a, m in zip(pv, parts, strict=True)])
    gradient[-1] -= 0.5 * (free / theta[-1] - within / theta[-1] ** 2)
    information = np.array([[0.5 * (a * b.T).sum() for b in pv] for a in pv])
    information[-1, -1] += 0.5 * free / theta[-1] ** 2
    return value, gradient, information


def restricted_fit(codes: np.ndarray, n: np.ndarray, mean: np.ndarray, within: float, rounds: int = 500) -> Fit:
    """Variance components of crossed random terms around one mean, by restricted maximum likelihood.

    Observations that agree in all terms are one cell: codes (cells x terms) says which level of each term a cell has, n, mean and `within` are the
    cells' sizes and means and the sum of squares inside them. That suffices for the likelihood, so its matrices are cells x cells, not samples x
    samples. A term that has one level, a level for each observation, or the levels of a term before it can't be told apart: its
    variance is 0. Scoring steps on the variances, held at 0 or above, halved while the likelihood falls.
    """
    codes, n, mean = np.atleast_2d(codes), np.asarray(n, float), np.asarray(mean, float)
    size, terms = int(n.sum()), codes.shape[1]
    total = within + float((n * (mean - (n * mean).sum() / size) ** 2).sum())
    if size < 3 or not total > 1e-300:
        return Fit(np.zeros(terms + 1), math.nan, "failed")
    known, use = set(), []
    for t in range(terms):
        levels = np.unique(codes[:, t], return_inverse=True)[1]
        if 1 < levels.max() + 1 < size and (name := tuple(levels)) not in known:
            known.add(name)
            use.append(t)
    same = [(codes[:, t][:, None] == codes[:, t][None, :]).astype(float) for t in use]
    unit = total / (size - 1)
    theta = np.full(len(use) + 1, unit / (len(use) + 1))
    floor = np.zeros(len(theta))
    floor[-1] = 1e-9 * unit
    try:
        value, gradient, information = _likelihood(theta, same, n, mean, within, size)
        for _ in range(rounds):
            free = (theta > floor) | (gradient > 0)
            step = np.zeros(len(theta))
            step[free] = np.linalg.lstsq(information[np.ix_(free, free)], gradient[free], rcond=None)[0]
            scale, moved = 1.0, None
            while scale > 1e-9:
                trial = np.maximum(theta + scale * step, floor)
                found = _likelihood(trial, same, n, mean, within, size)
                if found[0] >= value:
                    moved = trial
                    break
                scale /= 2
            if moved is None:
                break
            done = np.abs(moved - theta).max() <= 1e-11 * unit
            theta, (value, gradient, information) = moved, found
            if done:
                break
    except (np.linalg.LinAlgError, ValueError):
        return Fit(np.zeros(terms + 1), math.nan, "failed")
    out = np.zeros(terms + 1)
    out[use], out[-1] = theta[:-1], theta[-1]
    singular = theta[-1] <= 2 * floor[-1] or bool((theta[:-1] <= 1e-9 * unit).any()) or len(use) < terms
    return Fit(out, value, "singular" if singular else "fitted")


def explained(codes: np.ndarray, n: np.ndarray, mean: np.ndarray, within: float) -> np.ndarray:
    """Each term's eta squared and what is left, summing to 1: for where the restricted fit fails."""
    n, mean = np.asarray(n, float), np.asarray(mean, float)
    grand = (n * mean).sum() / n.sum()
    total = within + (n * (mean - grand) ** 2).sum()
    shares = []
    for t in range(codes.shape[1]):
        level = np.unique(codes[:, t], return_inverse=True)[1]
        count, sums = np.bincount(level, n), np.bincount(level, n * mean)
        shares.append(float((count * (sums / count - grand) ** 2).sum() / total) if total > 0 else 0.0)
    over = max(1.0, sum(shares))
    return np.array([s / over for s in shares] + [max(0.0, 1 - sum(shares) / over)])


def terms_of(factors: list[str], interactions: bool = True) -> list[tuple[str, ...]]:
    return [(f,) for f in factors] + (list(combinations(factors, 2)) if interactions else [])


COMPONENTS = "term string, variance double, status string, n long"


def variance_fits(values: DataFrame, by: list[str], factors: list[str], value: str = "y", interactions: bool = True) -> DataFrame:
    """(by, term, variance, status, n) for each group of values: the components of `value` by factor, pair of factors ("a:b") and "residual".

    Spark reduces each group to one row per combination of levels (number, mean and squares about it); a group is then fitted in its task.
    Status: fitted, singular, or eta_squared where the fit failed and shares of the sum of squares stand in. NULL values don't count; a NULL
    level is a level.
    """
    terms = terms_of(factors, interactions)
    v, keys = F.col(value).cast("double"), [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(factors)]
    cells = values.where(v.isNotNull()).groupBy(*by, *keys).agg(F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("w"))

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values([f"f{i}" for i in range(len(factors))])
        label = {f: pdf[f"f{i}"].astype(str) for i, f in enumerate(factors)}
        codes = np.stack([np.unique(["\x1f".join(x) for x in zip(*(label[f] for f in t), strict=True)], return_inverse=True)[1] for t in terms], axis=1)
        n, mean, within = pdf["n"].to_numpy(float), pdf["m"].to_numpy(float), float(pdf["w"].sum())
        found = restricted_fit(codes, n, mean, within)
        variances, status = (found.variances, found.status) if found.status != "failed" else (explained(codes, n, mean, within), "eta_squared")
        out = pd.DataFrame({"term": [*(":".join(t) for t in terms), "residual"], "variance": variances, "status": status, "n": int(n.sum())})
        for b in reversed(by):
            out.insert(0, b, pdf[b].iloc[0])
        return out

    schema = "".join(f"{b} {values.schema[b].dataType.simpleString()}, " for b in by) + COMPONENTS
    return cells.groupBy(*by).applyInPandas(fit, schema)


def variance_components(cells: DataFrame, samples: DataFrame, factors: list[str], value: str = "y", cumulative: float = 0.6, interactions: bool = True, seed: int = 0) -> DataFrame:
    """(term, share, n_singular, n_fallback): how the variance between samples divides among factors, pairs of factors and the rest.

    The principal components of the samples' correlation matrix, to the cumulative share (three at least), are fitted each by its own mixed model;
    a component's variances, scaled to 1, weigh by its share. n_singular and n_fallback say for how many components the fit
    ended at a bound, or failed and shares of the sum of squares stood in. samples: one row per sample, with its factors.
    """
    spark, features = cells.sparkSession, Features(cells, value)
    vectors, shares = correlation_components(features, cumulative, seed=seed)
    features.close()
    rows = [(s, j, float(vectors[i, j])) for i, s in enumerate(features.names) for j in range(len(shares))]  # samples x components
    weight = spark.createDataFrame([(j, float(w)) for j, w in enumerate(shares)], "pc int, weight double")
    scores = spark.createDataFrame(rows, "sample string, pc int, y double").join(samples.select("sample", *factors), "sample", "left")
    found = variance_fits(scores, ["pc"], factors, "y", interactions).join(weight, "pc")
    own = found.groupBy("pc").agg(F.sum("variance").alias("whole"))
    parts = found.join(own, "pc").withColumn("part", F.coalesce(F.try_divide("variance", "whole") * F.col("weight"), F.lit(0.0)))
    sums = parts.groupBy("term").agg(F.sum("part").alias("part"), F.sum((F.col("status") == "singular").cast("long")).alias("n_singular"), F.sum((F.col("status") == "eta_squared").cast("long")).alias("n_fallback"))
    whole = sums.agg(F.sum("part").alias("whole"))
    return sums.join(F.broadcast(whole)).select("term", F.try_divide("part", "whole").alias("share"), "n_singular", "n_fallback")  # whole: one row
