"""One process, dense matrices: what the distributed fits and spectra are held against."""

from __future__ import annotations

import math

import numpy as np


def gram_matrix(g) -> tuple[list[str], np.ndarray]:
    """The samples in order and their Gram matrix, from gram(): n x n numbers, of samples, not of cells."""
    rows = g.toArrow().to_pydict()
    names = sorted(set(rows["s1"]) | set(rows["s2"]))
    at = {s: i for i, s in enumerate(names)}
    k = np.zeros((len(names), len(names)))
    for a, b, v in zip(rows["s1"], rows["s2"], rows["g"], strict=True):
        k[at[a], at[b]] = k[at[b], at[a]] = v
    return names, k


def pca(k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (samples x n) and variance shares, from a Gram matrix; each component's largest absolute score is positive."""
    values, vectors = np.linalg.eigh(k)
    order = np.argsort(-values)[:n]
    values_all, values, vectors = np.maximum(values, 0), np.maximum(values[order], 0), vectors[:, order]
    scores = vectors * np.sqrt(values)
    signs = np.where(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])] < 0, -1.0, 1.0)
    total = values_all.sum()
    return scores * signs, values / total if total > 0 else np.zeros(len(values))


def permanova(k: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R2 and pseudo-F of one factor, for each row of a code matrix (permutations x samples)."""
    codes = np.atleast_2d(codes)
    n, levels, total = len(k), np.unique(codes), float(np.trace(k))
    between = np.zeros(len(codes))
    for level in levels:
        m = (codes == level).astype(float)
        count = m.sum(axis=1)
        between += np.divide(((m @ k) * m).sum(axis=1), count, out=np.zeros(len(codes)), where=count > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / (len(levels) - 1)) / ((total - between) / (n - len(levels)))
    return between / total if total > 0 else between * 0, f


def permanova_numeric(k: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one numeric predictor per row."""
    x = np.atleast_2d(np.asarray(x, float))
    c, total = x - x.mean(axis=1, keepdims=True), float(np.trace(k))
    size = (c**2).sum(axis=1)
    fitted = np.divide(((c @ k) * c).sum(axis=1), size, out=np.zeros(len(c)), where=size > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = fitted / ((total - fitted) / (len(k) - 2))
    return fitted / total if total > 0 else fitted * 0, f


def detection_curve(mean, detected, n: int, rounds: int = 200) -> tuple[float, float]:
    """(b0, b1) of logit p = b0 + b1 * mean, by the likelihood of binomials that can't be 0: features seen in at least one sample."""
    mean, d = np.asarray(mean, float), np.asarray(detected, float)
    x = mean - mean.mean()
    share = float(np.clip(d.mean() / n, 0.05, 0.95))
    b = np.array([math.log(share / (1 - share)), 0.0])

    def value(b):
        eta = b[0] + b[1] * x
        log_p, log_q = -np.logaddexp(0, -eta), -np.logaddexp(0, eta)
        return float((d * log_p + (n - d) * log_q - np.log(-np.expm1(n * log_q))).sum())

    best = value(b)
    for _ in range(rounds):
        eta = b[0] + b[1] * x
        p = 1 / (1 + np.exp(-eta))
        seen = -np.expm1(-n * np.logaddexp(0, eta))  # chance of any detection
        expect = n * p / seen
        score = d - expect
        weight = np.maximum(n * p * (1 - p) / seen - expect**2 * (1 - seen), 1e-9)
        design = np.stack([np.ones_like(x), x])
        step = np.linalg.lstsq((design * weight) @ design.T, design @ score, rcond=None)[0]
        scale = 1.0
        while scale > 1e-6 and not (new := value(b + scale * step)) >= best:
            scale /= 2
        if scale <= 1e-6:
            break
        b, gain, best = b + scale * step, new - best, new
        if gain < 1e-12 * (1 + abs(best)):
            break
    return float(b[0] - b[1] * mean.mean()), float(b[1])


def complete_linkage(points: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of complete-linkage clustering of rows; clusters are numbered on from the rows."""
    n = len(points)
    d = np.sqrt(np.maximum(0, ((points[:, None] - points[None]) ** 2).sum(axis=2)))
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = sorted(np.unravel_index(int(d.argmin()), d.shape))
        out.append((min(names[i], names[j]), max(names[i], names[j]), float(d[i, j]), sizes[i] + sizes[j]))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = d[j] = d[:, j] = np.inf
        names[i], sizes[i] = n + step, sizes[i] + sizes[j]
    return out
