"""Vector operators against brute force."""

import numpy as np
import pytest

from assayloom.llm import ann, embedding_dedup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"
NAN, INF = float("nan"), float("inf")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def crowd(spark):
    """Vectors with copies, near copies around hubs, chains and odd rows."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for label in (0, 1):
        for _ in range(30):
            hub = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 9))):
                v = hub + rng.normal(size=8) * rng.choice([0, 0.05, 0.15, 0.3])
                rows.append((at, [float(np.float32(x)) for x in v], label, "x", 1))
                at += 1
        for angle in np.arange(0, 1.2, 0.15):  # a chain: neighbours link, ends do not
            rows.append((at, [float(np.float32(x)) for x in (np.cos(angle), np.sin(angle), 0, 0, 0, 0, 0, 0)], label, None, None))
            at += 1
    odd = [(None, rows[0][1], 0, "x", 1), (at, None, 0, "x", 1), (at + 1, [], 0, "x", 1), (at + 2, [0.0] * 8, 0, "x", 1), (at + 3, [NAN] * 8, 0, "x", 1), (at + 4, [INF] + [1.0] * 7, 0, "x", 1), (at + 5, rows[0][1], None, "x", 1), (at + 6, [1.0] * 5, 0, "x", 1), (at + 7, [None] + [1.0] * 7, 0, "x", 1), rows[3]]
    return rows, odd, spark.createDataFrame(rows + odd, SCHEMA).repartition(3)


def test_embedding_dedup(crowd):
    rows, odd, df = crowd
    valid = [*rows, odd[-1]]
    ids, labels, x = np.array([r[0] for r in valid]), np.array([r[2] for r in valid]), unit(np.array([r[1] for r in valid]))
    link = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 10**9).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    want = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp, strict=True))
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    known = {r[0] for r in rows}
    assert sorted(tuple(r) for r in got if r.vec_id in known) == want
    rest = [r for r in got if r.vec_id not in known]
    assert len(rest) == len(odd) - 1 and all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in rest)


def test_tiles_of_large_cells(crowd, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE_MAX", 5)
    want = sorted(map(str, embedding_dedup.near_duplicate_vectors(crowd[2]).collect()))
    monkeypatch.undo()
    assert sorted(map(str, embedding_dedup.near_duplicate_vectors(crowd[2]).collect())) == want


def test_cells_grow_with_the_table(spark, crowd, monkeypatch):
    """The test vectors get one cell at their own size and 256 from 200,000 rows on; more cells lose no link."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding", "label").collect()
    x, labels = unit(np.array([r.embedding for r in rows], float)), len({r.label for r in rows})
    cells = [len(embedding_dedup.fit_cells(x, n, labels, 0.98, 23)) for n in (2_000, 200_000, 2_000_000, 20_000_000)]
    assert cells[0] == 1 and min(cells[1:]) >= 256
    want = sorted(map(str, embedding_dedup.near_duplicate_vectors(crowd[2]).collect()))
    many = unit(np.random.default_rng(2).normal(size=(40, 8)))
    monkeypatch.setattr(embedding_dedup, "fit_cells", lambda *a: many)
    assert sorted(map(str, embedding_dedup.near_duplicate_vectors(crowd[2]).collect())) == want


def brute(rows, every, top):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    n, out = np.linalg.norm(x, axis=1), {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i] / (n * n[i])
        other = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in other[np.lexsort([ids[other], -s[other]])][:top]]
    return out


def recall(found, want):
    hits = total = 0
    for q, best in want.items():
        got = {r.vec_id for r in found if r.query_id == q}
        hits += sum(i in got for i, _ in best)
        total += len(best)
    return hits / total


def test_ann_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    found, want = queries.op4_ann_search(spark, "/root/testdata/sf0.1").collect(), brute(rows, 50, 5)
    assert len(found) == sum(map(len, want.values())) and recall(found, want) == 1
    exact = {(q, i): s for q, best in want.items() for i, s in best}
    for r in found:
        assert 1 <= r.rank <= 5 and abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12


def test_ann_over_many_blocks(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = sorted(map(tuple, ann.nearest(table).collect()))
    for name, value in (("BLOCK", 150), ("QUERIES", 7), ("FIRST", 3), ("ROWS", 40), ("AT_ONCE", 3)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, ann.nearest(table.repartition(5)).collect())) == want


def test_ann_on_odd_rows(spark, crowd):
    rows, odd, df = crowd
    found = ann.nearest(df, every=10).collect()
    want = brute(rows + [odd[6]], 10, 5)
    assert recall(found, want) == 1 and {r.query_id for r in found} == set(want)
    for q, best in want.items():
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in best]
    same = spark.createDataFrame([(i, [1.0, 2.0], 0, "x", 1) for i in range(40)], SCHEMA)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(same, every=20).collect()}
    assert got == {(q, k + 1): i for q in (0, 20) for k, i in enumerate(i for i in range(6) if i != q) if k < 5}
    assert ann.nearest(same.where("vec_id < 2"), every=20).count() == 1


def test_ann_with_repeated_rows(spark):
    rng = np.random.default_rng(5)
    plain = [(i, [float(np.float32(v)) for v in rng.normal(size=6)], 0, "x", 1) for i in range(1, 60)]
    plain[30] = (31, plain[19][1], 0, "x", 1)  # another id with the vector of query 20
    for repeated in ([plain[3]] * 6, [plain[19]] * 7, [plain[30]] * 9 + [plain[19]] * 9):
        got = sorted(map(tuple, ann.nearest(spark.createDataFrame(plain + repeated, SCHEMA).repartition(4), every=20).collect()))
        want = brute(plain, 20, 5)
        assert [(q, k, i) for q, k, i, _ in got] == [(q, k + 1, i) for q in sorted(want) for k, (i, _) in enumerate(want[q])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none).count() == 0 and embedding_dedup.near_duplicate_vectors(none).count() == 0


@pytest.mark.parametrize("noise", [0.0125, 0.0004])  # cosines of about 0.99 and 0.999
def test_bounds_hold_in_a_large_group(noise):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8192, 64))
    x[:2700] = unit(rng.normal(size=(1, 64))) + rng.normal(size=(2700, 64)) * noise
    x = unit(unit(x).astype(np.float32).astype(float))
    q = ann.Quantiser(x[rng.permutation(8192)[:2048]])
    codes = q.pack(x)
    asked = np.r_[:100, 8092:8192]
    near = x[asked] @ x.T
    least = np.sort(near, axis=1)[:, -6] - ann.EPS
    need = ann.needed(*q.scores(x[asked], codes), least, *q.errors(x, codes))
    assert need[near >= least[:, None]].all()


def test_few_rows_are_reranked():
    """The share of rows that exact scoring sees, with the bound that the search starts from."""
    rng = np.random.default_rng(11)
    x = unit(rng.normal(size=(50_000, 64)))
    q = ann.Quantiser(x[:8192])
    codes, asked = q.pack(x), x[:100]
    scores, slack = q.scores(asked, codes)
    near, first = asked @ x.T, np.argpartition(-scores, ann.FIRST, axis=1)[:, : ann.FIRST]
    least = np.sort(np.take_along_axis(near, first, 1), axis=1)[:, -6]
    share = ann.needed(scores, slack, least, *q.errors(x, codes)).mean()
    assert share < 0.01
