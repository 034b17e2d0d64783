import math

import numpy as np
import pytest

NAN, INF = math.nan, math.inf


def brute(rows, modulus, k=20):
    """(query, rank, id, score) by all inner products; rows are (id, vector)."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(fine):
        if i % modulus == 0:
            found = []
            for other, (j, w) in enumerate(fine):
                if other != at:
                    s = 0.0
                    for a, b in zip(v, w, strict=False):
                        s += a * b
                    found.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, k string, list int").repartition(3)


def floats(x):
    return [[float(v) for v in r] for r in np.asarray(x, np.float32)]


def test_odd_vectors(spark):
    """Nulls, zeros, lengths, repeats of rows and ids, copies with ties, fewer rows than are asked for."""
    from vireo.llm.neighbours import search

    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (4, [1.0, 2.0]), (2, [0.0, 0.0]), (6, [NAN, 1.0]), (8, [INF, 1.0]), (10, None), (12, []), (14, [None, 1.0]), (None, [5.0, 5.0]), (3, [1.0]), (5, [1.0, 2.0, 9.0]), (-2, [-1.0, -2.0])]
    df = frame(spark, rows)
    assert got(search(df, 2, 5)) == brute(rows, 2, 5)
    copies = [(i, [1.0, 0.5]) for i in range(90)] + [(100, [1.0, 0.25]), (101, [50.0, -80.0])]
    assert got(search(frame(spark, copies), 10)) == brute(copies, 10)
    assert search(df.limit(0), 2).count() == 0 and search(frame(spark, [(2, [1.0])]), 2).count() == 0 and search(frame(spark, [(1, [1.0]), (3, [2.0])]), 2).count() == 0


@pytest.mark.parametrize(("spread", "most"), [(0.0, 0.85), (0.4, 1.0)])
def test_scan_reads_less_and_loses_nothing_near(spread, most):
    """The less of the sphere's last coordinate the norms take up, the sooner candidates go."""
    from vireo.llm import neighbours

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x *= rng.lognormal(0, spread, (3000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    space = neighbours.Space(64, float(np.linalg.norm(x, axis=1).max()), np.linalg.qr(rng.normal(size=(65, 65)))[0])
    y, size = space.queries(x[:50])
    s = x[:50] @ x.T
    least = np.sort(s, axis=1)[:, -21]
    a, b, read = neighbours.adaptive(y, np.ascontiguousarray(space.rows(x).T), 2 - 2 * least / size)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    wanted = {(i, int(j)) for i in range(50) for j in np.argsort(-s[i])[:21]}
    assert len(wanted & found) / len(wanted) > 0.97 and read <= most * 50 * 3000 * 65
    assert all(s[i, j] >= least[i] - 1e-3 for i, j in found)  # whatever survives all blocks is within the threshold


@pytest.mark.parametrize("kind", ["even", "clusters", "norms"])
def test_recall(spark, monkeypatch, kind):
    """Many small lists in small groups: found neighbours against brute force, scores exact, none but true pairs."""
    from vireo.llm import neighbours

    monkeypatch.setattr(neighbours, "LIST_ROWS", 60)
    monkeypatch.setattr(neighbours, "GROUP", 50)
    monkeypatch.setattr(neighbours, "PACK", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24))
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(12, 24))[rng.integers(0, 12, 2000)]
    elif kind == "norms":
        x *= rng.lognormal(0, 0.6, (2000, 1))
    x[1500:1700] = x[1500] + rng.normal(size=(200, 24)) * 1e-3  # near copies
    x[1700:1800] = x[1700]  # copies
    rows = list(enumerate(floats(x)))
    found = got(neighbours.search(frame(spark, rows), 20))
    whole = np.asarray(x, np.float32).astype(float)
    hits = 0
    for q in range(0, 2000, 20):
        s = whole @ whole[q]
        s[q] = -np.inf
        near = np.lexsort((np.arange(2000), -s))[:20]
        mine = [r for r in found if r[0] == q]
        assert [r[1] for r in mine] == list(range(1, 21)) and [(-r[3], r[2]) for r in mine] == sorted((-r[3], r[2]) for r in mine)
        assert [r[3] for r in mine] == pytest.approx([s[r[2]] for r in mine], rel=1e-12, abs=1e-12)
        hits += sum(s[r[2]] >= s[near[-1]] - 1e-12 for r in mine)
    assert hits / 2000 >= 0.9
    assert len(found) == 2000


def test_whole_table(spark, sf, same):
    from vireo.llm import neighbours

    same(neighbours.op12_dimension_scan, neighbours.OP12_SQL)
