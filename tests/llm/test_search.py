"""Exact and approximate search against brute force."""

import numpy as np

from skeinwatch.llm import ann_forest, exact_topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).astype(float).tolist(), "x") for i in range(400)]
    rows += [(i, rows[5][1], "x") for i in range(400, 480)]  # copies
    rows += [
        (480, None, "x"),
        (481, [float("nan")] * 16, "x"),
        (482, [None, *[1.0] * 15], "x"),
        (483, [0.0] * 16, "x"),
        (484, [float("inf")] * 16, "x"),
        (485, [], "x"),
        (None, [1.0] * 16, "x"),
    ]
    return rows + [rows[7], rows[7]]


def good(rows, zero=True):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, dtype=np.float32).astype(np.float64)
    return out


def brute(vectors, k, score):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = score(m, vectors[q])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_topk_matches_brute_force(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    floored = {i: np.floor(64 * v) for i, v in good(rows).items()}
    expected = brute(floored, 20, lambda m, q: (m @ q).astype(int))
    assert collected(exact_topk.exact_topk(df, df.where("vec_id % 20 = 0"))) == expected


def test_exact_topk_small_and_huge(spark):
    df = frame(spark, [(0, [1e30, 1.0], "x"), (20, [-1e30, 1.0], "x"), (1, [2.0, 3.0], "x"), (40, [1.0, 1.0, 1.0], "x")])
    got = collected(exact_topk.exact_topk(df, df.where("vec_id % 20 = 0")))
    assert [v for v, _ in got[0]] == [1, 20] and got[0][0][1] == 2**63 - 1
    assert 40 not in got
    empty = df.where("false")
    assert exact_topk.exact_topk(empty, empty).count() == 0


def test_forest_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], "x") for r in df.collect()]
    expected = brute(good(rows), 20, lambda m, q: m @ q)
    got = collected(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
    assert got.keys() == expected.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9
    vectors = good(rows)
    for q, found in got.items():
        assert len(found) == 20
        assert all(abs(s - float(vectors[v] @ vectors[q])) < 1e-12 for v, s in found)


def test_forest_keeps_lengths_apart_and_ties_in_order(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(ann_forest, "FORESTS", 2)
    rows = [(i, np.eye(6)[int(rng.integers(0, 6))].tolist(), "x") for i in range(300)]  # one-hot: whole leaves tie
    rows += [(300 + i, rng.standard_normal(4).astype(np.float32).tolist(), "x") for i in range(60)]
    rows += [
        (400 + i, rng.standard_normal(3).astype(np.float32).tolist(), "x") for i in range(41)
    ] + [(500, [1.0], "x"), (520, [2.0], "x"), (540, [1.0, 1.0], "x")]
    df = frame(spark, rows)
    got = collected(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
    for dim in (1, 2, 3, 4, 6):
        own = good([r for r in rows if len(r[1]) == dim])
        for q, want in brute(own, 20, lambda m, q: m @ q).items():
            if dim in (1, 2, 3, 6):
                assert [v for v, _ in got.get(q, [])] == [v for v, _ in want], (dim, q)
            else:
                assert len(got[q]) == 20 and len({v for v, _ in got[q]} & {v for v, _ in want}) >= 18


def test_forest_edge_cases(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    expected = brute(good(rows, zero=False), 20, lambda m, q: m @ q)
    got = collected(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
    assert got.keys() == expected.keys()
    copies = [q for q in got if 400 <= q < 480]
    for q in copies:  # a copy's nearest are the other copies, the smallest ids first
        assert [v for v, _ in got[q]] == [v for v in [5, *range(400, 480)] if v != q][:20]
    assert ann_forest.nearest(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 3 or vec_id = 20")
    assert [len(x) for x in collected(ann_forest.nearest(few, few.where("vec_id % 20 = 0"))).values()] == [3, 3]


def test_forest_reads_a_falling_share_of_clustered_vectors():
    """Scored pairs, all trees counted, against queries x rows: what the forest saves where vectors aren't even."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (1000, 4000, 16_000):
        centres = rng.standard_normal((50, 64))
        v = centres[rng.integers(0, 50, n)] + 0.4 * rng.standard_normal((n, 64))
        v /= np.linalg.norm(v, axis=1)[:, None]
        scored, different = ann_forest.candidates(v, v[:: n // 50])
        asked = len(v[:: n // 50])
        assert different <= scored < 0.3 * n * asked, (n, scored / n / asked)
        shares.append(scored / n / asked)
    assert shares[-1] < shares[0], shares


def test_forest_recall_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    v = (rng.standard_normal((20, 32))[rng.integers(0, 20, 1500)] + 0.5 * rng.standard_normal((1500, 32))).astype(np.float32)
    rows = [(i, x.astype(float).tolist(), "x") for i, x in enumerate(v)]
    df = frame(spark, rows)
    expected = brute(good(rows), 20, lambda m, q: m @ q)
    got = collected(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
    assert got.keys() == expected.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in got) >= 0.9 * 20 * len(expected)


def test_forest_tiny_and_huge_vectors(spark):
    """Lengths whose squares underflow to zero, or near the end of the range, still route: every query gets 20 rows."""
    rng = np.random.default_rng(9)
    for scale in (1e-200, 1e148):
        m = rng.standard_normal((600, 8)) * scale
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
        got = collected(ann_forest.nearest(df, df.where("vec_id % 20 = 0")))
        assert len(got) == 30 and all(len(x) == 20 for x in got.values())
        if scale < 1:  # every score underflows to zero: ties, smaller ids first among those met
            assert all(s == 0 and [v for v, _ in x] == sorted(v for v, _ in x) for x in got.values() for _, s in x)
