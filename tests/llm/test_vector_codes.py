"""Vector codes against plain k-means over all entries, and the tree against all distances."""

import hashlib

import numpy as np
import pytest

from quakeframe.llm import vector_codes as codes

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """{row number: (key, code, error, label)} and the digest, one vector at a time."""
    kept = [(k, np.floor(1024 * np.array(v, float)).astype(int), x) for k, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(kept[0][1]) // parts
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, tuple(r[1])))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in start] for p in range(parts)]

    def assign():
        out = []
        for _, x, _ in kept:
            own = []
            for p in range(parts):
                d = [int(((x[p * width : (p + 1) * width] - e) ** 2).sum()) for e in books[p]]
                own.append((d.index(min(d)), min(d)))
            out.append(own)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [r[1][p * width : (p + 1) * width] for r, own in zip(kept, found, strict=True) if own[p][0] == j]
                if mine:
                    books[p][j] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    found = assign()
    rows = [(k, "".join(f"{i:02x}" for i, _ in own), sum(d for _, d in own), x) for (k, _, x), own in zip(kept, found, strict=True)]
    return rows, hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def check(df, rows):
    want, digest = brute(rows)
    by = {}
    for _, _, e, x in want:
        by[x] = by.get(x, 0) + e
    got = codes.compress(df).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == sorted(((k, c, e, by[x]) for k, c, e, x in want), key=repr)
    assert {r[4] for r in got} <= {digest}


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_tree_finds_the_nearest_entry(spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (12, 8))
    entries = np.floor(centres[rng.integers(0, 12, 256)] + rng.normal(0, 1000 * spread, (256, 8))).astype(np.int64)
    entries[100:110] = entries[5]
    queries = np.concatenate([entries, np.floor(centres[rng.integers(0, 12, 2000)] + rng.normal(0, 1000 * spread, (2000, 8))).astype(np.int64), (entries[:60] + entries[60:120]) // 2])
    tree = codes.Gnat(entries)
    at, d = tree.nearest(queries)
    every = codes.squared(queries, entries)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    if spread < 1:
        assert tree.compared < 0.5 * every.size


def test_tree_on_lattice_ties_and_small_books():
    grid = np.stack(np.meshgrid(*[np.arange(0, 12, 2)] * 3), -1).reshape(-1, 3).astype(np.int64)
    queries = np.stack(np.meshgrid(*[np.arange(11)] * 3), -1).reshape(-1, 3).astype(np.int64)
    every = codes.squared(queries, grid)
    assert (codes.Gnat(grid).nearest(queries)[0] == every.argmin(axis=1)).all()
    for n in (1, 2, 8, 9, 10):
        assert (codes.Gnat(grid[:n]).nearest(queries)[0] == every[:, :n].argmin(axis=1)).all()
    same = np.ones((50, 3), np.int64)
    assert set(codes.Gnat(same).nearest(queries)[0].tolist()) == {0}


def test_large_components_are_exact():
    a, b = np.array([[1 << 25, -(1 << 25)], [3, 4]]), np.array([[-(1 << 25), 1 << 25], [0, 0]])
    assert codes.squared(a, b).tolist() == [[2 * (1 << 26) ** 2, 2 * (1 << 25) ** 2], [sum(x * x for x in (3 + (1 << 25), 4 - (1 << 25))), 25]]


def test_driver_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(df, [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    assert codes.op13_vector_codes(spark, SF).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(int(i), rng.normal(0, 1, 8).tolist(), None if i % 3 else int(i % 2)) for i in rng.permutation(300)]
    rows += [(7, rows[0][1], 5), (7, rows[0][1], 5), (None, rows[1][1], None), (400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [nan] + [0.0] * 7, 1), (403, [0.0] * 7 + [-inf], 1), (404, [0.0] * 8, 1), (405, [-0.0] * 8, 1)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, label int, code string, error string")
    check(df.repartition(3), rows)
    few = rows[:20]
    check(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"), few)
    empty = codes.compress(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_hot_label_and_many_labels(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 4).tolist(), i if i < 50 else None) for i in range(400)]
    monkeypatch.setattr(codes, "LABELS", 10)
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), [(k, np.array(v, np.float32).tolist(), x) for k, v, x in rows])


def test_lengths_must_fit(spark):
    with pytest.raises(Exception, match="same length"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int")).collect()
