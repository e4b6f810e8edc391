import numpy as np
import pyarrow.parquet as pq
import pytest

from graphloom.llm.grid_join import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, n long, key string"


def brute(rows, threshold=0.9):
    ids = [i for i, _ in rows]
    ok, unit = [], []
    for k, (_, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok.append(k)
            unit.append(x / np.linalg.norm(x))
    near = np.zeros((len(rows), len(rows)), bool)
    if ok:
        u = np.stack(unit)
        near[np.ix_(ok, ok)] = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min([comp[i], *[comp[j] for j in np.flatnonzero(near[i])]])
            if low != comp[i]:
                comp[i], changed = low, True
    out = []
    for i in range(len(rows)):
        group = [ids[j] for j in range(len(rows)) if comp[j] == comp[i] and ids[j] is not None]
        c = min(group) if group else None
        out.append((ids[i], int(near[i].sum()), c, ids[i] == c))
    return sorted(out, key=repr)


def check(spark, rows, **how):
    got = near_duplicates(spark.createDataFrame([(i, v, 5, "k") for i, v in rows], SCHEMA), **how).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("interval", [16, 4096])
def test_against_brute_force(spark, interval):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(25, 12))
    v = np.concatenate([rng.normal(size=(60, 12)), centre[rng.integers(0, 25, 150)] + rng.normal(size=(150, 12)) * 0.25, np.repeat(centre[:1], 30, 0)])
    check(spark, [(int(i), x.tolist()) for i, x in zip(rng.permutation(len(v)), v, strict=True)], interval=interval)


def test_edges(spark):
    e = [1.0, 0.0, 0.0]
    check(spark, [(4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (3, e), (9, [2.0, 0.0, 0.0]), (2, [-1.0, 0.0, -0.0]), (None, e), (3, e), (1, [0.0, 1.0, 0.0]), (None, None)])
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(1, e)])


def test_other_lengths_link_with_nothing(spark):
    got = near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_every_length_is_joined(spark):
    rng = np.random.default_rng(7)
    want, rows = [], []
    for dim, n in ((1, 5), (3, 20), (12, 60)):
        centre = rng.normal(size=(4, dim))
        v = centre[rng.integers(0, 4, n)] + rng.normal(size=(n, dim)) * 0.1
        part = [(100 * dim + i, x.tolist()) for i, x in enumerate(np.concatenate([v, v[:2]]))]
        want += brute(part)
        rows += part
    one = [(7, [3.0, 4.0]), (8, [3.0, 4.0])]  # a length of one class
    want, rows = want + brute(one), rows + one
    got = near_duplicates(spark.createDataFrame([(i, v, 5, "k") for i, v in rows], SCHEMA), interval=16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # Links that vectors of other than the most frequent length have.
    assert sum(r.n_links for r in got if r.vec_id < 1200) == sum(n for i, n, _, _ in want if i < 1200) > 0


def test_whole_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = pq.read_table(path)
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    got = near_duplicates(spark.read.parquet(path), interval=256).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
