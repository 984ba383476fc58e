import numpy as np
import pytest
from helpers import SF

from quern.llm import vptree
from quern.llm.common import table


def brute(points, queries, k=10):
    out = {}
    for q, v in queries:
        d = [(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in points if i != q and len(x) == len(v)]
        out[q] = sorted(d)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for _, i in a[q]] == [i for _, i in b[q]]
        assert np.allclose([d for d, _ in a[q]], [d for d, _ in b[q]], rtol=1e-12)


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = found(vptree.op2_neighbours(spark, SF))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got.get(q, [])}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("shard,block", [(16_384, 16_384), (60, 3)])
def test_factor_one_is_exact(spark, shard, block):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (100, 6)) for c in range(4)]).astype(np.float32)
    x[50:90] = x[50]  # ties
    points = [(i, x[i].tolist()) for i in range(len(x))]
    queries = points[::20]
    p, q = (spark.createDataFrame(r, "vec_id long, embedding array<float>") for r in (points, queries))
    same(found(vptree.nearest(p, q, factor=1, shard=shard, block=block)), brute(points, queries))


def test_hot_vectors_share_a_cell_of_many_shards(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 4))
    x[:150] = x[0]
    points = [(i, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>").repartition(3)
    same(found(vptree.nearest(df, df.filter("vec_id % 20 = 0"), factor=1, shard=40)), brute(points, points[::20]))


def test_cells_bound_all_vectors():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c * 5, 1, (300, 3)) for c in range(4)])
    cells = vptree.Cells(x[::5], 8)
    home, low = cells.look(x)
    assert cells.n == 8 and (low[np.arange(len(x)), home] <= 1e-6).all() and (low > 1).mean() > 0.3
    for q in range(0, len(x), 97):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all((d[home == c] >= low[q, c] - 1e-9).all() for c in range(8))
    assert vptree.Cells(np.ones((9, 2)), 8).n == 1


@pytest.mark.parametrize("n,dim", [(4000, 64)])
def test_recall_and_pruning_without_structure(n, dim):
    """On vectors without structure the default factor keeps nine of ten neighbours and still skips some distances."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, dim))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    tree = vptree.Tree(x)
    ids = np.arange(n)
    q = ids[::40]
    _, who = tree.search(x[q], q, ids, 10, vptree.FACTOR)
    want = brute([(i, v) for i, v in enumerate(x)], [(i, x[i]) for i in q[:30]])
    hits = sum(len({i for _, i in want[i]} & set(who[r].tolist())) for r, i in enumerate(q[:30].tolist()))
    assert hits >= 270 and tree.seen < 0.97 * n * len(q)


def test_pruning_skips_leaves():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c * 10, 0.1, (200, 3)) for c in range(8)])
    tree = vptree.Tree(x, leaf=32)
    low = tree.bounds(x[:1])
    assert (low > 1).mean() > 0.5
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert all((d[leaf] >= low[0, i] - 1e-9).all() for i, leaf in enumerate(tree.leaves))
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(x)))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "e"), (1, None, "e"), (2, [0.0, 0.0], "e"), (3, [float("nan"), 1.0], "e"), (4, [float("inf"), 1.0], "e"), (5, [None, 1.0], "e"), (6, [], "e"), (None, [1.0, 1.0], "e")]
    rows += [(7, [1.0, 2.0, 3.0], "e"), (8, [0.0, 1.0], "e"), (-9, [0.0, 1.0], "e"), (0, [1.0, 0.0], "e"), (100, [5.0, 5.0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    got = found(vptree.nearest(df, df.filter("vec_id % 100 = 0")))
    assert [i for _, i in got[0]] == [-9, 8, 100]
    assert [i for _, i in got[100]] == [-9, 0, 0, 8]
    assert vptree.nearest(df, df.limit(0)).count() == 0 and vptree.nearest(df.limit(0), df).count() == 0
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0
