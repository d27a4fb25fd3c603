"""Small tests of the operators on vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from crowdlake.llm import balltree, flatgraph
from crowdlake.llm.common import components

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def vectors(n=300, dim=8, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.randn(n, dim)
    x[n // 3: 2 * n // 3] = x[0] + 0.05 * rng.randn(2 * n // 3 - n // 3, dim)  # a third of all rows are near copies
    x[-5:] = x[1]
    return x


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 0, "s") for i, v in enumerate(x)] + list(extra), SCHEMA).repartition(4)


ODD = [(1000, None, None, None), (1020, [], 1, None), (1040, [1.0, None], 1, None), (1060, [float("nan")] * 8, 1, None), (None, [1.0] * 8, 1, None), (1080, [float("inf")] * 8, 1, None)]


def test_top_k_matches_brute_force(spark):
    x = np.floor(64 * vectors())
    df = balltree.vectors(frame(spark, x, [*ODD, (0, [float(c) for c in x[0]], 0, "s")]))
    got = balltree.top_k(df, df.where("vec_id % 20 = 0"), k=7, shard_rows=90, block_rows=6).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.arange(len(x))
    assert sorted(by) == list(range(0, 300, 20))
    for q, rows in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:7]
        assert rows == [(int(i), int(s[i])) for i in best]


def test_top_k_edges(spark):
    few = balltree.vectors(frame(spark, [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [5.0]]))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in balltree.top_k(few, few.where("vec_id = 0"), k=20).collect()}
    assert got == {(0, 1): (1, 11), (0, 2): (2, 5)}
    none = balltree.vectors(spark.createDataFrame([], SCHEMA))
    assert balltree.top_k(none, none).count() == 0


def test_ball_tree_prunes():
    x = np.concatenate([np.full((500, 3), 10.0) + np.arange(500)[:, None] % 5, -np.full((500, 3), 10.0)])
    score, found = balltree.BallTree(x).search(x[:1], np.array([0]), np.arange(1000), 3, np.array([-np.inf]))
    s = x @ x[0]
    s[0] = -np.inf
    assert found[0].tolist() == np.lexsort((np.arange(1000), -s))[:3].tolist()


@pytest.mark.parametrize("shard", [60, 1000])
def test_near_vectors_match_brute_force(spark, shard):
    x = vectors()
    zero = (2000, [0.0] * 8, 0, None)
    got, audit = flatgraph.near_vectors(frame(spark, x, [*ODD, zero]), cosine=0.9, shard=shard)
    rows = {r.vec_id: r for r in got.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(near)):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    found = sum(rows[i].n_links for i in range(len(x)))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(rows[i].n_links <= near[i].sum() for i in range(len(x)))
    assert [rows[i].component_id for i in range(len(x))] == [find(i) for i in range(len(x))]
    assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in (1000, 1020, 1040, 1060, 1080, 2000))
    assert rows[None].component_id is None
    a = audit.first()
    assert a.hits >= 0.9 * a.truth > 0


def test_probes_grow_with_centres(spark, monkeypatch):
    """2,000 pairs without other structure and 50 centres that most rows were not fitted on: five probes reach 94 % of the links."""
    monkeypatch.setattr(flatgraph, "SAMPLE", 800)
    rng = np.random.RandomState(5)
    x = rng.randn(4000, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.randn(2000, 64)
    u -= (u * x[:2000]).sum(1)[:, None] * x[:2000]
    x[2000:] = 0.901 * x[:2000] + np.sqrt(1 - 0.901 ** 2) * u / np.linalg.norm(u, axis=1)[:, None]
    got, _ = flatgraph.near_vectors(frame(spark, x), cosine=0.9, shard=80)
    assert sum(r.n_links for r in got.collect()) >= 0.97 * ((x @ x.T >= 0.9).sum() - len(x))


def test_poor_graph_with_sparse_links_is_noticed():
    """A graph without edges and one link among 1,000 foreign asks, off the first asks that an audit draws."""
    x = np.eye(40)
    q = -np.eye(40)[np.arange(1000) % 40]
    q[501] = x[39]
    n = len(x) + len(q)
    table = pa.table({"side": [0] * 40 + [1] * 1000, "id": np.arange(n), "v": pa.array(np.concatenate([x, q]).tolist()), "weight": np.ones(n, np.int64),
                      "own": np.arange(n) < 40, "near": pa.array([[]] * n, pa.list_(pa.int64()))})
    got = flatgraph._search_shard(0.9)(table).to_pylist()
    assert {(r["kind"], r["a"], r["b"]) for r in got if r["kind"] < 2} == {(0, 541, 1), (1, 541, 39)}


def test_tight_groups_are_exact_and_stay_out_of_the_shards(spark, monkeypatch):
    """Two tight groups near each other, and vectors at every distance around them: exact links once shards are scanned, and no group in the shards of the centres."""
    monkeypatch.setattr(flatgraph, "OVERALL", 2.0)
    rng = np.random.RandomState(4)
    a, b = np.eye(8)[0], np.array([np.cos(0.4), np.sin(0.4)] + [0.0] * 6)
    x = np.concatenate([a + 0.02 * rng.randn(150, 8), b + 0.02 * rng.randn(100, 8), rng.randn(100, 8), a + rng.randn(100, 8) * np.linspace(0, 0.4, 100)[:, None]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lead = flatgraph.leaders(x, 0.9)
    assert len(lead) == 2
    g = flatgraph._groups(x, lead, 0.9)
    near = x @ x.T >= 0.9
    assert all(near[np.ix_(g == j, g == j)].all() and (g == j).sum() >= 100 for j in range(2))
    got, _ = flatgraph.near_vectors(frame(spark, x), cosine=0.9, shard=1000)
    assert {r.vec_id: r.n_links for r in got.collect()} == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    fit = spark.createDataFrame([(i, [float(c) for c in v], 1, 8) for i, v in enumerate(x)], "id long, v array<double>, weight long, dim int")
    centre = {8: np.eye(8)[:2]}
    rows = flatgraph._assign(fit, centre, {8: 2}, {8: lead}, flatgraph._group_sizes(fit, {8: lead}, 0.9), 0.9).collect()
    assert {r.id for r in rows if r.node and r.centre < 2} == set(np.flatnonzero(g < 0).tolist())
    assert not [r for r in rows if r.ask and g[r.id] >= 0 and r.centre == 2 + g[r.id]]  # no member is looked for in its own group


def test_near_vectors_edges(spark):
    got, _ = flatgraph.near_vectors(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0
    same = frame(spark, [[1.0, 1.0], [2.0, 2.0], [-1.0, 1.0]], [(0, [1.0, 1.0], 0, None)])
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in flatgraph.near_vectors(same)[0].collect())
    assert rows == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (2, 0, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 5), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
