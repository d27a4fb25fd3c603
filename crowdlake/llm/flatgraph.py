"""Operator 9: near-duplicate vectors over a robust-pruned flat graph.

Vectors go to the ``OVERLAP`` nearest of some centres, the first of which owns them, so that neighbouring shards share their border; a centre with many
vectors has several shards, dealt by a hash. Each shard's task builds a graph over its vectors: batches of doubling size are searched for
in the graph so far, and each vector's candidates are pruned robustly (a candidate goes if a kept one is closer to it by the
factor ``ALPHA``), edges both ways. The adjacency lists of the shards are united by vector. A second job searches: each
vector is looked for, from the medoid, in the shards of its nearest centres, as many as a measurement over all shards asks for, by a greedy search with a beam that then expands through all neighbours in
range until none is new. What it finds is verified with double-precision cosines. Each shard audits some of its searches against brute force,
drawn until they have ``LINKS`` links to other vectors, and widens its beam while their mean recall is below ``RECALL``; a shard that stays below it at
``WIDEST``, or in which ``MOST_AUDIT`` searches have fewer links, is compared in blocks, which its bounded size allows. At the end the counts of the asked vectors are
held against brute force over all rows: below ``OVERALL``, on average over those with links, all shards are compared in blocks, and then more centres probed, up to all.

The number of centres is measured on asked vectors whose links are found by brute force against all rows: the least number, ``PROBES`` or more, with
which ``REACH`` of an asked vector's links, on average, have their owner among its centres. More vectors are asked until ``LINKED`` of them have links, up to ``MOST_ASKED``;
if too few have, vectors made at the threshold cosine, in random directions, are the links.

Vectors in a tight group, within half the threshold angle of a leader, link to each other by the triangle inequality and meet in no task. Leaders are
found in the sample, where at least one in ``CROWD`` vectors lies that close; all vectors are then dealt to them. A group stays out of the shards of the centres: its
members count for a vector all at once where the group's radius proves that all or none are in range, and otherwise the vector is looked for in shards of the
group's own. The asks of a shard come in blocks of about ``ASKS``, so a task holds one shard and one block, whatever the number of asks.

A found vector is counted in the shard that owns it only, so counts add up without any list of pairs; for the
components a task hands on one edge per vector to its root among the links it saw. Equal vectors are one class from the start,
weighted with its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep a row of their own; so do rows
without an id (component null). Only vectors of one length are compared. Rows that repeat a ``vec_id`` give one row each, and count as vectors. Empty tables give
no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

SHARD, OVERLAP, PROBES = 3_000, 2, 5
DEGREE, POOL, BEAM, ALPHA, RECALL, AUDIT = 24, 48, 32, 1.2, 0.97, 24
WIDEST = 128
LINKS, MOST_AUDIT, OVERALL = 32, 384, 0.95
#: Vectors that the centres are fitted on; every vector is indexed.
SAMPLE = 20_000
_BLOCK = 512
#: Vectors asked first and at most, how many of them must have links, and the share of links that the probed centres must own.
ASKED, MOST_ASKED, LINKED, REACH = 512, 8_192, 64, 0.98
#: Asks in a task, the share of the sample that makes a group, and the vectors tried as leaders.
ASKS, CROWD, TRIED = 20_000, 200, 2_000


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, 1)
        for j in range(k):
            m = sample[near == j]
            if len(m):
                v = m.sum(0)
                c[j] = v / max(np.linalg.norm(v), 1e-12)
    return c


def leaders(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Unit leaders of the tight groups that hold one in ``CROWD`` vectors of the sample or more."""
    within, least = _half(cosine), max(32, len(sample) // CROWD)
    alive, out = np.ones(len(sample), bool), []
    for i in np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int):
        if alive[i]:
            near = alive & (sample @ sample[i] >= within)
            if near.sum() >= least:
                v = sample[near].sum(0)
                v /= np.linalg.norm(v)
                near |= alive & (sample @ v >= within)
                alive &= ~near
                out.append(v)
    return np.array(out).reshape(-1, sample.shape[1])


def _half(cosine: float) -> float:
    """The cosine of half the threshold angle, a little less: two vectors this close to a third are in range of each other."""
    return float(np.cos(max(np.arccos(cosine) / 2 - 1e-6, 0)))


def _groups(x: np.ndarray, lead: np.ndarray, cosine: float) -> np.ndarray:
    """The group of each vector, -1: none."""
    if not len(lead):
        return np.full(len(x), -1)
    s = x @ lead.T
    near = np.argmax(s, 1)
    return np.where(s[np.arange(len(x)), near] >= _half(cosine), near, -1)


def greedy(x: np.ndarray, adj: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries side by side: the best ``beam`` nodes found for each and their similarities."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, q @ x[entry], False
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        s = np.where(done[live], -np.inf, sims[live])
        at = np.argmax(s, 1)
        go = np.isfinite(s[np.arange(len(live)), at])
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        near = adj[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        t = np.einsum("qd,qrd->qr", q[live], x[near])
        t[~fresh] = -np.inf
        all_s = np.concatenate([sims[live], t], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_d = np.concatenate([done[live], ~fresh], 1)
        best = np.argsort(-all_s, 1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, best, 1)
        ids[live] = np.take_along_axis(all_i, best, 1)
        done[live] = np.take_along_axis(all_d, best, 1)
    return ids, sims


def robust_prune(x: np.ndarray, who: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """At most ``DEGREE`` neighbours for each of ``who`` out of its ``pool`` (-1: none)."""
    ok = (pool >= 0) & (pool != who[:, None])
    s = np.where(ok, np.einsum("nd,ncd->nc", x[who], x[pool]), -np.inf)
    by = np.argsort(-s, 1, kind="stable")[:, :POOL]
    pool, s = np.take_along_axis(pool, by, 1), np.take_along_axis(s, by, 1)
    v = x[pool]
    among = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
    dist = np.sqrt(np.maximum(2 - 2 * np.where(np.isfinite(s), s, -1), 0))
    alive = np.isfinite(s)
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    out = np.full((len(who), DEGREE), -1, np.int64)
    rows = np.arange(len(who))
    for r in range(DEGREE):
        has = alive.any(1)
        if not has.any():
            break
        first = np.argmax(alive, 1)
        out[has, r] = pool[rows, first][has]
        alive &= ~((ALPHA * among[rows, first] <= dist) | (np.arange(alive.shape[1]) == first[:, None])) | ~has[:, None]
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency lists by insertion in batches of doubling size."""
    n = len(x)
    adj = np.full((n, DEGREE), -1, np.int64)
    order = np.random.RandomState(7).permutation(n)
    start = int(np.argmax(x @ x.mean(0)))
    order = np.concatenate([[start], order[order != start]])
    lo = 1
    while lo < n:
        hi = min(n, lo + min(lo, 1024))
        for a in range(lo, hi, _BLOCK):
            who = order[a: min(hi, a + _BLOCK)]
            pool, _ = greedy(x, adj, start, x[who], POOL)
            adj[who] = robust_prune(x, who, pool)
        who = order[lo:hi]
        target, source = adj[who].ravel(), np.repeat(who, DEGREE)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        names, at, n_in = np.unique(target, return_index=True, return_counts=True)
        pos = np.arange(len(target)) - np.repeat(at, n_in)
        slot = np.repeat(np.arange(len(names)), n_in)
        for first in range(0, int(n_in.max()) if len(n_in) else 0, POOL):  # what a much wanted node gets comes in turns
            on = (pos >= first) & (pos < first + POOL)
            mine = np.unique(slot[on])
            extra = np.full((len(names), POOL), -1, np.int64)
            extra[slot[on], pos[on] - first] = source[on]
            for a in range(0, len(mine), _BLOCK):
                m = mine[a: a + _BLOCK]
                adj[names[m]] = robust_prune(x, names[m], np.concatenate([adj[names[m]], extra[m]], 1))
        lo = hi
    return adj


def range_search(x: np.ndarray, adj: np.ndarray, entry: int, q: np.ndarray, least: float, beam: int):
    """For each query, one after the other, the nodes in range that the greedy search and then the expansion through neighbours in range reach."""
    for a in range(0, len(q), _BLOCK):
        part = q[a: a + _BLOCK]
        ids, sims = greedy(x, adj, entry, part, beam)
        for i in range(len(part)):
            found = ids[i][sims[i] >= least]
            seen = np.zeros(len(x) + 1, bool)
            seen[found] = True
            edge = found
            while len(edge):
                near = np.unique(adj[edge])
                near = near[near >= 0]
                near = near[~seen[near]]
                seen[near] = True
                edge = near[x[near] @ part[i] >= least]
                found = np.concatenate([found, edge])
            yield found


def _scan(x: np.ndarray, q: np.ndarray, least: float):
    """For each query the rows in range, block by block."""
    for a in range(0, len(q), _BLOCK):
        near = q[a: a + _BLOCK] @ x.T >= least
        yield from (np.flatnonzero(row) for row in near)


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return table.column("id").to_numpy(), v


def _build_shard(table: pa.Table) -> pa.Table:
    ids, v = _load(table)
    adj = build(v.astype(np.float32))
    flat = [ids[row[row >= 0]] for row in adj]
    return pa.table({"id": ids, "near": pa.array([f.tolist() for f in flat], pa.list_(pa.int64()))})


def _audited(v: np.ndarray, ids: np.ndarray, q: np.ndarray, qid: np.ndarray, cosine: float) -> tuple[np.ndarray, list[np.ndarray], bool]:
    """Asks drawn until they have enough links, those of them with links, and whether there were enough or no more to draw."""
    order = np.random.RandomState(3).permutation(len(qid))[:MOST_AUDIT]
    probe, exact, links = [], [], 0
    for a in range(0, len(order), AUDIT):
        for i, near in zip(order[a: a + AUDIT], q[order[a: a + AUDIT]] @ v.T >= cosine):
            e = np.flatnonzero(near & (ids != qid[i]))
            if len(e):
                probe.append(i)
                exact.append(e)
                links += len(e)
        if links >= LINKS and len(probe) >= min(LINKS // 4, len(qid)):
            break
    return np.array(probe, np.int64), exact, links >= LINKS and len(probe) >= min(LINKS // 4, len(qid))


def _search_shard(cosine: float, scan: bool = False):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes, asks = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        ids, v = _load(nodes)
        qid, q = _load(asks)
        by = np.argsort(ids)
        ids, v = ids[by], v[by]
        weight = np.where(nodes.column("own").to_numpy()[by], nodes.column("weight").to_numpy()[by], 0)
        lists = nodes.column("near").combine_chunks().take(pa.array(by))
        n = np.diff(lists.offsets.to_numpy())
        adj = np.full((len(ids), max(int(n.max(initial=0)), 1)), -1, np.int64)
        if len(ids):
            flat = lists.flatten().to_numpy()
            at = np.searchsorted(ids, flat)
            at[at == len(ids)] = 0
            adj[np.repeat(np.arange(len(ids)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.where(ids[at] == flat, at, -1)
        x, p = v.astype(np.float32), q.astype(np.float32)
        count, root = np.zeros(len(qid), np.int64), np.arange(len(ids))
        edges_a, edges_b, beam = [], [], BEAM
        if len(ids):
            entry = int(np.argmax(x @ x.mean(0)))
            least = cosine - 1e-5
            # Too few links to judge the graph by, or a graph that the widest beam does not search well enough: this shard's vectors are compared in blocks instead.
            poor = scan
            if not scan:
                probe, exact, enough = _audited(v, ids, q, qid, cosine)
                poor = not enough
                while enough:
                    found = range_search(x, adj, entry, p[probe], least, beam)
                    recall = np.mean([np.isin(e, f).mean() for e, f in zip(exact, found)])
                    poor = recall < RECALL
                    if not poor or beam >= WIDEST:
                        break
                    beam *= 2

            def top(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, f in enumerate(_scan(x, p, least) if poor else range_search(x, adj, entry, p, least, beam)):
                f = f[v[f] @ q[i] >= cosine]  # in double precision
                f = f[ids[f] != qid[i]]
                if len(f):
                    count[i] = weight[f].sum()
                    tops = {top(j) for j in np.unique(root[f]).tolist()}
                    low = min(tops)
                    for j in tops:
                        root[j] = low
                    edges_a.append(qid[i])
                    edges_b.append(int(f[0]))
        real = [int(ids[top(j)]) for j in edges_b]
        mine = [(int(ids[j]), int(ids[top(j)])) for j in range(len(ids)) if root[j] != j]
        a = np.array(list(map(int, edges_a)) + [i for i, _ in mine], np.int64)
        b = np.array(real + [j for _, j in mine], np.int64)
        on = count > 0
        return pa.table({"kind": np.concatenate([np.zeros(on.sum(), np.int64), np.ones(len(a), np.int64)]),
                         "a": np.concatenate([qid[on], a]), "b": np.concatenate([count[on], b])})

    return run


def _truth(fit: DataFrame, dim: int, ids: np.ndarray, q: np.ndarray, c: np.ndarray, lead: np.ndarray, cosine: float):
    """All links of the asked vectors, by brute force (rank 0: links to a group's members): arrays of the ask, the rank of the owner among the ask's centres, and the weight."""
    rank = np.argsort(np.argsort(-(q @ c.T), 1, kind="stable"), 1)

    def run(batches):
        for batch in batches:
            vid, weight = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(len(vid), -1)
            for a in range(0, len(x), _BLOCK):
                part = x[a: a + _BLOCK]
                owner = np.argmax(part @ c.T, 1)
                i, j = np.nonzero(part @ q.T >= cosine)
                other = vid[a + i] != ids[j]
                i, j = i[other], j[other]
                key, at = np.unique(j * len(c) + np.where(_groups(part, lead, cosine)[i] >= 0, 0, rank[j, owner[i]]), return_inverse=True)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key // len(c)), pa.array(key % len(c)), pa.array(np.bincount(at, weight[a + i]).astype(np.int64))], names=["ask", "rank", "n"])

    found = fit.where(F.col("dim") == dim).select("id", "v", "weight").mapInArrow(run, "ask long, rank long, n long").groupBy("ask", "rank").agg(F.sum("n").alias("n")).toArrow()
    return tuple(found.column(n).to_numpy() for n in ("ask", "rank", "n"))


def _reach(ask: np.ndarray, rank: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """For 1 to ``k`` probes: the share of an ask's links whose owner is probed, averaged over the asks that have links."""
    names, at = np.unique(ask, return_inverse=True)
    share = np.bincount(rank, n / np.bincount(at, n)[at], k) if len(names) else np.zeros(k)
    return np.cumsum(share) / max(len(names), 1)


def _made_ranks(q: np.ndarray, c: np.ndarray, cosine: float) -> np.ndarray:
    """The rank, among each vector's centres, of the owner of a vector made at the threshold cosine to it."""
    u = np.random.RandomState(11).randn(*q.shape)
    u -= (u * q).sum(1)[:, None] * q
    u /= np.maximum(np.linalg.norm(u, axis=1), 1e-12)[:, None]
    owner = np.argmax((cosine * q + np.sqrt(max(1 - cosine * cosine, 0)) * u) @ c.T, 1)
    order = np.argsort(-(q @ c.T), 1, kind="stable")
    return np.argmax(order == owner[:, None], 1)


def measure(fit: DataFrame, dim: int, n: int, c: np.ndarray, lead: np.ndarray, cosine: float):
    """The number of centres to probe, and the asked ids with the weight of their links."""
    many = ASKED
    while True:
        rows = fit.where(F.col("dim") == dim).orderBy(F.xxhash64("id", F.lit(1))).limit(many).select("id", "v").collect()
        ids, q = np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows])
        ask, rank, weight = _truth(fit, dim, ids, q, c, lead, cosine)
        enough = len(np.unique(ask)) >= LINKED
        if enough or many >= min(n, MOST_ASKED):
            break
        many *= 4
    if not enough and many < n:  # all vectors asked is the truth itself
        made = _made_ranks(q, c, cosine)
        probes = int(np.argmax(_reach(np.arange(len(made)), made, np.ones(len(made)), len(c)) >= REACH)) + 1
    elif len(ask):
        probes = int(np.argmax(_reach(ask, rank, weight, len(c)) >= REACH - 1e-9)) + 1
    else:
        probes = 1
    return max(probes, PROBES), dict(zip(ids.tolist(), np.bincount(ask, weight, len(ids)).astype(int).tolist()))


def fit_centres(fit: DataFrame, shard: int, cosine: float) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """The number of classes, the centres and the groups' leaders for each vector length."""
    totals = {r["dim"]: r["n"] for r in fit.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    fitted = {}
    for dim, n in totals.items():
        some = np.array([r["v"] for r in fit.where(F.col("dim") == dim).orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()])
        lead = leaders(some, cosine)
        loose = some[_groups(some, lead, cosine) < 0] if len(lead) else some
        loose = loose if len(loose) else some
        fitted[dim] = n, centres(loose, max(1, min(-(-n // shard), len(loose) // 16))), lead
    return fitted


def _group_sizes(fit: DataFrame, lead: dict[int, np.ndarray], cosine: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length, of each group: the angle that holds all members, their weight, and the smallest id."""
    def run(batches):
        for batch in batches:
            dims, ids, weight = (batch.column(n).to_numpy() for n in ("dim", "id", "weight"))
            for dim in np.unique(dims):
                part, mine = batch.filter(pa.array(dims == dim)), dims == dim
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                g = _groups(x, lead[int(dim)], cosine)
                for j in np.unique(g[g >= 0]):
                    on = g == j
                    yield pa.RecordBatch.from_pydict({"dim": [dim], "g": [j], "cos": [float((x[on] @ lead[int(dim)][j]).min())], "weight": [int(weight[mine][on].sum())], "id": [int(ids[mine][on].min())]},
                                                     pa.schema([("dim", pa.int32()), ("g", pa.int64()), ("cos", pa.float64()), ("weight", pa.int64()), ("id", pa.int64())]))

    out = {dim: (np.zeros(len(l)), np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)) for dim, l in lead.items()}
    if any(map(len, lead.values())):
        sizes = fit.mapInArrow(run, "dim int, g long, cos double, weight long, id long").groupBy("dim", "g").agg(F.min("cos").alias("cos"), F.sum("weight").alias("weight"), F.min("id").alias("id"))
        for r in sizes.collect():  # a row per leader
            radius, weight, least = out[r["dim"]]
            radius[r["g"]], weight[r["g"]], least[r["g"]] = np.arccos(min(r["cos"], 1.0)), r["weight"], r["id"]
    return out


def _reaches(x: np.ndarray, g: np.ndarray, lead: np.ndarray, radius: np.ndarray, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and group: whether all members are in range, and whether some may be."""
    angle, most = np.arccos(np.clip(x @ lead.T, -1, 1)), np.arccos(cosine)
    own = g[:, None] == np.arange(len(lead))
    every = own | (angle + radius <= most - 1e-7)
    return every & (weight > 0), ~every & (angle - radius <= most + 1e-7) & (weight > 0)


def _whole_groups(fit: DataFrame, lead: dict, sizes: dict, cosine: float) -> DataFrame:
    """``kind, a, b`` as ``_links`` has them: links to all members of a group at once."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids, own = part.column("id").to_numpy(), part.column("weight").to_numpy()
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                radius, weight, least = sizes[int(dim)]
                g = _groups(x, lead[int(dim)], cosine)
                i, j = np.nonzero(_reaches(x, g, lead[int(dim)], radius, weight, cosine)[0])
                n = weight[j] - np.where(g[i] == j, own[i], 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(i))), pa.array(np.tile(ids[i], 2)), pa.array(np.concatenate([n, least[j]]))], names=["kind", "a", "b"])

    return fit.mapInArrow(run, "kind long, a long, b long").where("kind = 1 or b > 0")


def _assign(fit: DataFrame, fitted: dict[int, np.ndarray], probes: dict[int, int], lead: dict, sizes: dict, cosine: float) -> DataFrame:
    """Each class with its nearest centres, and the groups (numbered behind the centres) that it is in or may reach in part:
    ``id, v, weight, dim, centre, node, own, ask``: whether it is indexed there, first of all there, and looked for there."""
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                c, l = fitted[int(dim)], lead[int(dim)]
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                order = np.argsort(-(x @ c.T), 1, kind="stable")[:, :probes[int(dim)]]
                k = order.shape[1]
                g = _groups(x, l, cosine)
                place, loose = np.tile(np.arange(k), len(x)), np.repeat(g < 0, k)
                member = np.flatnonzero(g >= 0)
                some, to = np.nonzero(_reaches(x, g, l, *sizes[int(dim)][:2], cosine)[1]) if len(l) else (member[:0], member[:0])
                take = pa.array(np.concatenate([np.repeat(np.arange(len(x)), k), member, some]))
                centre = np.concatenate([order.ravel(), len(c) + g[member], len(c) + to])
                yes, no = np.ones(len(member), bool), np.zeros(len(some), bool)
                yield pa.RecordBatch.from_arrays([*(part.column(n).take(take) for n in ("id", "v", "weight", "dim")), pa.array(centre), pa.array(np.concatenate([loose & (place < OVERLAP), yes, no])),
                                                  pa.array(np.concatenate([loose & (place == 0), yes, no])), pa.array(np.concatenate([np.ones(len(place), bool), ~yes, ~no]))],
                                                 names=["id", "v", "weight", "dim", "centre", "node", "own", "ask"])

    return fit.mapInArrow(run, "id long, v array<double>, weight long, dim int, centre long, node boolean, own boolean, ask boolean")


def union_graph(index: DataFrame) -> DataFrame:
    """``id, near``: the shards' graphs, a vector's lists united."""
    made = index.groupBy("dim", "centre", "part").applyInArrow(_build_shard, "id long, near array<long>")
    return made.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists


def _links(fit: DataFrame, fitted: dict, probes: dict[int, int], lead: dict, sizes: dict, cosine: float, shard: int, scan: bool) -> DataFrame:
    """``kind, a, b``: a class and the weight of its links (0, several rows a class), or an edge between classes (1)."""
    placed = materialize(_assign(fit, fitted, probes, lead, sizes, cosine), "vector-places")
    parts = placed.groupBy("dim", "centre").agg(F.ceil(F.count_if("node") / (shard * OVERLAP)).cast("long").alias("parts"),
                                                F.ceil(F.count_if("ask") / ASKS).cast("long").alias("blocks"))  # a row per centre
    parts = parts.where("parts > 0 and blocks > 0")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    index = materialize(placed.where("node").join(parts, ["dim", "centre"]).select("dim", "centre", part.alias("part"), "blocks", "id", "v", "weight", "own"), "vector-index")
    graph = materialize(union_graph(index), "vector-graph")
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n[:-1]) for n in ("parts", "blocks")]
    nodes = index.join(graph, "id").select("dim", "centre", "part", each[1], F.lit(0).alias("side"), "id", "v", "weight", "own", "near")
    asks = placed.where("ask").join(parts, ["dim", "centre"]).select("dim", "centre", each[0], F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).alias("block"), F.lit(1).alias("side"),
                                                                     "id", "v", "weight", F.lit(False).alias("own"), F.array().cast("array<long>").alias("near"))
    found = nodes.unionByName(asks).groupBy("dim", "centre", "part", "block").applyInArrow(_search_shard(cosine, scan), "kind long, a long, b long")
    if any(map(len, lead.values())):
        found = found.unionByName(_whole_groups(fit, lead, sizes, cosine))
    return materialize(found, "vector-links")


def near_vectors(df: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """One row per vector, ``vec_id, n_links, component_id, kept``, and the audit, one row with ``hits`` and ``truth``: the asked vectors' links."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (norm > 0) & (norm < float("inf"))
    unit = F.when(good, F.transform("v", lambda x: x / norm))
    digest = F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))
    rows = rows.withColumn("v", unit).withColumn("id", F.when(F.col("v").isNotNull(), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    rows = materialize(rows, "unit-vectors")
    fit = rows.where("id is not null").groupBy("id").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    fit = materialize(fit.withColumn("dim", F.size("v")), "vector-classes")
    fitted = fit_centres(fit, shard, cosine)
    measured = {dim: measure(fit, dim, *f, cosine) for dim, f in fitted.items()}
    lead = {dim: f[2] for dim, f in fitted.items()}
    sizes = _group_sizes(fit, lead, cosine)
    probes, scan = {dim: m[0] for dim, m in measured.items()}, False
    truth = {i: n for _, asked in measured.values() for i, n in asked.items() if n}
    while True:
        found = _links(fit, {dim: f[1] for dim, f in fitted.items()}, probes, lead, sizes, cosine, shard, scan)
        counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
        asked = df.sparkSession.createDataFrame(list(truth.items()), "id long, truth long")
        got = asked.join(counts, "id", "left").select(F.coalesce("others", F.lit(0)).alias("hits"), "truth")
        audit = got.agg(F.sum("hits").alias("hits"), F.sum("truth").alias("truth"), F.avg(F.col("hits") / F.col("truth")).alias("recall")).first()
        whole = scan and all(probes[dim] >= len(f[1]) for dim, f in fitted.items())
        if whole or not truth or audit["recall"] >= OVERALL:
            break
        probes, scan = {dim: 2 * n if scan else n for dim, n in probes.items()}, True
    label = components(found.where("kind = 1").select("a", "b"), "vectors").withColumnRenamed("node", "id")
    classes = fit.select("id", "least", "weight").join(counts, "id", "left").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    done = classes.join(least, "component").select("id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "id").join(done, "id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out, df.sparkSession.createDataFrame([(audit["hits"], audit["truth"])], "hits long, truth long")
