"""Approximate nearest neighbours by robust-pruned directed graphs.

Rows are dealt to shards of about ``shard_rows`` by a hash of their id, so that equal vectors
spread over all shards; inside a shard equal vectors are one node.  Nodes are cut into bands of
similar norm, and each band is a graph of unit vectors: where norms hardly differ, the largest
product is the nearest direction.  Nodes of bands too small for a graph are scored one by one.
Nodes join a graph in batches: each is searched for greedily from the entry points, what the
search passed becomes its candidates, and of these it keeps the nearest that no kept one covers:
c is covered by p if ``alpha x d(p, c) <= d(node, c)``.  Kept edges are also offered in reverse;
a list that outgrows its room is pruned the same way.  Nodes that no entry point reaches in the
end become entry points.  Queries walk every shard with a beam, in blocks, band after band from
the longest, and leave out bands whose norm cannot make a product large enough; the best of all
shards are ranked by the exact product of the original vectors.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE = 32
BEAM = 96
BUILD_BEAM = 48
ALPHA = 1.2
SHARD_ROWS = 16384
QUERY_BLOCK = 16384
#: Norms of a band differ by less than this factor; bands of fewer nodes have no graph.
BAND_RATIO = 1.2
BAND_LEAST = 64
#: Nodes among which a walk looks for a start, and how many of them it starts from.
ENTRIES = 256
STARTS = 16
_BATCH = 512
_OPEN = 4
_PRUNED = 128


def _beam(vectors: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int, passed: bool = False):
    """Beam search of many queries at once, by product; a step opens ``_OPEN`` nodes each.

    All ``vectors`` have one norm, so the largest product is the least distance.  Returns nodes (-1
    where none) and distances, nearest first; with ``passed`` all nodes whose edges were looked at, as well.
    """
    b, n = len(queries), len(vectors)
    seen = np.zeros((b, n + 1), np.int16)  # 0, or one plus the place that met the node; index -1 marks the spare column
    at = np.full((b, width), -1, np.int32)
    dist = np.full((b, width), np.inf, np.float32)
    far, starts = -(queries @ vectors[entry].T), min(len(entry), STARTS, width)
    first = np.argpartition(far, starts - 1, 1)[:, :starts]
    at[:, :starts] = entry[first]
    dist[:, :starts] = np.take_along_axis(far, first, 1)
    seen[np.arange(b)[:, None], at[:, :starts]] = 1
    done = at < 0
    places = np.arange(1, _OPEN * edges.shape[1] + 1, dtype=np.int16)
    opened = []
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            break
        row = live[:, None]
        pick = np.argpartition(np.where(done[live], np.inf, dist[live]), min(_OPEN, width) - 1, 1)[:, :_OPEN]
        node = np.where(done[row, pick], -1, at[row, pick])
        done[row, pick] = True
        if passed:
            note = np.full((b, node.shape[1]), -1, np.int32)
            note[live] = node
            opened.append(note)
        near = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(len(live), -1)
        fresh = (seen[row, near] == 0) & (near >= 0)
        r, c = np.nonzero(fresh)
        met = near[r, c]
        seen[live[r], met] = places[c]
        once = seen[live[r], met] == places[c]  # of a node met twice in a step one place stays
        r, c, met = r[once], c[once], met[once]
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = -np.einsum("nd,nd->n", queries[live[r]], vectors[met])
        all_at, all_d = np.concatenate([at[live], near], 1), np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~np.isfinite(d)], 1)
        keep = np.argpartition(all_d, width - 1, 1)[:, :width]
        k = np.arange(len(live))[:, None]
        at[live], dist[live], done[live] = all_at[k, keep], all_d[k, keep], all_done[k, keep]
    k, order = np.arange(b)[:, None], np.argsort(dist, 1, kind="stable")
    at, dist = at[k, order], dist[k, order]
    at = np.where(np.isfinite(dist), at, -1)
    return (at, dist, np.concatenate(opened, 1)) if passed else (at, dist)


def _prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The kept edges of each node among its candidates (-1: none); relaxed pruning keeps diverse ones."""
    order = np.sort(np.where(candidates == nodes[:, None], -1, candidates), 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1  # each candidate once
    out = np.full((len(nodes), degree), -1, np.int32)
    for at in range(0, len(nodes), _PRUNED):
        part = slice(at, at + _PRUNED)
        points, k = vectors[order[part]], np.arange(len(order[part]))
        open_ = np.where(order[part] >= 0, ((points - vectors[nodes[part]][:, None]) ** 2).sum(2), np.inf)
        to_node = open_.copy()
        norm = np.einsum("bcd,bcd->bc", points, points)
        between = norm[:, :, None] + norm[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        for slot in range(degree):
            best = np.argmin(open_, 1)
            found = np.isfinite(open_[k, best])
            if not found.any():
                break
            out[at + k[found], slot] = order[part][k[found], best[found]]
            open_[alpha**2 * between[k, best] <= to_node] = np.inf
            open_[k, best] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> np.ndarray:
    """Edges (n x degree, -1: none) of the pruned graph over distinct ``vectors``."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    if n <= degree + 1:  # everyone knows everyone
        full = np.array([[j for j in range(n) if j != i] + [-1] * (degree - n + 1) for i in range(n)], np.int32)
        return full.reshape(n, degree)
    room = degree + degree // 2  # lists that outgrow it are pruned
    edges = np.full((n, room), -1, np.int32)
    held = np.zeros(n, np.int64)
    entry = entry_points(vectors)
    order = np.concatenate([entry, rng.permutation(np.setdiff1d(np.arange(n), entry))])
    joined = 0
    while joined < n:
        # The first batch meets itself; later ones are at most as large as what has joined.
        batch = order[joined : joined + min(_BATCH, max(joined, 2 * degree))]
        near, _, passed = _beam(vectors, edges, entry, vectors[batch], beam, passed=True)
        known = [near, passed] if joined else [near, np.tile(batch, (len(batch), 1))]
        edges[batch, :degree] = _prune(vectors, batch, np.concatenate(known, 1), degree, alpha)
        held[batch] = (edges[batch] >= 0).sum(1)
        # Offer the edges in reverse, grouped by their end.
        src, dst = np.repeat(batch, degree), edges[batch, :degree].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        ends, at, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(at, count)
        roomy = held[ends] + count <= room
        fits = np.repeat(roomy, count)
        edges[dst[fits], held[dst[fits]] + place[fits]] = src[fits]
        held[ends[roomy]] += count[roomy]
        full, lots = ends[~roomy], count[~roomy]
        if len(full):
            offered = np.full((len(full), int(lots.max())), -1)
            offered[np.repeat(np.arange(len(full)), lots), place[~fits]] = src[~fits]
            pruned = _prune(vectors, full, np.concatenate([edges[full], offered], 1), degree, alpha)
            edges[full] = -1
            edges[full, :degree] = pruned
            held[full] = (edges[full] >= 0).sum(1)
        joined += len(batch)
    long = np.flatnonzero(held > degree)
    edges[long, :degree] = _prune(vectors, long, edges[long], degree, alpha)
    return np.ascontiguousarray(edges[:, :degree])


def entry_points(vectors: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """The node nearest to the mean, and others spread over the rows."""
    medoid = int(np.argmin(((vectors - vectors.mean(0)) ** 2).sum(1)))
    return np.unique(np.append(np.linspace(0, len(vectors) - 1, most).astype(np.int64), medoid))


def with_unreached(edges: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The entry points, and more of them until every node can be reached from one."""
    reached = np.zeros(len(edges), bool)
    new, more = entry, []
    while True:
        while len(new):
            reached[new] = True
            new = np.unique(edges[new])
            new = new[(new >= 0) & ~reached[new]]
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return np.concatenate([entry, np.array(more, np.int64)])
        more.append(rest[0])
        new = rest[:1]


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows that are not zero; squares neither overflow nor vanish."""
    most = np.abs(x).max(1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((x / most[:, None]) ** 2).sum(1)), np.finfo(np.float64).max)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float32)


def norm_bands(norm: np.ndarray, ratio: float = BAND_RATIO, least: int = BAND_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """An order of the nodes, and where its bands start and end: longest first, and at the end the
    nodes of bands with fewer than ``least`` nodes.  Norms that differ by rounding share a band."""
    level = np.floor((np.log(norm.max()) - np.log(norm)) / np.log(ratio) + 1e-9).astype(np.int64)
    names, level, count = np.unique(level, return_inverse=True, return_counts=True)
    small = count < least
    rank = np.where(small, len(names), np.arange(len(names)))
    order = np.argsort(rank[level], kind="stable")
    return order, np.concatenate([[0], np.cumsum(count[~small])])


def _index(top: int, degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        nodes, member = np.unique(x[order], axis=0, return_inverse=True)
        placed, bands = norm_bands(_norms(nodes))
        nodes, member = nodes[placed], np.argsort(placed)[member.ravel()]
        by = np.argsort(member, kind="stable")  # ids stay in order inside a node
        start = np.searchsorted(member[by], np.arange(len(nodes)))
        rank = np.arange(len(by)) - start[member[by]]
        held = by[rank <= top]  # a query needs no more of equal vectors, itself aside
        graphs, entries = [np.zeros((0, degree), np.int32)], []
        for a, b in zip(bands, bands[1:]):
            unit = _unit(nodes[a:b])
            graphs.append(build_graph(unit, degree, beam, alpha))
            entries.append(with_unreached(graphs[-1], entry_points(unit)).tolist())
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "nodes": pa.array([nodes.astype(np.float64).tobytes()], pa.binary()),
                "bands": pa.array([bands.tolist()], pa.list_(pa.int64())),
                "edges": pa.array([np.concatenate(graphs).astype(np.int32).tobytes()], pa.binary()),
                "entries": pa.array([entries], pa.list_(pa.list_(pa.int64()))),
                "ids": pa.array([ids[order][held].tobytes()], pa.binary()),
                "member": pa.array([member[held].astype(np.int32).tobytes()], pa.binary()),
            }
        )

    return run


_SHARD = "shard int, nodes binary, bands array<long>, edges binary, entries array<array<long>>, ids binary, member binary"
_HITS = "query_id long, vec_id long, score double"


def _search(dim: int, degree: int, top: int, beam: int):
    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        cell = lambda c, kind: np.frombuffer(shard.column(c)[0].as_py(), kind)
        nodes = cell("nodes", np.float64).reshape(-1, dim)
        edges = cell("edges", np.int32).reshape(-1, degree)
        ids, member = cell("ids", np.int64), cell("member", np.int32)
        first = np.searchsorted(member, np.arange(len(nodes) + 1))
        bands = shard.column("bands")[0].as_py()
        parts = [
            (a, _unit(nodes[a:b]), _norms(nodes[a:b]).max(), edges[a:b], np.array(entry))
            for a, b, entry in zip(bands, bands[1:], shard.column("entries")[0].as_py())
        ]
        apart = nodes[bands[-1] :]
        own = queries.column("vec_id").to_numpy()
        q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), dim)
        out = []
        for at in range(0, len(own), _BATCH):
            part = q[at : at + _BATCH]
            flat, size = _unit(part), _norms(part)
            rows, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # The products that a further node must reach: one more than asked for, since the query may be among them.
            best = np.full((len(part), top + 1), -np.inf)
            if len(apart):
                exact = part @ apart.T
                least = np.partition(exact, -(top + 1), 1)[:, [-(top + 1)]] if len(apart) > top + 1 else -np.inf  # ties stay
                row, col = np.nonzero(exact >= least)
                rows.append(row)
                met.append(bands[-1] + col)
                best = np.partition(np.concatenate([best, exact], 1), -(top + 1), 1)[:, -(top + 1) :]
            for start, unit, longest, graph, entry in parts:
                with np.errstate(over="ignore"):
                    open_ = np.flatnonzero(longest * size * (1 + 1e-12) >= best.min(1))
                if not len(open_):
                    continue
                found, _ = _beam(unit, graph, entry, flat[open_], beam)
                row, col = np.nonzero(found >= 0)
                node = start + found[row, col]
                rows.append(open_[row])
                met.append(node)
                exact = np.full(found.shape, -np.inf)
                exact[row, col] = np.einsum("nd,nd->n", part[open_[row]], nodes[node])
                best[open_] = np.partition(np.concatenate([best[open_], exact], 1), -(top + 1), 1)[:, -(top + 1) :]
            row, node = np.concatenate(rows), np.concatenate(met)
            count = first[node + 1] - first[node]
            pick = np.repeat(first[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            score = np.repeat(np.einsum("nd,nd->n", part[row], nodes[node]), count)
            row = np.repeat(row, count)
            vec = ids[pick]
            keep = vec != own[at + row]
            row, vec, score = row[keep], vec[keep], score[keep]
            order = np.lexsort((vec, -score, row))
            row, vec, score = row[order], vec[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < top
            out.append(pa.table({"query_id": own[at + row[keep]], "vec_id": vec[keep], "score": score[keep]}))
        return pa.concat_tables(out)

    return run


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = 20,
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, degree: int = DEGREE, build_beam: int = BUILD_BEAM,
    beam: int = BEAM, alpha: float = ALPHA,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows with the largest inner product found.

    Queries are the rows for which ``is_query`` holds; a query never finds rows of its own id.
    Equal scores go to the smaller id.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do rows without an id and vectors of another
    length than the most frequent one (the smaller of equally frequent lengths).  Rows that
    repeat an id and vector count once.  Fewer candidates than ``top`` are all returned; an
    empty table gives no rows.
    """
    x = rows.filter(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda e: e.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    ).dropDuplicates(["vec_id", "v"])
    sizes = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).orderBy(F.desc("n"), "d").first()
    dim, n, asked = (sizes["d"], sizes["n"], sizes["q"]) if sizes else (1, 0, 0)
    shards, blocks = max(1, ceil(n / shard_rows)), max(1, ceil(asked / query_block))
    x = x.filter(F.size("v") == dim)
    index = x.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v").groupBy("shard").applyInArrow(
        _index(top, degree, build_beam, alpha), _SHARD
    )
    # Every block of the stated queries meets every shard.
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = x.filter("is_query").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v",
    )
    hits = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_search(dim, degree, top, beam), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
