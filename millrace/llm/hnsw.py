"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Distinct vectors are dealt to shards by a hash; each shard gets a graph of its
own, built and kept as arrays. Every shard's graph is searched for every vector.
A search is a beam from the top layer down, for many vectors in lock-step; from
what it finds at or above the threshold it spreads over the bottom layer until
nothing new is near enough. While the graph is built, audits compare searches of a
sample with brute force and widen the beam until their recall is reached; a shard
whose widest beam falls short is searched by brute force. Cosines
of what is found are then computed in double precision, and the pairs at or above
the threshold are united into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, scratch
from .components import connected_components

THRESHOLD = 0.95
#: Vectors of a shard at most, in expectation, and shards at least.
SHARD_ROWS, MIN_SHARDS = 65_536, 8
#: Links of a node (twice that in the bottom layer), beam while building.
LINKS, BUILD_BEAM, FIRST_BEAM = 12, 48, 24
#: Vectors audited in a shard, and the recall to reach.
AUDIT_ROWS, AUDIT_RECALL = 128, 0.995
#: Single precision may be off by this much; verification is in double.
SLACK = 1e-4
_STEP = 4  # nodes of a beam that are expanded at a time
_CELLS = 16_000_000  # visited marks held at a time
_FRONTIER = 16_384  # found pairs spread from at a time


def _select(x: np.ndarray, base: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates: those nearer to the row than to any
    chosen before, then the nearest others. -1 is no candidate."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * keep]
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = cand.shape
    among = np.empty((rows, width, width), np.float32)
    for i in range(0, rows, 512):
        v = x[np.maximum(cand[i : i + 512], 0)]
        among[i : i + 512] = v @ v.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)  # to a chosen one
    count = np.zeros(rows, np.int64)
    for j in range(width):
        take = (cand[:, j] >= 0) & (sims[:, j] > nearest[:, j]) & (count < keep)
        chosen[:, j] = take
        count += take
        np.maximum(nearest, np.where(take[:, None], among[:, j], -np.inf), out=nearest)
    rank = np.where(cand < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
    first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(cand, first, 1)
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of each query's beam, best first; -1 fills up."""
    n, m = len(links), len(q)
    visited = np.zeros((m, n), bool)
    ids = np.full((m, width), -1, np.int32)
    sims = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    entry = entry[:, :width]
    e = entry.shape[1]
    at, col = np.nonzero(entry >= 0)
    ids[:, :e] = entry
    sims[at, col] = np.einsum("ij,ij->i", q[at], x[entry[at, col]])
    done[at, col] = False
    visited[at, entry[at, col]] = True
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], -np.inf, sims[live])
        step = min(_STEP, width)
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        ok = np.take_along_axis(open_, best, 1) > -np.inf
        alive = ok.any(axis=1)
        live, best, ok = live[alive], best[alive], ok[alive]
        if not len(live):
            break
        done[live[:, None], best] = True
        nodes = np.where(ok, ids[live[:, None], best], -1)
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[visited[live[:, None], near]] = -1
        r, c = np.nonzero(near >= 0)
        got = near[r, c]
        visited[live[r], got] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", q[live[r]], x[got])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], near < 0], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(sims, order, 1)), np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)


class Graph:
    """The graph of one shard's unit vectors ``x`` (single precision).

    Nodes are in order of falling level, so layer l is the first ``sizes[l]``
    nodes; ``layers[0]`` is the bottom. A width of 0 stands for brute force.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], width: int = FIRST_BEAM):
        self.x, self.layers, self.width = x, layers, width

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        sizes = [len(x)]
        while sizes[-1] > 2 * links:
            sizes.append(max(1, sizes[-1] // links))
        layers: list[np.ndarray] = []
        for level in range(len(sizes) - 1, -1, -1):  # layers holds the built ones, top first
            n, most = sizes[level], links if level else 2 * links
            out = np.full((n, most), -1, np.int32)
            above = cls(x, layers[::-1])
            at = 0
            while at < n:
                to = min(n, max(at * 2, 256), at + 1024)
                new = np.arange(at, to)
                among = x[at:to] @ x[at:to].T
                np.fill_diagonal(among, -np.inf)
                among[np.triu_indices(len(new))] = -np.inf  # earlier ones of the batch
                k = min(beam, len(new))
                own = np.argpartition(-among, k - 1, axis=1)[:, :k]
                own_sims = np.take_along_axis(among, own, 1)
                cand, sims = np.where(np.isfinite(own_sims), own + at, -1), own_sims
                if at:
                    start = above._descend(x[new]) if layers else np.zeros((len(new), 1), np.int32)
                    start = np.where(start < at, start, -1)
                    start[(start < 0).all(axis=1), 0] = 0
                    found, s = _beam(x, out[:at], x[new], start, beam)
                    cand, sims = np.concatenate([cand, found], axis=1), np.concatenate([sims, s], axis=1)
                chosen = _select(x, new, cand, np.where(cand >= 0, sims, -np.inf), links)
                out[at:to, :links] = chosen
                _link_back(x, out, new, chosen)
                at = to
            layers.append(out)
        return cls(x, layers[::-1])

    def _descend(self, q: np.ndarray, width: int = 4) -> np.ndarray:
        """Entry points for the layer below this graph's layers."""
        entry = np.zeros((len(q), 1), np.int32)
        for links in reversed(self.layers):
            entry, _ = _beam(self.x, links, q, entry, width)
        return entry

    def near(self, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of what is found at or above ``least``, for some queries at a time."""
        upper = Graph(self.x, self.layers[1:])
        links, n = self.layers[0], len(self.x)
        chunk = max(16, min(512, _CELLS // max(n, 1)))
        if not self.width:
            for i in range(0, len(q), chunk):
                r, at = np.nonzero(q[i : i + chunk] @ self.x.T >= least)
                yield r + i, at
            return
        for i in range(0, len(q), chunk):
            some = q[i : i + chunk]
            ids, sims = _beam(self.x, links, some, upper._descend(some), min(self.width, n))
            r, c = np.nonzero((ids >= 0) & (sims >= least))
            at = ids[r, c]
            found_r, found = [r], [at]
            # Not the beam's own marks: it has seen near ones that it had no room for.
            visited = np.zeros((len(some), n), bool)
            visited[r, at] = True
            while len(at):
                new_r, new = [], []
                for j in range(0, len(at), _FRONTIER):
                    key = (r[j : j + _FRONTIER, None].astype(np.int64) * n + links[at[j : j + _FRONTIER]])[links[at[j : j + _FRONTIER]] >= 0]
                    key = np.unique(key[~visited.reshape(-1)[key]])
                    visited.reshape(-1)[key] = True
                    q_of, node = key // n, key % n
                    ok = np.concatenate([np.einsum("ij,ij->i", some[q_of[k : k + 65536]], self.x[node[k : k + 65536]]) >= least for k in range(0, len(key), 65536)] or [np.zeros(0, bool)])
                    new_r.append(q_of[ok])
                    new.append(node[ok])
                r, at = np.concatenate(new_r), np.concatenate(new)
                found_r.append(r)
                found.append(at)
            yield np.concatenate(found_r) + i, np.concatenate(found)

    def audit(self, least: float, rows: int = AUDIT_ROWS, recall: float = AUDIT_RECALL) -> None:
        """Widen the beam until searches of evenly spread nodes find what brute force finds.

        The recall is the mean over the nodes that have neighbours, so that a large
        group cannot hide what small ones miss. If the widest beam falls short, the
        width becomes 0: brute force.
        """
        pick = np.unique(np.linspace(0, len(self.x) - 1, min(rows, len(self.x))).astype(int))
        true = [np.setdiff1d(np.flatnonzero(self.x[p] @ self.x.T >= least), [p]) for p in pick]
        pick, true = [p for p, t in zip(pick, true, strict=True) if len(t)], [t for t in true if len(t)]
        while pick and self.width:
            found: list[list[np.ndarray]] = [[] for _ in pick]
            for r, node in self.near(self.x[pick], least):
                for i in np.unique(r):
                    found[i].append(node[r == i])
            if np.mean([np.isin(t, np.concatenate(f or [t[:0]])).mean() for t, f in zip(true, found, strict=True)]) >= recall:
                return
            self.width = self.width * 2 if self.width < len(self.x) else 0


def _link_back(x: np.ndarray, out: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the new nodes to the lists of those they chose; a full list is chosen anew."""
    most = out.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, frm = chosen[r, c], new[r].astype(np.int32)
    sims = np.einsum("ij,ij->i", x[to], x[frm])
    order = np.lexsort((-sims, to))
    to, frm = to[order], frm[order]
    nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, counts)
    few = rank < most
    more = np.full((len(nodes), most), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), counts)[few], rank[few]] = frm[few]
    both = np.concatenate([out[nodes], more], axis=1)
    for i in range(0, len(nodes), 2048):
        part, some = both[i : i + 2048], nodes[i : i + 2048]
        s = np.where(part >= 0, np.einsum("ikj,ij->ik", x[np.maximum(part, 0)], x[some]), -np.inf)
        out[some] = _select(x, some, part, s, most)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def is_usable(vec: Column) -> Column:
    """Not null, not empty, only finite components, and not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _build(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    vecs = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    nodes = pdf["node"].to_numpy(np.int64)
    order = np.random.default_rng(7).permutation(len(nodes))  # levels fall in a random order
    nodes, vecs = nodes[order], vecs[order]
    graph = Graph.build(_unit(vecs).astype(np.float32))
    graph.audit(threshold - SLACK)
    return pd.DataFrame({"dim": [vecs.shape[1]], "shard": [pdf["shard"].iloc[0]], "nodes": [nodes.tobytes()], "copies": [pdf["n"].to_numpy(np.int64)[order].tobytes()], "vecs": [vecs.tobytes()], "links": [[a.tobytes() for a in graph.layers]], "width": [graph.width]})


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels, in place, until both ends of every edge (a, b) have one label."""
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]


def _search(key: tuple, graphs: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one shard's vectors with another shard's: (node, links, root).

    Each shard's vectors are searched in the other's graph. Searches are not
    symmetric: a link counts, once, if either end finds it. A row for each node with
    links: how many rows they stand for, and a node that it is connected with here.
    So what leaves the task grows with the nodes, not with the pairs.
    """
    none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(graphs) or not len(asked):
        return none
    dim, of, by = (int(k) for k in key)

    def read(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        nodes, x = np.frombuffer(row["nodes"], np.int64), _unit(np.frombuffer(row["vecs"], np.float64).reshape(-1, dim))
        sizes = [len(nodes)]
        while sizes[-1] > 2 * LINKS:
            sizes.append(max(1, sizes[-1] // LINKS))
        layers = [np.frombuffer(b, np.int32).reshape(n, -1) for b, n in zip(row["links"], sizes, strict=True)]
        return nodes, np.frombuffer(row["copies"], np.int64), x, Graph(x.astype(np.float32), layers, int(row["width"]))

    nodes, copies, x, graph = read(graphs.iloc[0])
    asked_nodes, asked_copies, y, asked_graph = read(asked.iloc[0])
    n, m, same = len(nodes), len(asked_nodes), of == by
    label, links, asked_links = np.arange(n + m), np.zeros(n), np.zeros(m)
    # A bit for each pair that has been counted; pages of nodes without links stay untouched.
    seen = np.zeros((m, -(-n // 8)), np.uint8)

    def count(r: np.ndarray, at: np.ndarray) -> None:
        keep = np.concatenate([np.einsum("ij,ij->i", y[r[i : i + 65536]], x[at[i : i + 65536]]) >= threshold for i in range(0, len(r), 65536)] or [np.zeros(0, bool)])
        r, at = r[keep], at[keep]
        if same:  # both have one order; a pair is kept by its later end
            r, at = np.maximum(r, at)[r != at], np.minimum(r, at)[r != at]
        pair = np.unique(r.astype(np.int64) * n + at)
        r, at = pair // n, pair % n
        new = (seen[r, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        r, at = r[new], at[new]
        np.bitwise_or.at(seen, (r, at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        asked_links[:] += np.bincount(r, weights=copies[at], minlength=m)
        links[:] += np.bincount(at, weights=asked_copies[r], minlength=n)
        _merge(label, at, r if same else n + r)

    for r, at in graph.near(asked_graph.x, threshold - SLACK):
        count(r, at)
    if same:  # this one search had both directions
        links, label, ids = links + asked_links, label[:n], nodes
    else:
        for at, r in asked_graph.near(graph.x, threshold - SLACK):
            count(r, at)
        links, ids = np.concatenate([links, asked_links]), np.concatenate([nodes, asked_nodes])
    has = np.flatnonzero(links)
    return pd.DataFrame({"node": ids[has], "links": links[has].astype(np.int64), "root": ids[label[has]]})


def near_duplicate_vectors(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows whose vectors have a cosine of ``threshold`` or more are linked. n_links
    counts a row's directly linked other rows, equal vectors among them. Vectors
    that are null, empty or all zero, or that hold null or non-finite components,
    link with nothing, nor do vectors of different lengths. component_id is the
    smallest id reachable; kept says whether it is the row's own. Repeated rows are
    rows of their own. Other columns are ignored. Equal vectors enter once, however
    many rows have them.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = src.where(is_usable(F.col("vec")))
    with scratch() as keep:
        # A written table fixes the node numbers, whatever tasks are run again later.
        distinct = materialize(good.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
        n = distinct.count()  # from the files' footers
        shards = max(MIN_SHARDS, -(-n // SHARD_ROWS))
        dealt = distinct.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "n", "vec")
        graphs = dealt.groupBy("dim", "shard").applyInPandas(lambda pdf: _build(pdf, threshold), "dim int, shard int, nodes binary, copies binary, vecs binary, links array<binary>, width int")
        graphs = materialize(graphs, "graphs")
        # Each pair of shards meets in one task, which searches both graphs.
        searched = graphs.select("dim", F.col("shard").alias("of"), F.explode(F.sequence(F.col("shard"), F.lit(shards - 1))).alias("by"), "nodes", "copies", "vecs", "links", "width")
        asked = graphs.select("dim", F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("of"), F.col("shard").alias("by"), "nodes", "copies", "vecs", "links", "width")
        found = searched.groupBy("dim", "of", "by").cogroup(asked.groupBy("dim", "of", "by")).applyInPandas(lambda key, g, a: _search(key, g, a, threshold), "node long, links long, root long")
        found = materialize(found, "links", n * shards)
        labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), n * shards)
        linked = found.groupBy("node").agg(F.sum("links").alias("links"))
        named = distinct.select("node", "n", "least").join(labels.select(F.col("v").alias("node"), "root"), "node", "left").join(linked, "node", "left")
        named = materialize(named.select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "named", n)
        least = materialize(named.groupBy("root").agg(F.min("least").alias("component")), "least", n)
        classes = named.join(least, "root").select("node", "links", "component")
        classes = keep(materialize(distinct.select("node", "vec").join(classes, "node").select("vec", "links", "component"), "classes", n))
    out = src.withColumn("vec", F.when(is_usable(F.col("vec")), F.col("vec"))).join(classes, "vec", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
