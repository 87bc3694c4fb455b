"""Communities of an undirected graph by modularity (Louvain), and outlines of point sets.

Nodes move to neighbouring communities in rounds. All moves of a round are made at once, and still each adds to the
modularity at least what the round counts for it:

* of the moves that leave or enter a community, the one of most gain says whether the community gives or takes in this
  round; only moves from givers to takers are made. So the members that a node goes to stay where they are.
* nodes that enter a community together weigh on each other by the products of their degrees only. A move is made if its
  gain exceeds its weight against all that enter, or if it is the best of them.

The move of most gain is always made, so modularity rises in every round until a level's moves promise less than the
tolerance. Then communities become nodes, as long as there are fewer of them. On the way back the finer nodes move again,
from level to level, which mends early merges. There is no limit of rounds or levels.

A round joins edges with labels and aggregates by (node, community), then by node and by community; a hub's edges or a
large community are pre-aggregated or split, never gathered in one place. Rounds are staged, so executors may be lost.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.staging import discard, staged


@dataclass
class Communities:
    """rows: (node, community), a community being named by its least node. modularity: after each level, there and back."""

    rows: DataFrame
    modularity: list[float]


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (node, community) on edges (u, v, w) that stand in both directions."""
    ends = [labels.select(F.col("node").alias(n), F.col("community").alias(f"c{n}")) for n in ("u", "v")]
    t = edges.join(ends[0], "u").join(ends[1], "v")
    parts = t.groupBy("cu").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner"))
    row = parts.agg(F.sum("inner"), F.sum("k"), F.sum(F.col("k") * F.col("k"))).first()
    return float(row[0] / row[1] - row[2] / row[1] ** 2) if row[1] else 0.0


def _proposals(links: DataFrame, labels: DataFrame, double_m: float, turn: int) -> DataFrame:
    """(node, own, c, k, gain, tie): the best move of each node that gains by one. labels: (node, k, community)."""
    to = links.join(labels.select(F.col("node").alias("v"), F.col("community").alias("c")), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
    totals = labels.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("total"))
    own = labels.select(F.col("node").alias("u"), F.col("community").alias("own"), "k").join(totals.select(F.col("c").alias("own"), F.col("total").alias("own_total")), "own")
    options = to.join(own, "u").join(totals, "c")
    there = F.col("c") != F.col("own")
    worth = F.round(F.col("w") - F.col("k") * F.col("total") / double_m, 9)
    best = options.groupBy("u").agg(
        F.max(F.when(there, F.struct(worth.alias("worth"), F.xxhash64("u", "c", F.lit(turn)).alias("tie"), F.col("c").alias("c")))).alias("best"),
        F.coalesce(F.max(F.when(~there, F.col("w"))), F.lit(0.0)).alias("held"),
        *[F.first(x).alias(x) for x in ("own", "k", "own_total")],
    )
    gain = F.round(F.col("best.worth") - F.col("held") + F.col("k") * (F.col("own_total") - F.col("k")) / double_m, 9)
    return best.select(F.col("u").alias("node"), "own", F.col("best.c").alias("c"), "k", gain.alias("gain"), F.col("best.tie").alias("tie")).where(F.col("gain") > 1e-9)


def _made(moves: DataFrame, double_m: float) -> DataFrame:
    """(node, c) of the moves that are made together."""
    first = F.struct("gain", "tie", "node")
    roles = moves.select(F.col("own").alias("at"), first.alias("m"), F.lit(False).alias("takes")).unionByName(moves.select(F.col("c").alias("at"), first.alias("m"), F.lit(True).alias("takes")))
    roles = roles.groupBy("at").agg(F.max_by("takes", "m").alias("takes"))
    givers, takers = roles.where("NOT takes").select(F.col("at").alias("own")), roles.where("takes").select(F.col("at").alias("c"))
    may = moves.join(givers, "own", "left_semi").join(takers, "c", "left_semi")
    entering = may.groupBy("c").agg(F.sum("k").alias("_k"), F.max(first)["node"].alias("_first"))
    lasting = (F.col("gain") - F.col("k") * F.col("_k") / double_m > 0) | (F.col("node") == F.col("_first"))
    return may.join(entering, "c").where(lasting).select("node", F.col("c").alias("_to"))


def _settled(graph: DataFrame, labels: DataFrame, double_m: float, tolerance: float) -> DataFrame:
    """The labels (node, k, community), staged, after rounds of moves until those left promise less than the tolerance."""
    links, turn = graph.where(F.col("u") != F.col("v")), 0
    while True:
        moves = staged(_proposals(links, labels, double_m, turn), "moves")
        promised = moves.agg(F.sum("gain")).first()[0] or 0.0
        if 2 * promised / double_m < tolerance:
            discard(moves)
            return labels
        after = labels.join(_made(moves, double_m), "node", "left").select("node", "k", F.coalesce("_to", "community").alias("community"))
        before, labels, turn = labels, staged(after, "labels"), turn + 1
        discard(before)
        discard(moves)


def louvain(edges: DataFrame, left: str = "u", right: str = "v", weight: str | None = None, tolerance: float = 1e-4) -> Communities:
    """Communities of all nodes with an edge to another node; repeated edges count once (with weights: added up), null ends and loops not at all.

    Communities never cross components.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"), w.alias("w")).where(F.col(left) != F.col(right))
    pairs = pairs.groupBy("u", "v").agg(F.sum("w").alias("w") if weight else F.lit(1.0).alias("w"))
    graph = staged(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "graph")
    double_m = graph.agg(F.sum("w")).first()[0]
    if not double_m:
        return Communities(graph.select(F.col("u").alias("node"), F.col("u").alias("community")), [])
    history, levels = [], []
    while True:
        alone = staged(graph.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).withColumn("community", F.col("node")), "labels")
        nodes = alone.count()
        labels = _settled(graph, alone, double_m, tolerance)
        levels.append((graph, labels))
        if labels.select("community").distinct().count() == nodes:
            break
        a, b = [labels.select(F.col("node").alias(n), F.col("community").alias(f"c{n}")) for n in ("u", "v")]
        graph = staged(graph.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "graph")
        history.append(modularity(graph, graph.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()))
    graph, coarse = levels.pop()
    discard(graph)
    while levels:
        graph, labels = levels.pop()
        up = coarse.select(F.col("node").alias("community"), F.col("community").alias("_to"))
        start = staged(labels.join(up, "community").select("node", "k", F.col("_to").alias("community")), "labels")
        discard(labels)
        discard(coarse)
        coarse = _settled(graph, start, double_m, tolerance)
        history.append(modularity(graph, coarse))
        discard(graph)
    names = coarse.groupBy("community").agg(F.min("node").alias("_name"))
    return Communities(coarse.join(names, "community").select("node", F.col("_name").alias("community")), history)


def communities(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, community) of every node with an edge."""
    return louvain(edges, left, right).rows


def _convex(p: np.ndarray) -> list[int]:
    """Corners of the convex ring around sorted points, counter-clockwise."""

    def chain(order: range) -> list[int]:
        out: list[int] = []
        for i in order:
            x, y = p[i]
            while len(out) > 1 and (p[out[-1]][0] - p[out[-2]][0]) * (y - p[out[-2]][1]) - (p[out[-1]][1] - p[out[-2]][1]) * (x - p[out[-2]][0]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    n = len(p)
    return chain(range(n)) + chain(range(n - 1, -1, -1))


class _Free:
    """Points by rows of cells, to find the nearest to an edge."""

    def __init__(self, p: np.ndarray, taken: list[int]):
        self.alive = np.ones(len(p), bool)
        self.alive[taken] = False
        span = np.ptp(p, axis=0)
        self.cell = max(2 * float(np.sqrt(span[0] * span[1] / len(p))), 1e-9)
        self.low = float(p[:, 1].min())
        row = ((p[:, 1] - self.low) // self.cell).astype(np.int64)
        self.order = np.lexsort((p[:, 0], row))
        self.x, self.y = p[self.order].T
        self.ends = np.searchsorted(row[self.order], np.arange(row.max() + 2))

    def near(self, a: np.ndarray, b: np.ndarray, reach: float) -> tuple[int, float] | None:
        """(point, squared distance to the nearer end) of the free point nearest to the edge, beside it and within reach."""
        d, r = b - a, self.cell
        n2 = float(d @ d)
        while True:
            r = min(r, reach)
            first = max(0, int((min(a[1], b[1]) - r - self.low) // self.cell))
            last = min(len(self.ends) - 2, int((max(a[1], b[1]) + r - self.low) // self.cell))
            at = []
            for k in range(first, last + 1):
                row = self.x[self.ends[k] : self.ends[k + 1]]
                i, j = np.searchsorted(row, [min(a[0], b[0]) - r, max(a[0], b[0]) + r])
                at.append(np.arange(self.ends[k] + i, self.ends[k] + j))
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            at = at[self.alive[self.order[at]]]
            px, py = self.x[at] - a[0], self.y[at] - a[1]
            s = px * d[0] + py * d[1]
            gap = np.abs(px * d[1] - py * d[0]) / np.sqrt(n2)
            beside = np.flatnonzero((s > 0) & (s < n2) & (gap <= r))
            if len(beside):
                ends = np.minimum(px * px + py * py, (px - d[0]) ** 2 + (py - d[1]) ** 2)
                k = beside[np.lexsort((self.y[at[beside]], self.x[at[beside]], ends[beside], gap[beside]))[0]]
                return int(self.order[at[k]]), float(ends[k])
            if r >= reach:
                return None
            r *= 2


class _Edges:
    """The ring's edges as arrays, to see what a new edge would meet."""

    def __init__(self, p: np.ndarray, ring: list[int]):
        self.p, self.n = p, len(ring)
        self.ends = np.zeros((max(16, 2 * len(ring)), 2), np.int64)
        self.ends[: self.n] = list(zip(ring, [*ring[1:], ring[0]], strict=True))
        self.slot = {a: k for k, a in enumerate(ring)}
        self.boxes = np.zeros((len(self.ends), 4))
        for k in range(self.n):
            self._box(k)

    def _box(self, k: int) -> None:
        u, v = self.p[self.ends[k, 0]], self.p[self.ends[k, 1]]
        self.boxes[k] = [*np.minimum(u, v), *np.maximum(u, v)]

    def split(self, a: int, q: int, b: int) -> None:
        """The edge from a to b goes by q."""
        if self.n == len(self.ends):
            self.ends, self.boxes = np.vstack([self.ends, np.zeros_like(self.ends)]), np.vstack([self.boxes, np.zeros_like(self.boxes)])
        self.ends[self.slot[a], 1] = q
        self.slot[q] = self.n
        self.ends[self.n] = q, b
        self._box(self.slot[a])
        self._box(self.n)
        self.n += 1

    def meets(self, a: int, q: int, b: int) -> bool:
        """Whether a-q or q-b meets or touches an edge other than at a or b."""
        corner = self.p[[a, q, b]]
        low, high, box = corner.min(axis=0), corner.max(axis=0), self.boxes[: self.n]
        close = np.flatnonzero((box[:, 0] <= high[0]) & (box[:, 2] >= low[0]) & (box[:, 1] <= high[1]) & (box[:, 3] >= low[1]))
        close = close[close != self.slot[a]]
        u, v = self.p[self.ends[close, 0]], self.p[self.ends[close, 1]]
        for e in (a, b):
            s, t = self.p[e], self.p[q]
            side = lambda m, n, o: (n[..., 0] - m[..., 0]) * (o[..., 1] - m[..., 1]) - (n[..., 1] - m[..., 1]) * (o[..., 0] - m[..., 0])
            su, sv, us, ut = side(s, t, u), side(s, t, v), side(u, v, s), side(u, v, t)
            lo, hi = np.minimum(s, t), np.maximum(s, t)
            apart = (np.minimum(u, v) > hi).any(axis=1) | (np.maximum(u, v) < lo).any(axis=1)
            hit = (su * sv <= 0) & (us * ut <= 0) & ~apart
            # an edge that shares the end meets the new one elsewhere only if it holds q or leads along it
            shared = (self.ends[close] == e).any(axis=1)
            far = np.where((self.ends[close, 0] == e)[:, None], v, u)
            along = (side(s, t, far) == 0) & (((far - s) * (t - s)).sum(axis=1) > 0)
            if (hit & np.where(shared, along, True)).any():
                return True
        return False


def hull(points: np.ndarray, concavity: float = 2.0) -> np.ndarray:
    """Ring around points: the convex one, its edges dug in to the nearest free point beside them.

    An edge is dug in while it is more than ``concavity`` times as long as the way from the point to the nearer end, and
    the new edges meet no other one. What an edge is dug over holds no point, so the ring holds all points. A point's
    search reads the cells near its edge only.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 4:
        return p
    ring = _convex(p.tolist())
    if len(ring) < 3:
        return p[ring]
    free, edges = _Free(p, ring), _Edges(p, ring)
    after = dict(zip(ring, [*ring[1:], ring[0]], strict=True))
    queue = deque(after.items())
    while queue:
        a, b = queue.popleft()
        length2 = float(((p[b] - p[a]) ** 2).sum())
        found = free.near(p[a], p[b], np.sqrt(length2) / concavity)
        if found is None or found[1] * concavity**2 >= length2 or edges.meets(a, found[0], b):
            continue
        q = found[0]
        free.alive[q] = False
        edges.split(a, q, b)
        after[a], after[q] = q, b
        queue += [(a, q), (q, b)]
    out, at = [ring[0]], after[ring[0]]
    while at != ring[0]:
        out.append(at)
        at = after[at]
    return p[out]


def rim(points: DataFrame, key: str, step: float) -> DataFrame:
    """The distinct points (key, x, y) without those inside a full lattice: two points at each step on all sides of them.

    Digging takes the points nearest to the edge first, so it never comes to points two deep in a lattice. The counts
    run along rows, then along columns; no point becomes several rows.
    """
    w = lambda fixed, moving: W.partitionBy(key, fixed).orderBy(moving)

    def full(fixed: str, c: str) -> Column:
        at = w(fixed, c)
        return F.coalesce((F.lag(c, 2).over(at) == F.col(c) - 2 * step) & (F.lag(c).over(at) == F.col(c) - step) & (F.lead(c).over(at) == F.col(c) + step) & (F.lead(c, 2).over(at) == F.col(c) + 2 * step), F.lit(False))

    rows = points.distinct().withColumn("_row", full("y", "x").cast("int"))
    inner = full("x", "y") & (F.min("_row").over(w("x", "y").rowsBetween(-2, 2)) == 1)
    return rows.withColumn("_in", inner).where("NOT _in").select(key, "x", "y")


def outlines(members: DataFrame, key: str = "community", x: str = "x", y: str = "y", concavity: float = 2.0, step: float = 10.0) -> DataFrame:
    """(key, points, ring): a concave outline of each community's distinct points, which lie ``step`` apart where they are dense.

    A task holds the rim of a community, not its area; only the rim is shuffled to it.
    """

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(pdf[["x", "y"]].to_numpy(float), concavity)
        return pd.DataFrame([{"key": k[0], "ring": [{"x": float(a), "y": float(b)} for a, b in ring]}])

    every = members.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    found = rim(every, "key", step).groupBy("key").applyInPandas(run, "key string, ring array<struct<x:double,y:double>>")
    counts = every.groupBy("key").agg(F.count("*").cast("int").alias("points"))
    return counts.join(found, "key").select(F.col("key").alias(key), "points", "ring")


def statistics(members: DataFrame, least: int = 25, key: str = "community") -> DataFrame:
    """(key, size, mean, min, max of day over break members) of communities of at least ``least`` members."""
    day = F.when(F.col("is_break"), F.col("day"))
    return members.groupBy(key).agg(F.count("*").alias("size"), F.avg(day).alias("mean_day"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).where(F.col("size") >= least)
