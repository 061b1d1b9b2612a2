"""Trees: extremely randomised ensembles and exhaustive (CART) ones, their growth, votes and storage.

Modes: R regression, P periodic (radians), C classes. A tree is a table of nodes (tree, node, attr, cut, leaf, value, spread,
classes, left, right); node 0 is the root, and rows with x[attr] < cut go left.

Growth reads the rows as they are and never rewrites them. While a node holds more rows than fit a group, its ranges and
its cuts' scores are sums over all rows: each task routes its rows through the nodes made so far, which are bounded and
broadcast, adds up what it has seen, and only those sums are shuffled. As soon as all nodes are small, one shuffle sends
each node's rows to a group that grows the rest of its subtree in numpy, level by level. Cuts come from hashes of the
seed and the path from the root, and scores are compared rounded, so where a node is grown doesn't matter. No depth is
out of bounds: children are found by their ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import circ_mean
from ..llm.common import spread
from ..storage import materialise, ship

#: Rows of a node whose subtree one group grows, or more where MOST_OPEN nodes wouldn't do; nodes that are broadcast at most, while growing and as a model.
LOCAL_ROWS, MOST_OPEN, MODEL_NODES = 50_000, 1 << 17, 500_000
NODE = "tree int, node long, attr int, cut double, leaf boolean, value double, spread double, classes map<int,bigint>, left long, right long"
_U = np.uint64


def defaults(mode: str, n_attributes: int) -> tuple[int, int]:
    """(attributes tried at a node, least rows of a node that is split)."""
    return (max(1, round(math.sqrt(max(n_attributes - 1, 0)))), 2) if mode == "C" else (max(1, n_attributes - 1), 5)


def side_score(rows: DataFrame, mode: str, keys: list[str], side: str, measure: str = "entropy") -> DataFrame:
    """(keys, score, n_left, n_right) of splits: minus the mean impurity of both sides, weighted by rows. rows: keys, side (boolean), y."""
    if mode == "C":
        c = rows.groupBy(*keys, side, "y").agg(F.count("*").alias("n"))
        g = c.groupBy(*keys, side).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("n2"))
        bad = F.col("n") * F.log("n") - F.col("nl") if measure == "entropy" else F.col("n") - F.col("n2") / F.col("n")
    elif mode == "P":
        g = rows.groupBy(*keys, side).agg(F.count("*").alias("n"), F.sum(F.sin("y")).alias("s"), F.sum(F.cos("y")).alias("c"))
        bad = F.col("n") - F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    else:
        g = rows.groupBy(*keys, side).agg(F.count("*").alias("n"), F.var_pop("y").alias("v"))
        bad = F.col("n") * F.col("v")
    left = F.col(side)
    return g.withColumn("_bad", bad).groupBy(*keys).agg(F.try_divide(-F.sum("_bad"), F.sum("n")).alias("score"), F.coalesce(F.sum(F.when(left, F.col("n"))), F.lit(0)).alias("n_left"), F.coalesce(F.sum(F.when(~left, F.col("n"))), F.lit(0)).alias("n_right"))


# What a node sums up


@dataclass(frozen=True)
class Task:
    """How trees are grown. `impurity`, if given, replaces the mode's: from sums (.. x len(features)) to n times the impurity."""

    mode: str
    n_attributes: int
    k: int
    nmin: int
    seed: int = 0
    measure: str = "entropy"
    exhaustive: bool = False
    max_depth: int | None = None
    shift: float = 0.0
    classes: tuple[int, ...] = ()
    impurity: Callable[[np.ndarray], np.ndarray] | None = None

    def features(self, y: np.ndarray) -> np.ndarray:
        """rows x sums: what the impurity and the leaves are made of."""
        if self.mode == "C":
            return (y[:, None] == np.array(self.classes, float)[None, :]).astype(float)
        if self.mode == "P":
            return np.column_stack([np.ones(len(y)), np.sin(y), np.cos(y)])
        d = y - self.shift
        return np.column_stack([np.ones(len(y)), d, d * d])

    def size(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1) if self.mode == "C" else s[..., 0]

    def bad(self, s: np.ndarray) -> np.ndarray:
        """Rows times impurity."""
        if self.impurity:
            return self.impurity(s)
        n = np.maximum(self.size(s), 1e-300)
        if self.mode == "P":
            return np.maximum(0.0, s[..., 0] - np.hypot(s[..., 1], s[..., 2]))
        if self.mode == "R":
            return np.maximum(0.0, s[..., 2] - s[..., 1] ** 2 / n)
        if self.measure == "gini":
            return n - (s * s).sum(axis=-1) / n
        return n * np.log(n) - (s * np.log(np.maximum(s, 1e-300))).sum(axis=-1)

    def relative(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What a split leaves of a node's impurity, rounded; infinite if a side is empty."""
        right = total - left
        left_over = (self.bad(left) + self.bad(right)) / np.maximum(self.bad(total), 1e-300)
        return np.where((self.size(left) > 0.5) & (self.size(right) > 0.5), np.round(left_over, 9), np.inf)

    def leaf(self, s: np.ndarray) -> tuple[float, float, list | None]:
        """(value, spread, classes) of a leaf: mean and deviation; circular mean and half-width of its confidence interval; mode (the largest of equals) and share."""
        n = float(self.size(s))
        if self.mode == "R":
            m = s[1] / n
            return self.shift + m, math.sqrt(max(0.0, s[2] / n - m * m)), None
        if self.mode == "P":
            return math.atan2(s[1], s[2]), _confidence(math.hypot(s[1], s[2]) / n, n), None
        at = len(s) - 1 - int(np.argmax(s[::-1]))
        return (float(self.classes[at]) if self.exhaustive else float(s @ np.array(self.classes, float)) / n), s[at] / n, [(c, int(v)) for c, v in zip(self.classes, s) if v]


def _confidence(r: float, n: float, sigma: float = 2.0) -> float:
    """functions.stats.circ_confidence of one group."""
    c2, big = sigma * sigma, r * n
    t = math.nan
    if r >= 0.9:
        t = math.sqrt(max(0.0, n * n - (n * n - big * big) * math.exp(c2 / n)))
    elif r > math.sqrt(c2 / 2 / n) and 4 * n > c2:
        t = math.sqrt(max(0.0, 2 * n * (2 * big * big - n * c2) / (4 * n - c2)))
    return -1.0 if math.isnan(t) else math.acos(min(1.0, t / big))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def root_keys(seed: int, trees) -> np.ndarray:
    """A key for each tree; keys of children come from their parent's."""
    return _mix(np.array([(seed + int(t)) & (2**64 - 1) for t in trees], _U) + _U(0x9E3779B97F4A7C15))


def _child_keys(keys: np.ndarray) -> np.ndarray:
    """keys x 2."""
    return np.stack([_mix(keys * _U(2) + _U(side + 1)) for side in (0, 1)], axis=-1)


def _uniform(keys: np.ndarray, attr: np.ndarray, kind: int) -> np.ndarray:
    """In (0, 1]."""
    return ((_mix(keys ^ _mix(attr.astype(_U) * _U(2) + _U(kind + 1))) >> _U(12)).astype(float) + 1) / (1 << 52)


def random_cuts(task: Task, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes with ranges lo, hi (nodes x attributes) the k attributes tried (-1: none is left) and their cuts, nodes x k."""
    a = np.arange(task.n_attributes)
    order = np.where(lo < hi, _uniform(keys[:, None], a[None, :], 0), np.inf)
    tried = np.argsort(order, axis=1, kind="stable")[:, : task.k]
    there = np.take_along_axis(order, tried, 1) < np.inf
    low, high = np.take_along_axis(lo, tried, 1), np.take_along_axis(hi, tried, 1)
    with np.errstate(invalid="ignore"):
        cut = low + (high - low) * _uniform(keys[:, None], tried, 1)
    return np.where(there, tried, -1), cut


def _best(left_over: np.ndarray, attr: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each row of alternatives the place of the best one: least impurity, then least attribute, then least cut."""
    return np.lexsort((cut, attr, left_over), axis=1)[:, 0]


# Growth within a group


def grow(task: Task, x: np.ndarray, y: np.ndarray, key: np.uint64, depth: int) -> list[tuple]:
    """All nodes of a subtree: (place, attr, cut, sums or None, left place, right place); place 0 is its root."""
    f = task.features(y)
    at, places, keys, made, n_made = np.zeros(len(y), np.int64), np.zeros(1, np.int64), np.array([key], _U), [], 1
    rows = np.arange(len(y))
    while len(places):
        m = len(places)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        starts = np.searchsorted(at, np.arange(m))
        sums = np.add.reduceat(f[rows], starts, axis=0)
        n = np.diff(np.append(starts, len(rows)))
        ys, xs = y[rows], x[rows]
        lo, hi = np.minimum.reduceat(xs, starts, axis=0), np.maximum.reduceat(xs, starts, axis=0)
        may = (n >= task.nmin) & (np.minimum.reduceat(ys, starts) < np.maximum.reduceat(ys, starts)) & (lo < hi).any(axis=1)
        if task.max_depth is not None and depth >= task.max_depth:
            may[:] = False
        attr, cut, ok = _split_exhaustive(task, xs, f[rows], at, sums, may) if task.exhaustive else _split_random(task, xs, f[rows], at, sums, may, keys, lo, hi)
        split = np.flatnonzero(ok)
        lefts = np.full(m, -1, np.int64)
        lefts[split] = n_made + 2 * np.arange(len(split))
        for j in range(m):
            made.append((int(places[j]), int(attr[j]), float(cut[j]), None, int(lefts[j]), int(lefts[j]) + 1) if ok[j] else (int(places[j]), -1, 0.0, sums[j], -1, -1))
        n_made += 2 * len(split)
        on = ok[at]
        rows, was = rows[on], at[on]
        number = np.cumsum(ok) - 1
        right = ~(x[rows, attr[was]] < cut[was])
        at = 2 * number[was] + right
        places = (lefts[split][:, None] + np.arange(2)[None, :]).ravel()
        keys = _child_keys(keys[split]).ravel()
        depth += 1
    return made


def _split_random(task, xs, f, at, sums, may, keys, lo, hi):
    tried, cuts = random_cuts(task, keys, lo, hi)
    left_over = np.full(tried.shape, np.inf)
    for j in range(tried.shape[1]):
        left = xs[np.arange(len(xs)), tried[at, j]] < cuts[at, j]
        got = np.stack([np.bincount(at[left], f[left, c], len(may)) for c in range(f.shape[1])], axis=1)
        left_over[:, j] = np.where(tried[:, j] >= 0, task.relative(got, sums), np.inf)
    best = _best(left_over, tried, cuts)
    take = np.arange(len(may))
    return tried[take, best], cuts[take, best], may & np.isfinite(left_over[take, best])


def _split_exhaustive(task, xs, f, at, sums, may):
    m = len(may)
    found = [np.full((m, task.n_attributes), np.inf), np.tile(np.arange(task.n_attributes), (m, 1)), np.zeros((m, task.n_attributes))]
    for a in range(task.n_attributes):
        order = np.lexsort((xs[:, a], at))
        node, v = at[order], xs[order, a]
        run = np.cumsum(f[order], axis=0)
        start = np.searchsorted(node, np.arange(m))
        run -= np.where(start > 0, run[start - 1].T, 0.0).T[node]
        edge = np.flatnonzero((node[1:] == node[:-1]) & (v[1:] > v[:-1]))
        if not len(edge):
            continue
        cut = midpoint(v[edge], v[edge + 1])
        left_over = task.relative(run[edge], sums[node[edge]])
        first = np.lexsort((cut, left_over, node[edge]))
        nodes, at_first = np.unique(node[edge][first], return_index=True)
        pick = first[at_first]
        found[0][nodes, a], found[2][nodes, a] = left_over[pick], cut[pick]
    best = _best(*found)
    take = np.arange(m)
    return found[1][take, best], found[2][take, best], may & np.isfinite(found[0][take, best])


def midpoint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between two values, above the lower one."""
    mid = a + (b - a) / 2
    return np.where(mid > a, mid, b)


# Growth over all rows


class Top:
    """The nodes that are made over all rows, for all trees: arrays by node, the first n_trees being the roots."""

    def __init__(self, task: Task, n_trees: int, n_rows: int):
        self.task, self.n_trees = task, n_trees
        self.tree = np.arange(n_trees)
        self.attr, self.cut = np.full(n_trees, -1), np.zeros(n_trees)
        self.left, self.right = np.full(n_trees, -1), np.full(n_trees, -1)
        self.key, self.depth, self.rows = root_keys(task.seed, range(n_trees)), np.zeros(n_trees, int), np.full(n_trees, n_rows)
        self.sums: dict[int, np.ndarray] = {}  # of nodes that are leaves already

    def route(self, x: np.ndarray, tree: int) -> np.ndarray:
        return _route(self.attr, self.cut, self.left, self.right, x, np.full(len(x), tree))

    def split(self, node: np.ndarray, attr: np.ndarray, cut: np.ndarray, n_left: np.ndarray) -> None:
        first, k = len(self.attr), len(node)
        self.attr[node], self.cut[node] = attr, cut
        self.left[node], self.right[node] = first + 2 * np.arange(k), first + 2 * np.arange(k) + 1
        both = lambda v: np.repeat(v, 2)
        self.tree = np.append(self.tree, both(self.tree[node]))
        self.depth = np.append(self.depth, both(self.depth[node]) + 1)
        self.key = np.append(self.key, _child_keys(self.key[node]).ravel())
        self.rows = np.append(self.rows, np.stack([n_left, self.rows[node] - n_left], axis=1).ravel())
        for name, empty in (("attr", -1), ("cut", 0.0), ("left", -1), ("right", -1)):
            setattr(self, name, np.append(getattr(self, name), np.full(2 * k, empty)))


def _route(attr, cut, left, right, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node without children that each row comes to."""
    on = np.flatnonzero(attr[at] >= 0)
    while len(on):
        a = at[on]
        at[on] = np.where(x[on, attr[a]] < cut[a], left[a], right[a])
        on = on[attr[at[on]] >= 0]
    return at


def _matrix(column, n_attributes: int) -> np.ndarray:
    """rows x attributes of an Arrow array of lists; null is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, :n_attributes]


def _ranges(src: DataFrame, top: Top, big: np.ndarray) -> tuple:
    """n, y0, y1 and lo, hi of the attributes of the nodes `big`."""
    slot_of = np.full(len(top.attr), -1)
    slot_of[big] = np.arange(len(big))
    shared, m, p = src.sparkSession.sparkContext.broadcast((top, slot_of)), len(big), top.task.n_attributes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, slot_of = shared.value
        low, high, n = np.full((m, p + 1), np.inf), np.full((m, p + 1), -np.inf), np.zeros(m, np.int64)
        for b in batches:
            x = _matrix(b.column(2), p)
            v = np.column_stack([x, b.column(1).to_numpy()])
            for t in range(top.n_trees):
                slot = slot_of[top.route(x, t)]
                order = np.argsort(slot, kind="stable")
                order = order[np.searchsorted(slot[order], 0) :]
                if len(order):
                    there, starts = np.unique(slot[order], return_index=True)
                    low[there] = np.minimum(low[there], np.minimum.reduceat(v[order], starts, axis=0))
                    high[there] = np.maximum(high[there], np.maximum.reduceat(v[order], starts, axis=0))
                    n[there] += np.diff(np.append(starts, len(order)))
        s = np.flatnonzero(n)
        flat = lambda z: pa.array(z[s].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s, p + 1)), pa.array(np.tile(np.arange(p + 1), len(s))), flat(low), flat(high)], names=["slot", "a", "lo", "hi"])

    got = src.mapInArrow(run, "slot long, a long, lo double, hi double").groupBy("slot", "a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    lo, hi = np.full((m, p + 1), np.nan), np.full((m, p + 1), np.nan)
    s, a = got["slot"].to_numpy(), got["a"].to_numpy()
    lo[s, a], hi[s, a] = got["lo"].to_numpy(), got["hi"].to_numpy()
    return lo[:, p], hi[:, p], lo[:, :p], hi[:, :p]


def _sums(src: DataFrame, top: Top, big: np.ndarray, tried: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the nodes (nodes x sums) and of the left sides of their cuts (nodes x k x sums)."""
    slot_of = np.full(len(top.attr), -1)
    slot_of[big] = np.arange(len(big))
    m, k, p, w = len(big), tried.shape[1], top.task.n_attributes, top.task.features(np.zeros(1)).shape[1]
    shared = src.sparkSession.sparkContext.broadcast((top, slot_of, tried, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, slot_of, tried, cuts = shared.value
        total = np.zeros((m, k + 1, w))
        for b in batches:
            x, f = _matrix(b.column(2), p), top.task.features(b.column(1).to_numpy())
            for t in range(top.n_trees):
                slot = slot_of[top.route(x, t)]
                on = np.flatnonzero(slot >= 0)
                s = slot[on]
                for j in range(k + 1):
                    left = np.ones(len(on), bool) if j == k else (tried[s, j] >= 0) & (x[on, tried[s, j]] < cuts[s, j])
                    for c in range(w):
                        total[:, j, c] += np.bincount(s[left], f[on[left], c], m)
        place = np.flatnonzero(total.any(axis=(1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, (k + 1) * w)), pa.array(np.tile(np.arange((k + 1) * w), len(place))), pa.array(total[place].ravel())], names=["slot", "a", "v"])

    got = src.mapInArrow(run, "slot long, a long, v double").groupBy("slot", "a").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((m, (k + 1) * w))
    out[got["slot"].to_numpy(), got["a"].to_numpy()] = got["v"].to_numpy()
    out = out.reshape(m, k + 1, w)
    return out[:, k], out[:, :k]


def _grow_top(src: DataFrame, top: Top, local: int) -> None:
    """Splits nodes of more than `local` rows until there are none but leaves."""
    task = top.task
    while True:
        big = np.flatnonzero((top.attr < 0) & (top.rows > local))
        big = big[[i not in top.sums for i in big.tolist()]]
        if not len(big):
            return
        y0, y1, lo, hi = _ranges(src, top, big)
        may = (top.rows[big] >= task.nmin) & (y0 < y1) & (lo < hi).any(axis=1)
        if task.max_depth is not None:
            may &= top.depth[big] < task.max_depth
        if task.exhaustive:
            tried, cuts = _exhaustive_cuts(src, top, big)
        else:
            tried, cuts = random_cuts(task, top.key[big], lo, hi)
        sums, left = _sums(src, top, big, tried, cuts)
        left_over = np.where(tried >= 0, task.relative(left, sums[:, None, :]), np.inf)
        best = _best(left_over, tried, cuts)
        take = np.arange(len(big))
        ok = may & np.isfinite(left_over[take, best])
        top.split(big[ok], tried[take, best][ok], cuts[take, best][ok], np.round(task.size(left[take, best])[ok]).astype(int))
        for i in np.flatnonzero(~ok):
            top.sums[int(big[i])] = sums[i]


def _exhaustive_cuts(src: DataFrame, top: Top, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cut of each attribute of each node, nodes x attributes; -1: none."""
    slot_of = np.full(len(top.attr), -1)
    slot_of[big] = np.arange(len(big))
    p, shared = top.task.n_attributes, src.sparkSession.sparkContext.broadcast((top, slot_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, slot_of = shared.value
        for b in batches:
            x, y = _matrix(b.column(2), p), b.column(1).to_numpy()
            for t in range(top.n_trees):
                slot = slot_of[top.route(x, t)]
                on = np.flatnonzero(slot >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(slot[on], p)), pa.array(np.tile(np.arange(p), len(on)).astype(np.int32)), pa.array(x[on].ravel()), pa.array(np.repeat(y[on], p))], names=["slot", "attr", "v", "y"])

    cuts = _scored_cuts(src.mapInArrow(run, "slot long, attr int, v double, y double"), ["slot"], top.task)
    best = cuts.groupBy("slot", "attr").agg(F.min(F.struct(F.round("rel", 9).alias("r"), "cut")).alias("b")).select("slot", "attr", "b.cut").toArrow()
    tried, cut = np.full((len(big), p), -1), np.zeros((len(big), p))
    s, a = best["slot"].to_numpy(), best["attr"].to_numpy()
    tried[s, a], cut[s, a] = a, best["cut"].to_numpy()
    return tried, cut


def fit(rows: DataFrame, n_attributes: int, mode: str = "R", n_trees: int = 10, k: int = 0, nmin: int = 0, seed: int = 0, max_depth: int | None = None, measure: str = "entropy", algorithm: str = "extra", local_rows: int = LOCAL_ROWS, impurity: Callable | None = None) -> DataFrame:
    """The node table from rows (row_id, y, x). algorithm: extra (k random attributes and cuts at a node) or cart (one tree of
    the best cuts). Rows with a null y or a null or NaN attribute teach nothing. impurity: see Task."""
    auto = defaults(mode, n_attributes)
    ship(rows.sparkSession)
    src = rows.select("row_id", F.col("y").cast("double").alias("y"), F.slice("x", 1, n_attributes).cast("array<double>").alias("x"))
    src = materialise(spread(src).filter(f"y IS NOT NULL AND NOT isnan(y) AND size(x) = {n_attributes} AND forall(x, v -> v IS NOT NULL AND NOT isnan(v))"), "trees-rows")
    n, mean = src.agg(F.count("*"), F.avg("y")).first()
    if not n:
        raise ValueError("no rows to learn from")
    classes = tuple(sorted(r["c"] for r in src.select(F.col("y").cast("int").alias("c")).distinct().collect())) if mode == "C" else ()
    exhaustive = algorithm == "cart"
    task = Task(mode, n_attributes, k or auto[0], nmin or auto[1], seed, measure, exhaustive, max_depth, mean if mode == "R" else 0.0, classes, impurity)
    top = Top(task, 1 if exhaustive else n_trees, n)
    _grow_top(src, top, max(local_rows, -(-n * top.n_trees // MOST_OPEN)))
    made = _local_nodes(src, top).unionByName(_top_nodes(src.sparkSession, top))
    return materialise(made, "trees-model")


def _top_nodes(spark: SparkSession, top: Top) -> DataFrame:
    """Inner nodes of the top, and its leaves."""
    number = lambda i: 0 if i < top.n_trees else int(i)
    rows = []
    for i in range(len(top.attr)):
        if top.attr[i] >= 0:
            rows.append((int(top.tree[i]), number(i), int(top.attr[i]), float(top.cut[i]), False, None, None, None, int(top.left[i]), int(top.right[i])))
        elif i in top.sums:
            value, spread, classes = top.task.leaf(top.sums[i])
            rows.append((int(top.tree[i]), number(i), None, None, True, float(value), float(spread), dict(classes) if classes else None, None, None))
    return spark.createDataFrame(rows, NODE)


def _local_nodes(src: DataFrame, top: Top) -> DataFrame:
    """The subtrees of the top's open nodes, each grown by the group that gets its rows."""
    p = top.task.n_attributes
    open_nodes = np.array([top.attr[i] < 0 and i not in top.sums for i in range(len(top.attr))])
    shared = src.sparkSession.sparkContext.broadcast((top, open_nodes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, open_nodes = shared.value
        for b in batches:
            x = _matrix(b.column(2), p)
            for t in range(top.n_trees):
                node = top.route(x, t)
                on = np.flatnonzero(open_nodes[node])
                part = b.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array(node[on]), *[part.column(c) for c in range(3)]], names=["node", "row_id", "y", "x"])

    def subtree(part: pa.Table) -> pa.Table:
        top, _ = shared.value
        part = part.sort_by("row_id")
        i = part["node"][0].as_py()
        first, tree = 0 if i < top.n_trees else i, int(top.tree[i])
        name = lambda place: first if place == 0 else ((i + 1) << 32) + place
        out = []
        for place, attr, cut, sums, left, right in grow(top.task, _matrix(part["x"], p), part["y"].to_numpy(), top.key[i], int(top.depth[i])):
            if sums is None:
                out.append((tree, name(place), attr, cut, False, None, None, None, name(left), name(right)))
            else:
                value, spread, classes = top.task.leaf(sums)
                out.append((tree, name(place), None, None, True, value, spread, classes, None, None))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.map_(pa.int32(), pa.int64()), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in NODE.split(", ")])

    sent = src.mapInArrow(send, f"node long, row_id {src.schema['row_id'].dataType.simpleString()}, y double, x array<double>")
    return sent.groupBy("node").applyInArrow(subtree, NODE)


# Models and votes


def save(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE).parquet(path)


def _ragged(lists: pa.ListArray, p: int) -> np.ndarray:
    """rows x p of lists of any length; what isn't there is NaN."""
    x = np.full((len(lists), p), np.nan)
    width = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row, col = np.repeat(np.arange(len(width)), width), np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
    x[row[col < p], col[col < p]] = flat[col < p]
    return x


def _walk(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """Rows routed through a part of a tree: to a leaf or to the node at which another part begins."""
    nodes = nodes.sort_by("node")
    ids, at = nodes["node"].to_numpy(), rows["node"].to_numpy()
    place = lambda v: np.where((i := np.searchsorted(ids, v)) < len(ids), np.where(ids[np.minimum(i, len(ids) - 1)] == v, i, -1), -1)
    if not len(ids):
        rows = rows.slice(0, 0)
    else:
        rows = rows.filter(pa.array(place(at) >= 0))
    node = rows["node"].to_numpy().copy()
    at, attr = place(node) if len(ids) else node, nodes["attr"].fill_null(-1).to_numpy()
    children, cut = [nodes[c].fill_null(-1).to_numpy() for c in ("left", "right")], nodes["cut"].fill_null(0.0).to_numpy()
    places = [place(c) if len(ids) else c for c in children]
    x = _ragged(rows["x"].combine_chunks(), int(attr.max(initial=-1)) + 1)
    gone, on = np.zeros(len(at), bool), np.flatnonzero(attr[at] >= 0)
    while len(on):
        left = x[on, attr[at[on]]] < cut[at[on]]
        node[on], to = (np.where(left, c[0][at[on]], c[1][at[on]]) for c in (children, places))
        gone[on[to < 0]] = True
        on, to = on[to >= 0], to[to >= 0]
        at[on] = to
        on = on[attr[to] >= 0]
    end = pa.array(at, mask=gone)
    return pa.table({"row_id": rows["row_id"], "x": rows["x"].cast(pa.list_(pa.field("element", pa.float64()))), "tree": rows["tree"], "node": pa.array(node), "leaf": pa.array(~gone), "value": nodes["value"].combine_chunks().take(end), "classes": nodes["classes"].combine_chunks().take(end)})


def apply_trees(rows: DataFrame, model: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(row_id, tree, value, classes): the leaf of each row in each tree, whatever the model's size and depth.

    A group gets the nodes of one subtree as fit has grown it, by its ids, and about local_rows of the rows that come to it; a
    round of groups takes rows through the top of the trees, the next through the subtrees."""
    ship(rows.sparkSession)
    trees = (model.agg(F.max("tree")).first()[0] or 0) + 1
    part = F.shiftright("node", 32).alias("part")
    nodes = model.select("tree", "node", "attr", "cut", "value", "classes", "left", "right", part)
    state = rows.select("row_id", F.col("x").cast("array<double>").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).cast("long").alias("node"))
    kind, found, keys = rows.schema["row_id"].dataType.simpleString(), None, ["tree", "part", "salt"]
    while True:
        state = state.select("*", part)
        sizes = materialise(state.groupBy("tree", "part").agg(F.ceil(F.count("*") / F.lit(local_rows)).alias("n")), "trees-sizes")
        sent = state.join(sizes.hint("merge"), ["tree", "part"]).withColumn("salt", F.pmod(F.xxhash64("row_id"), "n")).drop("n")
        there = nodes.join(sizes.hint("merge"), ["tree", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
        walked = sent.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_walk, f"row_id {kind}, x array<double>, tree int, node long, leaf boolean, value double, classes map<int,bigint>")
        at = materialise(walked, "trees-walk")
        got = at.filter("leaf").select("row_id", "tree", "value", "classes")
        found = got if found is None else found.unionByName(got)
        state = at.filter("NOT leaf").select("row_id", "x", "tree", "node")
        if not state.head(1):
            return found


def combine(votes: DataFrame, mode: str = "R") -> DataFrame:
    """(row_id, value, uncertainty) from the trees' leaves: mean and spread, circular mean and root mean square difference, or the likeliest (of equals the smallest) class and 1 minus its share."""
    if mode == "R":
        return votes.groupBy("row_id").agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("uncertainty"))
    if mode == "P":
        mean = votes.groupBy("row_id").agg(circ_mean(F.col("value")).alias("m"), F.collect_list("value").alias("v"))
        d = F.transform("v", lambda a: F.pow(F.atan2(F.sin(a - F.col("m")), F.cos(a - F.col("m"))), 2))
        return mean.select("row_id", F.col("m").alias("value"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, a: s + a) / F.size("v")).alias("uncertainty"))
    total = F.aggregate(F.map_values("classes"), F.lit(0).cast("long"), lambda s, n: s + n)
    p = votes.select("row_id", F.explode("classes").alias("c", "n"), total.alias("t")).groupBy("row_id", "c").agg(F.sum(F.col("n") / F.col("t")).alias("p"))
    n = votes.groupBy("row_id").agg(F.count("*").alias("trees"))
    # Equal shares differ in their last bits by the order of the sums, so they are compared rounded.
    share = p.join(n, "row_id").withColumn("p", F.col("p") / F.col("trees"))
    best = share.groupBy("row_id").agg(F.max(F.struct(F.round("p", 12).alias("r"), (-F.col("c")).alias("c"), "p")).alias("m"))
    return best.select("row_id", (-F.col("m.c")).cast("double").alias("value"), F.greatest(F.lit(0.0), 1 - F.col("m.p")).alias("uncertainty"))


class Forest:
    """A model as arrays, which route many rows at once."""

    def __init__(self, nodes: pa.Table, mode: str):
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        self.mode, self.leaf = mode, nodes["leaf"].to_numpy(zero_copy_only=False)
        # Nodes are found by bisection in the sorted table: a dictionary of them takes some hundred bytes each.
        starts = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        self.roots = starts.tolist()  # node 0 of each tree
        self.left, self.right = np.full(len(tree), -1), np.full(len(tree), -1)
        for a, b in zip(starts, np.append(starts[1:], len(tree))):
            for c, to in (("left", self.left), ("right", self.right)):
                v = nodes[c].slice(a, b - a)
                there = np.flatnonzero(v.is_valid().to_numpy())
                to[a + there] = a + np.searchsorted(node[a:b], v.fill_null(0).to_numpy()[there])
        self.attr = nodes["attr"].fill_null(-1).to_numpy().astype(np.int64)
        self.cut = nodes["cut"].to_numpy(zero_copy_only=False)
        self.value = nodes["value"].to_numpy(zero_copy_only=False)
        if mode == "C":
            counts = [dict(c or ()) for c in nodes["classes"].to_pylist()]
            self.classes = sorted({c for v in counts for c in v})
            self.share = np.array([[v.get(c, 0) / max(1, sum(v.values())) for c in self.classes] for v in counts]).reshape(len(counts), len(self.classes))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, uncertainty) as combine gives them."""
        ends = [_route(self.attr, self.cut, self.left, self.right, x, np.full(len(x), r)) for r in self.roots]
        if self.mode == "C":
            p = sum(self.share[e] for e in ends) / len(ends)
            best = np.round(p, 12).argmax(axis=1)
            return np.array(self.classes, float)[best], np.maximum(0.0, 1 - p[np.arange(len(x)), best])
        v = np.stack([self.value[e] for e in ends])
        if self.mode == "P":
            m = np.arctan2(np.sin(v).sum(axis=0), np.cos(v).sum(axis=0))
            return m, np.sqrt((np.arctan2(np.sin(v - m), np.cos(v - m)) ** 2).mean(axis=0))
        return v.mean(axis=0), v.std(axis=0)


def predict(rows: DataFrame, model: DataFrame, mode: str = "R", model_nodes: int = MODEL_NODES) -> DataFrame:
    """(row_id, value, uncertainty) for each of rows (row_id, x), which may be a stream. A model of model_nodes nodes at most is
    sent to the tasks as arrays; a larger one goes to groups with the rows, with the same result."""
    if model.count() > model_nodes:
        return combine(apply_trees(rows, model), mode)
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Forest(model.toArrow(), mode))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        p = int(forest.attr.max(initial=-1)) + 1
        for b in batches:
            x = _ragged(b.column(1), p)
            value, deviation = forest.predict(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array(deviation)], names=["row_id", "value", "uncertainty"])

    kind = rows.schema["row_id"].dataType.simpleString()
    rows = rows if rows.isStreaming else spread(rows)
    return rows.select("row_id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"row_id {kind}, value double, uncertainty double")


# The exhaustive split


def _scored_cuts(values: DataFrame, keys: list[str], task: Task) -> DataFrame:
    """(keys, attr, cut, rel, score) of all cuts between distinct values; values: keys, attr, v, y.

    Values are first summed up by (keys, attr, v). The sums lie in ranges of (keys, attr, v); within a range they add up in
    order, and only the ranges' totals meet in one window, so no attribute's values come into one task."""
    y = F.col("y")
    if task.mode == "C":
        sums = [F.sum((y == c).cast("double")) for c in task.classes]
    elif task.mode == "P":
        sums = [F.count("*").cast("double"), F.sum(F.sin(y)), F.sum(F.cos(y))]
    else:
        d = y - F.lit(task.shift)
        sums = [F.count("*").cast("double"), F.sum(d), F.sum(d * d)]
    names = [f"s{k}" for k in range(len(sums))]
    g = values.groupBy(*keys, "attr", "v").agg(*[s.alias(c) for s, c in zip(sums, names)])
    g = materialise(g.repartitionByRange(*keys, "attr", "v").withColumn("part", F.spark_partition_id()), "split-values")
    totals = g.groupBy(*keys, "attr", "part").agg(F.min("v").alias("first"), *[F.sum(c).alias(f"{c}t") for c in names])
    along = Window.partitionBy(*keys, "attr").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "attr", "part", F.lead("first").over(along).alias("next"), *[F.coalesce(F.sum(f"{c}t").over(before), F.lit(0.0)).alias(f"{c}b") for c in names], *[F.sum(f"{c}t").over(Window.partitionBy(*keys, "attr")).alias(f"{c}a") for c in names])
    inside = Window.partitionBy(*keys, "attr", "part").orderBy("v")
    g = g.join(totals, [*keys, "attr", "part"]).withColumns({**{f"{c}l": F.col(f"{c}b") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in names}, "after": F.coalesce(F.lead("v").over(inside), F.col("next"))})
    g = g.filter("after IS NOT NULL")
    left, total = ([F.col(f"{c}{z}") for c in names] for z in "la")
    right = [a - b for a, b in zip(total, left)]
    bad = lambda s: _bad_columns(task, s)
    n = sum(total[1:], total[0]) if task.mode == "C" else total[0]
    both = bad(left) + bad(right)
    mid = F.col("v") + (F.col("after") - F.col("v")) / 2
    return g.select(*keys, "attr", F.when(mid > F.col("v"), mid).otherwise(F.col("after")).alias("cut"), (both / F.greatest(F.lit(1e-300), bad(total))).alias("rel"), (-both / n).alias("score"))


def _bad_columns(task: Task, s: list[Column]) -> Column:
    """Task.bad of Columns."""
    if task.mode == "R":
        return F.greatest(F.lit(0.0), s[2] - s[1] * s[1] / s[0])
    if task.mode == "P":
        return F.greatest(F.lit(0.0), s[0] - F.sqrt(s[1] * s[1] + s[2] * s[2]))
    n = sum(s[1:], s[0])
    if task.measure == "gini":
        return n - sum((c * c for c in s[1:]), s[0] * s[0]) / n
    log = lambda c: F.when(c > 0.5, c * F.log(c)).otherwise(0.0)
    return log(n) - sum((log(c) for c in s[1:]), log(s[0]))


def best_split(rows: DataFrame, n_attributes: int, mode: str = "R", measure: str = "entropy") -> DataFrame:
    """One row, attr, cut and score: the best of all cuts between distinct values of all attributes; ties go to the least
    attribute, then the least cut. rows: y, x. No row comes out if all rows are alike; null and NaN values count for nothing."""
    long = rows.select(F.col("y").cast("double").alias("y"), F.posexplode(F.slice("x", 1, n_attributes)).alias("attr", "v")).filter("y IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    classes = tuple(sorted(r["c"] for r in long.select(F.col("y").cast("int").alias("c")).distinct().collect())) if mode == "C" else ()
    if mode == "C" and not classes:
        classes = (0,)
    shift = (rows.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0) if mode == "R" else 0.0
    cuts = _scored_cuts(long, [], replace(Task(mode, n_attributes, 1, 2), measure=measure, shift=shift, classes=classes))
    best = cuts.select("attr", "cut", F.round("score", 9).alias("score"))
    return best.agg(F.max(F.struct("score", (-F.col("attr")).alias("a"), (-F.col("cut")).alias("c"))).alias("m")).filter("m IS NOT NULL").select((-F.col("m.a")).alias("attr"), (-F.col("m.c")).alias("cut"), "m.score")
