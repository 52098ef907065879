"""Nearest neighbours by stable projections under a kd-tree, with a chi-square stopping test.

Unit vectors are projected to ``M`` dimensions by a Gaussian matrix. The squared projected distance of two vectors, over
their squared distance, follows a chi-square law with M degrees of freedom. A query takes neighbours in order of projected
distance from the leaves of a kd-tree, verifies them on the original vectors, and stops when the test holds: a vector as
near as the k-th found so far would, with probability ``CERTAIN``, already have come up. Where neighbours stand out little,
a test with few dimensions stops late; with 24 it stops about halfway even among unstructured vectors.

The upper levels of the tree, fitted on a bounded sample of the projections, deal all rows into cells, each indexed by
its own subtree. A query first searches its own cell, and the distance found there bounds which other cells can hold
anything within the test's radius. Equal vectors are indexed once with their smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written

M, CERTAIN, SEED = 24, 0.93, 20
#: Rows that the upper tree is fitted on at most; rows per cell aimed at; cells, rows of a subtree and its queries at most.
SAMPLE, CELL, CELLS, SHARD, BLOCK = 20_000, 4096, 4096, 16_384, 4096
LEAF, STEP = 64, 32
#: Cosines that differ by less are compared exactly, row by row.
TIE = 1e-12


def chi_square(x: float, m: int = M) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def radius(certain: float = CERTAIN, m: int = M) -> float:
    """The squared projected distance, per squared distance, at which the stopping test holds."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, m) < certain:
        hi *= 2
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if chi_square((lo + hi) / 2, m) >= certain else ((lo + hi) / 2, hi)
    return hi


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED + dim).normal(size=(dim, m))


def split(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Planes of a kd-tree of so many levels, in heap order: widest dimension, median."""
    planes, at = [], [np.arange(len(points))]
    for _ in range(levels):
        deeper = []
        for own in at:
            p = points[own]
            d = int(np.argmax(p.max(0) - p.min(0))) if len(own) else 0
            v = float(np.median(p[:, d])) if len(own) else 0.0
            planes.append((d, v))
            deeper += [own[p[:, d] < v], own[p[:, d] >= v]] if len(own) else [own, own]
        at = deeper
    return planes


def cell_of(points: np.ndarray, planes: list[tuple[int, float]], levels: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if not planes:
        return node
    dims, cuts = np.array([p[0] for p in planes]), np.array([p[1] for p in planes])
    for _ in range(levels):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= cuts[node])
    return node - (2**levels - 1)


class Subtree:
    """Leaves of at most LEAF rows by widest-dimension medians, as contiguous runs with boxes."""

    def __init__(self, points: np.ndarray):
        order, self.starts = [], [0]
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                order.append(own)
                self.starts.append(self.starts[-1] + len(own))
                continue
            p = points[own]
            by = own[np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")]
            todo += [by[len(by) // 2 :], by[: len(by) // 2]]
        self.order = np.concatenate(order)
        self.points = points[self.order]
        self.low = np.array([self.points[a:z].min(0) for a, z in zip(self.starts, self.starts[1:], strict=False)])
        self.high = np.array([self.points[a:z].max(0) for a, z in zip(self.starts, self.starts[1:], strict=False)])

    def nearest(self, query: np.ndarray, verify, k: int, known: float, factor: float) -> tuple[np.ndarray, float | None]:
        """Rows among which the ``k`` of largest cosine are (``verify`` gives cosines), and the k-th's distance if there are k.

        Leaves are opened by the distance of their boxes, a few at a time; rows nearer than any leaf still closed are verified
        in projected order. Rows within ``TIE`` of the k-th all come back. ``known``: a distance that k vectors are within.
        """
        gap = np.maximum(0, np.maximum(self.low - query, query - self.high))
        gap = (gap * gap).sum(1)
        leaves = np.argsort(gap, kind="stable")
        found, rows = np.empty(0), np.empty(0, np.int64)
        far, waiting = np.empty(0), np.empty(0, np.int64)  # of opened leaves, not verified yet
        at, wide, step, worst = 0, 4, STEP, known
        while at < len(leaves) and gap[leaves[at]] <= _reach(worst, factor):
            own = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in leaves[at : at + wide]])
            apart = self.points[own] - query
            far, waiting = np.concatenate([far, (apart * apart).sum(1)]), np.concatenate([waiting, own])
            at, wide = at + wide, 2 * wide
            border = gap[leaves[at]] if at < len(leaves) else math.inf
            ready = far <= border
            order = np.argsort(far[ready], kind="stable")
            near, next_, done = far[ready][order], self.order[waiting[ready][order]], 0
            far, waiting = far[~ready], waiting[~ready]
            while done < len(near):
                stop = min(done + step, int(np.searchsorted(near, _reach(worst, factor), "right")))
                if stop <= done:
                    break  # the test holds for all that is left
                found, rows = np.concatenate([found, verify(next_[done:stop])]), np.concatenate([rows, next_[done:stop]])
                if len(found) >= k:
                    kth = np.partition(found, -k)[-k]
                    keep = found >= kth - TIE
                    found, rows = found[keep], rows[keep]
                    worst = min(worst, math.sqrt(max(0.0, 2 - 2 * kth)))
                done, step = stop, min(2 * step, 256)
            if done < len(near):
                break
        last = math.sqrt(max(0.0, 2 - 2 * float(np.partition(found, -k)[-k]))) if len(found) >= k else None
        return rows, last


def _reach(distance: float, factor: float) -> float:
    """The squared projected distance beyond which the test holds for vectors within ``distance``."""
    return math.inf if distance == math.inf else distance * distance * factor * (1 + 1e-9) + 1e-12


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite numbers, not all zero."""
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.where("vec_id is not null and v is not null and forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def search(rows: DataFrame, every: int = 50, k: int = 5, certain: float = CERTAIN, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, its k nearest by cosine.

    Rows with a null id, or a vector that is null, empty, zero or holds a null or non-finite number, take no part; vectors
    are compared with those of equal length. Equal vectors tie and go by id; rows of the query's own id are not its
    neighbours; an empty table gives an empty result. Fewer than k candidates: all of them.
    """
    spark = rows.sparkSession
    ship(spark)
    factor = radius(certain)
    full = valid(rows, id_col, vec_col)
    first = full.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = full.where(F.col("vec_id") % every == 0).select("v", F.lit(True).alias("asked")).distinct()
    index = index.join(asked, "v", "left").withColumn("key", F.expr("ids[0]")).withColumn("dim", F.size("v"))

    def project(batches):
        for b in batches:
            vs = b.column("v").to_pylist()
            out = []
            for v in vs:
                x = np.array(v)
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(x @ x)) @ _matrix(len(v)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tolist() for p in out], pa.list_(pa.float64()))], [*b.schema.names, "p"])

    index = written(index.mapInArrow(project, "v array<double>, ids array<long>, asked boolean, key long, dim int, p array<double>"), "projected")
    dims = index.groupBy("dim").count()
    out = None
    for d in dims.orderBy("dim").collect():  # the lengths of vectors that a table holds: in practice one
        part = _search_one(index.where(F.col("dim") == d["dim"]), d["count"], k, factor)
        out = part if out is None else out.union(part)
    schema = "query_id long, rank int, vec_id long, score double"
    if out is None:
        return spark.createDataFrame([], schema)
    # Back from vectors to rows: each asked row takes its vector's list without itself.
    rows_asked = full.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    keyed = rows_asked.join(index.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key")
    lists = keyed.join(out, "key")
    each = lists.select("query_id", F.explode(F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})")).alias("x"), F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})").alias("all"))
    return each.select("query_id", F.expr("cast(array_position(all, x) AS int)").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors whose squares would overflow or vanish, divided by their largest component; a cosine doesn't change by that."""
    most = np.abs(v).max(axis=1, keepdims=True)
    return np.where((most > 1e100) | (most < 1e-100), v / most, v)


_MATRICES: dict[int, np.ndarray] = {}


def _matrix(dim: int) -> np.ndarray:
    if dim not in _MATRICES:
        _MATRICES[dim] = projection(dim)
    return _MATRICES[dim]


def _search_one(index: DataFrame, n: int, k: int, factor: float) -> DataFrame:
    """``key, found``: for each asked vector, the k + 1 or more nearest (score, vec_id), its own vector included."""
    levels = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, n / CELL)))))
    sample = index.select("p", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE).select("p").collect()
    planes = split(np.array([r.p for r in sample]).reshape(-1, M), levels)

    def place(batches):
        for b in batches:
            p = np.array(b.column("p").to_pylist(), np.float64).reshape(-1, M)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(p, planes, levels))], [*b.schema.names, "cell"])

    placed = index.mapInArrow(place, "v array<double>, ids array<long>, asked boolean, key long, dim int, p array<double>, cell long")
    placed = written(placed, "cells")
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[j]).alias(f"{name}{j}") for j in range(M) for name, f in (("lo", F.min), ("hi", F.max))]).orderBy("cell").collect()  # CELLS rows at most
    shards = {r.cell: -(-r.n // SHARD) for r in boxes}
    cells = np.array([r.cell for r in boxes])
    low, high = (np.array([[r[f"{name}{j}"] for j in range(M)] for r in boxes]) for name in ("lo", "hi"))
    queries = written(placed.where("asked").select("key", "v", "p", "cell"), "queries")
    sizes = placed.sparkSession.createDataFrame([(int(c), int(n)) for c, n in shards.items()], "cell long, shards int")  # CELLS rows at most

    def ask(some: DataFrame) -> DataFrame:
        """some: key, v, p, known, cell. A cell is read once for every BLOCK of its own queries, and not at all without one."""
        blocks = written(some.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(sizes, "cell"), "blocks")
        base = placed.select("cell", "v", "ids", "p", "key").join(F.broadcast(blocks), "cell")  # CELLS rows at most
        base = base.withColumn("shard", F.pmod(F.hash("key"), F.col("shards"))).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        asked = some.join(F.broadcast(blocks), "cell").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("key", "v", "p", "known", "cell", "shard", "block")
        base = base.select("cell", "v", "ids", "p", "key", "shard", "block")
        return asked.groupBy("cell", "shard", "block").cogroup(base.groupBy("cell", "shard", "block")).applyInPandas(answer, "key long, score double, vec_id long, kth double")

    def answer(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"key": [], "score": [], "vec_id": [], "kth": []})
        tree = Subtree(np.stack(b["p"].to_numpy()))
        v = _scaled(np.stack(b["v"].to_numpy()))
        norm = np.sqrt((v * v).sum(1))
        unit = v / norm[:, None]
        ids = b["ids"].to_numpy()
        out = []
        for key, x, p, known in zip(q["key"], q["v"], q["p"], q["known"], strict=True):
            x = _scaled(np.asarray(x, np.float64)[None, :])[0]
            size = math.sqrt(float(x @ x))
            u = x / size

            got, kth = tree.nearest(np.asarray(p), lambda r, u=u: unit[r] @ u, k + 1, known, factor)
            pairs = sorted((-float(v[r] @ x / (norm[r] * size)), int(i)) for r in got for i in ids[r])[: k + 1]
            out += [(key, -s, i, kth) for s, i in pairs]
        return pd.DataFrame(out, columns=["key", "score", "vec_id", "kth"])

    home = written(ask(queries.withColumn("known", F.lit(float("inf")))), "home")
    bound = home.groupBy("key").agg(F.min("kth").alias("kth"))

    def route(batches):
        for b in batches:
            p = np.array(b.column("p").to_pylist(), np.float64).reshape(-1, M)
            own = b.column("cell").to_numpy(zero_copy_only=False)
            far = np.array([math.inf if x is None else x for x in b.column("kth").to_pylist()])
            rows_, to = [], []
            for i in range(len(p)):
                gap = np.maximum(0, np.maximum(low - p[i], p[i] - high))
                hit = cells[((gap * gap).sum(1) <= far[i] * far[i] * factor * (1 + 1e-9) + 1e-12) & (cells != own[i])]
                rows_ += [i] * len(hit)
                to += hit.tolist()
            at = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("v").take(at), b.column("p").take(at), pa.array(far[rows_] if rows_ else [], pa.float64()), pa.array(to, pa.int64())], ["key", "v", "p", "known", "cell"])

    onward = queries.join(bound, "key", "left").select("key", "v", "p", "cell", "kth").mapInArrow(route, "key long, v array<double>, p array<double>, known double, cell long")
    more = ask(written(onward, "onward"))
    all_ = home.union(more).select("key", F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")).alias("x")).distinct()
    top = all_.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("x.s", "x.i"))).where(F.col("r") <= k + 1)
    return top.groupBy("key").agg(F.expr("transform(sort_array(collect_list(x)), y -> named_struct('score', -y.s, 'vec_id', y.i))").alias("found"))
