"""Vector search: exact, scoped, approximate by cells; reranking for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.operators.lookup import first_per

#: Query vectors that are compared with a batch of rows at once; more are taken in blocks of this size.
BLOCK = 4096


def knn(rows: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """(query_id, vec_id, distance): the `k` nearest rows (vec_id, embedding) of each query by squared L2 distance.

    The queries (query_id, embedding) are a stated set: they go to the tasks in blocks, each task keeps its own `k`
    best for each query over all its rows, and only those are shuffled. With `scope`, a column of both
    sides, only rows of the query's scope count. Distances are rounded to 6 digits before ties go to the smaller id.
    """
    cols = ["query_id", "embedding", *([scope] if scope else [])]
    block: list = []
    out: DataFrame | None = None

    def add(part: list) -> None:
        nonlocal out
        one = _pass(rows, part, k, scope)
        out = one if out is None else out.unionByName(one)

    for row in queries.where("embedding is not null").select(*cols).toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block or out is None:
        add(block)
    return first_per(out, ["query_id"], ["distance", "vec_id"], k, "rank").select("query_id", "vec_id", "distance", "rank")


class _Best:
    """The `k` nearest rows of each query that a task has seen so far; of equal distances the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.square = (queries**2).sum(1)
        self.near: list[list[tuple[float, int]]] = [[] for _ in queries]
        self.bound = np.full(len(queries), np.inf)

    def add(self, x: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Takes rows in; `allowed` says which query may have which row."""
        square = (x**2).sum(1)
        for lo in range(0, len(x), 1024):
            part = slice(lo, lo + 1024)
            # A first estimate finds the rows that may count; their distance is then taken as defined.
            d = self.square[:, None] + square[part] - 2 * self.q @ x[part].T
            may = d <= (self.bound + 1e-5 * (1 + self.square))[:, None] + 1e-5 * square[part]
            if allowed is not None:
                may &= allowed[:, part]
            for i in np.flatnonzero(may.any(1)):
                at = lo + np.flatnonzero(may[i])
                if len(at) > 4 * self.k:  # the k nearest by the estimate, and all within its error of the last of them
                    own = d[i][at - lo]
                    last = np.partition(own, self.k - 1)[self.k - 1]
                    at = at[own <= last + 2e-5 * (1 + self.square[i] + square[at].max())]
                exact = np.round(((x[at] - self.q[i]) ** 2).sum(1), 6)
                self.near[i] = sorted([*self.near[i], *zip(exact.tolist(), ids[at].tolist(), strict=True)])[: self.k]
                if len(self.near[i]) == self.k:
                    self.bound[i] = self.near[i][-1][0]


def _pass(rows: DataFrame, block: list, k: int, scope: str | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        if not part:
            return
        best = _Best(np.array([x[1] for x in part], np.float64), k)
        for batch in batches:
            if batch.num_rows:
                allowed = np.array([p[2] for p in part], object)[:, None] == np.array(batch.column(2).to_pylist(), object)[None, :] if scope else None
                best.add(np.array(batch.column(1).to_pylist(), np.float64), batch.column(0).to_numpy(zero_copy_only=False), allowed)
        found = [(p[0], i, d) for p, near in zip(part, best.near, strict=True) for d, i in near]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "distance"])

    picked = rows.where("embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding", *([scope] if scope else []))
    return picked.mapInArrow(run, "query_id bigint, vec_id bigint, distance double")


def cells(rows: DataFrame, n: int, sample: int = 20_000, seed: int = 1, steps: int = 10) -> np.ndarray:
    """Centres of `n` cells, by k-means on at most `sample` rows, the first by a hash of their id, on the driver."""
    drawn = rows.where("embedding is not null").select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample)
    x = np.array([r.embedding for r in drawn.collect()], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(n, len(x)), replace=False))]
    for _ in range(steps):
        nearest = _nearest(x, centres, 1)[:, 0]
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def with_cells(rows: DataFrame, centres: np.ndarray, name: str = "cell") -> DataFrame:
    """(vec_id, embedding) with `cell`, the nearest centre: the index of knn_in_cells, to be written partitioned by it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64)
            own = _nearest(x, shared.value, 1)[:, 0] if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32())], names=["vec_id", "embedding", name])

    kind = dict(rows.dtypes)["embedding"]
    return rows.where("embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, f"vec_id bigint, embedding {kind}, {name} int")


def knn_in_cells(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate neighbours: of the rows (vec_id, embedding, cell) those in the `probes` cells nearest to each query.

    Every row is indexed. The queries go to the tasks in blocks, as in `knn`; a task compares a row only with the
    queries that probe its cell, and keeps each query's `k` best, so that a large cell is spread as the rows are.
    """
    out, block = None, []

    def add(part: list) -> None:
        nonlocal out
        one = _probe(indexed, part, centres, k, probes)
        out = one if out is None else out.unionByName(one)

    for row in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        block.append(tuple(row))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block or out is None:
        add(block)
    return first_per(out, ["query_id"], ["distance", "vec_id"], k, "rank").select("query_id", "vec_id", "distance", "rank")


def _probe(indexed: DataFrame, block: list, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    q = np.array([x[1] for x in block], np.float64) if block else np.zeros((0, centres.shape[1] if centres.ndim == 2 else 0))
    asked: dict[int, list[int]] = {}
    for i, own in enumerate(_nearest(q, centres, probes) if len(q) and len(centres) else []):
        for c in own.tolist():
            asked.setdefault(c, []).append(i)
    shared = indexed.sparkSession.sparkContext.broadcast((block, q, {c: np.array(v) for c, v in asked.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, by_cell = shared.value
        best: dict[int, _Best] = {}
        for batch in batches:
            cell = batch.column(2).to_numpy()
            for c in np.unique(cell):
                if int(c) in by_cell:
                    at = np.flatnonzero(cell == c)
                    few = batch.take(pa.array(at))
                    best.setdefault(int(c), _Best(own[by_cell[int(c)]], k)).add(np.array(few.column(1).to_pylist(), np.float64), few.column(0).to_numpy())
        found = [(part[i][0], v, d) for c, b in best.items() for i, near in zip(by_cell[c].tolist(), b.near, strict=True) for d, v in near]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "distance"])

    return indexed.select("vec_id", "embedding", "cell").mapInArrow(run, "query_id bigint, vec_id bigint, distance double")


def diverse(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, vec_id, place): maximal marginal relevance over few candidates of each query.

    candidates: (query_id, vec_id, query, embedding). The next is the one with the highest weight * cosine to the query
    less (1 - weight) * the highest cosine to a chosen one; of equals the smaller id. This is sequential within a
    query, and a query has the bounded number of candidates that a search has left.
    """

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        x = np.array(part["embedding"].tolist(), np.float64)
        q = np.array(part["query"].iloc[0], np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        to_query = x @ (q / max(np.linalg.norm(q), 1e-12))
        near, chosen = np.full(len(x), -np.inf), []
        for _ in range(min(k, len(x))):
            score = weight * to_query - (1 - weight) * np.where(np.isinf(near), 0, near)
            score[chosen] = -np.inf
            best = int(np.argmax(np.round(score, 9)))
            chosen.append(best)
            near = np.maximum(near, x @ x[best])
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "vec_id": part["vec_id"].iloc[chosen].to_numpy(), "place": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id bigint, vec_id bigint, place int")
