"""Approximate nearest neighbours: learned partitions of a neighbour graph, a routing classifier, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import stage
from tidewatch.llm.vectors import matrix, one_row_per_id, usable, usual_length


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, in blocks."""
    x = x.astype(np.float32)
    sq, out = (x * x).sum(1), np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        d = sq[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Cut the graph into parts of nearly equal size with few edges between them.

    Starts from cells around random rows, filled in order of distance up to the room of a cell, then moves nodes to the
    part that holds most of their neighbours while it has room.
    """
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(slack * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        label, size = np.full(n, -1), np.zeros(parts, np.int64)
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        choice = np.argsort(d, 1)
        for i in np.argsort(d.min(1) - d.mean(1)):
            for c in choice[i]:
                if size[c] < room:
                    label[i], size[c] = c, size[c] + 1
                    break
        centres = np.stack([x[label == c].mean(0) if size[c] else centres[c] for c in range(parts)])
    both = np.concatenate((np.stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel()), 1), np.stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])), 1)))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both[:, 0], label[both[:, 1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network with one hidden layer from a vector to the probabilities of the partitions."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._norm(x)
        dims = (x.shape[1], hidden, target.shape[1])
        self.w = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(dims, dims[1:], strict=False)]
        self.b = [np.zeros(b) for b in dims[1:]]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        step = 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-4
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                h = np.maximum(z[rows] @ self.w[0] + self.b[0], 0)
                p = self._softmax(h @ self.w[1] + self.b[1])
                g2 = (p - target[rows]) / len(rows)
                g1 = (g2 @ self.w[1].T) * (h > 0)
                grads = (z[rows].T @ g1, h.T @ g2, g1.sum(0), g2.sum(0))
                step += 1
                for p_, g, s in zip((*self.w, *self.b), grads, state, strict=True):
                    s[0] = 0.9 * s[0] + 0.1 * g
                    s[1] = 0.999 * s[1] + 0.001 * g * g
                    p_ -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) / self.scale

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._norm(x) @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1])


def fit_router(sample: np.ndarray, parts: int, neighbours: int = 10, recall: float = 0.95) -> tuple[Router, int]:
    """A router and the number of partitions to search so that `recall` of the sample's own neighbour edges are found."""
    graph = neighbour_graph(sample, neighbours)
    label = balanced_partition(sample, graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.arange(len(sample)), label), 1)
    if graph.shape[1]:
        np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph.ravel()]), 1)
    router = Router(sample, target / target.sum(1, keepdims=True))
    p = router.probabilities(sample)
    place = np.argsort(np.argsort(-p, 1, kind="stable"), 1, kind="stable")
    home = p.argmax(1)
    ranks = np.sort(place[np.repeat(np.arange(len(sample)), graph.shape[1]), home[graph.ravel()]]) if graph.size else np.zeros(1, np.int64)
    return router, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def _nearest(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of each query, ties to the smaller id; distances from the differences themselves."""
    sq, out = (rows * rows).sum(1), []
    for i in range(0, len(queries), 256):
        q = queries[i : i + 256]
        about = np.maximum(sq[None, :] + (q * q).sum(1)[:, None] - 2 * q @ rows.T, 0)
        about[names[i : i + 256][:, None] == ids[None, :]] = np.inf
        edge = np.partition(about, min(k, about.shape[1]) - 1, axis=1)[:, min(k, about.shape[1]) - 1]
        for j, vec in enumerate(q):
            slack = 1e-9 * (1 + sq.max() + float(vec @ vec))
            near = np.flatnonzero((about[j] <= edge[j] + slack) & np.isfinite(about[j]))
            diff = rows[near] - vec
            exact = np.sqrt((diff * diff).sum(1))
            best = np.lexsort((ids[near], exact))[:k]
            out += [(int(names[i + j]), int(ids[near[b]]), float(exact[b])) for b in best]
    return out


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, part_rows: int = 100_000, sample_rows: int = 8192, recall: float = 0.96, rows_per_task: int = 8192, queries_per_task: int = 2048) -> DataFrame:
    """The k nearest other vectors of each query by Euclidean distance: (query_id, rank, vec_id, score), rank from 1.

    A sample of about `sample_rows` vectors (documented bound, drawn by hash of the id) gives a neighbour graph, cut into `parts` balanced
    partitions, or more of about `part_rows` vectors where the table is large (one for 64 sampled vectors at most); a small network learns which partitions hold a vector's neighbours. Every vector is indexed in its most probable
    partition; a query (rows where `is_query`, a condition on vec_id) searches its most probable ones, as many as find
    `recall` of the sample's own edges, or more until these hold k candidates. A partition larger than `rows_per_task` is
    dealt over several tasks, and so are many queries to one partition; each task returns k rows a query, reranked exactly.

    Null vectors, zero vectors, ones with null or non-finite components, of another than the usual length or with a null id take
    no part. Of rows repeating an id the greatest vector counts. Extra columns are ignored.
    """
    rows = one_row_per_id(vectors, id_col, vector_col)
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dim = usual_length(good)
    spark = vectors.sparkSession
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = stage(good.where(F.size("v") == dim), "vectors")
    total = good.count()
    drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 60)) < (sample_rows << 60) // total) if total > sample_rows else good
    sample = drawn.toPandas().sort_values("vec_id")
    x = np.stack(sample["v"].to_list())
    router, probes = fit_router(x, max(1, min(max(parts, total // part_rows), len(x) // 64)), min(k, len(x) - 1), recall)
    shared = spark.sparkContext.broadcast(router)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = shared.value.probabilities(matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.argmax(1))], names=[*b.schema.names, "part"])

    index = stage(good.mapInArrow(home, "vec_id long, v array<double>, part long"), "ann-index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(-shared.value.probabilities(matrix(b.column("v"))), 1, kind="stable")
                held = np.cumsum(np.array([sizes.get(j, 0) for j in range(order.shape[1])])[order], 1)
                want = np.maximum(probes, (held < k + 1).sum(1) + 1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array([list(map(int, o[:n])) for o, n in zip(order, want, strict=True)], pa.list_(pa.int64()))], names=["query_id", "q", "parts"])

    asked = good.where(is_query).mapInArrow(route, "query_id long, q array<double>, parts array<long>")
    asked = stage(asked.select("query_id", "q", F.explode("parts").alias("part")), "ann-queries")
    wanted = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    deal = lambda counts, each: F.coalesce(F.create_map(*(F.lit(v) for p in counts for v in (int(p), max(1, -(-counts[p] // each)))))[F.col("part")], F.lit(1))
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    row_deals, query_deals = deal(sizes, rows_per_task), deal(wanted, queries_per_task)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = asked.withColumn("b", F.pmod(F.xxhash64("query_id"), query_deals)).withColumn("a", spread(row_deals)).select("query_id", "q", "part", "a", "b")
    right = index.withColumn("a", F.pmod(F.xxhash64("vec_id"), row_deals)).withColumn("b", spread(query_deals)).select("vec_id", "v", "part", "a", "b")

    def rerank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            out = _nearest(np.stack(queries["q"].to_list()), queries["query_id"].to_numpy(np.int64), np.stack(rows["v"].to_list()), rows["vec_id"].to_numpy(np.int64), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("part", "a", "b").cogroup(right.groupBy("part", "a", "b")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
