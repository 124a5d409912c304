"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node. Nodes are dealt to shards of a bounded size by a hash of the
vector; each shard's graph is built in one task and kept as one row of flat arrays. Query
vectors go in blocks of a bounded size to the tasks that hold the graphs, each of which searches its shards
one by one and merges what they give; the tasks' nearest are merged by exact distance. So no
pair of a shard and a block is ever written.
"""

from __future__ import annotations

import functools
import heapq
import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

#: Vectors of a shard, on average; the unit of one task.
SHARD_ROWS = 5_000
#: Components of the query vectors of a block, which is broadcast: 64 MB.
BLOCK_VALUES = 8_000_000
#: Links of a node (twice as many on the ground level), beams of building and searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 12, 64, 96


class Graph:
    """An HNSW graph over the rows of vectors; neighbours[l] is a flat int32 array of
    rows x links, -1 where there is no link."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray] | None = None, entry: int = -1):
        self.x = vectors.astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.levels = neighbours or []
        self.entry = entry

    def _far(self, q, rows):
        return self.norm[rows] - 2 * (self.x[rows] @ q)

    def _beam(self, q, starts, width, level):
        """The width nearest nodes found from starts: (distance, node), nearest first."""
        links, seen = self.levels[level], np.zeros(len(self.x), bool)
        starts = np.asarray(starts)
        seen[starts] = True
        todo = [(float(d), int(s)) for d, s in zip(self._far(q, starts), starts, strict=True)]
        best = [(-d, s) for d, s in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            near = links[node]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for e, s in zip(self._far(q, near).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, s))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, s))
                else:
                    continue
                heapq.heappush(todo, (e, s))
        return sorted((-d, s) for d, s in best)

    def _choose(self, q, nodes, most):
        """Up to most of the nodes, nearest to q first, each nearer to q than to those
        chosen before; the rest fills up."""
        nodes = np.asarray(nodes)
        far = self._far(q, nodes) + float(q @ q)
        nodes, far = nodes[order := np.argsort(far, kind="stable")], far[order]
        if len(nodes) <= most:
            return nodes
        rows = self.x[nodes]
        between = self.norm[nodes][:, None] + self.norm[nodes][None, :] - 2 * (rows @ rows.T)
        nearest, picked, rest = np.full(len(nodes), np.inf), [], []
        for i in range(len(nodes)):
            if far[i] < nearest[i]:
                picked.append(i)
                np.minimum(nearest, between[i], out=nearest)
                if len(picked) == most:
                    break
            else:
                rest.append(i)
        return nodes[(picked + rest)[:most]]

    def _link(self, a, b, level):
        own = self.levels[level][a]
        free = np.flatnonzero(own < 0)
        if len(free):
            own[free[0]] = b
        else:
            keep = self._choose(self.x[a], np.append(own, b), len(own))
            own[: len(keep)] = keep

    def build(self, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1) -> Graph:
        n = len(self.x)
        height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(int)
        self.levels = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(height.max(initial=0)) + 1)]
        self.entry, top = 0 if n else -1, int(height[0]) if n else 0
        for i in range(1, n):
            q, at = self.x[i], [self.entry]
            for level in range(top, -1, -1):
                if level > height[i]:
                    at = [self._beam(q, at, 1, level)[0][1]]
                    continue
                found = [s for _, s in self._beam(q, at, beam, level)]
                mine = self._choose(q, found, links)
                self.levels[level][i, : len(mine)] = mine
                for s in mine.tolist():
                    self._link(s, i, level)
                at = found
            if height[i] > top:
                self.entry, top = i, int(height[i])
        return self

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> list[int]:
        if self.entry < 0:
            return []
        q, at = q.astype(np.float32), [self.entry]
        top = max(lv for lv in range(len(self.levels)) if lv == 0 or (self.levels[lv][self.entry] >= 0).any())
        for level in range(top, 0, -1):
            at = [self._beam(q, at, 1, level)[0][1]]
        return [s for _, s in self._beam(q, at, max(beam, k), 0)[:k]]


GRAPH = "shard int, dim int, entry int, height int, vectors binary, links binary, ids binary, bounds binary"


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: rows (vec_id, v) with equal vectors up to the wanted number of ids."""
    shard, dim = int(key[0]), int(key[1])
    pdf = pdf.sort_values("vec_id", kind="stable")
    rows = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim) + 0.0
    vectors, inverse = np.unique(rows, axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    ids = pdf["vec_id"].to_numpy(np.int64)[order]
    bounds = np.searchsorted(inverse.ravel()[order], np.arange(len(vectors) + 1))
    mixed = np.random.default_rng(0).permutation(len(vectors))  # not sorted by a component
    vectors, spans = vectors[mixed], [ids[bounds[i] : bounds[i + 1]] for i in mixed]
    graph = Graph(vectors).build()
    return pd.DataFrame(
        {
            "shard": [shard], "dim": [dim], "entry": [graph.entry], "height": [len(graph.levels)], "vectors": [vectors.tobytes()],
            "links": [b"".join(level.tobytes() for level in graph.levels)], "ids": [np.concatenate(spans).tobytes()],
            "bounds": [np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int64).tobytes()],
        }
    )


def _load(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    links, n, levels, at = np.frombuffer(row["links"], np.int32), len(vectors), [], 0
    for level in range(row["height"]):
        wide = n * LINKS * (2 if level == 0 else 1)
        levels.append(links[at : at + wide].reshape(n, -1))
        at += wide
    return Graph(vectors, levels, row["entry"]), vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64)


@lean
def _search(batches, k, block):
    """The k + 1 nearest ids of each query over all shards of a task. block: by length of the
    vectors, keys and queries."""
    best: dict[int, list[tuple[float, int]]] = {}
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(c)[at].as_py() for c, name in enumerate(batch.schema.names)}
            if row["dim"] not in block.value:
                continue
            graph, vectors, ids, bounds = _load(row)
            for key, q in zip(*block.value[row["dim"]], strict=True):
                nodes = np.array(graph.search(q, k + 1), np.int64)
                far = np.sqrt(((vectors[nodes] - q) ** 2).sum(axis=1)).tolist()
                own = ((d, i) for d, s in zip(far, nodes.tolist(), strict=True) for i in ids[bounds[s] : bounds[s + 1]].tolist())
                best[int(key)] = heapq.nsmallest(k + 1, [*best.get(int(key), ()), *own])
    rows = [(key, i, d) for key, found in best.items() for d, i in found]
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["key", "vec_id", "score"])


@lean
def _packed(batches):
    """Rows (dim, key, v) of one length as (dim, keys, queries), one row for each batch and length."""
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            values = own.column(2).flatten().to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([own.column(1).to_numpy().tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dim", "keys", "queries"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: rows whose vector is not null or empty, has only finite components and is
    not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, query_ids, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which the column query_ids
    (of vec_id) holds, its k nearest other rows found, by Euclidean distance in double
    precision, ties to the smaller id; fewer if there are fewer.

    Rows with a null id or an unusable vector take no part. Vectors of another length are
    not neighbours. Copies of a vector are one node that keeps its k + 1 smallest ids, which
    is all that any answer can hold. An id that repeats counts once, with the least of its
    vectors."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    # The ids beyond k + 1 of equal vectors go before the shuffle.
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    nodes = first.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    graphs = staged(nodes.groupBy("shard", "dim").applyInPandas(_build, GRAPH))

    asked = rows.where(query_ids)
    keys = staged(asked.groupBy("v").agg(F.min("vec_id").alias("key")).select(F.size("v").alias("dim"), "key", "v"))
    blocks = max(1, math.ceil((keys.agg(F.sum("dim")).first()[0] or 0) / BLOCK_VALUES))
    found = []
    for block in range(blocks):
        own: dict[int, list] = {}
        for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).mapInArrow(_packed, "dim int, keys binary, queries binary").toLocalIterator():
            part = own.setdefault(r.dim, [[], []])
            part[0].append(np.frombuffer(r.keys, np.int64))
            part[1].append(np.frombuffer(r.queries, np.float64).reshape(-1, r.dim))
        shared = spark.sparkContext.broadcast({dim: (np.concatenate(a), np.concatenate(b)) for dim, (a, b) in own.items()})
        found.append(staged(graphs.select("dim", "entry", "height", "vectors", "links", "ids", "bounds").mapInArrow(partial(_search, k=k, block=shared), "key long, vec_id long, score double")))
        shared.destroy()
    best = functools.reduce(DataFrame.union, found)
    best = staged(best.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r"))
    answers = asked.join(keys.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key").join(best, "key").where("query_id <> vec_id")
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
