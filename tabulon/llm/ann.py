"""Approximate nearest neighbours by cosine: one navigable small-world graph per shard.

Vectors are dealt to shards by their hash. Each shard builds a hierarchical navigable small-world
graph, stored as flat neighbour arrays in a table. Queries visit every shard in blocks: a shard's
graph is loaded once for a block and the queries stream past it; the shards' nearest are merged.
What is returned is scored exactly, in double precision, on the original vectors.

Equal vectors are one node, which lists the smallest ids it stands for, as many as a result could
need, so very many copies neither clog a graph nor hide each other. Null, zero and empty vectors,
and such with null or non-finite components, take no part; vectors are compared with those of
their own length; a row that repeats a query's id is not its candidate; an id that repeats with
other vectors counts with its nearest one. Without vectors or queries the result is empty. Columns
other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, released

#: Links of a node (twice that in the lowest layer), breadth while building and searching.
M, EF_BUILD, EF_SEARCH = 16, 80, 128
#: Shards at least, rows of a shard and queries of a block, about.
SHARDS, SHARD_ROWS, BLOCK_QUERIES = 12, 50_000, 100_000
#: Nodes of one row of the stored graph.
PART = 2048


class Graph:
    """Links of unit vectors x[node]; base[node, 2 * m] and upper[row, m] are flat neighbour arrays, -1 where empty."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, base: np.ndarray, upper: np.ndarray):
        self.x, self.levels, self.base, self.upper = x, levels, base, upper
        self.first = np.cumsum(levels, dtype=np.int64) - levels  # a node's row of upper for layer 1
        self.seen, self.stamp = np.zeros(len(x), np.int32), 0
        self.entry = int(np.argmax(levels)) if len(x) else -1

    @classmethod
    def build(cls, x: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7) -> Graph:
        u = np.random.default_rng(seed).random(len(x))
        levels = np.minimum(-np.log(1 - u) / np.log(m), 12).astype(np.int64)
        g = cls(x, levels, np.full((len(x), 2 * m), -1, np.int32), np.full((int(levels.sum()), m), -1, np.int32))
        g.entry = -1
        for node in range(len(x)):
            g._insert(node, m, ef)
        return g

    def links(self, node: int, layer: int) -> np.ndarray:
        return self.base[node] if layer == 0 else self.upper[self.first[node] + layer - 1]

    def _insert(self, node: int, m: int, ef: int) -> None:
        top = int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        q, height = self.x[node], int(self.levels[self.entry])
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(height, top, -1):
            at = self._layer(q, at, 1, layer)
        for layer in range(min(top, height), -1, -1):
            at = self._layer(q, at, ef, layer)
            ids = np.array([i for _, i in at], np.int64)
            chosen = ids[self._diverse(ids, np.array([s for s, _ in at]), m)]
            own = self.links(node, layer)
            own[: len(chosen)] = chosen
            for other in chosen.tolist():
                row = self.links(other, layer)
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                near = np.append(row, node).astype(np.int64)
                sims = self.x[near] @ self.x[other]
                order = np.argsort(-sims, kind="stable")
                near = near[order]
                kept = near[self._diverse(near, sims[order], len(row))]
                row[: len(kept)] = kept
                row[len(kept) :] = -1
        if top > height:
            self.entry = node

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """Places of at most ``most`` of ids (nearest first): each nearer to the centre than to those chosen before, then the nearest others."""
        if len(ids) <= most:
            return list(range(len(ids)))
        x = self.x[ids]
        between, nearest = x @ x.T, np.full(len(ids), -2.0, np.float32)
        chosen: list[int] = []
        for i in range(len(ids)):
            if nearest[i] < sims[i]:
                chosen.append(i)
                if len(chosen) == most:
                    return chosen
                np.maximum(nearest, between[i], out=nearest)
        taken = set(chosen)
        return chosen + [i for i in range(len(ids)) if i not in taken][: most - len(chosen)]

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The nearest found, nearest first."""
        self.stamp += 1
        stamp, seen, x = self.stamp, self.seen, self.x
        for _, i in entries:
            seen[i] = stamp
        best = list(entries)
        heapq.heapify(best)
        ahead = [(-s, i) for s, i in entries]
        heapq.heapify(ahead)
        while ahead:
            s, i = heapq.heappop(ahead)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = self.links(i, layer)
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = x[near] @ q
            if len(best) >= ef:
                ok = sims > best[0][0]
                near, sims = near[ok], sims[ok]
            for c, j in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (c, j))
                elif c > best[0][0]:
                    heapq.heapreplace(best, (c, j))
                else:
                    continue
                heapq.heappush(ahead, (-c, j))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self._layer(q, at, 1, layer)
        return [i for _, i in self._layer(q, at, ef, 0)]


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled before squaring, so that no finite vector over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q and the rows of x, in double precision."""
    most = np.abs(x).max(1, initial=0)
    if len(x) and (most.max() > 1e150 or most.min() < 1e-140 or not 1e-140 < np.abs(q).max() < 1e150):  # squares would over- or underflow
        x, q = x / most[:, None], q / np.abs(q).max()
    return (x @ q) / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


GRAPH = "dim int, shard int, part int, members array<array<long>>, vectors binary, levels binary, base binary, upper binary"


def _build(k: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, list]]] = {}
        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    held.setdefault(keys[a], []).append((_matrix(batch.column("vector").slice(a, b - a)), batch.column("members").slice(a, b - a).to_pylist()))
        for (dim, shard), found in held.items():
            x, members = np.concatenate([v for v, _ in found]), [m for _, ms in found for m in ms]
            g = Graph.build(unit(x))
            for part, a in enumerate(range(0, len(x), PART)):
                b = min(a + PART, len(x))
                rows = slice(int(g.first[a]), int(g.first[b - 1] + g.levels[b - 1]))
                yield pa.RecordBatch.from_pylist(
                    [{"dim": dim, "shard": shard, "part": part, "members": members[a:b], "vectors": x[a:b].tobytes(), "levels": g.levels[a:b].tobytes(), "base": g.base[a:b].tobytes(), "upper": g.upper[rows].tobytes()}],
                    schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("members", pa.list_(pa.list_(pa.int64()))), *((c, pa.binary()) for c in ("vectors", "levels", "base", "upper"))]),
                )

    return run


def _search(k: int, ef: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, g, x, members = [], None, None, None, []
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            for r in batch.to_pylist():
                key = (r["cell"], r["dim"], r["shard"])
                if key != at:
                    parts, at, g = [], key, None
                if r["kind"] == 0:
                    parts.append(r)
                    continue
                if not parts:
                    continue
                if g is None:
                    x = np.frombuffer(b"".join(p["vectors"] for p in parts)).reshape(-1, r["dim"])
                    levels = np.frombuffer(b"".join(p["levels"] for p in parts), np.int64)
                    base = np.frombuffer(b"".join(p["base"] for p in parts), np.int32).reshape(len(x), -1)
                    upper = np.frombuffer(b"".join(p["upper"] for p in parts), np.int32).reshape(-1, base.shape[1] // 2)
                    g, members = Graph(unit(x), levels, base, upper), [m for p in parts for m in p["members"]]
                q = np.array(r["vector"])
                near = g.search(unit(q[None])[0], ef)
                scores = cosine(q, x[near])
                found = sorted((-s, i) for s, n in zip(scores.tolist(), near, strict=True) for i in members[n] if i != r["query_id"])[:k]
                out["query_id"] += [r["query_id"]] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return run


def index(vectors: DataFrame, k: int = 5, shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The stored graphs of all usable rows; save the result before searching it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: F.when(v == 0, 0.0).otherwise(v))).withColumn("h", F.xxhash64("vector"))
    n = shards or max(SHARDS, -(-vectors.count() // SHARD_ROWS))
    # Copies of a vector: the first k + 1 ids; Spark cuts each partition to that before it shuffles.
    rank = F.dense_rank().over(Window.partitionBy("h", "vector").orderBy("id"))
    nodes = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("h", "vector").agg(F.array_sort(F.collect_set("id")).alias("members"))
    nodes = nodes.select(F.size("vector").alias("dim"), F.pmod(F.col("h"), F.lit(n)).cast("int").alias("shard"), "h", "vector", "members")
    dealt = nodes.repartitionById(n, F.col("shard")).sortWithinPartitions("dim", "h", "vector").drop("h")
    return dealt.mapInArrow(_build(k), GRAPH)


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, ties to the smaller id."""
    shards = sorted(tuple(r) for r in graphs.select("dim", "shard").distinct().collect())  # a row for each SHARD_ROWS vectors
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("query_id").isNotNull() & usable(F.col("vector")))
    q = q.withColumn("dim", F.size("vector"))
    blocks = max(1, -(-q.count() // BLOCK_QUERIES))
    n = max([s for _, s in shards], default=0) + 1
    cell = F.col("shard") * blocks + F.col("block")
    asked = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("dim", "shard", cell.alias("cell"), F.lit(1).alias("kind"), F.lit(0).alias("part"), "query_id", "vector")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "shard", cell.alias("cell"), F.lit(0).alias("kind"), "part", "members", "vectors", "levels", "base", "upper")
    both = held.unionByName(asked, allowMissingColumns=True)
    found = both.repartitionById(n * blocks, F.col("cell")).sortWithinPartitions("cell", "dim", "shard", "kind", "part", "query_id").mapInArrow(_search(k, ef), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, shards: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index and search; the graphs go when the result is saved."""
    scratch = Scratch(vectors.sparkSession, "ann")
    graphs = scratch.save(index(vectors, k, shards, id_col, vector_col), "graphs")
    found = scratch.save(search(graphs, queries, k, ef, id_col, vector_col), "result")
    scratch.keep("result")
    return found
