"""Approximate nearest neighbours by largest inner product: a robust-pruned graph per shard.

Distinct vectors are spread over shards by hash. In a shard each vector is searched from a
fixed start in the graph so far; what the search meets is pruned to diverse edges (an edge
goes if a kept one is nearer to its end by the factor ALPHA), and edges back are added.
Queries walk every shard's graph with a beam, in blocks, and their best are merged.

Inner products become distances by one more coordinate, sqrt(m^2 - |x|^2) for the largest
length m of the shard (0 for queries). That coordinate must stay small, or it hides the direction
of a vector, so a shard holds vectors of one band of lengths only, and every band is searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrace.storage import materialise

SHARD = 8192
DEGREE, BUILD_BEAM, ALPHA = 32, 48, 1.2
BEAM, STEP = 80, 4
#: Lengths of a shard differ by this factor at most.
LENGTH_BAND = 1.15
QUERY_BLOCK = 1024
#: Query blocks that pass one copy of a shard.
BLOCKS_PER_COPY = 16
_GRAPH = "shard int, dim int, band int, vectors binary, edges binary, ids binary, id_bounds binary, start int"


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points found for each query, nearest first (-1 and inf where there are fewer)."""
    n, b = len(points), len(queries)
    size = (points**2).sum(1)
    own = np.full((b, beam), -1, np.int32)
    far = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no edge"
    own[:, 0] = start
    far[:, 0] = size[start] - 2 * queries @ points[start]
    seen[:, start] = True
    active = np.arange(b)
    while len(active):
        open_ = np.where(done[active] | (own[active] < 0), np.inf, far[active])
        picks = np.argsort(open_, axis=1, kind="stable")[:, :step]
        real = np.take_along_axis(open_, picks, 1) < np.inf
        more = real.any(1)
        active, picks, real = active[more], picks[more], real[more]
        if not len(active):
            break
        flags = done[active]
        np.put_along_axis(flags, picks, True, 1)
        done[active] = flags
        nodes = np.take_along_axis(own[active], picks, 1)
        new = np.where(real[:, :, None], edges[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        new = np.sort(np.where(new < 0, n, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        fresh = ~seen[active[:, None], new]
        seen[active[:, None], new] = True
        row, col = np.nonzero(fresh)
        target = new[row, col]
        distance = np.full(new.shape, np.inf, np.float32)
        distance[row, col] = size[target] - 2 * np.einsum("ij,ij->i", queries[active[row]], points[target])
        all_far = np.concatenate([far[active], distance], 1)
        all_own = np.concatenate([own[active], np.where(fresh, new, -1).astype(np.int32)], 1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, best, 1)
        own[active] = np.where(far[active] < np.inf, np.take_along_axis(all_own, best, 1), -1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return own, far


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Diverse out-edges (-1: none) of each node, from its row of candidates (-1: none)."""
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    where = points[np.maximum(candidates, 0)]
    distance = np.where(valid, ((where - points[nodes][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
    where = np.take_along_axis(where, order[:, :, None], 1)
    norm = (where**2).sum(2)
    out = np.full((len(nodes), degree), -1, np.int32)
    rows = np.arange(len(nodes))
    alive = distance < np.inf
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = candidates[rows[has], pick[has]]
        apart = norm + norm[rows, pick][:, None] - 2 * np.einsum("ijk,ik->ij", where, where[rows, pick])
        alive &= ~(has[:, None] & (alpha * alpha * np.maximum(apart, 0) <= distance))
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 0) -> tuple[np.ndarray, int]:
    """Out-edges of every point and the point that searches start from."""
    n = len(points)
    random = np.random.default_rng(seed)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n, degree), -1, np.int32)
    few = min(degree // 2, n - 1)
    if few:
        edges[:, :few] = (np.arange(n)[:, None] + random.integers(1, n, (n, few))) % n
    order = random.permutation(n)
    for at in range(0, n, 256):
        nodes = order[at : at + 256]
        met, _ = beam_search(points, edges, start, points[nodes], beam)
        edges[nodes] = robust_prune(points, nodes, np.concatenate([met, edges[nodes]], 1), degree)
        source = np.repeat(nodes, degree)
        target = edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), count.max() if len(ends) else 0), -1, np.int64)
        back[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        wide = np.concatenate([edges[ends], back], 1)
        wide = np.sort(wide, axis=1)[:, ::-1]
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        held = (wide >= 0).sum(1)
        fits = held <= degree
        packed = np.sort(wide, axis=1)[:, ::-1][:, :degree]
        edges[ends[fits]] = packed[fits][:, :degree] if packed.shape[1] == degree else np.pad(packed[fits], ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
        full = np.flatnonzero(~fits)
        for s in range(0, len(full), 256):
            part = full[s : s + 256]
            edges[ends[part]] = robust_prune(points, ends[part], wide[part], degree)
    return edges, start


def lift(vectors: np.ndarray) -> np.ndarray:
    """Vectors, scaled to lengths up to 1, with the coordinate that makes them equally long."""
    vectors = vectors / max(np.abs(vectors).max(), np.finfo(float).tiny)
    square = (vectors**2).sum(1)
    vectors, square = vectors / np.sqrt(square.max()), square / square.max()
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_id")
    vectors = np.stack(group["vector"].to_numpy()).astype(np.float64)
    edges, start = build_graph(lift(vectors))
    ids = [np.sort(np.asarray(i, np.int64)) for i in group["ids"]]
    return pd.DataFrame(
        {
            "shard": [group["shard"].iloc[0]],
            "dim": [vectors.shape[1]],
            "band": [group["band"].iloc[0]],
            "vectors": [vectors.tobytes()],
            "edges": [edges.tobytes()],
            "ids": [np.concatenate(ids).tobytes()],
            "id_bounds": [np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int64).tobytes()],
            "start": [start],
        }
    )


def _search(k: int, beam: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, row.dim)
                edges = np.frombuffer(row.edges, np.int32).reshape(len(vectors), -1)
                ids, bounds = np.frombuffer(row.ids, np.int64), np.frombuffer(row.id_bounds, np.int64)
                query_ids = np.asarray(row.query_ids, np.int64)
                queries = np.stack([np.asarray(q, np.float64) for q in row.queries])
                points = lift(vectors)
                for at in range(0, len(queries), 256):
                    part = queries[at : at + 256]
                    scaled = part / np.maximum(np.abs(part).max(1, keepdims=True), np.finfo(float).tiny)
                    padded = np.concatenate([scaled, np.zeros((len(part), 1))], 1).astype(np.float32)
                    met, _ = beam_search(points, edges, row.start, padded, beam)
                    query, slot = np.nonzero(met >= 0)
                    node = met[query, slot]
                    score = np.einsum("ij,ij->i", part[query], vectors[node])
                    n = bounds[node + 1] - bounds[node]
                    which = np.repeat(np.arange(len(node)), n)
                    vec = ids[np.repeat(bounds[node] - (np.cumsum(n) - n), n) + np.arange(len(which))]
                    query, score = query[which], score[which]
                    other = vec != query_ids[at : at + 256][query]
                    query, score, vec = query[other], score[other], vec[other]
                    order = np.lexsort((vec, -score, query))
                    query, score, vec = query[order], score[order], vec[order]
                    place = np.arange(len(query)) - np.searchsorted(query, query)
                    best = place < k
                    yield pd.DataFrame({"query_id": query_ids[at : at + 256][query[best]], "vec_id": vec[best], "score": score[best]})

    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one per id."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~odd & some).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    query_step: int = 20,
    shard_size: int = SHARD,
    beam: int = BEAM,
) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``query_step``: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller id. Null ids,
    and vectors that are null, empty, zero, or hold a null or non-finite component, take no
    part. Of several rows with one id the smallest vector counts. Vectors of different
    length are never compared. Equal vectors are one point of the graph, with its ``k + 1``
    smallest ids (larger ones cannot be among the nearest). Every row is indexed.
    """
    rows = usable(vectors, id_col, vector_col)
    most = "array_max(transform(vector, x -> abs(x)))"
    length = f"ln({most}) + 0.5D * ln(aggregate(vector, 0D, (t, x) -> t + (x / {most}) * (x / {most})))"
    band = F.expr(f"CAST(floor(({length}) / {math.log(LENGTH_BAND)!r}D + 0.5D) AS INT)")
    rows = materialise(rows.withColumn("dim", F.size("vector")).withColumn("band", band), "vectors")
    equal = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.withColumn("nr", F.row_number().over(equal)).where(F.col("nr") <= k + 1)
    points = points.groupBy("dim", "band", "vector").agg(F.collect_list("vec_id").alias("ids"), F.min("vec_id").alias("first_id"))
    # One row for each number of components and band of lengths.
    sizes = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_step == 0).alias("asked")).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked_of: dict[int, int] = {}
    for r in sizes:
        asked_of[r["dim"]] = asked_of.get(r["dim"], 0) + r["asked"]
    plan = [
        (r["dim"], r["band"], math.ceil(r["n"] / shard_size), max(1, math.ceil(asked_of[r["dim"]] / QUERY_BLOCK))) for r in sizes
    ]
    n_shards = sum(shards for _, _, shards, _ in plan)
    plan = rows.sparkSession.createDataFrame(plan, "dim int, band int, shards int, blocks int")
    placed = points.join(plan, ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64("vector"), "shards").cast("int"))
    # Building takes long for its bytes, so shards are spread by their number, not by their size.
    spread = placed.repartition(2 * n_shards, "dim", "band", "shard")
    graphs = materialise(spread.groupBy("dim", "band", "shard").applyInPandas(_index, _GRAPH), "graphs")
    of_dim = plan.groupBy("dim").agg(F.max("blocks").alias("blocks"))
    queries = rows.where(F.col("vec_id") % query_step == 0).select("vec_id", "vector", "dim").join(of_dim, "dim")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    queries = queries.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("q"))
    copy = F.floor(F.col("block") / BLOCKS_PER_COPY).cast("int").alias("copy")
    queries = queries.select("dim", copy, F.col("q.vec_id").alias("query_ids"), F.col("q.vector").alias("queries"))
    # Query blocks travel to the shards; a shard is copied once for many blocks and searched where the join puts it.
    shards = plan.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = queries.join(shards, "dim")
    copies = F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS_PER_COPY).cast("int"))).alias("copy")
    held = graphs.join(of_dim, "dim").select("*", copies)
    pairs = asked.join(held.hint("merge"), ["dim", "band", "shard", "copy"])
    pairs = pairs.select("dim", "vectors", "edges", "ids", "id_bounds", "start", "query_ids", "queries")
    found = pairs.mapInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
