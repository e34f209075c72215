"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph per shard, searched by beam."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import ready, staged, table

#: Distinct vectors of a shard, edges of a node, beam while building and searching, and the pruning's relaxation.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 8192, 32, 64, 240, 1.2
#: Nodes that a search starts from beside the first, spread over all, as one may be far from some queries.
STARTS = 16
#: Nodes of a beam that a step expands.
WIDE = 4
#: Queries that are searched side by side, and queries of a block.
SIDE, QUERY_BLOCK = 256, 4096


def lift(x: np.ndarray) -> np.ndarray:
    """One more coordinate that gives all rows the norm of the longest, so that the nearest are those of largest inner product."""
    norm = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]], 1).astype(np.float32)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the `beam` nearest nodes that greedy search meets, nearest first, -1 where fewer, and their squared distances.

    All queries walk side by side: each step expands the nearest nodes of each beam that aren't expanded yet, until none is left.
    Only nodes that a query hasn't met are measured.
    """
    m = len(queries)
    square = np.einsum("nd,nd->n", x, x)
    own = np.einsum("nd,nd->n", queries, queries)
    ids, dist, done = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32), np.zeros((m, beam), bool)
    first = np.unique(np.append(np.linspace(0, len(x) - 1, STARTS).astype(np.int32), start))
    first = first[(edges[first] >= 0).any(1) | (first == start)][:beam]
    d = square[first] + own[:, None] - 2 * queries @ x[first].T
    order = np.argsort(d, 1, kind="stable")
    ids[:, : len(first)], dist[:, : len(first)] = first[order], np.take_along_axis(d, order, 1)
    # The last column stands for missing edges; place tells the first of a step's equal neighbours from the others.
    met, place = np.zeros((m, len(x) + 1), bool), np.zeros((m, len(x) + 1), np.int16)
    met[:, first] = met[:, -1] = True
    column = np.arange(WIDE * edges.shape[1], dtype=np.int16)
    active = np.arange(m)
    while len(active):
        todo = ~done[active] & (ids[active] >= 0)
        some = todo.any(1)
        active, todo = active[some], todo[some]
        if not len(active):
            break
        mine, turn = ids[active], np.cumsum(todo, 1)
        row, slot = np.nonzero(todo & (turn <= WIDE))
        node = np.full((len(active), WIDE), -1, np.int32)
        node[row, turn[row, slot] - 1] = mine[row, slot]
        done[active[row], slot] = True
        near = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(len(active), -1)
        side = active[:, None]
        place[side, near] = column
        row, slot = np.nonzero(~met[side, near] & (place[side, near] == column))
        met[side, near] = True
        d, to, of = np.full(near.shape, np.inf, np.float32), near[row, slot], active[row]
        d[row, slot] = square[to] + own[of] - 2 * np.einsum("nd,nd->n", x[to], queries[of])
        every = np.concatenate([dist[active], d], 1)
        order = np.argsort(every, 1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(every, order, 1)
        ids[active] = np.where(np.isinf(dist[active]), -1, np.take_along_axis(np.concatenate([mine, near], 1), order, 1))
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(near.shape, bool)], 1), order, 1)
    return ids, dist


def robust_prune(x: np.ndarray, dist: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (sorted by dist, -1 where none) the edges to keep: the nearest, without those that a kept one is alpha times nearer to."""
    m, c = candidates.shape
    v = x[candidates]
    square = np.einsum("mcd,mcd->mc", v, v)
    between = square[:, :, None] + square[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    alive, out = candidates >= 0, np.full((m, degree), -1, np.int32)
    rows = np.arange(m)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        best = alive.argmax(1)
        out[some, k] = candidates[rows, best][some]
        alive &= ~((alpha * alpha * between[rows, best] <= dist) & some[:, None])
        alive[rows, best] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Edges of each node, -1 where fewer, and the node that searches start from.

    Nodes enter in a seeded order, in batches as large as the graph so far or an eighth of all at most: greedy searches
    propose neighbours, pruning keeps diverse ones, and each edge is offered in reverse, pruned again where a node has too many.
    """
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    if n < 2:
        return edges, 0
    start = int(np.argmin(np.einsum("nd,nd->n", x - x.mean(0), x - x.mean(0))))
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(at, n // 8 + 1))]
        at += len(batch)
        for i in range(0, len(batch), SIDE):
            some = batch[i : i + SIDE]
            ids, dist = beam_search(x, edges, start, x[some], beam)
            ids[ids == some[:, None]] = -1
            edges[some] = robust_prune(x, dist, ids, degree, alpha)
        src = np.repeat(batch, degree)
        dst = edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for i in range(0, len(nodes), SIDE):
            v, f, c = nodes[i : i + SIDE], first[i : i + SIDE], count[i : i + SIDE]
            most = int(c.max())
            take = np.arange(most)[None, :] < c[:, None]
            offered = np.where(take, src[np.minimum(f[:, None] + np.arange(most), len(src) - 1)], -1)
            offered[(offered[:, :, None] == edges[v][:, None, :]).any(2)] = -1
            every = np.concatenate([edges[v], offered], 1)
            diff = x[every] - x[v][:, None, :]
            d = np.where(every >= 0, np.einsum("mcd,mcd->mc", diff, diff), np.inf)
            near = np.argsort(d, 1, kind="stable")[:, : 3 * degree]
            every, d = np.take_along_axis(every, near, 1), np.take_along_axis(d, near, 1)
            full = (every >= 0).sum(1) > degree
            edges[v[~full]] = every[~full][:, :degree] if every.shape[1] >= degree else np.pad(every[~full], ((0, 0), (0, degree - every.shape[1])), constant_values=-1)
            if full.any():
                edges[v[full]] = robust_prune(x, d[full].astype(np.float32), every[full], degree, alpha)
    return edges, start


def _index(table_: pa.Table) -> pa.Table:
    """A shard's row: its vectors, graph and ids."""
    vectors = np.stack(table_.column("embedding").to_numpy()).astype(np.float64)
    ids = table_.column("ids").combine_chunks()
    edges, start = build(lift(vectors))
    return pa.table({
        "shard": pa.array([table_.column("shard")[0].as_py()], pa.int64()), "size": pa.array([vectors.shape[1]], pa.int64()), "start": pa.array([start], pa.int64()),
        "vectors": pa.array([vectors.tobytes()], pa.binary()), "edges": pa.array([edges.tobytes()], pa.binary()),
        "ids": pa.array([np.asarray(ids.flatten()).astype(np.int64).tobytes()], pa.binary()), "counts": pa.array([np.diff(np.asarray(ids.offsets)).astype(np.int64).tobytes()], pa.binary())})


def _query_block(table_: pa.Table) -> pa.Table:
    vectors = np.stack(table_.column("embedding").to_numpy()).astype(np.float64)
    return pa.table({"block": pa.array([table_.column("block")[0].as_py()], pa.int64()), "query_ids": pa.array([table_.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())})


def best_of(vectors: np.ndarray, ids: np.ndarray, counts: np.ndarray, found: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows among the found distinct vectors, without the query's id: by score in double precision, ties to the smaller id."""
    found = found[found >= 0]
    score = (vectors[found] * query).sum(1)
    first = np.cumsum(counts) - counts
    rows = np.repeat(score, counts[found])
    each = np.concatenate([ids[first[f] : first[f] + counts[f]] for f in found]) if len(found) else np.zeros(0, np.int64)
    rows, each = rows[each != query_id], each[each != query_id]
    order = np.lexsort((each, -rows))[:k]
    return each[order], rows[order]


def _search(k: int, beam: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                d = row["size"]
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, d)
                edges, queries = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1), np.frombuffer(row["queries"], np.float64).reshape(-1, d)
                ids, counts, query_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "counts", "query_ids"))
                x, q = lift(vectors), np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
                out = []
                for i in range(0, len(q), SIDE):
                    found, _ = beam_search(x, edges, row["start"], q[i : i + SIDE], max(beam, k + 1))
                    for j, f in enumerate(found):
                        out.append((query_ids[i + j], *best_of(vectors, ids, counts, f, queries[i + j], query_ids[i + j], k)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], schema=schema)

    return run


def nearest(rows: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score: of each row of rows (vec_id, embedding) with vec_id divisible by `every`, the k nearest others.

    All rows are indexed: equal vectors are one node, which holds its k + 1 smallest ids, as larger ones can't be among
    the k nearest; distinct vectors are dealt by hash to shards of about `shard`, each with a graph. Queries meet the
    shards in blocks of bounded size. Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; vectors of another length than the query's aren't compared. Repeated rows of an id and vector are one;
    a query's own id is never found. Without queries or rows the result is empty; other columns are ignored.
    """
    ready(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(sound)
    rows = rows.select("vec_id", F.transform("embedding", lambda c: c + 0.0).alias("embedding")).withColumn("key", F.sha1(F.to_json(F.struct("embedding")).cast("binary")))
    # Ids alone are ranked in each vector's group; row_number <= k + 1 cuts the group in every map task, before the shuffle.
    light = rows.groupBy("key", "vec_id").agg(F.lit(1).alias("one"))
    kept = light.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = kept.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = rows.join(ids.withColumn("vec_id", F.col("ids")[0]), ["key", "vec_id"]).select("key", "ids", "embedding").dropDuplicates(["key"])
    nodes = staged(nodes, "nodes")
    # One number for each vector length.
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("embedding")).count().collect()}
    shards, at = {}, 0
    for size, n in sorted(sizes.items()):
        shards[size] = (at, -(-n // shard))
        at += shards[size][1]
    deal = F.lit(0).cast("long")
    for size, (first, n) in shards.items():
        deal = F.when(F.size("embedding") == size, first + F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(n))).otherwise(deal)
    index = nodes.withColumn("shard", deal.cast("long")).select("shard", "ids", "embedding").groupBy("shard").applyInArrow(
        _index, "shard long, size long, start long, vectors binary, edges binary, ids binary, counts binary")
    index = staged(index, "index")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"])
    number = {r[0]: r[1] for r in queries.groupBy(F.size("embedding")).count().collect()}
    block, span, at = F.lit(0).cast("long"), F.array().cast("array<bigint>"), 0
    for size, n in sorted(number.items()):
        blocks = -(-n // QUERY_BLOCK)
        mine = F.size("embedding") == size
        block = F.when(mine, at + F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).otherwise(block)
        at += blocks
    blocks = queries.withColumn("block", block.cast("long")).groupBy("block").applyInArrow(_query_block, "block long, query_ids binary, queries binary")
    blocks = blocks.withColumn("size", (F.octet_length("queries") / F.octet_length("query_ids")).cast("long"))
    for size, (first, n) in shards.items():
        span = F.when(F.col("size") == size, F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))).otherwise(span)
    blocks = blocks.withColumn("shard", F.explode(span)).drop("size")
    met = index.join(blocks, "shard").select("size", "start", "vectors", "edges", "ids", "counts", "query_ids", "queries")
    found = met.mapInArrow(_search(k, beam), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
