"""Exact top-k inner products by branch and bound over a columnar layout.

Candidates stay where they are stored. A task holds CHUNK of them at a time in vertical layout (a row for each dimension)
and adds up scores a block of DIMS dimensions at a time. After each block a query's candidates are bounded: what the
remaining dimensions can add or take lies within the product of the remaining masses (norms) of query and candidate.
Those whose upper bound is below the k-th best lower bound, or the k-th best whole score so far, are dropped and the rest
is compacted. Queries come in batches of QUERIES rows at most, which bounds what is broadcast; there is one pass over
the candidates for each batch. A task gives its k best for each query; the best of those are the result.

Components become floor(256 * x). Vectors that are null or hold a null, nan or infinite component take no part; shorter
vectors count as filled up with zeros. Ties go to the smaller vec_id; a row is no candidate of a query with its own
vec_id; rows that repeat a query's vec_id are queries of their own, rows that repeat another's are candidates each. Scores
are ranked as exact whole numbers of any size, and shown as long, beyond its range as its largest or smallest value. An
empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, table

K, EVERY, DIMS, CHUNK, QUERIES = 5, 50, 8, 8192, 16384
#: Up to here sums of products are exact in doubles.
EXACT = 2.0**52
LONG = (1 << 63) - 1
_NINES = str.maketrans("0123456789", "9876543210")


def unpacked(column, dims: int | None = None) -> np.ndarray:
    """dims x rows of an Arrow array of lists, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = np.diff(column.offsets.to_numpy())
    dims = int(width.max(initial=0)) if dims is None else dims
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (width == dims).all():
        return np.ascontiguousarray(flat.reshape(len(width), dims).T)
    out = np.zeros((dims, len(width)))
    row = np.repeat(np.arange(len(width)), width)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width), row] = flat
    return out


def quantised(raw: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles; infinite if it exceeds them."""
    with np.errstate(over="ignore"):
        return np.floor(256.0 * raw)


def whole(x: float) -> int:
    """floor(256 * x) exactly; numbers that 256 could lift out of the doubles are whole already."""
    return int(x) * 256 if abs(x) > 2.0**60 else int(np.floor(256.0 * x))


def order_key(score: int) -> str:
    """Text that sorts as whole numbers do."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(_NINES)


def masses(x: np.ndarray) -> np.ndarray:
    """For each block border b, the norm of dimensions from b on: borders x columns, rounded up."""
    squares = np.add.reduceat(x * x, np.arange(0, len(x), DIMS), axis=0) if len(x) else np.zeros((0, x.shape[1]))
    rest = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.vstack([np.sqrt(rest) * (1 + 1e-12), np.zeros((1, x.shape[1]))])


def best_of_chunk(q: np.ndarray, q_mass: np.ndarray, q_id: int, x: np.ndarray, x_mass: np.ndarray, x_id: np.ndarray, k: int, floor: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates that may be among the k best for one query; floor: a score that k others reach already."""
    alive = np.flatnonzero(x_id != q_id)
    score = start[alive]
    blocks = len(x_mass) - 1
    for b in range(1, blocks + 1):
        slack = x_mass[b][alive] * q_mass[b]
        if len(alive) > k:
            low = score - slack
            bound = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        else:
            bound = floor
        keep = score + slack >= bound
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if b < blocks and len(alive):
            d = slice(b * DIMS, (b + 1) * DIMS)
            score = score + q[d] @ x[d][:, alive]
    return alive, score


def _grown(m: np.ndarray, dims: int) -> np.ndarray:
    return np.vstack([m, np.zeros((dims - len(m), m.shape[1]))]) if len(m) < dims else m


def search_chunk(raw_queries: np.ndarray, q_mass: np.ndarray, q_ids: np.ndarray, raw: np.ndarray, x_ids: np.ndarray, k: int, best: list) -> None:
    """Merges a chunk's candidates into best, a list of (scores, ids) a query, in order."""
    dims = max(len(raw_queries), len(raw))
    raw_queries, raw = _grown(raw_queries, dims), _grown(raw, dims)
    queries, x = quantised(raw_queries), quantised(raw)
    with np.errstate(over="ignore", invalid="ignore"):
        large = dims and not np.abs(queries).max(initial=0) * np.abs(x).max(initial=0) * dims < EXACT
    if large or any(s.dtype == object for s, _ in best):
        return _search_large(raw_queries, q_ids, raw, x_ids, k, best)
    q_mass = masses(queries) if len(q_mass) != -(-dims // DIMS) + 1 else q_mass
    x_mass = masses(x)
    for at in range(0, len(q_ids), 256):
        first = queries[:DIMS, at : at + 256].T @ x[:DIMS]
        for j in range(at, min(at + 256, len(q_ids))):
            scores, ids = best[j]
            floor = scores[k - 1] if len(scores) >= k else -np.inf
            alive, got = best_of_chunk(queries[:, j], q_mass[:, j], q_ids[j], x, x_mass, x_ids, k, floor, first[j - at])
            if len(alive):
                best[j] = _merged(np.concatenate([scores, got]), np.concatenate([ids, x_ids[alive]]), k)


def _search_large(queries, q_ids, x, x_ids, k, best) -> None:
    """Whole numbers of any size, for vectors whose products leave the exact range of doubles."""
    ints = [[whole(v) for v in c] for c in x.T]
    for j, q in enumerate(queries.T):
        q = [whole(v) for v in q]
        mine = [(sum(a * b for a, b in zip(q, c)), int(i)) for c, i in zip(ints, x_ids) if i != q_ids[j]]
        both = sorted([*mine, *((int(s), int(i)) for s, i in zip(*best[j]))], key=lambda r: (-r[0], r[1]))[:k]
        best[j] = np.array([r[0] for r in both], object), np.array([r[1] for r in both], np.int64)


def _merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, per_batch: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each of `queries`, both with vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)
    usable = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    clean = lambda d: d.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding").filter(usable)
    queries, candidates = materialise(clean(queries), "topk-queries"), clean(vectors)
    n_batches = max(1, -(-queries.count() * 5 // (4 * per_batch)))
    found = None
    for batch in range(n_batches):
        # Rows that repeat a vec_id share a batch, so the batch is told by the id.
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_batches)) == batch).sort("vec_id", "embedding").toArrow()
        raw = unpacked(got["embedding"])
        with np.errstate(over="ignore", invalid="ignore"):
            shared = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), raw, masses(quantised(raw))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, raw, q_mass = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in q_ids]
            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    part = b.slice(at, CHUNK)
                    search_chunk(raw, q_mass, q_ids, unpacked(part.column(1)), part.column(0).to_numpy(), k, best)
            counts = [len(s) for s, _ in best]
            scores = [int(x) for s, _ in best for x in s]
            ids = np.concatenate([i for _, i in best] or [np.zeros(0, np.int64)])
            shown = [max(-LONG - 1, min(LONG, x)) for x in scores]
            cols = [np.repeat(np.arange(len(q_ids)), counts), np.repeat(q_ids, counts), ids, shown]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(list(map(order_key, scores)), pa.string())], names=["query", "query_id", "vec_id", "score", "key"])

        part = candidates.mapInArrow(run, "query long, query_id long, vec_id long, score long, key string")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search(e, e.filter(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
