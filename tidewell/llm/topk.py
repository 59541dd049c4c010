"""Exact top-k inner-product search with norm order, rotated partial sums and bounds.

Vectors are ranged by descending length and packed in blocks.  All vectors are
rotated by the right singular vectors of the whole table, which gathers most of an
inner product in the first dimensions.  A block pair first drops the vectors whose
length times the query's is under the query's k-th best score so far, then adds
partial sums a few dimensions at a time and drops a vector as soon as its partial
sum plus the product of the residual lengths (Cauchy-Schwarz) is under that score.
What is left is scored in exact integers.  The first scores come from the block of
the longest vectors, so that later blocks prune from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut

BLOCK = 4096
QUERIES = 512
STEP = 16
#: Pairs of a query and a vector that are held at once.
PAIRS = 1 << 19
#: Relative slack for the rounding of rotated sums; only exact scores decide.
SLACK = 1e-9


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id and v (array of long): floor(scale * x) of each component.

    Rows whose vector is null or holds a null or non-finite component are left out.
    """
    x = F.col("x")
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where(
        F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    )
    return v.select("id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs; shorter vectors are filled with zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    length = np.diff(ends)
    out = np.zeros((len(length), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = values
    return out


def _packer(dims: int, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                ids, m = some.column(0).to_numpy().astype("<i8"), _matrix(some.column(1), dims)
                f = m.astype(np.float64)
                yield pa.RecordBatch.from_pydict({
                    "ids": [ids.tobytes()], "data": [m.astype("<i8").tobytes()], "n": pa.array([len(ids)], pa.int32()),
                    "longest": pa.array([float(np.sqrt((f * f).sum(axis=1)).max(initial=0.0))], pa.float64()),
                    "gram": pa.array([(f.T @ f).ravel()], pa.list_(pa.float64())),
                })

    return pack


def _blocks(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    schema = "ids binary, data binary, n int, longest double, gram array<double>"
    return vectors.select("id", "v").mapInArrow(_packer(dims, block), schema)


def _rotation(blocks: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all packed vectors, from the sum of the blocks' Gram matrices."""
    summed = blocks.select(F.posexplode("gram").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros(dims * dims)
    for row in summed:
        gram[row["at"]] = row["g"]
    return np.ascontiguousarray(np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1])


def _top(query_ids, ids, scores, query_at, k):
    """The k best of each query: higher score first, smaller id on ties."""
    order = np.lexsort((ids, -scores, query_at))
    query_at, ids, scores = query_at[order], ids[order], scores[order]
    first = np.searchsorted(query_at, query_at, side="left")
    keep = np.arange(len(order)) - first < k
    return query_ids[query_at[keep]], ids[keep], scores[keep]


def search_block(query_ids, q, least, ids, x, rotation, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query in one block, at or above ``least``.

    ``least`` is a lower bound of each query's final k-th score (-inf if unknown).
    """
    dims = x.shape[1]
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    norm_q, norm_x = np.sqrt((fq * fq).sum(axis=1)), np.sqrt((fx * fx).sum(axis=1))
    order = np.argsort(-norm_x, kind="stable")
    ids, x, fx, norm_x = ids[order], x[order], fx[order], norm_x[order]
    rq, rx = fq @ rotation, fx @ rotation
    rest_q, rest_x = (np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1])) for r in (rq, rx))
    floor = least - SLACK * (np.abs(least) + norm_q * norm_x.max(initial=0.0))
    step, found = max(1, PAIRS // max(1, len(x))), []
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        # lengths descend: one cut drops the vectors too short for every query of this slice
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floor[part] > 0, floor[part] / norm_q[part], 0.0).min()
        cut_at = int(np.searchsorted(-norm_x, -need * (1 - SLACK), side="right"))
        sums = rq[part, :STEP] @ rx[:cut_at, :STEP].T
        near = sums + rest_q[part, STEP : STEP + 1] * rest_x[:cut_at, STEP : STEP + 1].T >= floor[part, None] if dims > STEP else sums >= floor[part, None]
        at_q, at_x = np.nonzero(near)
        sums = sums[at_q, at_x]
        at_q = at_q + a
        for d in range(STEP, dims, STEP):
            if len(at_q) <= 4 * k * step:
                break
            sums = sums + _dots(rq[:, d : d + STEP], rx[:, d : d + STEP], at_q, at_x)
            rest = rest_q[at_q, d + STEP] * rest_x[at_x, d + STEP] if d + STEP < dims else 0.0
            near = sums + rest >= floor[at_q]
            at_q, at_x, sums = at_q[near], at_x[near], sums[near]
        other = ids[at_x] != query_ids[at_q]
        at_q, at_x = at_q[other], at_x[other]
        exact = _dots(q, x, at_q, at_x)
        good = exact >= least[at_q]
        found.append(_top(query_ids, ids[at_x[good]], exact[good], at_q[good], k))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _dots(q: np.ndarray, x: np.ndarray, at_q: np.ndarray, at_x: np.ndarray) -> np.ndarray:
    """Inner products of picked rows, a slice of pairs at a time."""
    out = np.empty(len(at_q), q.dtype)
    for a in range(0, len(at_q), 1 << 15):
        part = slice(a, a + (1 << 15))
        out[part] = np.einsum("ij,ij->i", q[at_q[part]], x[at_x[part]])
    return out


def _searcher(dims: int, rotation: np.ndarray, k: int):
    def longs(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                query_ids, ids = longs(row["q_ids"]), longs(row["ids"])
                least = np.frombuffer(row["q_least"], "<f8") if row.get("q_least") else np.full(len(query_ids), -np.inf)
                found = search_block(query_ids, longs(row["q_data"]).reshape(-1, dims), least, ids, longs(row["data"]).reshape(-1, dims), rotation, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "id", "score"])

    return run


FOUND = "query_id long, id long, score long"


def _with_least(dims: int):
    """Pack queries with the bounds that they carry (id, v, least)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                m = _matrix(some.column(1), dims)
                least = np.nan_to_num(some.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-np.inf).astype("<f8")
                f = m.astype(np.float64)
                norm = np.sqrt((f * f).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(least > 0, least / norm, 0.0)
                yield pa.RecordBatch.from_pydict({
                    "q_ids": [some.column(0).to_numpy().astype("<i8").tobytes()], "q_data": [m.astype("<i8").tobytes()],
                    "q_least": [least.tobytes()], "q_need": pa.array([float(need.min(initial=np.inf))], pa.float64()),
                })

    return pack


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` highest inner products of each query row among all other rows.

    Components become floor(scale * x); scores are exact as long as they fit a long.
    ``is_query`` marks the queries by columns of ``df``.  Candidates are all rows
    but those of the query's own key; on ties the smaller key ranks first, and fewer
    are returned where there are fewer.  Null vectors and those with null or
    non-finite components take no part, nor do rows with a null key; shorter vectors count as filled up with
    zeros, an empty one scores 0.  Repeated rows of a key are candidates each; as a
    query such a key has its least vector.
    Returns query_id, rank (from 1), key, score; an empty table gives no rows.

    Queries meet all rows in blocks: the work is pairs of blocks, each a row, and a
    pair returns at most k rows a query.
    """
    spark = df.sparkSession
    marked = df.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    vectors = integer_vectors(marked, "_key", "_vector", scale)
    widest, rows = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    dims = max(1, widest or 1)
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    ranged = vectors.withColumn("length", length).repartitionByRange(max(1, -(-rows // BLOCK)), F.col("length").desc(), "id")
    blocks = cut(_blocks(ranged.sortWithinPartitions(F.col("length").desc(), "id"), dims, BLOCK))
    if not blocks.take(1):
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    rotation = _rotation(blocks, dims)
    queries = cut(integer_vectors(marked.where("_query"), "_key", "_vector", scale).groupBy("id").agg(F.min("v").alias("v")))
    # full query blocks: the pairs that follow are as few as they can be
    parts = max(1, -(-queries.count() // QUERIES))
    queries = queries.coalesce(parts)
    search = _searcher(dims, rotation, k)
    data = ["ids", "data", "q_ids", "q_data", "q_least"]
    # one block of the longest vectors gives each query a first bound
    head = blocks.orderBy(F.col("longest").desc()).limit(1).select("ids", "data")
    plain = queries.withColumn("least", F.lit(None).cast("double")).mapInArrow(_with_least(dims), "q_ids binary, q_data binary, q_least binary, q_need double")
    first = plain.crossJoin(F.broadcast(head)).select(*data).mapInArrow(search, FOUND)
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    bounded = queries.join(bound, queries["id"] == bound["query_id"], "left").select("id", "v", "least").coalesce(parts)
    asked = bounded.mapInArrow(_with_least(dims), "q_ids binary, q_data binary, q_least binary, q_need double")
    # a block pair whose longest vector is too short for every query of its block is never made
    pairs = cut(asked).join(blocks.select("ids", "data", "longest"), F.col("longest") * (1 + SLACK) >= F.col("q_need") * (1 - SLACK))
    found = pairs.select(*data).mapInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
