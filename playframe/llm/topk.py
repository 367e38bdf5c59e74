"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks of about ``BLOCK`` rows, queries into groups of
about ``GROUP``; a cell is one query group against one block. In a cell each term
(vector component) has postings: the block's rows with a weight there. The
queries with a weight at the term scatter products into dense score arrays, one
per query, term after term. A selection by partition keeps each query's best rows
of the block; the best of all blocks are merged by ranking per query.

Blocks and groups meet in an equi-join on the cell, so nothing is broadcast and
the work grows with queries times candidates, which is what an exhaustive search
has to do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

TOP = 20
BLOCK = 8192
GROUP = 2048
#: Queries and candidates whose dense score array is filled at a time (1 MB of 32-bit scores).
TILE_QUERIES, TILE_ROWS = 64, 4096

RESULT = "query_uid long, query_id long, vec_id long, score long"


def quantised(vector: str, scale: float) -> tuple[Column, Column]:
    """floor(scale * x) of every component, x as double: as integers of 32 bits, else null; and where one doesn't fit, as doubles, which hold it exactly."""
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < F.lit(float(2**31 - 1)))

    def wide(x: Column) -> Column:
        v = x.cast("double") * scale
        return F.when(F.abs(v) < F.lit(float(2**52)), F.floor(v).cast("double")).otherwise(v)

    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))), F.when(~fits, F.transform(vector, wide))


def _sound(vector: str) -> Column:
    """No null vector, no null or non-finite component."""
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def _lengths(vectors: pa.ListArray) -> np.ndarray:
    return vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.ListArray, terms: int) -> np.ndarray:
    """Rows padded with zeros to the longest vector."""
    flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), _lengths(vectors)
    out = np.zeros((len(lengths), terms), np.int64)
    out[np.arange(terms)[None, :] < lengths[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores of every query row against every candidate row, term at a time."""
    bound = (int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))) * queries.shape[1]
    kind = np.int32 if bound < 2**31 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    scores = np.zeros((len(queries), len(candidates)), kind)
    product = np.empty_like(scores)
    for term, weights in enumerate(postings):
        own = queries[:, term]
        rows, cols = np.flatnonzero(own), np.flatnonzero(weights)
        if 2 * len(rows) >= len(own) and 2 * len(cols) >= len(weights):
            np.multiply(own[:, None], weights[None, :], out=product)
            scores += product
        elif len(rows) and len(cols):
            scores[np.ix_(rows, cols)] += own[rows][:, None] * weights[cols][None, :]
    return scores.astype(np.int64)


def _wide_rows(matrix: np.ndarray, wide: pa.ListArray) -> dict[int, np.ndarray]:
    """Rows with components so large that a score could exceed 64 bits, as Python integers; they become zeros in ``matrix``."""
    terms = matrix.shape[1]
    limit = math.isqrt((2**63 - 1) // max(1, terms))
    found = {i: [int(x) for x in wide[i].as_py()] for i in np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False)).tolist()}
    found |= {i: matrix[i].tolist() for i in np.flatnonzero((np.abs(matrix) > limit).any(axis=1)).tolist()}
    matrix[list(found)] = 0
    return {i: np.array([*v, *[0] * (terms - len(v))], object) for i, v in found.items()}


def _scores(queries: np.ndarray, candidates: np.ndarray, wide_queries: dict[int, np.ndarray], wide_candidates: dict[int, np.ndarray]) -> np.ndarray:
    """Exact scores of a tile, as Python integers if there are wide rows in it."""
    scores = accumulate(queries, candidates)
    if not wide_queries and not wide_candidates:
        return scores
    scores, queries, candidates = (x.astype(object) for x in (scores, queries, candidates))
    for i, v in wide_queries.items():
        queries[i] = v
    for j, v in wide_candidates.items():
        candidates[j] = v
    for i, v in wide_queries.items():
        scores[i] = candidates @ v
    for j, v in wide_candidates.items():
        scores[:, j] = queries @ v
    return scores


def _best(scores: np.ndarray, query: np.ndarray, ids: np.ndarray, uids: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per query (uid, id) the tile's best rows but its own; candidates are in ascending order of id, so position breaks ties."""
    for i, (own, asked) in enumerate(query):
        there = np.flatnonzero(uids != own)
        if len(there) > top:
            s, at = scores[i, there], len(there) - top
            least = (np.sort(s) if s.dtype == object else np.partition(s, at))[at]
            above = there[s > least]
            there = np.concatenate((above, there[s == least][: top - len(above)]))
        yield np.full(len(there), own), np.full(len(there), asked), ids[there], scores[i, there]


def _cell(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            q, c = (b.column(i)[r].values for i in (0, 1))
            (asking, query), (uids, ids) = ([x.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)] for x in (q, c))
            vectors, wide = ([x.field(i) for x in (q, c)] for i in (2, 3))
            terms = max(int(_lengths(v).max(initial=0)) for v in (*vectors, *wide))
            left, right = (_matrix(v, terms) for v in vectors)
            order = np.argsort(ids, kind="stable")
            ids, uids, right = ids[order], uids[order], right[order]
            wide_left, wide_right = _wide_rows(left, wide[0]), _wide_rows(right, wide[1].take(pa.array(order)))
            for lo in range(0, len(query), TILE_QUERIES):
                part = slice(lo, lo + TILE_QUERIES)
                found = []
                for at in range(0, len(ids), TILE_ROWS):
                    tile = slice(at, at + TILE_ROWS)
                    near = [{i - start: v for i, v in rows.items() if start <= i < start + n} for rows, start, n in ((wide_left, lo, TILE_QUERIES), (wide_right, at, TILE_ROWS))]
                    found += _best(_scores(left[part], right[tile], *near), np.stack((asking[part], query[part]), 1), ids[tile], uids[tile], top)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["query_uid", "query_id", "vec_id", "score"])


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(``name``, ``name_rows``): lists of about ``size`` rows, dealt by a hash of the row's number; and how many lists."""
    count = max(1, -(-rows.count() // size))
    key = F.pmod(F.xxhash64("uid"), F.lit(count))
    return rows.groupBy(key.alias(name)).agg(F.collect_list(F.struct("uid", "id", "vector", "wide")).alias(f"{name}_rows")), count


def top_inner_products(vectors: DataFrame, is_query: Column, row_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, top: int = TOP, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Per query row its ``top`` highest integer inner products: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    ``is_query`` picks the queries, an expression over the columns of ``vectors``. All
    rows but the query's own are candidates; ties go to the smaller id. Vectors
    that are null or hold null or non-finite components take no part, nor do null
    ids. A shorter vector counts as padded with zeros; an empty one scores 0. Rows
    count, not ids: each of several rows of one id, repeated whole or not, is a
    candidate of all other rows and asks for itself. Components may be of any finite
    size; a score that is among a block's best and doesn't fit in 64 bits fails the
    query, as its column can't hold it. An empty table gives no rows. Further columns
    are not read.
    """
    small, wide = quantised(f"`{vector}`", scale)
    rows = vectors.where(_sound(f"`{vector}`") & F.col(f"`{row_id}`").isNotNull()).select(F.col(f"`{row_id}`").cast("long").alias("id"), small.alias("vector"), wide.alias("wide"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()))
    blocks, n_blocks = _dealt(rows, block, "block")
    groups, n_groups = _dealt(rows.where("asks"), group, "group")
    left = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    cells = left.join(right.withColumnsRenamed({"block": "_block", "group": "_group"}), (F.col("group") == F.col("_group")) & (F.col("block") == F.col("_block")))
    found = cells.select("group_rows", "block_rows").mapInArrow(lambda batches: _cell(batches, top), RESULT)
    rank = F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
