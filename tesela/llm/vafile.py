"""Exact top-k inner products by vector-approximation files (Weber, Schek and Blott, 1998).

Vectors are dealt into bounded blocks.  A block's file holds every component's quantised cell in a byte beside the exact
vectors.  For a block of queries the cells are scanned first: their borders bound each score from above.  Exact
vectors are then read in the order of their bounds until the kth score is above every bound still unread, so results
are exact whatever the cells.  Query blocks meet vector blocks in a join on the block's number; each meeting returns
at most k rows a query, and these are ranked in two bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Cells of a component.
CELLS = 64
#: Partial results of a query ranked at once in the first of two steps.
FAN_IN = 64
_LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (array of floor(scale * x)) and dim, once a vec_id, of the rows whose vectors are whole and finite."""
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null").filter(~bad)
    rows = rows.select("vec_id", F.transform("e", lambda x: F.floor(x * float(scale))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _file(group: pa.Table) -> pa.Table:
    """One row for a block: ids, exact vectors and cells as bytes, with the cells' lowest value and width."""
    group = group.sort_by("vec_id")
    dim = group["dim"][0].as_py()
    exact = _matrix(group["v"], dim)
    low = exact.min(axis=0).astype(float) if dim else np.zeros(0)
    width = np.maximum(np.ceil((exact.max(axis=0).astype(float) - low + 1) / CELLS), 1.0) if dim else np.zeros(0)
    cells = np.minimum((exact - low) // width, CELLS - 1).astype(np.uint8)
    values = (group["dim"][0].as_py(), group["block"][0].as_py(), group["vec_id"].to_numpy().astype("<i8").tobytes(), exact.tobytes(), cells.tobytes(), low.tobytes(), width.tobytes())
    return pa.table({n: [v] for n, v in zip(("dim", "block", "ids", "exact", "cells", "low", "width"), values, strict=True)}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "exact", "cells", "low", "width"))]))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, exact: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Query ids, ids and scores of each query's k best in one block, and how many exact vectors were read."""
    out: tuple[list, list, list] = ([], [], [])
    read = 0
    largest = max((float(np.abs(m.astype(float)).max()) if m.size else 0.0) for m in (queries, exact))
    safe = largest * largest * max(1, exact.shape[1]) < 2.0**52
    bottom = low + cells * width
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    bound = up @ (bottom + width).T + down @ bottom.T
    if not safe:  # rounding may lower a bound; widen it by more than that
        bound = bound + (np.abs(queries).astype(float) @ (np.abs(bottom) + width).T) * 1e-9 + 1.0
    order = np.argsort(-bound, axis=1, kind="stable")
    lead = 4 * k + 12
    for i in range(len(queries)):
        scores = np.zeros(0, np.int64 if safe else object)
        taken = np.zeros(0, np.int64)
        at, q = 0, queries[i].astype(float if safe else object)
        while at < len(ids):
            rows = order[i, at : at + lead]
            at += len(rows)
            if safe:
                got = (exact[rows].astype(float) @ q).astype(np.int64)
            else:
                got = np.array([min(max(sum(int(x) * int(y) for x, y in zip(exact[r], q, strict=True)), _LONG.min), _LONG.max) for r in rows], object)
            read += len(rows)
            other = ids[rows] != query_ids[i]
            scores, taken = np.concatenate([scores, got[other]]), np.concatenate([taken, ids[rows][other]])
            best = sorted(range(len(scores)), key=lambda j: (-scores[j], taken[j]))[:k]
            scores, taken = scores[best], taken[best]
            if len(scores) == k and at < len(ids) and scores[-1] > bound[i, order[i, at]]:
                break
        out[0].extend([query_ids[i]] * len(taken))
        out[1].extend(taken)
        out[2].extend(scores)
    return (*out, read)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k vectors of the highest integer inner product.

    ``vectors`` (vec_id, embedding) and ``queries`` (the same columns) have their components x turned into
    floor(scale * x).  A query's own vec_id is no candidate; ties go to the smaller vec_id; with fewer than k
    candidates all come back.  Vectors of different lengths don't meet.

    Vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part.  Rows that
    share a vec_id count once, with the smallest of their vectors.  Empty vectors score 0 with one another.  Scores
    beyond the range of a long are held at its ends.  Other columns are ignored; empty tables give an empty result.
    """
    base = checkpointed(usable(vectors, scale))
    asked = checkpointed(usable(queries, scale))
    blocks = max(1, -(-base.count() // block_rows))
    sheets = max(1, -(-asked.count() // query_rows))
    files = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block")
    files = files.applyInArrow(_file, "dim int, block long, ids binary, exact binary, cells binary, low binary, width binary")
    packs = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sheets)).alias("sheet")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("asked"))
    packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                rows = batch.column(1)[r].values
                ids = rows.field("vec_id").to_numpy().astype(np.int64)
                matrix = rows.field("v").flatten().to_numpy().astype(np.int64).reshape(len(ids), dim)
                bytes_ = [batch.column(c)[r].as_py() for c in range(2, 7)]
                names = np.frombuffer(bytes_[0], "<i8")
                shape = (len(names), dim)
                found = best_of_block(matrix, ids, np.frombuffer(bytes_[1], np.int64).reshape(shape), names, np.frombuffer(bytes_[2], np.uint8).reshape(shape), np.frombuffer(bytes_[3]), np.frombuffer(bytes_[4]), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in found[:3]], ["query_id", "vec_id", "score"])

    partial = packs.join(files.hint("merge"), ["dim", "block"]).select("dim", "asked", "ids", "exact", "cells", "low", "width").mapInArrow(search, "query_id long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    first = Window.partitionBy("query_id", "fan").orderBy(*order)
    some = partial.withColumn("fan", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-blocks // FAN_IN))))).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
