"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded bytes. For a block, every vector is
scored in each pass, and nothing but counts leaves a task: a histogram of scores
per query is summed over all tasks and refined, until the value of the k-th best
score is known exactly (scores are integers). A last pass keeps the scores that
reach it and breaks ties by the smaller identifier. Counts of bins below a
task's own k-th best bin cannot matter and are not sent, and bins above those of
the last pass are counted as one.

Products of ordinary vectors are exact in floating point. A vector with an entry
so large that they might not be is scored apart, in whole numbers of any size,
and its best scores are ranked together with the others.

Defined cases: vectors that are null or hold null or non-finite components take
no part; only vectors of the query's length are scored; a query's own row and
rows with its identifier are no candidates; fewer candidates than k are all
returned; repeated candidates each take a rank; a query row that repeats is
answered once for each row; rows without identifier take no part, and identifiers
are whole numbers; entries are clipped to the range of a long, and so are scores;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.llm.common import cut
from stockcast.llm.negatives import HIGHEST, LOWEST, candidates_of, first_rows, nothing

BLOCK_BYTES = 16_000_000
EXACT = 2**53
SCORES = 2_000_000
BINS = 11


def integers(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, q, large): vectors that take part, as whole numbers floor(scale * x), whether they are queries, and whether products need more than a double."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).withColumn("large", F.coalesce(F.greatest(F.array_max("v"), -(F.array_min("v") + 1)) >= F.floor(F.sqrt(EXACT / F.size("v"))), F.lit(False)))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(column), 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray, query_ids: np.ndarray):
    """(ids, scores) for slices of candidates; a query's own identifier scores -inf. Products stay below 2**53, so they are exact."""
    dim = queries.shape[1]
    step = max(1, SCORES // len(queries))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            ids = piece.column(0).to_numpy()
            scores = matrix(piece.column(1), dim) @ queries.T
            order = np.argsort(query_ids, kind="stable")
            left, right = (np.searchsorted(query_ids[order], ids, side) for side in ("left", "right"))
            for row in np.flatnonzero(right > left):
                scores[row, order[left[row]:right[row]]] = -np.inf
            yield ids, scores


def histograms(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, shift: int, k: int):
    """Counts of bins of width 2**shift at or above each query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), 0), -np.inf)  # the k best bins so far: the least of them bounds what can matter
        counts: dict[tuple[int, int], int] = {}
        for _, scores in scored(batches, queries, query_ids):
            bins = np.minimum(np.floor(np.ldexp(scores - floor, -shift)), 1 << BINS).T  # query x candidate; above the last pass's bins all are one
            bound = best.min(axis=1) if best.shape[1] >= k else np.full(len(queries), -1.0)
            q, c = np.nonzero((bins >= 0) & (bins >= bound[:, None]))
            packed, n = np.unique(q.astype(np.int64) << 40 | bins[q, c].astype(np.int64), return_counts=True)
            for key, m in zip(packed.tolist(), n.tolist()):
                counts[key] = counts.get(key, 0) + m
            top = np.partition(bins, max(0, bins.shape[1] - k), axis=1)[:, -k:]
            best = np.sort(np.hstack([best, top]), axis=1)[:, -k:]
        bound = np.maximum(best.min(axis=1), 0) if best.shape[1] >= k else np.zeros(len(queries))
        kept = [(key >> 40, key & (1 << 40) - 1, n) for key, n in counts.items() if (key & (1 << 40) - 1) >= bound[key >> 40]]
        q, b, n = zip(*kept) if kept else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["q", "bin", "n"])

    return run


def reaching(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int):
    """Scores at or above each query's k-th value; of a task's rows the first k by score and identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]
        for ids, scores in scored(batches, queries, query_ids):
            c, q = np.nonzero(scores >= np.where(np.isneginf(least), -np.finfo(float).max, least))
            held = [np.concatenate(x) for x in zip(held, (q.astype(np.int64), ids[c], scores[c, q].astype(np.int64)))]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            place = np.arange(len(order)) - np.searchsorted(held[0], held[0], "left")
            held = [x[place < k] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1]), pa.array(held[2])], ["q", "id", "score"])

    return run


def exactly(queries: np.ndarray, query_ids: np.ndarray, k: int):
    """A task's first k rows of each query, scored in whole numbers of any size that are then clipped to a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dim = nothing(), queries.shape[1]
        step = max(1, SCORES // 4 // len(queries))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids, v = piece.column(0).to_numpy(), piece.column(1).flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((len(piece), 0), np.int64)
                bound = dim * max(1, *(abs(int(f(x, initial=0))) for x in (v, queries) for f in (np.max, np.min))) ** 2
                kind = np.int64 if bound < 2**62 else object
                scores = np.clip(v.astype(kind) @ queries.T.astype(kind), LOWEST, HIGHEST).astype(np.int64)
                c, q = np.nonzero(candidates_of(scores, ids[:, None] != query_ids, k))
                held = first_rows(held, [q, ids[c], scores[c, q]], k)
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[1]), pa.array(held[2])], ["q", "id", "score"])

    return run


def kth_values(candidates: DataFrame, queries: np.ndarray, query_ids: np.ndarray, low: int, span: int, k: int) -> np.ndarray:
    """The exact k-th best score of each query, -inf where there are fewer candidates. Its driver state is a few numbers per query of the block."""
    bits = max(1, span.bit_length())
    shift = max(0, bits - BINS)
    floor, short = np.full(len(queries), float(low)), np.zeros(len(queries), bool)
    while True:
        counts = candidates.mapInArrow(histograms(queries, query_ids, floor, shift, k), "q int, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q").orderBy(F.col("bin").desc())
        found = counts.withColumn("reached", F.sum("n").over(w)).filter(F.col("reached") >= k).groupBy("q").agg(F.max("bin").alias("bin")).toPandas()
        hit = np.full(len(queries), -1, np.int64)
        hit[found["q"].to_numpy(int)] = found["bin"].to_numpy(np.int64)
        short |= hit < 0
        floor = np.where(hit >= 0, floor + np.ldexp(np.maximum(hit, 0).astype(float), shift), floor)
        if shift == 0:
            return np.where(short, -np.inf, floor)
        shift = max(0, shift - BINS)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score) for each row that ``is_query`` selects, against all rows."""
    spark = vectors.sparkSession
    ready, _ = cut(integers(vectors, is_query, id_col, vector_col, scale))
    result = None
    kinds = ready.groupBy(F.size("v").alias("dim"), "large").agg(
        F.count_if("q").alias("queries"), F.max(F.greatest(F.array_max("v"), -(F.array_min("v") + 1))).alias("top")).collect()  # two per vector length
    mixed = {r["dim"] for r in kinds if r["large"]}
    for dim, large, n, top in sorted(map(tuple, kinds), key=lambda r: r[:2]):
        same = ready.filter(F.size("v") == dim)
        ordinary = same.filter(~F.col("large")).select("id", "v")
        bound = max(1, dim * (int(top or 0) + 1) ** 2)
        blocks = max(1, -(-n * max(dim, 1) * 8 // block_bytes))
        for block in range(blocks):
            chosen = same.filter(F.col("q") & (F.col("large") == large)).filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v").toArrow()
            if not chosen.num_rows:
                continue
            ids = chosen.column(0).to_numpy()
            wholes = chosen.column(1).combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
            found, schema = None, "q int, id long, score long"
            if not large:
                least = kth_values(ordinary, wholes.astype(np.float64), ids, -bound, 2 * bound + 1, k)
                found = ordinary.mapInArrow(reaching(wholes.astype(np.float64), ids, least, k), schema)
            if dim in mixed:
                apart = (same if large else same.filter("large")).select("id", "v").mapInArrow(exactly(wholes, ids, k), schema)
                found = apart if found is None else found.unionByName(apart)
            w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
            named = spark.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids)}))
            part = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(named, "q").select("query_id", "rank", "id", "score")
            part = part if blocks == 1 else cut(part)[0]
            result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    return result
