"""Hard-negative mining by Four-Russians scoring.

Candidates are kept as packed bit planes: the bits of one plane of eight
dimensions make a byte. For each anchor and group of eight dimensions a table
holds the sums of all 256 subsets of the anchor's entries, so a score is a sum of
table entries looked up by the candidate's bytes, one plane after the other,
shifted and added; the top plane counts negative. These are whole exact scores.

Anchors are taken in blocks of bounded table bytes, each against all rows. A
first pass keeps the best rows of the anchor's label in every task, a second one
the best rows of other labels within each positive's band; only those few leave
a task.

Defined cases: rows whose label, identifier or vector is null, or whose vector
holds null or non-finite entries, take no part; only vectors of the anchor's
length are scored; rows with the anchor's identifier are not its candidates;
repeated rows each take a place, ties go to the smaller identifier and equal
pairs stay apart by their place; an anchor row that repeats is answered once for
each; a positive without a negative in its band gives no row, so a negative
positive score gives none; entries are clipped to the range of a long, and so are
scores; identifiers are whole numbers, labels of any type; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from stockcast.llm.common import cut

BLOCK_BYTES = 16_000_000
SCORES = 1_000_000
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, bytes): two's-complement planes of each row, as few as it needs, packed by eight dimensions; rows are padded by empty bytes."""
    dim = x.shape[1]
    magnitude = np.where(x < 0, ~x, x).max(axis=1, initial=0)
    bits = np.array([int(m).bit_length() + 1 for m in magnitude], np.int32)
    wide = int(bits.max(initial=1))
    packed = np.stack([np.packbits((x >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(wide)], axis=1)
    return bits, packed.reshape(len(x), wide * -(-dim // 8))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, bits, planes) from (id, label, v)."""
    for batch in batches:
        lengths = batch.column(2).value_lengths().to_numpy()
        for dim in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            x = rows.column(2).flatten().to_numpy().reshape(len(rows), dim)
            bits, packed = planes(x)
            groups = -(-int(dim) // 8)
            data = [row[:b * groups].tobytes() for row, b in zip(packed, bits.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.full(len(rows), dim, np.int32)), pa.array(bits), pa.array(data, pa.binary())], ["id", "label", "dim", "bits", "planes"])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, subset, anchor): sums of the entries that a byte's bits name, built up bit by bit."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((n, groups * 8), anchors.dtype)
    padded[:, :dim] = anchors
    entries = padded.reshape(n, groups, 8).transpose(1, 2, 0)
    table = np.zeros((groups, 256, n), anchors.dtype)
    for bit in range(8):
        table[:, 1 << bit:2 << bit] = table[:, :1 << bit] + entries[:, bit:bit + 1]
    return table


def looked_up(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Scores (candidate, anchor) from planes (candidate, plane, group)."""
    total = None
    for plane in range(packed.shape[1] - 1, -1, -1):  # from the top plane, which counts negative, downwards
        level = np.zeros((len(packed), table.shape[2]), table.dtype)
        for group in range(table.shape[0]):
            level += table[group][packed[:, plane, group]]
        total = -level if total is None else total * 2 + level
    return total


class Block:
    """Anchors of one vector length, and their tables where a task needs them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(ids, labels, scores) for slices of candidates of the same length and number of planes; scores are (candidate, anchor)."""
        dim, groups = self.vectors.shape[1], -(-self.vectors.shape[1] // 8)
        tables: dict[type, np.ndarray] = {}
        step = max(1, SCORES // len(self.ids))
        for batch in batches:
            bits = batch.column(3).to_numpy()
            for b in np.unique(bits):
                rows = batch.take(pa.array(np.flatnonzero(bits == b)))
                # all sums on the way are below dim * largest * 2 ** bits
                kind = np.int64 if dim * self.largest << int(b) < 2**62 else object
                if kind not in tables:
                    tables[kind] = subset_sums(self.vectors.astype(kind))
                for at in range(0, len(rows), step):
                    piece = rows.slice(at, step)
                    packed = np.frombuffer(b"".join(piece.column(4).to_pylist()), np.uint8).reshape(len(piece), b, groups)
                    scores = looked_up(tables[kind], packed)
                    if kind is object:
                        scores = np.clip(scores, LOWEST, HIGHEST).astype(np.int64)
                    yield piece.column(0).to_numpy(), piece.column(1).to_numpy(), scores


def first_rows(held: list[np.ndarray], found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first k (slot, id, score) of each slot, by falling score and rising identifier."""
    held = [np.concatenate(x) for x in zip(held, found)]
    order = np.lexsort((held[1], ~held[2], held[0]))
    held = [x[order] for x in held]
    place = np.arange(len(order)) - np.searchsorted(held[0], held[0], "left")
    return [x[place < k] for x in held]


def nothing() -> list[np.ndarray]:
    return [np.empty(0, np.int64)] * 3


def candidates_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Which allowed scores reach the k-th best allowed one of their anchor in this slice."""
    if len(scores) <= k:
        return allowed
    shown = np.where(allowed, scores, LOWEST)
    return allowed & (shown >= np.partition(shown, len(shown) - k, axis=0)[len(shown) - k])


def same_label(block: Block, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's first k rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = nothing()
        for ids, labels, scores in block.scored(batches):
            c, q = np.nonzero(candidates_of(scores, (labels[:, None] == block.labels) & (ids[:, None] != block.ids), k))
            held = first_rows(held, [q, ids[c], scores[c, q]], k)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["slot", "id", "score"])

    return run


def in_bands(block: Block, low: np.ndarray, high: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's first k rows of other labels in each band; ``low`` and ``high`` are (band, anchor), the slot is anchor * bands + band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = nothing()
        for ids, labels, scores in block.scored(batches):
            other = (labels[:, None] != block.labels) & (ids[:, None] != block.ids)
            for band in range(len(low)):
                c, q = np.nonzero(candidates_of(scores, other & (scores >= low[band]) & (scores <= high[band]), k))
                held = first_rows(held, [q * len(low) + band, ids[c], scores[c, q]], k)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["slot", "id", "score"])

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``low`` and ``high`` bound a negative's score in hundredths of the positive's.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    usable = v.isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ready = vectors.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    code = F.col("label").cast("long") if isinstance(ready.schema["label"].dataType, IntegralType) else F.xxhash64("label")
    ready = ready.withColumn("label", code)
    anchors, _ = cut(ready.filter("anchor").select("id", "label", "v"))
    packed, _ = cut(ready.select("id", "label", "v").mapInArrow(pack, "id long, label long, dim int, bits int, planes binary"))
    result = None
    lengths = anchors.groupBy(F.size("v").alias("dim")).count().collect()  # few: one per vector length
    for dim, n in sorted(map(tuple, lengths)):
        candidates = packed.filter(F.col("dim") == dim)
        blocks = max(1, -(-n * 256 * 8 * -(-dim // 8) // block_bytes))
        for at in range(blocks):
            chosen = anchors.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == at)).toArrow()
            if not chosen.num_rows:
                continue
            block = Block(chosen.column(0).to_numpy(), chosen.column(1).to_numpy(), chosen.column(2).combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, dim))
            best, _ = cut(ranked(candidates.mapInArrow(same_label(block, positives), "slot long, id long, score long"), positives))
            bands_low, bands_high = np.full((positives, len(block.ids)), 1), np.zeros((positives, len(block.ids)), np.int64)
            for q, p, rank in best.select("slot", "score", "rank").toArrow().to_pandas().itertuples(index=False):
                lowest, highest = -(-low * int(p) // 100), high * int(p) // 100
                if lowest <= highest:
                    bands_low[rank - 1, q], bands_high[rank - 1, q] = lowest, highest
            found = ranked(candidates.mapInArrow(in_bands(block, bands_low, bands_high, negatives), "slot long, id long, score long"), negatives)
            names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(block.ids))), "anchor_id": pa.array(block.ids)}))
            positive = best.join(names, best["slot"] == names["q"]).select(
                (F.col("slot") * positives + F.col("rank") - 1).alias("slot"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            part = found.join(positive, "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            part = part if blocks == 1 else cut(part)[0]
            result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return result
