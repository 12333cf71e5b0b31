"""Embedding whitening by weighted multiplicity covariance.

Identical whole-number vectors are grouped first; a group counts once in the fit,
or as often as it has rows. Three passes go over the distinct vectors, each a sum
of one small matrix per task: exact column sums, the centred weighted product,
and the covariance of what was whitened. Every distinct vector is whitened once
and joined back to its rows; groups that hold more rows than a fair share are
broadcast for that (their number is bounded).

Defined cases: vectors that are null or hold null or non-finite entries are
dropped; entries are clipped to the range of a long; each vector length is
a space of its own with its own fit; vectors of fewer than ``components`` entries
have as many components as entries, and empty ones give no row; where the fit list
does not vary along a component, ``whitened`` is null, and ``explained`` too
where it does not vary at all; a deviation beyond a long is given as the largest
long; rows that repeat and rows without identifier are each answered; other
columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockcast.llm.common import cut, lookup

LONGEST = 2**63 - 1
#: an eigenvalue below this share of the trace, times the length, is rounding
FLAT = 1e-14


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors that take part, entries as floor(scale * c)."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(usable).select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, matrix, copies) for each vector length of a batch with the columns x and copies."""
    column, copies = batch.column(0), batch.column(1).to_numpy()
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == dim)
        yield places, column.take(pa.array(places)).flatten().to_numpy().reshape(-1, dim), copies[places]


def column_sums(counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the three 22-bit limbs of every column, so that no sum leaves a long; one set per length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, copies in by_length(batch):
                w = copies if counted else np.ones_like(copies)
                limbs = [x >> 44, x >> 22 & 0x3FFFFF, x & 0x3FFFFF]
                found = np.stack([w @ part for part in limbs] + [np.full(x.shape[1], w.sum())])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + found
        for dim, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, found)], ["dim", "place", "high", "middle", "low", "n"])

    return run


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x minus the mean, which is ``whole`` + ``part``: the large part is taken off exactly."""
    if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 2**61:
        return (x - whole).astype(np.float64) - part
    return x.astype(np.float64) - whole - part


def products(means: dict[int, tuple[np.ndarray, np.ndarray]], counted: bool):
    """The upper triangle of the weighted product of centred vectors; one per length and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, copies in by_length(batch):
                d = centred(x, *means[x.shape[1]])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + d.T @ (d * copies[:, None] if counted else d)
        for dim, found in sums.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(found[i, j])], ["dim", "i", "j", "value"])

    return run


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int]:
    """The exact sum over columns of (n * x - sum) ** 2 of each row."""
    largest = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if largest < 2**53:
        t = n * x - np.array(sums, np.int64)
        high, low = t >> 26, t & 0x3FFFFFF
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        found = ((int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip(*parts))
    else:
        found = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
    return [min(value, LONGEST) for value in found]


def whitened(fits: dict[int, dict]):
    """Adds the deviation and the whitened coordinates to (x, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, coordinates = [0] * batch.num_rows, [[]] * batch.num_rows
            for places, x, _ in by_length(batch):
                fit = fits[x.shape[1]]
                w = centred(x, *fit["mean"]) @ fit["project"]
                for place, value, row in zip(places.tolist(), deviations(x, fit["sums"], fit["n"]), w.tolist()):
                    deviation[place], coordinates[place] = value, [None if flat else c for c, flat in zip(row, fit["flat"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviation, pa.int64()), pa.array(coordinates, pa.list_(pa.float64()))], ["x", "copies", "deviation", "whitened"])

    return run


def fit(groups: DataFrame, components: int, counted: bool) -> dict[int, dict]:
    """Mean, projection and explained shares per vector length; the driver holds one matrix per length."""
    sums = groups.mapInArrow(column_sums(counted), "dim int, place int, high long, middle long, low long, n long").groupBy("dim", "place").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "middle", "low", "n")]).collect()
    fits: dict[int, dict] = {}
    for row in sums:
        one = fits.setdefault(row["dim"], {"n": int(row["n"]), "sums": [0] * row["dim"]})
        one["sums"][row["place"]] = (int(row["high"]) << 44) + (int(row["middle"]) << 22) + int(row["low"])
    for one in fits.values():
        one["mean"] = (np.array([s // one["n"] for s in one["sums"]], np.int64), np.array([s % one["n"] / one["n"] for s in one["sums"]]))
        one["v"] = np.zeros((len(one["sums"]),) * 2)
    means = {dim: one["mean"] for dim, one in fits.items()}
    found = groups.mapInArrow(products(means, counted), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).toArrow()
    dims, i, j, values = (found.column(c).to_numpy() for c in ("dim", "i", "j", "value"))
    for dim, one in fits.items():
        own = dims == dim
        one["v"][i[own], j[own]] = one["v"][j[own], i[own]] = values[own] / one["n"]
        e, vectors = np.linalg.eigh(one.pop("v"))
        trace, k = float(e.sum()), min(components, dim)
        e, vectors = e[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        one["flat"] = (e <= FLAT * dim * trace).tolist()
        one["project"] = vectors / np.sqrt(np.where(one["flat"], 1.0, e))
        one["explained"] = [float(x) / trace if trace > 0 else None for x in e]
    return fits


def identity_errors(ready: DataFrame, fits: dict[int, dict], counted: bool) -> dict[int, float | None]:
    """Largest entry of the whitened covariance minus the identity, over the components that vary."""
    if not fits:
        return {}
    w, k = F.col("copies").cast("double") if counted else F.lit(1.0), max((len(one["flat"]) for one in fits.values()), default=0)
    at = [F.try_element_at("whitened", F.lit(c + 1)) for c in range(k)]
    sums = ready.groupBy(F.size("x").alias("dim")).agg(
        *[F.sum(w * at[c]).alias(f"s{c}") for c in range(k)], *[F.sum(w * at[a] * at[b]).alias(f"p{a}_{b}") for a in range(k) for b in range(a, k)]).collect()
    errors: dict[int, float | None] = {}
    for row in sums:
        one = fits.get(row["dim"])
        live = [c for c, flat in enumerate(one["flat"]) if not flat] if one else []
        off = [abs(row[f"p{a}_{b}"] / one["n"] - row[f"s{a}"] * row[f"s{b}"] / one["n"] ** 2 - (a == b)) for a in live for b in live if a <= b]
        errors[row["dim"]] = max(off, default=None)
    return errors


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, counted: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) for each row that takes part.

    ``n`` is the weight of the fit list: the distinct vectors, or their rows if ``counted``.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, id_col, vector_col)
    groups, _ = cut(rows.groupBy("x").agg(F.count("*").alias("copies")))
    fits = fit(groups, components, counted)
    ready, _ = cut(groups.mapInArrow(whitened(fits), "x array<bigint>, copies long, deviation long, whitened array<double>"))
    errors = identity_errors(ready, fits, counted)
    known = spark.createDataFrame(
        [(dim, one["n"], one["explained"], errors.get(dim)) for dim, one in fits.items()], "dim int, n long, explained array<double>, identity_error double")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    found = lookup(rows, ready, "x", total).withColumn("dim", F.size("x"))
    return found.join(F.broadcast(known), "dim").select("id", "n", "deviation", "whitened", "explained", "identity_error")
