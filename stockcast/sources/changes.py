"""Tables that take small upserts: changes are appended, readers merge, compaction folds them together.

A table is a list of folders, oldest first. An upsert writes one more folder with
a file for each hash bucket of the keys it touches, and publishes a manifest: the
list with that folder at its end. The place in the list is the sequence number;
of the rows of one key the last folder's counts. Nothing is rewritten, so a row
costs one small file however large the table is.

Compaction replaces neighbouring folders by one that holds their merged rows: all
but the oldest after ``MAX_CHANGES`` upserts, so a reader has few folders and the
large one is left alone, or the whole table if asked to. Manifests are created
only if their number is free. A writer who comes second adds its folder to the
other's list: the rows are not written again.

Defined cases: a folder without manifest (its writer died) is never read; null
keys are a key; an upsert without rows publishes nothing; a table that was never
written reads as empty. Changes must hold one row per key.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stockcast.sources import shared, store

BUCKETS = 64
MAX_CHANGES = 16
BUCKET, SEQUENCE = "_bucket", "_sequence"
GRACE = 10  # looks at a manifest that is still empty, a fifth of a second apart, before its writer counts as dead


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def live(spark: SparkSession, path: str) -> tuple[int, int | None, list[str]]:
    """Number of the newest manifest, the table's bucket count and its folders, oldest first."""
    newest = store.published(spark, path)
    if newest is None:
        return -1, None, []
    buckets, *folders = newest[1].split("\n")
    return newest[0], int(buckets), folders


def _commit(spark: SparkSession, path: str, buckets: int, change: Callable[[list[str]], list[str] | None]) -> bool:
    """Publish ``change`` of the newest list, made anew whenever another writer was first; false if it gives none."""
    for _ in range(store.ATTEMPTS):
        for _ in range(GRACE):
            taken = max(shared.numbered(spark, f"{path}/{store.MANIFESTS}"), default=-1)
            number, known, folders = live(spark, path)
            if taken <= number:
                break
            time.sleep(0.2)
        if known not in (None, buckets):
            raise ValueError(f"the table has {known} buckets, not {buckets}")
        wanted = change(folders)
        if wanted is None:
            return False
        text = "\n".join([str(buckets), *wanted]) + "\n"
        if shared.create(spark, f"{path}/{store.MANIFESTS}/{max(taken, number) + 1:012d}", text):
            return True
    raise store.SnapshotConflict(f"{store.ATTEMPTS} attempts met other writers")


def _write(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> str:
    """Rows in a new folder, few files a bucket, while a bucket with very many rows is still split."""
    folder = f"rows-{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, _bucket(keys, buckets)).hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    return folder


def upsert(
    spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], schema: str, buckets: int = BUCKETS, max_changes: int = MAX_CHANGES
) -> None:
    """Add or replace rows by key; ``buckets`` counts when the table is made, later the table's own number does."""
    buckets = live(spark, path)[1] or buckets
    wanted = StructType.fromDDL(schema)
    folder = _write(changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]), path, keys, buckets)
    if not any(name.startswith(f"{BUCKET}=") for name, _ in shared.folders(spark, f"{path}/{folder}")):
        shared.remove(spark, f"{path}/{folder}")  # no rows
        return
    _commit(spark, path, buckets, lambda folders: [*folders, folder])
    if len(live(spark, path)[2]) > max_changes:
        compact(spark, path, keys, schema)


def _stored(spark: SparkSession, path: str, folders: Sequence[str], schema: str) -> DataFrame:
    """All rows of some folders with bucket and sequence number; compaction keeps the folders few."""
    names = StructType.fromDDL(schema).fieldNames()
    table = spark.read.schema(f"{schema}, {BUCKET} int")
    parts = [
        table.parquet(f"{path}/{folder}").select(*names, BUCKET, F.lit(i).alias(SEQUENCE))
        for i, folder in enumerate(folders)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _merged(rows: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).fieldNames()
    rest = [c for c in names if c not in keys]
    if not rest:
        return rows.select(*names).distinct()
    if len(rest) == 1:  # a value by a number: a hash aggregate
        return rows.groupBy(*keys).agg(F.max_by(rest[0], SEQUENCE).alias(rest[0])).select(*names)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), SEQUENCE).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.`{c}`").alias(c) for c in names])


def read(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The table as published now: the last row of each key. One folder alone is read without a shuffle."""
    _, _, folders = live(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = _stored(spark, path, folders, schema)
    return rows.drop(BUCKET, SEQUENCE) if len(folders) == 1 else _merged(rows, keys, schema)


def rows_of(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """The rows of the wanted keys (null keys are none of them); the join on the bucket spares the files of other buckets."""
    _, buckets, folders = live(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    asked = wanted.select(*keys).distinct().withColumn(BUCKET, _bucket(keys, buckets))
    return _merged(_stored(spark, path, folders, schema).join(asked, [BUCKET, *keys], "left_semi"), keys, schema)


def compact(spark: SparkSession, path: str, keys: Sequence[str], schema: str, whole: bool = False) -> bool:
    """Replace all folders but the oldest, or with ``whole`` all of them, by one; false if there was nothing to do.

    Upserts published meanwhile stay behind the new folder. If another
    compaction was first, this one's folder goes.
    """
    _, buckets, folders = live(spark, path)
    old = folders if whole else folders[1:]
    if len(old) < 2:
        return False
    folder = _write(_merged(_stored(spark, path, old, schema), keys, schema), path, keys, buckets)

    def replaced(now: list[str]) -> list[str] | None:
        at = now.index(old[0]) if old[0] in now else -1
        return [*now[:at], folder, *now[at + len(old):]] if at >= 0 and now[at:at + len(old)] == old else None

    done = _commit(spark, path, buckets, replaced)
    if not done:
        shared.remove(spark, f"{path}/{folder}")
    return done


def expire(spark: SparkSession, path: str, older_than_seconds: int = 86_400) -> int:
    """Remove folders that the newest manifest does not name and that have some age; returns their number.

    A reader may still be on a replaced folder and a writer on one not yet
    published, so young folders stay.
    """
    kept, gone = set(live(spark, path)[2]), 0
    for name, age in shared.folders(spark, path):
        if name.startswith("rows-") and name not in kept and age >= older_than_seconds:
            shared.remove(spark, f"{path}/{name}")
            gone += 1
    return gone
