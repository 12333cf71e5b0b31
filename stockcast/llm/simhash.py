"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ by at most 2 bits are cut into two 32-bit segments, one
fewer than an exact match would need: one segment then differs by at most one
bit. Each segment is indexed under its 32 one-wildcard variants (one bit
deleted), so such segments share a variant; fingerprints that meet under one are
verified by their bit distance. Only distinct fingerprints are indexed, however
many copies they have. A variant shared by more than ``BUCKET`` fingerprints, or
by so many that they would fill a task, is not paired out: its fingerprints are joined through the points at one bit's
distance instead. Two fingerprints within 2 bits share such a point, and a point
has 65 neighbours at most, so this is exact and bounded.

Links are joined to components by alternating minimum-star steps on distributed
tables, each step cut in the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle of all of them; rows without
identifier get their component's smallest identifier, null if it has none; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stockcast.llm.common import carried, cut, drop, fair_share, whole

SEED = 42
BUCKET = 64
SPACES = bytes(range(9, 14)) + b" "
SPREAD = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of the shingles of lower-cased words."""
    tokens = text.lower().split()  # bytes.split() cuts at \x20 and \x09-\x0d
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())]
    # count each bit over blocks of 255 hashes, eight bits at a time in byte lanes
    h = np.array(hashes, np.uint64)
    totals = np.zeros(64, np.int64)
    cuts = np.arange(0, len(h), 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & SPREAD, cuts)
        totals[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(totals * 2 > len(h))
    return sum(1 << int(b) for b in ones)


def fingerprint_arrow(words: int) -> Callable[[pa.Array], pa.Array]:
    def of(texts: pa.Array) -> pa.Array:
        found = (fingerprint(x or b"", words) for x in texts.cast(pa.binary()).to_pylist())
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64), pa.int64())

    return of


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, fp) per row, ``row`` with all columns too if asked for."""
    found = F.arrow_udf(fingerprint_arrow(words), "long")
    return docs.select(
        *([carried(docs).alias("row")] if carry else []), F.col(id_col).alias("id"), found(F.col(text_col)).alias("fp")
    )


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 32 one-wildcard variants of both segments. The key packs the 31 kept bits, the wildcard's place and the segment."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = fps.select("fp", F.explode(F.array(
        F.struct(low.alias("part"), F.lit(0).cast("long").alias("segment")), F.struct(high.alias("part"), F.lit(1).cast("long").alias("segment"))
    )).alias("s")).select("fp", "s.*")
    spread = both.select("fp", "part", "segment", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("place"))
    kept = F.expr("part & ~shiftleft(1L, place)")
    return spread.select(
        F.expr("shiftleft(segment * 32 + place, 32)").bitwiseOR(kept).alias("key"), "fp"
    )


def near(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def crowded_keys(fps: DataFrame, rows: int) -> DataFrame:
    """Keys that would fill a task, told from every 64th fingerprint: a few per partition at most. Balance rests on it, results don't."""
    limit = max(16, fair_share(fps.sparkSession, 64 * rows) // 128)
    return variants(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0)).groupBy("key").count().filter(F.col("count") > limit).select("key")


def links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct (a, b) of linked fingerprints, enough to connect each component; ``fps`` is distinct. ``bits`` is 1 or 2."""
    if bits not in (1, 2):
        raise ValueError("two segments with one wildcard cover a distance of 1 or 2")
    full, _ = cut(crowded_keys(fps, fps.count()))
    # one shuffle of the variants; what is alone under its key, nearly all, ends here
    met = variants(fps).join(F.broadcast(full), "key", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    met, _ = cut(met)
    few = met.filter(F.col("n") <= bucket)
    checked = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter("a < b").select("a", "b")
    checked = checked.filter(near("a", "b", bits))
    crowd = met.filter(F.col("n") > bucket).select("fp").unionByName(variants(fps).join(F.broadcast(full), "key").select("fp")).distinct()
    flips = F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))")
    points = crowd.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    if bits == 2:  # all fingerprints around a point are within 2 bits of each other: a star connects them
        stars = points.join(points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"), "point")
        stars = stars.filter("a <> fp").select("a", F.col("fp").alias("b"))
    else:
        stars = points.filter("point <> fp").join(crowd.select(F.col("fp").alias("point")), "point").filter("fp < point").select(
            F.col("fp").alias("a"), F.col("point").alias("b"))
    return checked.unionByName(stars).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the smallest node of the component."""
    spark = edges.sparkSession
    now, path = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("a", "u").withColumnRenamed("b", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours go to the smallest one around
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small_least, "b")
        small = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small_least.select(F.col("m").alias("a"), "b")).distinct()
        new, new_path = cut(small)
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        drop(spark, path)
        now, path = new, new_path
        if seen == state:
            break
        state = seen
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def components(marked: DataFrame, bits: int = 2, bucket: int = BUCKET, by: str = "id") -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``marked`` (id, fp); component_id is the least ``by`` of the component."""
    groups, _ = cut(marked.groupBy("fp").agg(F.min(by).alias("least")))
    found = roots(links(groups.select("fp"), bits, bucket))
    labelled = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled, _ = cut(labelled)
    return labelled.join(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row."""
    marked, _ = cut(fingerprints(docs, words, id_col, text_col))
    return marked.join(components(marked, bits), "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One text of each component, that of the smallest identifier, with all columns.

    Of several texts with that identifier, and where no row of a component has an
    identifier, the one with the smallest hash stays. Exact copies of the text that
    stays are kept if they have its identifier or none: they are another operator's
    work. Only the identifiers and text hashes of dropped rows are joined to the
    texts, so the texts are not shuffled when that table is small enough to be
    broadcast.
    """
    found = F.arrow_udf(fingerprint_arrow(words), "long")
    marked, _ = cut(docs.select(
        F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("hash")).alias("key"),
        found(F.col(text_col)).alias("fp"),
    ))
    stays = (F.col("key.hash") == F.col("component_id.hash")) & (F.col("key.unnamed") | F.col("key.id").eqNullSafe(F.col("component_id.id")))
    gone, _ = cut(
        marked.join(components(marked, bits, by="key"), "fp").filter(~stays)
        .select(F.col("key.id").alias("gone_id"), F.col("key.hash").alias("gone_hash")).distinct()
    )
    own = F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone_id")) & (F.xxhash64(whole(f"row.`{text_col}`")) == F.col("gone_hash"))
    return docs.select(carried(docs).alias("row")).join(gone, own, "left_anti").select("row.*")
