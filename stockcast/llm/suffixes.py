"""Removal of repeated byte strings: equal hashes of windows, sought bucket by bucket after a prefilter by a difference cover.

A byte goes if it lies in a string of ``window`` bytes that also starts in a
document with a smaller identifier. Only the equality of ``window`` bytes matters,
so windows are sorted by 64-bit or wider hashes of them, not by content: there is
no suffix order, no ranks that break ties, and equal hashes are taken for equal
bytes without comparing these. Never all at once:

1. Cover sample. A difference cover D modulo v gives every pair of positions an
   offset below v that takes both into the sample (positions whose residue is in
   D). Equal strings of ``window`` bytes therefore share a sampled string of
   ``window - v + 1`` bytes. It is found out first whether that is unique or
   shared, one bit. A suffix whose sampled strings are all unique has no equal and is dropped.
2. Blocks. The suffixes left are dealt into buckets by a hash of their string, and
   one bucket's hashes are sorted at a time; equal ones are ordered by document.

Documents whose whole text also belongs to a smaller identifier lose it all and
take no part; they are found by their SHA-256.

Texts are shuffled once, into chunks of bounded bytes and consecutive
identifiers. All else that travels are sorted lists of hashes, delta-coded, from
each chunk to each bucket, and one bit per entry back; within a chunk equals are
found on the spot, so an entry travels once per chunk however often it occurs.
Memory holds one chunk or one bucket. Hashes are rolling products; their width
grows with twice the logarithm of the input, so that the expected number of false
matches stays far below one at any size.

Defined cases: null and empty texts have no bytes; texts shorter than the window
keep all; rows with one identifier are no smaller than each other and do not
remove each other; rows without identifier come after all others and do not
remove each other either; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from stockcast.llm.common import cut, whole

#: perfect difference covers: modulus and residues (fixed values)
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
CHUNK_BYTES = 4_000_000
BUCKET_ENTRIES = 2_000_000
LEAST_BUCKETS = 64
SLICE = 1 << 19
U = np.uint64
REPLY = "chunk int, stage int, bucket int, n int, bits binary"
LISTS = "bucket int, chunk int, ord int, n int, body binary"


def powers(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, base**i and its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    base = U(int(rng.integers(2**62, 2**63)) * 2 + 5 | 1)
    inverse = U(pow(int(base), -1, 2**64))
    n = SLICE + 256
    up, down = (np.cumprod(np.concatenate([[U(1)], np.full(n, b, U)]), dtype=U) for b in (base, inverse))
    return values, up, down


class Hasher:
    def __init__(self, seed: int):
        self.values, self.up, self.down = powers(seed)

    def at(self, data: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
        """Hashes of ``length`` bytes at sorted positions, a slice of the data at a time."""
        out = np.empty(len(positions), U)
        for a in range(0, len(data), SLICE):
            i, j = np.searchsorted(positions, [a, a + SLICE])
            if i == j:
                continue
            piece = self.values[data[a:a + SLICE + length]] * self.up[:len(data[a:a + SLICE + length])]
            sums = np.concatenate([[U(0)], np.cumsum(piece, dtype=U)])
            p = positions[i:j] - a
            h = (sums[p + length] - sums[p]) * self.down[p]
            h ^= h >> U(32)
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
            h *= U(0xBF58476D1CE4E5B9)
            out[i:j] = h ^ (h >> U(32))
        return out


class Plan:
    """Numbers that all tasks agree on."""

    def __init__(self, window: int, total: int, chunks: int, chunk_bytes: int):
        self.window, self.chunks = window, chunks
        fitting = [v for v in COVERS if v <= 0.7 * window]
        if not fitting or window > 250:
            raise ValueError("the window must have 10 to 250 bytes")
        self.period = max(fitting)
        self.cover = COVERS[self.period]
        self.anchor = window - self.period + 1
        size = max(2.0, math.log2(max(total, 2)))
        self.sample_bits = min(64, math.ceil(size - 2.3) + 8)
        self.extra = max(0, math.ceil((2 * size - 60) / 8))
        self.buckets = max(LEAST_BUCKETS, -(-int(total * len(self.cover) / self.period) // BUCKET_ENTRIES))


class Sorted:
    """Distinct keys of a chunk in order, and where each entry belongs."""

    def __init__(self, h: np.ndarray, extra: np.ndarray | None, doc: np.ndarray):
        order = np.argsort(h, kind="stable") if extra is None else np.lexsort((extra, h))
        h, extra = h[order], None if extra is None else extra[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        if extra is not None:
            fresh[1:] |= extra[1:] != extra[:-1]
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        self.keys, self.extra = h[first], None if extra is None else extra[first]
        self.group = np.empty(len(h), np.int64)
        self.group[order] = group
        docs = doc[order]  # ascending inside a group, as positions are
        self.least = docs[first]
        self.shared = self.least != docs[np.append(first[1:], len(h)) - 1] if len(first) else np.zeros(0, bool)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) * U(buckets)) >> U(32)


def packed(keys: np.ndarray, extra: np.ndarray | None, width: int) -> bytes:
    """Sorted keys as differences, byte planes of them compressed."""
    steps = np.diff(keys, prepend=U(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    if extra is not None:
        planes += np.ascontiguousarray(extra.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(body: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view(U).ravel(), dtype=U)
    if not width:
        return keys, None
    extra = np.zeros((n, 8), np.uint8)
    extra[:, :width] = raw[8 * n:].reshape(width, n).T
    return keys, extra.view(U).ravel()


class Chunk:
    """Documents of one chunk, by identifier, and what can be told from them alone."""

    def __init__(self, table: pa.Table, replies: pa.Table, plan: Plan):
        self.plan = plan
        table = table.sort_by("id")
        self.ids = table.column("id")
        texts = table.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()
        copies = {pair for r in replies.filter(pa.compute.equal(replies.column("stage"), 0)).to_pylist()
                  for pair in map(tuple, np.frombuffer(r["bits"], np.int64).reshape(-1, 2).tolist())}
        known = {i for i, _ in copies}
        self.copy = np.array([i in known and (i, signed(xxhash.xxh64_intdigest(t, 42))) in copies for i, t in zip(self.ids.to_pylist(), texts)], bool)
        self.lengths = np.array(list(map(len, texts)), np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        ids = self.ids.combine_chunks()
        known = ids.drop_null().to_numpy()
        self.rank = np.full(len(ids), len(ids), np.int64)  # those without identifier come last, all alike
        self.rank[:len(known)] = np.cumsum(np.diff(known, prepend=known[:1]) != 0) if len(known) else 0

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")

    def sample(self) -> tuple[np.ndarray, Sorted]:
        """Sampled positions and their sorted strings."""
        plan, places = self.plan, []
        for start, length, copy in zip(self.starts.tolist(), self.lengths.tolist(), self.copy.tolist()):
            if length >= plan.window and not copy:
                whole = np.arange(0, length - plan.anchor + 1, plan.period)[:, None] + np.array(plan.cover)
                places.append(start + whole.ravel()[whole.ravel() <= length - plan.anchor])
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        h = Hasher(11).at(self.data, at, plan.anchor) >> U(64 - plan.sample_bits) << U(64 - plan.sample_bits)
        return at, Sorted(h, None, self.rank[self.doc(at)])

    def candidates(self, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, Sorted]:
        """Positions whose string holds a shared sample, and their sorted strings."""
        plan = self.plan
        hit = at[shared]
        low = np.maximum(hit - plan.period + 1, self.starts[self.doc(hit)])
        depth = np.bincount(low, minlength=len(self.data) + 1) - np.bincount(hit + 1, minlength=len(self.data) + 1)[:len(self.data) + 1]
        found = np.flatnonzero(np.cumsum(depth)[:len(self.data)] > 0)
        doc = self.doc(found)
        fits = (found + plan.window <= self.ends[doc]) & ~self.copy[doc]
        found, doc = found[fits], doc[fits]
        extra = None
        if plan.extra:
            extra = Hasher(29).at(self.data, found, plan.window) & U((1 << 8 * plan.extra) - 1)
        return found, Sorted(Hasher(17).at(self.data, found, plan.window), extra, self.rank[doc])


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def lists(chunk: int, plan: Plan, s: Sorted, width: int) -> pa.Table:
    """One message per bucket that the chunk has keys for."""
    edges = np.searchsorted(bucket_of(s.keys, plan.buckets), np.arange(plan.buckets + 1))
    rows = [(b, chunk, min(chunk, plan.chunks), int(j - i), packed(s.keys[i:j], None if s.extra is None else s.extra[i:j], width))
            for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if j > i]
    columns = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["bucket", "chunk", "ord", "n", "body"])


def flags(replies: pa.Table, stage: int, s: Sorted, plan: Plan) -> np.ndarray:
    """Bits of the replies, in the order of the chunk's distinct keys."""
    out = np.zeros(len(s.keys), bool)
    edges = np.searchsorted(bucket_of(s.keys, plan.buckets), np.arange(plan.buckets + 1))
    for r in replies.filter(pa.compute.equal(replies.column("stage"), stage)).to_pylist():
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["bits"]), np.uint8), count=r["n"])
        out[edges[r["bucket"]]:edges[r["bucket"] + 1]] = bits
    return out


def answer(plan: Plan, stage: int, width: int):
    """For one bucket: sort all chunks' keys. Stage 1 asks which are in another chunk too, stage 2 which are in an earlier one."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["bucket", "chunk", "ord", "n"]).to_pylist()
        keys, extras = [], []
        for r, body in zip(rows, table.column("body")):
            k, x = unpacked(body.as_py(), r["n"], width)
            keys.append(k)
            extras.append(x)
        ends = np.cumsum([r["n"] for r in rows])
        orders = np.repeat(np.array([r["ord"] for r in rows], np.int32), [r["n"] for r in rows])
        h = np.concatenate(keys)
        del keys
        if width:
            x = np.concatenate(extras)
            order = np.lexsort((orders, x, h))
        else:
            order = np.argsort(h, kind="stable")
        h = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        if width:
            x = x[order]
            fresh[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(h)))
        if stage == 1:
            hit = np.repeat(size > 1, size)
        else:
            sorted_orders = orders[order]
            hit = sorted_orders > np.repeat(np.minimum.reduceat(sorted_orders, first), size)
        bits = np.zeros(len(h), bool)
        bits[order] = hit
        out = []
        for r, end in zip(rows, ends.tolist()):
            own = bits[end - r["n"]:end]
            if own.any():
                out.append((r["chunk"], stage, r["bucket"], r["n"], zstandard.ZstdCompressor(level=1).compress(np.packbits(own).tobytes())))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                        names=["chunk", "stage", "bucket", "n", "bits"])

    return run


def listed(table: pa.Table) -> pa.Table:
    """Copies of one chunk as one message of stage 0: (identifier, hash) pairs."""
    pairs = np.column_stack([table.column("id").to_numpy(), table.column("h").to_numpy()]).astype(np.int64)
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "stage": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()),
                     "n": pa.array([len(pairs)], pa.int32()), "bits": pa.array([pairs.tobytes()], pa.binary())})


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def bounds(sizes: DataFrame, chunks: int) -> np.ndarray:
    """Approximate quantiles of the identifiers, in two levels, so that no aggregate holds more than about the root of their number."""
    side = max(1, math.isqrt(chunks - 1) + 1)
    shares = [i / side for i in range(1, side)]
    if not shares:
        return np.empty(0, np.int64)
    accuracy = 50 * side
    top = sizes.agg(F.percentile_approx("id", shares, accuracy).alias("q")).first()["q"] or []
    group = F.aggregate(F.lit(top).cast("array<bigint>"), F.lit(0), lambda n, x: n + (F.col("id") >= x).cast("int"))
    inner = sizes.groupBy(group.alias("g")).agg(F.percentile_approx("id", shares, accuracy).alias("q")).collect()
    return np.unique(np.array([x for r in inner for x in r["q"]] + list(top), np.int64))


def repeated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
             keep_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256, kept) per row; spans are the removed runs, ``kept`` the bytes left if asked for."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    size = F.octet_length("text").cast("long")
    sums = base.agg(F.coalesce(F.sum(size), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("id").isNull(), size)), F.lit(0)).alias("lost")).first()
    edges = bounds(base.filter("id IS NOT NULL").select("id"), max(1, -(-sums["all"] // chunk_bytes)))
    plan = Plan(window, sums["all"], len(edges) + 1, chunk_bytes)

    @F.arrow_udf("int")
    def chunk_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.fill_null(0).to_numpy(), "right"), pa.int32())

    spread = F.lit(plan.chunks) + F.pmod(F.xxhash64("text"), F.lit(max(1, -(-sums["lost"] // chunk_bytes)))).cast("int")
    dealt = base.withColumn("chunk", F.when(F.col("id").isNull(), spread).otherwise(chunk_of("id"))).repartition("chunk")
    by_chunk = dealt.groupBy("chunk")

    named = base.filter("id IS NOT NULL").select("id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"))
    least = named.groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    copies = named.join(least, "sha").filter("id > least").select(chunk_of("id").alias("chunk"), "id", "h").distinct()
    whole_copies = copies.groupBy("chunk").applyInArrow(listed, REPLY)
    whole_copies, _ = cut(whole_copies)

    def number(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def sampled(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return lists(0, plan, Sorted(np.empty(0, U), None, np.empty(0, np.int64)), 0)
        _, s = Chunk(table, replies, plan).sample()
        return lists(number(table), plan, s, 0)

    def narrowed(table: pa.Table, replies: pa.Table) -> tuple[Chunk, np.ndarray, Sorted]:
        chunk = Chunk(table, replies, plan)
        at, s = chunk.sample()
        shared = (flags(replies, 1, s, plan) | s.shared)[s.group]
        found, t = chunk.candidates(at, shared)
        return chunk, found, t

    def left_over(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, t = narrowed(table, replies)
        return lists(number(table), plan, t, plan.extra)

    def removed(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk, found, t = narrowed(table, replies)
        own = chunk.rank[chunk.doc(found)]
        gone = found[flags(replies, 2, t, plan)[t.group] | (own > t.least[t.group])]
        depth = np.bincount(gone, minlength=len(chunk.data) + 1)[:len(chunk.data) + 1]
        depth = depth - np.bincount(gone + window, minlength=len(chunk.data) + 1)[:len(chunk.data) + 1]
        mask = np.cumsum(depth)[:len(chunk.data)] > 0
        for d in np.flatnonzero(chunk.copy & (chunk.lengths >= window)).tolist():
            mask[chunk.starts[d]:chunk.ends[d]] = True
        spans, hashes, left = [], [], []
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist()):
            s, e = runs(mask[a:b])
            kept = chunk.data[a:b][~mask[a:b]].tobytes()
            spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
            hashes.append(hashlib.sha256(kept).hexdigest())
            left.append(kept if keep_bytes else None)
        return pa.table({
            "id": chunk.ids.cast(pa.int64()), "n_bytes": pa.array(chunk.lengths),
            "n_removed": pa.array([sum(x["end"] - x["start"] for x in s) for s in spans], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_sha256": pa.array(hashes, pa.string()), "kept": pa.array(left, pa.binary()),
        })

    first = by_chunk.cogroup(whole_copies.groupBy("chunk")).applyInArrow(sampled, LISTS).groupBy("bucket").applyInArrow(answer(plan, 1, 0), REPLY)
    first = first.unionByName(whole_copies)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(left_over, LISTS).groupBy("bucket").applyInArrow(answer(plan, 2, plan.extra), REPLY)
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(
        removed, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    )
