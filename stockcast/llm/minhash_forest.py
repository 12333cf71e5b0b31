"""MinHash near-duplicates by an LSH forest.

A document's set of word shingles gets ``TREES * DEPTH`` minima. Each tree is one
sorted order of all distinct sets by that tree's minima, so sets with a long
common prefix of minima lie next to each other. Candidates of a set are its
neighbours up to ``WINDOW`` places away that share a prefix of at least two
minima: where few sets share that prefix, all of them are met at that
depth; where many do, the order goes on by the deeper minima, and those that share
the longest prefixes are met. Pairs whose minima agree too rarely for the
similarity (five standard deviations below it) or whose sizes exclude it are left
out, the others are confirmed on the full sets.

A crowd of copies that are not quite near enough would give very many such pairs, of
which hardly one is a link. So its entries carry the parities of their sets: how many
of a set's hashes fall into each of ``PARITIES`` bins, modulo 2. What two sets share
cancels out, so they differ in at least as many hashes as in parities, and a pair
whose parities differ too often for the similarity can't be a link: this bound is
exact and leaves out no link.

Equal sets are one entry, however many rows have them. An order is cut into
ranges by the whole entry, so a region that shares a prefix may span many tasks;
neighbours across a cut are joined by their place.

A first pass gives each entry's best pair with an entry before it; the two best of
each set are confirmed, and their links make components. Sets in further pairs go
through a second pass, whose entries carry their component: it gives all pairs of
different components. A third one takes wider windows for sets that are still
alone in a crowd. Those are confirmed too, so components come out as if every
pair within a window had been, and a crowd of near copies gives no pairs that
would not change them.

A pair of similarity s shares a prefix of d minima in a tree with probability
s ** d. At 0.8 a pair that has to be met at depth 2 is missed by all 16 trees once
in 1e7, at depth 4 once in 1e6 / 0.6, at depth 6 once in 120; a component is
lost only if all its connecting pairs are missed. The README gives measured figures.

Defined cases: null, empty and blank texts have the empty set and are linked with
nothing; fewer words than a shingle make one shingle of all of them; equal sets
are linked whatever the texts; a row without identifier gets the smallest one of its
component, null if there is none; rows that repeat an identifier are judged by
their own text; texts are whole, however long; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stockcast.llm.common import cut, lookup, partitions
from stockcast.llm.simhash import roots

TREES, DEPTH, WINDOW, WIDER = 16, 12, 16, 8
MINIMA = TREES * DEPTH
PIECE = 2048
PARITIES = 1024
_draw = np.random.default_rng(20)
MASKS, FACTORS = (_draw.integers(0, 2**64, (MINIMA, 1), np.uint64, endpoint=False) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of lower-cased words."""
    tokens = (text or b"").lower().split()  # bytes.split() cuts at \x20 and \x09-\x0d, bytes.lower() changes A-Z alone
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[words - 1:].tolist())), np.uint64, len(tokens) - words + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest of the hashes under each of ``MINIMA`` mixings."""
    least = np.full(MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, ((hashes[at:at + PIECE] ^ MASKS) * FACTORS).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def described(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) rows with the size of the set, its 128-bit name and its minima; name and minima of the empty set are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, least = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                names.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                least.append(minima(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(least, pa.binary())], ["id", "key", "n", "node", "least"])

    return run


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of ``PARITIES`` bins is odd, in 64-bit words."""
    bins = (hashes >> np.uint64(64 - PARITIES.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def sets_of(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, members, odd) of texts; odd are the parities of the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text, words) for text in batch.column(0).cast(pa.binary()).to_pylist()]
            names = pa.array([xxhash.xxh128_digest(x.tobytes()) for x in found], pa.binary())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([x.view(np.int64) for x in found], [parities(x) for x in found])]
            yield pa.RecordBatch.from_arrays([names, *lists], ["node", "members", "odd"])

    return run


def sketches(least: np.ndarray) -> np.ndarray:
    """One bit of each of the minima, in 64-bit words."""
    return np.packbits((least & 1).astype(np.uint8), axis=1).view(np.int64)


SKETCH = [f"s{i}" for i in range(MINIMA // 64)]
ENTRY = ["tree", "prefix", "label", "node", "n", *SKETCH, "odd", "root"]
ENTRY_TYPES = "tree int, prefix long, label binary, node binary, n long, " + ", ".join(f"{s} long" for s in SKETCH) + ", odd array<bigint>, root binary"
FOUND_TYPES = f"a binary, b binary, agree int, part int, place long, {ENTRY_TYPES}"


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each tree from (node, n, least, odd, root)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        least = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, MINIMA)
        bits = [pa.array(x) for x in sketches(least).T]
        for tree in range(TREES):
            own = np.ascontiguousarray(least[:, tree * DEPTH:(tree + 1) * DEPTH])
            # the first two minima as a long in the same order as the label
            prefix = (own.view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
            labels = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree, np.int32)), pa.array(prefix), labels, batch.column(0), batch.column(1), *bits, batch.column(3), batch.column(4)], ENTRY)


def least_agreement(similarity: float) -> int:
    """Five standard deviations below the expected number of equal sketch bits."""
    p = (1 + similarity) / 2
    return int(MINIMA * p - 5 * (MINIMA * p * (1 - p)) ** 0.5)


def best_before(left: np.ndarray, right: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Which pairs are the best of their right end: the one that agrees most, of several the nearest."""
    order = np.lexsort((left, agree, right))
    last = np.append(right[order][1:] != right[order][:-1], True) if len(order) else np.zeros(0, bool)
    best = np.zeros(len(left), bool)
    best[order[last]] = True
    return best


def neighbours(percent: int, window: int, alone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs among a task's sorted entries.

    Without roots, each entry's best pair with one before it is given, and the
    nodes of all other pairs on rows without ``b``. With roots, all pairs of
    different roots are given, with ``alone`` only those of which an end is its own
    root. With parities, pairs that these exclude are not given. Also a task's first and last entries with their
    places, and a row with ``place`` and no node for its length.
    """
    lowest, names = least_agreement(percent / 100), ["a", "b", "agree", "part", "place", *ENTRY]

    def pairs_of(a: pa.Array, b: pa.Array, agree: pa.Array, types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a, b, agree, *(pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), *types))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, None

        def placed(rows: list[pa.Array], places: np.ndarray) -> pa.RecordBatch:
            n = len(places)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(np.full(n, part, np.int32)), pa.array(places), *rows], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if seen < window:
                edge = batch.slice(0, window - seen)
                yield placed(edge.columns, np.arange(seen, seen + edge.num_rows))
            known = held.num_rows if held is not None else 0
            rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if known else batch
            tree, prefix, n = (rows.column(i).to_numpy() for i in (0, 1, 4))
            bits = np.stack([rows.column(5 + i).to_numpy() for i in range(len(SKETCH))], axis=1).view(np.uint64)
            node, odd, root = rows.column(3), rows.column(ENTRY.index("odd")), rows.column(ENTRY.index("root"))
            odd = odd.flatten().to_numpy().view(np.uint64).reshape(-1, PARITIES // 64) if odd.null_count == 0 else None
            rooted = root.null_count == 0
            top = np.frombuffer(b"".join(root.to_pylist()), np.uint64).reshape(-1, 2) if rooted else None
            own = (np.frombuffer(b"".join(node.to_pylist()), np.uint64).reshape(-1, 2) == top).all(axis=1) if alone else None
            left, right, agree = [], [], []
            for step in range(1, window + 1):
                i = np.flatnonzero((prefix[:-step] == prefix[step:]) & (tree[:-step] == tree[step:]))
                i = i[i + step >= known]
                if rooted:
                    i = i[(top[i] != top[i + step]).any(axis=1)]
                if alone:
                    i = i[own[i] | own[i + step]]
                small, large = np.minimum(n[i], n[i + step]), np.maximum(n[i], n[i + step])
                i = i[100 * small >= percent * large]
                same = MINIMA - np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int32)
                keep = same >= lowest
                i, same = i[keep], same[keep]
                if odd is not None:
                    apart = np.bitwise_count(odd[i] ^ odd[i + step]).sum(axis=1, dtype=np.int64)
                    keep = apart * (100 + percent) <= (n[i] + n[i + step]) * (100 - percent)
                    i, same = i[keep], same[keep]
                left.append(i)
                right.append(i + step)
                agree.append(same)
            left, right, agree = map(np.concatenate, (left, right, agree))
            shown = np.ones(len(left), bool) if rooted else best_before(left, right, agree)
            yield pairs_of(node.take(pa.array(left[shown])), node.take(pa.array(right[shown])), pa.array(agree[shown].astype(np.int32)), rows.schema.types)
            more = node.take(pa.array(np.unique(np.concatenate([left[~shown], right[~shown]]))))
            yield pairs_of(more, pa.nulls(len(more), pa.binary()), pa.nulls(len(more), pa.int32()), rows.schema.types)
            seen += batch.num_rows
            held = rows.slice(max(0, rows.num_rows - window))
        if seen > window:
            tail = held.slice(max(0, held.num_rows - (seen - window)))
            yield placed(tail.columns, np.arange(seen - tail.num_rows, seen))
        if seen:
            yield placed([pa.nulls(1, t) for t in held.schema.types], np.array([seen]))

    return run


def across_cuts(found: DataFrame, percent: int, window: int, alone: bool) -> DataFrame:
    """Candidate pairs of entries that lie in different tasks of the sorted order."""
    spark = found.sparkSession
    lengths = dict(found.filter("part IS NOT NULL AND node IS NULL").select("part", "place").collect())  # one number per task
    starts, at = [], 0
    for part in sorted(lengths):
        starts.append((part, at))
        at += lengths[part]
    start = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    edges = found.filter("part IS NOT NULL AND node IS NOT NULL").join(start, "part").withColumn("place", F.col("place") + F.col("start"))
    edges = edges.withColumn("block", F.floor(F.col("place") / window))
    x = edges.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1))).alias("x")
    y = edges.alias("y")
    agree = MINIMA - sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in SKETCH), F.lit(0))
    near = (F.col("x.place") < F.col("y.place")) & (F.col("y.place") <= F.col("x.place") + window) & (F.col("x.part") != F.col("y.part"))
    alike = (F.col("x.tree") == F.col("y.tree")) & (F.col("x.prefix") == F.col("y.prefix"))
    alike &= ~F.col("x.root").eqNullSafe(F.col("y.root")) | F.col("x.root").isNull()
    if alone:
        alike &= (F.col("x.root") == F.col("x.node")) | (F.col("y.root") == F.col("y.node"))
    apart = F.aggregate(F.zip_with("x.odd", "y.odd", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, count: total + count)
    alike &= F.col("x.odd").isNull() | (apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    met = x.join(y, (F.col("x.block") == F.col("y.block")) & near & alike & sized)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), agree.cast("int").alias("agree")).filter(F.col("agree") >= least_agreement(percent / 100))


def candidates(sets: DataFrame, percent: int, window: int, alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b, agree) with a < b, and the nodes (node) that are in further pairs, from (node, n, least, root) of distinct sets, and their parities (odd) if they are there."""
    odd = F.col("odd") if "odd" in sets.columns else F.lit(None).cast("array<bigint>").alias("odd")
    sets = sets.select("node", "n", "least", odd, "root")
    order = ["tree", "prefix", "label", "node"]
    forest = sets.mapInArrow(entries, ENTRY_TYPES).repartitionByRange(partitions(sets.sparkSession), *order).sortWithinPartitions(*order)
    found, _ = cut(forest.mapInArrow(neighbours(percent, window, alone), FOUND_TYPES))
    pairs = found.filter("b IS NOT NULL").select("a", "b", "agree").unionByName(across_cuts(found, percent, window, alone))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "agree").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    return pairs, found.filter("a IS NOT NULL AND b IS NULL").select(F.col("a").alias("node")).distinct()


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their full sets."""
    side = {c: members.select(F.col("node").alias(c), F.col("members").alias(f"{c}_members")) for c in "ab"}
    both = pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b")
    shared = F.size(F.array_intersect("a_members", "b_members"))
    return both.filter(shared * 100 >= (F.size("a_members") + F.size("b_members") - shared) * percent).select("a", "b")


def best_of_each(pairs: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` pairs of each node that agree most; a node has at most 2 * TREES * WINDOW pairs."""
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    w = Window.partitionBy("a").orderBy(F.col("agree").desc(), "b")
    best = ends.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unconnected(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """Pairs (a, b, x, y) whose ends lie in different components x and y."""
    for end, top in (("a", "x"), ("b", "y")):
        pairs = pairs.join(tops.select(F.col("node").alias(end), F.col("root").alias(top)), end, "left").withColumn(top, F.coalesce(top, end))
    return pairs.filter("x <> y").select("a", "b", "x", "y")


def texts_of(pairs: DataFrame, sets: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(text): one text of each set that is in a pair."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "key", "copies"), "node").select("key", "copies")
    return lookup(texts, needed, "key", total).dropDuplicates(["key"]).select("text")


def linked(sets: DataFrame, texts: DataFrame, total: int, percent: int, words: int, window: int) -> DataFrame:
    """(node, root) of the nodes that are linked with another one; ``texts`` has (key, text), ``sets`` (node, n, least, key, copies)."""
    described_sets = sets.select("node", "n", "least")
    pairs, more = candidates(described_sets.withColumn("root", F.lit(None).cast("binary")), percent, window)
    pairs, _ = cut(pairs)
    crowded, _ = cut(more)
    of_pairs = pairs.select("a", "b").unionByName(crowded.select(F.col("node").alias("a"), F.col("node").alias("b")))
    members, _ = cut(texts_of(of_pairs, sets, texts, total).mapInArrow(sets_of(words), "node binary, members array<bigint>, odd array<bigint>").dropDuplicates(["node"]))
    tops, _ = cut(roots(confirmed(best_of_each(pairs, 2), members, percent)))
    # what those links leave apart: the pairs known so far, and all neighbours among the nodes that have more
    crowd = described_sets.join(crowded, "node", "left_semi").join(members.select("node", "odd"), "node")
    further, _ = candidates(with_roots(crowd, tops), percent, window)
    tops = merged(tops, unconnected(pairs.select("a", "b").unionByName(further.select("a", "b")).distinct(), tops), members, percent)
    # and for those of them that are still alone, wider windows
    wider, _ = candidates(with_roots(crowd, tops), percent, WIDER * window, alone=True)
    return merged(tops, unconnected(wider.select("a", "b"), tops), members, percent)


def with_roots(sets: DataFrame, tops: DataFrame) -> DataFrame:
    return sets.join(tops, "node", "left").select("node", "n", "least", "odd", F.coalesce("root", "node").alias("root"))


def merged(tops: DataFrame, apart: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, root) after the confirmed ones of the pairs (a, b, x, y) have joined their components x and y."""
    apart, _ = cut(apart)
    joined = apart.join(confirmed(apart, members, percent), ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    last, _ = cut(roots(joined).select(F.col("node").alias("root"), F.col("root").alias("last")))
    # a component's nodes first, then those that were alone until now
    known = tops.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    alone = last.join(tops.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("last").alias("root"))
    return cut(known.unionByName(alone))[0]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component_id) per row: the size of its set and the smallest identifier that links of ``percent`` similarity reach."""
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes")).alias("key"), text.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    marked, _ = cut(texts.mapInArrow(described(words), f"id {kind}, key struct<hash: bigint, bytes: int>, n long, node binary, least binary"))
    total = marked.count()
    sets, _ = cut(marked.filter("n > 0").groupBy("node", "n", "least").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.count("*").alias("copies")))
    tops = linked(sets, texts.select("key", "text"), total, percent, words, window)
    nodes, _ = cut(sets.select("node", "id", "copies").join(tops, "node", "left").withColumn("root", F.coalesce("root", "node")))
    components = nodes.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("copies"))
    named = lookup(nodes.select("root", "node", F.col("copies").alias("rows")), components, "root", nodes.count()).select("node", "component_id", F.col("rows").alias("copies"))
    rows = marked.select("id", "n", "node")
    found = lookup(rows.filter("node IS NOT NULL"), named, "node", total).select("id", "n", "component_id")
    return found.unionByName(rows.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id")))
