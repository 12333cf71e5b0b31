"""Whitening, hard negatives and the MinHash forest against plain versions."""

import math
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.llm import common, minhash_forest, negatives, queries, topk, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, slot int, n int, copies int"


def vectors(spark, rows, kind=VECTORS):
    names = ("id", "x", "slot", "n", "copies")
    return spark.createDataFrame([(*r, *("x" if c == "id" else 1 for c in names)) for r in rows], kind)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def scaled(v):
    return [max(-2**63, min(2**63 - 1, math.floor(256 * c))) for c in v]


def plain_fit(xs, weights):
    """Centred vectors, eigenvalues, axes and their sum; the centre is taken off in whole numbers."""
    n, sums = sum(weights), [sum(w * c for w, c in zip(weights, column)) for column in zip(*xs)]
    d, w = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in xs]), np.array(weights)
    v = (d * w[:, None]).T @ d / n
    e, vectors = np.linalg.eigh(v)
    return d, e[::-1], vectors[:, ::-1], e.sum()


def check_whitening(found, rows, counted=False, components=4):
    by_dim = defaultdict(list)
    for i, v in rows:
        if usable(v) and len(v):
            by_dim[len(v)].append((i, tuple(scaled(v))))
    want = defaultdict(list)
    for dim, own in by_dim.items():
        copies = defaultdict(int)
        for _, x in own:
            copies[x] += 1
        distinct = sorted(copies)
        weights = [copies[x] if counted else 1 for x in distinct]
        n, sums = sum(weights), [sum(w * x[j] for x, w in zip(distinct, weights)) for j in range(dim)]
        d, e, axes, trace = plain_fit(distinct, weights)
        k = min(components, dim)
        for i, x in own:
            place = distinct.index(x)
            want[i].append((n, min(2**63 - 1, sum((n * c - s) ** 2 for c, s in zip(x, sums))), [d[place] @ axes[:, c] / e[c] ** 0.5 if e[c] > 1e-9 * trace else None for c in range(k)],
                            [e[c] / trace if trace else None for c in range(k)]))
    got = defaultdict(list)
    for r in found.collect():
        got[r["id"]].append(r)
        live = [c for c in r["whitened"] if c is not None]
        assert r["identity_error"] is None and not live or r["identity_error"] < 1e-4
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in want.items()}
    signs = {}
    for i, found_rows in got.items():
        for r, (n, deviation, w, explained) in zip(sorted(found_rows, key=str), sorted(want[i], key=str)):
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == [None if x is None else pytest.approx(x, rel=1e-6, abs=1e-12) for x in explained]
            for c, (a, b) in enumerate(zip(r["whitened"], w)):
                assert (a is None) == (b is None)
                if a is not None:
                    sign = signs.setdefault((len(w), len(r["whitened"]), n, c), np.sign(a * b) if abs(b) > 1e-6 else None) or 1
                    assert a == pytest.approx(sign * b, rel=1e-6, abs=1e-7)


def test_whitening_of_the_given_vectors(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(whitening.whiten(given), [(r[0], r[1]) for r in given.select("vec_id", "embedding").collect()])


@pytest.mark.parametrize("counted", [False, True])
def test_whitening_counts_equal_vectors_as_asked(spark, counted):
    rng = np.random.default_rng(5)
    base = rng.normal(0, [3, 2, 1, 0.5, 0.2], (60, 5)).tolist()
    rows = [(i, v, 1) for i, v in enumerate(base + base[:20] + [base[7]] * 300)]
    rows += [(900, None, 1), (901, [1.0, None, 1, 1, 1], 1), (902, [float("nan")] * 5, 1), (903, [float("inf"), 1, 1, 1, 1], 1), (None, base[1], 1), (904, [], 1), (5, base[1], None)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(rng.normal(0, [2, 1], (30, 2)).tolist())] + [(2000, [5.0] * 3, 1)] * 2
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in rows]
    found = whitening.whiten(vectors(spark, rows).repartition(5), counted=counted)
    check_whitening(found, [(i, v) for i, v, _ in rows], counted)
    alone = found.filter("id = 2000").collect()
    assert len(alone) == 2 and all(r["whitened"] == [None] * 3 and r["explained"] == [None] * 3 and r["identity_error"] is None for r in alone)


@pytest.mark.parametrize("shift,spread", [(0.0, 1e6), (1e9, 30.0), (-4e12, 2.0)])
def test_whitening_far_from_zero(spark, shift, spread):
    values = (shift + np.random.default_rng(6).normal(0, [spread, spread / 2, spread / 4], (80, 3))).tolist()
    rows = [(i, v, 1) for i, v in enumerate(values)]
    check_whitening(whitening.whiten(vectors(spark, rows, VECTORS.replace("float", "double"))), [(i, v) for i, v, _ in rows])


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(i), 1e30 if i == 3 else float(i * i % 7)], 1) for i in range(20)]
    found = whitening.whiten(vectors(spark, rows, VECTORS.replace("float", "double"))).collect()
    assert len(found) == 20 and max(r["deviation"] for r in found) == 2**63 - 1


def test_whitening_of_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0


def test_whitening_groups_larger_than_a_share_are_broadcast(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("copies"))
    found = common.lookup(rows, table, "k", 1000)
    assert found.count() == 1000 and found.filter("copies = 600").count() == 600
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2


def nearest(rows, query, k=5):
    own = [(i, scaled(v)) for i, v, _ in rows if i is not None and usable(v)]
    out = []
    for a, av in own:
        if query(a):
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(av, v)))), i) for i, v in own if i != a and len(v) == len(av))[:k]
            out += [(a, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,block_bytes", [(1.0, 16_000_000), (6e3, 16_000_000), (6e3, 400), (1e6, 16_000_000), (1e15, 400)])
def test_topk_of_large_vectors(spark, spread, block_bytes):
    rng, rows = np.random.default_rng(12), []
    for dim, n in ((4, 300), (9, 40)):
        values = rng.normal(0, 1, (n, dim))
        values[::7] *= spread
        rows += [(len(rows) + i, v, 1) for i, v in enumerate(values.tolist())]
    rows[5][1][2], rows[10][1][0], rows[310][1][4] = 1e30, -1e30, 1e300
    rows += [(700, [], 1), (710, [], 1), (701, [float("inf")] * 4, 1), (None, rows[5][1], 1), (20, rows[20][1], 1), (20, rows[20][1], 1), (720, [-1e25] * 4, 1), (721, [-1e25] * 4, 1)]
    table = vectors(spark, rows, VECTORS.replace("float", "double")).repartition(3)
    found = topk.search(table, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == nearest(rows, lambda i: i % 10 == 0)


def mined(rows, anchor, positives=5, count=10, low=30, high=90):
    own = [(i, label, scaled(v)) for i, v, label in rows if i is not None and label is not None and usable(v)]
    out = []
    for a, a_label, av in own:
        if not anchor(a):
            continue
        scores = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(av, v)))), i, label) for i, label, v in own if i != a and len(v) == len(av)]
        best = sorted(((-s, i) for s, i, label in scores if label == a_label))[:positives]
        for p, positive in best:
            hard = sorted((-s, i) for s, i, label in scores if label != a_label and low * -p <= 100 * s <= high * -p)[:count]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [16_000_000, 40_000])
def test_hard_negatives_awkward(spark, block_bytes):
    rng = np.random.default_rng(8)
    rows = [(i, np.abs(rng.normal(0, 1, 10)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(80)]
    rows += [(100 + i, rows[20][1], 1) for i in range(150)] + [(10, rows[1][1], 2), (30, rows[30][1], rows[30][2])] * 2
    rows += [(300, None, 1), (301, [1.0] * 9 + [None], 1), (302, [float("nan")] * 10, 1), (303, [1.0] * 10, None), (None, [1.0] * 10, 1), (304, [], 1), (310, [], 1), (310, [], 2)]
    rows += [(400 + i, rng.normal(0, 1, 3).astype(np.float32).tolist(), i % 2) for i in range(40)]
    found = negatives.mine(vectors(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, F.col("label"), block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == mined(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e30])
def test_hard_negatives_of_large_vectors(spark, spread):
    values = np.random.default_rng(9).normal(0.7 * spread, spread, (60, 9))
    values[::2] /= spread
    rows = [(i, v, i % 3) for i, v in enumerate(values.tolist())]
    found = negatives.mine(vectors(spark, rows, VECTORS.replace("float", "double")), F.col("vec_id") % 5 == 0, F.col("label"))
    assert sorted(map(tuple, found.collect())) == mined(rows, lambda i: i % 5 == 0)


def test_hard_negatives_take_labels_of_any_type_and_empty_tables(spark):
    rows = [(i, [float(i % 5 + 1), float(i % 3)], i % 2) for i in range(30)]
    table = vectors(spark, rows)
    named = negatives.mine(table, F.col("vec_id") % 10 == 0, F.concat(F.lit("label "), F.col("label")))
    assert sorted(map(tuple, named.collect())) == mined(rows, lambda i: i % 10 == 0)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.mine(table, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_planes_and_subset_sums_make_products():
    rng = np.random.default_rng(10)
    for dim in (1, 7, 8, 9, 64):
        x, a = rng.integers(-300, 300, (50, dim)), rng.integers(-300, 300, (6, dim))
        x[0], x[1] = 0, -1
        bits, packed = negatives.planes(x)
        assert bits[:2].tolist() == [1, 1]
        for row in range(50):
            own = packed[row, :bits[row] * -(-dim // 8)].reshape(1, bits[row], -1)
            assert negatives.looked_up(negatives.subset_sums(a), own).tolist() == [(a @ x[row]).tolist()]


def word_sets(rows, size=2):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, {tuple(words[p:p + size]) for p in range(max(1, len(words) - size + 1))} if words else set()))
    return out


def linked(sets, percent=80):
    """The smallest identifier that each row's links reach, by all pairs that share a shingle."""
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    distinct = defaultdict(list)
    for place, (_, s) in enumerate(sets):
        distinct[frozenset(s)].append(place)
    for s, places in distinct.items():
        if s:
            for p in places[1:]:
                parent[top(p)] = top(places[0])
    meeting, shared = defaultdict(list), defaultdict(int)
    for s, places in distinct.items():
        for shingle in s:
            meeting[shingle].append(places[0])
    for members in meeting.values():
        for a, b in combinations(members, 2):
            shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[top(a)] = top(b)
    least = {}
    for place, (i, _) in enumerate(sets):
        known = least.get(top(place))
        least[top(place)] = i if known is None else known if i is None else min(known, i)
    return [(i, len(s), least[top(place)]) for place, (i, s) in enumerate(sets)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def check_forest(docs, **options):
    found = minhash_forest.near_duplicates(docs, words=2, **options)
    rows = docs.select("doc_id", "text").collect()
    assert order(map(tuple, found.collect())) == order(linked(word_sets(rows)))


def test_forest_on_the_given_table(spark):
    check_forest(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def templates(spark):
    """Near copies of a few texts at all similarities around the limit, in a crowd that is larger than a window, and awkward rows."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(6):
        base = rng.choice(words, 120).tolist()
        for _ in range(60):
            text = list(base)
            for place in rng.choice(120, int(rng.integers(0, 16)), replace=False):
                text[place] = str(rng.choice(words))
            rows.append(" ".join(text))
    rows += [" ".join(rng.choice(words, int(rng.integers(1, 90)))) for _ in range(200)]
    rows += rows[:40] + [rows[3].upper().replace(" ", "\t\n")] + [rows[5]] * 400
    rows += [None, "", " \n", "one", "ONE", "one two", "two one", "one two one two one", "x " * 30_000, "x " * 30_000 + "y", "é É", "é É é"]
    rows = [(i, t, 1) for i, t in enumerate(rows)] + [(None, rows[3], 1), (None, "nobody knows me", 1), (None, "", 1), (3, "twice three", 1), (3, rows[70], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({c: F.lit("x") for c in ("id", "key", "node", "least", "root", "copies", "a", "b", "place")}).repartition(7)


def test_forest_of_crowded_families(templates):
    check_forest(templates)


def test_forest_does_not_depend_on_how_orders_are_cut(spark, templates):
    few = templates.filter("doc_id % 3 = 0")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    try:
        check_forest(few)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_candidates_are_the_same_however_orders_are_cut(spark, templates):
    marked, _ = common.cut(templates.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text").mapInArrow(
        minhash_forest.described(2), "id long, key long, n long, node binary, least binary"))
    sets = marked.filter("n > 0").select("node", "n", "least").distinct()
    found, best = [], []
    for parts in (1, 4, 90):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rooted = sets.withColumn("root", F.when(F.xxhash64("node") % 3 == 0, F.lit(bytes(16))).otherwise(F.col("node")))
            found.append({(bytes(r["a"]), bytes(r["b"]), r["agree"]) for r in minhash_forest.candidates(rooted, 80, 5)[0].collect()})
            pairs, more = minhash_forest.candidates(sets.withColumn("root", F.lit(None).cast("binary")), 80, 5)
            pairs, more = {(bytes(r["a"]), bytes(r["b"])) for r in pairs.collect()}, {bytes(r["node"]) for r in more.collect()}
            best.append(pairs)
            assert all((a, b) in pairs or {a, b} <= more for a, b, _ in found[-1])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    assert best[0] <= best[1] <= best[2] and len(best[0]) > 100


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 400, 20_000):
        one, other = (np.unique(rng.integers(0, 2**64, size, np.uint64)) for _ in range(2))
        both = np.unique(np.concatenate([one[: size // 2], other]))
        for x, y in ((one, other), (one, both), (other, both), (one, one)):
            apart = int(np.bitwise_count((minhash_forest.parities(x) ^ minhash_forest.parities(y)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(x, y))


def test_few_pairs_of_a_crowd_are_confirmed(spark, monkeypatch):
    """Copies that are mostly too far from each other; all neighbours would be 30 pairs for each set."""
    rng = np.random.default_rng(12)
    base, rows = rng.choice(3000, 100), []
    for i in range(600):
        text = base.copy()
        places = rng.choice(100, int(rng.integers(8, 14)), replace=False)
        text[places] = rng.choice(3000, len(places))
        rows.append((i, " ".join(f"w{w}" for w in text)))
    counts, confirmed = [], minhash_forest.confirmed

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(minhash_forest, "confirmed", counting)
    check_forest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(counts) == 3 and max(counts) < 10 * len(rows), counts


def test_best_pairs_of_their_right_ends():
    left, right, agree = (np.array(x) for x in ([0, 1, 2, 3, 3], [3, 3, 3, 4, 5], [9, 9, 5, 1, 1]))
    assert minhash_forest.best_before(left, right, agree).tolist() == [False, True, False, True, True]
    assert minhash_forest.best_before(*[np.empty(0, np.int64)] * 3).tolist() == []


def test_forest_on_other_words_and_limits(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "a b c d e g"), (4, "p q")], "doc_id long, text string")
    found = minhash_forest.near_duplicates(docs, words=1, percent=85)
    assert sorted(map(tuple, found.collect())) == [(1, 6, 1), (2, 7, 1), (3, 6, 1), (4, 2, 4)]


def test_forest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_forest.near_duplicates(docs).count() == 0
    blank = spark.createDataFrame([(5, None), (6, ""), (6, " ")], "doc_id long, text string")
    assert sorted(map(tuple, minhash_forest.near_duplicates(blank).collect())) == [(5, 0, 5), (6, 0, 6), (6, 0, 6)]


def test_forest_of_text_identifiers(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "four")], "doc_id string, text string")
    assert sorted(map(tuple, minhash_forest.near_duplicates(docs).collect())) == [("a", 1, "a"), ("b", 1, "a"), ("c", 1, "c")]


@pytest.mark.parametrize("name,columns", [
    ("op11_whitening", ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]),
    ("op12_minhash_forest", ["doc_id", "n_shingles", "component_id", "kept"]),
    ("op13_hard_negatives", ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]),
])
def test_columns_of_the_queries(spark, name, columns):
    assert queries.QUERIES[name](spark, SF).columns == columns
