"""Tables of small changes: what is written, who wins, crashes, other writers, compaction, lookups."""

import random

import pytest

from stockcast.session import scratch_path
from stockcast.sources import changes, shared, store

SCHEMA, KEYS = "k string, day date, v bigint, name string", ["k", "day"]


@pytest.fixture
def path(spark):
    return scratch_path(spark, "changes")


def rows(spark, *values):
    return spark.createDataFrame([(k, None, v, name) for k, v, name in values], SCHEMA)


def found(spark, path):
    return sorted((r["k"] or "", r["v"], r["name"]) for r in changes.read(spark, path, KEYS, SCHEMA).collect())


def put(spark, path, *values, **how):
    changes.upsert(spark, path, rows(spark, *values), KEYS, SCHEMA, **how)


def test_one_row_writes_one_small_file_and_nothing_else(spark, path):
    put(spark, path, *[(f"k{i}", i, "old") for i in range(500)], buckets=8)
    before = set(changes.read(spark, path, KEYS, SCHEMA).inputFiles())
    assert {f.split("_bucket=")[1].split("/")[0] for f in before} == {str(i) for i in range(8)}
    put(spark, path, ("k7", -7, None))
    after = set(changes.read(spark, path, KEYS, SCHEMA).inputFiles())
    assert before < after and len(after - before) == 1
    assert found(spark, path) == sorted((f"k{i}", i if i != 7 else -7, "old" if i != 7 else None) for i in range(500))


def test_random_upserts_and_compactions_equal_a_dictionary(spark, path):
    rng, want = random.Random(4), {}
    for step in range(9):
        batch = {rng.choice(["", "a", "b", "c", "d", "e", "f", None]): (rng.choice([None, step]), rng.choice([None, "x"])) for _ in range(rng.randint(1, 4))}
        put(spark, path, *[(k, *v) for k, v in batch.items()], buckets=3, max_changes=4)
        want |= batch
        if step == 6:
            assert changes.compact(spark, path, KEYS, SCHEMA, whole=True)
            assert len(changes.live(spark, path)[2]) == 1
        got = {r["k"]: (r["v"], r["name"]) for r in changes.read(spark, path, KEYS, SCHEMA).collect()}
        assert got == want
        assert len(changes.live(spark, path)[2]) <= 4


def test_never_written_and_no_rows(spark, path):
    assert changes.read(spark, path, KEYS, SCHEMA).collect() == []
    assert changes.rows_of(spark, path, rows(spark, ("a", 1, "")), KEYS, SCHEMA).collect() == []
    put(spark, path)
    assert changes.live(spark, path) == (-1, None, [])
    put(spark, path, ("a", 1, "x"))
    put(spark, path)
    assert changes.live(spark, path)[0] == 0 and found(spark, path) == [("a", 1, "x")]
    assert not changes.compact(spark, path, KEYS, SCHEMA, whole=True)


def test_what_a_dead_writer_left_is_not_read_and_expires(spark, path, monkeypatch):
    put(spark, path, ("a", 1, "x"))
    with monkeypatch.context() as m:
        m.setattr(changes, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, path, ("a", 2, "lost"))
    monkeypatch.setattr(changes, "GRACE", 2)
    assert shared.create(spark, f"{path}/{store.MANIFESTS}/{1:012d}", "")  # died before it wrote the list
    assert found(spark, path) == [("a", 1, "x")]
    put(spark, path, ("b", 3, "y"))
    assert changes.live(spark, path)[0] == 2 and found(spark, path) == [("a", 1, "x"), ("b", 3, "y")]
    assert changes.expire(spark, path) == 0  # too young
    assert changes.expire(spark, path, older_than_seconds=0) == 1
    assert found(spark, path) == [("a", 1, "x"), ("b", 3, "y")]


def meanwhile(monkeypatch, action):
    """``action`` runs once, after the next list was read and before it is published."""
    create, once = shared.create, [action]

    def late(session, at, text):
        if once:
            once.pop()()
        return create(session, at, text)

    monkeypatch.setattr(shared, "create", late)


def test_of_two_writers_both_count(spark, path, monkeypatch):
    put(spark, path, ("a", 1, "x"))
    meanwhile(monkeypatch, lambda: put(spark, path, ("a", 2, "other"), ("b", 2, "other")))
    put(spark, path, ("a", 3, "mine"))
    assert found(spark, path) == [("a", 3, "mine"), ("b", 2, "other")]  # published last
    assert len(changes.live(spark, path)[2]) == 3


def test_an_upsert_during_a_compaction_stays(spark, path, monkeypatch):
    for i in range(3):
        put(spark, path, ("a", i, "x"), (f"b{i}", i, "x"))
    meanwhile(monkeypatch, lambda: put(spark, path, ("a", 9, "new")))
    assert changes.compact(spark, path, KEYS, SCHEMA, whole=True)
    assert len(changes.live(spark, path)[2]) == 2
    assert found(spark, path) == [("a", 9, "new"), ("b0", 0, "x"), ("b1", 1, "x"), ("b2", 2, "x")]


def test_of_two_compactions_one_counts(spark, path, monkeypatch):
    for i in range(3):
        put(spark, path, ("a", i, "x"), (f"b{i}", i, "x"))
    meanwhile(monkeypatch, lambda: changes.compact(spark, path, KEYS, SCHEMA))
    assert not changes.compact(spark, path, KEYS, SCHEMA, whole=True)
    assert found(spark, path) == [("a", 2, "x"), ("b0", 0, "x"), ("b1", 1, "x"), ("b2", 2, "x")]


def test_lookups_read_the_buckets_of_their_keys(spark, path):
    schema, keys = "k string, v bigint", ["k"]
    table = spark.createDataFrame([(f"k{i}", i) for i in range(300)], schema)
    changes.upsert(spark, path, table, keys, schema, buckets=8)
    changes.upsert(spark, path, spark.createDataFrame([("k5", -5)], schema), keys, schema)
    out = changes.rows_of(spark, path, spark.createDataFrame([("k5",), ("k9",), ("k5",), ("none",), (None,)], "k string"), keys, schema)
    assert sorted(map(tuple, out.collect())) == [("k5", -5), ("k9", 9)]
    assert "PartitionFilters" in out._jdf.queryExecution().toString()


def test_another_bucket_count_and_extra_columns(spark, path):
    put(spark, path, ("a", 1, "x"), buckets=4)
    more = rows(spark, ("a", 2, "y")).selectExpr("*", "1 AS extra", "2 AS _bucket", "3 AS _sequence")
    changes.upsert(spark, path, more, KEYS, SCHEMA, buckets=16)
    assert changes.live(spark, path)[1] == 4 and found(spark, path) == [("a", 2, "y")]
