"""CSV uploads through files, tables and the stream."""

import codecs
import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockcast.operators import clean, demand
from stockcast.plans.ingest import Tables, ingest
from stockcast.schemas import SKUS
from stockcast.sources import store, upload
from stockcast.streaming import uploads

SKU_HEADER = "sku_id,product_name,category,mrp,cost,current_inventory"
SALES_HEADER = "date,sku_id,units_sold"


@pytest.fixture
def clock(spark):
    return F.lit("2026-03-01 08:00:00").cast("timestamp")


@pytest.fixture
def put(spark, tmp_path, clock):
    """Write a CSV with BOM and ingest it; returns (kind, metrics)."""
    tables = Tables(str(tmp_path / "tables"))
    count = iter(range(1000))

    def run(*lines, raw=None):
        path = tmp_path / f"up{next(count)}.csv"
        path.write_bytes(raw if raw is not None else codecs.BOM_UTF8 + "\n".join(lines).encode() + b"\n")
        kind, metrics = ingest(spark, tables, upload.read_upload(spark, str(path)), clock, path.name)
        return kind, metrics.first().asDict()

    run.tables = tables
    run.spark = spark
    return run


def skus(put):
    return [tuple(r) for r in put.tables.read_skus(put.spark).orderBy("sku_id").collect()]


def sales(put):
    return [(str(r["date"]), r["sku_id"], r["units_sold"]) for r in put.tables.read_sales(put.spark).orderBy("sku_id", "date").collect()]


def add_items(put, *ids):
    put(SKU_HEADER, *[f"{i},Face Wash,Personal Care,120.5,80.0,50" for i in ids])


def test_items_and_update(put):
    kind, metrics = put(SKU_HEADER, "SKU100,Face Wash,Personal Care,120.5,80.0,50")
    assert kind == "sku" and metrics["rows_cleaned"] == 1
    put(SKU_HEADER, "SKU100,Face Wash Pro,Personal Care,140.0,90.0,70")
    assert skus(put) == [("SKU100", "Face Wash Pro", "Personal Care", 140.0, 90.0, 70)]


def test_header_and_case(put):
    put(" SKU_ID , Product_Name,CATEGORY , mrp,cost, current_inventory,unexpected_col", "SkU_CaSe_1, Soap  bar ,ready-to-eat 3kg,10,5,1,x")
    assert skus(put) == [("SKU_CASE_1", "Soap bar", "Ready-To-Eat 3Kg", 10.0, 5.0, 1)]


@pytest.mark.parametrize(
    "lines, message",
    [
        ((), "empty"),
        ((SKU_HEADER,), "no data rows"),
        (("sku_id,product_name,category,mrp,cost", "A,b,c,2,1"), "current_inventory"),
        (("date,units_sold", "2026-02-20,4"), "sku_id"),
        ((SKU_HEADER, "A,b,c,text,1,1"), "No valid SKU"),
        ((SKU_HEADER, "A,b,c,5,9,1"), "No valid SKU"),
        ((SALES_HEADER, "invalid-date,A,3"), "No valid Sales"),
        ((SALES_HEADER + ",schema_version", "2026-02-20,A,3,2.0"), "schema_version"),
    ],
)
def test_unusable_files(put, lines, message):
    with pytest.raises(upload.UploadError, match=message):
        put(*lines)


def test_binary_garbage(put):
    with pytest.raises(upload.UploadError):
        put(raw=bytes([0x00, 0xFF, 0x81, 0xAA, 0xBB]))


def test_partial_rows(put):
    _, m = put(SKU_HEADER, "A,x,c,10,5,3", "B,x,c,not-a-number,5,3", "C,x,c,10,5,-4", "D,x,c,10,5,2.5", ",x,c,10,5,2", "E,x,,10,5,2")
    assert [r[0] for r in skus(put)] == ["A"]
    assert (m["rows_received"], m["rows_cleaned"], m["invalid_rows_dropped"]) == (6, 1, 5)


def test_schema_version_accepted(put):
    add_items(put, "A")
    put(SALES_HEADER + ",schema_version", "2026-02-20,A,3,1.0", "2026-02-21,A,3,")
    assert len(sales(put)) == 2


def test_sales_duplicates_and_corrections(put):
    add_items(put, "SKU100")
    _, m = put(SALES_HEADER, "2026-02-20,SKU100,8", "2026-02-20,sku100,12", "2026-02-20,SKU100,8")
    # the last copy of the repeated row comes last
    assert sales(put) == [("2026-02-20", "SKU100", 8)] and m["duplicates_removed"] == 2
    put(SALES_HEADER, "2026-02-20,SKU100,30", "2035-01-01,SKU100,1")
    assert sales(put) == [("2026-02-20", "SKU100", 30), ("2035-01-01", "SKU100", 1)]


def test_four_nine_four(put):
    add_items(put, "A")
    put(SALES_HEADER, "2026-02-20,A,4", "2026-02-20,A,9", "2026-02-20,A,4")
    assert sales(put) == [("2026-02-20", "A", 4)]


def test_case_insensitive_duplicate_and_negative_units(put):
    add_items(put, "SKU_DUP")
    put(SALES_HEADER, "2026-02-20,sku_dup,4", "2026-02-20,SKU_DUP,9", "2026-02-21,SKU_DUP,-2")
    assert sales(put) == [("2026-02-20", "SKU_DUP", 9)]


def test_unknown_items_are_counted(put):
    add_items(put, "A")
    _, m = put(SALES_HEADER, "2026-02-20,A,4", "2026-02-20,NOPE,4", "2026-02-21,NOPE,4")
    assert (m["rows_cleaned"], m["invalid_rows_dropped"]) == (1, 2)
    with pytest.raises(upload.UploadError, match="known SKU"):
        put(SALES_HEADER, "2026-02-20,NOPE,4")


def test_outlier_is_counted_and_kept(put):
    add_items(put, "A")
    _, m = put(SALES_HEADER, *[f"2026-02-{10 + i},A,{u}" for i, u in enumerate((8, 9, 10, 11, 400))])
    assert m["outliers_detected"] == 1 and len(sales(put)) == 5


def test_no_outliers_below_four_rows(put):
    add_items(put, "A")
    _, m = put(SALES_HEADER, "2026-02-10,A,1", "2026-02-11,A,1", "2026-02-12,A,900")
    assert m["outliers_detected"] == 0


def test_months_not_touched_stay_as_they_are(put):
    add_items(put, "A")
    put(SALES_HEADER, "2026-01-10,A,1", "2026-02-11,A,2")
    january = put.spark.read.parquet(put.tables.sales).filter("sales_month = '2026-01'").inputFiles()
    before = {f for f in january if "2026-01" in f}
    put(SALES_HEADER, "2026-02-11,A,5", "2026-03-01,A,7")
    after = {f for f in put.spark.read.parquet(put.tables.sales).inputFiles() if "2026-01" in f}
    assert before == after and [u for _, _, u in sales(put)] == [1, 5, 7]


def test_events_and_archive(put):
    add_items(put, "A", "B")
    put(SALES_HEADER, "2026-02-20,A,4", "2026-02-20,B,4")
    events = put.spark.read.parquet(put.tables.events)
    assert [(r["category"], r["count"]) for r in events.groupBy("category").count().collect()] == [("Personal Care", 2)]
    archived = put.spark.read.parquet(put.tables.archive).filter("kind = 'sales'").collect()
    assert len(archived) == 2 and archived[0]["archive_name"].startswith("uploads/sales/20260301T080000Z_up1-csv")


def test_many_rows_in_one_file(put):
    ids = [f"SKU{i:05d}" for i in range(5000)]
    _, m = put(SKU_HEADER, *[f"{i},Name,Cat,10,5,1" for i in ids])
    assert m["rows_cleaned"] == 5000 and len(skus(put)) == 5000


def test_order_within_a_file_read_in_pieces(spark, tmp_path):
    """The last line wins also when the file is split over many tasks."""
    lines = [SALES_HEADER] + [f"2026-02-20,A{i % 50:02d},{i}" for i in range(20000)]
    path = tmp_path / "big.csv"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        raw = upload.read_upload(spark, str(path), multi_line=False)
        assert raw.rdd.getNumPartitions() > 5
        items = spark.createDataFrame([(f"A{i:02d}",) for i in range(50)], "sku_id string")
        out = {r["sku_id"]: r["units_sold"] for r in clean.clean_sales(raw, items).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out == {f"A{i:02d}": 19950 + i for i in range(50)}


def test_quality_summary(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("Date,Category,Units_Sold\n2026-01-05,B,3\n2026-01-02,A,\n,A,3\n2026-01-09,C,x\n")
    r = clean.quality_summary(upload.read_upload(spark, str(path))).first()
    assert (r["total_rows"], r["accepted_rows"], r["rejected_rows"]) == (4, 2, 2)
    assert r["date_range"] == "2026-01-02 to 2026-01-05" and r["categories_detected"] == ["A", "B"]


@pytest.mark.parametrize("probabilities", [[0.25, 0.75], [0.0, 0.5, 1.0]])
def test_exact_quantiles_against_numpy(spark, probabilities):
    import numpy as np

    rng = np.random.default_rng(2)
    values = [float(v) for v in np.concatenate([rng.integers(0, 60, 4001), rng.normal(-5, 3, 500), [1e12, -1e9, 0.25]])]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    r = clean.exact_quantiles(df, "v", probabilities).first()
    assert [r[f"p{i}"] for i in range(len(probabilities))] == pytest.approx(list(np.quantile(values, probabilities)))
    assert r["n"] == len(values)


def test_stream_of_files(spark, tmp_path, festivals):
    tables = Tables(str(tmp_path / "tables"))
    items = [("A", "x", "Snacks", 2.0, 1.0, 5), ("B", "x", "Toys", 2.0, 1.0, 5)]
    store.write_snapshot(spark, tables.skus, spark.createDataFrame(items, SKUS))
    folder = tmp_path / "in"
    folder.mkdir()
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    (folder / "snacks_day1.csv").write_text("\n".join([SALES_HEADER] + [f"{d},A,{10 + i % 7}" for i, d in enumerate(days)]) + "\n")
    (folder / "zero.csv").write_text("")

    def run():
        uploads.start(spark, str(folder), tables, str(tmp_path / "cp"), festivals).awaitTermination()

    run()
    first = spark.read.parquet(tables.models)
    assert [(r["category"], r["n_samples"]) for r in first.collect()] == [("Snacks", 33)]
    # a late correction and a new series in a second file; the first file is not read again
    (folder / "later.csv").write_text(f"{SALES_HEADER}\n{days[0]},A,500\n{days[1]},B,3\n{days[1]},ZZ,3\n")
    run()
    run()
    daily = {(r["category"], r["date"]): r["units_sold"] for r in demand.daily_demand(tables.read_sales(spark), tables.read_skus(spark)).collect()}
    assert daily["Snacks", days[0]] == 500 and daily["Snacks", days[1]] == 11 and daily["Toys", days[1]] == 3
    assert len(daily) == 41
    assert {(r["category"], r["date"]): r["units_sold"] for r in tables.read_daily(spark).collect()} == daily
    assert spark.read.parquet(tables.models).count() == 2  # Toys is too short to fit


def test_touched_days(spark):
    day = dt.date(2026, 1, 1)
    sales_rows = spark.createDataFrame([(day, "A", 5), (day, "B", 7), (day + dt.timedelta(1), "A", 9)], "date date, sku_id string, units_sold bigint")
    items = spark.createDataFrame([("A", "X"), ("B", "Y")], "sku_id string, category string")
    changes = sales_rows.filter("sku_id = 'A' and units_sold = 5")
    out = uploads.touched_days(changes, items, sales_rows).collect()
    assert [(r["category"], r["units_sold"]) for r in out] == [("X", 5)]


def test_one_date_order_per_file(put):
    """Days 1 to 31 in one order stay in that order; a file that fits both orders, or neither, is reported."""
    add_items(put, "A1")
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(31)]
    _, metrics = put(SALES_HEADER, *[f"{d:%d/%m/%Y},A1,{d.day}" for d in days])
    assert metrics["rows_cleaned"] == 31 and metrics["invalid_rows_dropped"] == 0 and metrics["files_of_unclear_date_order"] == 0
    assert sales(put) == [(str(d), "A1", d.day) for d in days]
    _, metrics = put(SALES_HEADER, *[f"{d:%m/%d/%Y},A1,{d.day + 100}" for d in days])
    assert sales(put) == [(str(d), "A1", d.day + 100) for d in days] and metrics["files_of_unclear_date_order"] == 0
    _, metrics = put(SALES_HEADER, "02/03/2026,A1,1")
    assert ("2026-02-03", "A1", 1) in sales(put) and metrics["files_of_unclear_date_order"] == 1
    _, metrics = put(SALES_HEADER, "25/03/2026,A1,1", "03/26/2026,A1,2", "2026-03-27,A1,3")
    assert (metrics["rows_cleaned"], metrics["invalid_rows_dropped"], metrics["files_of_unclear_date_order"]) == (2, 1, 1)


def test_files_of_one_upload_have_their_own_orders(spark, tmp_path):
    for name, first in (("a.csv", "05/01/2026"), ("b.csv", "01/05/2026")):
        second = "25/01/2026" if name == "a.csv" else "01/25/2026"
        (tmp_path / name).write_text(f"{SALES_HEADER}\n{first},A1,1\n{second},A1,2\n")
    rows = upload.with_date_order(upload.read_upload(spark, str(tmp_path)))
    found = clean.type_sales(rows).select("date").collect()
    assert sorted(str(r[0]) for r in found) == ["2026-01-05", "2026-01-05", "2026-01-25", "2026-01-25"]


def test_row_numbers_follow_files_and_lines(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "".join(f"{name},{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
    try:
        raw = upload.read_upload(spark, str(tmp_path), multi_line=False)
        assert raw.rdd.getNumPartitions() > 6
        found = upload.number_rows(raw).orderBy(upload.ROW_ORDER).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["k"], int(r["v"])) for r in found] == [(name, i) for name in "abc" for i in range(500)]
    assert [r[upload.ROW_ORDER] for r in found] == list(range(1500))


def test_cleaning_hashes_and_metrics_read_raw_rows_once(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SALES_HEADER + "\n" + "".join(f"2026-01-{i % 28 + 1:02d},A{i % 7},{i % 11}\n" for i in range(2000)))
    items = spark.createDataFrame([(f"A{i}",) for i in range(5)], "sku_id string")
    rows = upload.number_rows(upload.read_upload(spark, str(tmp_path / "s.csv")))
    plan = clean.clean_sales(rows, items)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    raw = spark.read.schema("date string, sku_id string, units_sold string").csv(str(tmp_path / "s.csv"), header=True).withColumn("row_order", F.monotonically_increasing_id())
    metrics = clean.ingestion_metrics(raw.mapInArrow(counted, raw.schema), "sales", items).first()
    assert reads.value == 2000 and metrics["rows_received"] == 2000 and metrics["rows_cleaned"] == 20


QUOTED = [
    'date,sku_id,units_sold,"the\n""note"""',
    '2026-01-01,A1,1,plain', '2026-01-02,A1,2,"two\nlines"', '', '2026-01-03,"A,1",3,"a ""quoted"" word, and\n\n"",""\nmore"', '2026-01-04,A1,4,', '2026-01-05,A1,5,""',
    '2026-01-06,A1,6,stray " quote', '2026-01-07,A1,7,back\\slash', '"2026-01-08","A1","8","' + "long\n" * 300 + '"', '2026-01-09,A1,9,"\n"', '2026-01-10,A1', '2026-01-11,A1,11,é▁"x"', '2026-01-12,A1,12,end',
]


@pytest.mark.parametrize("split", [60, 333, 5000])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_files_are_split(spark, tmp_path, split, newline):
    """Equal rows in equal order, from one task a file and from many."""
    for name, copies in (("b", 8), ("a", 3)):
        lines = [QUOTED[0], *[f"{line}" for i in range(copies) for line in QUOTED[1:]]]
        (tmp_path / f"{name}.csv").write_bytes(codecs.BOM_UTF8 + "\n".join(lines).replace("\n", newline).encode() + (b"" if name == "a" else newline.encode()))
    plain = upload.read_upload(spark, str(tmp_path))
    names = [c for c in plain.columns if c != upload.ROW_ORDER]
    want = [tuple(r)[:-1] for r in plain.orderBy(upload.ROW_ORDER).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cut = upload.read_upload(spark, str(tmp_path))
        assert cut.columns == plain.columns
        got = [tuple(r) for r in upload.number_rows(cut).orderBy(upload.ROW_ORDER).select(*names).collect()]
        tasks = upload.split_csv.lines_of(spark, str(tmp_path), False).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(want) == 11 * 12 and got == want
    assert tasks > (2 if split == 5000 else 20)


def test_splits_inside_one_quoted_field(spark, tmp_path):
    text = "x\n" * 2000
    (tmp_path / "one.csv").write_text(f'k,v\n1,"{text}"\n2,b\n3,"open')
    rows = upload.read_split_upload(spark, str(tmp_path / "one.csv"))
    assert [(r["k"], r["v"]) for r in rows.orderBy(upload.ROW_ORDER).collect()] == [("1", text), ("2", "b"), ("3", "open")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    try:
        cut = upload.read_split_upload(spark, str(tmp_path / "one.csv")).orderBy(upload.ROW_ORDER).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["k"], r["v"]) for r in cut] == [("1", text), ("2", "b"), ("3", "open")]
    (tmp_path / "other.csv").write_text("k,w\n1,2\n")
    with pytest.raises(ValueError, match="same header"):
        upload.read_split_upload(spark, str(tmp_path))


def items_of(spark, *rows):
    return spark.createDataFrame([(i, n, "C", 2.0, 1.0, 5) for i, n in rows], SKUS)


def names(spark, path):
    return {r["sku_id"]: r["product_name"] for r in store.read_snapshot(spark, path, SKUS).collect()}


def test_unpublished_snapshots_are_not_read(spark, tmp_path):
    path = str(tmp_path / "items")
    assert names(spark, path) == {}
    store.write_snapshot(spark, path, items_of(spark, ("A", "one")))
    # a writer that dies after its rows, and one that dies between creating and writing its manifest
    items_of(spark, ("A", "lost")).write.parquet(f"{path}/snapshot-lost")
    assert names(spark, path) == {"A": "one"}
    store.shared.create(spark, store._manifest(path, 1), "")
    assert names(spark, path) == {"A": "one"}
    store.upsert_skus(spark, path, items_of(spark, ("B", "two")), SKUS)
    assert names(spark, path) == {"A": "one", "B": "two"} and store.published(spark, path)[0] == 2
    assert store.expire_snapshots(spark, path, keep=1, older_than_seconds=3600) == 0
    assert store.expire_snapshots(spark, path, keep=1, older_than_seconds=0) == 2
    assert names(spark, path) == {"A": "one", "B": "two"}
    assert len(store.shared.numbered(spark, f"{path}/_published")) == 1


def test_two_writers_of_snapshots(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "items")
    store.write_snapshot(spark, path, items_of(spark, ("A", "one")))
    with pytest.raises(store.SnapshotConflict):
        store.write_snapshot(spark, path, items_of(spark, ("A", "late")), based_on=-1)
    # another writer publishes between this one's read and its manifest: the change is merged into that snapshot
    create, calls = store.shared.create, []

    def overtaken(session, name, text):
        if not calls:
            calls.append(name)
            monkeypatch.setattr(store.shared, "create", create)
            store.upsert_skus(session, path, items_of(session, ("B", "other")), SKUS)
        return create(session, name, text)

    monkeypatch.setattr(store.shared, "create", overtaken)
    store.upsert_skus(spark, path, items_of(spark, ("C", "mine")), SKUS)
    assert names(spark, path) == {"A": "one", "B": "other", "C": "mine"}
    assert sum(x.is_dir() and x.name.startswith("snapshot-") for x in (tmp_path / "items").iterdir()) == 3


def test_a_batch_counts_once(spark, tmp_path, festivals, monkeypatch):
    tables = Tables(str(tmp_path / "tables"))
    store.write_snapshot(spark, tables.skus, spark.createDataFrame([("A", "x", "Snacks", 2.0, 1.0, 5)], SKUS))
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rows = spark.createDataFrame([(str(d), "A", str(10 + i % 7)) for i, d in enumerate(days)], "date string, sku_id string, units_sold string")
    batch = rows.select("*", F.lit(None).cast("string").alias("file_category"), F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit("f").alias("p"), F.lit(0).cast("long").alias("b")).alias("place"))

    def state():
        read = [spark.read.parquet(getattr(tables, t)) for t in ("events", "models", "daily", "sales")]
        return [sorted(map(str, df.collect())) for df in read]

    # the first run stops before the ledger is written; the next one replaces its events and models
    with monkeypatch.context() as stop:
        stop.setattr(store, "mark_done", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            uploads.upsert_batch(spark, tables, festivals, batch, 0)
    uploads.upsert_batch(spark, tables, festivals, batch, 0)
    once = state()
    assert [len(x) for x in once] == [1, 1, 40, 40]
    uploads.upsert_batch(spark, tables, festivals, batch, 0)
    assert state() == once
    uploads.upsert_batch(spark, tables, festivals, batch, 1)
    assert [len(x) for x in state()] == [2, 2, 40, 40]
