"""Files read by many tasks: what a task holds, and how often lines are read."""

from stockcast.sources import split_csv, upload


def test_rows_are_cut_once_and_not_gathered_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' \nid,text\n1,"x\n\ny"\n2,z\n"3","""\n"\n')
    (tmp_path / "b.csv").write_text('\nid,"text"\n4,"' + "line\n" * 40 + '"\n5,\n6,"open\nto the end')
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 16)
    try:
        rows = upload.read_split_upload(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = [(r["id"], r["text"]) for r in rows.orderBy(upload.ROW_ORDER).collect()]
    finally:
        spark.conf.set(key, before)
    assert found == [("1", "x\n\ny"), ("2", "z"), ("3", '"\n'), ("4", "line\n" * 40), ("5", None), ("6", "open\nto the end")]
    assert "Join" not in plan and "Window" not in plan and "MapInArrow" not in plan


def test_one_task_writes_a_bounded_part_of_the_texts(spark, monkeypatch, tmp_path):
    from suite import ingest_checks
    from suite.base import QUERIES

    read = []
    monkeypatch.setattr(ingest_checks, "ONE_FILE", 100_000)
    monkeypatch.setattr(upload, "read_upload", lambda session, path: read.append(path) or session.createDataFrame([], "id string, text string"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").write.parquet(f"{tmp_path}/conversations.parquet")
    QUERIES["csv_split_round_trip"](spark, str(tmp_path))
    assert len(spark.read.text(read[0]).inputFiles()) > 1


def test_rows_do_not_meet_by_file_or_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,sku_id,units_sold\n13/01/2026,A,1\n02/01/2026,B,2\n")
    rows = upload.number_rows(upload.with_date_order(upload.read_upload(spark, str(tmp_path))))
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert [(r["sku_id"], r["day_first"]) for r in rows.orderBy("row_order").collect()] == [("A", True), ("B", True)]


def test_splits_without_quotes_keep_the_state_they_start_in(spark):
    rows = [("f", 0, 'a,"b'), ("f", 10, "c"), ("f", 10, "d"), ("f", 20, 'e",1'), ("f", 20, "g,2"), ("f", 30, "h,3"), ("g", 0, "i,4"), ("g", 10, "j,5")]
    lines = spark.createDataFrame([(None, *r) for r in rows], "t timestamp, p string, b long, value string").coalesce(1)
    found = split_csv.split_starts(split_csv.marked_lines(lines)).collect()
    assert sorted(map(tuple, found)) == [("f", 10, True, 0), ("f", 20, True, 0)]
    plain = split_csv.split_starts(split_csv.marked_lines(lines.filter("p = 'g'")))
    assert plain.collect() == []


def test_lines_are_read_once_and_guesses_of_splits_that_start_inside_are_joined_anew(spark):
    """Splits that start inside quotes, that never tell how they start, and that hold no end of a row."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [
        ("f", 0, "id,text"), ("f", 0, 'a,"b'), ("f", 10, "c"), ("f", 10, ""), ("f", 20, 'e",1'), ("f", 20, "g,2"), ("f", 20, 'h,"i'), ("f", 20, 'j"'), ("f", 30, "k,3"),
        ("f", 30, 'l,"""'), ("f", 40, '"""'), ("g", 0, 'id,"text"'), ("g", 10, '"x","y"'), ("g", 10, '"z","'), ("g", 20, '"'), ("g", 20, 'o,"p'),
    ]
    schema = "t timestamp, p string, b long, value string"
    lines = spark.createDataFrame([(None, *r) for r in rows], schema).coalesce(1).mapInArrow(counted, schema)
    found = [(r["p"], r["b"], r["text"], r["is_first"]) for r in split_csv.rows_of(split_csv.marked_lines(lines)).orderBy("p", "b", "i").collect()]
    assert found == [
        ("f", 0, "id,text", True), ("f", 0, 'a,"b\nc\n\ne",1', False), ("f", 20, "g,2", False), ("f", 20, 'h,"i\nj"', False), ("f", 30, "k,3", False),
        ("f", 30, 'l,"""\n"""', False), ("g", 0, 'id,"text"', True), ("g", 10, '"x","y"', False), ("g", 10, '"z","\n"', False), ("g", 20, 'o,"p', False),
    ]
    assert seen.value == len(rows)


def test_small_splits_share_a_task(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n" + '1,"x\n\ny"\n2,z\n' * 400)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, 16)
    try:
        lines = split_csv.lines_of(spark, str(tmp_path), False)
        splits, rows = lines.rdd.getNumPartitions(), split_csv.rows_of(lines)
        assert splits > 300 and len(rows.inputFiles()) <= 2 * split_csv.TASKS_A_CORE * spark.sparkContext.defaultParallelism + 8
        assert rows.count() == 801
    finally:
        spark.conf.set(key, before)
