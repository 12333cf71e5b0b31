"""Category of a file from a table of prefixes."""

from stockcast.sources import upload


def test_longest_prefix_of_items_and_fixed_ones(spark):
    skus = spark.createDataFrame([("a", " Hot Drinks "), ("b", "Hot"), ("c", "hot"), ("d", None), ("e", " "), ("f", "Tea (loose)")], "sku_id string, category string")
    names = {
        "in/HOT_drinks_2026.csv": "Hot Drinks", "in/hotdrinks.csv": "Hot Drinks", "x/hot-drinks": "Hot Drinks", "hot drinks 1.csv": "Hot Drinks",
        "in/hot_1.csv": "Hot", "tea_(loose)-1.csv": "Tea (loose)", "in/edible-oil.csv": "Edible Oil", "snacks_1.csv": "Snacks",
        "hot/other.csv": None, "": None, ".csv": None, "in/": None, "ho.csv": None,
    }
    files = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "path string")
    out = upload.file_categories(files, upload.category_prefixes(skus)).collect()
    assert len(out) == len(names) + 1
    assert {r["path"]: r["category"] for r in out} == names | {None: None}


def test_no_files_and_no_items(spark):
    skus = spark.createDataFrame([], "sku_id string, category string")
    prefixes = upload.category_prefixes(skus)
    assert upload.file_categories(spark.createDataFrame([], "path string"), prefixes).collect() == []
    assert [r["category"] for r in upload.file_categories(spark.createDataFrame([("staples.csv",)], "path string"), prefixes).collect()] == ["Staples"]


def test_neither_files_nor_prefixes_are_broadcast_and_odd_names_keep_their_category(spark, tmp_path):
    skus = spark.createDataFrame([("a", "Tea"), ("b", "Tea/cold"), ("c", "/in/te.csv"), ("d", "Teapots and kettles")], "sku_id string, category string")
    names = {"in/tea1.csv": "Tea", "in/te.csv": None, "in/teapots.csv": "Tea", "teapots-and-kettles-2.csv": "Teapots and kettles", "tea/cold.csv": None}
    # small files, which Spark would broadcast by itself
    skus.write.parquet(f"{tmp_path}/skus")
    spark.createDataFrame([(n,) for n in names], "path string").write.parquet(f"{tmp_path}/files")
    skus, files = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("skus", "files"))
    found = upload.file_categories(files, upload.category_prefixes(skus))
    assert {r["path"]: r["category"] for r in found.collect()} == names
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
