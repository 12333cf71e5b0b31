"""Upload cleaning on rows made dirty by rule, text cleaning on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockcast.functions import text as tx
from stockcast.operators import clean
from stockcast.sources import upload
from suite.base import ORACLES, Domain, query, register_cte
from suite.plain import plain

HIDDEN = "chr(8203)"

# Raw uploads: the same CASE rules in both engines.
SALES_RAW = """
    CASE WHEN l_orderkey % 31 = 0 THEN ' ' WHEN l_orderkey % 5 = 0 THEN concat('  sku', CAST(l_partkey AS {text}), {hidden}, ' ')
         ELSE concat('SKU', CAST(l_partkey AS {text})) END AS sku_id,
    CASE WHEN l_orderkey % 13 = 0 THEN 'not-a-date' WHEN l_orderkey % 3 = 0 THEN {slash_us} WHEN l_orderkey % 3 = 1 THEN {slash_iso}
         ELSE concat({iso}, ' 10:30:00') END AS date,
    CASE WHEN l_orderkey % 17 = 0 THEN concat('-', CAST(CAST(l_quantity AS INTEGER) AS {text})) WHEN l_orderkey % 19 = 0 THEN concat(CAST(CAST(l_quantity AS INTEGER) AS {text}), '.5')
         WHEN l_orderkey % 23 = 0 THEN 'many' WHEN l_orderkey % 29 = 0 THEN '1d' WHEN l_orderkey % 37 = 0 THEN '9e2'
         ELSE CAST(CAST(l_quantity AS INTEGER) AS {text}) END AS units_sold,
    CASE WHEN l_suppkey % 3 = 0 THEN '1.0' WHEN l_suppkey % 3 = 1 THEN ' 1.00 ' WHEN l_suppkey % 6 = 2 THEN '1' ELSE '2' END AS schema_version,
    ((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS row_order"""
SKUS_RAW = """
    CASE WHEN p_partkey % 41 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN concat(' sku', CAST(p_partkey AS {text}), {hidden}) ELSE concat('SKU', CAST(p_partkey AS {text})) END AS sku_id,
    CASE WHEN p_partkey % 43 = 0 THEN {hidden} ELSE concat('  ', p_name, chr(9), '   pack ') END AS product_name,
    CASE WHEN p_partkey % 47 = 0 THEN '   ' ELSE concat('READY-to-eat  ', lower(p_type), ' 3kg') END AS category,
    CASE WHEN p_partkey % 53 = 0 THEN 'n/a' ELSE CAST(CAST(floor(p_retailprice) AS INTEGER) AS {text}) END AS mrp,
    CASE WHEN p_partkey % 59 = 0 THEN '99999' WHEN p_partkey % 61 = 0 THEN '' ELSE ' 12.25 ' END AS cost,
    CASE WHEN p_partkey % 11 = 0 THEN '-4' WHEN p_partkey % 7 = 0 THEN concat(CAST(p_size AS {text}), '.5') ELSE CAST(p_size AS {text}) END AS current_inventory,
    p_partkey AS row_order"""
DUCK = {
    "text": "VARCHAR", "hidden": HIDDEN, "slash_us": "strftime(l_shipdate, '%m/%d/%Y')",
    "slash_iso": "strftime(l_shipdate, '%Y/%m/%d')", "iso": "strftime(l_shipdate, '%Y-%m-%d')",
}
SPARK = {
    "text": "STRING", "hidden": "'​'", "slash_us": "date_format(l_shipdate, 'MM/dd/yyyy')",
    "slash_iso": "date_format(l_shipdate, 'yyyy/MM/dd')", "iso": "date_format(l_shipdate, 'yyyy-MM-dd')",
}
AGAIN = 100_000_000_000_000_000

register_cte("sales_once", "SELECT " + SALES_RAW.format(**DUCK) + " FROM lineitem")
register_cte(
    "raw_sales",
    f"SELECT * FROM sales_once UNION ALL SELECT * REPLACE (row_order + {AGAIN} AS row_order) FROM sales_once WHERE units_sold IN ('7', '8')",
    "sales_once",
)
register_cte("skus_once", "SELECT " + SKUS_RAW.format(**DUCK) + " FROM part")
register_cte(
    "raw_skus",
    f"""SELECT * FROM skus_once UNION ALL SELECT * REPLACE (row_order + {AGAIN} AS row_order) FROM skus_once WHERE mrp LIKE '%5'
        UNION ALL SELECT * REPLACE ('77' AS current_inventory, row_order + {2 * AGAIN} AS row_order) FROM skus_once WHERE mrp LIKE '%3'""",
    "skus_once",
)
register_cte("known", "SELECT 'SKU' || p_partkey AS sku_id, p_type AS category FROM part WHERE p_size <= 45")

STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
VISIBLE = r"regexp_replace({x}, '[\x00-\x1f\x7f-\x9f\x{{200b}}-\x{{200f}}\x{{feff}}]', '', 'g')"
NUM = r"CASE WHEN regexp_full_match(trim({x}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def strip_sql(x: str) -> str:
    return STRIP.format(x=x)


def sku_sql(x: str) -> str:
    return f"replace(upper({strip_sql(VISIBLE.format(x=x))}), chr(7838), 'SS')"


def text_sql(x: str) -> str:
    return strip_sql(r"regexp_replace(" + VISIBLE.format(x=x) + r", '[\s\p{Z}]+', ' ', 'g')")


def title_sql(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)'), lambda w: replace(upper(w[1]), chr(7838), 'Ss') || lower(w[2:])), '')"


def num_sql(x: str) -> str:
    return NUM.format(x=x)


def day_sql(x: str) -> str:
    d = f"regexp_replace(trim({x}), '[T ][0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?$', '')"
    return (
        f"CAST(coalesce(try_strptime({d}, '%Y-%m-%d'), try_strptime({d}, '%Y/%m/%d'), try_strptime({d}, '%m/%d/%Y')) AS DATE)"
    )


register_cte(
    "checked_sales",
    f"""
    SELECT *, list_filter([CASE WHEN sku_id = '' THEN 'blank_sku' END, CASE WHEN date IS NULL THEN 'bad_date' END, CASE WHEN units_sold IS NULL THEN 'bad_units' END,
                           CASE WHEN units_sold % 1 <> 0 THEN 'fractional_units' END, CASE WHEN units_sold < 0 THEN 'negative_units' END], lambda r: r IS NOT NULL) AS rules
    FROM (SELECT {sku_sql('sku_id')} AS sku_id, {day_sql('date')} AS date, {num_sql('units_sold')} AS units_sold, max(row_order) AS row_order, count(*) AS copies
          FROM raw_sales GROUP BY raw_sales.sku_id, raw_sales.date, raw_sales.units_sold, raw_sales.schema_version)""",
    "raw_sales",
)
register_cte(
    "clean_sales",
    """SELECT date, sku_id, CAST(units_sold AS BIGINT) AS units_sold
       FROM (SELECT *, row_number() OVER (PARTITION BY date, sku_id ORDER BY row_order DESC) AS r FROM checked_sales WHERE len(rules) = 0)
       WHERE r = 1 AND sku_id IN (SELECT sku_id FROM known)""",
    "checked_sales", "known",
)
register_cte(
    "checked_skus",
    f"""
    SELECT *, list_filter([CASE WHEN sku_id = '' THEN 'blank_sku' END, CASE WHEN product_name = '' THEN 'blank_name' END, CASE WHEN category = '' THEN 'blank_category' END,
                           CASE WHEN mrp IS NULL THEN 'bad_mrp' END, CASE WHEN cost IS NULL THEN 'bad_cost' END, CASE WHEN current_inventory IS NULL THEN 'bad_inventory' END,
                           CASE WHEN current_inventory % 1 <> 0 THEN 'fractional_inventory' END, CASE WHEN current_inventory < 0 THEN 'negative_inventory' END,
                           CASE WHEN cost >= mrp THEN 'cost_not_below_mrp' END], lambda r: r IS NOT NULL) AS rules
    FROM (SELECT {sku_sql('sku_id')} AS sku_id, {text_sql('product_name')} AS product_name, {title_sql(text_sql('category'))} AS category, {num_sql('mrp')} AS mrp, {num_sql('cost')} AS cost,
                 {num_sql('current_inventory')} AS current_inventory, row_order, copies
          FROM (SELECT sku_id, product_name, category, mrp, cost, current_inventory, max(row_order) AS row_order, count(*) AS copies FROM raw_skus GROUP BY ALL))""",
    "raw_skus",
)


def raw_sales(t: Domain):
    once = t.table("lineitem").selectExpr(*_items(SALES_RAW.format(**SPARK)))
    again = once.filter(F.col("units_sold").isin("7", "8")).withColumn("row_order", F.col("row_order") + AGAIN)
    return once.unionByName(again)


def raw_sales_in_order(t: Domain, tasks: int):
    """The same rows in their order, which numbers are dealt by: texts are made behind the sort."""
    *texts, order = _items(SALES_RAW.format(**SPARK))
    units = F.expr(texts[2].removesuffix(" AS units_sold"))
    place = F.expr(order.removesuffix(" AS row_order"))
    twice = F.when(units.isin("7", "8"), F.array(place, place + AGAIN)).otherwise(F.array(place))
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", F.explode(twice).alias("row_order"))
    return rows.repartitionByRange(tasks, "row_order").sortWithinPartitions("row_order").selectExpr(*texts)


def raw_skus(t: Domain):
    once = t.table("part").selectExpr(*_items(SKUS_RAW.format(**SPARK)))
    again = once.filter(F.col("mrp").endswith("5")).withColumn("row_order", F.col("row_order") + AGAIN)
    changed = once.filter(F.col("mrp").endswith("3")).withColumns(
        {"current_inventory": F.lit("77"), "row_order": F.col("row_order") + 2 * AGAIN}
    )
    return once.unionByName(again).unionByName(changed)


def _items(select_list: str) -> list[str]:
    """Split a select list at the line ends that follow an alias."""
    parts, current = [], ""
    for line in select_list.strip().splitlines():
        current += " " + line.strip()
        if " AS " in line and line.rstrip().rstrip(",").split(" AS ")[-1].replace("_", "").isalpha():
            parts.append(current.strip().rstrip(","))
            current = ""
    return parts + ([current.strip()] if current.strip() else [])


def known(t: Domain):
    return t.table("part").filter("p_size <= 45").selectExpr("concat('SKU', p_partkey) AS sku_id", "p_type AS category")


@query(
    "exact_duplicates_dropped",
    "SELECT sku_id, date, units_sold, schema_version, max(row_order) AS row_order, count(*) AS copies FROM raw_sales GROUP BY ALL",
    ("raw_sales",),
)
def _(t):
    return clean.drop_exact_duplicates(raw_sales(t))


@query(
    "clean_sales_rows",
    "SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM clean_sales",
    ("clean_sales",),
)
def _(t):
    return plain(clean.clean_sales(raw_sales(t), known(t)))


@query(
    "rejected_sales_rows",
    "SELECT sku_id, CAST(date AS VARCHAR) AS date, units_sold, row_order, array_to_string(rules, '|') AS failed_rules FROM checked_sales WHERE len(rules) > 0",
    ("checked_sales",),
)
def _(t):
    out = clean.rejected(clean.checked(raw_sales(t), "sales"))
    return plain(out.select("sku_id", "date", "units_sold", "row_order", "failed_rules"))


@query(
    "sales_of_unknown_items",
    "SELECT sku_id, count(*) AS n FROM checked_sales WHERE len(rules) = 0 AND sku_id NOT IN (SELECT sku_id FROM known) GROUP BY 1",
    ("checked_sales", "known"),
)
def _(t):
    rows = clean.valid(clean.checked(raw_sales(t), "sales"))
    return clean.unknown_items(rows, known(t)).groupBy("sku_id").agg(F.count("*").alias("n"))


@query(
    "clean_sku_rows",
    """SELECT sku_id, product_name, category, mrp, cost, CAST(current_inventory AS INTEGER) AS current_inventory
       FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY row_order DESC) AS r FROM checked_skus WHERE len(rules) = 0) WHERE r = 1""",
    ("checked_skus",),
)
def _(t):
    return clean.clean_skus(raw_skus(t))


@query(
    "rejected_sku_rows",
    "SELECT sku_id, product_name, category, row_order, array_to_string(rules, '|') AS failed_rules FROM checked_skus WHERE len(rules) > 0",
    ("checked_skus",),
)
def _(t):
    out = clean.rejected(clean.checked(raw_skus(t), "sku"))
    return plain(out.select("sku_id", "product_name", "category", "row_order", "failed_rules"))


METRICS = """
    SELECT CAST(sum(copies) AS BIGINT) AS rows_received, (SELECT count(*) FROM {cleaned}) AS rows_cleaned,
           CAST(sum(copies - 1) + sum(CASE WHEN len(rules) = 0 THEN 1 ELSE 0 END) - (SELECT count(DISTINCT {key}) FROM {checked} WHERE len(rules) = 0) AS BIGINT) AS duplicates_removed,
           CAST(sum(CASE WHEN len(rules) > 0 THEN 1 ELSE 0 END) + (SELECT count(DISTINCT {key}) FROM {checked} WHERE len(rules) = 0) - (SELECT count(*) FROM {cleaned}) AS BIGINT) AS invalid_rows_dropped,
           {outliers} AS outliers_detected
    FROM {checked}"""
BOUND = "quantile_cont(units_sold, 0.75) + 3 * (quantile_cont(units_sold, 0.75) - quantile_cont(units_sold, 0.25))"


@query(
    "sales_ingestion_metrics",
    METRICS.format(
        cleaned="clean_sales", checked="checked_sales", key="(date, sku_id)",
        outliers=f"(SELECT count(*) FROM clean_sales WHERE units_sold > (SELECT {BOUND} FROM clean_sales))",
    ),
    ("clean_sales",),
)
def _(t):
    return clean.ingestion_metrics(raw_sales(t), "sales", known(t))


@query(
    "sku_ingestion_metrics",
    METRICS.format(
        cleaned="(SELECT DISTINCT sku_id FROM checked_skus WHERE len(rules) = 0)", checked="checked_skus", key="sku_id",
        outliers="CAST(0 AS BIGINT)",
    ),
    ("checked_skus",),
)
def _(t):
    return clean.ingestion_metrics(raw_skus(t), "sku")


@query(
    "outlier_bound",
    f"SELECT quantile_cont(units_sold, 0.25) AS q1, quantile_cont(units_sold, 0.75) AS q3, {BOUND} AS upper_bound, count(*) AS n FROM clean_sales",
    ("clean_sales",),
)
def _(t):
    return clean.outlier_bound(clean.clean_sales(raw_sales(t), known(t)))


@query(
    "exact_price_quantiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS p0, round(quantile_cont(l_extendedprice, 0.5), 4) AS p1,
              round(quantile_cont(l_extendedprice, 0.999), 4) AS p2, count(*) AS n FROM lineitem""",
)
def _(t):
    return plain(clean.exact_quantiles(t.table("lineitem"), "l_extendedprice", [0.01, 0.5, 0.999]))


@query(
    "outlier_rows",
    f"SELECT CAST(date AS VARCHAR) AS date, sku_id, units_sold FROM clean_sales WHERE units_sold > (SELECT {BOUND} FROM clean_sales)",
    ("clean_sales",),
)
def _(t):
    return plain(clean.outliers(clean.clean_sales(raw_sales(t), known(t))))


@query(
    "outliers_per_series",
    f"""SELECT sku_id, CAST(date AS VARCHAR) AS date, units_sold, round(upper_bound, 4) AS upper_bound
        FROM clean_sales JOIN (SELECT sku_id, {BOUND} AS upper_bound FROM clean_sales GROUP BY 1 HAVING count(*) >= 4) b USING (sku_id) WHERE units_sold > upper_bound""",
    ("clean_sales",),
)
def _(t):
    return plain(clean.outliers_per_series(clean.clean_sales(raw_sales(t), known(t)), ["sku_id"]))


@query(
    "upload_quality_summary",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE ok) AS accepted_rows, count(*) FILTER (WHERE NOT ok) AS rejected_rows,
               'Invalid date or units_sold value' AS rejected_reason,
               CAST(min(day) FILTER (WHERE ok) AS VARCHAR) || ' to ' || CAST(max(day) FILTER (WHERE ok) AS VARCHAR) AS date_range,
               (SELECT string_agg(DISTINCT schema_version, '|' ORDER BY schema_version) FROM (SELECT trim(schema_version) AS schema_version, units_sold FROM raw_sales WHERE {num_sql('units_sold')} IS NOT NULL)) AS categories_detected,
               count(*) FILTER (WHERE ok) > 0 AS models_will_retrain
        FROM (SELECT {num_sql('units_sold')} IS NOT NULL AS ok, {day_sql('date')} AS day FROM raw_sales)""",
    ("raw_sales",),
)
def _(t):
    return plain(clean.quality_summary(raw_sales(t).withColumnRenamed("schema_version", "category")))


@query(
    "wrong_schema_versions",
    "SELECT schema_version, count(*) AS n FROM raw_sales WHERE trim(schema_version) NOT IN ('1.0', '1.00', '') GROUP BY 1",
    ("raw_sales",),
)
def _(t):
    return upload.wrong_version(raw_sales(t)).groupBy("schema_version").agg(F.count("*").alias("n"))


@query(
    "missing_required_columns",
    """SELECT p_partkey, array_to_string(list_sort(list_filter(['date', 'sku_id', 'units_sold'], lambda c: NOT list_contains(h, c))), '|') AS missing_for_sales,
              array_to_string(list_sort(list_filter(['sku_id', 'product_name', 'category', 'mrp', 'cost', 'current_inventory'], lambda c: NOT list_contains(h, c))), '|') AS missing_for_sku
       FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ['date', 'sku_id', p_type] WHEN 1 THEN ['sku_id', 'units_sold', 'date'] WHEN 2 THEN ['mrp', 'cost', 'category'] ELSE [p_name] END AS h FROM part)""",
)
def _(t):
    header = F.expr(
        """CASE p_size % 4 WHEN 0 THEN array('date', 'sku_id', p_type) WHEN 1 THEN array('sku_id', 'units_sold', 'date')
           WHEN 2 THEN array('mrp', 'cost', 'category') ELSE array(p_name) END"""
    )
    for_sales, for_sku = upload.missing_column_arrays(F.col("h"))
    return plain(t.table("part").select("p_partkey", header.alias("h")).select(
        "p_partkey", for_sales.alias("missing_for_sales"), for_sku.alias("missing_for_sku")
    ))


@query(
    "bulk_sales_rows",
    f"""SELECT CAST({day_sql('date')} AS VARCHAR) AS date, sku_id, CAST(trunc(coalesce({num_sql('units_sold')}, 0)) AS BIGINT) AS units_sold FROM raw_sales WHERE {day_sql('date')} IS NOT NULL""",
    ("raw_sales",),
)
def _(t):
    return plain(upload.bulk_sales(raw_sales(t)).drop("row_order"))


@query(
    "archive_rows",
    """SELECT 'uploads/sales-upload/20240131T000000Z_my-file-csv.csv' AS archive_name, 'Sales Upload' AS kind, '2024-01-31' AS ingest_date, count(*) AS n,
              CAST(sum(length('{"sku_id":"' || sku_id || '","date":"' || date || '","units_sold":"' || units_sold || '","schema_version":"' || schema_version || '"}')) AS BIGINT) AS n_chars
       FROM raw_sales""",
    ("raw_sales",),
)
def _(t):
    from suite.base import as_of

    rows = upload.archive_rows(raw_sales(t), "Sales Upload", " My file.csv ", as_of())
    return plain(rows.groupBy("archive_name", "kind", "ingest_date").agg(
        F.count("*").alias("n"), F.sum(F.length("raw")).alias("n_chars")
    ))


# --- text functions on whole texts ------------------------------------------

@query("normalized_item_text", f"SELECT doc_id, md5({sku_sql('text')}) AS digest, length({sku_sql('text')}) AS n FROM documents")
def _(t):
    c = tx.norm_sku(F.col("text"))
    return t.table("documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("n"))


@query("normalized_text", f"SELECT doc_id, md5({text_sql('text')}) AS digest FROM documents")
def _(t):
    return t.table("documents").select("doc_id", F.md5(tx.norm_text(F.col("text"))).alias("digest"))


@query("title_case_text", f"SELECT conv_id, turn, md5({title_sql('text')}) AS digest FROM conversations")
def _(t):
    return t.table("conversations").select("conv_id", "turn", F.md5(tx.title_case(F.col("text"))).alias("digest"))


@query(
    "comma_items",
    f"""SELECT doc_id, list_count(items) AS n_items, md5(array_to_string(items, '|')) AS digest
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {strip_sql('x')}), lambda x: x <> '') AS items FROM documents)""",
)
def _(t):
    items = tx.comma_items(F.col("text"))
    return t.table("documents").select("doc_id", F.size(items).cast("bigint").alias("n_items"), F.md5(F.array_join(items, "|")).alias("digest"))


@query(
    "slugs",
    """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug FROM pages""",
)
def _(t):
    return t.table("pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query(
    "prompt_context",
    """SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(replace(text || role || ' <system>x</system> <|a|>' || text,
              '<system>', ''), '</system>', ''), '<|', ''), '|>', ''), '\\n\\nHuman:', ''), '\\n\\nAssistant:', '')) AS digest,
              md5('{"n":' || turn || ',"text":"' || role || ' x a"}') AS record_digest
       FROM conversations""",
)
def _(t):
    """Whole texts without the blocked tokens."""
    from stockcast.operators.reports import context_text

    record = F.struct(F.col("turn").alias("n"), F.concat("role", F.lit(" <system>x</system> <|a|>")).alias("text"))
    whole = F.concat("text", "role", F.lit(" <system>x</system> <|a|>"), "text")
    return t.table("conversations").select(
        "conv_id", "turn", F.md5(tx.prompt_safe(whole)).alias("digest"), F.md5(context_text(record)).alias("record_digest")
    )


@query(
    "csv_dialect_round_trip",
    """SELECT 'd' || doc_id AS id, length(text) AS n, md5(text) AS digest FROM documents
       UNION ALL SELECT 'c' || conv_id || '-' || turn, length(text), md5(text) FROM conversations
       UNION ALL SELECT 'q' || doc_id, length(text) + 18, md5('"' || text || '",' || chr(10) || ' "two' || chr(10) || 'lines" \\') FROM documents""",
)
def _(t):
    """Whole texts, also with quotes, line breaks and a last backslash, written as CSV and read back by the upload reader."""
    from stockcast.session import scratch_path

    docs = t.table("documents")
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        t.table("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    ).unionByName(docs.select(F.concat(F.lit("q"), "doc_id").alias("id"), F.concat(F.lit('"'), "text", F.lit('",\n "two\nlines" \\')).alias("text")))
    path = scratch_path(t.spark, "dialect")
    rows.write.options(header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **upload.DIALECT).csv(path)
    back = upload.read_upload(t.spark, path)
    return back.select("id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(
    "category_from_file_name",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Snacks' WHEN 1 THEN 'Staples' WHEN 2 THEN 'Edible Oil' WHEN 3 THEN 'Edible Oil' WHEN 4 THEN 'Edible Oil' END AS category FROM part""",
)
def _(t):
    path = F.expr(
        """concat('uploads/x/', CASE p_size % 6 WHEN 0 THEN 'Snacks_' WHEN 1 THEN 'STAPLES' WHEN 2 THEN 'edible_oil_' WHEN 3 THEN 'EdibleOil-'
           WHEN 4 THEN 'edible-oil' ELSE 'edible' END, p_partkey, '.csv')"""
    )
    return t.table("part").select("p_partkey", tx.category_from_file(path).alias("category"))


@query(
    "category_from_known_items",
    """SELECT p_partkey, arg_max(category, length(prefix)) AS category
       FROM (SELECT p_partkey, lower(replace(p_brand, '#', CASE p_size % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END))
                    || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || p_partkey AS stem FROM part)
       LEFT JOIN (SELECT DISTINCT lower(replace(p_brand, '#', mark)) AS prefix, replace(p_brand, '#', ' ') AS category
                  FROM part, (VALUES (' '), ('_'), ('-'), ('')) m(mark)) ON starts_with(stem, prefix)
       GROUP BY 1""",
)
def _(t):
    """Files named after brands, some with the number right behind, so that several brands begin the name."""
    part = t.table("part")
    items = part.select(F.replace("p_brand", F.lit("#"), F.lit(" ")).alias("category"))
    path = F.expr(
        """concat('in/', replace(p_brand, '#', CASE p_size % 3 WHEN 0 THEN '_' WHEN 1 THEN '-' ELSE '' END),
           CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END, p_partkey, '.csv')"""
    )
    files = part.select("p_partkey", path.alias("path"))
    # one row per item on both sides, however few bytes the file of the items has: no side is broadcast
    return files.join(upload.file_categories(files, upload.category_prefixes(items)).hint("merge"), "path").select("p_partkey", "category")


@query(
    "number_coercion",
    f"SELECT row_order, {num_sql('units_sold')} AS units, {num_sql('sku_id')} AS none FROM sales_once",
    ("sales_once",),
)
def _(t):
    rows = t.table("lineitem").selectExpr(*_items(SALES_RAW.format(**SPARK)))
    return rows.select("row_order", tx.to_number(F.col("units_sold")).alias("units"), tx.to_number(F.col("sku_id")).alias("none"))


@query(
    "date_coercion",
    f"SELECT row_order, CAST({day_sql('date')} AS VARCHAR) AS day FROM sales_once",
    ("sales_once",),
)
def _(t):
    rows = t.table("lineitem").selectExpr(*_items(SALES_RAW.format(**SPARK)))
    return plain(rows.select("row_order", tx.to_day(F.col("date")).alias("day")))


@query(
    "date_forms",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 8 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day FROM lineitem""",
)
def _(t):
    """One day in eight forms, and a text that is none."""
    d = F.to_date("l_shipdate")
    forms = [F.date_format(d, p) for p in ("yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "MM-dd-yyyy", "yyyyMMdd", "d MMM yyyy", "MMMM d, yyyy")]
    forms.append(F.when(F.dayofmonth(d) > 12, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    forms.append(F.date_format(d, "yyyy-13-dd"))
    text = F.get(F.array(*forms), F.col("l_orderkey").cast("int") % 9)
    return plain(t.table("lineitem").select("l_orderkey", "l_linenumber", tx.to_day(text).alias("day")))


# one file per supplier group: day first, month first, ISO, both orders in one file, days up to the 12th only, no such form
register_cte(
    "dated_files",
    """SELECT 'file-' || l_suppkey % 6 AS file, l_orderkey, l_linenumber,
              CASE l_suppkey % 6 WHEN 0 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y')
                   WHEN 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%d-%m-%Y') END
                   WHEN 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%m/%d/%Y') END
                   WHEN 4 THEN CASE WHEN day(l_shipdate) <= 12 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE 'n/a' END
                   ELSE strftime(l_shipdate, '%Y/%m/%d') END AS date
       FROM lineitem""",
)


@query(
    "date_order_by_file",
    """
    SELECT file, l_orderkey, l_linenumber, date_order,
           CAST(CAST(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%Y/%m/%d'),
                CASE WHEN date_order = 'day_first' THEN try_strptime(replace(date, '-', '/'), '%d/%m/%Y') ELSE try_strptime(replace(date, '-', '/'), '%m/%d/%Y') END) AS DATE) AS VARCHAR) AS day
    FROM dated_files JOIN (
        SELECT file, CASE WHEN max(a) > 12 AND max(b) > 12 THEN 'mixed' WHEN max(a) > 12 THEN 'day_first' WHEN max(b) > 12 THEN 'month_first'
                          WHEN max(a) IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS date_order
        FROM (SELECT file, TRY_CAST(nullif(regexp_extract(date, '^(\\d\\d)[/-](\\d\\d)[/-]\\d{4}$', 1), '') AS INTEGER) AS a,
                     TRY_CAST(nullif(regexp_extract(date, '^(\\d\\d)[/-](\\d\\d)[/-]\\d{4}$', 2), '') AS INTEGER) AS b FROM dated_files) GROUP BY file
    ) USING (file)""",
    ("dated_files",),
)
def _(t):
    """Dates of several files, each read in the order that fits all of its rows."""
    d = F.col("l_shipdate")
    first, second, odd = F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MM/dd/yyyy"), F.col("l_orderkey") % 2 == 1
    forms = [
        first, second, F.when(odd, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")), F.when(odd, second).otherwise(first),
        F.when(F.dayofmonth(d) <= 12, first).otherwise("n/a"), F.date_format(d, "yyyy/MM/dd"),
    ]
    number = (F.col("l_suppkey") % 6).cast("int")
    rows = t.table("lineitem").select(F.concat(F.lit("file-"), number.cast("string")).alias("file"), "l_orderkey", "l_linenumber", F.get(F.array(*forms), number).alias("date"))
    dated = upload.with_date_order(rows, F.col("file")).withColumn("day", tx.to_day(F.col("date"), order=F.col("day_first")))
    orders = upload.date_orders(rows, F.col("file")).select("file", "date_order")
    return plain(dated.join(orders, "file").select("file", "l_orderkey", "l_linenumber", "date_order", "day"))


ONE_FILE = 128 << 20  # bytes of text that one task writes


@query("csv_split_round_trip", ORACLES["csv_dialect_round_trip"])
def _(t):
    """The same texts in one file for each 128 MB of them, which is read in splits of 256 KB although rows hold line breaks."""
    from stockcast.session import cut, scratch_path

    docs = t.table("documents")
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        t.table("conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    ).unionByName(docs.select(F.concat(F.lit("q"), "doc_id").alias("id"), F.concat(F.lit('"'), "text", F.lit('",\n "two\nlines" \\')).alias("text")))
    path = scratch_path(t.spark, "one-file")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows.coalesce(size // ONE_FILE + 1).write.options(header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **upload.DIALECT).csv(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, "256k")
    try:
        back = cut(upload.read_upload(t.spark, path))
    finally:
        t.spark.conf.set(key, before)
    return back.select("id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))
