"""Headline timings; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
Each query runs once to warm up code generation and is then timed; results go
to a sink that reads every column.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402

from stockcast.operators import clean, demand, model, reports, scenario  # noqa: E402
from stockcast.operators import decide as d  # noqa: E402
from stockcast.plans.batch import forecast_decisions, models_for  # noqa: E402
from stockcast.session import build_session  # noqa: E402
from stockcast.sources import festivals as fest  # noqa: E402
from stockcast.sources import store  # noqa: E402
from suite.base import Domain, as_of, festival_day  # noqa: E402
from suite.ingest_checks import known, raw_sales  # noqa: E402


def bench_queries(t: Domain) -> dict:
    item = ["sku_id"]
    return {
        "daily_category_demand": lambda: t.daily,
        "category_training_frame": lambda: demand.training_frame(t.daily, t.festivals),
        "item_training_frame": lambda: demand.training_frame(
            demand.daily_demand(t.sales, t.skus, ["sku_id", "category"]), t.festivals, item
        ),
        "category_fit": lambda: models_for(t.sales, t.skus, t.festivals),
        "item_fit": lambda: models_for(t.sales, t.skus, t.festivals, item),
        "category_forecast_30d": lambda: model.forecast(models_for(t.sales, t.skus, t.festivals), t.festivals, 30),
        "item_forecast_30d": lambda: model.forecast(models_for(t.sales, t.skus, t.festivals, item), t.festivals, 30, item),
        "category_decisions_60d": lambda: forecast_decisions(t.sales, t.skus, t.festivals, t.params, as_of(), 60),
        "scenario_report": lambda: scenario.scenario_report(t.forecast, t.scenarios, t.params, as_of()),
        "portfolio_kpis": lambda: reports.portfolio_kpis(reports.portfolio_rows(t.forecast, d.decide(t.forecast, t.params, as_of()))),
        "clean_sales_upload": lambda: clean.clean_sales(raw_sales(t), known(t)),
        "sales_upload_metrics": lambda: clean.ingestion_metrics(raw_sales(t), "sales", known(t)),
        "sales_upsert": lambda: store.upsert(t.sales, t.sales.withColumn("units_sold", t.sales.units_sold + 1), ["date", "sku_id"]),
        "festival_rollup": lambda: fest.rollup(t.festivals, festival_day()),
        "same_day_history": lambda: demand.same_day_history(t.daily, t.daily.select("category", "date")),
    }


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            # local test data is far below the sizes the default merge of small partitions is meant for
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Domain(spark, folder)
    seconds: dict[str, float] = {}
    for name, build in bench_queries(t).items():
        drain(build())
        start = time.perf_counter()
        drain(build())
        seconds[name] = round(time.perf_counter() - start, 3)
    items = t.skus.count()
    rows = t.table("lineitem").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds_all_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "item_series": items,
                "item_series_forecast_per_sec": round(items / seconds["item_forecast_30d"], 1),
                "upload_rows_cleaned_per_sec": round(rows / seconds["clean_sales_upload"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
