"""Times of the headline queries, as one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

from barspark.session import get_session

HEADLINE = (
    "bars_daily",
    "bars_15m",
    "ind_window",
    "ind_multi_ma",
    "ind_ema_macd",
    "ind_kdj",
    "ind_dmi",
    "cond_price",
    "cond_kd",
    "cond_flow",
    "asof_flow",
    "store_upsert",
    "screen_technical",
    "portfolio_periods",
    "backtest_trades",
    "backtest_metrics",
    "sweep_grid",
    "volume_profile",
    "pattern_range",
    "pattern_swings",
    "fibonacci",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus), spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    from barspark.queries import QUERIES

    took: dict[str, float] = {}
    QUERIES["entry_ma_cross"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
