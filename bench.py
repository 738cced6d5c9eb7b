"""Headline queries on $BENCH_SF_DIR; prints one JSON line.

Each query runs twice on ``local[$BENCH_CPUS]``, every row computed and thrown
away; the faster run counts. Where a query has SQL, DuckDB's time for it on
the same files is given beside it, and the rows of the main input per second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tideline.plans import ORACLES, QUERIES  # noqa: E402
from tideline.session import local_session  # noqa: E402

HEADLINE = {
    "clean_profile": "customer",
    "menu_violations": "customer",
    "ratio_feature": "orders",
    "churn_rate_by": "customer",
    "numeric_by_label": "customer",
    "baseline_profile": "customer",
    "stratified_split": "orders",
    "stratified_folds": "orders",
    "bootstrap_sample": "orders",
    "fold_stats": "customer",
    "roc_auc": "lineitem",
    "pr_f1_curve": "lineitem",
    "operating_point_by_segment": "lineitem",
    "threshold_metrics": "lineitem",
    "isotonic_fit": "lineitem",
    "percentile_nearest_rank": "events",
    "linear_score": "customer",
    "top_drivers": "customer",
    "normalize_text": "documents",
    "redact_documents": "documents",
    "validate_request": "events",
    "session_profile": "events",
    "call_budget": "events",
    "process_turns": "events",
    "answer_turns": "events",
    "fit_logistic_scores": "customer",
    "call_budget_stream": "events",
    "session_profile_stream": "events",
}


def connect(sf_dir: str):
    """DuckDB with a view for every table of the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    duck = connect(sf_dir)
    duck.execute(f"SET threads={cpus}")
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds, rate, duck_seconds = {}, {}, {}
    for name, source in HEADLINE.items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        rate[name] = round(sizes[source] / min(runs))
        if name in ORACLES:
            start = time.perf_counter()
            duck.execute(ORACLES[name]).fetchall()
            duck_seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
                "cpus": cpus,
                "input_rows_per_sec": rate,
                "duckdb_sec": duck_seconds,
            }
        )
    )


if __name__ == "__main__":
    main()
