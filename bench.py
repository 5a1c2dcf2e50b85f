"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "period_compare_count_group",
    "period_compare_distribution",
    "distribution",
    "top_n",
    "event_window_count",
    "agg_multi",
    "join_outer",
    "calc_share_partition",
    "clean_whitespace",
    "clean_dedup",
    "tokens_count",
    "keyword_table",
    "word_cloud",
    "aspect_sentiment_matrix",
    "run_comparison",
    "recent_year_stats",
    "sentence_chunks",
)


def main() -> None:
    from loomtext import workload
    from loomtext.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus=cpus, memory="16g", name="bench")
    run = lambda name: workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # the session's own start is not a query's time
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
