"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from worldstate.plans import QUERIES
from worldstate.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "players_per_zone zone_assign_many_zones plan_transfers overload_report split_plan server_metrics "
    "latest_state moved_since_last tick_sample parse_change_feed publish_change_feed config_in_effect "
    "membership_intervals current_parent player_sessions metrics_windows keep_last_messages batch_assign "
    "batch_stats batch_size_controller chunk_index focus_load focus_contents moved_chunks camera_updates "
    "entities_near containing_field near_any hierarchy_paths node_bounds upsert_entities diff_tables expect "
    "clean_player_name text_color quadtree_tiles entity_state_stream player_sessions_stream write_batches"
).split()


def run_once(spark, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=int(CPUS), memory="12g")
    times = {}
    for name in names:
        run_once(spark, name)  # warm-up: class loading, code generation, file listing
        times[name] = round(run_once(spark, name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": FOLDER}))


if __name__ == "__main__":
    main()
