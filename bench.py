"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
(comma separated) other queries than the headline ones.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrier.queries import ALL  # noqa: E402
from terrier.session import local_session  # noqa: E402

HEADLINE = [
    "level_country", "level_region", "level_department", "level_commune", "level_zone",
    "level_parcel", "levels_by_span", "top_groups", "quantile_nearest", "iqr_filter",
    "outlier_chain", "time_adjusted_price", "keep_first_category", "flag_group",
    "proportional_allocation", "reduce_first_list_sum", "reduce_list_parts", "key_uniqueness",
    "region_lookup", "point_in_zone", "zone_counts", "project_points", "dissolve_edges",
    "dissolve_shapes", "tile_assign", "tile_density_cap", "geojson_explode", "export_keep_empty",
    "parcel_inner_join", "status_counts", "simplify",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "bench", **{"spark.sql.shuffle.partitions": cores})
    ALL["level_region"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        ALL[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
