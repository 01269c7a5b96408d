"""Time the headline queries: one JSON line with seconds by query."""

from __future__ import annotations

import json
import os
import time

from sweepline.plans import registry
from sweepline.session import local_session

HEADLINE = (
    "merge_build", "voxel_downsample", "occupancy_grid", "revisit_overlap", "map_windows_shared_cells", "knn_topk", "outlier_filter",
    "asof_pose", "section_breaks", "path_length", "loop_candidates", "interval_merge", "min_delay_envelope", "scan_assembly",
    "clock_sweep_ncc", "nmea_roundtrip", "geodetic_ecef_enu", "las_quantise",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["merge_build"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
