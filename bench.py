"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from gridwise.plans import registry
from gridwise.session import clear, session

HEADLINE = (
    "nearest_line_prior_rank", "regional_rank", "known_new_semi", "clearance_anti", "endpoint_candidate_matches", "annulus_counts", "building_fill_boxes",
    "line_km_per_cell", "auc_average_rank", "fusion_threshold_sweep", "masked_median_composite", "hysteresis_components_8x8", "focal_contrast_8x8", "hann_overlap_add",
    "proportional_negative_cap", "dedupe_grid_first", "atlas_grid_rollup", "polygon_known_mark", "polygon_overlap_fill", "polygon_intersection_area", "warp_to_grid", "composite_run", "postprocess_run", "endpoint_leads_run", "chip_centres", "roi_cells_run",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "12g", int(cpus))
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first one warms up
            t = time.perf_counter()
            registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(median(runs[1:]), 3)
        clear(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
