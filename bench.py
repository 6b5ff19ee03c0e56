"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxweave.plans import load  # noqa: E402

HEADLINE = ["img1_normals_from_points", "img7_bilateral", "img4_pyramid_depth", "vox14_ray_blocks", "vox16_fuse",
            "str3_fuse_given_poses", "vox17_interpolate", "vox18_generate_depth", "msh1_extract_mesh", "msh11_vertex_normals",
            "ray2_nearest_triangle", "ras4_z_buffer", "knn4_node_edges", "knn6_pixel_edges", "bld5_blend_mesh",
            "sol1_normal_equations", "sol12_normal_matrix", "str4_nearest_in_time", "str7_running_mean",
            "knn11_large_k", "sol2_register_frames", "str1_streamed_fusion"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-ck-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf}/events.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
