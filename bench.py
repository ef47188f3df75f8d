"""Time the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    from stratapoint.functions import geometry as geo
    from stratapoint.functions import intra
    from stratapoint.operators import patching, spatial
    from stratapoint.plans.formats import lineitem, order, schema, values
    from stratapoint.sources.tables import read_patches, write_patches

    s, work = schema(101), f"/tmp/stratapoint-bench-{os.getpid()}"
    run = lambda df: df.write.format("noop").mode("overwrite").save()

    def build() -> None:
        chips = spatial.chip(lineitem(spark, sf_dir), F.col("l_extendedprice"), F.col("l_quantity"), 1000.0, order())
        write_patches(patching.patchify(chips, s, values(), ["cell", "part"], [F.col("nth")]), f"{work}/pa")

    pa = F.col("pa")
    table = lambda: read_patches(spark, f"{work}/pa")
    small = lambda: table().select("cell", "part", pa["bounds"].alias("box"))
    steps = {
        "patch_build": build,
        "scan_count": lambda: table().count(),
        "header_bounds": lambda: run(table().select(geo.envelope(pa))),
        "stats_only": lambda: run(table().select(pa["stats"]["min"][0], pa["stats"]["max"][0])),
        "full_decode": lambda: run(table().select(intra.uncompress(pa).alias("pa"))),
        "explode": lambda: run(patching.explode_points(table(), s, "pa")),
        "explode_columns": lambda: run(patching.explode_columns(table(), s, "pa")),
        "intra_filter": lambda: run(table().select(intra.filter_between(pa, s, "y", 10, 30).alias("p")).where("p is not null")),
        "union": lambda: run(patching.union(table().withColumn("g", F.col("cell") % 50), s, pa, ["g"], [F.col("cell"), F.col("part")])),
        "overlap_join": lambda: run(spatial.overlap_join(small(), small(), F.col("box"), F.col("box"), 1000.0)),
    }
    took = {}
    run(lineitem(spark, sf_dir).limit(1))
    for name, step in steps.items():
        began = time.time()
        step()
        took[name] = round(time.time() - began, 3)
    import shutil

    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
