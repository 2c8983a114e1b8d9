"""Headline timings: ONE JSON line.

Generated cases of 1,000, 10,000 and 100,000 findings a side, read, compared and measured (``BENCH_SIZES``
names others), and headline queries over the tables in ``BENCH_SF_DIR``, written to a sink that keeps
nothing.  ``counts`` holds the operation counts, which must be the same on every machine.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SIZES = [int(x) for x in os.environ.get("BENCH_SIZES", "1000,10000,100000").split(",")]
QUERIES = ("versioned_hash", "message_canonical", "segment_collapse", "fp_compare", "decision_vector", "mutual_unique_link", "run_summary")


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parent))
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from findrift.plans import bench
    from findrift.queries import QUERIES as registered

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxPlanStringLength", "10000").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bench.run(spark, 1_000, "unique")  # the first run compiles
    seconds, counts, budgets = {}, {}, {}
    for kind, sizes in (("unique", SIZES), ("pathological", SIZES[:1])):
        for size in sizes:
            r = bench.run(spark, size, kind)
            name = f"{kind}_{size}"
            seconds[name] = round(sum(r["observations"]["seconds"].values()), 3)
            counts[name] = {k: r["operations"][k] for k in ("candidateEdges", "components", "ambiguousComponents", "largestComponent")}
            budgets[name] = r["budget"]["seconds"]
    for name in QUERIES:
        if name in registered:
            began = time.time()
            registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"), "counts": counts, "budgets": budgets}))


if __name__ == "__main__":
    main()
