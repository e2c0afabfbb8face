"""Throughput of the daily preparation job on local cores: throughput.py [sf_dir] [copies].

Writes the events ``copies`` times (with new ids) as TSV day directories to the scratch folder, then
times one run of the job with 30 days of history, without and with stored daily counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from clickloom.plans.prepare import Preparation, prepare_files  # noqa: E402
from clickloom.queries.base import impressions  # noqa: E402
from clickloom.session import local_session, scratch_path  # noqa: E402
from clickloom.sinks.logs import write_days  # noqa: E402

FIELDS = ["clk", "event_id", "dt", "user_id", "hour", "k", "event_type", "value"]
LAYOUT = "day={day}"


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 40
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("throughput", cores)
    source = scratch_path(spark, "raw")
    log = impressions(spark, sf_dir).repartition(cores)
    copied = log.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    ids = F.concat_ws("-", "event_id", "copy").alias("event_id")
    rows = copied.select("clk", ids, *FIELDS[2:], F.col("dt").alias("day"))
    write_days(rows, source, "day")
    days = [r[0] for r in log.select("dt").distinct().orderBy("dt").collect()]
    size, n_rows = 0, log.count() * copies
    for folder, _, names in os.walk(source):
        size += sum(os.path.getsize(os.path.join(folder, n)) for n in names if n.startswith("part-"))

    def run(features, counts=None):
        job = Preparation(features=features, keep=0.01)
        target = scratch_path(spark, "out")
        prepare_files(spark, source, target, days[-1:], FIELDS, "event_id", job, directory=LAYOUT, counts=counts)

    run(("user_id",))
    counts = scratch_path(spark, "counts")
    seconds = {
        "one feature": timed(lambda: run(("user_id",))),
        "three features": timed(lambda: run(("user_id", "hour", "k"))),
        "three features, counting": timed(lambda: run(("user_id", "hour", "k"), counts)),
        "three features, counted": timed(lambda: run(("user_id", "hour", "k"), counts)),
    }
    spark.stop()
    mb = size / 1e6
    report = {
        name: {"sec": round(s, 2), "rows_per_sec": round(n_rows / s), "mb_per_sec_per_core": round(mb / s / cores, 2)}
        for name, s in seconds.items()
    }
    print(json.dumps({"rows": n_rows, "mb": round(mb), "cores": cores, "runs": report}))


if __name__ == "__main__":
    main()
