"""Benchmark: the headline flows at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.  Every query
is forced to completion with the ``noop`` sink (full execution, nothing collected to
the driver).  Each query runs twice; ``queries`` holds the warm (second) time and
``cold`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from facsimile.operators import profile, quality  # noqa: E402
from facsimile.operators.copula import synthesize_copula  # noqa: E402
from facsimile.operators.synth import synthesize_independent  # noqa: E402
from facsimile.plans.batch import synthesize_batch  # noqa: E402
from facsimile.schema import SynthConfig  # noqa: E402
from facsimile.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_session(f"local[{CPUS}]", shuffle_partitions=max(2, CPUS),
                        extra={"spark.driver.memory": "16g"})
    load = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    li = load("lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

    def q_profile():
        profile.profile(li)
        sink(profile.describe(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]))

    def q_synth_md5():
        sink(synthesize_independent(li.select(*cols), SynthConfig(seed=1)))

    def q_synth_fast():
        sink(synthesize_independent(li.select(*cols), SynthConfig(seed=1, fast=True)))

    def q_copula():
        sink(synthesize_copula(li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"),
                               SynthConfig(seed=1, fast=True)))

    def q_report():
        a, b = li.where(F.col("l_orderkey") % 2 == 0), li.where(F.col("l_orderkey") % 2 == 1)
        sink(quality.quality_report(a.select(*cols[:4]), b.select(*cols[:4])))

    def q_batch():
        o = load("orders").select(F.col("o_orderpriority").alias("dataset"), "o_totalprice", "o_orderstatus",
                                  "o_custkey")
        sink(synthesize_batch(o, config=SynthConfig(seed=1, method="independent")))

    plan = [("profile", q_profile), ("synth_independent", q_synth_md5), ("synth_independent_fast", q_synth_fast),
            ("copula", q_copula), ("quality_report", q_report), ("batch", q_batch)]
    sink(spark.range(1000).select(F.md5(F.col("id").cast("string"))))   # JVM warm-up, not timed
    warm, cold = {}, {}
    for name, fn in plan:
        t = time.perf_counter()
        fn()
        cold[name] = round(time.perf_counter() - t, 3)
        t = time.perf_counter()
        fn()
        warm[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": sf, "cpus": CPUS,
                      "rows": {"lineitem": li.count()}}))
    spark.stop()


if __name__ == "__main__":
    main()
