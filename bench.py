"""Headline queries, timed once warm on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.model import Options
from commitlens.operators.coupling import coupling
from commitlens.plans.catalogue import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def made_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coupling micro-benchmark's frame: 10,000 revisions of 20 rows over 10 entities."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("r"), F.floor(F.col("id") / 20).cast("string")).alias("rev"),
        F.format_string("pkg/module%d/file.go", F.col("id") % 20 % 10).alias("entity"),
    )
    return coupling(rows, Options(min_revs=1, min_shared_revs=1, min_coupling=0, max_changeset_size=100))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = QUERIES | {"coupling_micro": made_changes}

    def timed(name: str) -> float:
        began = time.perf_counter()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    timed("entity_ownership")  # starts the session and its compilers
    seconds = {name: timed(name) for name in found}
    print(json.dumps({"metric": "catalogue_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
