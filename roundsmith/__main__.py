"""python -m roundsmith [file.dem] [--decoder module:function] [--knowledge path]: advice for one recorded match."""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession, functions as F

from roundsmith.functions.providers import hashing_embedder
from roundsmith.functions.render import local_log
from roundsmith.functions.scalar import PREVIEW_CHARS, prefix
from roundsmith.plans import demos, workflow
from roundsmith.plans.lineage import saved
from roundsmith.sources import tables


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None) -> int:
    """Decodes a file, runs the workflow on its text (cut to the local limit), appends both reports to the local log (each run an entry of its own) and
    prints a preview of the advice. 1 if the file is missing or has no rounds, or a report could not be had."""
    parser = argparse.ArgumentParser(prog="roundsmith")
    parser.add_argument("path", nargs="?", default="data/sample.dem")
    parser.add_argument("--decoder", default=os.environ.get("ROUNDSMITH_DECODER", ""))
    parser.add_argument("--knowledge", default=None)
    options = parser.parse_args(argv)
    if not os.path.exists(options.path):
        print(f"no such file: {options.path}", file=sys.stderr)
        return 1
    settings = tables.Settings.load()
    spark = spark or SparkSession.builder.appName("roundsmith").getOrCreate()
    embed = hashing_embedder()
    path = options.knowledge or settings.knowledge_path
    if options.knowledge is None and not os.path.exists(path):
        tables.write_knowledge(tables.seed_documents(spark), path, embed)
    retrieve = workflow.knowledge_retriever(spark.read.parquet(path), embed=embed)
    state = saved(demos.analyse(demos.read(spark, [options.path], options.decoder), retrieve, provider, cut=True), "local")
    row = state.select("match_id", "error", "coach_advice", prefix(F.col("coach_advice"), PREVIEW_CHARS).alias("preview")).first()
    if row is None or row["coach_advice"] is None:
        print(row["error"] if row and row["error"] else "the file holds no rounds", file=sys.stderr)
        return 1
    entry = state.select(local_log(F.col("match_id"), F.col("map_name"), F.col("n_rounds"), F.col("analyst_report"), F.col("coach_advice")).alias("value"))
    tables.append_log(entry, f"{settings.log_path}_local", f"run={time.time_ns()}-{uuid.uuid4().hex[:8]}")
    print(row["preview"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
