"""From raw documents to a training mix, in stages that each work on all that the one before kept.

Every stage is written as Parquet below ``spark.checkpoint.dir`` and read again, so a failure repeats one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voucherflow.llm.common import written
from voucherflow.llm.jaccard import one_of_each_group
from voucherflow.llm.linededup import drop_repeated_lines
from voucherflow.llm.mixing import mixed
from voucherflow.llm.qda import keep_quality
from voucherflow.llm.templates import drop_contaminated
from voucherflow.sources.scratch import discard

STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("source mix", mixed),
]

#: Fitted covariances, MinHash and winnowing have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
