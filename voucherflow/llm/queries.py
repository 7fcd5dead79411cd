"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classlm, jaccard, linededup, mixing, secrets, warc, weakrules
from .classlm import op1_class_lm
from .jaccard import op6_ngram_jaccard
from .linededup import op3_line_dedup
from .mixing import op7_source_mix
from .qda import op8_quality_qda
from .secrets import op10_secret_links
from .tagpaths import op4_html_text
from .templates import op5_template_decontam
from .warc import op2_warc_roundtrip
from .weakrules import op9_weak_rules


def base_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 1's result SQL can express: all but the class model's score."""
    return op1_class_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def base_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 9's result SQL can express: all but the verdict."""
    return op9_weak_rules(spark, sf_dir).select("doc_id", *weakrules.BASE, "base_failed")


QUERIES = {
    "op1_class_lm": op1_class_lm,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_text": op4_html_text,
    "op5_template_decontam": op5_template_decontam,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_source_mix": op7_source_mix,
    "op8_quality_qda": op8_quality_qda,
    "op9_weak_rules": op9_weak_rules,
    "op10_secret_links": op10_secret_links,
    "base_op1": base_op1,
    "base_op9": base_op9,
}

ORACLE_SQL: dict[str, str] = {
    "base_op1": classlm.BASE_ORACLE,
    "base_op9": weakrules.BASE_ORACLE,
    "op2_warc_roundtrip": warc.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op6_ngram_jaccard": jaccard.ORACLE,
    "op7_source_mix": mixing.ORACLE,
    "op10_secret_links": secrets.ORACLE,
}
