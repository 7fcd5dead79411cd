"""Operator 9: quality rules as weak labels.

Each rule votes good or bad or abstains. The votes of one document are a pattern, of which there are at most 3 ** rules, so what
expectation-maximisation needs of the corpus is the count of each pattern: it estimates the share of good documents and each rule's vote
probabilities given the class, and yields a posterior per pattern that replaces "all rules must pass". EM starts from the belief
that bad votes are rare on good documents, and a rule that would vote against its meaning is held at no information.

Defined cases: a null or empty text has no words and fails the base rule; a null doc_id is a document like any other; repeated rows count as
often as they occur; a pattern in which every rule abstains gets the estimated share of good documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table, written
from .textstats import stats

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BAD, ABSTAIN, GOOD = 0, 1, 2


def _vote(value: float, good: float, bad: float) -> int:
    """Good on the near side of ``good``, bad beyond ``bad``; which way is larger follows from the two."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


#: name, value of the statistics, good up to (or from), bad from (or up to); a None value abstains
RULES = [
    ("length", lambda s: s["n_words"], 50, 20),
    ("word length", lambda s: abs(s["word_chars"] / s["n_words"] - 5.5) if s["n_words"] else None, 3.0, 5.0),
    ("symbols", lambda s: s["n_symbols"] / max(1, s["word_chars"]), 0.01, 0.05),
    ("symbol runs", lambda s: s["n_symbol_runs"] / max(1, s["n_words"]), 0.01, 0.05),
    ("words ending in symbols", lambda s: s["n_symbol_ends"] / max(1, s["n_words"]), 0.02, 0.1),
    ("repeated lines", lambda s: s["n_dup_lines"] / s["n_lines"] if s["n_lines"] > 2 else None, 0.1, 0.3),
    ("repeated words", lambda s: s["n_repeat_words"] / s["n_words"] if s["n_words"] else None, 0.1, 0.3),
    ("ended lines", lambda s: s["n_ended_lines"] / s["n_lines"] if s["n_lines"] else None, 0.7, 0.3),
    ("capitals", lambda s: s["n_upper"] / max(1, s["n_upper"] + s["n_lower"]), 0.15, 0.4),
    ("shouts", lambda s: s["n_shouts"] / max(1, s["n_words"]), 0.05, 0.2),
    ("digits", lambda s: s["n_digit"] / max(1, s["word_chars"]), 0.05, 0.2),
    ("variety", lambda s: s["n_distinct"] / s["n_words"] if 50 <= s["n_words"] <= 2000 else None, 0.35, 0.2),
]


def votes(s: dict[str, int]) -> int:
    """The votes as digits of base 3."""
    pattern = 0
    for _, value, good, bad in RULES:
        v = value(s)
        pattern = 3 * pattern + (ABSTAIN if v is None else _vote(v, good, bad))
    return pattern


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [stats(x) for x in batch["text"].cast(pa.binary()).to_pylist()]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in BASE]
        yield pa.record_batch([batch["doc_id"], *columns, pa.array([votes(r) for r in rows], pa.int64())], names=["doc_id", *BASE, "votes"])


#: Where EM starts: bad votes are rare on good documents, and bad documents mostly break few of the rules. Rows: class bad, good; columns: votes bad, abstain, good.
START = np.array([[0.3, 0.2, 0.5], [0.02, 0.1, 0.88]])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, floor: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: share of good, table[rule, class, vote], and the posterior of each pattern."""
    k = len(RULES)
    digits = (patterns[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3
    table, share = np.tile(START, (k, 1, 1)), 0.8
    post = np.full(len(patterns), -1.0)
    for i in range(rounds):
        log = np.log(table)
        gap = np.log(share / (1 - share)) + sum(log[r, 1, digits[:, r]] - log[r, 0, digits[:, r]] for r in range(k))
        old, post = post, 1 / (1 + np.exp(-np.clip(gap, -700, 700)))
        if len(post) == 0 or i == rounds - 1 or np.abs(old - post).max() < 1e-9:
            break
        weight = np.stack([counts * (1 - post), counts * post])
        share = (weight[1].sum() + floor) / (weight.sum() + 2 * floor)
        for r in range(k):
            for c in (0, 1):
                n = np.bincount(digits[:, r], weight[c], 3) + floor
                table[r, c] = n / n.sum()
            against = (table[r, 1, GOOD] < table[r, 0, GOOD]) and (table[r, 1, BAD] > table[r, 0, BAD])
            if against:
                table[r, :] = table[r].mean(0)
    return share, table, post


def weak_quality(docs: DataFrame, *, threshold: float = 0.02) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior and the votes, a digit a rule: 0 bad, 1 abstains, 2 good.

    ``threshold`` is low, so a document goes only if its votes make it almost surely bad.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    counted = written(docs.mapInArrow(_count, f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, votes long"), "weak-counts")
    patterns = counted.groupBy("votes").count().orderBy("votes").toArrow()  # at most 3 ** len(RULES) rows
    _, _, post = estimate(patterns["votes"].to_numpy(), patterns["count"].to_numpy().astype(float))
    posterior = spark.createDataFrame(list(zip(patterns["votes"].to_pylist(), map(float, post), strict=True)), "votes long, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    text = F.lpad(F.conv("votes", 10, 3), len(RULES), "0")
    scored = counted.join(F.broadcast(posterior), "votes", "left").withColumn("base_failed", failed)
    return scored.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior", text.alias("votes"))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


#: The base columns by plain counting; a text's number is unique.
BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT at_) AS again FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_ FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
