"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment.

The unit is a block of ``block_words`` words. Sainte-Laguë gives each source its number of blocks by the highest quotients target / (2 k + 1), and
the same rule deals a source's blocks to its shards in proportion to their words; a shard is a hash part of a source of some ``shard_docs``
documents, so a source of any size is spread over many tasks. Inside a shard, documents stand in a seeded order and their words
form a circle; the blocks taken are those from a seeded start on, round the circle as often as the quota asks. Seats are found by searching the divisor, not by
handing them out one by one, so the cost does not depend on the number of blocks.

What reaches the driver is a row per source, of which there may be ``max_sources`` (beyond, it refuses), and a row per shard, of which there are at most ``max_shards`` more than sources.

Defined cases: a null text has size 0; null sources are one source, sorted last; sources of size 0 have target 0; a quota stops at twice the shard's
words, so no document is taken more than twice; rows that repeat in all columns each have a place of their own, adjacent in order, but are one row with a number until the end, so they fill no task; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded, pick, table, written

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """Weights share ``share`` of all words; a source stops at ``most`` times its size, the excess goes on by weight."""
    cap = most * sizes.astype(float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * float(sizes.sum())
    while free.any():
        part = left * weights / weights[free].sum()
        over = free & (part > cap)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out


def sainte_lague(claims: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients claim / (2 k + 1), none above ``most``; ties go to the first."""
    claims, most = claims.astype(float), np.minimum(most, seats).astype(np.int64)
    most = np.where(claims > 0, most, 0)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(len(claims), np.int64)
    given = lambda d: np.minimum(np.floor(claims / d + 0.5), most).astype(np.int64)
    low, high = claims[claims > 0].min() / (2.0 * seats + 2), 2 * claims.max() + 1  # divisors that give too many, none
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    out = given(high)
    while (short := seats - int(out.sum())) > 0:  # the seats whose quotients equal the last one
        quotient = np.where(out < most, claims / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[:short]] += 1
        out = np.minimum(out, most)
    return out


def _number(*parts: Column | int) -> Column:
    """32 bits of a hash that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(str(x)) if isinstance(x, int) else F.coalesce(x.cast("string"), F.lit("")) for x in parts))), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, *columns: str, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 16, shard_docs: int = 2000, max_shards: int = 50_000, max_sources: int = 1_000_000, seed: int = 7) -> DataFrame:
    """doc_id, the further ``columns``, size, source_size, target, taken."""
    spark = docs.sparkSession
    also = [c for c in columns if c not in ("source", "text")]
    docs = pick(docs, "doc_id", *dict.fromkeys(["source", "text", *columns])).withColumn("key", F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 16))
    # equal rows are one, with their number: however many they are, they can stand in one shard
    sized = docs.select("doc_id", "source", "key", *also, n_words(F.col("text")).alias("size"), F.col("text").isNull().alias("no_text"))
    sized = written(sized.groupBy("doc_id", "source", "key", *also, "size", "no_text").agg(F.count("*").alias("copies")), "mix-sizes")

    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("n")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources: weights by source need names that stand for more than single sites")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares strings by code point
    words = np.array([r["words"] for r in sources], np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(sources))], float)
    goal = targets(words, weight, share, most)
    per_shard = max(shard_docs, math.ceil(sum(r["n"] for r in sources) / max_shards))
    rows = [(i, r["source"], int(words[i]), float(goal[i]), -(-r["n"] // per_shard)) for i, r in enumerate(sources)]
    plan = spark.createDataFrame(rows, "s int, source string, source_size long, target double, shards long")
    # the plan has a row per source; Spark broadcasts it if its size allows
    placed = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.s", "p.source_size", "p.target", "p.shards")
    placed = placed.withColumn("shard", _number(seed, F.col("doc_id"), F.col("key")) % F.col("shards")).withColumn("width", F.col("size") * F.col("copies"))

    parts = placed.groupBy("s", "shard").agg(F.sum("width").alias("words")).orderBy("s", "shard").toPandas()
    seats = math.floor(min(share, most) * int(words.sum()) / block_words + 0.5)
    blocks = sainte_lague(goal, seats, np.ceil(most * words / block_words))
    quota = np.zeros(len(parts), np.int64)
    owner, held = parts["s"].to_numpy(), parts["words"].to_numpy()
    edges = np.searchsorted(owner, np.arange(len(sources) + 1))
    for i in range(len(sources)):
        at = slice(edges[i], edges[i + 1])
        quota[at] = sainte_lague(held[at], int(blocks[i]), np.ceil(most * held[at] / block_words)) * block_words
    quota = np.minimum(quota, np.floor(most * held).astype(np.int64))
    quotas = spark.createDataFrame(list(zip(owner.tolist(), parts["shard"].tolist(), held.tolist(), quota.tolist(), strict=True)), "s int, shard long, words long, quota long")

    order = W.partitionBy("s", "shard").orderBy(_number(seed + 1, F.col("doc_id"), F.col("key")), "doc_id", "key", *also, "no_text").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("stop", F.sum("width").over(order)).join(quotas, ["s", "shard"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    placed = placed.withColumn("last", F.col("stop") - (F.col("copies") - F.col("copy")) * F.col("size"))
    # round the circle: whole rounds, then the arc [start, start + rest), which may pass the end once
    whole, rest = F.floor(F.col("quota") / F.greatest("words", F.lit(1))), F.col("quota") % F.greatest("words", F.lit(1))
    start = _number(seed + 2, F.col("s"), F.col("shard")) % F.greatest("words", F.lit(1))
    placed = placed.withColumns({"whole": whole, "rest": rest, "start": start, "first": F.col("last") - F.col("size")})
    arc = lambda a, b: F.greatest(F.lit(0), F.least(F.col("last"), b) - F.greatest(F.col("first"), a))
    end = F.col("start") + F.col("rest")
    taken = F.col("whole") * F.col("size") + arc(F.col("start"), F.least(end, F.col("words"))) + arc(F.lit(0), end - F.col("words"))
    placed = placed.withColumn("taken", taken.cast("long"))
    if "text" in columns:  # the texts meet the numbers once, and are not counted again
        texts = docs.select("doc_id", "key", "text").groupBy("doc_id", "key").agg(F.max("text").alias("text"))
        placed = placed.alias("p").join(texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.key") == F.col("t.key"))).select("p.*", F.when(~F.col("p.no_text"), F.col("t.text")).alias("text"))
    return placed.select("doc_id", *columns, "size", "source_size", "target", "taken")


#: The same with every quotient written out; for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(text, '')), 1, 16) AS key FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, count(*) AS n FROM d GROUP BY source),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM g),
w AS (SELECT *, CAST([5, 2, 1][s % 3 + 1] AS DOUBLE) AS weight, CAST(2 * words AS DOUBLE) AS cap, (SELECT sum(words) FROM s) AS total, (SELECT sum(n) FROM s) AS docs FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, s) AS pos, 1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
f AS (SELECT * FROM o WHERE left_ * weight / free <= cap ORDER BY pos LIMIT 1),
p AS (SELECT o.s, o.source, o.words, o.n, CASE WHEN f.pos IS NULL OR o.pos < f.pos THEN o.cap ELSE f.left_ * o.weight / f.free END AS target, CAST(ceil(o.n / greatest(2000, ceil(o.docs / 50000))) AS BIGINT) AS shards, o.total FROM o LEFT JOIN f ON true),
q AS (SELECT s, k, target / (2 * k + 1) AS quotient FROM (SELECT s, target, unnest(range(0, CAST(ceil(2 * words / 16) AS BIGINT))) AS k FROM p)),
b AS (SELECT s, count(*) AS blocks FROM (SELECT s, row_number() OVER (ORDER BY quotient DESC, s, k) AS r FROM q) WHERE r <= (SELECT floor(1.5 * any_value(total) / 16 + 0.5) FROM p) GROUP BY s),
e AS (SELECT d.*, p.s, p.words AS source_size, p.target, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || key), 1, 8))::BIGINT % p.shards AS shard, ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '') || ':' || key), 1, 8))::BIGINT AS turn FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
h AS (SELECT s, shard, CAST(sum(size) AS BIGINT) AS held FROM e GROUP BY s, shard),
z AS (SELECT s, shard, row_number() OVER (PARTITION BY s ORDER BY held / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT s, shard, held, unnest(range(0, CAST(ceil(2 * held / 16) AS BIGINT))) AS k FROM h)),
t AS (SELECT h.s, h.shard, greatest(h.held, 1) AS held, least(16 * count(z.r), 2 * h.held) AS quota FROM h LEFT JOIN b USING (s) LEFT JOIN z ON z.s = h.s AND z.shard = h.shard AND z.r <= b.blocks GROUP BY h.s, h.shard, h.held),
c AS (SELECT e.*, t.held, t.quota // t.held AS whole, t.quota % t.held AS rest, ('0x' || substr(md5('9:' || e.s || ':' || e.shard), 1, 8))::BIGINT % t.held AS start,
  CAST(sum(size) OVER (PARTITION BY e.s, e.shard ORDER BY turn, doc_id, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last FROM e JOIN t USING (s, shard))
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(last, start + rest, held) - greatest(last - size, start)) + greatest(0, least(last, start + rest - held) - (last - size)) AS BIGINT) AS taken FROM c
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of which the mix takes words, with how many it takes, repeats counted."""
    bounded(spark)
    out = mix(docs, *[c for c in DOCUMENT_COLUMNS if c != "doc_id"])
    return out.where("taken > 0").select(*DOCUMENT_COLUMNS, "size", "source_size", "target", "taken")
