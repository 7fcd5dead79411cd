"""Operator 6: n-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. A text's n-grams of words (five) are hashed to 64 bits; a text with fewer words is one n-gram. Texts with equal sets are one *class*, whatever the number of copies,
   and only classes go on.
2. MinHash values are cut into ``bands`` of ``rows``. Two texts of similarity s share a band with probability 1 - (1 - s**rows)**bands: for
   the defaults 0.99992 at 0.8 and under 0.009 at 0.3. ``plan_bands`` finds them for another threshold and recall.
3. Classes are shuffled on band hashes. A bucket yields its members' edges to its least member, not its pairs; the connected components of these edges hold every
   candidate pair.
4. Pairs are verified on the full sets. A component of up to ``block`` classes is a *unit*: one task compares its members. A larger one is verified in the cheaper of two ways, by the number of texts that must be
   sent: as one unit, which suits a true group of copies, or with each of its buckets as a unit, which suits a chain of chance collisions, where all pairs of the component would be far more than
   the candidates. Buckets of the same members count once, and a pair is compared in its first common bucket only. Units are cut into blocks of ``block`` classes, and a task has two
   blocks: the work on a large unit is spread, and what is returned is each class's number of links and a spanning forest of the links, not the pairs.
5. The connected components of the links are the groups.

Result: one row per document with the group's id, its own text's id, and its text's links to other texts.

Defined cases: a null text is empty; texts without words are copies of each other and linked to nothing else; ids are the least doc_id, null if no document of the
group has one; rows that repeat are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded, documents, table, written
from .graph import components

P = np.uint64(0x9E3779B97F4A7C15)


def plan_bands(threshold: float, recall: float, most_hashes: int = 512) -> tuple[int, int]:
    """(bands, rows): the most selective pair that reaches the recall at the threshold with so many hash values."""
    best = None
    for rows in range(1, 33):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def ngrams(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams of words."""
    words = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) >= n:
        m = len(h) - n + 1
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * P + h[i : i + m]
    elif len(h):
        out = h[:1] * P + np.uint64(len(h))
        for x in h[1:]:
            out = out * P + x
    else:
        return h
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, bands * rows, np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)[:, None]
        self.p = rng.integers(0, 1 << 62, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = np.arange(bands, dtype=np.uint64) * P
        self.bands, self.rows = bands, rows

    def __call__(self, grams: np.ndarray, step: int = 1024) -> np.ndarray:
        """The band hashes of a set that is not empty."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = None
        for i in range(0, len(x), step):
            v = self.a * x[None, i : i + step]
            v += self.b
            v = v.min(1)
            low = v if low is None else np.minimum(low, v)
        h = (low.reshape(self.bands, self.rows).astype(np.uint64) * self.p).sum(1) + self.band
        h ^= h >> np.uint64(32)
        h *= P
        h ^= h >> np.uint64(29)
        return h.view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            sets, hashes = [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                grams = ngrams(text, n)
                sets.append(xxhash.xxh3_128_digest(grams.tobytes()))
                hashes.append(minhash(grams) if len(grams) else [])
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array(sets, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "key", "set", "bands"])

    return run


def intersections(sets: list[np.ndarray], most: int = 5_000_000) -> np.ndarray:
    """Sizes of all pairwise intersections, in pieces of at most ``most`` cells."""
    n = len(sets)
    gram, count = np.unique(np.concatenate(sets), return_counts=True)
    gram = gram[count > 1]  # others are in one set
    out = np.zeros((n, n), np.float32)
    width = max(1, most // n)
    for i in range(0, len(gram), width):
        part = gram[i : i + width]
        m = np.zeros((n, len(part)), np.float32)
        for r, s in enumerate(sets):
            s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
            at = np.searchsorted(part, s)
            m[r, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
        out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold; none with itself."""
    both = intersections(sets).astype(np.float64)
    size = np.diagonal(both)
    close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(close, False)
    return close


def forest(close: np.ndarray) -> np.ndarray:
    """The least index in each one's component."""
    root = np.arange(len(close))
    while True:
        new = np.minimum(root, np.where(close, root[None, :], len(close)).min(1, initial=len(close)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def common_bands(bands: np.ndarray, before: int) -> np.ndarray:
    """Which pairs share one of the first ``before`` bands."""
    out = np.zeros((len(bands), len(bands)), bool)
    for k in range(before):
        out |= bands[:, k][:, None] == bands[:, k][None, :]
    return out


def _verify(n: int, threshold: float):
    schema = pa.schema([("set", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("whole", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        order = sorted(range(group.num_rows), key=group["set"].to_pylist().__getitem__)
        if len(order) < 2:
            return schema.empty_table()
        group = group.take(order)
        names, band = group["set"].to_pylist(), group["band"][0].as_py()
        compared = np.ones((len(names), len(names)), bool)
        if group["i"][0].as_py() != group["j"][0].as_py():  # pairs inside a block are another task's
            block = group["own"].to_numpy()
            compared = block[:, None] != block[None, :]
        if band is not None:  # and those of an earlier bucket are that one's
            compared &= ~common_bands(np.array(group["bands"].to_pylist(), np.int64), band)
        np.fill_diagonal(compared, False)
        some = np.flatnonzero(compared.any(0))
        if not len(some):
            return schema.empty_table()
        texts = group["text"].cast(pa.binary())
        close = links([ngrams(texts[int(k)].as_py(), n) for k in some], threshold) & compared[np.ix_(some, some)]
        root, count = forest(close), close.sum(1)
        hit = np.flatnonzero(count)
        whole = group["whole"][0].as_py()
        return pa.table([[names[some[k]] for k in hit], [names[some[root[k]]] for k in hit], count[hit].astype(np.int64), [whole] * len(hit)], schema=schema)

    return run


UNIT = ["set", "unit", "blocks", "whole", "band", "bands"]


def _units(parts: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """The classes of every unit to verify; ``band`` is null where the unit is a component."""
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = written(parts.groupBy("root").agg(F.count("*").alias("n")), "jaccard-sizes")
    nodes = parts.join(sizes, "root").select(F.col("node").alias("set"), "root", "n")
    none = [F.lit(None).cast("int").alias("band"), F.lit(None).cast("array<long>").alias("bands")]
    small = nodes.where(F.col("n") <= block).select("set", F.col("root").alias("unit"), F.lit(1).alias("blocks"), F.lit(True).alias("whole"), *none)
    if sizes.where(F.col("n") > block).isEmpty():
        return small
    large = written(nodes.where(F.col("n") > block).join(classes.select("set", "bands"), "set"), "jaccard-large")
    members = large.select("set", "root", "bands", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("root", "bucket").agg(F.count("*").alias("m"), F.min("band").alias("band"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("who"), F.min("set").alias("least")).where("m > 1")
    buckets = written(buckets.groupBy("root", "m", "who", "least").agg(F.min(F.struct("band", "bucket")).alias("b")).select("root", "m", "b.*"), "jaccard-buckets")
    cost = buckets.groupBy("root").agg(F.sum(F.col("m") * blocks(F.col("m"))).alias("sent"))
    ways = written(sizes.where(F.col("n") > block).join(cost, "root").select("root", "n", (F.col("n") * blocks(F.col("n")) <= F.col("sent")).alias("as_one")), "jaccard-ways")
    one = large.drop("n", "bands").join(ways.where("as_one"), "root").select("set", F.col("root").alias("unit"), blocks(F.col("n")).alias("blocks"), F.lit(False).alias("whole"), *none)
    chosen = written(buckets.join(ways.where("not as_one"), "root").select("bucket", "band", "m"), "jaccard-chosen")
    many = members.drop("band").join(chosen, "bucket").select("set", F.encode(F.hex("bucket"), "utf-8").alias("unit"), blocks(F.col("m")).alias("blocks"), F.lit(False).alias("whole"), "band", "bands")
    return small.union(one).union(many).select(*UNIT)


def jaccard_groups(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 7, block: int = 128) -> DataFrame:
    """doc_id, key, class_id (its group), text_id (its copies), n_links, and the group's first document (first_id, first_key)."""
    docs = documents(docs, "doc_id", "text")
    signed = written(docs.mapInArrow(_signatures(n, bands, rows), "doc_id long, key long, set binary, bands array<long>"), "jaccard-bands")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    classes = written(signed.groupBy("set").agg(F.min(order).alias("first"), F.first("bands").alias("bands")), "jaccard-classes")

    members = classes.select("set", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("set").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    stars = members.join(leaders, "bucket").where("set <> leader").select(F.col("set").alias("a"), F.col("leader").alias("b"))
    parts = written(components(written(stars.distinct(), "jaccard-stars")), "jaccard-parts")

    firsts = parts.join(classes.select(F.col("set").alias("node"), "first"), "node").select(F.col("node").alias("set"), F.col("first.doc_id").alias("id"), F.col("first.key").alias("first_key"))
    texts = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["id"]) & (docs["key"] == firsts["first_key"])).groupBy("set").agg(F.max("text").alias("text"))  # rows that repeat are one
    cut = _units(parts, classes, block).withColumn("own", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    found = cut.join(texts, "set").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")
    checked = written(found.groupBy("unit", "i", "j").applyInArrow(_verify(n, threshold), "set binary, root binary, links long, whole boolean"), "jaccard-links")

    ends = checked.where("whole").select(F.col("set").alias("node"), "root")
    spread = checked.where("not whole")
    if not spread.isEmpty():
        ends = ends.union(components(spread.select(F.col("set").alias("a"), F.col("root").alias("b"))))
    counts = checked.groupBy("set").agg(F.sum("links").alias("n_links"))
    texts = classes.select("set", "first").join(counts, "set", "left").join(ends.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    texts = written(texts.select("set", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "jaccard-texts")
    groups = texts.groupBy("root").agg(F.min("first").alias("head"))
    texts = texts.join(groups, "root").select("set", "first", "head", "n_links")
    return signed.select("doc_id", "key", "set").join(texts, "set").select("doc_id", "key", F.col("head.doc_id").alias("class_id"), F.col("first.doc_id").alias("text_id"), "n_links", F.col("head.doc_id").alias("first_id"), F.col("head.key").alias("first_key"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id", "n_links")


#: All pairs that share an n-gram, and all that can be reached over links; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM w),
s AS (SELECT doc_id, md5(array_to_string(grams, chr(10))) AS k, grams FROM g),
c AS (SELECT k, min(doc_id) AS text_id, any_value(grams) AS grams, len(any_value(grams)) AS n FROM s GROUP BY k),
u AS (SELECT k, unnest(grams) AS gram FROM c),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS both_n FROM u a JOIN u b ON a.gram = b.gram AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN c x ON x.k = p.a JOIN c y ON y.k = p.b WHERE p.both_n >= 0.8 * (x.n + y.n - p.both_n) - 1e-9),
reach(k, r) AS (SELECT k, k FROM c UNION SELECT reach.k, l.b FROM reach JOIN l ON l.a = reach.r),
grp AS (SELECT reach.k, min(c.text_id) AS class_id FROM reach JOIN c ON c.k = reach.r GROUP BY 1),
n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY 1)
SELECT s.doc_id, grp.class_id, c.text_id, coalesce(n.n_links, 0) AS n_links FROM s JOIN grp USING (k) JOIN c USING (k) LEFT JOIN n USING (k)
"""


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first document of every group of near duplicates, in (doc_id, text hash) order."""
    bounded(spark)
    heads = written(jaccard_groups(docs).select("first_id", "first_key").distinct(), "jaccard-heads")
    all_ = documents(docs, *DOCUMENT_COLUMNS)
    kept = all_.join(heads, all_["doc_id"].eqNullSafe(heads["first_id"]) & (all_["key"] == heads["first_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "key"]).select(*DOCUMENT_COLUMNS)
