"""Operator 10: secret scan with multipart credential linking, by DataFrame functions only.

Base kinds are always reported: ``assign`` (a keyword with a value), ``access`` (an access identifier) and ``hex``. Weak kinds alone mean nothing and
are reported only where disjoint parts that complete them stand in the same scope: the same paragraph (no blank line between the two), at most ``scope`` code points apart:

* ``ident`` (a user, account or client name) needs a secret: assign, hex or opaque;
* ``endpoint`` (a URL or IPv4 address) needs a secret as well;
* ``opaque`` (a long mixed token) needs an identifier (access, ident) or an endpoint.

Characters are read in one way only: a weak span that overlaps a base span, or a weak span of a kind before it in this list, is no candidate: neither
reported nor evidence for others, so a URL does not complete a token in its own path. The interval join of a document's parts is a pair of running windows over their starts, up and down
the text: the parts are disjoint, so what completes a part within reach is there if and only if the nearest such part before or after it is. Its cost is a sort and no pairs are made.

A pattern's matches come from regexp_extract_all and their places from the lengths of the pieces that split leaves between
them, added up by a running window; both walk through the text in the same way, leftmost and without overlap. No step's cost grows faster than the text's length, but for sorts. Places are code points, ends exclusive.

Defined cases: a null text is empty and has no spans; a null doc_id is kept; rows that repeat doc_id and text get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, table, written


def _either(text: str) -> str:
    """A pattern's letters in either case; A-Z only, which flags of regex engines do not agree on."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


GLUE = r"""["']?\x20*[:=]\x20*["']?"""
URL = _either("https?") + r"""://[^\x20\x09-\x0D"'<>]+"""
ADDRESS = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(\.[0-9]+)*(:[0-9]+)?"
#: the same for Spark's engine, which would go back over digits step by step, and into recursion for each repeat of the group: it takes all or nothing and begins at a run's first digit only
ADDRESS_AT_ONCE = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++(\.[0-9]++)*+(:[0-9]++)?+"
#: kind, pattern, group whose length counts, least length, what the match must look like besides; the order is the order at equal starts
KINDS = [
    ("assign", f"({_either('password|passwd|secret|token|api_?key')}){GLUE}([A-Za-z0-9+/_.=-]+)", 2, 6, []),
    ("access", "AKIA[A-Z0-9]+", 0, 20, []),
    ("hex", "[0-9a-f]{24,}", 0, 24, []),  # a match of [0-9a-f]+ is a whole run, so the short ones may fail in the pattern
    ("ident", f"{_either('(user(_?name|_?id)?|login|client_?id|account(_?id)?|access_?key(_?id)?)')}{GLUE}[A-Za-z0-9@+/_.=-]+", 0, 1, []),
    ("endpoint", f"{URL}|{ADDRESS}", 0, 1, [r"^[Hh]|^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?$"]),
    ("opaque", "[A-Za-z0-9+/_=-]{32,}", 0, 32, ["[0-9]", "[A-Za-z]"]),
    ("break", r"\n[\x20\x09\x0D]*\n", 0, 1, []),  # parts paragraphs; never reported
]
BASE = ["assign", "access", "hex"]
WEAK = ["ident", "endpoint", "opaque"]
SECRETS, IDENTIFIERS, ENDPOINTS = ["assign", "hex", "opaque"], ["access", "ident"], ["endpoint"]
NEEDS = {"ident": SECRETS, "endpoint": SECRETS, "opaque": IDENTIFIERS + ENDPOINTS}
RANK = {k[0]: i for i, k in enumerate(KINDS)}
#: what a text with a match of the kind has in any case: some of these words (the text lower-cased), or what a pattern quickly finds
HINTS = {
    "assign": (["password", "passwd", "secret", "token", "key"], None),
    "access": (["akia"], None),
    "hex": ([], "(?<![0-9a-f])[0-9a-f]{24}"),
    "ident": (["user", "login", "client", "account", "access"], None),
    "endpoint": (["://"], r"[0-9]\.[0-9]+\.[0-9]"),
    "opaque": ([], "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32}"),
}
MATCH = "array<struct<rank:int,kind:string,i:int,gap:int,size:int,good:boolean>>"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _hinted(kind: str) -> Column:
    """Whether ``text``, with ``low`` beside it, may have matches of the kind."""
    words, pattern = HINTS[kind]
    hints = [F.contains("low", F.lit(w)) for w in words] + ([F.col("text").rlike(pattern)] if pattern else [])
    return reduce(lambda a, b: a | b, hints)


def _matches(text: Column, rank: int, there: Column) -> Column:
    """The kind's matches in turn: what lies between one and the one before it, its length, and whether it counts; none where ``there`` does not hold."""
    kind, pattern, group, least, also = KINDS[rank]
    pattern = pattern.replace(ADDRESS, ADDRESS_AT_ONCE)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))

    def match(m: Column, i: Column) -> Column:
        good = reduce(lambda a, p: a & m["whole"].rlike(p), also, F.length(m["part"]) >= least)
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), F.length(m["whole"]).alias("size"), good.alias("good"))

    return F.when(there, F.transform(found, match)).otherwise(F.array().cast(MATCH))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, scope: int = 200) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_linked: the weak spans reported."""
    docs = documents(docs, "doc_id", "text")
    text = F.col("text")
    hinted = docs.withColumn("low", F.lower("text")).select("doc_id", "key", "text", *(_hinted(k).alias(f"may_{k}") for k in HINTS))
    hinted = hinted.where(reduce(lambda a, b: a | b, (F.col(f"may_{k}") for k in HINTS)))
    weak_may = reduce(lambda a, b: a | b, (F.col(f"may_{k}") for k in WEAK))
    found = hinted.select("doc_id", "key", F.concat(*(_matches(text, RANK[k], F.col(f"may_{k}")) for k in HINTS), _matches(text, RANK["break"], weak_may)).alias("found"))
    parts = found.select("doc_id", "key", F.explode("found").alias("s")).distinct().select("doc_id", "key", "s.*").repartition("doc_id", "key")  # as all windows below need it
    walked = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("doc_id", "key", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    parts = parts.withColumn("end", walked).where("good").select("doc_id", "key", (F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end")

    document, so_far = W.partitionBy("doc_id", "key"), (W.unboundedPreceding, -1)
    up, down = document.orderBy("start", "rank").rowsBetween(*so_far), document.orderBy(F.desc("start"), F.desc("rank")).rowsBetween(*so_far)
    end_before = lambda those: F.max(F.when(those, F.col("end"))).over(up)
    start_after = lambda those: F.min(F.when(those, F.col("start"))).over(down)

    stronger = {k: F.col("rank") < RANK[k] for k in WEAK}
    parts = parts.withColumns({f"{k}_{side}": f(stronger[k]) for k in WEAK for side, f in (("end", end_before), ("start", start_after))})
    clear = [(F.col("kind") == k) & F.coalesce(F.col(f"{k}_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col(f"{k}_start") >= F.col("end"), F.lit(True)) for k in WEAK]
    parts = parts.where(reduce(lambda a, b: a | b, clear, ~F.col("kind").isin(WEAK))).select("doc_id", "key", "start", "rank", "kind", "end")

    of = {k: F.col("kind").isin(NEEDS[k]) for k in WEAK} | {"break": F.col("kind") == "break"}
    parts = parts.withColumns({f"{k}_{side}": f(c) for k, c in of.items() for side, f in (("end", end_before), ("start", start_after))})
    lowest = F.greatest(F.col("start") - scope, F.coalesce("break_end", F.lit(0)))
    highest = F.least(F.col("end") + scope, F.coalesce("break_start", F.col("end") + scope))
    beside = {k: F.coalesce(F.col(f"{k}_end") >= lowest, F.lit(False)) | F.coalesce(F.col(f"{k}_start") <= highest, F.lit(False)) for k in WEAK}
    kept = parts.where(reduce(lambda a, k: a | ((F.col("kind") == k) & beside[k]), WEAK, F.col("kind").isin(BASE)))

    # written, so that the join has a shuffle on either side and rows that repeat can be split
    spans = written(kept.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans")), "secret-spans")
    all_ = docs.select("doc_id", "key").alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key") == F.col("s.key")), "left")
    out = all_.select("d.doc_id", F.coalesce("s.spans", F.array().cast(SPAN)).alias("found"))
    only = lambda kinds: F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [F.size(only([k])).cast("long").alias(f"n_{k}") for k in BASE]
    weak = F.size(F.filter("found", lambda s: ~s["kind"].isin(BASE))).cast("long")
    return out.select("doc_id", *counts, F.sha2(_joined(only(BASE)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), weak.alias("n_linked"))


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle(scope: int = 200) -> str:
    """The same by pairs of a document's spans: for small tables."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = []
    for kind, pattern, group, least, also in KINDS:
        p = quoted(pattern)
        good = " AND ".join([f"length(part[i]) >= {least}", *(f"regexp_matches(whole[i], {quoted(a)})" for a in also)])
        kinds.append(
            f"SELECT r, '{kind}' AS kind, {RANK[kind]} AS rank, pos AS start, pos + length(whole[i]) AS end_, {good} AS good FROM (SELECT *, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos "
            f"FROM (SELECT r, list_transform(regexp_split_to_array(t, {p}), lambda x: length(x)) AS gaps, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS part, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d WHERE regexp_matches(t, {p})))"
        )
    names = lambda x: ", ".join(f"'{k}'" for k in x)
    needs = " OR ".join(f"(a.kind = '{k}' AND b.kind IN ({names(v)}))" for k, v in NEEDS.items())
    joined = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, rank){where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, kind, rank, start, end_ FROM ({' UNION ALL '.join(kinds)}) WHERE good),
c AS (SELECT * FROM s a WHERE a.kind NOT IN ({names(WEAK)}) OR NOT EXISTS (SELECT 1 FROM s b WHERE b.r = a.r AND b.rank < a.rank AND b.start < a.end_ AND b.end_ > a.start)),
near AS (SELECT DISTINCT a.r, a.rank, a.start FROM c a JOIN c b ON a.r = b.r AND ({needs}) AND greatest(a.start, b.start) - least(a.end_, b.end_) <= {scope}
  WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.r = a.r AND z.kind = 'break' AND z.start >= least(a.end_, b.end_) AND z.start < greatest(a.start, b.start))),
k AS (SELECT * FROM c WHERE kind IN ({names(BASE)}) UNION ALL SELECT c.* FROM c JOIN near USING (r, rank, start) WHERE kind IN ({names(WEAK)})),
g AS (SELECT r, {counts}, {joined(f" FILTER (kind IN ({names(BASE)}))")} AS base, {joined('')} AS spans, count(*) FILTER (kind IN ({names(WEAK)})) AS n_linked FROM k GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
