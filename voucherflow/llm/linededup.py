"""Operator 3: removal of repeated runs of lines, found by winnowing.

Lines are hashed with the white space at their ends cut off; lines without a word are skipped. Two lengths, in words, rule:

* ``noise`` (25): a *gram* is the shortest run of lines from a line on that has this many words.
* ``guarantee`` (50): a *window* is the shortest run from a line on, or up to a line, with this many words. The least hash of the grams inside a window is its fingerprint, so equal windows have equal
  fingerprints. A long line is a window by itself.

1. Fingerprints are selected, and joined on their hashes: those that stand in one place only, most of them, are done with, and with them all of their windows.
2. From the places of a repeated fingerprint matches are extended both ways: window by window to either side, forward and backward, as long as the window's fingerprint repeats too. A window's hash leads to
   its earliest place, which need not be where the fingerprint was seen first, so every part of a run meets the copy that holds it.
3. Of every window the first place in (doc_id, text hash, line) order stays; in the others its lines are deleted, and blank lines between them. So all later copies of a run of ``guarantee`` words or more go whole: each of its lines lies in a
   window inside the run. Every deleted line has an equal line at an earlier place, and shorter repeats, headings and greetings stay.

Defined cases: null or empty texts have nothing to delete and come back as they are (null as empty); a null doc_id sorts last; rows
that repeat doc_id and text are one document and come back as often as they came; a run repeated inside one text loses its later
occurrences too, also where they overlap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded, documents, table, written


def _signed(h: int) -> int:
    return h - (1 << 64 if h >> 63 else 0)


def read_lines(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words: hashes, line numbers, and numbers of words."""
    hashes, numbers, words = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            hashes.append(xxhash.xxh64_intdigest(line.strip()))
            numbers.append(i)
            words.append(n)
    return np.array(hashes, np.uint64), np.array(numbers, np.int32), np.array(words, np.int32)


def fingerprints(hashes: np.ndarray, words: np.ndarray, noise: int, guarantee: int) -> tuple[list[int], list[int], list[int]]:
    """All places of the windows' least grams, the grams there, and the least gram of the window from each line on."""
    total = np.append(0, np.cumsum(words))
    reach = lambda n: np.searchsorted(total, total[:-1] + n)  # noqa: E731  one past the last line; too large if the text ends before
    gram_end, window_end = reach(noise), reach(guarantee)
    raw, n = hashes.tobytes(), len(hashes)
    grams = [_signed(xxhash.xxh64_intdigest(raw[8 * i : 8 * e])) if e <= n else None for i, e in enumerate(gram_end.tolist())]
    stops = np.searchsorted(gram_end, window_end, "right").tolist()  # grams from i to here lie inside the window
    at: list[int] = []
    least: list[int] = []
    seen = 0
    for i, e in enumerate(window_end.tolist()):
        if e > n:
            break
        m = min(grams[i : stops[i]])
        since = max(i, seen) if least and least[-1] == m else i
        at += [j for j in range(since, stops[i]) if grams[j] == m]
        seen = stops[i]
        least.append(m)
    at = sorted(set(at))
    return at, [grams[j] for j in at], least


def winnow(text: bytes, noise: int, guarantee: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Hashes of the lines with words, their line numbers, and the fingerprints' positions among them and hashes."""
    hashes, numbers, words = read_lines(text)
    return hashes, numbers, *fingerprints(hashes, words, noise, guarantee)[:2]


def windows(hashes: np.ndarray, words: np.ndarray, least: list[int], repeated: set[int], guarantee: int) -> list[tuple[int, int, int]]:
    """Hash, first and last line of the windows, forward and backward, whose fingerprint is among the repeated ones."""
    total, n, raw = np.append(0, np.cumsum(words)), len(hashes), hashes.tobytes()
    forward = [(i, e) for i, e in enumerate(np.searchsorted(total, total[:-1] + guarantee).tolist()) if e <= n]
    backward = [(i, e) for e, i in enumerate((np.searchsorted(total, total[1:] - guarantee, "right") - 1).tolist(), 1) if i >= 0]
    # one that ends at a line begins with one from a line on, and equal ones with equal ones
    return [(_signed(xxhash.xxh64_intdigest(raw[8 * i : 8 * e], 1)), i, e - 1) for i, e in sorted({*forward, *backward}) if least[i] in repeated]


def _lines(noise: int, guarantee: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                hashes, numbers, words = read_lines(text)
                grams = Counter(fingerprints(hashes, words, noise, guarantee)[1])
                twice = [g for g, n in grams.items() for _ in range(min(n, 2))]  # whether it stands elsewhere in the text is all that counts
                rows.append((hashes.tobytes(), numbers.tobytes(), words.tobytes(), twice))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.record_batch([batch["doc_id"], batch["key"], *columns], names=["doc_id", "key", "hashes", "numbers", "words", "grams"])

    return run


def _extend(noise: int, guarantee: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, number, word, repeated in zip(*(batch[c].to_pylist() for c in ("hashes", "numbers", "words", "repeated")), strict=True):
                hashes, numbers, words = np.frombuffer(raw, np.uint64), np.frombuffer(number, np.int32), np.frombuffer(word, np.int32)
                least = fingerprints(hashes, words, noise, guarantee)[2]
                found.append([{"window": h, "first": int(numbers[a]), "last": int(numbers[b])} for h, a, b in windows(hashes, words, least, set(repeated), guarantee)])
            kind = pa.list_(pa.struct([("window", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array(found, kind)], names=["doc_id", "key", "found"])

    return run


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, cuts in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["cuts"].to_pylist(), strict=True):
            lines = text.split(b"\n")
            if not cuts:
                rows.append((text, len(lines), 0, 0))
                continue
            gone = np.zeros(len(lines) + 1, np.int64)
            for c in cuts:
                gone[c["first"]] += 1
                gone[c["last"] + 1] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            words = sum(len(x.split()) for x, g in zip(lines, gone, strict=True) if g)
            rows.append((b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum()), words))
        text, n, removed, words = zip(*rows, strict=True) if rows else ((),) * 4
        new = [pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64())]
        keep = [c for c in batch.schema.names if c not in ("text", "cuts")]
        yield pa.record_batch([*(batch[c] for c in keep), *new], names=[*keep, "text", "n_lines", "removed_lines", "removed_words"])


def dedup_lines(docs: DataFrame, *columns: str, noise: int = 25, guarantee: int = 50) -> DataFrame:
    """doc_id, the further ``columns``, the text without its repeated runs, n_lines, removed_lines, removed_words."""
    docs = documents(docs, "doc_id", "text", *columns)
    own = ["hashes", "numbers", "words", "grams"]
    lines = docs.select("doc_id", "key", "text").mapInArrow(_lines(noise, guarantee), "doc_id long, key long, hashes binary, numbers binary, words binary, grams array<long>")
    lines = written(lines.where(F.size("grams") > 0).groupBy("doc_id", "key").agg(*(F.min(c).alias(c) for c in own)), "dedup-lines")

    marks = lines.select("doc_id", "key", F.explode("grams").alias("gram"))
    # written, so that the joins have a shuffle on either side and a hot hash can be split
    again = written(marks.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "dedup-repeated")
    some = marks.distinct().join(again, "gram").groupBy("doc_id", "key").agg(F.collect_list("gram").alias("repeated"))
    some = some.alias("s").join(lines.alias("l"), F.col("s.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("s.key") == F.col("l.key"))).select("l.doc_id", "l.key", "l.hashes", "l.numbers", "l.words", "s.repeated")
    found = some.mapInArrow(_extend(noise, guarantee), "doc_id long, key long, found array<struct<window:long,first:int,last:int>>")
    found = written(found.select("doc_id", "key", F.explode("found").alias("w")).select("doc_id", "key", "w.*"), "dedup-windows")

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "first")
    firsts = written(found.groupBy("window").agg(F.min(place).alias("o"), F.count("*").alias("n")).where("n > 1").select("window", "o"), "dedup-firsts")
    cuts = written(found.join(firsts, "window").where(place > F.col("o")).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("cuts")), "dedup-cuts")

    # written and merged at every size: the join has a shuffle on either side, so rows that repeat can be split
    both = docs.alias("d").join(cuts.alias("c").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.key") == F.col("c.key")), "left").select("d.doc_id", *(f"d.{c}" for c in columns), "d.text", "c.cuts")
    kept = ", ".join(f"`{c}` {t}" for c, t in both.drop("text", "cuts").dtypes)
    return both.mapInArrow(_delete, f"{kept}, text string, n_lines long, removed_lines long, removed_words long")


#: Every window of every text by its lines, for small tables whose doc_ids are unique.
ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS number FROM l),
w AS (SELECT doc_id, number, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS trimmed FROM u),
g AS (SELECT doc_id, list(number ORDER BY number) AS numbers, list(trimmed ORDER BY number) AS kept, list(words ORDER BY number) AS words FROM w WHERE words > 0 GROUP BY doc_id),
t AS (SELECT doc_id, numbers, kept, list_transform(range(1, len(words) + 1), lambda i: list_sum(words[1:i])) AS total FROM g),
i AS (SELECT *, unnest(range(1, len(total) + 1)) AS i FROM t),
r AS (SELECT doc_id, numbers, kept, i AS a, list_position(list_transform(total, lambda x: x - coalesce(total[i - 1], 0) >= 50), true) AS b FROM i
  UNION ALL SELECT doc_id, numbers, kept, len(list_filter(list_concat([0], total)[1:i], lambda x: total[i] - x >= 50)) AS a, i AS b FROM i),
s AS (SELECT DISTINCT doc_id, numbers[a] AS first, numbers[b] AS last, md5(array_to_string(kept[a:b], chr(10))) AS k FROM r WHERE a > 0 AND b > 0),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS place FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS number FROM e WHERE place > 1)
SELECT w.doc_id, coalesce(string_agg(line, chr(10) ORDER BY w.number) FILTER (gone.number IS NULL), '') AS text, count(*) AS n_lines, count(gone.number) AS removed_lines,
  CAST(coalesce(sum(words) FILTER (gone.number IS NOT NULL), 0) AS BIGINT) AS removed_words FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.number = w.number GROUP BY w.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated runs; one that loses all its words goes."""
    bounded(spark)
    out = dedup_lines(docs, "lang", "source")
    left = (F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")).select(*DOCUMENT_COLUMNS)
