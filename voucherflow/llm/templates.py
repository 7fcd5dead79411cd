"""Operator 5: benchmark decontamination on templates.

Texts of documents and benchmark items become sequences of canonical words: case and punctuation at a word's ends go, and numbers, units,
quantities and names (capitalised words inside a sentence) become typed placeholders. Windows of ``window`` canonical words with at least ``literals``
plain ones are hashed on both sides and joined on the hash; so are, without that minimum, all windows of the lower-cased words themselves,
which find exact copies of items made of numbers or names, and copies in other capitals. Hits of one item on one diagonal are put together, and the words behind the
placeholders are compared: a slot value of the item must stand for one value in the document throughout, and the reverse. So a verbatim copy and a question with other
numbers or names are both found, while two texts that share a template by chance disagree in their slots.

A document is contaminated by an item if a consistent match has ``run`` canonical words in a row, or covers ``cover`` of the item.

The benchmark's windows are a table of any size. What goes to the tasks that read the documents is a bitmap of their hashes, at most 2 ** ``most_bits`` bits (8 MB): it lets all windows of the
benchmark pass and few others (more, if the benchmark outgrows it), so only those are shuffled and joined. Of a window that passes go its hash, its place and the hashes of its words. Matches
are put together from sorted rows as a stream; at most one item's counts are held at a time.

Defined cases: null texts match nothing; an item with fewer words than the window is one window of its own length, down to ``literals``
words; below that it is never matched; equal items are one, named by the smallest item_id; a null item_id stays null; rows that repeat are judged alike, each by itself.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, documents, pick, table, written

# Words for numbers and units of measurement.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty "
    "seventy eighty ninety hundred thousand million billion first second third fourth fifth half quarter dozen".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mg g kg gram grams kilogram "
    "kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons cup cups ms s sec secs second seconds minute minutes hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp yen mph kph kmh degree degrees celsius fahrenheit kelvin joule joules watt watts volt volts amp amps "
    "newton newtons pascal hz khz mhz ghz kb mb gb tb".split()
)
NUMBER = re.compile(r"[-+$€£]*\d[\d.,:/]*(?:%|st|nd|rd|th)?")
QUANTITY = re.compile(r"\d[\d.,]*([a-z]+)")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)  # from the first letter or digit to the last
BASE = np.uint64(0x9E3779B97F4A7C15)
LINE, TEXT = b"\x00", b"\x01"  # stand for the end of a line and of a text
SLOT, IS_NAME, ENDS, VOID = 1, 2, 4, 8


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode())


NUM, UNIT, NAME, QUANT = (_hash(f"\0{x}") for x in ("number", "unit", "name", "quantity"))


class Canon(dict):
    """Word (bytes) to a number; arrays by that number give its hashes and kind. Forgets all between batches when it holds ``most`` words."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.start()

    def start(self) -> None:
        self.clear()
        self.table = np.zeros((0, 3), np.uint64)  # hash with placeholders, of the lower-cased word, and flags
        self.new: list[tuple[int, int, int]] = []
        for mark in (LINE, TEXT):
            self[mark] = len(self)
            self.new.append((0, 0, ENDS | VOID))

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?")
        letters = core.isalpha()
        if not letters:
            core = m[0] if (m := CORE.search(text)) else ""
        low = core.lower()
        if letters:
            kind = NUM if low in NUMBERS else UNIT if low in UNITS else None
        else:
            kind = NUM if low in NUMBERS or NUMBER.fullmatch(low) else QUANT if (m := QUANTITY.fullmatch(low)) and m[1] in UNITS else UNIT if low in UNITS else None
        plain = _hash(low)
        flags = SLOT if kind else IS_NAME if core[:1].isupper() and core[1:].islower() else 0
        if text.rstrip("\"')]}*#$%&").endswith((".", "!", "?", ":")):
            flags |= ENDS
        self.new.append((kind or plain, plain, flags if core else flags | VOID))
        self[word] = at
        return at

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts' canonical words, one after the other: the text's number, the hash, whether it is a slot, and the lower-cased word's hash."""
        if len(self) > self.most:
            self.start()
        texts = [x.replace(TEXT, b"\x02") if TEXT in x else x for x in texts]
        words = b" \x01 ".join(texts).replace(b"\n", b" \x00 ").split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.uint64)])
            self.new = []
        flags = self.table[:, 2].astype(np.uint8)[ids]
        text = np.cumsum(ids == self[TEXT])
        first = np.ones(len(ids), bool)  # of a sentence; so is a line's first word
        first[1:] = (flags[:-1] & ENDS) > 0
        use = np.flatnonzero((flags & VOID) == 0)
        ids, flags, name = ids[use], flags[use], ((flags & IS_NAME) > 0)[use] & ~first[use]
        return text[use], np.where(name, np.uint64(NAME), self.table[:, 0][ids]), name | ((flags & SLOT) > 0), self.table[:, 1][ids]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n values in a row, put together from hashes of halves."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers: dict[int, np.ndarray] = {1: h}
    base, size = {1: BASE}, 1
    with np.errstate(over="ignore"):
        while 2 * size <= n:
            x = powers[size]
            powers[2 * size] = x[:-size] * base[size] + x[size:]
            base[2 * size] = base[size] * base[size]
            size *= 2
        out, done = powers[size], size
        while done < n:
            size = 1 << (n - done).bit_length() - 1
            out = out[: len(h) - done - size + 1] * base[size] + powers[size][done : done + len(h) - done - size + 1]
            done += size
        out = out + np.uint64(n) * BASE
        out ^= out >> np.uint64(29)
        return out * BASE


def windows(text: np.ndarray, h: np.ndarray, slot: np.ndarray, lower: np.ndarray, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of the windows of n words inside one text: on templates with enough plain words, and on the words themselves where that says something else."""
    w, exact = rolled(h, n), rolled(lower, n)
    whole = text[: len(w)] == text[n - 1 :] if len(w) else np.zeros(0, bool)
    plain = np.append(0, np.cumsum(~slot))
    good = (plain[n:] - plain[:-n] >= literals)[: len(w)] if len(w) else whole
    a, b = np.flatnonzero(whole & good), np.flatnonzero(whole & (~good | (exact != w)))
    return np.concatenate([a, b]), np.concatenate([w[a], exact[b]])


ITEMS_DDL = "hash long, item long, item_id long, size int, q int, n int, words binary, slots binary"


def _items(window: int, literals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            text, h, slot, lower = canon.read(batch["text"].cast(pa.binary()).to_pylist())
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            rows = []
            for item, item_id, i, j in zip(batch["item"].to_pylist(), batch["item_id"].to_pylist(), edges, edges[1:], strict=False):
                n = int(min(window, j - i))
                if n >= literals:
                    at, hashes = windows(text[i:j], h[i:j], slot[i:j], lower[i:j], n, literals)
                    rows += [(int(x), item, item_id, int(j - i), int(q), n, lower[i + q : i + q + n].tobytes(), slot[i + q : i + q + n].tobytes()) for q, x in zip(at, hashes.view(np.int64), strict=True)]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2
            names = [x.split()[0] for x in ITEMS_DDL.split(", ")]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of 2 ** 15 neighbours as one row."""
    for batch in batches:
        for chunk, bits in zip(batch["chunk"].to_pylist(), batch["bits"].to_pylist(), strict=True):
            seen = np.zeros(1 << 15, bool)
            seen[bits] = True
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary())})


HITS_DDL = "row long, doc_id long, key long, hash long, p int, n int, words binary"


def _hits(lengths: list[int], bits: int, packed: bytes, literals: int):
    """The documents' windows that the benchmark may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, seen, numbers = Canon(), np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool), count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            number = np.array([next(numbers) for _ in range(batch.num_rows)], np.int64)
            text, h, slot, lower = canon.read(batch["text"].cast(pa.binary()).to_pylist())
            begin = np.searchsorted(text, np.arange(batch.num_rows))
            for n in lengths:
                at, hashes = windows(text, h, slot, lower, n, literals)
                hit = np.flatnonzero(seen[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
                if len(hit):
                    at, hashes = at[hit], hashes[hit].view(np.int64)
                    who = text[at]
                    take = pa.array(who)
                    words = pa.array([lower[i : i + n].tobytes() for i in at.tolist()], pa.binary())
                    columns = [pa.array(number[who]), batch["doc_id"].take(take), batch["key"].take(take), pa.array(hashes), pa.array((at - begin[who]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), words]
                    yield pa.record_batch(columns, names=[x.split()[0] for x in HITS_DDL.split(", ")])

    return run


FOUND_DDL = "row long, doc_id long, key long, item_id long, coverage double, run long, slots long, changed_slots long"


class Match:
    """What one item's hits in one document come to, diagonal by diagonal."""

    def __init__(self, size: int, agree: float):
        self.size, self.agree = size, agree
        self.covered: set[int] = set()
        self.longest = self.changed = self.n_slots = 0
        self.places: set[int] = set()
        self.behind: dict[int, tuple[int, int]] = {}  # by the slot's place in the item: the word there and the document's

    def add(self, q: int, n: int, item: bytes, slots: bytes, doc: bytes) -> None:
        self.places.update(range(q, q + n))
        if any(slots):
            for k, (s, a, b) in enumerate(zip(slots, np.frombuffer(item, np.int64).tolist(), np.frombuffer(doc, np.int64).tolist(), strict=True)):
                if s:
                    self.behind[q + k] = (a, b)

    def end_diagonal(self) -> None:
        there, back = defaultdict(Counter), defaultdict(Counter)
        for a, b in self.behind.values():
            there[a][b] += 1
            back[b][a] += 1
        pairs = len(self.behind)
        steady = sum(max(c.values()) for c in there.values()) + sum(max(c.values()) for c in back.values())
        if steady >= 2 * self.agree * pairs:
            self.covered |= self.places
            self.n_slots += pairs
            self.changed += sum(a != b for a, b in self.behind.values())
            now, last = 0, -2
            for q in sorted(self.places):
                now = now + 1 if q == last + 1 else 1
                self.longest, last = max(self.longest, now), q
        self.places, self.behind = set(), {}


def _judge(run_words: int, cover: float, agree: float):
    """From rows sorted by (row, item, d, q) to the matches that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = diagonal = match = None
        out: list[tuple] = []

        def end() -> None:
            match.end_diagonal()
            if match.longest >= run_words or len(match.covered) >= cover * match.size:
                row, doc_id, key, item_id = named
                out.append((row, doc_id, key, item_id, len(match.covered) / match.size, match.longest, match.n_slots, match.changed))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 3
            batch = pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in FOUND_DDL.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if (r["row"], r["item"]) != pair:
                    if match is not None:
                        end()
                    pair, diagonal, match, named = (r["row"], r["item"]), r["d"], Match(r["size"], agree), (r["row"], r["doc_id"], r["key"], r["item_id"])
                elif r["d"] != diagonal:
                    match.end_diagonal()
                    diagonal = r["d"]
                match.add(r["q"], r["n"], r["item_words"], r["slots"], r["words"])
            if out:
                yield flush()
        if match is not None:
            end()
        yield flush()

    return run


def benchmark_pairs(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, literals: int = 4, run: int = 13, cover: float = 0.6, agree: float = 0.75, most_bits: int = 26) -> DataFrame:
    """A row for each document row and item that it contains: row (a number of the document row), doc_id, key, item_id, coverage, run, slots, changed_slots."""
    spark = docs.sparkSession
    items = pick(benchmark, "item_id", "text").where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("item", F.xxhash64("text"))
    items = written(items.mapInArrow(_items(window, literals), ITEMS_DDL), "templates-items")
    lengths, n = items.agg(F.collect_set("n"), F.count("*")).first()  # at most ``window`` lengths
    bits = int(min(most_bits, max(16, np.ceil(np.log2(64 * n + 1)))))
    place = F.shiftrightunsigned("hash", 64 - bits)
    chunks = items.select(place.alias("at")).distinct().groupBy(F.shiftright("at", 15).alias("chunk")).agg(F.collect_list((F.col("at") % (1 << 15)).cast("int")).alias("bits"))
    packed = bytearray(1 << bits - 3)
    for r in chunks.mapInArrow(_bitmap, "chunk long, seen binary").toLocalIterator():
        packed[r["chunk"] << 12 : r["chunk"] + 1 << 12] = r["seen"]

    hits = documents(docs, "doc_id", "text").mapInArrow(_hits(sorted(lengths), bits, bytes(packed), literals), HITS_DDL)
    hits = written(hits, "templates-hits")
    pairs = hits.join(items.withColumnRenamed("words", "item_words"), ["hash", "n"]).withColumn("d", F.col("p") - F.col("q"))
    pairs = pairs.select("row", "doc_id", "key", "item", "item_id", "size", "d", "q", "n", "item_words", "slots", "words")
    return pairs.repartition("row", "item").sortWithinPartitions("row", "item", "d", "q").mapInArrow(_judge(run, cover, agree), FOUND_DDL)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *columns: str, **how) -> DataFrame:
    """doc_id, text, the further ``columns`` and ``matches``, the benchmark items that the text contains."""
    found = benchmark_pairs(docs, benchmark, **how).select("doc_id", "key", F.struct("item_id", "coverage", "run", "slots", "changed_slots").alias("m"))
    found = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("m")).alias("matches"))
    both = documents(docs, "doc_id", "text", *columns).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")
    return both.select("d.doc_id", "d.text", *(f"d.{c}" for c in columns), F.coalesce("f.matches", F.array().cast(found.schema["matches"].dataType)).alias("matches"))


def op5_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return benchmark_pairs(docs, benchmark).drop("row", "key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that contain no benchmark item."""
    bad = benchmark_pairs(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "key").distinct()
    bad = written(bad, "templates-bad")  # so that the join has a shuffle on either side and rows that repeat can be split
    all_ = documents(docs, *DOCUMENT_COLUMNS)
    return all_.join(bad, all_["doc_id"].eqNullSafe(bad["doc_id"]) & (all_["key"] == bad["key"]), "left_anti").select(*DOCUMENT_COLUMNS)
