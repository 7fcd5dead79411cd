"""Operator 1: Brown class-based bigram model, trained by exchange clustering.

Every word belongs to one class. A token's probability is P(class | class before) * P(word | class),
and a text's score is the sum of the base-10 logarithms over its words and one end token.

Words are known by 64-bit hashes. What belongs to words is kept in packed arrays, a row per (block, part), so that a row of the engine
stands for thousands of words: a *block* is some ``block_bytes`` of texts, cut from a task's stream where they lie, and a *part* is a range of hashes, of which
there is one for every ``part_bytes`` of the corpus. Training, over all training texts:

1. *Counts.* A block gives its texts as places in its own dictionary, and that dictionary, with counts, in slices by part. A part's slices give its words and their
   total counts; each slice comes back as ranks in the part. The vocabulary is never collected or broadcast.
2. *Exchange clustering of the head.* The ``head`` most frequent words start in ``classes`` classes, and each in turn moves
   to the class that raises the class bigram likelihood most, until a sweep moves none. It needs only the head's bigram counts: at most head**2 numbers, whatever the corpus,
   and gives the rounds their start.
3. *Exchange rounds of all words.* A block meets its words' classes, and counts for each word the classes to its left and right, texts' edges included. By part these
   counts are added up, and every word, of the head or not, moves to its best class against the class table of the whole corpus, in parallel, as in
   distributed word clustering. In the first round only the head and the edges have classes; a word beside neither is decided in the next, until when it stands in the largest class. Rounds go
   on until one moves at most ``few_moves`` of the tokens, or the likelihood rises by under ``least_rise`` (nats) a token, or ``rounds`` are over.
4. *Scoring.* Blocks meet their words' last classes and counts, which yields each text's word part and its classes, one byte a token.
5. *Transitions* are counted over the class bytes of the training texts and smoothed with the class unigrams.

Word emission discounts every count by ``D``; what is taken away within a class is the probability of an
unknown word there, so the model sums to one over the vocabulary and one unknown token.

Defined cases: a null or empty text is the end token alone; a null doc_id is trained on; repeated rows count
as often as they occur; with no training text every token has probability one; ties between words of one
count go by their hashes, ties between classes to the lowest; two words of one hash, of which a vocabulary of ten billion has three pairs or so, would count as one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import fold, pick, table, written

HAPAX, UNKNOWN = 0x80, 0x7F
OPEN = 255  # the class of a word that has none yet, or that no training text holds
NO_RANK = 0xFFFFFFFF
TEXTS = -1  # the part of a row that is a block's texts


def _pack(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, plane by plane, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(x: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8")[:, 0]


CODED = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("docs", pa.binary()), ("flags", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])
CODED_DDL = "block long, part long, ids binary, n binary, docs binary, flags binary, sizes binary, codes binary"


def _code(block_bytes: int, parts: int):
    """Texts to blocks: a row of the texts as places in the block's dictionary, and a row of the dictionary for each part."""

    def block(number: int, place: dict, docs: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        held = np.array([d[1] for d in docs], bool)
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
        order = np.argsort(ids)
        ids = ids[order]
        new = np.empty(len(ids), np.int64)
        new[order] = np.arange(len(ids))
        codes, sizes = new[np.concatenate(texts)], np.array([len(x) for x in texts])
        n = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(ids))
        part = ((ids >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        names, start = np.unique(part, return_index=True)
        rows = [(number, int(p), _pack(np.diff(ids[i:j], prepend=np.uint64(0)), 8), _pack(n[i:j], 4), None, None, None, None) for p, i, j in zip(names, start, [*start[1:], len(ids)], strict=True)]
        doc_ids, null = np.array([d[0] or 0 for d in docs], np.int64), np.array([d[0] is None for d in docs])
        rows.append((number, TEXTS, None, None, doc_ids.tobytes(), (null + 2 * held).astype(np.uint8).tobytes(), _pack(sizes, 4), _pack(codes, 4)))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CODED, strict=True)], schema=CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        held = 0
        place: defaultdict = defaultdict(count().__next__)
        docs, texts = [], []
        for batch in batches:
            for text, *doc in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), strict=True):
                words = text.lower().split()  # bytes.lower() changes A-Z only
                texts.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                docs.append(doc)
                held += len(text) + 32
                if held >= block_bytes:
                    yield block(next(numbers), place, docs, texts)
                    place, docs, texts, held = defaultdict(count().__next__), [], [], 0
        if docs:
            yield block(next(numbers), place, docs, texts)

    return run


WORDS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ranks", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())])
WORDS_DDL = "part long, block long, ranks binary, counts binary, classes binary"


def _words(part: int, counts: np.ndarray, of: np.ndarray, slices: list[tuple[int, np.ndarray]]) -> pa.Table:
    """A part's words in rank order (the row without a block), and the slices of the blocks: ranks, counts and classes."""
    rows = [(part, None, None, _pack(counts, 8), of.astype(np.uint8).tobytes())]
    with_none = np.append(counts, 0), np.append(of, OPEN).astype(np.uint8)
    for block, ranks in slices:
        at = np.minimum(ranks, len(counts))
        rows.append((part, block, _pack(ranks, 4), _pack(with_none[0][at], 8), with_none[1][at].tobytes()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), WORDS, strict=True)], schema=WORDS)


def _vocabulary(group: pa.Table) -> pa.Table:
    ids = [np.cumsum(_unpack(x, 8).view(np.uint64)) for x in group["ids"].to_pylist()]
    n = np.concatenate([_unpack(x, 4) for x in group["n"].to_pylist()])
    whole, at = np.unique(np.concatenate(ids), return_inverse=True)
    c = np.bincount(at, n, len(whole)).astype(np.int64)
    rank = np.where(c > 0, np.cumsum(c > 0) - 1, NO_RANK)[at]
    edges = np.cumsum([0, *map(len, ids)])
    slices = [(b, rank[i:j]) for b, i, j in zip(group["block"].to_pylist(), edges, edges[1:], strict=False)]
    c = c[c > 0]
    return _words(group["part"][0].as_py(), c, np.full(len(c), OPEN), slices)


def _top(head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                c = _unpack(packed, 8)
                at = np.argsort(-c, kind="stable")[:head]
                yield pa.record_batch({"part": np.full(len(at), part), "rank": at, "c": c[at]})

    return run


def _head_slices(index: dict[int, tuple[np.ndarray, np.ndarray]], none: int):
    """In place of the classes of a slice's words, their numbers in the head, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, packed in zip(batch["part"].to_pylist(), batch["ranks"].to_pylist(), strict=True):
                ranks, (known, number) = _unpack(packed, 4), index.get(part, (np.zeros(0, np.int64),) * 2)
                at = np.searchsorted(known, ranks)
                hit = np.append(known, -1)[at] == ranks
                out.append(np.where(hit, np.append(number, none)[at], none).astype("<u2").tobytes())
            yield pa.record_batch([batch["block"], batch["part"], pa.array(out, pa.binary())], names=["block", "part", "classes"])

    return run


class Block:
    """A block's texts, and what came back for its dictionary's slices, in its order."""

    def __init__(self, row: dict):
        self.number, self.row, self.parts, self.slices = row["block"], row, [], defaultdict(list)

    def add(self, row: dict) -> None:
        self.parts.append(row["part"])
        for c in ("counts", "classes"):
            self.slices[c].append(row.get(c))

    def read(self) -> None:
        flags = np.frombuffer(self.row["flags"], np.uint8)
        self.null, self.held = (flags & 1).astype(bool), (flags & 2).astype(bool)
        self.doc_id, self.sizes, self.codes = np.frombuffer(self.row["docs"], np.int64), _unpack(self.row["sizes"], 4), _unpack(self.row["codes"], 4)

    def of(self, kind: str = "u1") -> np.ndarray:
        return np.frombuffer(b"".join(self.slices["classes"]), kind).astype(np.int64)

    def training(self) -> np.ndarray:
        """The codes of the training texts, -1 before, between and after them."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        keep = ~self.held[owner]
        turn = np.cumsum(~self.held)
        out = np.full(int(keep.sum()) + int(turn[-1] if len(turn) else 0) + 1, -1, np.int64)
        out[np.arange(int(keep.sum())) + turn[owner[keep]]] = self.codes[keep]
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks from rows in the order of (block, part): the texts come first."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == TEXTS:
                if now is not None:
                    now.read()
                    yield now
                now = Block(row)
            else:
                now.add(row)
    if now is not None:
        now.read()
        yield now


def _meet(texts: DataFrame, slices: DataFrame, *columns: str) -> DataFrame:
    """Blocks' texts with their slices, in the order that ``_blocks`` reads."""
    own = ["docs", "flags", "sizes", "codes"]
    rows = texts.select("block", "part", *own).unionByName(slices.select("block", "part", *columns), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "part")


def _head_bigrams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        for block in _blocks(batches):
            of = np.append(block.of("<u2"), k)[block.training()]
            a, b = of[:-1], of[1:]
            both = (a < k) & (b < k)
            table += np.bincount(a[both] * k + b[both], minlength=k * k)
        at = np.flatnonzero(table)
        yield pa.record_batch({"cell": at, "n": table[at]})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Exchange clustering: word to class, given the bigram counts of the words and their totals.

    Maximises sum f(N(c, d)) - 2 sum f(N(c)), f(x) = x log x, moving one word at a time.
    """
    k = len(n)
    of = np.arange(k) % classes
    one = np.eye(classes, dtype=np.float64)[of]
    table = one.T @ bigrams @ one
    total = one.T @ n.astype(np.float64)
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            old, self_ = of[w], float(bigrams[w, w])
            right = np.bincount(of, bigrams[w], classes)
            left = np.bincount(of, bigrams[:, w], classes)
            right[old] -= self_
            left[old] -= self_
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            total[old] -= n[w]
            gain = (_xlogx(table + right[None, :]) - _xlogx(table)).sum(1)
            gain += (_xlogx(table + left[:, None]) - _xlogx(table)).sum(0)
            d = np.diag(table)  # the cell where row and column meet
            gain += _xlogx(d + right + left + self_) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= 2 * (_xlogx(total + n[w]) - _xlogx(total))
            best = int(np.argmax(gain))
            if gain[best] <= gain[old] + 1e-9:
                best = int(old)
            of[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_
            total[best] += n[w]
            moved += best != old
        if not moved:
            break
    return of


NEAR = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("pairs", pa.binary()), ("slots", pa.binary()), ("n", pa.binary())])
NEAR_DDL = "block long, part long, pairs binary, slots binary, n binary"


def _near(classes: int):
    """For each word of a block's dictionary its counts of the classes beside it in the training texts, a row for each part; and at a task's end its class bigrams.

    Slots: the class to the left, the class to the right (``classes`` is a text's edge, ``classes`` + 1 a word without a class yet),
    and last the word followed by itself, which neither side counts. A count over 255 takes several entries.
    """
    side, width = classes + 2, 2 * (classes + 2) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((classes + 1) ** 2, np.int64)
        for block in _blocks(batches):
            of = block.of()
            size = len(of)
            of = np.append(np.where(of == OPEN, classes + 1, of), classes)  # the last one is where -1 points
            a = block.training()
            here = a[1:-1] >= 0
            w, left, right = a[1:-1][here], a[:-2][here], a[2:][here]
            of_w, of_left, of_right = of[w], of[left], of[right]
            known = (of_w <= classes) & (of_right <= classes)
            table += np.bincount(of_w[known] * (classes + 1) + of_right[known], minlength=len(table))
            starts = (left < 0) & (of_w <= classes)
            table += np.bincount(classes * (classes + 1) + of_w[starts], minlength=len(table))
            same, same_left = right == w, left == w
            key = np.concatenate([(w * width + of_left)[~same_left], (w * width + side + of_right)[~same], w[same] * width + 2 * side])
            key = np.sort(key.astype(np.uint32) if size * width < 1 << 32 else key)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            n, key = np.diff(np.append(first, len(key))), key[first].astype(np.int64)
            times = (n + 254) // 255
            rest = np.repeat(n, times)
            rest -= 255 * (np.arange(len(rest)) - np.repeat(np.cumsum(times) - times, times))
            word, slot = np.divmod(np.repeat(key, times), width)
            n, slot = np.minimum(rest, 255).astype(np.uint8), slot.astype(np.uint8)
            pairs = np.bincount(word, minlength=size)
            edges = np.cumsum([0, *map(len, block.slices["classes"])])
            at = np.append(0, np.cumsum(pairs))[edges]
            rows = []
            for p, i, j, s, e in zip(block.parts, edges, edges[1:], at, at[1:], strict=False):
                if e > s:
                    rows.append((block.number, p, _pack(pairs[i:j], 4), _pack(slot[s:e], 1), _pack(n[s:e], 1)))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NEAR, strict=True)], schema=NEAR)
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((None, TEXTS, None, None, table.tobytes()), NEAR, strict=True)], schema=NEAR)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch["n"].to_pylist():
            table = np.frombuffer(x, np.int64)
            at = np.flatnonzero(table)
            yield pa.record_batch({"cell": at, "n": table[at]})


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(table: np.ndarray, old: np.ndarray, row: np.ndarray, slot: np.ndarray, n: np.ndarray, few: int = 16) -> np.ndarray:
    """The exchange step of each word by itself: taken out of its class ``old`` (-1: it has none) and put where the likelihood is best.

    (row, slot, n) are the words' counts of neighbours, at most one of a slot. A word all of whose neighbours have no class yet gets -1.
    """
    edge = len(table) - 1
    classes, m, side = edge, len(old), edge + 2
    dense = np.zeros((m, 2 * side + 1))
    dense[row, slot] = n
    left, right, own = dense[:, : edge + 1], dense[:, side : side + edge + 1], dense[:, -1]
    near = (slot != edge + 1) & (slot != side + edge + 1) & (slot != 2 * side)
    row, slot, n = row[near], slot[near], n[near]
    flat = np.zeros((2 * side, classes))  # a slot's cells, by the word's class
    flat[: edge + 1], flat[side : side + edge + 1] = table[:, :classes], table[:classes].T
    base = _xlogx(flat)
    gain = np.zeros((m, classes))
    steps = np.stack([_xlogx(flat + i) - base for i in range(few)])
    change = steps[np.minimum(n, few - 1).astype(np.int64), slot]
    much = np.flatnonzero(n >= few)
    change[much] = _xlogx(flat[slot[much]] + n[much, None]) - base[slot[much]]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    if len(first):
        gain[row[first]] = np.add.reduceat(change, first)
    # the cell where row and column meet
    r, l, diagonal = right[:, :classes], left[:, :classes], np.diag(table)[:classes]
    w, d = np.nonzero(((r > 0) & (l > 0)) | (own > 0)[:, None])
    x = diagonal[d]
    gain[w, d] += _xlogx(x + r[w, d] + l[w, d] + own[w]) - _xlogx(x + r[w, d]) - _xlogx(x + l[w, d]) + _xlogx(x)
    out, into = table.sum(1)[:classes], table.sum(0)[:classes]
    for sums, marginal in ((right.sum(1) + own, out), (left.sum(1) + own, into)):
        value, at = np.unique(sums, return_inverse=True)
        gain -= (_xlogx(marginal + value[:, None]) - _xlogx(marginal))[at]
    # cells and sums of the old class are without the word
    has = np.flatnonzero(old >= 0)
    o = old[has]
    for own_side, other, cells in ((right, left, table), (left, right, table.T)):
        there = own_side[has, o]
        w, d = np.nonzero((there > 0)[:, None] & (other[has][:, :classes] > 0))
        x, less, more = cells[d, o[w]], other[has[w], d], there[w]
        gain[has[w], d] += _xlogx(x - less + more) - _xlogx(x - less) - _xlogx(x + more) + _xlogx(x)
    stay = np.zeros(len(has))
    for own_side, cells, marginal in ((right, table, out), (left, table.T, into)):
        w, j = np.nonzero(own_side[has])
        off = j != o[w]
        w, j = w[off], j[off]
        x = cells[o[w], j]
        stay += np.bincount(w, _xlogx(x) - _xlogx(x - own_side[has[w], j]), len(has))
        stay -= _xlogx(marginal[o]) - _xlogx(marginal[o] - own_side[has].sum(1) - own[has])
    x = diagonal[o]
    stay += _xlogx(x) - _xlogx(x - right[has, o] - left[has, o] - own[has])
    gain[has, o] = stay + 1e-9
    return np.where((old < 0) & (left.sum(1) + right.sum(1) == 0), -1, gain.argmax(1)).astype(np.int32)


def _first_classes(index: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The head's words get their classes, in the vocabulary's rows and in the blocks' slices; the others stay without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, packed, none in zip(batch["part"].to_pylist(), batch["ranks"].to_pylist(), batch["classes"].to_pylist(), strict=True):
                ranks = np.arange(len(none)) if packed is None else _unpack(packed, 4)
                known, of = index.get(part, (np.zeros(0, np.int64),) * 2)
                at = np.searchsorted(known, ranks)
                out.append(np.where(np.append(known, -1)[at] == ranks, np.append(of, OPEN)[at], OPEN).astype(np.uint8).tobytes())
            yield pa.record_batch([*(batch[c] for c in batch.schema.names[:-1]), pa.array(out, pa.binary())], schema=WORDS)

    return run


STEP_DDL = WORDS_DDL + ", moved long"


def _exchange_step(table: np.ndarray, some: int = 5000):
    """A part's words, slices and counted neighbours to the same words and slices with new classes, and how many tokens changed theirs."""
    classes = len(table) - 1
    width = 2 * (classes + 2) + 1
    largest = int(table.sum(1)[:classes].argmax())  # until the next round, for words without a neighbour that has a class

    def run(group: pa.Table) -> pa.Table:
        slices: dict[int, np.ndarray] = {}
        near = []
        for row in group.to_pylist():
            if row["block"] is None:
                part, counts, old = row["part"], _unpack(row["counts"], 8), np.frombuffer(row["classes"], np.uint8)
            elif row["pairs"] is None:
                slices[row["block"]] = _unpack(row["ranks"], 4)
            else:
                near.append(row)
        del group
        keys, sums = [], []
        for row in near:
            keys.append(np.repeat(slices[row["block"]] * width, _unpack(row["pairs"], 4)) + _unpack(row["slots"], 1))
            sums.append(_unpack(row["n"], 1))
        del near
        key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, sums))
        del keys, sums
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(n, first).astype(np.float64) if len(first) else n.astype(np.float64)
        row, slot = np.divmod(key[first], width)
        new = np.empty(len(old), np.int64)
        was = np.where(old == OPEN, -1, old.astype(np.int64))
        for i in range(0, len(old), some):
            a, b = np.searchsorted(row, (i, i + some))
            new[i : i + some] = best_classes(table, was[i : i + some], row[a:b] - i, slot[a:b], n[a:b])
        new[new < 0] = largest
        out = _words(part, counts, new, list(slices.items()))
        return out.append_column("moved", pa.array([int(counts[new != was].sum()), *[0] * (out.num_rows - 1)], pa.int64()))

    return run


def exchange_rounds(texts: DataFrame, words: DataFrame, classes: int, rounds: int, few_moves: float, least_rise: float) -> DataFrame:
    """``words`` after rounds of parallel exchange steps of all words: until ``rounds`` are over, a round moves few tokens, or raises the likelihood by under ``least_rise`` a token."""
    before, best, tokens = words, -np.inf, 0
    for i in range(rounds):
        near = _meet(texts, words.where("block is not null"), "classes").mapInArrow(_near(classes), NEAR_DDL)
        near = written(near, "lm-near")
        table = _sum_cells(near.where(f"part = {TEXTS}").select("n").mapInArrow(_cells, "cell long, n long"), (classes + 1) ** 2).reshape(classes + 1, classes + 1).astype(np.float64)
        if i:  # from now on every word has a class
            value, tokens = likelihood(table), table[:classes].sum()
            if value < best + least_rise * tokens:
                return words if value > best else before  # steps of many words at once may undo each other
            before, best = words, value
        rows = words.select("part", "block", "ranks", F.when(F.col("block").isNull(), F.col("counts")).alias("counts"), F.when(F.col("block").isNull(), F.col("classes")).alias("classes"))
        rows = rows.unionByName(near.where(f"part <> {TEXTS}"), allowMissingColumns=True)
        words = written(rows.groupBy("part").applyInArrow(_exchange_step(table), STEP_DDL), "lm-words")
        moved = words.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        words = words.drop("moved")
        discard(near)
        if i and moved <= few_moves * tokens:
            break
    return words


def word_classes(words: DataFrame) -> DataFrame:
    """(part, rank, c, class) of every word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts, of in zip(*(batch[c].to_pylist() for c in ("part", "counts", "classes")), strict=True):
                c = _unpack(counts, 8)
                yield pa.record_batch({"part": np.full(len(c), part), "rank": np.arange(len(c)), "c": c, "class": np.frombuffer(of, np.uint8).astype(np.int64)})

    return words.where("block is null").select("part", "counts", "classes").mapInArrow(run, "part long, rank long, c long, class long")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By class: tokens (cells from 0), words (from 256); in all: words that occur once and twice (512, 513)."""
    table = np.zeros(514, np.int64)
    for batch in batches:
        for counts, of in zip(batch["counts"].to_pylist(), batch["classes"].to_pylist(), strict=True):
            c, k = _unpack(counts, 8), np.frombuffer(of, np.uint8)
            table[:256] += np.bincount(k, c, 256).astype(np.int64)
            table[256:512] += np.bincount(k, minlength=256)
            table[512:] += [(c == 1).sum(), (c == 2).sum()]
    yield pa.record_batch({"cell": np.arange(514), "n": table})


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("word_score", pa.float64()), ("codes", pa.binary())])


def _encode(n_train: int, n_vocab: int, ends: int, emit: np.ndarray, discount: float):
    """A block's texts and its words to the word part of each score and the class of each token."""
    denominator = np.log10(n_train + n_vocab + 1)
    end = np.log10(ends + 1) - denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            c = np.concatenate([_unpack(x, 8) for x in block.slices["counts"]]) if block.parts else np.zeros(0, np.int64)
            k = block.of()
            k = np.where(k == OPEN, UNKNOWN, k)
            word = np.where(c > 0, np.log10(np.maximum(c - discount, 1e-9)) - emit[k], 0.0)
            base = np.log10(c + 1) - denominator
            code = np.where(c == 1, k | HAPAX, k).astype(np.uint8)
            owner, n = np.repeat(np.arange(len(block.sizes)), block.sizes), len(block.sizes)
            known = np.bincount(owner, c[block.codes] > 0, n).astype(np.int64) + (ends > 0)
            edges = np.append(0, np.cumsum(block.sizes)).astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(code[block.codes].tobytes())])
            columns = [pa.array(block.doc_id, mask=block.null), pa.array(block.held), block.sizes + 1, known, np.bincount(owner, base[block.codes], n) + end, np.bincount(owner, word[block.codes], n), codes]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=SCORED)

    return run


def _transitions(end: int):
    """Counts of (class before, class); the row UNKNOWN holds what follows words that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(128 * 128, np.int64)
        for batch in batches:
            codes = [np.frombuffer(x, np.uint8) for x in batch["codes"].to_pylist()]
            if not codes:
                continue
            for i in range(0, len(codes), 2000):
                flat = np.concatenate([y for x in codes[i : i + 2000] for y in (x, [end])]).astype(np.int64)
                now = flat & 0x7F
                before = np.r_[end, now[:-1]]
                table += np.bincount(before * 128 + now, minlength=128 * 128)
                once = np.r_[False, flat[:-1] >= HAPAX]
                table += np.bincount(UNKNOWN * 128 + now[once], minlength=128 * 128)
        at = np.flatnonzero(table)
        yield pa.record_batch({"cell": at, "n": table[at]})

    return run


def _sum_cells(df: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` cells, a bound that the corpus does not move."""
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    return table


def _score(logs: np.ndarray, end: int, n_train: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch["word_score"].to_numpy().copy()
            for i, x in enumerate(batch["codes"].to_pylist()):
                now = np.r_[np.frombuffer(x, np.uint8) & 0x7F, end].astype(np.int64)
                score[i] += logs[np.r_[end, now[:-1]], now].sum()
            n = batch["n_tokens"].to_numpy()
            yield pa.record_batch(
                {x: batch[x] for x in ("doc_id", "held_out", "n_tokens", "n_known")} | {"train_tokens": np.full(len(n), n_train, np.int64), "base_score": batch["base_score"], "score": score, "perplexity": 10.0 ** np.minimum(-score / n, 300)}
            )

    return run


def class_lm_scores(docs: DataFrame, held_out: Column, *, classes: int = 64, head: int = 1000, block_bytes: int = 8 << 20, part_bytes: int = 8 << 20, kappa: float = 5.0, rounds: int = 4, few_moves: float = 0.01, least_rise: float = 0.01) -> DataFrame:
    """Train on the rows for which ``held_out`` is false, score all rows. ``classes`` is at most 120."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    parts = 1 + size // part_bytes

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # or the rounds' shuffle files would add up
    kept = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        coded = written(docs.mapInArrow(_code(block_bytes, parts), CODED_DDL), "lm-blocks")
        texts = coded.where(f"part = {TEXTS}")
        words = written(coded.where(f"part <> {TEXTS}").select("block", "part", "ids", "n").groupBy("part").applyInArrow(_vocabulary, WORDS_DDL), "lm-words")
        vocab = words.where("block is null")
        top = vocab.select("part", "counts").mapInArrow(_top(head), "part long, rank long, c long").orderBy(F.desc("c"), "part", "rank").limit(head).collect()
        of, k = np.zeros(0, np.int64), len(top)
        if k:
            index = {p: tuple(np.array(sorted((r["rank"], i) for i, r in enumerate(top) if r["part"] == p)).T) for p in {r["part"] for r in top}}
            heads = words.where("block is not null").select("block", "part", "ranks").mapInArrow(_head_slices(index, k), "block long, part long, classes binary")
            bigrams = _sum_cells(_meet(texts, heads, "classes").mapInArrow(_head_bigrams(k), "cell long, n long"), k * k).reshape(k, k).astype(np.float64)
            of = exchange(bigrams, np.array([r["c"] for r in top], np.float64), classes)
            index = {p: (at, of[i]) for p, (at, i) in index.items()}
            words = words.mapInArrow(_first_classes(index), WORDS_DDL)
            words = exchange_rounds(texts, words, classes, rounds, few_moves, least_rise)

        totals = _sum_cells(words.where("block is null").select("counts", "classes").mapInArrow(_totals, "cell long, n long"), 514)
        class_n, class_v, (once, twice) = totals[:classes].astype(np.float64), totals[256 : 256 + classes].astype(np.float64), totals[512:].tolist()
        n_train, n_vocab = int(totals[:256].sum()) + ends, int(totals[256:512].sum()) + (ends > 0)
        discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        emit = np.zeros(128)
        emit[:classes] = np.log10(np.maximum(class_n, 1))
        scored = _meet(texts, words.where("block is not null"), "counts", "classes").mapInArrow(_encode(n_train, n_vocab, ends, emit, discount), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, codes binary")
        scored = written(scored, "lm-codes")
    finally:
        spark.conf.set(cleanup, kept)

    end = classes
    moves = _sum_cells(scored.where(~F.col("held_out")).select("codes").mapInArrow(_transitions(end), "cell long, n long"), 128 * 128).reshape(128, 128).astype(np.float64)
    seen = moves.copy()
    seen[UNKNOWN] = 0
    prior = seen.sum(0)[: classes + 1] / max(1.0, seen.sum())
    p = np.zeros((128, 128))
    p[:, : classes + 1] = (moves[:, : classes + 1] + kappa * prior) / (moves[:, : classes + 1].sum(1, keepdims=True) + kappa)
    p[:, UNKNOWN] = p[:, :classes] @ (discount * class_v / np.maximum(class_n, 1))
    if n_train == 0:
        p[:, end] = p[:, UNKNOWN] = 1
    logs = np.log10(np.maximum(p, 1e-300))
    if n_train and not class_v.sum():  # only end tokens were seen: an unknown word gets what add-one would give it
        logs[:, UNKNOWN] = -np.log10(n_train + 2)
    return scored.mapInArrow(_score(logs, end, n_train), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_class_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return class_lm_scores(docs, fold(F.col("doc_id"), 7) == 2)


#: The base columns by plain counting; a text's number is unique. DuckDB has no crc32: it is folded from the digits' bytes.
BASE_ORACLE = r"""
WITH k AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))) AS crc FROM documents),
d AS (SELECT doc_id, xor(crc, 4294967295) % 7 = 2 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents JOIN k USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
e AS (SELECT count(*) FILTER (NOT held_out) AS ends FROM d),
n AS (SELECT ends, (SELECT coalesce(sum(c), 0) FROM c) + ends AS n, (SELECT count(*) FROM c) + CAST(ends > 0 AS INTEGER) AS v FROM e),
s AS (SELECT doc_id, count(c.c) AS known, sum(log10((coalesce(c.c, 0) + 1)::DOUBLE / (n.n + n.v + 1))) AS score FROM t LEFT JOIN c USING (word), n GROUP BY doc_id)
SELECT d.doc_id, d.held_out, CAST(len(words) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + CAST(ends > 0 AS INTEGER) AS BIGINT) AS n_known, CAST(n.n AS BIGINT) AS train_tokens,
  round(coalesce(score, 0) + log10((ends + 1)::DOUBLE / (n.n + n.v + 1)), 6) AS base_score FROM d LEFT JOIN s USING (doc_id), n
"""
