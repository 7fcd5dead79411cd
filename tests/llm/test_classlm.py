import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voucherflow.llm import classlm
from voucherflow.llm.classlm import best_classes, class_lm_scores, exchange, likelihood, op1_class_lm
from voucherflow.llm.common import fold

SF = "/root/testdata/sf0.001"


def base_scores(rows):
    """By plain counting: (held out, tokens, known, base score, N) of each row."""
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    words = [(r[1] or "").encode().lower().split() + [None] for r in rows]
    c = Counter(w for h, ws in zip(held, words, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), n) for h, ws in zip(held, words, strict=True)]


def test_base_columns_equal_plain_counting_and_the_model_is_better(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: w for r, w in zip(rows, base_scores(rows), strict=True)}
    got = op1_class_lm(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, base, total = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all texts of up to five words of the vocabulary and one unknown word."""
    train = ["a b a c", "b a b", "c c a", "a b"]
    texts = [" ".join(x) for n in range(6) for x in product(["a", "b", "c", "unseen"], repeat=n)]
    df = spark.createDataFrame(list(enumerate(train)) + [(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in class_lm_scores(df, F.col("doc_id") >= 100, classes=3).collect()}
    by_length = [sum(got[100 + i] for i, t in enumerate(texts) if len(t.split()) == n) for n in range(6)]
    # the rest of the mass is that of longer texts, which falls by a steady factor
    assert 0.6 < sum(by_length) < 1 and sum(by_length) + by_length[5] * (q := by_length[5] / by_length[4]) / (1 - q) == pytest.approx(1, abs=0.01)


def test_exchange_separates_words_by_their_neighbours():
    """Words 0-3 are always followed by 4-7 and the reverse: two classes must part them."""
    n = np.zeros((8, 8))
    n[:4, 4:], n[4:, :4] = 10, 10
    n += np.eye(8)
    of = exchange(n, n.sum(1), 2)
    assert len(set(of[:4])) == len(set(of[4:])) == 1 and of[0] != of[4]


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    n = rng.poisson(1.0, (12, 12)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

    def value(of):
        one = np.eye(3)[of]
        return f(one.T @ n @ one) - 2 * f(one.T @ n.sum(1))

    assert value(exchange(n, n.sum(1), 3)) >= value(np.arange(12) % 3) - 1e-6


def test_odd_rows(spark, odd, odd_count):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = class_lm_scores(odd, fold(F.col("doc_id"), 7) == 2).collect()
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6))
    assert sorted(map(key, ((r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got))) == sorted(map(key, (w[:4] for w in base_scores(rows))))
    assert len(got) == odd_count and all(math.isfinite(r["score"]) for r in got)


def test_empty_tables(spark, odd):
    assert class_lm_scores(odd.limit(0), F.lit(False)).count() == 0
    got = class_lm_scores(odd, F.lit(True)).collect()  # nothing to learn from
    assert {r["train_tokens"] for r in got} == {0} and {r["score"] for r in got} == {0.0}


def test_parallel_step_equals_moving_each_word_by_itself():
    rng = np.random.default_rng(3)
    classes, k = 4, 12
    n = rng.poisson(0.8, (k + 1, k + 1))  # the last one is the texts' edge
    n[k, k] = 0
    of = np.append(rng.integers(0, classes, k), classes)

    def table(of):
        one = np.eye(classes + 1)[of]
        return one.T @ n @ one

    side = classes + 2
    slots = np.zeros((k, 2 * side + 1))
    for w in range(k):
        for v in range(k + 1):
            if v == w:
                slots[w, -1] += n[w, w]
            else:
                slots[w, of[v]] += n[v, w]
                slots[w, side + of[v]] += n[w, v]
    row, slot = np.nonzero(slots)
    got = best_classes(table(of).astype(float), of[:k].astype(np.int32), row, slot, slots[row, slot], few=2)
    for w in range(k):
        values = [likelihood(table(np.where(np.arange(k + 1) == w, d, of)).astype(float)) for d in range(classes)]
        assert values[got[w]] == pytest.approx(max(values), abs=1e-6)


def test_words_beyond_the_head_are_clustered_by_each_other(spark, monkeypatch):
    """With a head of one word, the others' classes can only come from one another: no word may fall to a default class."""
    seen = []
    rounds = classlm.exchange_rounds
    monkeypatch.setattr(classlm, "exchange_rounds", lambda *a: seen.append(rounds(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[j % 2]}{rng.integers(0, 6)}" for j in range(i % 2, i % 2 + 24)) for i in range(80)] + ["the the the"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(class_lm_scores(df, F.lit(False), head=1, classes=4).collect()) == len(texts)
    got = [r["class"] for r in classlm.word_classes(seen[0]).collect()]
    assert all(0 <= c < 4 for c in got)
    assert len(got) == 13 and len(set(got)) > 1
