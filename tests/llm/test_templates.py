import random
import re
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from voucherflow.llm.templates import DOCUMENT_COLUMNS, Canon, benchmark_matches, drop_contaminated, op5_template_decontam, rolled

QUESTION = "Yesterday a farmer called John sold 12 apples and 7 pears for 30 dollars, and then John went home to count the 12 apples again."
OTHER = "Yesterday a farmer called Mary sold 15 apples and 9 pears for 44 euros, and then Mary went home to count the 15 apples again."
TORN = "Yesterday a farmer called Mary sold 15 apples and 9 pears for 44 euros, and then Paul went home to count the 81 apples again."


def found(spark, texts, items, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: r["matches"] for r in benchmark_matches(docs, bench, **kw).collect()}


def test_copies_and_changed_slots(spark):
    texts = [f"before it {QUESTION} and after", OTHER, TORN, "Nothing of the kind stands here at all, only some other words in a row."]
    got = found(spark, texts, [(1, QUESTION)], agree=0.9)
    assert [len(got[i]) for i in range(4)] == [1, 1, 0, 0]
    assert got[0][0]["item_id"] == 1 and got[0][0]["changed_slots"] == 0 and got[1][0]["changed_slots"] >= 5


def test_words_of_any_length_take_linear_time():
    began = time.process_time()
    for word in (b"x" + b"-" * 1_000_000 + b"x", b"-" * 1_000_000, b"1" * 1_000_000 + b"x", b"." * 500_000 + b"x" + b")" * 500_000):
        text, *_ = Canon().read([b"two words " + word])
        assert len(text) == (2 if word.strip(b"-") == b"" else 3)
    assert time.process_time() - began < 5


def test_part_of_an_item_counts_from_a_run_on(spark):
    words = [f"word{i}x" for i in range(60)]
    item = " ".join(words)
    got = found(spark, ["so " + " ".join(words[5:18]) + " ok", "so " + " ".join(words[5:15]) + " ok"], [(1, item)])
    assert [len(got[i]) for i in (0, 1)] == [1, 0]


def test_a_small_bitmap_gives_what_a_large_one_gives(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(30)] + [(99, None), (None, "an item that has no number of its own at all"), (31, "equal equals to each other item text"), (30, "equal equals to each other item text")]
    texts = [f"x y {t} z" for _, t in items if t] + ["", None]
    one = found(spark, texts, items)
    many = found(spark, texts, items, most_bits=16)
    norm = lambda got: {k: sorted((m["item_id"] is None, m["item_id"], m["run"]) for m in v) for k, v in got.items()}
    assert norm(one) == norm(many)
    ids = [i for i, t in items if t]
    for k, (i, t) in enumerate((i, t) for i, t in items if t):
        n = len(t.split())
        wanted = 30 if i == 31 else i
        assert (wanted in [m["item_id"] for m in one[k]]) == (n >= 4), (k, i, n)
    assert len(ids) == 33


def test_whole_table_equals_brute_force(spark):
    """Every item whose text stands in a document word for word is found, and nothing that shares under half of an item's 5-word windows."""
    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["item_id"]) for r in op5_template_decontam(spark, sf).collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs = [(r["doc_id"], grams((r["text"] or "").split())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        g = grams(b["text"].split())
        for doc_id, d in docs:
            share = len(g & d) / len(g)
            if share > 0.9:
                assert (doc_id, b["item_id"]) in got
    clean = [doc_id for doc_id, d in docs if not any(g & d for g in [grams(b["text"].split()) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])]
    assert len({i for i, _ in got} & set(clean)) <= 1  # symbols stuck to a copied passage hide it from the plain windows


def test_canonical_words(spark):
    _, h, slot, lower = Canon().read([b"He ran 5 km in 3 hours with Anna today", b"He ran 9 miles in 4 minutes with Bert today"])
    assert slot.tolist() == 2 * [False, False, True, True, False, True, True, False, True, False]
    assert (h[:10] == h[10:]).all() and (lower[:10] != lower[10:]).sum() == 5
    assert [len(m) for m in found(spark, ["He ran 9 miles in 4 minutes with Bert today"], [(1, "He ran 5 km in 3 hours with Anna today")]).values()] == [1]


def test_batches_of_texts_read_as_each_by_itself():
    texts = ["He ran. Anna ran\nBert - ran 5km", "", "\x01 odd \x00 Text", "so Carla went (home).", "\n", "A"]
    whole = Canon().read([x.encode() for x in texts])
    for i, x in enumerate(texts):
        one = Canon().read([x.encode()])
        for a, b in zip(one[1:], whole[1:], strict=True):
            assert a.tolist() == b[whole[0] == i].tolist()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 9))
def test_rolled_hashes_tell_windows_apart(values, n):
    h = np.array([v % 3 for v in values], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = rolled(h, n)
    windows_ = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
    assert len(got) == len(windows_)
    for i, a in enumerate(windows_):
        for j, b in enumerate(windows_):
            assert (got[i] == got[j]) == (a == b)


def test_reparameterised_questions_are_found_and_torn_ones_are_not(spark):
    """Planted: items with other numbers, units and names, put consistently (to be found), and with slots put at random (not), among other prose."""
    rng = random.Random(11)
    names, units = ["Anna", "Bert", "Carla", "Dora", "Emil", "Franz", "Greta", "Heinz"], ["apples", "km", "dollars", "litres", "hours", "kg"]
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 8)))

    def question():
        plain = [word() for _ in range(rng.randint(16, 30))]
        for k in range(2, len(plain), 5):
            plain[k] = "{%d}" % rng.randint(0, 4)
        return " ".join(plain) + " end."

    def fill(q, torn=False):
        values = rng.sample(names, 3) + [str(rng.randint(10, 999)), rng.choice(units)]
        return re.sub(r"\{(\d)\}", lambda m: (rng.choice(names) if int(m[1]) < 3 else str(rng.randint(10, 999))) if torn else values[int(m[1])], q)

    questions = [question() for _ in range(60)]
    items = [(i, fill(q)) for i, q in enumerate(questions)]
    prose = lambda: " ".join(word() for _ in range(rng.randint(20, 80)))
    texts = [f"{prose()} {fill(q)} {prose()}" for q in questions] + [prose() for _ in range(100)]
    got = found(spark, texts, items)
    caught = sum(any(m["item_id"] == i for m in got[i]) for i in range(60))
    wrong = sum(m["item_id"] != i for i, ms in got.items() for m in ms)
    assert caught >= 54 and wrong == 0


def test_long_texts_of_one_word_stay_small(spark):
    """Every window of the text equals every window of the item; rows are sorted and streamed."""
    got = found(spark, ["la " * 3000, "lo " * 30], [(1, "la " * 40)])
    assert [len(got[i]) for i in (0, 1)] == [1, 0]


def test_odd_rows(spark, odd, odd_count):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "A plain text. It has some words, and a second line.")], "item_id long, text string")
    got = benchmark_matches(odd, bench).collect()
    assert len(got) == odd_count and sum(len(r["matches"]) for r in got) == 2 and all(r["matches"][0]["item_id"] is None for r in got if r["matches"])
    assert benchmark_matches(odd.limit(0), bench).count() == 0 and benchmark_matches(odd, bench.limit(0)).count() == odd_count


def test_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = drop_contaminated(spark, docs, sf)
    assert kept.columns == DOCUMENT_COLUMNS
    bad = {r["doc_id"] for r in op5_template_decontam(spark, sf).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_items_of_numbers_and_copies_in_other_capitals_are_found(spark):
    sums, names = "Evaluate 3 + 4 * 12 - 7 / 2 + 15 - 6 * 81", "Anna Berta Carla Dora Emma Frieda Greta Hanna Ida Johanna"
    texts = [f"so it is {sums} and on", f"list of {names} here", QUESTION.title(), QUESTION.upper(), QUESTION.lower(), "Evaluate 4 + 5 * 13 - 8 / 3 + 16 - 7 * 82"]
    got = found(spark, texts, [(1, sums), (2, names), (3, QUESTION)])
    assert [[m["item_id"] for m in got[i]] for i in range(6)] == [[1], [2], [3], [3], [3], []]


def test_benchmark_with_clashing_columns_and_nulls(spark, odd):
    item = "A plain text. It has some words, and a second line."
    bench = spark.createDataFrame([(1, item, "x", 3, "h"), (None, None, None, None, None), (1, item, "y", 4, "i")], "item_id long, text string, `TEXT` string, hash long, `ITEM_ID` string")
    got = benchmark_matches(odd, bench).collect()
    assert [m["item_id"] for r in got for m in r["matches"]] == [1, 1]
