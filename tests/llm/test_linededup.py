import random

import pandas
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voucherflow.llm.linededup import ORACLE, dedup_lines, winnow

LINE = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))


def run(df, *columns):
    return {r["doc_id"]: r for r in dedup_lines(df, *columns).collect()}


def test_later_runs_go_and_the_first_stays(docs):
    passage = "\n".join([LINE("p", 20), LINE("q", 20), LINE("r", 20)])
    out = run(docs(f"own a\n{passage}\ntail a", f"own b\n{passage}\ntail b", f"{passage}\nown c"))
    assert out[1]["text"] == f"own a\n{passage}\ntail a" and out[1]["removed_lines"] == 0
    assert out[2]["text"] == "own b\ntail b" and (out[2]["removed_lines"], out[2]["removed_words"]) == (3, 60)
    assert out[3]["text"] == "own c"


def test_matches_are_extended_both_ways(docs):
    run_ = "\n".join([LINE("a", 3), LINE("b", 3), LINE("c", 60), LINE("d", 3), LINE("e", 3)])
    out = run(docs(f"x\n{run_}\ny", f"z\n{run_}\nw"))
    assert out[2]["text"] == "z\nw"


def test_short_repeats_stay(docs):
    out = run(docs("Hello there.\nmine one", "Hello there.\nmine two", "Hello there.\n" + LINE("s", 20)))
    assert all(r["removed_lines"] == 0 for r in out.values())


def test_repeats_inside_one_text(docs):
    line = LINE("k", 55)
    assert run(docs("\n".join([line] * 4 + ["end"])))[1]["text"] == f"{line}\nend"


def test_every_deleted_line_has_an_earlier_equal_one_and_long_runs_are_gone(spark):
    """Against brute force on random texts of few distinct lines."""
    rng = random.Random(5)
    pool = [LINE(f"w{i}_", rng.choice([2, 8, 15, 30, 55])) for i in range(25)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    seen: set[str] = set()
    for i, text in enumerate(texts):
        kept, lines = out[i].split("\n") if out[i] else [], text.split("\n")
        place = 0
        for line in lines:
            if place < len(kept) and kept[place] == line:
                place += 1
            else:
                assert line in seen or line in lines[: lines.index(line) + 1]
            seen.add(line)
        assert place == len(kept)
    # whatever repeats for 50 words or more must have lost its later copies: no window of kept lines with so many words occurs twice in adjacency
    grams: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= 50:
                    g = tuple(lines[a : b + 1])
                    if g in grams and grams[g] != i:
                        assert not f"\n{out[i]}\n".count("\n" + "\n".join(g) + "\n")
                    grams.setdefault(g, i)
                    break


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=8), st.lists(st.integers(6, 9), max_size=6), st.lists(st.integers(10, 14), max_size=6), st.lists(st.integers(0, 30), min_size=1, max_size=8))
def test_equal_runs_share_a_fingerprint(before, other, after, shared):
    words = lambda k: " ".join(f"t{k}" for _ in range(1 + k % 13))
    passage = [words(k) for k in shared]
    if sum(len(x.split()) for x in passage) < 50:
        return
    texts = ["\n".join([*map(words, a), *passage, *map(words, b)]).encode() for a, b in ((before, after), (other, before))]
    (_, _, _, a), (_, _, _, b) = (winnow(t, 25, 50) for t in texts)
    assert set(a) & set(b)


def test_odd_rows(odd, odd_count, spark):
    out = dedup_lines(odd, "lang", "source").collect()
    assert len(out) == odd_count and out[0].asDict().keys() == {"doc_id", "lang", "source", "text", "n_lines", "removed_lines", "removed_words"}
    assert dedup_lines(odd.limit(0)).count() == 0


def test_rows_without_ids_and_exact_copies(spark):
    text = LINE("a", 60)
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text)], "doc_id long, text string")
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in dedup_lines(df).collect()))
    assert out == [(False, 4, text), (False, 4, text), (False, 9, ""), (True, 0, "")]


def test_runs_longer_than_what_the_first_place_holds_go_whole(docs):
    """The first text holds only a part of the passage that the third repeats from the second."""
    for k in range(8):
        a, b, c, d = (LINE(f"{x}{k}_", 20) for x in "abcd")
        out = run(docs("\n".join([a, b, d]), "\n".join([a, b, c]), "\n".join([a, b, c])))
        assert out[3]["text"] == ""
    long, tail = LINE("long", 55), LINE("tail", 5)
    assert run(docs(f"{long}\nother", f"{long}\n{tail}", f"{long}\n{tail}"))[3]["text"] == ""
    assert run(docs(f"other\n{long}", f"{tail}\n{long}", f"{tail}\n{long}"))[3]["text"] == ""


def test_the_part_of_a_run_that_the_first_place_of_its_fingerprint_lacks(docs):
    """A holds the middle, B the whole, and C repeats B's run: it must go whole, wherever the least hash falls."""
    for k in range(12):
        x, y, z, own = (LINE(f"{c}{k}_", n) for c, n in (("x", 20), ("y", 60), ("z", 20), ("own", 9)))
        out = run(docs(y, "\n".join([x, y, z]), "\n".join([own, x, y, z])))
        assert out[2]["text"] == f"{x}\n{z}" and out[3]["text"] == own, k


def test_random_texts_equal_all_windows_by_brute_force(spark):
    """The SQL compares every window of every text; lines come from small pools, so runs overlap in many ways."""
    duckdb = pytest.importorskip("duckdb")
    for seed in range(4):
        rng = random.Random(seed)
        pool = [LINE(f"w{i}_", rng.choice([1, 2, 8, 15, 24, 30, 50, 55])) + rng.choice(["", " ", "\t"]) for i in range(rng.choice([3, 12, 30]))] + ["", "  "]
        texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["a b\n" * 26, None, ""]
        for i in range(0, 40, 3):  # whole passages, at other places
            lines = texts[i].split("\n")
            texts[i + 1] += "\n" + "\n".join(lines[rng.randrange(len(lines)) :])
        con = duckdb.connect()
        con.register("documents", pandas.DataFrame({"doc_id": range(len(texts)), "text": texts}))
        want = con.sql(f"SELECT doc_id, text, n_lines, removed_lines, removed_words FROM ({ORACLE})").fetchall()
        got = [tuple(r) for r in dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
        assert sorted(got) == sorted(want) and sum(r[3] for r in got) > 20
