import random
from collections import Counter, defaultdict

import numpy as np
import pandas
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voucherflow.llm.mixing import DOCUMENT_COLUMNS, ORACLE, mix, mixed, op7_source_mix, sainte_lague, targets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 5, 7, 7, 100, 33.3]), st.integers(0, 12)), min_size=1, max_size=6), st.integers(0, 40))
def test_seats_equal_handing_them_out_one_by_one(parties, seats):
    claims, most = map(np.array, zip(*parties, strict=True))
    given_ = [0] * len(parties)
    for _ in range(seats):
        open_ = [(-(claims[i] / (2 * given_[i] + 1)), i) for i in range(len(parties)) if given_[i] < most[i] and claims[i] > 0]
        if not open_:
            break
        given_[min(open_)[1]] += 1
    assert sainte_lague(claims, seats, most).tolist() == given_


def test_targets():
    t = targets(np.array([10, 1000, 1000]), np.array([5.0, 2.0, 1.0]), 1.5, 2.0)
    assert t == pytest.approx([20, 2995 * 2 / 3, 2995 / 3])
    assert targets(np.array([10, 100, 1000]), np.array([5.0, 2.0, 1.0]), 1.5, 2.0) == pytest.approx([20, 200, 1445])
    assert targets(np.array([0, 0]), np.array([5.0, 2.0]), 1.5, 2.0).tolist() == [0, 0]


def verify(rows, most_off=16.0):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for part in by.values():
        assert {r["source_size"] for r in part} == {sum(r["size"] for r in part)}
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= most_off


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mix(docs, "source").collect()
    verify(got)
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == words
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += words[r["doc_id"]]
    names = sorted(sizes)
    want = targets(np.array([sizes[n] for n in names]), np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float), 1.5, 2.0)
    for r in got:
        assert r["target"] == pytest.approx(want[names.index(r["source"])])
    again = op7_source_mix(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got)


def test_many_shards(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(900)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source", shard_docs=40).collect()
    assert len(got) == 900
    verify(got, 16.0 * 5)


def test_odd_rows(spark, odd, odd_count):
    got = mix(odd, "source").collect()
    assert len(got) == odd_count
    verify(got)
    assert sum(r["size"] == 0 for r in got) == 4
    assert mix(odd.limit(0)).count() == 0
    nothing = mix(odd.where("doc_id in (2, 3, 4)")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in nothing} == {(0, 0.0, 0)}


def test_stage(spark):
    sf = "/root/testdata/sf0.001"
    out = mixed(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert out.columns == [*DOCUMENT_COLUMNS, "size", "source_size", "target", "taken"] and out.where("taken < 1").count() == 0


def test_equal_rows_share_no_shard_of_their_own_and_are_all_there(spark):
    rows = [(1, "a b c d e f g", "x", 7)] * 500 + [(None, None, "x", None)] * 3 + [(None, "", "x", 0)] * 2 + [(i, "w " * (i % 40), "y", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mix(df, "source", "text", "n_chars", shard_docs=100).collect()
    verify(got, 16.0 * 9)
    count = lambda rows: sorted(Counter(rows).items(), key=str)
    assert count((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in got) == count(rows)


def test_random_sources_equal_all_quotients_by_brute_force(spark):
    """The SQL hands blocks out by sorting every quotient."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    for n_sources in (1, 2, 7):
        rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice([None, *map(chr, range(97, 97 + n_sources))]) if n_sources > 1 else "a") for i in range(250)]
        con = duckdb.connect()
        con.register("documents", pandas.DataFrame(rows, columns=["doc_id", "text", "source"]))
        want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})").fetchall()
        got = [tuple(r) for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
        assert sorted(got) == sorted(want)
