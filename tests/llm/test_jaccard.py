import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from voucherflow.llm import graph, jaccard
from voucherflow.llm.common import DOCUMENT_COLUMNS
from voucherflow.llm.graph import components
from voucherflow.llm.jaccard import ORACLE, forest, jaccard_groups, links, ngrams, one_of_each_group, op6_ngram_jaccard, plan_bands


def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(class, links) of each row's text, by all pairs."""
    sets = {}
    for _, t in rows:
        sets.setdefault(grams(t), len(sets))
    keys = list(sets)
    close = [[i != j and a and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(keys)] for i, a in enumerate(keys)]
    root = list(range(len(keys)))
    for _ in keys:
        root = [min([root[i]] + [root[j] for j in range(len(keys)) if close[i][j]]) for i in range(len(keys))]
    return [(root[sets[grams(t)]], sets[grams(t)], sum(close[sets[grams(t)]])) for _, t in rows]


def check(rows, got):
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    groups, texts = defaultdict(set), defaultdict(set)
    for r in got:
        groups[want[r["doc_id"]][0]].add(r["class_id"])
        texts[want[r["doc_id"]][1]].add(r["text_id"])
        assert r["n_links"] == want[r["doc_id"]][2]
    assert all(len(x) == 1 for x in [*groups.values(), *texts.values()])
    assert len({next(iter(x)) for x in groups.values()}) == len(groups) and len({next(iter(x)) for x in texts.values()}) == len(texts)


def near_copies(rng, n, groups):
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block", [512, 5])
def test_equals_all_pairs(spark, block):
    """With the small block every group is spread over several tasks."""
    rows = near_copies(random.Random(4), 14, 6)
    check(rows, jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect())


def test_sf_table_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], jaccard_groups(docs).collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(map(tuple, op6_ngram_jaccard(spark, "/root/testdata/sf0.01").collect())) == sorted(con.sql(ORACLE).fetchall())


def test_recall_of_the_bands():
    bands, rows = plan_bands(0.8, 0.9999, 280)
    assert (bands, rows) == (40, 7) and (1 - 0.8**rows) ** bands < 1e-4


def test_links_and_forest():
    sets = [ngrams(t, 5) for t in (b"a b c d e f g h i j k l", b"a b c d e f g h i j k l m", b"z y x w v u")]
    close = links(sets, 0.8)
    assert close.tolist() == [[False, True, False], [True, False, False], [False] * 3] and forest(close).tolist() == [0, 0, 2]
    chain = np.zeros((50, 50), bool)
    for i in range(49):
        chain[i, i + 1] = chain[i + 1, i] = True
    assert forest(chain).tolist() == [0] * 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)] + [(300 + i, 300) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, **dict.fromkeys(range(300, 340), 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, odd_count):
    got = jaccard_groups(odd).collect()
    assert len(got) == odd_count and all(r["n_links"] == 0 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[1] == {1} and by[2] == by[3] == by[4] == {2} and by[None] == {None, 2}
    assert jaccard_groups(odd.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark, odd):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base), "another text with some words in it", "short", "short"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = one_of_each_group(spark, docs, "")
    assert kept.columns == DOCUMENT_COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]
    ids = [r["doc_id"] for r in one_of_each_group(spark, odd, "").collect()]
    assert sorted(ids, key=repr) == sorted([1, 2, 5, 6, 7, -8, None], key=repr)


def test_one_gram_equals_the_same_gram_of_a_longer_text():
    assert ngrams(b"x x x x x", 5).tolist() == ngrams(b"x x x x x x", 5).tolist() != ngrams(b"x x x x", 5).tolist()


def test_components_go_on_until_settled(spark, monkeypatch):
    edges, least = spark.createDataFrame([(2, 1)], "a long, b long"), spark.createDataFrame([(2, 1)], "a long, m long")
    rounds = iter(range(100))
    monkeypatch.setattr(graph, "written", lambda df, name: least if name.endswith("least") else edges)
    monkeypatch.setattr(graph, "_settled", lambda _: next(rounds) == 80)
    components(edges)
    assert next(rounds) == 81


def chain(n, step=8, size=100):
    """Texts that each share most of their words with the next one only: similarity 0.85 to the next, 0.71 to the one after."""
    words = [f"c{i}" for i in range(n * step + size)]
    return [(i, " ".join(words[i * step : i * step + size])) for i in range(n)]


def test_a_chain_is_verified_by_buckets_and_equals_all_pairs(spark, monkeypatch):
    seen = []
    units = jaccard._units
    monkeypatch.setattr(jaccard, "_units", lambda *a: seen.append(units(*a)) or seen[-1])
    rows = chain(300)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()
    assert {r["class_id"] for r in got} == {0} and sorted(r["n_links"] for r in got) == [1, 1] + [2] * 298
    sent = seen[0].selectExpr("sum(blocks)", "sum(if(band is null, 0, 1))").first()
    assert sent[1] > 0 and sent[0] < 300 * 300 / 8 / 2  # the component as one unit would be 300 classes in 38 blocks


def test_both_ways_of_a_large_component_and_rows_that_repeat(spark):
    rows = near_copies(random.Random(9), 40, 3) + [(1000 + i, t) for i, t in chain(60)]
    rows += [(5000 + i, rows[3][1]) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:1] * 50, "doc_id long, text string")
    got = jaccard_groups(df, block=6).collect()
    assert len(got) == len(rows) + 50
    check(rows, got)
