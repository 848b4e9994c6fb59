"""The Jaccard join against all pairs, and its parts."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ngram_join


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[top(k)] = min(smallest.get(top(k), i), i)
    return sorted(((i, len(s), smallest.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "key": F.lit("k"), "component_id": F.lit(0)})
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, **settings).collect()), key=str)


def made_up(seed):
    """Copies, near copies of one text that are not all alike, a passage many share, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = fresh(60), fresh(30)
    texts = [" ".join(fresh(rng.randrange(1, 80))) for _ in range(40)] + [" ".join(base)] * 5
    for _ in range(60):
        edited = list(base)
        for _ in range(rng.randrange(1, 4)):
            edited[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [" ".join(passage + fresh(rng.randrange(0, 12))) for _ in range(40)]
    texts += [None, "", " \n", "a b", "A  B\n", "a", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    return rows + [rows[0], (None, rows[1][1]), (None, "only without an id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = made_up(seed)
    assert joined(spark, rows) == plain_components(rows)


def test_empty_table(spark):
    assert joined(spark, []) == []


def test_long_texts(spark):
    long = " ".join(f"w{k % 9973}" for k in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 10])]
    assert {(r[0], r[2]) for r in joined(spark, rows)} == {(1, 1), (2, 1), (3, 3)}


def test_keep_one(spark):
    rows = made_up(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_first", F.lit("x"))
    kept = ngram_join.keep_one(docs.drop("_first"))
    want = {i for i, _, c in plain_components(rows) if i is not None and i == c}
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert sorted(ids) == sorted(want)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    universe = np.sort(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [np.sort(rng.choice(universe, rng.integers(0, 100), replace=False)) for _ in range(200)]
    index = ngram_join.Index(sets)
    found = 0
    for query in sets:
        want = [
            k for k, s in enumerate(sets)
            if len(s) and len(query) and 100 * len(np.intersect1d(s, query)) >= 75 * len(np.union1d(s, query))
        ]
        found += len(want)
        assert index.search(query).tolist() == want
    assert found > 180


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = ngram_join.components(spark.createDataFrame(edges, "lead long, node long")).collect()
    assert {(r.node, r.root) for r in got} == {(k, 0) for k in range(1, 31)} | {(100 + k, 100) for k in range(1, 40)}


def test_unlike_texts_under_one_id_all_stay(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words[:60]), " ".join(words[60:120]), " ".join(words[120:180])
    rows = [
        (1, a, "x"), (1, b, "x"), (2, f"{a} more", "x"), (3, f"{b} more", "x"), (None, c, "x"), (None, f"{c} more", "x"),
        (1, None, "x"), (1, "", "x"), (1, "", "x"), (7, f"{c} other", "y"), (8, "alone here", "x"), (8, "alone here", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # The named row of the third text goes before the nameless ones.
    want = [(1, a), (1, b), (7, f"{c} other"), (1, None), (1, ""), (1, ""), (8, "alone here")]
    if got.count((8, "alone here")) == 2:
        want.append((8, "alone here"))
    assert got == sorted(want, key=str)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stars", [0, 1])
def test_many_shares_and_blocks_equal_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(ngram_join, "LEAST_SHARE", 1)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", stars)
    rows = made_up(4)[:90]
    assert joined(spark, rows) == plain_components(rows)


def test_finished_steps_leave_no_shuffle_files(spark):
    """Waits for no collection by the driver: its time is not known, and with more memory it comes later."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {path for folder in folders for path in Path(folder).rglob("shuffle_*.data")}

    rows = made_up(5)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    before = files()
    result = ngram_join.near_duplicates(docs)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert result.count() == len(rows)


def test_a_block_search_gets_only_classes_that_could_link(spark):
    # All meet on list 1, the longest of each, and so have it as home: one block for each size.
    sizes = {1: 100, 2: 110, 3: 100, 4: 1000, 5: 1000, 6: 20, 7: 30_000, 8: 30_000, 9: 90}
    roots = {**{k: k for k in sizes}, 5: 4, 8: 7}
    placed = [(shingle, 0, node, sizes[node], roots[node]) for shingle, nodes in [(1, sizes), (2, [1, 3])] for node in nodes]
    placed = spark.createDataFrame(placed, "shingle long, part int, node long, n long, root long")
    rows = ngram_join._block_requests(placed, 75).collect()
    # 4 and 5, and 7 and 8, are one component; no other has the size of 6.
    assert {r.node for r in rows} == {1, 2, 3, 9}
    searches = {}
    for r in rows:
        searches.setdefault((r.block, r.other), []).append(r.node)
    for a, b in [(1, 2), (1, 3), (1, 9), (2, 3), (3, 9)]:
        assert any(a in nodes and b in nodes for nodes in searches.values())
