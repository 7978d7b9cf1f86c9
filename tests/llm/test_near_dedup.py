import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import near_dedup


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        n = min(width, len(w))
        sets.setdefault(i, set()).update(tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, copies, width, monkeypatch):
    monkeypatch.setattr(near_dedup, "_LOT", 16)
    monkeypatch.setattr(near_dedup, "_PART", 1000)
    monkeypatch.setattr(near_dedup, "_CHUNK", 3000)
    want = brute(copies, width, 80)
    got = near_dedup.near_groups(spark.createDataFrame(copies, "doc_id long, text string"), width=width).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert len(got) == len(copies)


def test_odd_rows(odd, empty):
    got = [(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(odd, width=2).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == odd.count()
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert by[4][2:] == (4, True) and by[5][2:] == (4, False)
    assert by[6] == (6, 1, 6, True) and by[None][2:] == (None, True)
    assert near_dedup.near_groups(empty).count() == 0


def near_copies(n, seed=11):
    """Copies of one text with so many changes that pairs lie on both sides of the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(2, 16)):
            text[rng.randrange(len(text))] = word()
        out.append((k, " ".join(text)))
    return out


def test_repeated_ids_are_documents_of_their_own(spark):
    """The text under a row's id decides its links, in whatever order the rows come."""
    rows = [(1, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l m"), (5, "other words that stand in no other document"), (7, "other words that stand in no other document"), (9, "alone here")]
    for order in (rows, rows[::-1]):
        got = sorted((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(spark.createDataFrame(order, "doc_id long, text string").repartition(3), width=2).collect())
        assert got == [(1, 11, 1, True), (5, 7, 5, True), (5, 12, 1, False), (7, 7, 5, False), (9, 1, 9, True)]


def test_blocks_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    shipped, real = [], near_dedup._block_rows
    monkeypatch.setattr(near_dedup, "_block_rows", lambda members, sets: shipped.append(real(members, sets).count()) or real(members, sets))
    for n in (200, 400, 800):
        rows = near_copies(n)
        got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
        if n == 200:
            assert got == {i: c for i, (_, c) in brute(rows, 2, 80).items()}
    assert len(shipped) >= 2 and all(b <= 2.2 * a for a, b in zip(shipped, shipped[1:]))


def test_prefixes_miss_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets = {k: np.unique(np.concatenate([rng.permutation(40)[: rng.integers(33, 41)], rng.integers(40, 300, rng.integers(0, 9))])) for k in range(120)}
    df = spark.createDataFrame([(k, k, len(s), s.tolist()) for k, s in sets.items()], "node long, comp long, n long, hs array<long>")
    front = {}
    for r in near_dedup._prefixes(df, 80).collect():
        front.setdefault(r["key"], set()).add(r["node"])
    met = {(a, b) for v in front.values() for a in v for b in v if a < b}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert similar and similar <= met


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_on_documents(spark, sf):
    """The registered query against all pairs, with its columns and types."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    out = near_dedup.op2_circulant_minhash(spark, f"/root/testdata/{sf}")
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert out.filter(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
