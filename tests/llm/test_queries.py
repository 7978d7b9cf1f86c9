"""The registered queries on one small folder, whose longest text passes every block: columns, types, and right answers."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import queries

from .test_exact_operators import hits_brute

TYPES = {
    "op1": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"doc_id": "bigint", "text": "string"},
}


def _rows():
    rng = random.Random(12)
    some = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    words = lambda n: " ".join(rng.choice(some) for _ in range(n))
    item, shared = words(40), words(200)
    long = words(190_000) + " " + shared + " " + words(190_000) + " " + item + " " + shared + " write to jo.doe@example.com"
    assert len(long) > 2 << 20
    rows = [(k, words(rng.randrange(5, 120)), "en" if k % 2 else "de") for k in range(60)]
    rows += [(60, long, "en"), (61, rows[3][1] + " and", "de"), (62, rows[3][1], None), (63, None, None), (64, "", "en"), (65, shared, "de"), (66, "x " + item, "en"), (67, "12 34 !", None)]
    return rows, [(0, item), (1, words(9)), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("queries"))
    docs, items = _rows()
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def run(spark, folder):
    done = {}

    def one(n):
        if n not in done:
            name = next(x for x in queries.QUERIES if x.startswith(f"op{n}_"))
            out = queries.QUERIES[name](spark, folder)
            types = dict(out.dtypes)
            assert {k: types.get(k) for k in TYPES[f"op{n}"]} == TYPES[f"op{n}"]
            rows = out.collect()
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in _rows()[0])
            done[n] = {r["doc_id"]: r for r in rows}
        return done[n]

    return one


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(run):
    got, texts = run(1), {i: t for i, t, _ in _rows()[0]}
    shards = collections.defaultdict(list)
    for i, r in got.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw)) and r["law"] in ("bytes", "rows", "key")
        assert 0 <= r["shard"] < 24 and (r["grown_shard"] is not None) == (r["law"] == "key")
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op3(run):
    docs, items = _rows()
    got = sorted(repr((i, *(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))) for i, r in run(3).items())
    assert got == hits_brute([(i, t) for i, t, _ in docs], items)


def test_op4(run):
    docs = _rows()[0]
    words = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    count = collections.Counter(w for i, t, _ in docs if fold(i, 10) for w in words(t))
    n, v, got = sum(count.values()), len(count), run(4)
    for i, t, _ in docs:
        w, r = words(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 10) == 0, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_op5(run):
    from tokenizers import Tokenizer

    from weir.llm.bpe import public_vocabulary

    library, got = Tokenizer.from_str(public_vocabulary()), run(5)
    for i, t, _ in _rows()[0]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(run):
    got, media = run(6), collections.defaultdict(set)
    for i, t, _ in _rows()[0]:
        raw, r = (t or "").encode(), got[i]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media[raw].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in media.values())


def test_op7(run):
    docs, got = _rows()[0], run(7)
    seen = collections.Counter(hash(b[k : k + 400]) for _, t, _ in docs for b in [(t or "").encode()] for k in range(len(b) - 399))
    for i, t, _ in docs:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert got[60]["n_spans"] == 2


def test_op7_text(spark, tmp_path):
    """The query hands out what remains: a passage of over 50 words is gone from both texts and from nothing else; a cut within a character leaves U+FFFD."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(7, 12))) for _ in range(n))
    passage, clean, run = words(55), words(90), "".join(rng.choice("abcdefgh") for _ in range(399))
    around = [words(30) + mark for mark in "ACBD"]
    rows = [(0, around[0] + passage + around[2][::-1]), (1, around[1] + passage + around[3][::-1]), (2, clean), (3, "é" + run), (4, "ĩ" + run), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_cover_suffixes"](spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {0: around[0] + around[2][::-1], 1: around[1] + around[3][::-1], 2: clean, 3: "\ufffd", 4: "\ufffd", 5: ""}
    assert got[3]["kept_sha256"] == hashlib.sha256(b"\xc3").hexdigest() and got[3]["n_removed"] == 400


def test_op2(run):
    got = run(2)
    assert got[3]["component_id"] == got[62]["component_id"] == 3 and got[63]["n_shingles"] == got[64]["n_shingles"] == 0 and got[60]["n_shingles"] > 300_000


def test_op8_op9(run):
    language, toxic = run(8), run(9)
    for i, *_ in _rows()[0]:
        assert language[i]["held_out"] == toxic[i]["held_out"] == (fold(i, 3) == 1)
        assert 0 <= language[i]["score"] <= 1 and 0 <= toxic[i]["score"] <= 1 and toxic[i]["predicted"] == int(toxic[i]["score"] >= 0.7)
    assert {i for i, r in language.items() if r["lang_pred"] == "und"} == {63, 64, 67} and {r["lang_pred"] for r in language.values()} <= {"en", "de", "und"}


def test_op10(run):
    texts, got = {i: t for i, t, _ in _rows()[0]}, run(10)
    assert all(got[i]["text"] == t for i, t in texts.items() if i != 60)
    assert "jo.doe@" not in got[60]["text"] and got[60]["text"][:2_000_000] == texts[60][:2_000_000] and re.search(r"write to [a-z]{2}\.[a-z]{3}@[a-z]{7}\.com$", got[60]["text"])


def test_empty_tables(spark, folder, tmp_path):
    """Every query on tables without rows gives none."""
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {name: q(spark, str(tmp_path)).count() for name, q in queries.QUERIES.items()} == dict.fromkeys(queries.QUERIES, 0)
