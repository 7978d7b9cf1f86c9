"""Operators with one right answer, against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import _chains, bpe, decontam, lm, media, sharding, suffix_dedup
from weir.llm.langid import fold

from .conftest import ODD


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    run = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [run(n) for n in (350, 399, 400, 401, 600, 900, 2000)]
    rows = [(i, "".join(rng.choice([run(rng.randrange(0, 300)), rng.choice(shared)[rng.randrange(0, 60) :]]) for _ in range(rng.randrange(0, 8)))) for i in range(60)]
    return rows + [(1002, "x" * 3000), (1003, "ab" * 700), (1004, rows[5][1]), (1005, rows[5][1]), (1006, "é" * 300), (1007, "Sich " * 300 + run(200) + "Sich " * 90)]


def test_shards(spark, mixed, odd, empty):
    df = spark.createDataFrame(mixed, "doc_id long, text string").withColumn("size", F.octet_length("text").cast("long") + 8)
    out = sharding.shard(df, "size", "doc_id", "text", 5, range_bytes=2000).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert len(out) == len(mixed) and set(by) == set(range(5))
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)
    assert sharding.shard(odd.withColumn("size", F.lit(1)), "size", "doc_id", "text", 3).count() == len(ODD)
    assert sharding.shard(empty.withColumn("size", F.lit(1)), "size", "doc_id", "text", 3).count() == 0


def cut_brute(rows):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    out = []
    for i, b in raw:
        edge = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(map(repr, out))


@pytest.mark.parametrize("cap", [4, 8192])
def test_repeats(spark, mixed, cap):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(mixed, "doc_id long, text string"), cap=cap).collect()
    assert sorted(repr((*tuple(r)[:5], bytes(r["kept"]))) for r in got) == cut_brute(mixed)


def test_repeats_odd(odd, empty):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert sorted(repr((*tuple(r)[:5], bytes(r["kept"]))) for r in got) == cut_brute(ODD)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_difference_cover():
    on, shift = suffix_dedup.cover()
    for a in range(32):
        for b in range(32):
            assert on[(a + shift[a, b]) % 32] and on[(b + shift[a, b]) % 32]


def hits_brute(docs, items, size=13):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: find.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("turn", [8 << 20, 200])
def test_contamination(spark, turn):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("ab cd ef É9 gh".split()) for _ in range(n))
    items = [(k, words(rng.randrange(0, 20))) for k in range(12)] + [(50, None), (51, "")]
    docs = [(k, words(rng.randrange(0, 80)) + "! " + (items[k % 12][1] or "") + ";" + words(5)) for k in range(60)] + ODD
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), turn_bytes=turn).collect()
    assert sorted(repr(tuple(r)) for r in got) == hits_brute(docs, items)


def test_contamination_of_nothing(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x y green z blue"), (2, "blue green red"), (3, "red green")], "id long, text string")
    from weir.llm._scratch import Scratch

    scratch = Scratch(spark, "test")
    index = decontam.build_index(docs, scratch)
    items = spark.createDataFrame([("a", "red green blue")], "item string, text string")
    found = {r["id"]: r["items"] for r in decontam.find(index, items, scratch, within=4).collect()}
    assert found == {1: [], 2: ["a"], 3: []}
    assert {r["id"]: len(r["starts"]) for r in decontam.find(index, items, scratch, within=6).collect()} == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize("lexicon", [0, 200])
def test_bpe(spark, lexicon):
    from tokenizers import Tokenizer

    vocabulary = bpe.public_vocabulary()
    library = Tokenizer.from_str(vocabulary)
    rng = random.Random(2)
    chars = "abcdeABC  \n\t.,!'sS'tİΣσß①²½éÉé日本한가​\x1c\x85\xa0　١٢🙂👍🏽_<|>ǅŉ’"
    rows = [(k, "".join(rng.choice(chars) for _ in range(rng.randrange(0, 60)))) for k in range(400)] + ODD + [(700, "a <|endoftext|> b<|startoftext|>"), (701, "It's we'll THEY'VE")]
    got = {repr((r["id"], r["n_tokens"], list(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"])) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary, lexicon=lexicon).collect()}
    want = set()
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add(repr((k, len(ids), ids, text, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert got == want


def test_lexicon_is_minimal(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"t"]
    flat = bpe.compile_lexicon({w: [k, k + 1] for k, w in enumerate(words)})
    (tmp_path / "x").write_bytes(flat)
    lex = bpe.Lexicon(str(tmp_path / "x"))
    assert len(lex.final) == 5  # start, t, and the shared ends of the rest
    numbers = lex.numbers([*words, b"ta", b"", b"tapsy", b"zz"])
    assert [lex.of(n).tolist() for n in numbers[:5]] == [[k, k + 1] for k in range(5)] and (numbers[5:] == -1).all()


def test_media(spark, mixed, odd, empty, monkeypatch):
    rows = mixed + ODD
    for limit in (0, 1 << 25):
        monkeypatch.setattr(media, "BROADCAST", limit)
        kept, docs, facts = media.store(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {}
        for r in docs.join(facts, "pid").collect():
            got.setdefault(r["id"], []).append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]))
        want = {}
        for i, t in rows:
            b = (t or "").encode()
            p = media.payload(b)
            want.setdefault(i, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), media.feature(p)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert media.store(empty)[2].count() == 0


def test_lm_counts(spark, mixed):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("the cat sat on a mat The dog".split()) for _ in range(rng.randrange(0, 30)))) for k in range(80)] + ODD
    got = {(r["id"], r["n_tokens"]): r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), fold(n=10) != 0, rounds=1).collect()}
    count = collections.Counter()
    words = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            count.update(words(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        w = words(t)
        r = got[i, len(w)]
        assert r["train_tokens"] == n and r["n_known"] == sum(count[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_is_normalised(monkeypatch):
    monkeypatch.setattr(lm, "_AT_ONCE", 2)
    rng = np.random.default_rng(8)
    outputs = lm.Outputs(rng.integers(0, 2**63, 90).astype(np.uint64), 5000 / np.arange(1, 91), rng.random(lm.CLASSES) * 40)
    slots = np.arange(outputs.size[0])
    assert (np.diff(outputs.share) <= 0).all() and (np.diff(outputs.group) >= 0).all() and outputs.size[1] > 5
    assert sorted([*outputs.slots(outputs.head, np.zeros(90, int)), *outputs.slots(np.zeros(lm.CLASSES, np.uint64), np.arange(lm.CLASSES))]) == slots.tolist()
    trainer = lm.Trainer(lm.Weights.start(outputs).flat, outputs, 0.1, 0)
    for _ in range(30):
        one = rng.choice(slots, 400, p=outputs.share)
        trainer.learn(one, one, (one * 7 + 1) % len(slots))
    model = lm.Model(trainer.w.flat, outputs, 1, 1, np.ones(lm.CLASSES), np.ones(lm.CLASSES))
    for before in ([], [3], [3, 7]):
        total = sum(10 ** model.log10(np.array([*before, s]), np.array([0, len(before) + 1]))[-1] for s in slots)
        assert abs(total - 1) < 1e-3
    follows = np.array([10 ** model.log10(np.array([3, 3, s]), np.array([0, 3]))[-1] for s in slots])
    assert follows.argmax() == 22


def test_lm_steps_follow_the_plain_rule():
    """The step's shared products and the sums of exponentials against the rule written out in doubles, also beyond the range of floats."""
    rng = np.random.default_rng(3)
    outputs = lm.Outputs(rng.integers(0, 2**63, 60).astype(np.uint64), 4000 / np.arange(1, 61), rng.random(lm.CLASSES) * 40)
    trainer = lm.Trainer(lm.Weights.start(outputs).flat, outputs, 0.1, 0)
    trainer.w.b[3] = -200  # so unlikely that the exponential has no float
    w, n = lm.Weights(trainer.w.flat.astype(float), outputs.size), 500
    one, two, target = (rng.integers(0, outputs.size[0], n) for _ in range(3))
    noise = np.searchsorted(trainer.draw, np.random.default_rng(0).random(lm.NOISE) * trainer.draw[-1])
    grad, h = lm.Weights(np.zeros_like(w.flat), outputs.size), w.r[one] @ w.c1 + w.r[two] @ w.c2
    sure = lambda x: 1 / (1 + np.exp(-x))
    for k in range(n):
        g = int(outputs.group[target[k]])
        parts = [("g", "a", g, 1 - sure(h[k] @ w.g[g] + w.a[g] - trainer.noise[g]))] + [("g", "a", int(j), -sure(h[k] @ w.g[j] + w.a[j] - trainer.noise[j])) for j in noise]
        if (own := range(outputs.start[g], outputs.start[g + 1]))[1:]:
            odds = {j: sure(h[k] @ w.q[j] + w.b[j] - trainer.inner[j]) for j in own}
            parts += [("q", "b", j, -float(trainer.weight[j]) * odds[j] + (1 - odds[j]) * (j == target[k])) for j in own]
        back = np.zeros(lm.DIM)
        for name, bias, j, x in parts:
            getattr(grad, name)[j] += x * h[k]
            getattr(grad, bias)[j] += x
            back += x * getattr(w, name)[j]
        grad.c1[:] += np.outer(w.r[one[k]], back)
        grad.c2[:] += np.outer(w.r[two[k]], back)
        grad.r[one[k]] += w.c1 @ back
        grad.r[two[k]] += w.c2 @ back
    move = grad.flat * 10 / n
    with np.errstate(all="raise", under="ignore"):
        trainer.learn(one, two, target)
        x = rng.normal(0, 30, (50, 20)).astype(np.float32)
        for scale in (0.1, 1, 40):
            y = (x * scale).astype(float)
            assert np.allclose(lm._log_sum((x * np.float32(scale)).copy()), y.max(axis=1) + np.log(np.exp(y - y.max(axis=1)[:, None]).sum(axis=1)), rtol=1e-4, atol=1e-4)
    assert np.allclose(trainer.sum, 1e-5 + move**2, rtol=1e-3, atol=1e-6)
    assert np.allclose(trainer.w.flat, w.flat + 0.1 * move / np.sqrt(1e-5 + move**2), atol=2e-3)
    assert lm._against(np.zeros(3, np.float32)).tolist() == [2.0] * 3


def test_lm_beats_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = lm.score(docs, fold(n=10) != 0).filter(fold("id", 10) == 0).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > 0.97 * out["b"]


def test_chains():
    rng = np.random.default_rng(0)
    first = np.concatenate([[0], np.cumsum([0, 1, 130, 400, 257])])
    score = (rng.normal(size=(first[-1], 3)) * 2).astype(np.float32)
    label = _chains.viterbi(score, first, 2.0)
    weight, start, step = np.exp(rng.normal(size=(first[-1], 2))), np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.4, 0.6]])
    pairs = np.zeros((2, 2))
    p = _chains.marginals(weight, first, start, step, pairs)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        x = score[a:b].astype(float)
        v = x[0].copy()
        for t in range(1, len(x)):
            v = np.maximum(v, v.max() - 2.0) + x[t]
        own = label[a:b]
        assert abs(x[np.arange(len(x)), own].sum() - 2.0 * (np.diff(own) != 0).sum() - v.max()) < 1e-2
        w, n = weight[a:b], b - a
        f, back = np.zeros((n, 2)), np.ones((n, 2))
        f[0] = start * w[0]
        for t in range(1, n):
            f[t] = (f[t - 1] @ step) * w[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            back[t] = step @ (w[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        g = f * back
        assert np.abs(g / g.sum(axis=1, keepdims=True) - p[a:b]).max() < 1e-6
        for t in range(1, n):
            e = f[t - 1][:, None] * step * (w[t] * back[t])[None, :]
            want_pairs += e / e.sum()
    assert np.abs(pairs - want_pairs).max() < 1e-6
