"""Toxic spans by a linear-chain conditional random field.

Documents carry the labels, so tokens get theirs first: a word or word beginning
that sets toxic documents apart from others marks its tokens in them. On these
a two-label chain is trained (weights of word features and transitions, by gradient
steps on forward-backward expectations). Marginals give spans; their greatest and
their sum, through a logistic curve fitted on the labelled documents, a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import _text
from weir.llm._chains import marginals
from weir.llm._scratch import arrow_map
from weir.llm.langid import fold

#: Labelled documents of each label that the model, chain and curve, is fitted on, chosen by a hash of the id.
SAMPLE = 2000
#: Labelled documents of each label on which word features are counted again, with those of SAMPLE among them.
RECOUNT = 12_000
#: Word features that a model may hold.
LEXICON = 20_000
_BEGIN = (4, 5, 6)
_LEAST, _ODDS = 6, 8.0
_STEPS = 20
CUT = 0.7


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word, first byte of each word, first word of each row): the word, and its first 4, 5 and 6 bytes."""
    h, at, first = _text.words(data, off, _text.ALNUM)
    out = np.empty((len(h), 1 + len(_BEGIN)), np.uint64)
    out[:, 0] = h
    padded = np.concatenate([data, np.zeros(max(_BEGIN), np.uint8)])
    begin = np.zeros(len(h), np.uint64)
    alive = np.ones(len(h), bool)
    for k in range(max(_BEGIN)):
        c = padded[at + k]
        alive &= _text.ALNUM[c]
        begin = begin * np.uint64(257) + np.where(alive, _text._LOWER[c].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if k + 1 in _BEGIN:
            col = 1 + _BEGIN.index(k + 1)
            # a shorter word has no such beginning
            out[:, col] = np.where(alive, _text.mix(begin * np.uint64(8) + np.uint64(k)), np.uint64(0))
    return out, at, first


class Model:
    def __init__(self, keys: np.ndarray, weight: np.ndarray, bias: float, start: np.ndarray, step: np.ndarray, curve: np.ndarray):
        self.keys, self.weight, self.bias, self.start, self.step, self.curve = keys, weight, bias, start, step, curve

    def places(self, features: np.ndarray) -> np.ndarray:
        """Each feature's place in the lexicon; its length where it has none."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, at, len(self.keys))

    def tag(self, places: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Probability that each word is toxic."""
        lift = np.append(self.weight, 0.0)[places].sum(axis=1) + self.bias
        w = np.ones((len(places), 2))
        w[:, 1] = np.exp(np.clip(lift, -30, 30))
        return marginals(w, first, self.start, self.step, pairs)[:, 1]

    def summary(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By document: greatest and summed marginals, and the expected share of words, as the curve takes them."""
        size = np.diff(first)
        out = np.zeros((len(size), 4))
        out[:, 0] = 1
        some = np.flatnonzero(size)
        if len(some):
            cut = first[:-1][some]
            out[some, 1] = np.maximum.reduceat(p, cut)
            total = np.add.reduceat(p, cut)
            out[some, 2] = np.log1p(total)
            out[some, 3] = np.log1p(1000 * total / size[some]) / 4
        return out

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(p, first) @ self.curve, -40, 40)))


def _present(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document) of rows of features."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first) * features.shape[1])
    flat = features.ravel()
    order = np.lexsort((doc, flat))
    key, doc = flat[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    return key[new], doc[new]


def _set_apart(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """Is a feature in _LEAST toxic documents, and _ODDS times as frequent there as in the others?"""
    return (a >= _LEAST) & (((a + 0.5) / (n + 1)) / ((b + 0.5) / (m + 1)) >= _ODDS)


def _lexicon(features: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that set the toxic documents apart."""
    keys, bad = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for i, j in _text.blocks(first, 1 << 18):
        key, doc = _present(features[first[i] : first[j]], first[i : j + 1] - first[i])
        keys.append(key)
        bad.append(toxic[i + doc])
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    bad = np.concatenate(bad)
    a = np.bincount(where, weights=bad, minlength=len(key))
    b = np.bincount(where, weights=1 - bad, minlength=len(key))
    chosen = np.flatnonzero((key != 0) & _set_apart(a, b, toxic.sum(), (1 - toxic).sum()))
    chosen = chosen[np.argsort(-a[chosen], kind="stable")][:LEXICON]
    return np.sort(key[chosen])


def recounted(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Those ``keys`` that set toxic documents apart among all of ``rows`` (text, toxic) too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(keys) + 1), np.int64)
        for b in batches:
            data, off, _ = _text.column(b, "text")
            toxic = np.asarray(b.column(1))
            for i, j in _text.blocks(off):
                features, _, first = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                key, doc = _present(features, first)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = keys[at] == key
                for t in (0, 1):
                    sums[t, :-1] += np.bincount(at[ok & (toxic[i + doc] == t)], minlength=len(keys))
                    sums[t, -1] += int((toxic[i:j] == t).sum())
        t, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(k), pa.array(sums[t, k])], ["t", "k", "n"])

    if not len(keys):
        return keys
    found = arrow_map(rows.select("text", "toxic"), count, "t long, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((2, len(keys) + 1))
    for r in found:
        sums[r["t"], r["k"]] = r["n"]
    return keys[_set_apart(sums[1, :-1], sums[0, :-1], sums[1, -1], sums[0, -1])]


def _table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    data, off, _ = _text.buffers(pa.array(texts, pa.string()))
    parts, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in _text.blocks(off):
        f, _, d = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
        parts.append(f)
        first.append(d[1:] + n)
        n += len(f)
    return np.concatenate(parts) if parts else np.zeros((0, 1 + len(_BEGIN)), np.uint64), np.concatenate(first)


def fit(texts: list[str | None], labels: list[int], again: DataFrame | None = None, share: float | None = None) -> Model:
    """A model from labelled documents; ``again`` (text, toxic) holds more on which features must stand; ``share`` of documents are toxic where it matters."""
    toxic = np.array(labels, float)
    features, first = _table(texts)
    keys = _lexicon(features, first, toxic)
    if again is not None:
        keys = recounted(again, keys)
    model = Model(keys, np.zeros(0), -6.0, np.array([0.99, 0.01]), np.array([[0.99, 0.01], [0.5, 0.5]]), np.array([-4.0, 0, 0, 0]))
    model.weight = np.zeros(len(model.keys))
    places = model.places(features)
    none = len(model.keys)
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    y = ((places < none).any(axis=1) & (toxic[doc] > 0)).astype(float)
    if y.any():
        begins = np.zeros(len(y) + 1, bool)
        begins[first] = True
        inner = np.flatnonzero(~begins[1:-1]) + 1
        seen = np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4).reshape(2, 2).astype(float)
        speed, square = np.zeros(none + 1), np.zeros(none + 1)
        log_step, m2 = np.log(model.step), np.zeros((2, 2))
        for k in range(1, _STEPS + 1):
            pairs = np.zeros((2, 2))
            g, rest = np.zeros(none + 1), 0.0
            for a, b in _text.blocks(first, 1 << 18):
                x = places[first[a] : first[b]]
                wrong = y[first[a] : first[b]] - model.tag(x, first[a : b + 1] - first[a], pairs)
                g += np.bincount(x.ravel(), weights=np.repeat(wrong, x.shape[1]), minlength=none + 1)
                rest += wrong.sum()
            g[none] = rest
            g[:none] -= 0.05 * model.weight
            speed, square = 0.8 * speed + 0.2 * g, 0.95 * square + 0.05 * g * g
            move = 0.5 * (speed / (1 - 0.8**k)) / (np.sqrt(square / (1 - 0.95**k)) + 1e-3)
            model.weight += move[:none]
            model.bias += move[none] * 0.5
            d = seen - pairs
            m2 = 0.9 * m2 + 0.1 * d * d
            log_step += 0.15 * d / (np.sqrt(m2 / (1 - 0.9**k)) + 1e-3)
            log_step -= log_step.max(axis=1, keepdims=True)
            model.step = np.exp(np.clip(log_step, -8, 0))
    p = np.concatenate([model.tag(places[first[a] : first[b]], first[a : b + 1] - first[a]) for a, b in _text.blocks(first, 1 << 18)]) if len(toxic) else np.zeros(0)
    z = model.summary(p, first)
    curve = model.curve.copy()
    if len(toxic):
        share = toxic.mean() if share is None else share
        case = np.where(toxic > 0, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
        for _ in range(50):  # Newton steps with a small ridge
            q = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
            h = (z * (case * q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(4)
            step = np.linalg.solve(h, z.T @ (case * (toxic - q)) - 0.1 * curve)
            curve += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
    model.curve = curve
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, recount: int = RECOUNT) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``recount`` documents of each label are read, the least by a hash of the id, and the first ``sample``
    of them come to the driver, whole. An id with several labels is toxic if one of them says so; other labels than 0 and 1
    teach nothing. Without labelled documents the score is a constant.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = []
    for t in (1, 0):
        # of many labels those with great hashes are left out before the order is taken, so that no partition sends its least
        share = 1.3 * recount / max(1, n.get(t, 0))
        part = known.filter(F.col("toxic") == t).withColumn("h", F.xxhash64("doc_id"))
        if share < 1:
            part = part.filter(F.col("h") < int((2 * share - 1) * 2.0**63))
        part = [r["doc_id"] for r in part.orderBy("h", "doc_id").limit(recount).collect()]
        ids += [(d, t, k < sample) for k, d in enumerate(part)]
    spark = docs.sparkSession
    # 2 * recount ids at most: small enough to send to every executor
    chosen = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int, near boolean")), "doc_id")
    own = chosen.filter("near").select("doc_id", "toxic", "text").toArrow().sort_by("doc_id")
    return fit(own.column("text").to_pylist(), own.column("toxic").to_pylist(), chosen.select("text", "toxic"), share=n.get(1, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, score, starts, ends) for every row of ``docs``.

    score: 0 to 1, higher where toxic is likelier; null, empty and wordless texts get the curve's base value.
    starts, ends: byte spans of words whose marginal is ``cut`` or more, neighbours joined. Other columns are
    ignored; repeated rows repeat; an empty table gives no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    ship = source.sparkSession.sparkContext.broadcast(model.__dict__)  # LEXICON features at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**ship.value)
        for b in batches:
            data, off, _ = _text.column(b, "text")
            for i, j in _text.blocks(off):
                own = data[off[i] : off[j]]
                features, at, first = _features(own, off[i : j + 1] - off[i])
                p = model.tag(model.places(features), first)
                hit = np.flatnonzero(p >= cut)
                doc = np.searchsorted(first, hit, side="right") - 1
                new = np.append(True, (np.diff(hit) > 1) | (np.diff(doc) > 0))[: len(hit)]
                starts = hit[new]
                lasts = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
                ends = []
                for w in lasts.tolist():
                    stop = int(at[w + 1]) if w + 1 < len(at) else len(own)
                    stop = min(stop, int(off[i + int(np.searchsorted(first, w, side="right"))] - off[i]))
                    word = own[at[w] : stop]
                    gap = np.flatnonzero(~_text.ALNUM[word])
                    ends.append(int(at[w]) + (int(gap[0]) if len(gap) else len(word)))
                row = doc[new]
                per = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32))
                base = (off[i : j + 1] - off[i])[row]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(model.score(p, first)),
                    pa.ListArray.from_arrays(per, pa.array(at[starts] - base, pa.int64())), pa.ListArray.from_arrays(per, pa.array(np.array(ends, np.int64) - base, pa.int64())),
                ], ["id", "score", "starts", "ends"])

    return arrow_map(source, run, f"id {kind}, score double, starts array<long>, ends array<long>")


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity, learned from labelled documents outside fold 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(fold() != 1)
    model = learn(docs, labels)
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
