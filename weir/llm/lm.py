"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Exact counts of all training words come first. The most frequent words, in number four times the square root of that of the distinct words, and the end, are
outputs of their own; every other word belongs to one of 256 classes by its ending. The model
predicts the next output from the last two, ``r = C1 R[w1] + C2 R[w2]``, in two steps: the output's group,
with score ``r . G[g] + a[g]``, and in the group the output, with score ``r . Q[w] + b[w]``. Groups hold outputs of like frequency, and are as many as the square root of the outputs,
so that both sums that normalise a probability are short however large the vocabulary is.

It learns both steps from every training token, against noise from the unigram distributions of groups and of a group's outputs, by rounds
in which each partition trains on its own tokens and the results are averaged. A word's probability is its
output's, normalised by batched matrix products, times its smoothed share of its class.

Tokens are stored once, as blocks of whole documents with a local vocabulary; what the
corpus says of a block's words goes back to the block by joins on word and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weir.llm import _text
from weir.llm._scratch import Scratch, arrow_map
from weir.llm.langid import fold

#: Words with an output of their own, for each of the square root of the distinct words; classes for the others.
HEAD, CLASSES = 4, 256
DIM = 32
#: Columns of a vector with its bias.
_WIDE = DIM + 8
#: How often a corpus of any size is gone through; more rounds over a small one only learn it by heart.
ROUNDS = 2
#: Training tokens in one step (at least four for each output), group noise drawn for all of it, and how many draws of a group's noise each token counts.
STEP, NOISE, INNER = 32768, 16, 16
RATE = 0.1
#: Counts of words are told apart by sixteenths of an octave where the outputs are cut.
_OCTAVE = 16
_BLOCK = 4 << 20
#: Weights that go to one task to be averaged.
_CHUNK = 1 << 14
#: Tokens that are scored at once.
_AT_ONCE = 1 << 17
_END = np.uint64(0x454E44)
_SMOOTH = 0.1


def _ends(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Last byte of each word."""
    on = _text.NOT_BLANK[data]
    last = on.copy()
    last[:-1] &= ~on[1:]
    stop = off[1:][off[1:] > 0] - 1
    last[stop] = on[stop]
    return np.flatnonzero(last)


def _classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of each word, from its last two bytes and whether it is long."""
    low = _text._LOWER
    one = low[data[end]].astype(np.int64)
    two = np.where(end > start, low[data[np.maximum(end - 1, 0)]], 0).astype(np.int64)
    return (one * 31 + two * 131 + (end - start >= 7) * 17) % CLASSES


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _blocks_of(kind: T.DataType):
    """(id, text, train) to blocks: number, ids, train, first, codes, vocab, classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            data, off, _ = _text.column(b, "text")
            train = np.asarray(b.column(2).cast(pa.uint8()).to_numpy(zero_copy_only=False))
            for i, j in _text.blocks(off, _BLOCK):
                own, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                h, start, first = _text.words(own, o)
                cls = _classes(own, start, _ends(own, o)) if len(h) else np.zeros(0, np.int64)
                # one end after each document's words
                tokens = np.insert(h, first[1:], _END)
                classes = np.insert(cls, first[1:], 0)
                first = first + np.arange(len(first))
                vocab, at, codes = np.unique(tokens, return_index=True, return_inverse=True)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                parts = [train[i:j].tobytes(), first.astype(np.int64).tobytes(), _pack(codes.astype(np.uint32)), vocab.tobytes(), classes[at].astype(np.uint8).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, *(_text.binary([p]) for p in parts)], ["block", "ids", "train", "first", "codes", "vocab", "classes"])
                number += 1

    return run


def _trained(train: bytes, first: np.ndarray) -> np.ndarray:
    """Does each token belong to a training document?"""
    return np.repeat(np.frombuffer(train, np.uint8), np.diff(first)) > 0


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's words; ``local`` packs a word's count in the block's training documents, its place in the block (28 bits) and its class (8)."""
    for b in batches:
        for number, train, first, codes, vocab, classes in zip(*(c.to_pylist() for c in b.columns)):
            vocab = np.frombuffer(vocab, np.int64)
            first = np.frombuffer(first, np.int64)
            n = np.bincount(_unpack(codes, np.uint32)[_trained(train, first)], minlength=len(vocab))
            yield pa.RecordBatch.from_arrays([pa.array(vocab), pa.array(np.full(len(vocab), number)), pa.array((n << 36) + (np.arange(len(vocab)) << 8) + np.frombuffer(classes, np.uint8))], ["word", "block", "local"])


class Outputs:
    """The outputs in order of frequency: which words and classes they are, how frequent, and where each group begins."""

    def __init__(self, head: np.ndarray, head_n: np.ndarray, class_n: np.ndarray):
        """``head``: hashes of words with an output of their own."""
        by = np.argsort(head)
        self.head = head[by]
        n = np.concatenate([head_n[by], class_n]) + 0.5
        order = np.argsort(-n, kind="stable")
        self.share = (n / n.sum())[order]
        slot = np.empty(len(n), np.int64)
        slot[order] = np.arange(len(n))
        self.head_slot, self.class_slot = slot[: len(head)], slot[len(head) :]
        self.class_of = np.full(len(n), -1)
        self.class_of[self.class_slot] = np.arange(len(class_n))
        mass = np.cumsum(np.sqrt(self.share))
        group = np.minimum((mass / mass[-1] * np.ceil(np.sqrt(len(n)))).astype(np.int64), int(np.sqrt(len(n))))
        self.group = np.unique(group, return_inverse=True)[1]
        self.start = np.append(np.flatnonzero(np.diff(self.group, prepend=-1)), len(n))
        self.group_share = np.add.reduceat(self.share, self.start[:-1])
        self.inner = self.share / self.group_share[self.group]
        self.size = (len(n), len(self.group_share))

    def slots(self, vocab: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The output of each word."""
        at = np.minimum(np.searchsorted(self.head, vocab), max(len(self.head) - 1, 0))
        known = self.head[at] == vocab if len(self.head) else np.zeros(len(vocab), bool)
        return np.where(known, self.head_slot[at] if len(self.head) else 0, self.class_slot[classes])


class Weights:
    """R, C1, C2, Q, b, G and a as views of one vector."""

    def __init__(self, flat: np.ndarray, size: tuple[int, int]):
        self.flat, self.size, at = flat, size, 0
        for name, shape in self.shapes(size).items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(size: tuple[int, int]) -> dict:
        slots, groups = size
        return {"r": (slots + 1, DIM), "c1": (DIM, DIM), "c2": (DIM, DIM), "q": (slots, DIM), "b": (slots,), "g": (groups, DIM), "a": (groups,)}

    @classmethod
    def start(cls, outputs: Outputs) -> "Weights":
        rng = np.random.default_rng(5)
        n = sum(int(np.prod(s)) for s in cls.shapes(outputs.size).values())
        w = cls((0.1 * rng.standard_normal(n)).astype(np.float32), outputs.size)
        w.c1[:] = np.eye(DIM)
        w.c2[:] = 0.5 * np.eye(DIM)
        w.b[:], w.a[:] = np.log(outputs.inner), np.log(outputs.group_share)
        return w

    def hidden(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        out = (self.r @ self.c1).take(c1, axis=0)
        out += (self.r @ self.c2).take(c2, axis=0)
        return out


def _contexts(slots: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two before each token; ``none`` before a document's start."""
    one, two = np.full(len(slots), none), np.full(len(slots), none)
    one[1:], two[2:] = slots[:-1], slots[:-2]
    begin = first[:-1][np.diff(first) > 0]
    one[begin] = two[begin] = none
    after = begin + 1
    two[after[after < len(slots)]] = none
    return one, two


def _order(key: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(key.astype(np.uint16) if n <= 1 << 16 else key, kind="stable")


def _gather(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    order = _order(index, n)
    key = index[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[key[at]] = np.add.reduceat(rows.take(order, axis=0), at, axis=0)
    return out


def _against(x: np.ndarray) -> np.ndarray:
    """1 + exp(x), in place: the logistic function's reciprocal where ``x`` is its argument's opposite. Beyond the range of floats it is infinite, as the function is 0 there."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return x


def _opposite(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Minus vectors and bias, side by side."""
    out = np.zeros((len(vectors), _WIDE), np.float32)
    np.negative(vectors, out=out[:, :DIM])
    np.negative(bias, out=out[:, DIM])
    return out


class Trainer:
    """Adagrad steps of noise-contrastive estimation.

    A token's group stands against drawn groups, the same for a whole step. Its output stands against ``INNER`` noise outputs of
    the group, whose part in the gradient is taken in expectation over the group, which a product of matrices gives.
    """

    def __init__(self, flat: np.ndarray, outputs: Outputs, rate: float, seed: int):
        self.o, self.w = outputs, Weights(flat.copy(), outputs.size)
        self.sum = np.full(len(flat), 1e-5, np.float32)
        self.noise = np.log(NOISE * outputs.group_share).astype(np.float32)
        self.inner, self.weight = np.log(INNER * outputs.inner).astype(np.float32), (INNER * outputs.inner).astype(np.float32)
        self.draw, self.step = np.cumsum(outputs.group_share), max(STEP, 4 * outputs.size[0])
        self.rate, self.rng, self.tokens = rate, np.random.default_rng(seed), 0

    def learn(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        w, o, n = self.w, self.o, len(target)
        by = _order(o.group[target], o.size[1])
        one, two, target = one[by], two[by], target[by]
        group = o.group[target]
        noise = np.minimum(np.searchsorted(self.draw, self.rng.random(NOISE) * self.draw[-1]), o.size[1] - 1)
        # a column of ones beside the vectors takes the biases along; the rest keeps rows in step with the processor's
        vectors = np.zeros((n, _WIDE), np.float32)
        vectors[:, DIM] = 1
        h = vectors[:, :DIM]
        np.add((w.r @ w.c1).take(one, axis=0), (w.r @ w.c2).take(two, axis=0), out=h)
        grad = Weights(np.zeros_like(w.flat), o.size)
        # of the noise: how wrong is the guess where it came from
        less = _opposite(w.g, w.a - self.noise)
        wrong = np.reciprocal(_against(vectors @ less[noise].T))
        dh = wrong @ -w.g[noise]
        back = wrong.T @ vectors
        np.subtract.at(grad.g, noise, back[:, :DIM])
        np.subtract.at(grad.a, noise, back[:, DIM])
        miss = 1 - 1 / _against(np.einsum("ij,ij->i", vectors, less.take(group, axis=0)))
        dh += miss[:, None] * w.g.take(group, axis=0)
        less, weight = _opposite(w.q, w.b - self.inner), -self.weight
        first = np.flatnonzero(np.diff(group, prepend=-1))
        for s, e, g in zip(first.tolist(), [*first[1:].tolist(), n], group[first].tolist()):
            own, low, high = vectors[s:e], int(o.start[g]), int(o.start[g + 1])
            back = miss[s:e] @ own
            grad.g[g] += back[:DIM]
            grad.a[g] += back[DIM]
            if high - low > 1:  # the same in a group that has a choice
                x = _against(own @ less[low:high].T)
                rows, at = np.arange(e - s), target[s:e] - low
                short = 1 - 1 / x[rows, at]
                np.divide(weight[low:high], x, out=x)
                x[rows, at] += short
                dh[s:e] += x @ w.q[low:high]
                back = x.T @ own
                grad.q[low:high], grad.b[low:high] = back[:, :DIM], back[:, DIM]
        for index, c, dc in ((one, w.c1, grad.c1), (two, w.c2, grad.c2)):
            came = _gather(index, dh, o.size[0] + 1)
            dc[:] = w.r.T @ came
            grad.r += came @ c.T
        g = grad.flat
        g *= np.float32(10 / n)
        self.sum += g * g
        g /= np.sqrt(self.sum)
        g *= np.float32(self.rate)
        w.flat += g
        self.tokens += n


def _train(flat: np.ndarray, outputs: Outputs, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(flat, outputs, rate, TaskContext.get().partitionId())
        for b in batches:
            for train, first, codes, vocab, classes in zip(*(c.to_pylist() for c in b.columns)):
                first = np.frombuffer(first, np.int64)
                slots = outputs.slots(np.frombuffer(vocab, np.uint64), np.frombuffer(classes, np.uint8).astype(np.int64))[_unpack(codes, np.uint32)]
                one, two = _contexts(slots, first, outputs.size[0])
                rows = np.flatnonzero(_trained(train, first))
                rows = trainer.rng.permutation(rows)
                for k in range(0, len(rows), trainer.step):
                    own = rows[k : k + trainer.step]
                    trainer.learn(one[own], two[own], slots[own])
        if trainer.tokens:
            for k in range(0, len(flat), _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([k]), _text.binary([trainer.w.flat[k : k + _CHUNK].tobytes()]), pa.array([trainer.tokens])], ["at", "value", "tokens"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of partitions to their mean by training tokens; each ``at`` is in one task."""
    sums: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for b in batches:
        for at, value, n in zip(*(c.to_pylist() for c in b.columns)):
            sums[at] = sums.get(at, 0.0) + np.frombuffer(value, np.float32).astype(np.float64) * n
            tokens[at] = tokens.get(at, 0) + n
    for at, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([at]), _text.binary([(x / tokens[at]).astype(np.float32).tobytes()])], ["at", "value"])


class Model:
    """All that scoring needs; it grows with the square root of the vocabulary."""

    def __init__(self, flat, outputs, n, v, class_n, class_v):
        self.flat, self.outputs, self.n, self.v, self.class_n, self.class_v = flat, outputs, n, v, class_n, class_v

    def log10(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token's output."""
        one, two = _contexts(slots, first, self.outputs.size[0])
        out = np.empty(len(slots))
        for k in range(0, len(slots), _AT_ONCE):
            own = slice(k, k + _AT_ONCE)
            out[own] = self._natural(one[own], two[own], slots[own])
        return out / np.log(10)

    def _natural(self, one: np.ndarray, two: np.ndarray, slots: np.ndarray) -> np.ndarray:
        o, w = self.outputs, Weights(self.flat, self.outputs.size)
        pair, at = np.unique(one * (o.size[0] + 1) + two, return_inverse=True)
        h = w.hidden(pair // (o.size[0] + 1), pair % (o.size[0] + 1))
        group = o.group[slots]
        norm, step = np.empty(len(pair), np.float32), max(1, (1 << 21) // o.size[1])
        for k in range(0, len(pair), step):
            x = h[k : k + step] @ w.g.T
            x += w.a
            norm[k : k + step] = _log_sum(x)
        out = w.a[group] - norm[at]
        by = _order(group, o.size[1])
        cuts = np.searchsorted(group[by], np.arange(o.size[1] + 1))
        for g in np.unique(group).tolist():
            low, high = int(o.start[g]), int(o.start[g + 1])
            step = max(1, (1 << 21) // (high - low))
            for k in range(int(cuts[g]), int(cuts[g + 1]), step):
                own = by[k : min(k + step, int(cuts[g + 1]))]
                vectors = h.take(at[own], axis=0)
                out[own] += vectors @ w.g[g]
                if high - low > 1:
                    x = vectors @ w.q[low:high].T
                    x += w.b[low:high]
                    out[own] += x[np.arange(len(own)), slots[own] - low]
                    out[own] -= _log_sum(x)
        return out

    def share(self, slots: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of each word's part of its output."""
        k = self.outputs.class_of[slots]
        part = np.log10((count + _SMOOTH) / (self.class_n[k] + _SMOOTH * (self.class_v[k] + 1)))
        return np.where(k < 0, 0.0, part)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials; ``x`` is used up."""
    top = np.zeros(len(x), x.dtype)
    if not (x.max() < 60 and x.min() > -60):  # else no power leaves the range of floats
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return top + np.log(x @ np.ones(x.shape[1], x.dtype))


def _score(spec: dict, kind: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**spec)
        for b in batches:
            for r in range(b.num_rows):
                train, first, codes, vocab, classes = (b.column(k)[r].as_py() for k in range(1, 6))
                first = np.frombuffer(first, np.int64)
                codes = _unpack(codes, np.uint32).astype(np.int64)
                vocab = np.frombuffer(vocab, np.uint64)
                count = np.bincount(codes[_trained(train, first)], minlength=len(vocab))
                # what the corpus has beyond this block
                more = b.column(6)[r].values
                if more is not None and len(more):
                    count[np.asarray(more.field("at"))] = np.asarray(more.field("n"))
                slots = model.outputs.slots(vocab, np.frombuffer(classes, np.uint8).astype(np.int64))
                base = np.log10((count + _SMOOTH) / (model.n + _SMOOTH * (model.v + 1)))
                value = model.log10(slots[codes], first) + model.share(slots, count)[codes]
                known = (count > 0)[codes]
                at = first[:-1]  # each document has its end at least
                size = np.diff(first)
                sums = [np.add.reduceat(x, at) if len(at) else np.zeros(0) for x in (known.astype(np.int64), base[codes], value)]
                yield pa.RecordBatch.from_arrays([b.column(0)[r].values, pa.array(size, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(np.full(len(size), model.n), pa.int64()), pa.array(sums[1]), pa.array(sums[2])], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train``: a condition on ``docs``; the model learns from the rows where it holds, in ``rounds``. Words: A-Z lower-cased, parted by space and
    09-0D, then an end. base_score: log10 of the smoothed unigram probability; score: log10 of the model's.
    A null or empty text is its end alone. Rows repeat as they do in ``docs``; other columns are ignored; without training rows
    all words are unknown; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = source.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(x, T.BinaryType()) for x in ("train", "first", "codes", "vocab", "classes"))])
    blocks = scratch.write(arrow_map(source, _blocks_of(kind), schema), "blocks")

    # one exchange by word: each of a block's words learns its count in all of the corpus
    words = arrow_map(blocks.select("block", "train", "first", "codes", "vocab", "classes"), _local_counts, "word long, block long, local long")
    all_ = Window.partitionBy("word")
    own = F.shiftright("local", 36)
    words = words.select("word", "block", F.shiftright("local", 8).bitwiseAND((1 << 28) - 1).cast("int").alias("at"), own.alias("own"), F.col("local").bitwiseAND(255).alias("class"), F.sum(own).over(all_).alias("n"), F.min("block").over(all_).alias("least"))
    one = F.col("block") == F.col("least")  # a word stands once in a block
    kept = words.filter((F.col("n") > 0) & (one | (F.col("n") != F.col("own"))))
    counts = scratch.write(kept.select(F.when(one, F.col("word")).alias("word"), "block", "at", "class", "n", (F.col("n") != F.col("own")).alias("more")), "counts")
    distinct = counts.filter("word is not null").withColumn("level", F.floor(_OCTAVE * F.log2("n")).cast("int"))
    end = int(_END)
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # whole levels of counts, so that the driver gets no more words than it keeps
    cut, room = -1, HEAD * math.isqrt(total["v"])
    for r in distinct.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if r["n"] > room:
            cut = r["level"]
            break
        room -= r["n"]
    own = (F.col("level") > cut) | (F.col("word") == end)
    head = distinct.filter(own).select("word", "n").toArrow().sort_by("word")
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in distinct.filter(~own).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    outputs = Outputs(head.column("word").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy().astype(np.float64), class_n)

    flat = Weights.start(outputs).flat
    for k in range(rounds if total["n"] else 0):
        trained = arrow_map(blocks.select("train", "first", "codes", "vocab", "classes"), _train(flat, outputs, RATE / (k + 1) ** 0.5), "at long, value binary, tokens long")
        mean = arrow_map(trained.repartition("at"), _mean, "at long, value binary").toArrow().sort_by("at")
        flat = np.frombuffer(b"".join(mean.column("value").to_pylist()), np.float32)

    spec = {"flat": flat, "outputs": outputs, "n": total["n"], "v": total["v"], "class_n": class_n, "class_v": class_v}
    beyond = counts.filter("more").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("more"))
    rows = blocks.select("block", "ids", "train", "first", "codes", "vocab", "classes").join(beyond, "block", "left").drop("block")
    fields = [("id", kind), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return arrow_map(rows, _score(spec, kind), T.StructType([T.StructField(a, t) for a, t in fields]))


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' log probabilities under a model of those outside fold 0 of ten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fold(n=10) != 0)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
