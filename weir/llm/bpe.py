"""Exact BPE encoding and decoding over a minimal acyclic transducer lexicon.

The corpus's most frequent words are encoded once and compiled into a minimal
acyclic automaton over UTF-8 bytes: equal suffixes share states, each edge carries
the number of words that sort before it, and so a walk adds up to the word's number,
which points at its ids. The automaton is a flat file that every worker of a machine
memory-maps. Words that it lacks are merged exactly, by rank. What is in the
lexicon changes the speed only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import _text
from weir.llm._memory import per_task, trim
from weir.llm._scratch import Scratch, arrow_map

#: Most words in the lexicon.
LEXICON = 1 << 15
_BLOCK = 1 << 20
#: Distinct words that a task counts before it sends them on.
_HELD = 50_000
#: Counts of words are told apart by sixteenths of an octave where the lexicon is cut.
_OCTAVE = 16
#: Characters below this take the fast path when they are composed already.
_PLAIN = 0x250


def _classes() -> tuple[str, str]:
    letters, numbers = "", ""
    for c in map(chr, range(_PLAIN)):
        kind = unicodedata.category(c)[0]
        if kind == "L":
            letters += c
        elif kind == "N":
            numbers += c
    return letters, numbers


def _white() -> str:
    # the White_Space characters below _PLAIN
    return "\t\n\x0b\x0c\r \x85\xa0"


_L, _N = _classes()
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_white()}{_L}{_N}]+")
_NONE, _PAIR = 1 << 40, 1 << 32
_ODD = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")


class Vocabulary:
    """A word-level BPE vocabulary file: ids, merge ranks, special strings, byte characters."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        # all that texts beyond the fast path need of the library; its own vocabulary takes tens of MB
        self.rest = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None, "truncation": None, "padding": None})
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # of a pair that stands twice the first counts
        both = np.array([self.ids[a] * _PAIR + self.ids[b] for a, b in pairs] or [-1], np.int64)
        self.pairs, self.order = np.unique(both, return_index=True)
        self.made = np.array([self.ids[a + b] for a, b in pairs] or [0], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first = min((s[:2] for s in self.special), default="")
        chars = _byte_characters()
        self.inner = np.array([self.ids[c] for c in chars], np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in chars], np.int64)
        self._parts = self._ranks_of = None

    def parts(self):
        """The file's own normalizer and pre-tokenizer, for texts beyond the fast path."""
        if self._parts is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(self.rest)
            back = {c: b for b, c in enumerate(_byte_characters())}
            self._parts = (t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str, back)
        return self._parts

    def pieces(self, text: str) -> list[str]:
        """The words of a text that has no special strings."""
        if _ODD.search(text) is None and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return _SPLIT.findall(text.lower())
        normal, split, back = self.parts()
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in split(normal(text))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, by merges in order of rank: (ids one after the other, where each word's begin and the end)."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short = size < 64
        ids, ends = self._short([r for r in raw if len(r) < 64])
        if short.all():
            return ids, ends
        parts, k = [], 0
        for r in raw:
            if len(r) < 64:
                parts.append(ids[ends[k] : ends[k + 1]])
                k += 1
            else:
                parts.append(np.array(self._long([self.inner[b] for b in r[:-1]] + [self.last[r[-1]]]), np.int64))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once: each round merges every word's best pair wherever it stands."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, word = self.inner[data], np.repeat(np.arange(len(raw)), size)
        if len(ids):
            at = np.cumsum(size)[size > 0] - 1
            ids[at] = self.last[data[at]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            found = self._ranks(ids[:-1], ids[1:])
            rank = np.append(np.where(word[:-1] == word[1:], found, _NONE), _NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            over = best == _NONE
            done.append((word[over], ids[over]))
            at = np.flatnonzero((rank == best) & ~over)
            # of a run of one symbol every other pair is merged, from the left
            run = np.append(False, np.diff(at) == 1)
            if run.any():
                start = np.flatnonzero(~run)
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            left = ~over
            left[at + 1] = False
            ids, word = ids[left], word[left]
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        # a word's ids are all of one round, in order
        return ids[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(raw)))])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * _PAIR + b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.order[at], _NONE)

    def _rank(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, id made) of each pair, for words that are merged one by one."""
        if self._ranks_of is None:
            self._ranks_of = {(int(p) >> 32, int(p) & (_PAIR - 1)): (int(k), int(self.made[k])) for p, k in zip(self.pairs, self.order)}
        return self._ranks_of

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self._rank()
        heap = [(*rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, new, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else -1
            if j < 0 or rank.get((ids[k], ids[j])) != (r, new):
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if found := rank.get((new, ids[after[k]])):
                    heapq.heappush(heap, (*found, k))
            if before[k] >= 0 and (found := rank.get((ids[before[k]], new))):
                heapq.heappush(heap, (*found, before[k]))
        return [x for x in ids if x >= 0]


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, k = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + k)
            k += 1
    return [out[b] for b in range(256)]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Flat bytes of the minimal automaton of ``entries`` (non-empty words) with their ids."""
    order = sorted(entries)
    registry: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[tuple[bool, dict[int, int | None]]] = [(False, {})]
    previous = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges.items()))
            if key not in registry:
                registry[key] = len(frozen)
                frozen.append((final, [*edges.items()]))
            path[-1][1][previous[len(path) - 1]] = registry[key]

    for word in order:
        shared = len(os.path.commonprefix([previous, word]))
        freeze(shared)
        previous = word
        for c in word[shared:]:
            path[-1][1][c] = None
            path.append((False, {}))
        path[-1] = (True, path[-1][1])
    freeze(0)
    frozen.append((path[0][0], [*path[0][1].items()]))
    count = [0] * len(frozen)
    keys, target, skip = [], [], []
    for s, (final, edges) in enumerate(frozen):  # an edge leads to an earlier state
        below = int(final)
        for c, t in sorted(edges):
            keys.append(s * 256 + c)
            target.append(t)
            skip.append(below)
            below += count[t]
        count[s] = below
    ids = [entries[w] for w in order]
    arrays = [
        np.array(keys, np.int64), np.array(target, np.int64), np.array(skip, np.int64), np.array([f for f, _ in frozen], np.int64),
        np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([x for i in ids for x in i], np.int64),
    ]
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


class Lexicon:
    """A memory-mapped automaton; ``numbers`` walks many words at once."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.int64, "r")
        parts, at = [], 6
        for n in raw[:6]:
            parts.append(raw[at : at + int(n)])
            at += int(n)
        self.keys, self.target, self.skip, self.final, self.ends, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        n = len(words)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        state = np.full(n, len(self.final) - 1, np.int64)
        total = np.zeros(n, np.int64)
        live = np.flatnonzero(size > 0)
        depth = 0
        total[size == 0] = -1
        while len(live) and len(self.keys):
            want = state[live] * 256 + data[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            total[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            total[live] += self.skip[at]
            depth += 1
            done = size[live] == depth
            ended = live[done]
            total[ended[self.final[state[ended]] == 0]] = -1
            live = live[~done]
        if not len(self.keys):
            total[:] = -1
        return total

    def of(self, number: int) -> np.ndarray:
        return self.ids[self.ends[number] : self.ends[number + 1]]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start[k] .. start[k] + size[k] - 1`` of all k, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@per_task
def _vocabulary(text: str) -> Vocabulary:
    found = Vocabulary(text)
    trim()  # what reading the file took
    return found


@cache
def _mapped(flat: bytes) -> Lexicon:
    """The lexicon's file on this machine, written once and mapped by all its workers."""
    path = os.path.join(tempfile.gettempdir(), f"weir-lexicon-{hashlib.sha256(flat).hexdigest()[:24]}")
    if not os.path.exists(path):
        fd, part = tempfile.mkstemp(dir=tempfile.gettempdir())
        with os.fdopen(fd, "wb") as f:
            f.write(flat)
        os.replace(part, path)
    return Lexicon(path)


def _strings(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column(1)
    _, off, _ = _text.buffers(column)
    for i, j in _text.blocks(off, _BLOCK):
        yield i, j, [t or "" for t in column.slice(i, j - i).to_pylist()]


def frequent_words(docs: DataFrame, vocabulary: str, n: int = LEXICON) -> list[str]:
    """At most ``n`` words that occur most in ``docs`` (id, text), by exact counts: all words of the levels of counts that fit whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = _vocabulary(vocabulary), Counter()
        for b in batches:
            for _, _, texts in _strings(b):
                for t in texts:
                    for part in vocab.cut.split(t)[::2] if vocab.cut and vocab.first in t else (t,):
                        seen.update(vocab.pieces(part))
                if len(seen) > _HELD:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    words = arrow_map(docs, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(_OCTAVE * F.log2("n")).cast("int"))
    words = Scratch(docs.sparkSession, "words").write(words, "words")
    cut, held = -1, 0
    for r in words.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a thousand levels at most
        if held + r["n"] > n:
            cut = r["level"]
            break
        held += r["n"]
    return [bytes(r["word"]) for r in words.filter(F.col("level") > cut).select("word").collect()]


def _counted(seen) -> pa.RecordBatch:
    """Words and counts; words of over 64 characters are no frequent ones."""
    words = [w for w in seen if len(w) <= 64]
    return pa.RecordBatch.from_arrays([_text.binary([w.encode("utf-8", "surrogateescape") for w in words]), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of ``docs``.

    ``vocabulary`` is the text of a tokenizer file whose model is BPE with an end-of-word
    suffix. Ids equal those of its library without added start or end; special
    strings in a text become their ids; ``decoded`` joins the ids' strings by a blank.
    A null or empty text has no ids. Rows repeat as they do in ``docs``; its other
    columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    vocab = _vocabulary(vocabulary)
    words = frequent_words(source, vocabulary, lexicon)
    words = [w for w in words if w]
    ids, ends = vocab.merge([w.decode("utf-8", "surrogateescape") for w in words])
    flat = compile_lexicon({w: ids[a:z].tolist() for w, a, z in zip(words, ends.tolist(), ends[1:].tolist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = _vocabulary(vocabulary), _mapped(flat)
        token = vocab.tokens
        shown = [token[k] for k in range(max(token) + 1)] if len(token) == max(token) + 1 else token

        def table(words: list) -> tuple[np.ndarray, np.ndarray]:
            """Ids of distinct words, one after the other, and where each word's begin and the end; a special string is a tuple."""
            plain = np.array([isinstance(w, str) for w in words], bool)
            text = [w for w in words if isinstance(w, str)]
            number = np.full(len(words), -1, np.int64)
            number[plain] = lex.numbers([w.encode("utf-8", "surrogateescape") for w in text])
            known, new = np.flatnonzero(number >= 0), np.flatnonzero(plain & (number < 0))
            begin, made, made_ends = lex.ends[number[known]], *vocab.merge([words[k] for k in new.tolist()])
            size = np.ones(len(words), np.int64)
            size[known] = lex.ends[number[known] + 1] - begin
            size[new] = np.diff(made_ends)
            ends = np.concatenate([[0], np.cumsum(size)])
            ids = np.zeros(int(ends[-1]), np.int64)
            ids[_spread(ends[known], size[known])] = lex.ids[_spread(begin, size[known])]
            ids[_spread(ends[new], size[new])] = made
            other = np.flatnonzero(~plain)
            ids[ends[other]] = [vocab.special[words[k][0]] for k in other.tolist()]
            return ids, ends

        for b in batches:
            for i, j, texts in _strings(b):
                number: defaultdict = defaultdict()
                number.default_factory = number.__len__  # a new word gets the next number
                code = number.__getitem__
                codes, sizes = [], []
                for t in texts:
                    k = len(codes)
                    for p, part in enumerate(vocab.cut.split(t)) if vocab.cut and vocab.first in t else ((0, t),):
                        if p % 2:  # a special string, told from the word by its type
                            codes.append(code((part,)))
                        else:
                            codes += map(code, vocab.pieces(part))
                    sizes.append(len(codes) - k)
                word_ids, word_ends = table(list(number))
                pieces, at = [shown[x] for x in word_ids.tolist()], word_ends.tolist()
                strings = [" ".join(pieces[a:z]) for a, z in zip(at, at[1:])]
                own = np.array(codes, np.int64)
                length = np.diff(word_ends)[own]
                whole = word_ids[_spread(word_ends[own], length)].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])]
                n_tokens, shas, decoded, shas2, at = np.diff(ends), [], [], [], 0
                for n, a, z in zip(sizes, ends.tolist(), ends[1:].tolist()):
                    shas.append(hashlib.sha256(whole[a:z]).hexdigest())
                    text = " ".join(map(strings.__getitem__, codes[at : at + n]))
                    at += n
                    shas2.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        decoded.append(text)
                columns = [b.column(0).slice(i, j - i), pa.array(n_tokens, pa.int64()), pa.array(shas, pa.string()), pa.array(shas2, pa.string())]
                if keep_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole.astype(np.int32))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)
    return arrow_map(source, run, schema)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer file, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op5_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; counts and digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_vocabulary(), keep_ids=False).withColumnRenamed("id", "doc_id")
