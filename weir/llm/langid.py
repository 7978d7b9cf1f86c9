"""Language identification of spans by Viterbi over word scores.

A word's script leaves the languages written in it; its letter trigrams score
those. The best labelling of a document's words, where each change of language costs
``PENALTY``, gives spans; the language with most letters names the document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import _text
from weir.llm._chains import viterbi
from weir.llm._scratch import arrow_map

PENALTY = 8.0
UNKNOWN = "und"
_BUCKETS = 1 << 16
_SMOOTH = 0.3
#: What a language pays for a word in a script that it isn't written in.
_FOREIGN = 40.0
#: A language is written in a script that has this share of its letters.
_SHARE = 0.002
#: Languages that a model may hold, which bounds it.
MAX_LANGUAGES = 256

# fixed values: first code points of blocks, by script; a script ends where the next entry starts
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"),
    (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in _SCRIPTS})


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter or a mark, its lower case, its script."""
    n = 0x110000
    letter, low = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        kind = unicodedata.category(x)[0]
        if kind in "LM":
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                low[c] = ord(y)
    starts = np.array([s for s, _ in _SCRIPTS])
    script = np.array([SCRIPTS.index(name) for _, name in _SCRIPTS], np.uint8)[np.searchsorted(starts, np.arange(n), side="right") - 1]
    return letter, low, script


def _letters(data: np.ndarray, off: np.ndarray):
    """(trigram bucket of each letter, its place, first letter of each word, first word of each row, script of each word)."""
    letter, low, script = _characters()
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    on = letter[cps] if len(cps) else np.zeros(0, bool)
    at = np.flatnonzero(on)
    if not len(at):
        return np.zeros(0, np.int64), at, np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.zeros(0, np.uint8), rows
    new = np.append(True, np.diff(at) > 1)
    new[np.searchsorted(at, rows[:-1])[np.searchsorted(at, rows[:-1]) < len(at)]] = True
    c = low[cps[at]]
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:] = np.where(new[1:], 0, c[:-1])
    after[:-1] = np.where(new[1:], 0, c[1:])
    h = (c * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    word = np.flatnonzero(new)
    return (h >> np.uint32(16)).astype(np.int64), at, word, np.searchsorted(at[word], rows), script[cps[at[word]]], rows


def learn(rows: DataFrame) -> dict:
    """A model from all of ``rows`` (text, lang): trigram counts and scripts by language. Rows without text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, off, _ = _text.column(b, "text")
            langs = b.column(1).to_pylist()
            for i, j in _text.blocks(off):
                h, _, word, first, script, _ = _letters(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.append(word, len(h))[first]
                for lang in set(langs[i:j]) - {None}:
                    own = sums.setdefault(lang, np.zeros(_BUCKETS + len(SCRIPTS), np.int64))
                    mine = [k for k in range(j - i) if langs[i + k] == lang]
                    if len(h):
                        own[:_BUCKETS] += np.bincount(np.concatenate([h[ends[k] : ends[k + 1]] for k in mine]), minlength=_BUCKETS)
                        own[_BUCKETS:] += np.bincount(np.concatenate([script[first[k] : first[k + 1]] for k in mine]), minlength=len(SCRIPTS))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    sums = arrow_map(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    n_langs = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if n_langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sums.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((len(langs), _BUCKETS + len(SCRIPTS)))
    place = {x: k for k, x in enumerate(langs)}
    table[[place[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams, scripts = table[:, :_BUCKETS], table[:, _BUCKETS:]
    score = np.log((grams + _SMOOTH) / (grams.sum(axis=1, keepdims=True) + _SMOOTH * _BUCKETS))
    if len(langs):
        score -= score.max(axis=0)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    able = share >= _SHARE
    able[:, ~able.any(axis=0)] = True
    return {"langs": langs, "score": score.T.astype(np.float32).copy(), "script": np.where(able, 0, -_FOREIGN).T.astype(np.float32).copy()}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(id, lang, score, starts, ends, langs) for every row of ``docs``.

    ``lang``: the language with most letters, ties by name; ``score``: its share of the letters. ``und`` with
    score 0 where the text is null or has no letter, or the model knows no language. starts, ends, langs: spans in
    characters. Other columns are ignored; repeated rows repeat; an empty table gives no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    langs = np.array([*model["langs"], UNKNOWN], object)
    ship = source.sparkSession.sparkContext.broadcast((model["score"], model["script"]))  # MAX_LANGUAGES columns at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = ship.value
        n_langs = grams.shape[1]
        for b in batches:
            data, off, _ = _text.column(b, "text")
            for i, j in _text.blocks(off):
                h, at, word, first, script, rows = _letters(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = j - i
                if len(word) and n_langs:
                    score = np.stack([np.add.reduceat(grams[:, k][h], word) for k in range(n_langs)], axis=1) + scripts[script]
                    label = viterbi(score.astype(np.float32), first, penalty)
                else:
                    label, first = np.zeros(0, np.int16), np.zeros(n + 1, np.int64)
                    word, at = word[:0], at[:0]
                doc = np.repeat(np.arange(n), np.diff(first))
                ends = np.append(word[1:], len(at))[: len(word)]
                letters = np.bincount(doc * (n_langs + 1) + label, weights=(ends - word).astype(float), minlength=n * (n_langs + 1)).reshape(n, n_langs + 1) if len(word) else np.zeros((n, n_langs + 1))
                best, total = letters.argmax(axis=1), letters.sum(axis=1)
                known = total > 0
                cut = np.flatnonzero(np.append(True, (np.diff(label) != 0) | (np.diff(doc) != 0))) if len(word) else np.zeros(0, np.int64)
                last = np.append(cut[1:], len(word))[: len(cut)] - 1
                per = np.concatenate([[0], np.cumsum(np.bincount(doc[cut], minlength=n))]).astype(np.int32) if len(cut) else np.zeros(n + 1, np.int32)
                start = at[word[cut]] - rows[doc[cut]] if len(cut) else np.zeros(0, np.int64)
                end = at[ends[last] - 1] + 1 - rows[doc[cut]] if len(cut) else np.zeros(0, np.int64)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(per), pa.array(x, t))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, n), pa.array(langs[np.where(known, best, n_langs)], pa.string()), pa.array(np.where(known, letters.max(axis=1) / np.maximum(total, 1), 0.0)),
                    lists(start, pa.int64()), lists(end, pa.int64()), lists(langs[label[cut]] if len(cut) else [], pa.string()),
                ], ["id", "lang", "score", "starts", "ends", "langs"])

    return arrow_map(source, run, f"id {kind}, lang string, score double, starts array<long>, ends array<long>, langs array<string>")


def fold(column: str = "doc_id", n: int = 3):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op8_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from those outside fold 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.filter(fold() != 1))
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
