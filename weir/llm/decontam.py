"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each stored row holds the postings of about a
megabyte of whole texts, every token of them: sorted term hashes, and for each
term the ascending word positions. Phrases are looked up in every block by
themselves, so no posting is shuffled and a frequent word is nobody's hot key.
A phrase whose terms aren't all in a block costs one lookup each; else its lists
are intersected from the rarest term on, shifted by the terms' offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm import _text
from weir.llm._scratch import Scratch, arrow_map

WINDOW = 13
#: Benchmark text that goes to the executors at once; a larger table goes in several turns.
TURN_BYTES = 8 << 20


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Write and return the index of ``docs`` (id, text): a row for each block of documents, with the number ``block`` that it keeps once written."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(kind)), T.StructField("first", T.BinaryType()), T.StructField("terms", T.BinaryType()),
        T.StructField("ends", T.BinaryType()), T.StructField("positions", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = _text.column(b, "text")
            for i, j in _text.blocks(off):
                h, _, first = _text.words(data[off[i] : off[j]], off[i : j + 1] - off[i], _text.ALNUM)
                order = np.argsort(h, kind="stable")
                ranked = h[order]
                at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(h) else np.zeros(0, np.int64)
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                parts = [first.astype(np.int64), ranked[at], np.append(at, len(h)).astype(np.int32), order.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([ids, *(_text.binary([p.tobytes()]) for p in parts)], ["ids", "first", "terms", "ends", "positions"])

    blocks = arrow_map(docs.select("id", "text"), run, schema)
    return scratch.write(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "index")


class Block:
    """One block of the index in a worker."""

    def __init__(self, first: bytes, terms: bytes, ends: bytes, positions: bytes):
        self.first, self.terms = np.frombuffer(first, np.int64), np.frombuffer(terms, np.uint64)
        self.ends, self.positions = np.frombuffer(ends, np.int32), np.frombuffer(positions, np.int32)

    def sizes(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the block's terms, length of the posting list, 0 where it has none)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.ends[at + 1] - self.ends[at], 0)

    def list_(self, at: int) -> np.ndarray:
        return self.positions[self.ends[at] : self.ends[at + 1]]

    def phrase(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """First positions of a phrase whose k-th term is at place ``at[k]``, within one document."""
        n = len(at)
        start = None
        for k in np.argsort(size, kind="stable"):
            own = self.list_(at[k])
            if start is None:
                start = own - np.int32(k)
                continue
            want = start + np.int32(k)
            found = np.minimum(np.searchsorted(own, want), len(own) - 1)
            start = start[own[found] == want]
            if not len(start):
                return start
        return self._inside(start, start + n - 1)[0]

    def near(self, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) of the least stretches of at most ``width`` words of one document that hold all terms, around each place of the rarest term."""
        at, index = np.unique(at, return_index=True)
        rare = int(np.argmin(size[index]))
        lists = [self.list_(a) for a in at]
        firsts, lasts = [], []
        for p in lists[rare]:
            best = None
            for low in range(p - width + 1, p + 1):
                top = p
                for own in lists:
                    k = np.searchsorted(own, low)
                    if k == len(own):
                        top = None
                        break
                    top = max(top, int(own[k]))
                if top is not None and top - low < width and (best is None or top - low <= best[1] - best[0]):
                    best = (low, top)
            if best:
                firsts.append(best[0])
                lasts.append(best[1])
        return self._inside(np.array(firsts, np.int64), np.array(lasts, np.int64))

    def _inside(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (first >= 0) & (last < self.first[-1])
        first, last = first[ok], last[ok]
        same = self.document(first) == self.document(last)
        return first[same], last[same]

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _turns(items: DataFrame, turn_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's rows, some megabytes at a time."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        rows.append((r["item"], r["text"] or ""))
        size += len(rows[-1][1])
        if size >= turn_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _windows(rows: list[tuple[str | None, str]], window: int) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """By length: distinct windows (a row of hashes each) and the items that hold them."""
    raw = [t.encode() for _, t in rows]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    h, _, first = _text.words(np.frombuffer(b"".join(raw), np.uint8), off, _text.ALNUM)
    by: dict[int, dict[bytes, set[int]]] = {}
    for k in range(len(rows)):
        own = h[first[k] : first[k + 1]]
        n = min(window, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            by.setdefault(n, {}).setdefault(own[s : s + n].tobytes(), set()).add(k)
    return {n: (np.frombuffer(b"".join(w), np.uint64).reshape(-1, n), [sorted(x) for x in w.values()]) for n, w in by.items()}


def find(index: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, within: int | None = None, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """(block, k, id, n_words, starts, lengths, items), a row for every document of ``index``; ``items`` has (item, text).

    starts, lengths: word runs that match a window of ``window`` consecutive item words
    (an item of fewer, but not none, is one window). With ``within``, a match is a stretch
    of at most that many words that holds all the window's terms in any order.
    ``block`` and ``k`` name the document's row in the index. A benchmark of over ``turn_bytes`` takes turns: the matches of one are written before
    the next is read, so the driver holds one turn's windows, and meet by document at the end.
    """
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    look = lambda rows: arrow_map(index, _lookup(_windows(rows, window), [item for item, _ in rows], within, schema), schema)
    turns = _turns(items, turn_bytes)
    rows, following = next(turns, []), next(turns, None)
    if following is None:
        return look(rows)
    found = None
    while rows:
        hits = scratch.write(look(rows).filter(F.size("starts") > 0), "hits")
        found = hits if found is None else found.union(hits)
        rows, following = following or [], next(turns, None)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.groupBy("block", "k").agg(flat("starts"), flat("lengths"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = lambda c: F.coalesce(F.col(f"h.{c}"), F.col(f"a.{c}")).alias(c)
    return look([]).alias("a").join(found.alias("h"), ["block", "k"], "left").select("block", "k", "id", "n_words", *[none(c) for c in ("starts", "lengths", "items")])


def _lookup(windows, names, within, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {n: (*np.unique(w, return_inverse=True), owners) for n, (w, owners) in windows.items()}
        for b in batches:
            for r in range(b.num_rows):
                first, terms, ends, positions = (b.column(k)[r].as_py() for k in range(2, 6))
                block = Block(first, terms, ends, positions)
                n_docs = len(block.first) - 1
                runs: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
                hit: list[set] = [set() for _ in range(n_docs)]
                for n, (unique, inverse, owners) in asked.items():
                    at, size = block.sizes(unique)
                    inverse = inverse.reshape(-1, n)
                    sizes = size[inverse]
                    for w in np.flatnonzero(sizes.min(axis=1) > 0):
                        if within is None:
                            start = block.phrase(at[inverse[w]], sizes[w])
                            last = start + n - 1
                        else:
                            start, last = block.near(at[inverse[w]], sizes[w], within)
                        for d, s, e in zip(block.document(start).tolist(), start.tolist(), last.tolist()):
                            runs[d].append((s - int(block.first[d]), e - s + 1))
                            hit[d].update(names[o] for o in owners[w])
                flat = [sorted(set(x)) for x in runs]
                ids = b.column(1)[r].values
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column(0)[r].as_py()] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), ids, pa.array(np.diff(block.first), pa.int64()),
                    pa.array([[s for s, _ in x] for x in flat], pa.list_(pa.int32())), pa.array([[e for _, e in x] for x in flat], pa.list_(pa.int32())),
                    pa.array([sorted(x - {None}) for x in hit], pa.list_(pa.string())),
                ], [f.name for f in schema.fields])

    return run


def _sum_up(kind: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, shas, counts = [], [], []
            for starts, lengths, items in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                n, end = 0, 0
                for s, e in sorted((s, s + n) for s, n in zip(starts, lengths)):
                    n += max(0, e - max(s, end))
                    end = max(end, e)
                hits.append(n)
                counts.append(len(items))
                shas.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string())], ["id", "n_words", "n_hit", "n_items", "items_sha256"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, turn_bytes: int = TURN_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Words: runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased. A document is
    contaminated if a twentieth of its words, and one at least, lie in matched windows. Null and
    empty texts have no words; an item without an id counts for hits and isn't named; items that share
    an id are one. An empty benchmark leaves all clean; an empty ``docs`` gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    found = find(build_index(source, scratch), items, scratch, window, turn_bytes=turn_bytes)
    kind = source.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())])
    out = arrow_map(found.select("id", "n_words", "starts", "lengths", "items"), _sum_up(kind), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


#: The rows of op3_positional_index in DuckDB. Every window of an item is held against all stretches of as many words of all documents.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS x FROM i),
p AS (SELECT r, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s, w FROM d, (SELECT DISTINCT n FROM v) AS l WHERE len(w) >= n),
h AS (SELECT r, p.n, s, item FROM (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS x FROM p) AS p JOIN v ON p.n = v.n AND p.x = v.x),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by 13-word windows."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).withColumnRenamed("id", "doc_id")
