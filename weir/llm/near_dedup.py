"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Signatures: two fixed random permutations of a universe of 2^20 slots. The first
scatters a document's shingles; the second, circularly shifted by k, gives
coordinate k: ``min over shingles of second[(first[shingle] + k) mod 2^20]``. The K shifted
values of one shingle are K neighbours in memory, so a signature is a running
minimum over rows of a sliding view.

Candidates: documents that agree in one of ``bands`` runs of ``rows`` coordinates.
A pair at the similarity limit is missed with probability (1 - s^rows)^bands,
1.2e-7 at 0.8. Equal sets collapse to a class first. In a bucket, members are
tested against a hub, the member seen in the most company, and again against one drawn by hash; components join what
was confirmed, and links between components that are known already are never kept.

Members of buckets that still hold several components are settled by an exact prefix filter.
Their shingles are ordered with those that no other component has first, then from rare to frequent. Two
similar sets share one among the first ``n - ceil(0.8 n) + 1`` of the larger set and the first ``n - ceil(0.89 n) + 1`` of the
smaller, so documents that share no more than a passage do not meet. Who still meets is compared in blocks of
bounded numbers of shingles, the members outside a shingle's largest component against that component and each other, by
one inverted list for a block; a block gives a spanning forest of its links. Confirmation compares full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm import _text
from weir.llm._memory import per_task
from weir.llm._scratch import Scratch, arrow_map
from weir.llm.components import components

BANDS, ROWS = 40, 5
_SLOTS = 1 << 20
#: Members that share one copy of their hub's text in verification.
_LOT = 64
#: Text bytes that are cut into shingles at once.
_BLOCK = 1 << 19
#: Shingles of a block's queries, and of what is held against them.
_PART, _CHUNK = 1 << 18, 1 << 20


@per_task
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1889)
    first = rng.permutation(_SLOTS).astype(np.int32)
    second = rng.permutation(_SLOTS).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    first, shifted = _permutations(k)
    at = first[(shingles >> np.uint64(44)).astype(np.int64)]
    step = max(1, 400_000 // k)
    low = shifted[at[:step]].min(axis=0)
    for i in range(step, len(at), step):
        np.minimum(low, shifted[at[i : i + step]].min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    rows = len(low) // bands
    key = np.arange(bands, dtype=np.uint64) + np.uint64(bands << 32)
    for part in low.reshape(bands, rows).T.astype(np.uint64):
        key = _text.mix(key * np.uint64(5) + part)
    return key.view(np.int64)


def _sets(width: int):
    """(id, th, text) to (id, th, n, digest, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = _text.column(b, "text")
            for i, j in _text.blocks(off, _BLOCK):
                h, _, first = _text.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                sizes, digests, keys = [], [], []
                for k in range(j - i):
                    s = _text.shingle_set(h[first[k] : first[k + 1]], width)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                own = [b.column(c).slice(i, j - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), _text.binary(digests), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "th", "n", "digest", "bands"])

    return run


def _shingles(width: int):
    """(node, comp, text) to (node, comp, n, hs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off, _ = _text.column(b, "text")
            for i, j in _text.blocks(off, _BLOCK):
                h, _, first = _text.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                sets = [_text.shingle_set(h[first[k] : first[k + 1]], width) for k in range(j - i)]
                sizes = np.array([len(s) for s in sets], np.int64)
                hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes), hs], ["node", "comp", "n", "hs"])

    return run


def _buckets(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, deg) of buckets (key, node, n) with two members or more; deg: in how much company a member is seen."""
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("x"), F.max("node").alias("y")).filter("m > 1 and x <> y").select("key", "m")
    members = scratch.write(keys.join(shared, "key").select("key", "node", "n", "m"), "members")
    out = scratch.write(members.join(members.groupBy("node").agg(F.sum("m").alias("deg")), "node").select("key", "node", "n", "deg"), "buckets")
    scratch.drop(members)
    return out


def _confirm(width: int, percent: int):
    """Rows (hub, lot, kind, id, text) in order: a hub's text (kind 0), then its members' (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for b in batches:
            data, off, _ = _text.column(b, "text")
            hub, kind, id_ = (np.asarray(b.column(k)) for k in (0, 2, 3))
            for i, j in _text.blocks(off, _BLOCK):
                h, _, first = _text.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                a, c = [], []
                for k in range(i, j):
                    s = _text.shingle_set(h[first[k - i] : first[k - i + 1]], width)
                    if kind[k] == 0:
                        at, own = hub[k], s
                    elif hub[k] == at:
                        both = len(np.intersect1d(own, s, assume_unique=True)) if 100 * min(len(own), len(s)) >= percent * max(len(own), len(s)) else 0
                        if 100 * both >= percent * (len(own) + len(s) - both) and both:
                            a.append(at)
                            c.append(id_[k])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (hub, id) of ``pairs`` whose full sets are similar; ``texts`` has (node, text)."""
    lots = pairs.groupBy("hub").agg(F.ceil(F.count("*") / _LOT).cast("int").alias("lots"))
    hubs = lots.select("hub", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    members = pairs.join(lots, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int").alias("lot"), F.lit(1).alias("kind"), F.col("id").alias("node"))
    rows = hubs.union(members).join(texts, "node").select("hub", "lot", "kind", "node", "text")
    rows = rows.repartition(F.col("hub"), F.col("lot")).sortWithinPartitions("hub", "lot", "kind")
    return arrow_map(rows, _confirm(width, percent), "a long, b long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, comp, n) of the shingles at the front of each set (node, comp, n, hs) through which it can meet a similar one of another component."""
    each = sets.select("node", "comp", "n", F.explode("hs").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key", "c")
    own = Window.partitionBy("node")
    place = each.join(shared, "key").select("*", F.row_number().over(own.orderBy("c", "key")).alias("i"), F.count("*").over(own).alias("m"))
    # shingles that no other component has stand before the shared ones
    front = place.withColumn("at", F.expr("n - m + i")).filter(f"at <= n - ({percent} * n + 99) div 100 + 1")
    front = front.select("key", "node", "comp", "n", F.expr(f"at <= n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1").alias("small"))
    meet = front.groupBy("key").agg(F.max("small").alias("small"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("small and x <> y").select("key")
    return front.drop("small").join(meet, "key")


def _block_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, node, comp, n) that meet as blocks (dom, chunk, part, kind, node, comp, hs): queries (kind 0) and what they are held against (kind 1).

    ``dom`` is the largest component of a key; members outside it are its queries, and meet its own members and each other.
    """
    one = members.select("comp", "node", "n").distinct()
    sizes = one.groupBy("comp").agg(F.sum("n").alias("s"))
    heavy = members.select("key", "comp").distinct().join(sizes, "comp").groupBy("key").agg(F.max_by("comp", F.struct("s", "comp")).alias("dom"))
    queries = members.join(heavy, "key").filter("comp <> dom").select("dom", "node", "comp", "n").distinct()
    doms = queries.groupBy("dom").agg(F.sum("n").alias("q")).join(sizes.withColumnRenamed("comp", "dom"), "dom")
    doms = doms.select("dom", F.ceil(F.col("q") / _PART).cast("int").alias("parts"), F.ceil((F.col("q") + F.col("s")) / _CHUNK).cast("int").alias("chunks"))
    rows = one.select(F.col("comp").alias("dom"), "node", "comp").union(queries.select("dom", "node", "comp"))
    lot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(doms, "dom").select("dom", "node", "comp", lot("parts").alias("part"), every("chunks").alias("chunk"), F.lit(0).alias("kind"))
    held = rows.join(doms, "dom").select("dom", "node", "comp", every("parts").alias("part"), lot("chunks").alias("chunk"), F.lit(1).alias("kind"))
    both = asked.unionByName(held).join(sets.select("node", "hs"), "node")
    return both.select("dom", "chunk", "part", "kind", "node", "comp", "hs").repartition("dom", "chunk", "part").sortWithinPartitions("dom", "chunk", "part", "kind")


class _Block:
    """Queries of a block in one inverted list, and the forest of what was confirmed."""

    def __init__(self, percent: int):
        self.percent, self.nodes, self.comps, self.sets, self.lists = percent, [], [], [], None
        self.top: dict[int, int] = {}

    def _find(self, c: int) -> int:
        while (up := self.top.get(c, c)) != c:
            c = up
        return c

    def held(self, node: int, comp: int, s: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of a held set to queries that join components of which this block knew no path."""
        if self.lists is None:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets), dtype=np.int32), [len(x) for x in self.sets])
            order = np.argsort(flat, kind="stable")
            words, start = np.unique(flat[order], return_index=True)
            self.lists = words, np.append(start, len(flat)), owner[order]
            self.sizes = np.array([len(x) for x in self.sets])
            self.roots = np.array(self.comps)
        words, start, owner = self.lists
        at = np.searchsorted(words, s)
        at = at[words[np.minimum(at, len(words) - 1)] == s]
        size = start[at + 1] - start[at]
        rows = np.repeat(start[at] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
        both = np.bincount(owner[rows], minlength=len(self.sizes))
        root = self._find(comp)
        similar = (100 * both >= self.percent * (self.sizes + len(s) - both)) & (both > 0)
        for k in np.flatnonzero(similar & (self.roots != root)).tolist():
            if (other := int(self.roots[k])) != root:
                self.top[other] = root
                self.roots[self.roots == other] = root
                yield self.nodes[k], node


def _confirm_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, _Block(percent)
        for b in batches:
            dom, chunk, part, kind, node, comp = (c.to_pylist() for c in b.columns[:6])
            ends, flat = np.asarray(b.column(6).offsets), np.asarray(b.column(6).values).view(np.uint64)
            links = []
            for k in range(b.num_rows):
                s = flat[ends[k] : ends[k + 1]]
                if at != (dom[k], chunk[k], part[k]):
                    at, block = (dom[k], chunk[k], part[k]), _Block(percent)
                if kind[k] == 0:
                    block.nodes.append(node[k])
                    block.comps.append(comp[k])
                    block.sets.append(s.copy())
                elif block.nodes:
                    links += block.held(node[k], comp[k], s)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    return run


def _joined(label: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, comp) after further ``links`` (a, b); of those, only edges between components that are parted so far are worked on."""
    if label is not None:
        for side in ("a", "b"):
            known = label.select(F.col("node").alias(side), F.col("comp").alias("top"))
            links = links.join(known, side, "left").withColumn(side, F.coalesce("top", side)).drop("top")
    edges = scratch.write(links.select("a", "b").filter("a <> b").distinct(), "edges")
    if label is None:
        return components(edges, scratch)
    if edges.isEmpty():
        return label
    merged = components(edges, scratch)
    moved = label.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return scratch.write(moved.union(merged.join(label, "node", "left_anti")), "labels")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words: A-Z lower-cased, parted by space and 09-0D. Documents of fewer than
    ``width`` words have their whole sequence as one shingle; null, empty and blank
    texts have none, are linked with nothing and kept. ``component_id`` is the least id
    reachable over links of ``percent`` or more. Rows of one id with different texts are documents of their own, each
    linked by its own text; ``kept`` says whether a row's id is its component's. A row without
    an id is in no component (null) and kept. Other columns of ``docs`` are ignored; an empty table gives no rows.
    The result reads tables of ``scratch`` (one of its own if none is given), which may be closed once the result is written.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).select("id", F.xxhash64("text").alias("th"), "text")
    sets = scratch.write(arrow_map(source, _sets(width), "id long, th long, n long, digest binary, bands array<long>"), "sets")
    known = sets.filter("id is not null and digest is not null").withColumnRenamed("id", "cid")
    firsts = known.groupBy("digest").agg(F.min("cid").alias("cid"))
    # one row for each class of equal sets; once written, its number is fixed
    reps = known.select("digest", "cid", "th", "n", "bands").join(firsts, ["digest", "cid"], "left_semi").dropDuplicates(["digest", "cid"])
    reps = scratch.write(reps.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = _buckets(reps.select("node", "n", F.explode("bands").alias("key")), scratch)
    met = reps.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("cid").alias("id"), "th", "node")
    texts = scratch.write(source.join(met, ["id", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")

    label, tested = None, None

    def still_open() -> DataFrame:
        """Members, with their components, of buckets that hold several components."""
        if label is None:
            return buckets.withColumn("comp", F.col("node"))
        placed = buckets.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        return scratch.write(placed.join(mixed, "key"), "open")

    for hop in (0, 1):
        members = still_open()
        # another hub each time: the busiest, then by hash
        order = F.struct("deg", -F.col("node")) if hop == 0 else F.struct(F.xxhash64("node", F.lit(hop)), F.col("node"))
        hubs = members.groupBy("key").agg(F.max_by(F.struct("node", "comp", "n"), order).alias("h"))
        pairs = members.join(hubs, "key").filter(f"comp <> h.comp and 100 * least(n, h.n) >= {percent} * greatest(n, h.n)").select(F.col("h.node").alias("hub"), F.col("node").alias("id"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["hub", "id"], "left_anti").join(tested.select(F.col("id").alias("hub"), F.col("hub").alias("id")), ["hub", "id"], "left_anti")
        tested = pairs = scratch.write(pairs, "pairs")
        label = _joined(label, scratch.write(_verify(pairs, texts, width, percent), "links"), scratch)
    nodes = still_open().select("node", "comp").distinct()
    if not nodes.isEmpty():
        full = scratch.write(arrow_map(texts.join(nodes, "node").select("node", "comp", "text"), _shingles(width), "node long, comp long, n long, hs array<long>"), "full")
        front = scratch.write(_prefixes(full, percent), "front")
        label = _joined(label, scratch.write(arrow_map(_block_rows(front, full), _confirm_blocks(percent), "a long, b long"), "links"), scratch)
    placed = reps.select("digest", "cid", "node").join(label, "node", "left").select("digest", "cid", F.coalesce("comp", "node").alias("comp"))
    least = placed.join(placed.groupBy("comp").agg(F.min("cid").alias("component")), "comp").select("digest", "component")
    out = sets.select("id", "n", "digest").join(least, "digest", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: The rows of op2_circulant_minhash in DuckDB: all pairs that share a shingle, and the least id that each can reach.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.c), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(r.c), d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate component over 2-word shingles at 0.8."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80).withColumnRenamed("id", "doc_id")
