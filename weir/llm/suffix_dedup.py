"""Removal of repeated 400-byte strings by blockwise suffix sorting with a difference cover.

Candidates: of the 128 strings of 273 bytes in a 400-byte window, the one with the least hash is its
anchor. Equal windows have equal anchors at equal offsets, so only windows whose anchor's
string occurs twice anywhere can repeat; they go to the bucket of that string. Buckets are told by counts of hashes; a
Bloom filter of the buckets that matter goes to the texts, which so never move, and where it would pass its bound the buckets
take turns. Texts of a bucket meet by digest first, and only those of a bucket that holds different ones send their bytes.

Sorting: one suffix bucket at a time. Suffixes of a bucket are ordered by offset, their first 32 and last 48
bytes. What ties is resolved by ranks of a difference cover modulo 32, computed beforehand for the bucket's
texts: cover positions (7 of 32) are ranked by their next 32 bytes and by doubling to 352; for any two suffixes
some shift below 32 puts both on cover positions, where ranks compare at once. So a tie of any length costs a look-up, and
memory holds a few values for each cover position of a few buckets.

A bucket of more than ``CAP`` different texts is split before it is sorted: its windows by halves, each half by
all the bytes that its windows have in common. Copies of a text meet as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import _text
from weir.llm._scratch import Scratch, arrow_map

LENGTH = 400
_SPAN = 128
_CORE = LENGTH - _SPAN + 1
#: Different texts in a bucket that one task sorts.
CAP = 4096
#: Bytes of texts that a task sorts at once, or a bucket; about 60 bytes of memory for each.
_BATCH = 1 << 20
#: Bytes whose windows are hashed at once; about 100 bytes of memory for each.
_BLOCK = 1 << 18
#: Estimated bytes up to which what is known of documents is broadcast to them; beyond it both are shuffled.
BROADCAST = 32 << 20
#: Bits of a filter that is sent to the texts; more buckets or senders than fit take turns.
FILTER_BITS = 1 << 29
_V = 32
_HEAD, _DEEP = 32, 352
_TAIL = LENGTH - _DEEP


@cache
def cover() -> tuple[np.ndarray, np.ndarray]:
    """A difference cover modulo 32, and for residues (a, b) the least shift that puts both on it."""
    from itertools import combinations

    for size in range(6, _V):
        for rest in combinations(range(2, _V), size - 2):
            d = (0, 1, *rest)
            if len({(x - y) % _V for x in d for y in d}) == _V:
                on = np.zeros(_V, bool)
                on[list(d)] = True
                shift = np.array([[next(s for s in range(_V) if on[(a + s) % _V] and on[(b + s) % _V]) for b in range(_V)] for a in range(_V)])
                return on, shift
    raise AssertionError


def _anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, hash) of each run of windows with one anchor; places within the row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    power = _text._powers(n)[:n]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_text._BYTE[data] * power)])
    inverse = np.uint64(pow(int(_text._STEP), -1, 1 << 64))
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - _CORE, inverse, np.uint64))]) if n > _CORE else np.ones(1, np.uint64)
    value = _text.mix((total[_CORE:] - total[: n - _CORE + 1]) * back)
    best, at = value.copy(), np.arange(len(value), dtype=np.int32)
    step = 1
    while step < _SPAN:
        a, b = best[:-step], best[step:]
        less = b < a
        best, at = np.where(less, b, a), np.where(less, at[step:], at[:-step])
        step *= 2
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    ok = np.arange(len(at)) + LENGTH <= off[1:][row]
    place, at, row = np.flatnonzero(ok), at[ok], row[ok]
    if not len(at):
        return none, none, none, none, none
    new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(row) != 0)))
    last = np.append(new[1:], len(at)) - 1
    base = off[row[new]]
    return row[new], at[new] - base, place[new] - base, place[last] - base, value[at[new]].view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, tuple[np.ndarray, ...]]]:
    """Of (tid, text): (bytes, offsets, tids, 64 bits of each tid, (row, anchor, first window, last window, hash)) by blocks."""
    for b in batches:
        data, off, _ = _text.column(b, "text")
        tids = b.column(0)
        short = np.array([int.from_bytes(t[:8], "little") for t in tids.to_pylist()], np.uint64)
        for i, j in _text.blocks(off, _BLOCK):
            if off[j] - off[i] > 2 * _BLOCK:  # one long text, by ranges of its windows
                for s in range(int(off[i]), int(off[j]), _BLOCK):
                    own = data[s : min(s + _BLOCK + LENGTH - 1, off[j])]
                    row, anchor, lo, hi, h = _anchors(own, np.array([0, len(own)]))
                    s -= int(off[i])
                    yield data, off, tids, short, (row + i, anchor + s, lo + s, hi + s, h)
                continue
            row, *rest = _anchors(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield data, off, tids, short, (row + i, *rest)


def _place(short: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits that tell a place of a text."""
    return _text.mix(short * np.uint64(3) + _text.mix(at.astype(np.uint64)))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) to (core, place)."""
    for _, _, _, short, (row, anchor, _, _, h) in _runs(batches):
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(_place(short[row], anchor).view(np.int64))], ["core", "place"])


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.astype(np.int64).view(np.uint64)
    for _ in range(3):
        h = _text.mix(h + np.uint64(77))
        yield (h & np.uint64(bits - 1)).astype(np.int64)


def _among(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Which keys may be in a filter; all that are in it are."""
    ok = np.ones(len(keys), bool)
    for at in _probes(keys, len(bloom) * 64):
        ok &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return ok


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of a table of one long column with ``n`` rows, 16 bits for each."""
    bits = 1 << max(16, (16 * n).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([*_probes(np.asarray(b.column(0)), bits)])
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], ["word", "bits"])

    found = arrow_map(keys, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _digest(x: bytes, before: int) -> bytes:
    return hashlib.blake2b(x, digest_size=16, salt=before.to_bytes(8, "little")).digest()


def _contexts(wanted, turn: int, turns: int):
    """(tid, text) to (core, cid, before, windows, tid, lo) for runs whose core may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for data, off, tids, _, (row, anchor, lo, hi, h) in _runs(batches):
            at = np.flatnonzero(_among(h, wanted.value) & (h % turns == turn))
            tid = tids.take(pa.array(row[at])).to_pylist()
            out = []
            for t, r, c, a, z, core in zip(tid, row[at].tolist(), anchor[at].tolist(), lo[at].tolist(), hi[at].tolist(), h[at].tolist()):
                out.append((core, _digest(data[off[r] + a : off[r] + z + LENGTH].tobytes(), c - a), c - a, z - a + 1, t, a))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["core", "cid", "before", "windows", "tid", "lo"])

    return run


def _sender(cids: list[bytes], tids: list[bytes], lo: np.ndarray) -> np.ndarray:
    """A key of the one place of a text that sends its bytes."""
    short = lambda xs: np.array([int.from_bytes(x[:8], "little") for x in xs], np.uint64)
    return (_text.mix(short(cids)) ^ _place(short(tids), np.asarray(lo))).view(np.int64)


def _senders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_sender(b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(2))))], ["k"])


def _bytes(wanted, senders):
    """(tid, text) to (core, cid, bytes) for places that may send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, tids, _, (row, anchor, lo, hi, h) in _runs(batches):
            at = np.flatnonzero(_among(h, wanted.value))
            tid = tids.take(pa.array(row[at])).to_pylist()
            texts = [data[off[r] + a : off[r] + z + LENGTH].tobytes() for r, a, z in zip(row[at].tolist(), lo[at].tolist(), hi[at].tolist())]
            cids = [_digest(x, int(n)) for x, n in zip(texts, anchor[at] - lo[at])]
            sends = np.flatnonzero(_among(_sender(cids, tid, lo[at]), senders.value)) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(h[at][sends], pa.int64()), _text.binary([cids[k] for k in sends]), _text.binary([texts[k] for k in sends])], ["core", "cid", "bytes"])

    return run


def _halve(size: int):
    """Windows (key, cid, before, at, windows, bytes, lo) of large buckets to cells of ``size`` offsets, each under a key of the bytes that all windows of a cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, cid, before, at, windows, x, lo in zip(*(c.to_pylist() for c in b.columns)):
                # a window's offset, before - w, is the same for equal windows
                for cell in range((before - windows + 1) // size, before // size + 1):
                    w0, w1 = max(0, before - cell * size - size + 1), min(windows - 1, before - cell * size)
                    shared = x[before - cell * size : before - cell * size - size + 1 + LENGTH]
                    sub = hashlib.blake2b(shared + key.to_bytes(8, "little", signed=True) + cell.to_bytes(2, "little"), digest_size=8).digest()
                    out.append((int.from_bytes(sub, "little", signed=True), cid, before - w0, at + w0, w1 - w0 + 1, x[w0 : w1 + LENGTH], lo + w0))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "cid", "before", "at", "windows", "bytes", "lo"])

    return run


def sort_bucket(texts: list[bytes], bucket: np.ndarray, before: np.ndarray, windows: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each text, whether each of its windows equals another window of its bucket at the same offset.

    ``place``: the text's place in its document, whose residue decides what lies on the cover.
    """
    on, shift = cover()
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size) - size
    t = np.frombuffer(b"".join(texts) + bytes(8 * 64), np.uint8).astype(np.uint64)
    word = t.copy()
    for k in (1, 2, 4):  # the next 8 bytes, first byte highest
        word[:-k] = (word[:-k] << np.uint64(8 * k)) | word[k:]
    n = int(size.sum())
    text = np.repeat(np.arange(len(texts)), size)
    residue = ((np.arange(n) - start[text] + place[text]) % _V).astype(np.int64)
    sample = np.flatnonzero(on[residue])
    where = np.full(n + LENGTH + _V, -1, np.int64)
    where[sample] = np.arange(len(sample))

    def ranks(*keys: np.ndarray) -> np.ndarray:
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def ahead(rank: np.ndarray, k: int) -> np.ndarray:
        """Ranks k bytes on, which is on the cover again; none beyond the texts."""
        at = where[sample + k]
        return np.where(at >= 0, rank[at], -1)

    r32 = ranks(*(word[sample + k] for k in (0, 8, 16, 24)))
    r64 = ranks(r32, ahead(r32, 32))
    r128 = ranks(r64, ahead(r64, 64))
    r256 = ranks(r128, ahead(r128, 128))
    deep = ranks(r256, ahead(r64, 256), ahead(r32, 320))

    owner = np.repeat(np.arange(len(texts)), windows)
    w = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    i = start[owner] + w
    group = ranks(bucket[owner] * 4096 + before[owner] - w, *(word[i + k] for k in range(0, _HEAD, 8)), *(word[i + k] for k in range(_DEEP, LENGTH, 8)))
    tied = np.bincount(group)[group] > 1
    repeated = np.zeros(len(i), bool)
    left = np.flatnonzero(tied)
    if len(left):
        r = residue[i[left]]
        rank = deep[where[i[left] + shift[r, r]]]
        cls = ranks(group[left], r, rank)
        many = np.bincount(cls) > 1
        # across residues, one of each class against the first of its group, until no group has two
        rep = left[np.unique(cls, return_index=True)[1]]
        joined = many.copy()
        live = np.arange(len(rep))
        while len(live):
            g = group[rep[live]]
            order = np.argsort(g, kind="stable")
            live, g = live[order], g[order]
            first = np.append(True, g[1:] != g[:-1])
            head = live[np.flatnonzero(first)[np.cumsum(first) - 1]]
            s = shift[residue[i[rep[head]]], residue[i[rep[live]]]]
            same = (deep[where[i[rep[head]] + s]] == deep[where[i[rep[live]] + s]]) & ~first
            joined[live[same]] = True
            joined[head[same]] = True
            live = live[~(same | first)]
        repeated[left] = joined[cls]
    return np.split(repeated, np.cumsum(windows)[:-1])


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cid, before, at, windows, bytes, lo) in order of key to (cid, from, to): runs of repeated windows within a text."""
    rows: list[tuple] = []
    held = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        key = np.array([r[0] for r in rows], np.int64)
        bucket = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else key
        flags = sort_bucket([r[5] for r in rows], bucket, *(np.array([r[k] for r in rows], np.int64) for k in (2, 4, 6))) if rows else []
        cids, a, z = [], [], []
        for r, f in zip(rows, flags):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                cids.append(r[1])
                a.append(r[3] + s)
                z.append(r[3] + e - 1)
        return pa.RecordBatch.from_arrays([_text.binary(cids), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["cid", "from", "to"])

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held > _BATCH and rows and rows[-1][0] != r[0]:
                yield flush(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r[5])
    yield flush(rows)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, runs of windows) to (tid, runs, n): overlapping and touching runs as one."""
    for b in batches:
        starts, ends, sizes = [], [], []
        for runs in b.column(1).to_pylist():
            merged: list[list[int]] = []
            for a, z in sorted((r["a"], r["z"]) for r in runs):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            starts += [a for a, _ in merged]
            ends += [z for _, z in merged]
            sizes.append(len(merged))
        off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        runs = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["a", "z"]))
        yield pa.RecordBatch.from_arrays([b.column(0), runs, pa.array(sizes, pa.int64())], ["tid", "runs", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, copied, runs) to what is removed and what is kept."""
    for b in batches:
        data, off, _ = _text.column(b, "text")
        copied, runs = b.column(2).to_pylist(), b.column(3)
        removed, spans, shas, texts = [], [], [], []
        for k in range(b.num_rows):
            own = data[off[k] : off[k + 1]]
            found = sorted((r["a"], r["z"] + LENGTH) for r in runs[k].as_py() or ())
            if copied[k] and len(own) >= LENGTH:
                found = [(0, len(own))]
            merged: list[list[int]] = []
            for s, e in found:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            at, rest = 0, []
            for s, e in merged:
                rest.append(own[at:s].tobytes())
                at = e
            rest.append(own[at:].tobytes())
            kept = b"".join(rest)
            removed.append(len(own) - len(kept))
            spans.append(len(merged))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), _text.binary(texts)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _to_texts(docs: DataFrame, facts: DataFrame, size: int) -> DataFrame:
    return docs.join(F.broadcast(facts) if size <= BROADCAST else facts, "tid", "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Removes each byte covered by a 400-byte string that starts anywhere else too; matches lie within one text, and
    rows of equal text repeat each other. ``kept``: the remaining bytes. A null text is empty. Ids may be null or repeat. Other
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))
    kind = source.schema["id"].dataType.simpleString()
    long_ = source.filter(F.octet_length("text") >= LENGTH).select("tid", "text")
    copies = scratch.write(long_.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").select("tid", F.lit(True).alias("copied")), "copies")
    # an anchor that occurs in two places, of different texts or of one
    places = arrow_map(long_, _find, "core long, place long").groupBy("core").agg(F.min("place").alias("x"), F.max("place").alias("y"))
    twice = scratch.write(places.filter("x <> y").select("core"), "twice")
    n_twice = twice.count()
    send = docs.sparkSession.sparkContext.broadcast
    turns = -(-32 * n_twice // FILTER_BITS) or 1
    rows, contexts, whole = None, None, None
    join = lambda a, b: b if a is None else a.union(b)
    for turn in range(turns):
        mine = twice.filter(F.pmod("core", F.lit(turns)) == turn)
        wanted = send(_filter(mine, -(-n_twice // turns)))
        found = scratch.write(arrow_map(long_, _contexts(wanted, turn, turns), "core long, cid binary, before long, windows long, tid binary, lo long"), "contexts")
        # equal texts of a bucket are one; those that occur in two places repeat whole
        texts = found.groupBy("core", "cid", "before", "windows").agg(F.min(F.struct("tid", "lo")).alias("x"), F.max(F.struct("tid", "lo")).alias("y"))
        texts = scratch.write(texts.select("core", "cid", "before", "windows", "x.tid", "x.lo", (F.col("x") != F.col("y")).alias("again")), "texts")
        mixed = texts.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1").select("core")
        need = scratch.write(texts.join(mixed, "core").select("core", "cid", "before", "windows", "tid", "lo"), "need")
        n_need = need.count()
        rounds = -(-32 * n_need // FILTER_BITS) or 1
        for k in range(rounds):
            own = need.filter(F.pmod(F.xxhash64("core"), F.lit(rounds)) == k)
            senders = send(_filter(arrow_map(own.select("cid", "tid", "lo"), _senders, "k long"), -(-n_need // rounds)))
            sent = arrow_map(long_, _bytes(wanted, senders), "core long, cid binary, bytes binary").groupBy("core", "cid").agg(F.max("bytes").alias("bytes"))
            sorted_ = own.join(sent, ["core", "cid"]).select(F.col("core").alias("key"), "cid", "before", F.lit(0).cast("long").alias("at"), "windows", "bytes", "lo")
            rows = join(rows, scratch.write(sorted_, "rows"))
            senders.unpersist()
        again = texts.filter("again").select("cid", F.lit(0).cast("long").alias("from"), (F.col("windows") - 1).alias("to"))
        contexts, whole = join(contexts, found.select("cid", "tid", "lo")), join(whole, again)
    ready, size = None, _SPAN
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        fit = rows.join(counts.filter(f"m <= {cap}").select("key"), "key", "left_semi")
        ready = fit if ready is None else ready.union(fit)
        large = scratch.write(rows.join(counts.filter(f"m > {cap}").select("key"), "key", "left_semi"), "large")
        if size == 1 or large.isEmpty():
            break
        size //= 2
        rows = scratch.write(arrow_map(large, _halve(size), rows.schema), "halves")
    # a bucket of one offset holds one 400-byte string
    whole = whole.union(large.select("cid", F.col("at").alias("from"), F.col("at").alias("to")))
    ordered = ready.repartition(F.col("key")).sortWithinPartitions("key")
    found = arrow_map(ordered, _sort, "cid binary, from long, to long").union(whole)
    found = found.groupBy("cid").agg(F.collect_list(F.struct("from", "to")).alias("found"))
    hits = contexts.distinct().join(found, "cid").select("tid", F.explode(F.transform("found", lambda x: F.struct((F.col("lo") + x["from"]).alias("a"), (F.col("lo") + x["to"]).alias("z")))).alias("r"))
    merged = arrow_map(hits.groupBy("tid").agg(F.collect_list("r").alias("runs")), _merge, "tid binary, runs array<struct<a:long,z:long>>, n long")
    cutlist = scratch.write(merged, "cuts")
    n_cuts = cutlist.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    facts = scratch.write(copies.join(cutlist.select("tid", "runs"), "tid", "full").select("tid", "copied", "runs"), "facts")
    out = _to_texts(source, facts, 64 * (copies.count() + n_cuts[0]) + 16 * n_cuts[1]).select("id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "runs")
    return arrow_map(out, _cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_cover_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 400-byte strings: counts, the digest of the remaining bytes, and these as ``text``, where U+FFFD stands for what a cut leaves of a character."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
