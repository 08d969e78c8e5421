"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id. Suffixes are sorted in
slices: every LENGTH-byte window belongs to the slice of its anchor, the leftmost of its least-hashed GRAM-byte strings, so
equal windows always meet, and neighbouring windows with one anchor travel as one short string. The steps:

1. chunks: whole documents in runs of CHUNK bytes, compressed, written once.
2. shared: hashes of anchors are dealt to slices; an anchor matters if two documents have it, and is hot if it has more than
   HOT strings. Each chunk gets two bits an anchor back.
3. equals: each chunk names the strings of its shared anchors by 128 bits (32 of the anchor, 96 of the string), one copy of equal
   ones; further copies in later documents of the chunk are settled at once. Strings of hot anchors are cut into their
   windows first, which are dealt by their own hash, so that no slice holds a hot anchor. A slice settles equal strings by their
   smallest doc_id, and says which of the others have an anchor with different strings.
4. strings: only these are sent, by the documents of the smallest doc_id, so copies of a passage never travel as text.
5. factors: the longest previous factor array of the different strings of an anchor is made: their suffixes are sorted (to the
   depth LENGTH, beyond which nothing matters), neighbours give common prefixes, and of the nearest suffixes before and after
   one that have a smaller doc_id, the one with the longer common prefix is its longest earlier match. Those of LENGTH
   bytes are removed.
6. removal: each chunk joins the intervals of its earlier matches and cuts.

A chunk has bounded bytes; a slice has about SLICE bytes' anchors by hash, none of them hot; a passage of any number of copies
sends one name a string and chunk. Rows between chunks and slices are at most chunks x slices and at most the anchors. Everything
but the slices of steps 2, 3 and 5 works on chunks alone.

Nulls: a null text is empty; a null doc_id comes after all others. Rows of one doc_id never match each other. An empty
table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, raw, require_integer, stored, table, total_bytes

GRAM, CHUNK, SLICE, MIN_SLICES, HOT = 16, 8 << 20, 8 << 20, 8, 1000
BLOCK, BITS = 200_000, np.uint64(18)
LAST = (1 << 63) - 1
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def squeeze(x: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else x.tobytes())


def unsqueeze(x: bytes, kind: str | None = None) -> np.ndarray | bytes:
    b = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(b, kind) if kind else b


def to_chunks(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, ids, ends, body): documents in order of doc_id inside a chunk, their ends in the joined bytes. doc_id must be an
    integer."""
    require_integer(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, held, size
            held.sort(key=lambda x: x[0])
            ids, ends = np.array([x[0] for x in held], np.int64), np.cumsum([len(x[1]) for x in held], dtype=np.int64)
            out = [[part << 32 | made], [ids.tobytes()], [ends.tobytes()], [squeeze(b"".join(x[1] for x in held), 3)]]
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["chunk", "ids", "ends", "body"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
                if held and size + len(t or b"") > CHUNK:
                    yield chunk()
                held.append((LAST if i is None else i, t or b""))
                size += len(t or b"")
        if held:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "chunk long, ids binary, ends binary, body binary")


def anchored(body: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: first window, last window, anchor hash, document."""
    n, span = len(body) - length + 1, length - GRAM + 1
    starts = np.append(0, ends[:-1])
    cuts = np.unique(np.concatenate([starts, np.maximum(starts, ends - length + 1)]))
    first, hashes, stop = [], [], []
    for a in range(0, max(0, n), BLOCK):
        m = min(BLOCK, n - a)
        x = body[a : a + m + length - 1].astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        h = mix(x[:-8] * A + x[8:] * B)
        key = (h >> BITS) << BITS | np.arange(len(h), dtype=np.uint64)
        w = 1
        while 2 * w <= span:
            key = np.minimum(key[:-w], key[w:])
            w *= 2
        if w < span:
            key = np.minimum(key[: -(span - w)], key[span - w :])
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + m)] - a] = True
        at = np.flatnonzero(new)
        first.append(at + a)
        hashes.append(key[at] >> BITS)
        stop.append(np.append(at[1:], m) + a)
    if not first:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    first, hashes, stop = np.concatenate(first), np.concatenate(hashes), np.concatenate(stop)
    doc = np.searchsorted(ends, first, "right")
    valid = first + length <= ends[doc]
    return first[valid], stop[valid] - 1, mix(hashes[valid]), doc[valid]


def sliced(h: np.ndarray, slices: int) -> np.ndarray:
    """Slice and 32 bits of each anchor, in one number."""
    return ((h >> np.uint64(36)) % np.uint64(slices)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


class Chunk:
    """A chunk's text, its runs of windows in order, and the different anchors among them."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes, length: int, slices: int):
        self.ids, self.ends, self.text = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), unsqueeze(body)
        self.first, self.last, h, self.doc = anchored(np.frombuffer(self.text, np.uint8), self.ends, length)
        self.anchors, self.which = np.unique(sliced(h, slices), return_inverse=True)

    def by_slice(self) -> Iterator[tuple[int, int, int]]:
        """Slice, and where its anchors begin and end."""
        p = (self.anchors >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else [], len(p)).astype(np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(p[a]), a, b


def anchor_rows(chunks: DataFrame, length: int, slices: int) -> DataFrame:
    """(p, chunk, hashes, many, count): a chunk's anchors in slice p, bits of those that several of its documents have, and
    the strings of each (65535 stands for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *parts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "body")), strict=True):
                c = Chunk(*parts, length, slices)
                own = c.ids[c.doc]
                low, high = np.full(len(c.anchors), LAST, np.int64), np.full(len(c.anchors), -LAST, np.int64)
                np.minimum.at(low, c.which, own)
                np.maximum.at(high, c.which, own)
                count = np.minimum(np.bincount(c.which, minlength=len(c.anchors)), 0xFFFF).astype(np.uint16)
                rows = [(p, chunk, c.anchors[a:b].astype(np.uint32).tobytes(), np.packbits(low[a:b] != high[a:b]).tobytes(), squeeze(count[a:b])) for p, a, b in c.by_slice()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["p", "chunk", "hashes", "many", "count"])

    return chunks.mapInArrow(run, "p long, chunk long, hashes binary, many binary, count binary")


def shared_bits(rows: DataFrame, hot: int) -> DataFrame:
    """(chunk, p, bits, hot): which of a chunk's anchors in a slice are in two documents or more of all chunks, and which of
    these have more than `hot` strings."""

    def run(t: pa.Table) -> pa.Table:
        chunk, hashes, many, count = (t.column(c).to_pylist() for c in ("chunk", "hashes", "many", "count"))
        own = [np.frombuffer(x, np.uint32) for x in hashes]
        flags = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(o)) for m, o in zip(many, own, strict=True)]).astype(bool)
        _, which, chunks = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = chunks > 1
        shared[which[flags]] = True
        busy = np.bincount(which, np.concatenate([unsqueeze(x, np.uint16) for x in count]), len(shared)) > hot
        at = np.cumsum([len(o) for o in own])[:-1]
        bits = [pa.array([np.packbits(x).tobytes() for x in np.split(b[which], at)], pa.binary()) for b in (shared, shared & busy)]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "p": t.column("p"), "bits": bits[0], "hot": bits[1]})

    return rows.groupBy("p").applyInArrow(run, "chunk long, p long, bits binary, hot binary")


def split_hot(text: bytes, hot: np.ndarray, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray, doc: np.ndarray, length: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings lo..hi with their slice and tag, where hot ones are cut into their windows, each with a slice and tag by its own
    hash. The order of places is kept."""
    n = np.where(hot, hi - lo - length + 1, 1)
    which = np.repeat(np.arange(len(lo)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    cut = hot[which]
    lo = lo[which] + step
    hi = np.where(cut, lo + length, hi[which])
    tag = tag[which]
    own = np.fromiter((xxhash.xxh64_intdigest(text[i : i + length]) for i in lo[cut].tolist()), np.uint64, int(cut.sum()))
    tag[cut] = sliced(own, slices)
    return lo, hi, tag, doc[which]


def together(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that some intervals cover, as separate intervals in order."""
    by = np.argsort(lo, kind="stable")
    lo, far = lo[by], np.maximum.accumulate(hi[by])
    new = np.flatnonzero(np.append(True, lo[1:] > far[:-1])) if len(lo) else np.empty(0, np.int64)
    return lo[new], far[np.append(new[1:], len(lo)) - 1] if len(lo) else far


#: Bytes of a string's hash, beside the 32 bits of its anchor.
NAME = 12


def named_rows(chunks: DataFrame, bits: DataFrame, length: int, slices: int) -> DataFrame:
    """(p, chunk, x, y, z): doc_ids (each less the one before), anchors and hashes of a chunk's strings of shared anchors in slice p; with
    p = -1 - chunk the starts and sizes of all these strings by slice, and the starts and ends that the chunk settles by itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for chunk, *parts in zip(*(left.column(c).to_pylist() for c in ("chunk", "ids", "ends", "body")), strict=True):
            c = Chunk(*parts, length, slices)
            known = {p: x for p, *x in zip(*(right.column(c).to_pylist() for c in ("p", "bits", "hot")), strict=True)}
            shared, hot = np.zeros(len(c.anchors), bool), np.zeros(len(c.anchors), bool)
            for p, a, b in c.by_slice():
                shared[a:b], hot[a:b] = (np.unpackbits(np.frombuffer(x, np.uint8), count=b - a) for x in known[p])
            at = np.flatnonzero(shared[c.which])
            lo, hi, tag, doc = c.first[at], c.last[at] + length, c.anchors[c.which[at]], c.doc[at]
            if hot.any():
                lo, hi, tag, doc = split_hot(c.text, hot[c.which[at]], lo, hi, tag, doc, length, slices)
            ids, seen = c.ids.tolist(), {}
            send, settled = [], []
            for i, (a, b, d) in enumerate(zip(lo.tolist(), hi.tolist(), doc.tolist(), strict=True)):
                # Documents are in order, so the first to have a string has the smallest doc_id.
                if ids[seen.setdefault(c.text[a:b], d)] == ids[d]:
                    send.append(i)
                else:
                    settled.append(i)
            done, sent = np.array(settled, np.int64), np.array(send, np.int64)
            slot = (tag[sent] >> np.uint64(32)).astype(np.int64)
            # In the order of their places, neighbouring numbers are alike and compress well.
            sent, slot = sent[np.argsort(slot, kind="stable")], np.sort(slot)
            places = squeeze(lo[sent].astype(np.uint32)), squeeze((hi - lo)[sent].astype(np.uint8))
            out.append((-1 - chunk, chunk, *places, squeeze(np.concatenate(together(lo[done], hi[done])).astype(np.uint32))))
            edges = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else [], len(slot)).astype(np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = sent[a:b]
                names = b"".join([xxhash.xxh3_128_digest(c.text[i:j])[:NAME] for i, j in zip(lo[own].tolist(), hi[own].tolist(), strict=True)])
                out.append((int(slot[a]), chunk, squeeze(np.diff(c.ids[doc[own]], prepend=0)), tag[own].astype(np.uint32).tobytes(), names))
        return blobs(out, "p", "chunk")

    return chunks.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(run, "p long, chunk long, x binary, y binary, z binary")


def blobs(rows: list[tuple], *first: str) -> pa.Table:
    """Rows of two numbers and three byte strings."""
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(),) * 2 + (pa.binary(),) * 3)], names=[*first, "x", "y", "z"])


def answers(rows: DataFrame) -> DataFrame:
    """(chunk, p, x, y, z): which of a chunk's strings in slice p are also in a document with a smaller doc_id, which others have an
    anchor with different strings, and the anchors of the latter. Rows with p < 0 go back as they are."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("p")[0].as_py() < 0:
            return t.select(["chunk", "p", "x", "y", "z"])
        chunks = t.column("chunk").to_pylist()
        ids = [np.cumsum(unsqueeze(x, np.int64)) for x in t.column("x").to_pylist()]
        at = np.cumsum([len(x) for x in ids])[:-1]
        ids, anchor = np.concatenate(ids), np.frombuffer(b"".join(t.column("y").to_pylist()), np.uint32)
        name = np.frombuffer(b"".join(t.column("z").to_pylist()), np.uint32).reshape(-1, NAME // 4).astype(np.uint64)
        high, low = anchor.astype(np.uint64) << np.uint64(32) | name[:, 0], name[:, 1] << np.uint64(32) | name[:, 2]
        order = np.lexsort((low, high))
        new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
        first, which = np.flatnonzero(new), np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], first)
        _, group, count = np.unique(anchor[order[first]], return_inverse=True, return_counts=True)
        whole = ids > least[which]
        # An anchor with one string only has nothing more to compare.
        unclear = ~whole & (count[group] > 1)[which]
        p = t.column("p")[0].as_py()
        return blobs([(c, p, squeeze(w), squeeze(u), squeeze(y[u])) for c, w, u, y in zip(chunks, *(np.split(x, at) for x in (whole, unclear, anchor)), strict=True)], "chunk", "p")

    return rows.groupBy("p").applyInArrow(run, "chunk long, p long, x binary, y binary, z binary")


def string_rows(chunks: DataFrame, answered: DataFrame) -> DataFrame:
    """(p, chunk, blobs...): strings whose anchors have different ones; with p = -1 - chunk the intervals that are settled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for chunk, ids, ends, body in zip(*(left.column(c).to_pylist() for c in ("chunk", "ids", "ends", "body")), strict=True):
            (_, *own), *parts = sorted(zip(*(right.column(c).to_pylist() for c in ("p", "x", "y", "z")), strict=True))
            lo, size, done = (unsqueeze(x, k) for x, k in zip(own, (np.uint32, np.uint8, np.uint32), strict=True))
            lo, hi, (start, end) = lo.astype(np.int64), lo.astype(np.int64) + size, done.reshape(2, -1).astype(np.int64)
            flags = [[unsqueeze(x, bool) for x in part[1:3]] for part in parts]
            whole = np.concatenate([np.zeros(0, bool), *(w for w, _ in flags)])
            start, end = together(np.append(start, lo[whole]), np.append(end, hi[whole]))
            out.append((-1 - chunk, chunk, squeeze(start.astype(np.uint32)), squeeze((end - start).astype(np.uint32)), b"", b"", b""))
            ids, ends, text, a = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), unsqueeze(body), 0
            for (p, _, _, anchor), (_, unclear) in zip(parts, flags, strict=True):
                x, y, a = lo[a : a + len(unclear)][unclear], hi[a : a + len(unclear)][unclear], a + len(unclear)
                if len(x):
                    strings = b"".join([text[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)])
                    out.append((p, chunk, squeeze(x.astype(np.uint32)), squeeze((y - x).astype(np.uint8)), squeeze(ids[np.searchsorted(ends, x, "right")]), anchor, squeeze(strings, 3)))
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["p", "chunk", "start", "size", "ids", "anchor", "strings"])

    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, "p long, chunk long, start binary, size binary, ids binary, anchor binary, strings binary")


def previous_smaller(value: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest one before it with a smaller value (-1: none), and the least `prefix` of the places after
    that one, up to and with its own: what both suffixes have in common. prefix[i] is that of places i - 1 and i."""
    at, common = np.arange(len(value)) - 1, prefix.copy()
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[value[at[open_]] >= value[open_]]
        # Between a place's pointer and itself all values are at least its own, so its pointer may be taken over.
        common[open_] = np.minimum(common[open_], common[at[open_]])
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at, np.where(at >= 0, common, 0)


def longest_previous(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, given by its first bytes (rows of keys): how many of them also start a suffix
    with a smaller id."""
    n, depth = keys.shape
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{depth}")[:, 0], kind="stable")
    prefix = np.zeros(n + 1, np.int64)
    for a in range(1, n, BLOCK):
        b = min(n, a + BLOCK)
        differs = keys[order[a:b]] != keys[order[a - 1 : b - 1]]
        prefix[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), depth)
    value = ids[order]
    before = previous_smaller(value, prefix[:n])[1]
    after = previous_smaller(value[::-1], prefix[:0:-1])[1][::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier(strings: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows also start in a string of a smaller id."""
    sizes = np.array([len(s) - length + 1 for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum([len(s) for s in strings]) - [len(s) for s in strings]
    string = np.repeat(np.arange(len(strings)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[string]
    keys = np.lib.stride_tricks.sliding_window_view(text, length)[at]
    return np.split(longest_previous(keys, ids[string]) >= length, np.cumsum(sizes)[:-1])


def factor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(chunk, start, size): intervals of windows with an earlier match, for the strings of each slice, and those that
    are settled."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("p")[0].as_py() < 0:
            return t.select(["chunk", "start", "size"])
        chunks = t.column("chunk").to_pylist()
        start, size, ids, anchor = ([unsqueeze(x, k) for x in t.column(c).to_pylist()] for c, k in (("start", np.uint32), ("size", np.uint8), ("ids", np.int64), ("anchor", np.uint32)))
        source = np.repeat(np.arange(len(chunks)), [len(x) for x in start])
        start, size, ids, anchor = (np.concatenate(x) for x in (start, size, ids, anchor))
        blob, ends = b"".join(unsqueeze(x) for x in t.column("strings").to_pylist()), np.cumsum(size, dtype=np.int64)
        place: dict[bytes, int] = {}
        which = np.fromiter((place.setdefault(blob[b - n : b], len(place)) for b, n in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size))
        least = np.full(len(place), LAST, np.int64)
        np.minimum.at(least, which, ids)
        whole = ids > least[which]
        # An anchor with one string only has nothing more to compare.
        own = np.zeros(len(place), np.uint32)
        own[which] = anchor
        _, group, count = np.unique(own, return_inverse=True, return_counts=True)
        unclear = count[group] > 1
        out = [(source[whole], start[whole], size[whole].astype(np.uint32))]
        if unclear.any():
            number = np.flatnonzero(unclear)
            names = list(place)
            hits = earlier([names[i] for i in number.tolist()], least[number], length)
            back = np.full(len(place), -1)
            back[number] = np.arange(len(number))
            for i in np.flatnonzero(~whole & (back[which] >= 0)).tolist():
                w = np.flatnonzero(hits[back[which[i]]])
                if len(w):
                    edge = np.flatnonzero(np.append(True, np.diff(w) > length))
                    lo, hi = w[edge], w[np.append(edge[1:], len(w)) - 1] + length
                    out.append((np.full(len(lo), source[i]), (start[i] + lo).astype(np.uint32), (hi - lo).astype(np.uint32)))
        source, start, size = (np.concatenate([x[i] for x in out]) for i in range(3))
        by = np.lexsort((start, source))
        edges = np.searchsorted(source[by], np.arange(len(chunks) + 1))
        cut = [by[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "start": pa.array([squeeze(start[x]) for x in cut], pa.binary()), "size": pa.array([squeeze(size[x].astype(np.uint32)) for x in cut], pa.binary())})

    return rows.groupBy("p").applyInArrow(run, "chunk long, start binary, size binary")


def removed(chunks: DataFrame, intervals: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of each document that remain."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for ids, ends, body in zip(*(left.column(c).to_pylist() for c in ("ids", "ends", "body")), strict=True):
            ids, ends, text = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), unsqueeze(body, np.uint8)
            cover = np.zeros(len(text) + 1, np.int32)
            for s, n in zip(right.column("start").to_pylist(), right.column("size").to_pylist(), strict=True):
                s, n = unsqueeze(s, np.uint32).astype(np.int64), unsqueeze(n, np.uint32).astype(np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + n, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i, a, b in zip(ids.tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                g = gone[a:b]
                k = int(g.sum())
                out.append((None if i == LAST else i, b - a, k, int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0, text[a:b][~g].tobytes() if k else text[a:b].tobytes()))
        kinds = (pa.int64(),) * 4 + (pa.binary(),)
        return pa.table([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return chunks.groupBy("chunk").cogroup(intervals.groupBy("chunk")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame, text: str = "text", length: int = 50, hot: int = HOT) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans and the bytes kept. Anchors of more than `hot` strings are
    split."""
    slices = max(MIN_SLICES, math.ceil(total_bytes(docs, text) / SLICE))
    chunks = stored(to_chunks(docs, text))
    bits = shared_bits(anchor_rows(chunks, length, slices), hot)
    answered = answers(named_rows(chunks, bits, length, slices))
    return removed(chunks, factor_rows(string_rows(chunks, answered), length))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what repeats from documents with smaller ids."""
    df = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES: dict[str, str] = {}
