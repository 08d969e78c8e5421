"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards (runs of whole documents of about `shard_bytes`). A shard's suffix array holds its
word suffixes in order, compared to the depth of one window; suffixes that start with no window's first word, or in
too short a run of benchmark words, cannot match and are left out before sorting. Every benchmark suffix is
binary-searched in it; its range gives all verbatim occurrences, and neighbouring occurrences join into the longest
matches with their places. Nothing is shuffled: a shard never leaves its task.

Items are cut into parts of about `part_words` windows, which overlap by a window less one word, so no window is lost. Parts
are dealt by hash into blocks of about `block_bytes` of text; one block at a time is broadcast, and the hit bits and
matches travel with the documents from block to block. So what is broadcast has a bound whatever the benchmark's size,
its longest item, or how many rows have one item_id.

Nulls: a null text has no words and is never contaminated; a null item has no window; a null item_id counts as "".
Repeated documents are judged alike, row by row; repeated items of one id count once. Empty tables give empty or
clean results. Input columns with the names of added ones are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, raw, stored, table, total_bytes

#: Word characters: digits, letters, all beyond ASCII. As bytes, A-Z become a-z and the rest parts words.
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class Part:
    """Words of an item from its word `first` on; `copy` tells the different texts of one item_id apart."""

    item: str
    copy: int
    first: int
    text: bytes


class Windows:
    """The distinct windows of some parts: their word ids, lengths and places. Window k's places (item, copy, position in the item)
    are those from edge[k] to edge[k + 1]."""

    def __init__(self, parts: list[Part], size: int):
        self.size, self.vocab = size, {}
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in p.text.translate(WORD).split()], ">u4") for p in parts]
        count = np.array([max(0, len(x) - min(size, len(x)) + 1) if len(x) else 0 for x in ids], np.int64)
        words = np.zeros((int(count.sum()), size), ">u4")
        at = np.cumsum(count) - count
        for x, i, n in zip(ids, at.tolist(), count.tolist(), strict=True):
            if n:
                m = min(size, len(x))
                words[i : i + n, :m] = np.lib.stride_tricks.sliding_window_view(x, m)
        # No word has id 0, so a window's words tell its length.
        self.low, window = np.unique(words.view(f"S{4 * size}")[:, 0], return_inverse=True)
        known = np.frombuffer(self.low.tobytes(), ">u4").reshape(-1, size)
        self.length = (known != 0).sum(axis=1)
        self.high = np.where(known != 0, known, np.uint32(0xFFFFFFFF)).astype(">u4").view(f"S{4 * size}")[:, 0]
        order = np.argsort(window, kind="stable")
        self.edge = np.searchsorted(window[order], np.arange(len(self.low) + 1))
        self.parts = [(p.item, p.copy) for p in parts]
        part = np.repeat(np.arange(len(parts)), count)
        place = np.arange(len(part)) - np.repeat(at, count) + np.repeat(np.array([p.first for p in parts], np.int64), count)
        self.part, self.position = part[order].astype(np.int32), place[order]
        # The shortest window that starts with each word; words that start none get an unreachable length.
        self.shortest = np.full(len(self.vocab) + 1, 1 << 40, np.int64)
        np.minimum.at(self.shortest, known[:, 0].astype(np.int64), self.length)

    def places(self, k: int) -> list[tuple[str, int, int]]:
        own = slice(self.edge[k], self.edge[k + 1])
        return [(*self.parts[p], j) for p, j in zip(self.part[own].tolist(), self.position[own].tolist(), strict=True)]


def parts_of(benchmark: DataFrame, item_id: str, item_text: str, window: int, part_words: int) -> DataFrame:
    """(item, copy, first, text) of the parts of all items with words; equal texts of one id count once."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).distinct()
    words = items.select("item", F.xxhash64("item", "t").alias("copy"), F.regexp_extract_all("t", F.lit(LETTERS), F.lit(0)).alias("w")).where(F.size("w") > 0)
    each = words.withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(part_words))))
    return each.select("item", "copy", F.col("first").cast("long").alias("first"), F.array_join(F.slice("w", F.col("first") + 1, part_words + window - 1), " ").alias("text"))


def search(ids: np.ndarray, ends: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all window occurrences in a shard, and the window of each. ids: word ids (0: none of the
    benchmark's), ends: for each word, where its document ends."""
    n = len(ids)
    gaps = np.flatnonzero(ids == 0)
    stop = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n))]
    run = np.minimum(stop, ends) - np.arange(n)
    start = np.flatnonzero(run >= w.shortest[ids])
    if not len(start):
        return start, start
    at = start[:, None] + np.arange(w.size)
    words = np.where(at < ends[start, None], ids[np.minimum(at, n - 1)], 0)
    keys = np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * w.size}")[:, 0]
    order = np.argsort(keys, kind="stable")
    suffixes = keys[order]
    left, right = np.searchsorted(suffixes, w.low, "left"), np.searchsorted(suffixes, w.high, "right")
    count = right - left
    window = np.repeat(np.arange(len(count)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
    return start[order[rank]], window


def longest(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Occurrences (item, copy, diagonal, start, end) in one document joined to longest matches: runs in which text and item
    advance together."""
    out: list[list] = []
    for item, copy, d, a, b in sorted(found):
        if out and out[-1][:3] == [item, copy, d] and a <= out[-1][4]:
            out[-1][4] = max(out[-1][4], b)
        else:
            out.append([item, copy, d, a, b])
    return [tuple(x) for x in out]


#: A match while blocks are worked through: item_id, copy of its text, diagonal (start less place in the item), start, end.
NAMES = ("item_id", "copy", "diagonal", "start", "end")
MATCH = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if i else T.StringType()) for i, n in enumerate(NAMES)]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_bits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", MATCH)]
MATCH_ARROW = pa.list_(pa.struct([(n, pa.int64() if i else pa.string()) for i, n in enumerate(NAMES)]))


def shard_matches(texts: list[bytes | None], w: Windows, matches: bool = True) -> list[tuple[int, np.ndarray, set[str], list[tuple]]]:
    """For each document of a shard: words, a mask of hit words, items, longest matches (none unless asked for)."""
    get = w.vocab.get
    ids, sizes = [], []
    for t in texts:
        words = t.translate(WORD).split() if t else []
        ids.append(np.fromiter((get(x, 0) for x in words), np.uint32, len(words)))
        sizes.append(len(words))
    bounds = np.cumsum([0, *sizes])
    every = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    starts, window = search(every, np.repeat(bounds[1:], sizes), w) if len(every) and len(w.length) else (np.empty(0, np.int64),) * 2
    cover = np.zeros(len(every) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + w.length[window] if len(window) else window, -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(bounds, starts, "right") - 1
    by = np.argsort(doc, kind="stable")
    edges = np.searchsorted(doc[by], np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(sizes):
        own = by[edges[i] : edges[i + 1]]
        first, seen = int(bounds[i]), {k: w.places(k) for k in set(window[own].tolist())}
        items = {p[0] for places in seen.values() for p in places}
        spans = [(item, copy, s - first - j, s - first, s - first + int(w.length[k])) for s, k in zip(starts[own].tolist(), window[own].tolist(), strict=True) for item, copy, j in seen[k]] if matches else []
        out.append((n, hit[first : bounds[i + 1]], items, longest(spans)))
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 4 << 20, part_words: int = 4096, shard_bytes: int = 4 << 20, keep: list[str] | None = None, matches: bool = True) -> DataFrame:
    """docs[keep] with n_words, n_hit, hit_bits (one bit a word), items (sorted ids of items with occurring windows) and
    matches (longest verbatim matches: start word, words, item, start word in the item; every item
    and place). Without `matches` that column is neither worked out nor returned."""
    spark = docs.sparkSession
    # Stored once: each block picks its parts from there.
    parts = stored(parts_of(benchmark, item_id, item_text, window, part_words))
    blocks = max(1, math.ceil(total_bytes(parts) / block_bytes))
    keep = [c for c in (docs.columns if keep is None else keep)]
    df = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("copy", "first"), F.lit(blocks)) == b).collect()
        known = spark.sparkContext.broadcast(Windows([Part(r.item, r.copy, r.first, r.text.encode()) for r in rows], window))

        def one(batch: pa.RecordBatch, known=known, later=b > 0) -> list[pa.Array]:
            w, texts, out, i = known.value, raw(batch.column(text)), [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or b"") <= shard_bytes):
                    size += len(texts[j] or b"")
                    j += 1
                out += shard_matches(texts[i:j], w, matches)
                i = j
            bits, found, spans = [np.packbits(x[1]).tobytes() for x in out], [sorted(x[2]) for x in out], [x[3] for x in out]
            if later:
                bits = [bytes(a | c for a, c in zip(x, y, strict=True)) for x, y in zip(bits, batch.column("hit_bits").to_pylist(), strict=True)]
                found = [sorted({*x, *y}) for x, y in zip(found, batch.column("items").to_pylist(), strict=True)]
                spans = [longest([tuple(m[n] for n in NAMES) for m in x] + y) for x, y in zip(batch.column("matches").to_pylist(), spans, strict=True)]
            n_hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in bits]
            return [pa.array([x[0] for x in out], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array([[dict(zip(NAMES, m, strict=True)) for m in x] for x in spans], MATCH_ARROW)]

        last = b == blocks - 1
        df = append_arrow(df, FIELDS, one, keep=keep if last else [*dict.fromkeys([*keep, text])])
        if not last:
            df = stored(df)
            known.unpersist()
    if not matches:
        return df.drop("matches")
    shown = lambda m: F.struct(m["start"], (m["end"] - m["start"]).alias("words"), m["item_id"], (m["start"] - m["diagonal"]).alias("item_start"))
    return df.withColumn("matches", F.array_sort(F.array_distinct(F.transform("matches", shown))))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """find()'s rows with n_items and contaminated: some word is hit, and hit words are at least one in `share`."""
    return found.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))})


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, with their own columns."""
    names = docs.columns
    found = judged(find(docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.col("text").alias("_text")), benchmark, text="_text", keep=["_row"], **options))
    return found.where(~F.col("contaminated")).select("_row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item. Beyond the contract: the number of longest verbatim matches, the words of the
    longest one, and a digest of start:words:item:start in the item of all of them, in that order."""
    found = judged(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    place = F.transform("matches", lambda m: F.concat_ws(":", m["start"], m["words"], m["item_id"], m["item_start"]))
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0).cast("long"))
    more = [F.size("matches").cast("long").alias("n_matches"), most.alias("longest_match"), F.sha2(F.array_join(place, ","), 256).alias("matches_sha256")]
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", *more)


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {
    "op1_decontaminate": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
items AS (SELECT DISTINCT item_id, coalesce(text, '') txt, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
windows AS (SELECT item_id, txt, m, j, array_to_string(w[j:j + m - 1], ' ') g FROM (SELECT item_id, txt, w, least(13, len(w)) m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) j FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
starts AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) i FROM words, lengths WHERE len(w) >= m)),
hits AS (SELECT s.doc_id, s.m, s.i, v.item_id, v.txt, v.j FROM starts s JOIN windows v ON s.m = v.m AND s.g = v.g),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, txt, i - j ORDER BY i) g FROM hits),
places AS (SELECT DISTINCT doc_id, min(i) - 1 AS s, max(i) + any_value(m) - min(i) AS n, item_id::VARCHAR x, min(j) - 1 AS k FROM islands GROUP BY doc_id, item_id, txt, i - j, g),
verbatim AS (SELECT doc_id, count(*) n_matches, max(n) longest_match, string_agg(concat_ws(':', s, n, x, k), ',' ORDER BY s, n, x, k) p FROM places GROUP BY doc_id),
own AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR x FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) contaminated,
coalesce(n_matches, 0)::BIGINT n_matches, coalesce(longest_match, 0)::BIGINT longest_match, sha256(coalesce(p, '')) matches_sha256
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN verbatim USING (doc_id)"""
}
