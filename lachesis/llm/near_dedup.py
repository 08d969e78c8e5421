"""Near-duplicate groups by HyperMinHash.

1. Each text becomes the set of its word shingles (64-bit hashes) and a sketch of REGISTERS HyperMinHash registers: the
   leading zeros of a bucket's least hash and MANTISSA bits after them. Sets of fewer than SMALL shingles would leave
   buckets empty, so they take one hash function a register; sets of 0.8 * SMALL to SMALL shingles take both kinds, so
   two sets that can be linked always share a kind.
2. Equal sets collapse to the one with the smallest doc_id.
3. Registers are banded (ROWS a band). A band's bucket is centred on its smallest id, and every other member is paired with
   that centre only. Their collision-corrected estimate says whether the pair can link; a pair that can't goes no further
   unless its centre has other members, whom it might link with. Of the rest, members' full sets stream past their
   centre's, with a hot centre's members dealt over many tasks. That gives links, and each member's difference from the
   centre: what it adds and what it lacks.
4. Two members can also link past their centre. Their sets differ by what their differences don't share, so a link
   needs a common part of the two differences; if not both link to the centre, that part is so large that it must begin in the
   first places of both (additions first, which are rare; then lacks), and their bitmaps must have room for all of it.
   Only pairs that meet both, and of different components, are made. Their sizes and collision-corrected estimate must
   allow the threshold; then full sets confirm them as before.

A pair at the threshold shares no band with probability (1 - 0.8^3)^24 < 4e-8, and its estimate lies more than five standard
errors low with probability below 1e-6; no other link is lost.
All pairs of a group are never made. Nothing about all documents reaches the driver; every table that is used twice is
written to the shared folder. Ids are looked up in tables that are broadcast up to SMALL_TABLE rows and joined by shuffle
beyond, where adaptive execution splits a hot id's rows.

Nulls: a null text is empty; empty sets link with nothing, their component is their own. A null doc_id links with nothing;
its component is null and it is kept. Rows with one doc_id are one document, which is linked by each of its texts.
Empty tables give no rows. Extra columns are dropped by `components` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, PLACES, WordHashes, append_arrow, mix, raw, require_integer, shingles, stored, table

REGISTERS, ROWS, MANTISSA, SMALL = 72, 3, 10, 400
BANDS = REGISTERS // ROWS
#: Rows of a table of ids that may be broadcast.
SMALL_TABLE = 100_000
#: Starts of the buckets of the one-permutation kind, and seeds of the other one.
STARTS = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], np.uint64)
SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * PLACES[0])
#: Chance that two independent registers agree: about 0.17 / 2^MANTISSA.
COLLISION = 0.169919487159739 / (1 << MANTISSA)


def registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit least hashes, in 16 bits."""
    x = least | np.uint64(1)
    zeros = np.zeros(len(x), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        x = np.where(low, x << np.uint64(step), x)
        zeros += np.where(low, np.uint64(step), np.uint64(0))
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(">u2")


def sketch_small(s: np.ndarray) -> bytes:
    """One hash function a register."""
    h = (s[:, None] ^ SEEDS) * PLACES[1]
    h ^= h >> np.uint64(32)
    h *= PLACES[2]
    return registers(h.min(axis=0)).tobytes()


def sketch_large(s: np.ndarray) -> bytes:
    """One permutation: the set is sorted, so each bucket's least hash is its first; an empty bucket has all bits set."""
    at = np.searchsorted(s, STARTS)
    filled = at < np.append(at[1:], len(s))
    least = (s[np.minimum(at, len(s) - 1)] - STARTS) * np.uint64(REGISTERS)
    return np.where(filled, registers(least), np.uint16(0xFFFF)).astype(">u2").tobytes()


SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("small", T.BinaryType()), T.StructField("large", T.BinaryType())]


def sketches(docs: DataFrame, k: int, threshold: float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs[keep] with the set's size, a 128-bit key of the set, and its sketches of either kind."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, out = WordHashes(), []
        for t in raw(batch.column(text)):
            s = shingles(t.translate(LOWER).split() if t else [], k, hashes)
            n = len(s)
            key = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
            out.append((n, key[0], key[1], sketch_small(s) if 0 < n < SMALL else None, sketch_large(s) if n >= threshold * SMALL else None))
        return [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]

    return append_arrow(docs, SKETCH, run, keep)


def with_lookup(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """df joined with a stored table of ids, which is broadcast if it is small, so that a hot id stays where its rows are. The rows of
    a stored table are counted from its Parquet footers, without sending rows to one task."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL_TABLE else ids, on, how)


#: Bits of one row of a bitmap, and rows of a bitmap at most (16 MB).
BITS, MAPS = 32768, 4096


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be in ids: all that are, and few others while ids are fewer than the bitmap's bits. A bitmap of
    bounded size goes to the texts, so most texts that no pair needs are not shuffled."""
    maps = max(1, min(MAPS, -(-16 * ids.count() // BITS)))
    place = F.pmod(F.xxhash64("id"), F.lit(maps * BITS))
    own = ids.select(F.floor(place / BITS).cast("int").alias("map"), (place % BITS).alias("bit")).groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = docs.withColumns({"_map": F.floor(place / BITS).cast("int"), "_bit": (place % BITS).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(bits, int(_bit / 8) + 1, 1)")), 16, 10).cast("int")
    found = rows.join(F.broadcast(own), (F.col("_map") == F.col("map")) & (F.getbit(byte, F.col("_bit") % 8) == 1), "left_semi")
    return found.select(*docs.columns)


def banded(sets: DataFrame) -> DataFrame:
    """A row for each set and band: key, id."""
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("r")) for i, c in enumerate(("small", "large"))])
    each = sets.select("id", F.explode(F.filter(kinds, lambda x: x["r"].isNotNull())).alias("s"))
    each = each.select("id", "s", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"))
    return each.select(F.xxhash64("s.k", "b", F.expr(f"substring(s.r, b * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"), "id")


def possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes, and whose collision-corrected estimate of similarity by five standard errors, do not rule
    the threshold out."""
    least = threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("small").alias(f"small_{x}"), F.col("large").alias(f"large_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_pylist() for c in ("small_a", "small_b", "large_a", "large_b")}
            keep = []
            for i in range(batch.num_rows):
                p, q = (x["small_a"][i], x["small_b"][i]) if x["small_a"][i] and x["small_b"][i] else (x["large_a"][i], x["large_b"][i])
                if p is None or q is None:
                    continue
                p, q = np.frombuffer(p, ">u2"), np.frombuffer(q, ">u2")
                used = int(((p != 0xFFFF) | (q != 0xFFFF)).sum())
                same = int(((p == q) & (p != 0xFFFF)).sum())
                if (same / max(1, used) - COLLISION) / (1 - COLLISION) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


COMPARED = "a long, b long, n_a long, n_b long, linked boolean, delta binary"


def compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int, salts: int) -> DataFrame:
    """Each pair (a, b) by its full sets: sizes, linked (percent * union <= 100 * intersection), and a's difference from b:
    shingles it adds, in order, then those it lacks, in order. Members a stream past their centre b."""
    member = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).alias("salt"))
    centre = member.select("b", "salt").distinct()
    rows = member.join(texts.select(F.col("id").alias("a"), "text"), "a").select("b", "salt", "a", "text")
    rows = rows.unionByName(centre.join(texts.select(F.col("id").alias("b"), "text"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text"))
    # Centres (a is null) come first; a centre with several texts meets every member with each of them.
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, centres, open_ = WordHashes(), None, [], False
        for batch in batches:
            out: list[tuple] = []
            for b, a, t in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), raw(batch.column("text")), strict=True):
                s = shingles(t.translate(LOWER).split() if t else [], k, hashes)
                if a is None:
                    if at != b or not open_:
                        at, centres, open_ = b, [], True
                    centres.append(s)
                    continue
                open_ = False
                for c in centres if at == b and len(s) else []:
                    place = np.minimum(np.searchsorted(c, s), len(c) - 1)
                    hit = c[place] == s
                    lack = np.ones(len(c), bool)
                    lack[place[hit]] = False
                    same = int(hit.sum())
                    out.append((a, b, len(s), len(c), 100 * same >= percent * (len(s) + len(c) - same), np.concatenate([s[~hit], c[lack]]).tobytes()))
            kinds = (pa.int64(),) * 4 + (pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["a", "b", "n_a", "n_b", "linked", "delta"])

    return rows.mapInArrow(run, COMPARED)


#: Members of a centre whose differences say which shingles are common among them, and the ratio of neighbouring classes.
SAMPLE, RATIO = 64, 1.25


def common_parts(rows: DataFrame) -> DataFrame:
    """(b, common): the shingles that several differences of a centre's sampled members share, the rarest first. rows: (b, a, c, delta),
    c members each; about SAMPLE of them are taken by hash, and all of fewer. The sample decides an order, so it can't lose a
    pair."""
    some = rows.where(F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / SAMPLE)) == 0)

    def count(group: pa.Table) -> pa.Table:
        e, n = np.unique(np.concatenate([np.frombuffer(d, np.int64) for d in group.column("delta").to_pylist()]), return_counts=True)
        most = n >= (2 if group.column("c")[0].as_py() <= SAMPLE else 3)
        e, n = e[most], n[most]
        return pa.table({"b": group.column("b").slice(0, 1), "common": pa.array([e[np.lexsort([e, n])].tobytes()], pa.binary())})

    return some.select("b", "c", "delta").groupBy("b").applyInArrow(count, "b long, common binary")


def starts(rows: DataFrame, threshold: float, salts: int) -> DataFrame:
    """(b, e, a, comp, free, kind, top): the places e of each difference in which a common part with a partner must begin, the difference's
    class, and the highest class of partners for which the place counts. rows: (b, c, a, comp, free, n_a, n_b, delta).

    With D the difference from the centre c, s = (1 - threshold) / (1 + threshold) and g = |D| - s n for a set of n shingles, two members
    are linked exactly if their differences share (g_u + g_x) / 2 shingles. So g_u is at most |D_x| + s n_x, and, as n_u is at most
    n_x / threshold, at least g_x - 2 s n_x / threshold. Of two members that link past their centre, at least one, u, has no link to it
    (marked `free`), so g_u > s |c|. Classes of g, whose bounds grow by RATIO from s |c| on, give each side a close lower bound of
    the other's g, hence how much must be shared, and in how many first places of any common order that must begin: fewer for higher
    classes, so each place is named once. The order has a centre's common shingles last, so members that share a template, and little else, don't meet."""
    s = (1 - threshold) / (1 + threshold)
    members = rows.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    head = members.select("b", "salt").distinct().join(common_parts(rows), "b").withColumn("delta", F.col("common")).drop("common")
    both = members.unionByName(head, allowMissingColumns=True)
    # A centre's common shingles (a is null) come first.
    both = both.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, rank = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("b", "c", "a", "comp", "free", "n_a", "n_b", "delta"))
            out: list[list] = [[], []]
            heads: list[tuple] = []
            for b, c, a, comp, free, n, centre, delta in zip(*cols, strict=True):
                d = np.frombuffer(delta, np.int64)
                if a is None:
                    order = np.argsort(d)
                    at, known, rank = b, d[order], order
                    continue
                of = np.zeros(len(d), np.int64)
                if at == b and len(known):
                    place = np.minimum(np.searchsorted(known, d), len(known) - 1)
                    of = np.where(known[place] == d, rank[place] + 1, 0)
                order = np.lexsort([d, of])
                d, unique = d[order], int((of == 0).sum()) if c <= SAMPLE else 0
                g, unit = len(d) - s * n, s * centre
                low, high = g - 2 * s * n / threshold, len(d) + s * n
                kind = lambda v, unit=unit: 0 if v <= unit else 1 + int(np.log(v / unit) / np.log(RATIO))
                # Only a free member has partners that the centre links with, whose class is 0.
                kinds = np.arange(kind(low) if free else max(1, kind(low)), kind(high) + 1)
                least = np.where(kinds > 0, np.maximum(low, unit * RATIO ** (kinds - 1.0) * (1 - 1e-9)), low)
                need = np.maximum(1, np.ceil((g + least) / 2 - 1e-9).astype(np.int64))
                ends = len(d) - need + 1
                # A shingle that one member alone has makes no pair.
                own = d[unique : max(0, ends.max(initial=0))]
                top = kinds[0] - 1 + (ends[:, None] > np.arange(unique, unique + len(own))).sum(axis=0) if len(own) else own
                for col, v in zip(out, (own.tolist(), top.tolist()), strict=True):
                    col += v
                heads += [(b, a, comp, free, kind(g))] * len(own)
            first = zip(*heads, strict=True) if heads else [()] * 5
            kinds = (pa.int64(),) * 3 + (pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(first, kinds, strict=True)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())], names=["b", "a", "comp", "free", "kind", "e", "top"])

    return both.select("b", "salt", "c", "a", "comp", "free", "n_a", "n_b", "delta").mapInArrow(run, "b long, a long, comp long, free boolean, kind int, e long, top int")


#: Longs of a difference's bitmap.
LONGS = 8


def bitmaps(rows: DataFrame, threshold: float) -> DataFrame:
    """(b, a, w0.., extra, g): a bitmap of each difference's shingles, how many share a bit with an earlier one, and the
    difference's size less s times the set's. Two differences have at most as many shingles in common as bits and the
    lesser `extra` together, and linked members have at least half of the sum of their g."""
    s = (1 - threshold) / (1 + threshold)
    names = [f"w{i}" for i in range(LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, extra, g = np.zeros((batch.num_rows, LONGS * 64), np.uint8), [], []
            for i, (n, delta) in enumerate(zip(batch.column("n_a").to_pylist(), batch.column("delta").to_pylist(), strict=True)):
                d = np.frombuffer(delta, np.uint64)
                words[i, (mix(d) % np.uint64(LONGS * 64)).astype(np.int64)] = 1
                extra.append(len(d) - int(words[i].sum()))
                g.append(len(d) - s * n)
            packed = np.packbits(words, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("a"), *(pa.array(np.ascontiguousarray(packed[:, j])) for j in range(LONGS)), pa.array(extra, pa.int32()), pa.array(g, pa.float64())], names=["b", "a", *names, "extra", "g"])

    return rows.mapInArrow(run, "b long, a long, " + ", ".join(f"{n} long" for n in names) + ", extra int, g double")


def meetings(found: DataFrame, labels: DataFrame, threshold: float, salts: int) -> DataFrame:
    """(b, e, a, comp, free, kind, top, bitmap of a's difference): where members of one centre and of different components meet. A free
    member is held against each one of the same (b, e)."""
    name = lambda x, y: labels.select(F.col("id").alias(x), F.col("comp").alias(y))
    rows = found.join(name("a", "comp"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    centres = stored(found.select("b").distinct().join(name("b", "comp_b"), "b", "left"))
    rows = with_lookup(rows, centres, ["b"], "left").withColumn("free", F.col("comp") != F.coalesce("comp_b", "b"))
    rows = stored(rows.select("b", "a", "comp", "free", "n_a", "n_b", "delta"))
    some = stored(rows.groupBy("b").agg(F.bool_or("free").alias("f"), F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("f and lo <> hi").select("b", "c"))
    rows = stored(with_lookup(rows, some, ["b"], "inner"))
    at = stored(starts(rows, threshold, salts))
    # A place that one component has alone, or that no free member has, makes no pair.
    mixed = at.groupBy("b", "e").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("free").alias("f")).where("f and lo <> hi").select("b", "e")
    return stored(at.join(mixed, ["b", "e"], "left_semi").join(bitmaps(rows, threshold), ["b", "a"]))


def past_centres(found: DataFrame, labels: DataFrame, threshold: float, salts: int) -> DataFrame:
    """Pairs of members of one centre and different components whose differences begin alike and can share enough."""
    at = meetings(found, labels, threshold, salts)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("a", "comp", "kind", "top", "extra", "g", *(f"w{i}" for i in range(LONGS)))]
    u, x = at.where("free").select("b", "e", *side("u")), at.select("b", "e", *side("x"))
    common = sum((F.bit_count(F.col(f"w{i}_u").bitwiseAND(F.col(f"w{i}_x"))) for i in range(1, LONGS)), F.bit_count(F.col("w0_u").bitwiseAND(F.col("w0_x"))))
    enough = 2 * (common + F.least("extra_u", "extra_x")) >= F.col("g_u") + F.col("g_x") - 1e-9
    near = (F.col("kind_u") <= F.col("top_x")) & (F.col("kind_x") <= F.col("top_u"))
    pairs = u.join(x, ["b", "e"]).where((F.col("comp_u") != F.col("comp_x")) & near & enough)
    return pairs.select(F.least("a_u", "a_x").alias("a"), F.greatest("a_u", "a_x").alias("b")).distinct()


def labels_of(links: DataFrame) -> DataFrame:
    """(id, comp) for all ends of links: comp is the smallest id that can be reached. Each round takes the least label
    of all neighbours, then the label of that label, so long chains shrink by half at least."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = with_lookup(edges, labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), ["b"], "inner").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        after = stored(with_lookup(step, jump, ["comp"], "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = after.select("id", "comp")
        if after.where(F.col("old") != F.col("comp")).isEmpty():
            return labels


def components(docs: DataFrame, *, k: int = 5, percent: int = 80, text: str = "text", salts: int | None = None) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept. A centre's members go to `salts` tasks at most: as many
    as a shuffle has, unless set. doc_id must be an integer."""
    require_integer(docs, "doc_id")
    threshold = percent / 100
    salts = salts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = stored(sketches(docs.select("doc_id", F.col(text).alias("text")), k, threshold, keep=["doc_id"]))
    some = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # Registers of equal sets are equal, so the smallest doc_id's are any one's.
    sets = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "small", "large")).alias("s"))
    sets = stored(sets.select("k1", "k2", F.col("s.doc_id").alias("id"), F.col("s.n_shingles").alias("n"), "s.small", "s.large"))

    bands = banded(sets)
    centres = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("centre")).where(F.col("size") > 1)
    members = stored(bands.join(centres.select("key", "centre"), "key").select("key", "id", "centre"))
    star = stored(members.where(F.col("id") != F.col("centre")).select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    # A pair whose estimate rules it out is compared only for its centre's other members.
    several = stored(star.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b"))
    star = stored(with_lookup(star, several, ["b"], "left_semi").unionByName(possible(with_lookup(star, several, ["b"], "left_anti"), sets, threshold)))
    ends = stored(star.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = stored(likely(docs.select(F.col("doc_id").alias("id"), F.col(text).alias("text")), ends).join(ends, "id", "left_semi"))

    found = stored(compared(star, texts, k, percent, salts))
    links = found.where("linked").select("a", "b")
    labels = labels_of(links)
    pairs = stored(past_centres(found, labels, threshold, salts))
    more = stored(compared(possible(pairs, sets, threshold), texts, k, percent, salts).where("linked").select("a", "b"))
    if not more.isEmpty():
        labels = labels_of(links.unionByName(more))

    whole = sets.select("k1", "k2", "id").join(labels, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("component_id"))
    df = made.select("doc_id", "n_shingles", "k1", "k2").join(whole, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return df.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, *, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows of that doc_id with equal texts count
    once (the first in the order of their other columns); its different texts are one document and all stay."""
    names = docs.columns
    row = F.struct(*[docs[f"`{c}`"] for c in names]).alias("row")
    rows = docs.select(row, docs["doc_id"].alias("id"), docs[f"`{text}`"].alias("text"))
    gone = stored(components(docs, k=k, percent=percent, text=text).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct())
    again = stored(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"))
    left = with_lookup(rows, gone, ["id"], "left_anti")
    if not again.isEmpty():
        own = Window.partitionBy("id", "text").orderBy(F.to_json("row"))
        once = with_lookup(left, again, ["id"], "left_semi").withColumn("n", F.row_number().over(own)).where("n = 1").select(*left.columns)
        left = with_lookup(left, again, ["id"], "left_anti").unionByName(once)
    return left.select(*[F.col("row")[c].alias(c) for c in names])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component at a similarity of 0.8 of its 4-word shingles."""
    return components(table(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES: dict[str, str] = {}
