"""Resampling tests of AUC, all replicates of a test side by side.

A prediction carries one vector with a number for each replicate: how often a bootstrap draws it, or whether a permutation leaves it
on its side. Predictions are dealt by ranges of their scores and sorted inside; one pass over a range adds up, as vectors again, what
each replicate has of positives, of negatives, and of pairs in order. One short pass over the ranges gives every replicate's AUC. So rows
are as many as predictions, whatever the number of replicates, and nothing is sorted for one replicate alone.

Vectors are bytes: a bit a replicate where no number is above 1, else a byte or four. Predictions of one task with equal scores and
classes are added up before they are dealt, so a score that a third of all rows have is a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import stored
from .ranks import numbered

#: Places of the order that one task fills with draws, draws that a task makes for one row of the plan, and replicates of such a row.
SPAN, DRAWS, CHUNK = 4096, 1 << 17, 16
#: Rows whose vectors are unpacked at once.
PIECE = 256


def tasks(df: DataFrame) -> int:
    """Tasks to deal work over that isn't measured in bytes: at least what the session runs at once."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_fields(df: DataFrame, by: list[str], more: str) -> T.StructType:
    """The types of df's columns `by`, and more fields given as `name type, ...`."""
    return T.StructType([*(df.schema[c] for c in by), *T.DataType.fromDDL(more).fields])


def packed(v: np.ndarray) -> list[bytes]:
    """Each row of counts as bytes."""
    most = v.max(axis=1, initial=0)
    return [np.packbits(x.astype(bool)).tobytes() if m <= 1 and v.shape[1] > 8 else x.astype(np.uint8 if m < 256 else np.uint32).tobytes() for x, m in zip(v, most.tolist(), strict=True)]


def unpacked(rows: list[bytes], n: int) -> np.ndarray:
    out = np.empty((len(rows), n))
    for i, b in enumerate(rows):
        out[i] = np.unpackbits(np.frombuffer(b, np.uint8), count=n) if n > 8 and len(b) == -(-n // 8) else np.frombuffer(b, np.uint8 if len(b) == n else np.uint32)
    return out


def keys_of(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))


def merged(keys: list[tuple], vectors: np.ndarray) -> tuple[list[tuple], list[bytes]]:
    """Rows of equal keys added up; single ones stay as they are."""
    place: dict[tuple, int] = {}
    at = np.fromiter((place.setdefault(k, len(place)) for k in keys), np.int64, len(keys))
    if len(place) < len(keys):
        total = np.zeros((len(place), vectors.shape[1]), np.int64)
        np.add.at(total, at, vectors)
        vectors = total
    return list(place), packed(vectors)


class Sums:
    """Vectors of one group's replicates in one range: positives, negatives, ordered pairs, and those of the score at hand."""

    def __init__(self, key: tuple, first: float, n: int):
        self.key, self.first, self.score = key, first, first
        self.p, self.q, self.w, self.open_p, self.open_q = np.zeros((5, n))

    def close(self) -> None:
        self.w += self.open_p * (self.q + self.open_q / 2)
        self.p += self.open_p
        self.q += self.open_q

    def add(self, scores: np.ndarray, pos: np.ndarray, m: np.ndarray) -> None:
        """More rows in the order of their scores."""
        new = np.flatnonzero(np.append(True, (scores[1:] != scores[:-1]) & ~(np.isnan(scores[1:]) & np.isnan(scores[:-1]))))
        gp, gq = np.add.reduceat(m * pos[:, None], new), np.add.reduceat(m * ~pos[:, None], new)
        if scores[0] == self.score or (np.isnan(scores[0]) and np.isnan(self.score)):
            self.open_p += gp[0]
            self.open_q += gq[0]
            new, gp, gq = new[1:], gp[1:], gq[1:]
        if len(new):
            self.close()
            below = self.q + np.cumsum(gq, axis=0) - gq
            self.w += (gp[:-1] * (below[:-1] + gq[:-1] / 2)).sum(axis=0)
            self.p += gp[:-1].sum(axis=0)
            self.q += gq[:-1].sum(axis=0)
            self.open_p, self.open_q, self.score = gp[-1].copy(), gq[-1].copy(), scores[new[-1]]


def replicate_auc(entries: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, auc): an array of the AUCs of n replicates, null where a replicate lacks a class. entries: (by, score, pos, v), v a vector
    of counts."""
    dealt = entries.repartitionByRange(tasks(entries), *by, "score").sortWithinPartitions(*by, "score")
    schema = with_fields(entries, by, "p array<double>, q array<double>, w array<double>, first double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Sums | None = None

        def row() -> pa.RecordBatch:
            now.close()
            return pa.RecordBatch.from_pylist([dict(zip(by, now.key, strict=True)) | {"p": now.p, "q": now.q, "w": now.w, "first": now.first}], schema=arrow)

        for batch in batches:
            arrow = pa.schema([batch.schema.field(c) for c in by] + [pa.field(c, pa.list_(pa.float64())) for c in ("p", "q", "w")] + [pa.field("first", pa.float64())])
            for a in range(0, batch.num_rows, PIECE):
                piece = batch.slice(a, PIECE)
                keys = keys_of(piece, by) if by else [()] * piece.num_rows
                scores, pos, m = piece.column("score").to_numpy(), piece.column("pos").to_numpy(zero_copy_only=False), unpacked(piece.column("v").to_pylist(), n)
                cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if now is None or now.key != keys[lo]:
                        if now is not None:
                            yield row()
                        now = Sums(keys[lo], float(scores[lo]), n)
                    now.add(scores[lo:hi], pos[lo:hi], m[lo:hi])
        if now is not None:
            yield row()

    # A row for each group and range.
    ranges = dealt.select(*by, "score", "pos", "v").mapInArrow(run, schema)

    def join(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("first").to_numpy(), kind="stable")
        p, q, w = (np.stack([np.array(x) for x in group.column(c).to_pylist()])[order] for c in ("p", "q", "w"))
        total = (w + p * (np.cumsum(q, axis=0) - q)).sum(axis=0)
        pairs = p.sum(axis=0) * q.sum(axis=0)
        auc = [t / c if c else None for t, c in zip(total.tolist(), pairs.tolist(), strict=True)]
        return pa.table({**{c: group.column(c).slice(0, 1) for c in by}, "auc": pa.array([auc], pa.list_(pa.float64()))})

    out = with_fields(entries, by, "auc array<double>")
    return ranges.groupBy(*(by or [F.lit(0).alias("_all")])).applyInArrow(join, out)


def draws_of(sizes: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, span, cells): all draws of all replicates, dealt by spans of places. A task draws for blocks of replicates and
    draws (the number of MD5 of seed:replicate:draw, modulo n) and counts equal ones; cells are three arrays of replicate, place in
    the span and times. Blocks grow with n, so that cells stay full."""
    block = F.greatest(F.lit(DRAWS // CHUNK), F.least(F.col("n"), F.lit(1 << 20))).cast("long")
    plan = sizes.withColumn("block", block).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(CHUNK))))
    plan = plan.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("block")))).repartition(tasks(sizes))
    schema = with_fields(sizes, by, "span bigint, rep binary, at binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.slice(k, 1)
                n, block, first, j = (own.column(c)[0].as_py() for c in ("n", "block", "rep", "j"))
                last, stop = min(replicates, first + CHUNK), min(n, j + block)
                cells = []
                for rep in range(first, last):
                    head, md5 = f"{seed}:{rep}:", hashlib.md5
                    drawn = b"".join([md5(f"{head}{x}".encode(), usedforsecurity=False).digest()[:4] for x in range(j, stop)])
                    place, times = np.unique(np.frombuffer(drawn, ">u4").astype(np.int64) % n, return_counts=True)
                    cells.append(np.stack([np.full(len(place), rep), place, times]))
                rep, place, times = np.concatenate(cells, axis=1)
                order = np.argsort(place // SPAN, kind="stable")
                rep, place, times = rep[order], place[order], times[order]
                spans, starts = np.unique(place // SPAN, return_index=True)
                cut = lambda x, kind: [y.astype(kind).tobytes() for y in np.split(x, starts[1:])]
                key = [own.column(c).take(pa.array(np.zeros(len(spans), np.int64))) for c in by]
                yield pa.RecordBatch.from_arrays([*key, pa.array(spans, pa.int64()), *(pa.array(x, pa.binary()) for x in (cut(rep, np.uint32), cut(place % SPAN, np.uint16), cut(times, np.uint32)))], names=schema.names)

    return plan.select(*by, "n", "block", "rep", "j").mapInArrow(run, schema)


def bootstrap_auc(df: DataFrame, by: list[str], order: list[str], replicates: int = 1000, seed: int = 0, flip: bool = False) -> DataFrame:
    """(by, auc): the AUCs of resamples with replacement. Predictions are numbered in `order`; draw j of a replicate takes place
    MD5(seed:replicate:j) modulo n. flip takes the other class as positive and 1 - confidence. Null targets are drawn and
    count for no class; a null confidence is below all others."""
    score = 1 - F.col("confidence") if flip else F.col("confidence")
    rows = numbered(df, by, order).select(*by, "n", (F.col("target") == (0 if flip else 1)).alias("pos"), F.coalesce(score.cast("double"), F.lit(float("-inf"))).alias("score"), F.floor(F.col("i") / SPAN).cast("long").alias("span"), (F.col("i") % SPAN).cast("int").alias("place"))
    rows = stored(rows)
    draws = draws_of(rows.groupBy(*by).agg(F.max("n").alias("n")), by, replicates, seed)
    schema = with_fields(df, by, "score double, pos boolean, v binary")

    def fill(key: tuple, places: pa.Table, cells: pa.Table) -> pa.Table:
        v = np.zeros((SPAN, replicates), np.uint32)
        for rep, at, times in zip(*(cells.column(c).to_pylist() for c in ("rep", "at", "times")), strict=True):
            np.add.at(v, (np.frombuffer(at, np.uint16), np.frombuffer(rep, np.uint32)), np.frombuffer(times, np.uint32))
        places = places.filter(places.column("pos").is_valid())
        keys, vectors = merged(list(zip(places.column("score").to_pylist(), places.column("pos").to_pylist(), strict=True)), v[places.column("place").to_numpy()])
        known = {c: pa.array([k.as_py() for k in key[i : i + 1]] * len(keys), places.schema.field(c).type) for i, c in enumerate(by)}
        return pa.table({**known, "score": pa.array([k[0] for k in keys], pa.float64()), "pos": pa.array([k[1] for k in keys], pa.bool_()), "v": pa.array(vectors, pa.binary())})

    entries = stored(rows.groupBy(*by, "span").cogroup(draws.groupBy(*by, "span")).applyInArrow(fill, schema))
    return replicate_auc(entries, by, replicates)


def bootstrap_auc_ci(df: DataFrame, by: list[str], order: list[str], replicates: int = 1000, seed: int = 0, flip: bool = False) -> DataFrame:
    """2.5 and 97.5 percentiles and mean of bootstrap_auc's replicates that have both classes."""
    auc = bootstrap_auc(df, by, order, replicates, seed, flip).withColumn("auc", F.explode("auc")).where("auc is not null")
    return auc.groupBy(*by).agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.avg("auc").alias("mean"))


def permuted_auc(aligned: DataFrame, by: list[str], ids: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(by, side, auc): both sides' AUCs, first as they are, then after each of the replicates' swaps. aligned: (by, ids, target,
    confidence_a, confidence_b); a row swaps in a replicate if MD5(seed:replicate:ids) is odd. Null targets don't count, a null
    confidence is below all others."""
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ids]).alias("text")
    low = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c)
    rows = aligned.where("target is not null").select(*by, text, (F.col("target") == 1).alias("pos"), low("confidence_a"), low("confidence_b"))
    rows = rows.repartition(tasks(rows), "text", *by)
    schema = with_fields(aligned, by, "side string, score double, pos boolean, v binary")
    heads = [f"{seed}:{r}:".encode() for r in range(replicates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for whole in batches:
            for at in range(0, whole.num_rows, 2 * PIECE):
                b = whole.slice(at, 2 * PIECE)
                texts = [t.encode() for t in b.column("text").to_pylist()]
                coins = np.frombuffer(b"".join([md5(h + t, usedforsecurity=False).digest()[3:4] for t in texts for h in heads]), np.uint8).reshape(len(texts), -1) & 1
                stay = np.concatenate([np.ones((len(texts), 1), np.uint8), 1 - coins], axis=1).astype(np.int64)
                known, pos = keys_of(b, by) if by else [()] * len(texts), b.column("pos").to_pylist()
                keys, vectors = [], []
                for own, other, c in (("a", "b", "confidence_a"), ("b", "a", "confidence_b")):
                    for side, v in ((own, stay), (other, 1 - stay)):
                        keys += [(*k, side, s, p) for k, s, p in zip(known, b.column(c).to_pylist(), pos, strict=True)]
                        vectors.append(v)
                keys, v = merged(keys, np.concatenate(vectors)) if texts else ([], [])
                columns = [pa.array([k[i] for k in keys], b.column(c).type) for i, c in enumerate(by)]
                rest = [pa.array([k[len(by) + i] for k in keys], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*columns, *rest, pa.array(v, pa.binary())], names=schema.names)

    return replicate_auc(stored(rows.mapInArrow(run, schema)), [*by, "side"], replicates + 1)


def permutation_test_auc(aligned: DataFrame, by: list[str], ids: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """Observed difference of two AUCs and the share of label swaps with at least that difference, as permuted_auc draws them."""
    auc = permuted_auc(aligned, by, ids, replicates, seed)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("auc"))).alias(s)
    d = auc.groupBy(*by).agg(side("a"), side("b")).withColumn("d", F.zip_with("a", "b", lambda a, b: a - b))
    d = d.select(*by, F.get("d", F.lit(0)).alias("difference"), F.explode(F.slice("d", 2, replicates)).alias("d"))
    return d.groupBy(*by, "difference").agg(F.avg((F.abs("d") >= F.abs("difference") - 1e-12).cast("double")).alias("p_value"))


def all_pairs(df: DataFrame, by: list[str], side: str, keys: list[str], which: str = "all", order: list | None = None) -> DataFrame:
    """Aligned predictions of two values of `side`, as models of a configuration or configurations of a model: (by, pair, keys,
    target, confidence_a, confidence_b). A prediction meets the others of its own key, as many as there are values of side.

    which: every two values ("all", a before b), each value and the next ("adjacent"), or the first and each other one ("first").
    order: the values in order, by themselves if not given; values outside it are left out."""
    if which not in ("all", "adjacent", "first"):
        raise ValueError(f"which pairs: all, adjacent or first, not {which}")
    sides = [r[0] for r in df.select(side).where(F.col(side).isNotNull()).distinct().orderBy(side).limit(MOST_SIDES + 1).collect()] if order is None else list(order)
    if len(sides) > MOST_SIDES:
        raise ValueError(f"more than {MOST_SIDES} values of {side} to compare")
    place = F.array_position(F.array(*[F.lit(s).cast(df.schema[side].dataType) for s in sides]), F.col(side)) if sides else F.lit(0).cast("long")
    df = df.withColumn("_place", place).where("_place > 0")
    one = lambda x: df.select(*by, *keys, "target", F.col(side).cast("string").alias(f"_{x}"), F.col("_place").alias(f"_place_{x}"), F.col("prediction").alias(f"prediction_{x}"), F.col("confidence").alias(f"confidence_{x}"))
    fits = {"all": "_place_a < _place_b", "adjacent": "_place_a + 1 = _place_b", "first": "_place_a = 1 and _place_b > 1"}[which]
    both = one("a").join(one("b").drop("target"), [*by, *keys]).where(fits)
    return both.withColumn("pair", F.concat_ws(" / ", "_a", "_b")).drop("_a", "_b", "_place_a", "_place_b")


#: Models or configurations that are compared at once.
MOST_SIDES = 1000
