"""Sharding by extendible hashing.

A row's hash has DEPTH bits. The directory starts with one bucket; a bucket that holds more bytes than the limit splits on
its next hash bit, and only such buckets do. Rows are first added up by hash cell (the first CELL_BITS bits); one aggregation
gives the bytes of every prefix of the cells, and the buckets are the fitting prefixes whose parents don't fit, which is where
splitting one bit at a time ends. Cells that are too large themselves go on in the same way with their rows' next CELL_BITS bits,
so there are at most DEPTH / CELL_BITS rounds. Rows that share all bits (equal keys) and still exceed the limit are dealt to
overflow pages by running bytes inside ranges of about RANGE pages; such rows alone are written once more, which fixes their
ranges.

A row larger than the limit has a shard of its own, marked by `shard_bytes` over the limit. Nulls: a null key is the text
"", a null text has no bytes. Repeated rows share a hash and differ by page only. Input columns with the names of added
ones are replaced, all others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, without

DEPTH, CELL_BITS = 60, 20
#: Directories of at most so many entries are broadcast, larger ones are joined by shuffle.
BROADCAST_ENTRIES = 100_000
#: Overflow pages of a range: one task sorts so many pages' rows.
RANGE = 16
ADDED = ["shard", "depth", "shard_bytes", "shard_rows"]


def hash_bits(key: Column) -> Column:
    """The first DEPTH bits of the key's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, DEPTH // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int, bits: int = DEPTH) -> Column:
    return F.shiftright(h, bits - depth)


def split_cells(cells: DataFrame, limit: int, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """From cells (h, bytes, rows) whose hashes have `last` bits: the buckets of depths first..last that fit, as (depth, prefix,
    bytes, rows), and the cells that don't. Parents of buckets of depth `first` are known not to fit."""
    depths = F.sequence(F.lit(first), F.lit(last))
    levels = cells.withColumn("depth", F.explode(depths)).groupBy("depth", F.expr(f"shiftright(h, {last} - depth)").alias("prefix"))
    levels = stored(levels.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
    over = levels.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fit = levels.where(F.col("bytes") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    split = fit.where(F.col("depth") > first).join(over, ["depth", "parent"], "left_semi").unionByName(fit.where(F.col("depth") == first))
    large = levels.where((F.col("bytes") > limit) & (F.col("depth") == last))
    return split.select("depth", "prefix", "bytes", "rows"), large.select("depth", "prefix", "bytes", "rows")


def directory_of(sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, rows) of rows (h, bytes); only those of depth DEPTH may exceed the limit."""
    done, rest = None, sizes
    for last in range(CELL_BITS, DEPTH + 1, CELL_BITS):
        cells = rest.groupBy(prefix(F.col("h"), last).alias("h")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        fit, large = split_cells(cells, limit, last - CELL_BITS + (last > CELL_BITS), last)
        done = fit if done is None else done.unionByName(fit)
        if last == DEPTH:
            done = done.unionByName(large)
        elif large.isEmpty():
            break
        else:
            rest = rest.join(large.select(F.col("prefix").alias("cell")), prefix(F.col("h"), last) == F.col("cell"), "left_semi").drop("cell")
    return stored(done)


def looked_up(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (.., h) with their bucket's depth, prefix, bytes and rows. The directory has an entry for each prefix of the global depth:
    a bucket of depth d has 2^(top - d) of them; deeper buckets share an entry and are told apart by their own prefix."""
    top = min(CELL_BITS, buckets.agg(F.max("depth")).first()[0] or 0)
    span = F.when(F.col("depth") <= top, F.sequence(F.expr(f"shiftleft(prefix, {top} - least(depth, {top}))"), F.expr(f"shiftleft(prefix + 1, {top} - least(depth, {top})) - 1"))).otherwise(F.array(F.expr(f"shiftright(prefix, greatest(depth, {top}) - {top})")))
    entries = buckets.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), F.explode(span).alias("entry"))
    small = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    found = rows.withColumn("entry", prefix(F.col("h"), top)).join(F.broadcast(entries) if small else entries, "entry")
    return found.where(F.expr(f"shiftright(h, {DEPTH} - depth) = prefix"))


def paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that share all bits and exceed the limit, with a page in their shard's name and the page's bytes and rows.
    A range holds rows of about RANGE pages; in it, rows begin a new page every limit - (largest row) bytes, so that a page
    with its last row stays in the limit; rows of more than half the limit have a page each."""
    ranges = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / (RANGE * max(1, limit)))).cast("long")
    dealt = stored(rows.withColumns({"id": F.monotonically_increasing_id(), "ranges": ranges})).withColumn("part", F.pmod("id", "ranges"))
    big = 2 * F.col("bytes") > limit
    own = Window.partitionBy("shard", "part", "big")
    before = F.coalesce(F.sum("bytes").over(own.orderBy("bytes", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn("big", big).withColumns({"before": before, "most": F.max("bytes").over(own), "n": F.row_number().over(own.orderBy("bytes", "id"))})
    page = F.when(F.col("big"), F.concat(F.lit("b"), F.col("n").cast("string"))).otherwise(F.floor(F.col("before") / F.greatest(F.lit(1), limit - F.col("most"))).cast("string"))
    dealt = dealt.withColumn("page", page)
    one = Window.partitionBy("shard", "part", "big", "page")
    return dealt.withColumns({"shard_bytes": F.sum("bytes").over(one), "shard_rows": F.count(F.lit(1)).over(one), "shard": F.concat_ws("-", "shard", F.col("part").cast("string"), "page")})


def shard(df: DataFrame, limit: int, key: str, text: str = "text") -> DataFrame:
    """df with shard (hash bits, and the page if there is more than one), depth, and the shard's bytes and rows."""
    names = without(df, ADDED).columns
    size = F.coalesce(F.octet_length(df[f"`{text}`"]), F.lit(0)).cast("long").alias("bytes")
    h = hash_bits(df[f"`{key}`"]).alias("h")
    buckets = directory_of(df.select(h, size), limit)
    found = looked_up(df.select(F.struct(*[df[f"`{c}`"] for c in names]).alias("row"), h, size), buckets)
    name = F.concat(F.lit("s"), F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))))
    found = found.select("row", "bytes", "depth", "shard_bytes", "shard_rows", name.alias("shard"))
    if not buckets.where((F.col("depth") == DEPTH) & (F.col("bytes") > limit)).isEmpty():
        full = (F.col("depth") == DEPTH) & (F.col("shard_bytes") > limit)
        found = found.where(~full).unionByName(paged(found.where(full), limit).select(*found.columns))
    return found.select(*[F.col("row")[c].alias(c) for c in names], *ADDED)


LIMIT = 1 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most LIMIT bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, LIMIT, "doc_id").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


QUERIES = {"op10_sharding": op10_sharding}
#: The same directory without splitting: the least depth at which a prefix fits.
ORACLES = {
    "op10_sharding": f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {DEPTH // 4}))::BIGINT h FROM documents),
p AS (SELECT doc_id, b, d, h >> ({DEPTH} - d) p FROM h, (SELECT unnest(generate_series(0, {DEPTH}))::INTEGER d)),
g AS (SELECT d, p, sum(b)::BIGINT s, count(*)::BIGINT n FROM p GROUP BY d, p),
f AS (SELECT doc_id, b, p.d, p.p, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY p.d) r FROM p JOIN g ON p.d = g.d AND p.p = g.p WHERE s <= {LIMIT})
SELECT doc_id, b n_bytes, 's' || CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END shard, d AS depth, s shard_bytes, n shard_rows FROM f WHERE r = 1"""
}
