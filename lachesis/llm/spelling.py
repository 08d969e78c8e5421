"""Groups of spelling variants by a frequency-vector trie.

Words are the runs of Latin letters of whole texts (A-Z lowered), counted in all documents; near words differ by one inserted, deleted
or replaced letter. The counts of successive letter groups place a word in a trie. One edit adds at most one letter and takes at most
one away, so near words lie where a depth-first descent that may spend one surplus and one deficit ends. Two tries do this:

1. The upper trie is the directory: nodes with more than CELL words are parted by the next group's count, so its leaves are cells
   of bounded size. The driver holds this directory alone. Every word descends it and is sent to each cell within the budget; of two
   words in different cells one is sent.
2. A cell's words form the lower trie over all groups; the words sent to the cell descend it together. At a leaf bucket, pairs
   that share the first or the last half of the leaf word (one edit leaves one of them whole) are verified letter by letter.

A cell to which more than ASKED words are sent is dealt over several tasks, each with the cell's own words. Words with equal counts of all
groups can't be parted by the trie; where there are more than a cell holds, they meet by their deletion variants, of which a word has
one a letter, and a variant belongs to at most 64 words a letter.

Nulls: a null text has no words, a null doc_id is the text "". Repeated rows count each. Ties of forms go to the smallest word in
code-point order. Words of any length are handled. Other columns aren't read. Empty tables, or tables without such words, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, removed, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters whose counts are a level each; the last level counts all other letters.
GROUPS = ["e", "a", "i", "n", "r", "t", "o", "s", "l", "u", "d", "h", "c", "mgb", "pfv"]
LEVELS = len(GROUPS) + 1
#: Words of a cell, words sent to one task of a cell, words of a leaf bucket, and cells at most (a larger table gets larger cells).
CELL, ASKED, BUCKET, MOST_CELLS = 5_000, 40_000, 32, 50_000
#: Levels of the directory that one pass counts.
STEP = 4
#: Words that a worker takes at once; pairs that are verified at once; letters up to which pairs are verified together.
RUN, PAIRS, WIDTH = 100_000, 100_000, 63
CODES = np.full(256, len(GROUPS), np.int64)
for _g, _letters in enumerate(GROUPS):
    CODES[list(_letters.encode())] = _g
#: Powers and inverse powers make hashes of any part of a word from running sums.
BASE = 0x9E3779B97F4A7C15
MIXED = mix(np.arange(1, 257, dtype=np.uint64))


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", *, least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of words with at least `least` letters and `times` occurrences. A run loses the letter that crc32(key:run) points
    at, if `every` divides that number. Shorter runs can't become long enough and are skipped."""
    runs = docs.select(F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[f"`{text}`"], F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    ascii_ = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


class Words:
    """Words of one byte a letter, side by side: their bytes, bounds, group counts and half keys."""

    def __init__(self, column: pa.Array):
        self.bytes = column.to_pylist()
        self.length = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.start = np.cumsum(self.length) - self.length

    def __len__(self) -> int:
        return len(self.bytes)

    def vectors(self) -> np.ndarray:
        """Counts of the letter groups, a row a word."""
        row = np.repeat(np.arange(len(self)), self.length)
        return np.bincount(row * LEVELS + CODES[self.data], minlength=len(self) * LEVELS).reshape(len(self), LEVELS)

    def padded(self, width: int) -> np.ndarray:
        """Letters of words of at most `width` letters, with zeros behind; longer words are blank."""
        out = np.zeros((len(self), width + 2), np.uint8)
        fits = self.length <= width
        out[(np.arange(width + 2) < self.length[:, None]) & fits[:, None]] = self.data[np.repeat(fits, self.length)]
        return out

    def halves(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and the last half of a word that has `shift` letters more than this one."""
        most = int(self.length.max(initial=0)) + 2
        powers = np.cumprod(np.full(most, BASE, np.uint64)) * np.uint64(pow(BASE, -1, 1 << 64))
        back = np.cumprod(np.full(most, pow(BASE, -1, 1 << 64), np.uint64)) * np.uint64(BASE)
        place = np.arange(len(self.data)) - np.repeat(self.start, self.length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(MIXED[self.data] * powers[place], dtype=np.uint64)])
        whole = self.length + shift
        first, last = whole // 2, whole - whole // 2
        end = self.start + self.length
        head = sums[self.start + np.minimum(first, self.length)] - sums[self.start]
        tail = (sums[end] - sums[np.maximum(end - last, self.start)]) * back[np.maximum(self.length - last, 0)]
        size = whole.astype(np.uint64) * np.uint64(2)
        return mix(head + mix(size)), mix(tail + mix(size + np.uint64(1)))


def descend(rows: np.ndarray, asked: np.ndarray, budget: int, stop: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Depth-first search of the trie over `rows` (sorted; -1 from where a path ends) for all vectors of `asked` together. Yields the
    rows of a leaf (first, end), the vectors that reach it, and whether they have spent nothing. Nodes of at most `stop` rows are leaves."""
    n = len(asked)
    stack = [(0, len(rows), 0, np.arange(n), np.full(n, budget, np.int8), np.full(n, budget, np.int8))]
    while stack:
        lo, hi, level, at, surplus, deficit = stack.pop()
        if lo == hi or not len(at):
            continue
        if level == rows.shape[1] or hi - lo <= stop or rows[lo, level] < 0:
            yield lo, hi, at, (surplus == budget) & (deficit == budget)
            continue
        column = rows[lo:hi, level]
        cuts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
        have = asked[at, level]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            over = have - column[a]
            alive = (over == 0) | ((over == 1) & (surplus > 0)) | ((over == -1) & (deficit > 0))
            if alive.any():
                over = over[alive]
                stack.append((lo + int(a), lo + int(b), level + 1, at[alive], surplus[alive] - (over == 1), deficit[alive] - (over == -1)))


def in_order(vectors: np.ndarray) -> np.ndarray:
    return np.lexsort(vectors.T[::-1])


def directory(words: DataFrame, cell: int) -> tuple[np.ndarray, list[int]]:
    """The paths of all cells, sorted, -1 from where they end, and those cells that hold more than `cell` words of equal counts. Each
    pass counts STEP more levels below the nodes that are still too large."""
    over, cells = {()}, []
    if words.count() <= cell:
        return np.full((1, LEVELS), -1), []
    for top in range(0, LEVELS, STEP):
        last = min(LEVELS, top + STEP)
        known = sorted(p for p in over if len(p) == top)
        if not known:
            break
        held = np.array(known, np.int64).reshape(len(known), top)

        def count(batches: Iterator[pa.RecordBatch], top=top, last=last, held=held) -> Iterator[pa.RecordBatch]:
            for whole in gathered(batches):
                v = Words(whole.column("w")).vectors()[:, :last]
                inside = np.zeros(len(v), bool)
                for _, _, at, _ in descend(held, v[:, :top], 0, 0) if top else [(0, 1, np.arange(len(v)), None)]:
                    inside[at] = True
                for depth in range(top + 1, last + 1):
                    paths, n = np.unique(v[inside, :depth], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths.tolist(), pa.list_(pa.int32())), pa.array(n, pa.int64())], names=["path", "n"])

        nodes = stored(words.select("w").mapInArrow(count, "path array<int>, n long").groupBy("path").agg(F.sum("n").alias("n")))
        large = {tuple(r.path) for r in nodes.where(F.col("n") > cell).select("path").collect()}
        over = {*known, *large}
        parents = nodes.sparkSession.createDataFrame([(list(p),) for p in over], "parent array<int>")
        # At most one node a cell and level.
        small = nodes.where(F.col("n") <= cell).withColumn("parent", F.slice("path", 1, F.size("path") - 1)).join(F.broadcast(parents), "parent", "left_semi")
        cells += [tuple(r.path) for r in small.select("path").collect()]
        removed(nodes)
    hot = [p for p in over if len(p) == LEVELS]
    paths = np.full((len(cells) + len(hot), LEVELS), -1)
    for i, p in enumerate(cells + hot):
        paths[i, : len(p)] = p
    order = in_order(paths)
    return paths[order], np.flatnonzero(order >= len(cells)).tolist()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have RUN rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sent(words: DataFrame, cells: np.ndarray) -> DataFrame:
    """(cell, own, w, n): each word in its own cell and in those cells within the budget whose number is smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            v = Words(b.column("w")).vectors()
            home = np.zeros(len(v), np.int64)
            for lo, _, at, _ in descend(cells, v, 0, 0):
                home[at] = lo
            for lo, _, at, own in descend(cells, v, 1, 0):
                some = own | (home[at] > lo)
                at, own = pa.array(at[some]), own[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), lo, np.int32)), pa.array(own), b.column("w").take(at), b.column("n").take(at)], names=["cell", "own", "w", "n"])

    return words.select("w", "n").mapInArrow(run, "cell int, own boolean, w binary, n long")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def verified(u: Words, v: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of words (u[i], v[j]) differ by exactly one edit."""
    width = min(WIDTH, int(max(u.length.max(initial=0), v.length.max(initial=0))))
    left, right, out = u.padded(width), v.padded(width), np.zeros(len(i), bool)
    place = np.arange(width + 1)
    for a in range(0, len(i), PAIRS):
        at = slice(a, a + PAIRS)
        x, y, m, n = left[i[at]], right[j[at]], u.length[i[at]], v.length[j[at]]
        swap = m > n
        x[swap], y[swap] = y[swap], x[swap]
        unlike = x != y
        same = (m == n) & (unlike.sum(axis=1) == 1)
        shifted = ((x[:, :-1] != y[:, 1:]) & (place >= unlike.argmax(axis=1)[:, None])).any(axis=1)
        out[at] = np.where(np.maximum(m, n) <= width, same | ((np.abs(m - n) == 1) & ~shifted), False)
    for k in np.flatnonzero(np.maximum(u.length[i], v.length[j]) > width):
        out[k] = one_edit(u.bytes[i[k]], v.bytes[j[k]])
    return out


def pairs(asked: Words, leaves: Words) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all near pairs of an asked word and a leaf word: leaf buckets by the trie, then halves, then letters."""
    vectors = leaves.vectors()
    order = in_order(vectors)
    keys = [k[order] for k in leaves.halves(0)]
    own = [np.stack(x, axis=1) for x in zip(*(asked.halves(s) for s in (-1, 0, 1)), strict=True)]
    found, held = [], 0
    for lo, hi, at, _ in descend(vectors[order], asked.vectors(), 1, BUCKET):
        for key, mine in zip(keys, own, strict=True):
            by = np.argsort(key[lo:hi])
            low = key[lo:hi][by]
            want = mine[at].ravel()
            first = np.searchsorted(low, want, "left")
            n = np.searchsorted(low, want, "right") - first
            if n.any():
                hit = np.flatnonzero(n)
                rank = np.arange(n.sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + np.repeat(first[hit], n[hit])
                found.append((np.repeat(at[hit // 3], n[hit]), order[lo + by[rank]]))
                held += len(rank)
        if held > 10 * PAIRS:
            found, held = [checked(asked, leaves, found)], 0
    return checked(asked, leaves, found) if found else (np.empty(0, np.int64),) * 2


def checked(asked: Words, leaves: Words, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(i * len(leaves) + j)
    i, j = both // len(leaves), both % len(leaves)
    good = verified(asked, leaves, i, j)
    return i[good], j[good]


NEAR = "w binary, n_near long, form_n long, form binary"


def near_in_cell(group: pa.Table) -> pa.Table:
    """For each word of one task of a cell that has near words there: their number and the best of them."""
    own, asks, w, n = (group.column(c).combine_chunks() for c in ("own", "asks", "w", "n"))
    own, asks, n = (x.to_numpy(zero_copy_only=False) for x in (own, asks, n))
    leaf, ask = np.flatnonzero(own), np.flatnonzero(asks)
    i, j = pairs(Words(w.take(pa.array(ask))), Words(w.take(pa.array(leaf))))
    i, j = ask[i], leaf[j]
    # A pair of one cell is found from both sides, a pair of two cells from one.
    across = ~own[i]
    word, other = np.concatenate([i, j[across]]), np.concatenate([j, i[across]])
    rank = np.empty(len(w), np.int64)
    rank[np.array(sorted(range(len(w)), key=w.to_pylist().__getitem__), np.int64)] = np.arange(len(w))
    order = np.lexsort([rank[other], -n[other], word])
    word, other = word[order], other[order]
    word, first, many = np.unique(word, return_index=True, return_counts=True)
    best = other[first]
    return pa.table([w.take(pa.array(word)), pa.array(many, pa.int64()), pa.array(n[best], pa.int64()), w.take(pa.array(best))], names=["w", "n_near", "form_n", "form"])


def near_by_variants(rows: DataFrame) -> DataFrame:
    """The same for cells that the trie can't part, a row a pair: words meet by their deletion variants, or by one word as the
    other's variant."""

    def keyed(df: DataFrame, whole: str, cut: str) -> DataFrame:
        df = df.withColumn("word", F.decode("w", "ISO-8859-1"))
        cuts = F.expr("transform(sequence(1, length(word)), i -> struct(i AS i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS t))")
        rows = df.select("cell", "own", "w", "n", "word", F.explode(cuts).alias("c"))
        made = rows.select("cell", "own", "w", "n", F.explode(F.array(F.struct(F.col("c.i").cast("string").alias("kind"), F.col("c.t").alias("t")), F.struct(F.lit(cut).alias("kind"), F.col("c.t").alias("t")))).alias("k"))
        made = made.unionByName(df.select("cell", "own", "w", "n", F.struct(F.lit(whole).alias("kind"), F.col("word").alias("t")).alias("k")))
        return made.select("cell", "own", "w", "n", "k.kind", "k.t").distinct()

    leaf = keyed(rows.where("own"), "whole", "cut").select("cell", "kind", "t", F.col("w").alias("form"), F.col("n").alias("form_n"))
    both = keyed(rows, "cut", "whole").join(leaf, ["cell", "kind", "t"]).where("w != form").select("own", "w", "n", "form", "form_n").distinct()
    one = both.select("w", F.lit(1).cast("long").alias("n_near"), "form_n", "form")
    return one.unionByName(both.where("not own").select(F.col("form").alias("w"), F.lit(1).cast("long").alias("n_near"), F.col("n").alias("form_n"), F.col("w").alias("form")))


def neighbours(words: DataFrame, cell: int = CELL, asked: int = ASKED) -> DataFrame:
    """(word, n_near, top_n, top) of the words of (word, n) that have near words: their number, and the one with the largest n."""
    spark = words.sparkSession
    words = words.select(F.encode("word", "ISO-8859-1").alias("w"), "n")
    cells, hot = directory(words, max(cell, words.count() // MOST_CELLS))
    rows = stored(sent(words, cells))
    plain = rows.where(~F.col("cell").isin(hot)) if hot else rows
    sizes = plain.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("tasks"))
    home = F.pmod(F.xxhash64("w"), F.col("tasks"))
    # One row a cell.
    dealt = plain.join(F.broadcast(sizes), "cell").withColumn("home", home)
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("tasks").cast("long") - 1)).otherwise(F.array("home"))))
    dealt = dealt.select("cell", "task", "own", (F.col("task") == F.col("home")).alias("asks"), "w", "n")
    near = dealt.groupBy("cell", "task").applyInArrow(near_in_cell, NEAR)
    if hot:
        near = near.unionByName(near_by_variants(rows.where(F.col("cell").isin(hot))))
    best = near.groupBy("w").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return best.select(text(F.col("w")).alias("word"), "n_near", (-F.col("best.less")).alias("top_n"), text(F.col("best.form")).alias("top"))


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): each round doubles the steps taken. A form has at least twice its word's n, so
    there are no cycles and few rounds."""
    at = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, at = at, stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        removed(before)
    return at.select("word", "root")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", *, cell: int = CELL, asked: int = ASKED, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of docs."""
    words = stored(counted(docs, text, key, **options))
    near = words.join(neighbours(words, cell, asked), "word", "left")
    has = F.col("top_n") >= 2 * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("top")).alias("form"), F.when(has, F.col("top_n")).alias("form_n")))
    roots = rooted(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's form and root, from all documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
#: DuckDB has no crc32; tests hold the query to a brute-force version.
ORACLES: dict[str, str] = {}
