"""Spelling variants against plain Python, on the small tables and on words made to be awkward."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from lachesis.llm import registry, spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows, least=5, times=3):
    n = Counter()
    for i, t in rows:
        for w in RUNS.findall((t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= times}


def brute_near(words):
    """Near words by all deletions, replacements by a gap and insertions."""
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            near[w] |= set(gaps[i, cut]) - {w}
            if cut in near:
                near[w].add(cut)
                near[cut].add(w)
    return near


def brute(n):
    near, form = brute_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    df = registry.queries()["op11_spelling_variants"](spark, f"/root/testdata/{sf}")
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(df) == brute(brute_counts(docs))


@pytest.mark.parametrize("cell,asked", [(20_000, 200_000), (30, 40), (3, 5)])
def test_small_cells_and_tasks(spark, cell, asked):
    """Deep directories, cells dealt over tasks, and anagrams that no trie parts."""
    rng = random.Random(cell)
    texts = []
    for _ in range(150):
        w = "".join(rng.choice("abezéÿ") for _ in range(rng.choice([4, 5, 6, 7])))
        texts.append(" ".join([w] * rng.choice([1, 3, 6, 12])))
    texts += [" ".join("".join(rng.sample("aabbb", 5)) for _ in range(60)), "Aabbb AABBB aabbb Éaabb éaabb"]
    texts += [None, "", " 12 ", "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3000, " ".join(["x" * 3001] * 6), " ".join(["x" * 40 + "y" + "x" * 2959] * 12)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' as word", "1 as n", "'x' as `a.b`")
    assert got(spelling.variants(docs, cell=cell, asked=asked)) == brute(brute_counts(rows))


def test_text_ids_and_empty_tables(spark):
    rows = [("a b", "there there there theree theree theree theree theree theree")]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id string, text string"))) == brute(brute_counts(rows))
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0


def test_one_edit():
    words = ["", "a", "b", "ab", "ba", "aab", "aba", "abc", "abcd", "bacd", "acbd"]
    for a in words:
        for b in words:
            want = b in {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abcd" for k in (0, 1) if i + k <= len(a)} and a != b
            assert spelling.one_edit(a.encode(), b.encode()) == want, (a, b)


def test_each_task_stays_small(spark):
    """Cells hold what they may; words sent to one task stay within the limit, and few are sent twice."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghi") for _ in range(6)) for _ in range(3000)})
    df = spark.createDataFrame([(w.encode("latin-1"), 3) for w in words], "w binary, n long")
    cells, hot = spelling.directory(df, 200)
    rows = spelling.sent(df, cells).collect()
    own = Counter(r.cell for r in rows if r.own)
    assert not hot and sum(own.values()) == len(words) and max(own.values()) <= 200
    assert len(rows) < 12 * len(words)


def test_verified_pairs_are_few():
    """The trie and the halves leave little to verify letter by letter."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(8)) for _ in range(5000)})
    made = []
    old = spelling.verified
    spelling.verified = lambda u, v, i, j: made.append(len(i)) or old(u, v, i, j)
    try:
        w = spelling.Words(pa.array([x.encode() for x in words], pa.binary()))
        i, j = spelling.pairs(w, w)
    finally:
        spelling.verified = old
    assert {(words[a], words[b]) for a, b in zip(i, j, strict=True)} == {(a, b) for a, s in brute_near(words).items() for b in s}
    assert sum(made) < 20 * len(words)
