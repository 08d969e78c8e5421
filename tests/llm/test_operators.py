"""Each operator against a brute-force version, on the small tables and on rows made to be awkward."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lachesis.llm import byte_bpe, chat, common, decontaminate, language_mix, near_dedup, quality_model, quality_rules, secrets, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = "word " * 30_000
SF = "/root/testdata/sf0.01"


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


AWKWARD = [None, "", " ", "a", "A b\tC", "é ÀÉ ß", "\n\n x \n x\n", WIDE, "same text here for all to see", "same text here for all to see", "\x00nul\x00", "日本語 テキスト 🙂", "a  b\x0b c"]


# ---- 1

LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_hits(text, items, size=13):
    w = re.findall(LETTER, (text or "").translate(LOWER))
    hit, own = set(), set()
    for i, t in items:
        v = re.findall(LETTER, (t or "").translate(LOWER))
        m = min(size, len(v))
        for j in range(len(v) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[j : j + m]:
                    hit |= set(range(p, p + m))
                    own.add(str(i))
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    rng = random.Random(1)
    word = lambda: rng.choice("a b c d e f g h".split()) * rng.choice([1, 1, 2])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 13, 20])))) for i in range(12)] + [(12, None), (3, "zz yy")]
    long = " ".join(word() for _ in range(40))
    items.append((13, long))
    texts = AWKWARD + [" ".join(word() for _ in range(n)) for n in (0, 5, 30)] + [f"x {long} y", long.upper(), f"{long}. {long}", "yy zz yy"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(decontaminate.find(documents(spark, texts).withColumn("N_HIT", F.lit("clash")), bench, block_bytes=block)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, h, own = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n, h, own, h > 0 and 20 * h >= n)
    best = next(r for r in got if r.text == f"x {long} y")
    assert any(m.words >= 40 and m.start == 1 and m.item_id == "13" and m.item_start == 0 for m in best.matches)
    assert decontaminate.clean(documents(spark, texts), bench).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(documents(spark, AWKWARD), none).count() == len(AWKWARD)
    assert decontaminate.find(documents(spark, AWKWARD).where("false"), none).count() == 0


def test_matches_of_every_item_and_place(spark):
    """Two items share 20 words; a document copies the one with the larger id, whose shared words come twice."""
    shared, own = [f"s{i}" for i in range(20)], [f"b{i}" for i in range(15)]
    items = [("a", " ".join([*(f"a{i}" for i in range(5)), *shared])), ("b", " ".join([*own, *shared, "gap", *shared]))]
    docs, bench = documents(spark, [" ".join(["x", *own, *shared, "y"])]), spark.createDataFrame(items * 2, "item_id string, text string")
    for block, part in ((8 << 20, 4096), (200, 4096), (8 << 20, 3), (100, 3)):
        row = decontaminate.find(docs, bench, block_bytes=block, part_words=part).first()
        got = sorted((m["item_id"], m["start"], m["words"], m["item_start"]) for m in row.matches)
        assert got == [("a", 16, 20, 5), ("b", 1, 35, 0), ("b", 16, 20, 36)] and row["items"] == ["a", "b"]


def test_parts_of_one_hot_item(spark):
    """Many texts of one null item_id, and a long one, are dealt over blocks by their parts; nothing is lost at the cuts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c Dd é 7".split()) for _ in range(n)) for n in (0, 4, 13, 14, 40, 400)]
    bench = spark.createDataFrame([(None, t) for t in texts * 2], "item_id string, text string")
    docs = [texts[5].replace(" ", ", "), texts[4] + " x " + texts[3], texts[5][100:300], *AWKWARD]
    whole = decontaminate.find(documents(spark, docs), bench, block_bytes=8 << 20).orderBy("doc_id").collect()
    cut = decontaminate.find(documents(spark, docs), bench, block_bytes=800, part_words=20).orderBy("doc_id").collect()
    assert whole == cut
    for r in whole:
        n, h, own = brute_hits(r.text, [("", t) for t in texts])
        assert (r.n_words, r.n_hit, r["items"]) == (n, h, own)
    assert any((m.start, m.words, m.item_start) == (0, 400, 0) for m in whole[0].matches)
    sizes = [decontaminate.parts_of(bench, "item_id", "text", 13, k).agg(F.max(F.size(F.split("text", " ")))).first()[0] for k in (20, 4096)]
    assert sizes == [32, 400]


# ---- 2

def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|> <\\| <\\\\|"), (1, 2, "assistant", "again"), (2, 0, "system", None), (2, 1, "user", "a<"), (2, 2, "assistant", "|b\n"), (3, 0, None, "x"), (3, 1, "od\nd<|", "y"), (None, None, "user", "z"), (4, 0, "assistant", WIDE), (4, 0, "assistant", WIDE), (5, 0, "user", "q"), (5, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(0))
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = {}
    for c, t, r, x in sorted(turns, key=lambda z: (z[0] or 0, z[1] or 0, z[2] or "", z[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert {c: got[c].valid for c in got} == {1: False, 2: True, 3: False, None: False, 4: False, 5: True}
    text = "".join(s.text for r in formatted.where("conv_id = 1").orderBy("n").collect() for s in r.segments)
    assert chat.Template().read(text) == by[1]
    assert chat.format_turns(df.where("false")).count() == 0


def test_chats_with_null_conversations(spark):
    """Several conversations end in one batch, some of whose values are null."""
    rows = [(None, 0, "user", "a"), (7, 0, "user", "b"), (7, 1, "assistant", "c"), (8, None, None, None), (9, 0, "user", "d"), (None, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.valid) for r in chat.digests(chat.format_turns(df)).collect()}
    assert got == {None: (2, 0, True), 7: (2, 1, True), 8: (1, 0, False), 9: (1, 0, False)}


def test_escapes():
    rng = random.Random(3)
    for _ in range(500):
        x = "".join(rng.choice("<|\\a") for _ in range(rng.randrange(12)))
        assert "<|" not in chat.escape(x) and chat.unescape(chat.escape(x)) == x


# ---- 3

def components(docs, k):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        m = min(k, len(w))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + m]) for j in range(len(w) - m + 1)) if w else frozenset())
    up = {i: i for i in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def variants(seed):
    """A base, edits that link with it or only with one another, cut and longer forms, and unrelated texts."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(900)}" for _ in range(rng.choice([12, 60, 130]))], []
    for _ in range(45):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(8)}"
        cut = rng.random()
        w = w[: int(len(w) * rng.uniform(0.7, 1))] if cut < 0.2 else w + [f"y{j}" for j in range(rng.randrange(1, 1 + len(w) // 3))] if cut < 0.4 else w
        out.append(" ".join(w))
    return out + [" ".join(f"z{rng.randrange(5)}" for _ in range(6)) for _ in range(10)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_duplicates(spark, seed):
    texts = variants(seed) + AWKWARD
    ids = list(range(len(texts) - 1)) + [4]
    random.Random(seed).shuffle(ids)
    want = components(list(zip(ids, texts, strict=True)), 4)
    got = near_dedup.components(documents(spark, texts, ids), k=4).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    df = documents(spark, ["a b c d e"] * 3 + [None], [None, 1, 2, 3]).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.components(df).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False), 3: (3, True)}
    assert near_dedup.components(df.where("false")).count() == 0
    assert sorted(r.doc_id or 0 for r in near_dedup.deduplicated(df).collect()) == [0, 1, 3]
    assert near_dedup.deduplicated(df).columns == df.columns


def test_equal_rows_count_once(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "f g h i j", "a b c d e", "other words of one"], [1, 1, 2, 3, 1]).withColumns({"_gone": F.lit(1), "row": F.lit(2), "id": F.lit(3)})
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e"), (1, "other words of one"), (2, "f g h i j")]


def test_links_near_the_threshold(spark):
    """Pairs at 80 to 90 % similarity, each alone: every one is linked, and none just below."""
    rng, texts, want = random.Random(6), [], {}
    for p in range(400):
        n = rng.choice([60, 200, 700])
        words = [f"p{p}w{j}" for j in range(n)]
        other = list(words)
        # A run of changed words changes its length and three shingles more.
        run = int(n * rng.uniform(0.05, 0.14))
        at = rng.randrange(n - run)
        other[at : at + run] = [f"p{p}x{j}" for j in range(run)]
        a, b = ({tuple(w[j : j + 4]) for j in range(n - 3)} for w in (words, other))
        texts += [" ".join(words), " ".join(other)]
        want[2 * p + 1] = 2 * p if 100 * len(a & b) >= 80 * len(a | b) else 2 * p + 1
    got = {r.doc_id: r.component_id for r in near_dedup.components(documents(spark, texts), k=4).collect()}
    assert sum(v % 2 == 0 for v in want.values()) > 100 and sum(v % 2 for v in want.values()) > 50
    assert {k: got[k] for k in want} == want


def test_estimates_are_fair():
    rng = np.random.default_rng(0)
    for n in (50, 300, 5000):
        s = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
        a, b = s[: int(n * 1.1)], s[int(n * 0.1) : int(n * 1.2)]
        sketch = near_dedup.sketch_small if n < 400 else near_dedup.sketch_large
        p, q = (np.frombuffer(sketch(x), ">u2") for x in (a, b))
        assert abs((p == q).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.25


# ---- 4 and 7

def test_quality_model(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice("alpha beta gamma delta some other words here".split()) for _ in range(80)) + "." for _ in range(60)]
    bad = [" ".join("###" + rng.choice("ab") + "$$$" for _ in range(60)) for _ in range(60)]
    df = documents(spark, good + bad).withColumn("score", F.lit("clash"))
    stats = quality_model.statistics(df)
    model = quality_model.fit(stats.withColumn("label", (F.col("doc_id") < 60).cast("int")))
    got = {r.doc_id: r.score for r in quality_model.score(stats, model, keep=["doc_id"]).collect()}
    assert all(got[i] > 0.5 for i in range(60)) and all(got[i] < 0.5 for i in range(60, 120))
    odd = quality_model.score(quality_model.statistics(documents(spark, AWKWARD)), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    unlabelled = quality_model.fit(stats.withColumn("label", F.lit(None).cast("int")))
    assert {r.score for r in quality_model.score(stats, unlabelled).collect()} == {0.5}
    assert quality_model.score(quality_model.statistics(df.where("false")), model).count() == 0



def test_quality_accuracy(spark):
    got = quality_model.op4_quality_model(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93


def test_quality_against_plain_discriminant(spark):
    """The whole query against a discriminant in plain numpy, fitted on the documents that are not held out."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    x = {i: np.array(quality_model.measure(t)) for i, t in docs.items()}
    rows = [(x[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs and r.quality in (0, 1) and not held[r.doc_id]]
    own = [np.array([v for v, y in rows if y == c]) for c in (0, 1)]
    spread = [np.cov(v.T, bias=True) for v in own]
    pooled = sum(len(v) * s for v, s in zip(own, spread, strict=True)) / len(rows)

    def density(v, c):
        cov = 0.8 * spread[c] + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + (1e-4 + 0.0005 * np.trace(cov) / len(v)) * np.eye(len(v))
        d = v - own[c].mean(axis=0)
        return np.log(len(own[c]) / len(rows)) - np.linalg.slogdet(cov)[1] / 2 - d @ np.linalg.solve(cov, d) / 2

    got = {r.doc_id: r for r in quality_model.op4_quality_model(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, v in x.items():
        want = 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700)))
        assert got[i].held_out == held[i] and abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.3)


def test_languages_against_plain_mixture(spark):
    """The whole query against counts and expectation-maximisation in plain loops."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    grams = lambda w: [int(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 18 for b in [b" " + w.encode() + b" "] for i in range(len(b) - 2)]
    counts = {}
    for i, (t, lang) in docs.items():
        if t is not None and lang is not None and not held[i]:
            counts.setdefault(lang, Counter()).update(g for w in t.lower().split() for g in grams(w))
    names = sorted(counts)
    log_p = np.log([[counts[n][b] + 0.5 for b in range(1 << 14)] for n in names])
    log_p -= np.log(np.exp(log_p).sum(axis=1, keepdims=True))
    cache = {}

    def fit(scores, some):
        like = np.exp(scores[:, some] - scores.max(axis=1, keepdims=True))
        pi = np.full(len(some), 1 / len(some))
        for _ in range(20_000):
            r = like * pi
            new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            still, pi = np.abs(new - pi).max() < 1e-9, new
            if still:
                break
        return pi, np.log((like * pi).sum(axis=1)).sum() + scores.max(axis=1).sum()

    got = {r.doc_id: r for r in language_mix.op7_language_mix(spark, sf).collect()}
    for i, (t, _) in docs.items():
        r = got[i]
        assert r.held_out == held[i]
        if not t or not any(c.isalpha() for c in t):
            assert r.lang_pred == "und"
            continue
        words = t.lower().split()
        scores = np.array([cache[w] if w in cache else cache.setdefault(w, log_p[:, grams(w)].sum(axis=1)) for w in words])
        full = fit(scores, list(range(len(names))))[0]
        order = np.argsort(-full, kind="stable").tolist()
        best, value = np.eye(len(names))[order[0]], scores[:, order[0]].sum()
        for m in range(2, len(names) + 1):
            pi, likelihood = fit(scores, order[:m])
            now = likelihood - 2.0 * (m - 1) * np.log(max(2, len(words))) / 2
            if now <= value:
                break
            best, value = np.zeros(len(names)), now
            best[order[:m]] = pi
        assert r.lang_pred == names[int(best.argmax())] and abs(r.score - full[int(best.argmax())]) < 0.02


def test_language_fits_go_on_until_they_stay():
    """Words that three languages share almost evenly: far more than ten rounds are needed, and all that pays is chosen."""
    rng = np.random.default_rng(1)
    like = np.exp(rng.normal(0, 0.2, (3, 4000)))
    like[2, 3950:] *= 40
    scores = np.log(like).astype(np.float32)
    full, best = language_mix.mixtures(scores, np.ones(4000, np.int64), np.array([4000]), 2.0)
    pi, rounds = np.full(3, 1 / 3), 0
    while rounds < 10**5:
        new = pi * (like / (pi @ like)).mean(axis=1)
        still, pi, rounds = np.abs(new - pi).max() < 1e-10, new, rounds + 1
        if still:
            break
    assert rounds > 50 and np.abs(full[0] - pi).max() < 0.02 and np.log(full[0] @ like).sum() > np.log(pi @ like).sum() - 0.05
    # A language that has 1 % of the words pays if these are clear enough.
    clear = np.full((2, 5000), -1.0, np.float32)
    clear[1, :4960], clear[1, 4960:] = -9, 9
    assert (language_mix.mixtures(clear, np.ones(5000, np.int64), np.array([5000]), 2.0)[1][0] > 0).all()


def test_many_languages_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(language_mix, "MAX_LANGUAGES", 3)
    docs = documents(spark, [f"word{i}" for i in range(5)]).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="more than 3"):
        language_mix.train(docs)


def test_memory_with_400_languages():
    """Runs are bounded by words times languages."""
    model = language_mix.Model([f"l{i}" for i in range(400)], np.log(np.random.default_rng(2).dirichlet(np.ones(1 << 14), 400)))
    known = language_mix.Known(model)
    for a in range(0, 12_000, 1000):
        known.lookup([f"w{i}" for i in range(a, a + 1000)])
        assert known.scores.nbytes <= 4 * 2 * (language_mix.REMEMBERED + 2 * 400 * 1000)


def test_language_accuracy(spark):
    got = language_mix.op7_language_mix(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.98 and 0 <= r[1] <= r[2] <= 1
    assert got.count() == docs.count()


def test_language_mixtures(spark):
    de, en = "der die das und nicht ein zug nach bonn ", "the and that with of from there you are "
    docs = documents(spark, [de * 5, en * 5]).withColumn("lang", F.when(F.col("doc_id") == 0, "de").otherwise("en"))
    model = language_mix.train(docs.unionByName(documents(spark, [None, ""])))
    mixed = language_mix.infer(documents(spark, [de * 3 + en * 6, de, *AWKWARD, "123 ... !"]), model).collect()
    assert mixed[0].lang_pred == "en" and set(mixed[0].mixture) == {"de", "en"} and 0.55 < mixed[0].mixture["en"] < 0.8
    assert mixed[1].lang_pred == "de" and set(mixed[1].mixture) == {"de"}
    assert [r.lang_pred for r in mixed if r.text in (None, "", " ", "123 ... !")] == ["und"] * 4
    empty = language_mix.train(docs.where("false"))
    assert {r.lang_pred for r in language_mix.infer(docs, empty).collect()} == {"und"}


# ---- 5

NAMES = ["assign", "access", "hex", "key", "account", "endpoint"]
SPOTS = [
    (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    (re.compile("[A-Za-z0-9+/=_-]+"), None),
    (re.compile(r"""(?i:client_id|user(?:name)?|login|account)["']? *[:=] *["']?[A-Za-z0-9+/_.@-]+""", re.A), lambda m: True),
    (re.compile(r"[a-z][a-z0-9+]{1,10}://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]{2,5})?|(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}:[0-9]{2,5}(?![0-9])"), lambda m: True),
]
COMPLETES = {"key": {"access", "account", "endpoint"}, "account": {"assign", "access", "hex", "key"}, "endpoint": {"assign", "access", "hex", "key"}}


def keys_of(run):
    """40 characters of letters, digits, + and / with a digit and both cases, that fill what lies between other key characters."""
    for m in re.finditer("[A-Za-z0-9+/]+", run[0]):
        x, before, after = m[0], run[0][: m.start()][-1:], run[0][m.end() :][:1]
        if len(x) == 40 and before in ("", "=") and not after and re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x):
            yield run.start() + m.start()


def brute_parts(text):
    parts = []
    for k, (p, good) in enumerate(SPOTS):
        for m in p.finditer(text or ""):
            parts += [(s, k, s + 40) for s in keys_of(m)] if good is None else [(m.start(), k, m.end())] if good(m) else []
    return sorted(parts)


def brute_spans(text, scope=300):
    parts = brute_parts(text)
    near = lambda s, kinds: any(NAMES[o] in kinds and abs(t - s) <= scope for t, o, _ in parts)
    return [p for p in parts if p[1] < 3 or near(p[0], COMPLETES[NAMES[p[1]]])]


def brute_links(text, scope=300):
    spans = brute_spans(text)
    nearest = lambda s, kinds: min(((abs(p[0] - s[0]), p) for p in spans if NAMES[p[1]] in kinds and abs(p[0] - s[0]) <= scope), default=(0, None))[1]
    found = [(s, nearest(s, {"access", "account"}), nearest(s, {"endpoint"})) for s in spans if NAMES[s[1]] in {"assign", "hex", "key"}]
    return [x for x in found if x[1] or x[2]]


def brute_masked(text):
    out, end = "", 0
    for s, k, e in brute_spans(text):
        if s >= end:
            out += text[end:s] + f"[{NAMES[k].upper()}]"
        end = max(end, e)
    return text if text is None else out + text[end:]


KEY = "aB3" * 13 + "x"
SECRETS = [
    "password: hunter22 token=abc secret=token:abcdefg API_KEY = 'abcdef'", f"AKIA{'Z' * 16} then {KEY} at https://db.example.org:8080/x", KEY, "https://lonely.example.org", f"{KEY} {'. ' * 200} login=bob", "user=bob password=\"secret99\" 10.0.0.1:5432",
    "é" * 5 + " PASSWD=äbcdefgh passwd=abcdef0123 " + "0123456789abcdef" * 3, "AKIA AKIAAKIA" + "A" * 11, "Ā𝒳 token = 0123456789abcdef01234567", "token=" + "a" * 100_000, "secret=abcdef " * 300,
]


def test_secrets(spark):
    rng = random.Random(8)
    bits = ["user=b ", "token: ab12cd ", "ab://c ", KEY + " ", "AKIA" + "Q" * 16 + " ", "0a" * 13 + " ", "1.2.3.4:80 ", "x" * 90 + " ", "é " * 40]
    texts = SECRETS + AWKWARD + ["token=abcdef"] * 2 + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + ["user=b " * 400 + "token=abcdef", "ab://c " * 120]
    got = secrets.scan(documents(spark, texts).withColumn("spans", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("row", F.lit(3))).collect()
    assert len(got) == len(texts) and {(r["_row"], r["row"]) for r in got} == {(2, 3)}
    span = lambda s: s and (s["start"], s["kind"], s["end"])
    assert Counter((r.doc_id, tuple(map(span, r.spans))) for r in got) == Counter((i, tuple(brute_spans(t))) for i, t in enumerate(texts))
    for r in got:
        assert [(span(c.secret), span(c.identifier), span(c.endpoint)) for c in r.credentials] == brute_links(texts[r.doc_id])
    assert sum(len(r.credentials) for r in got) > 100
    assert secrets.scan(documents(spark, texts).where("false")).count() == 0


def test_reach_of_the_scope():
    """No text has more parts within the scope than the operator looks at."""
    for text in ("user=b " * 400, "ab://c " * 400, "token=abcdef " * 200, "0123456789abcdef01234567 " * 100):
        starts = [s for s, _, _ in brute_parts(text)]
        assert max(sum(abs(t - s) <= 300 for t in starts) for s in starts) <= 2 * secrets.reach(300)


def test_redaction(spark):
    texts = SECRETS + AWKWARD
    docs = documents(spark, texts).withColumns({"_row": F.lit(1), "_spans": F.lit("x"), "a.b": F.lit(2)})
    got = {r.doc_id: r for r in secrets.redacted(docs, chars="n_chars").collect()}
    for i, t in enumerate(texts):
        assert got[i].text == brute_masked(t) and got[i].n_chars == len(got[i].text or "")
        assert (got[i]["_row"], got[i]["_spans"], got[i]["a.b"]) == (1, "x", 2)
    assert secrets.redacted(docs).columns == docs.columns


def test_redaction_of_shuffled_rows(spark):
    """The same texts come out of a plain scan, a shuffle that is read in pieces, and one partition."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").withColumn("wide", F.repeat("text", 3))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        shuffled, single = ({r.doc_id: r.text for r in secrets.redacted(x).select("doc_id", "text").collect()} for x in (plain.repartition("doc_id"), plain.coalesce(1)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {r.doc_id: brute_masked(r.text) for r in plain.select("doc_id", "text").collect()}
    assert shuffled == want and single == want


def test_secret_digests(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = brute_spans(r.text)
        told = lambda some: ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in some)
        want[r.doc_id] = (*(sum(p[1] == k for p in spans) for k in range(3)), sha(told([p for p in spans if p[1] < 3])), told(spans), len(brute_links(r.text)))
    got = secrets.op5_secret_scan(spark, SF).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_linked) for r in got} == want


def test_keys_after_equals_signs(spark):
    """Pairs without space or quote, as in env files: spans written by hand."""
    access = "AWS_ACCESS_KEY_ID=AKIA" + "Z" * 16
    cases = [
        (f"{access}\naws_secret_access_key={KEY}", [(18, 1, 38), (61, 3, 101)], "AWS_ACCESS_KEY_ID=[ACCESS]\naws_secret_access_key=[KEY]"),
        (f"aws_secret_access_key={KEY}", [], None),
        (f"user=bob\nSECRET_KEY={KEY}\n", [(0, 4, 8), (20, 3, 60)], "[ACCOUNT]\nSECRET_KEY=[KEY]\n"),
        (f"{access} {'.' * 260} k={KEY}", [(18, 1, 38), (302, 3, 342)], f"AWS_ACCESS_KEY_ID=[ACCESS] {'.' * 260} k=[KEY]"),
        (f"{access} {'.' * 300} k={KEY}", [(18, 1, 38)], f"AWS_ACCESS_KEY_ID=[ACCESS] {'.' * 300} k={KEY}"),
        (f"{access} k={KEY}=", [(18, 1, 38)], f"AWS_ACCESS_KEY_ID=[ACCESS] k={KEY}="),
        (f"{access} k=={KEY}", [(18, 1, 38), (42, 3, 82)], "AWS_ACCESS_KEY_ID=[ACCESS] k==[KEY]"),
    ]
    docs = documents(spark, [c[0] for c in cases])
    got = {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}
    assert {r.doc_id: r.text for r in secrets.redacted(docs).collect()} == {i: c[2] or c[0] for i, c in enumerate(cases)}


# ---- 6

def test_tokens_match_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    odd = ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 256), rng.randrange(0x400, 0x500), 0x1F600])) for _ in range(60)) for _ in range(200)]
    texts = AWKWARD + odd + ["\x1c \x1d", "\x85\xa0 x", "I'll don't\r\n  x²½", "<|endoftext|>"]
    docs = documents(spark, texts).withColumn("IDS", F.lit(0))
    two, one = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect(), byte_bpe.round_trip(docs, path).collect()
    for r in [*two, *one]:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(documents(spark, texts).where("false"), path).count() == 0


def test_token_digests(spark):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(r.text or ""))
    got = byte_bpe.op6_byte_bpe(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_every_token_is_reached():
    """Each token's own merges lead to it; ids decode to their bytes."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = byte_bpe.Shared(ranks, public_tokenizers.PATTERN).coder
    ids = np.arange(len(ranks), dtype=np.int32)
    flat, ends = coder.decode(ids, np.arange(len(ranks) + 1))
    blob = flat.tobytes()
    assert [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == sorted(ranks, key=ranks.get)
    merged = coder.sp.encode([byte_bpe.to_piece(t) for t in sorted(ranks, key=ranks.get)], num_threads=1)
    assert merged == [[i] for i in range(len(ranks))]
    with pytest.raises(ValueError):
        coder.decode(np.array([len(ranks)], np.int32), np.array([0, 1]))


# ---- 8

def brute_removed(docs, length):
    seen, out = {}, {}
    for n, (i, t) in enumerate(docs):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            seen.setdefault(b[j : j + length], set()).add(i)
    first = {k: min(v, key=lambda x: (x is None, x)) for k, v in seen.items()}
    for n, (i, t) in enumerate(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            f = first[b[j : j + length]]
            if f != i and f is not None and (i is None or f < i):
                gone[j : j + length] = True
        out[n] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [1000, 2, 0])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_substrings(spark, alphabet, hot):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pieces = [make(n) for n in (30, 49, 50, 51, 70, 120)] + ["\x00" * 60, "日本語" * 9, "\x00nul\x00 日本語 🙂" * 5]
    texts = ["".join(rng.choice([*pieces, make(rng.randrange(40))]) for _ in range(rng.randrange(6))) for _ in range(60)] + [t if t != WIDE else t[:9000] for t in AWKWARD] + [make(400) * 2] * 3
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[0] = None
    ids[5] = ids[6]
    docs = list(zip(ids, texts, strict=True))
    want = Counter((i, *v) for (i, _), v in zip(docs, brute_removed(docs, 50).values(), strict=True))
    got = substring_dedup.deduplicated(documents(spark, texts, ids).repartition(5).withColumn("kept", F.lit(1)), hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_substrings_of_wide_texts(spark):
    texts = [WIDE, WIDE, "x" * 40 + WIDE[:60] + "y" * 40, WIDE[3:]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.deduplicated(documents(spark, texts)).collect()}
    assert got == {0: (150_000, 0, 0, WIDE.encode()), 1: (150_000, 150_000, 1, b""), 2: (140, 60, 1, b"x" * 40 + b"y" * 40), 3: (149_997, 149_997, 1, b"")}


def test_substring_digests(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, gone, spans, sha(kept)) for (i, _), (n, gone, spans, kept) in zip(docs, brute_removed(docs, 50).values(), strict=True)}
    got = substring_dedup.op8_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_copies_do_not_travel_as_text(spark, monkeypatch):
    """Of copies in several chunks only names are sent; of an altered one also what lies about the change."""
    rng, sent = random.Random(5), []
    text = "".join(rng.choice("abcdefghij") for _ in range(4000))
    factors = substring_dedup.factor_rows
    monkeypatch.setattr(substring_dedup, "factor_rows", lambda rows, length: (sent.append(rows), factors(rows, length))[1])
    size = lambda: sum(sum(substring_dedup.unsqueeze(r.size, np.uint8).tolist()) for r in sent[-1].where("p >= 0").collect())
    for texts, most in (([text] * 12, 0), ([text] * 11 + [text[:2000] + "-" + text[2000:]], 2000)):
        got = substring_dedup.deduplicated(documents(spark, texts).repartition(6)).collect()
        want = brute_removed(list(enumerate(texts)), 50)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
        assert size() <= most


def test_substrings_of_nothing(spark):
    assert substring_dedup.deduplicated(documents(spark, ["x"]).where("false")).count() == 0


def test_longest_previous_factors():
    """Values of the array, against every suffix with a smaller id."""
    rng = np.random.default_rng(0)
    for _ in range(30):
        keys, ids = rng.integers(0, 2, (40, 9)).astype(np.uint8), rng.integers(0, 7, 40)
        common = lambda x, y: int((np.cumprod(x == y)).sum())
        want = [max([common(keys[i], keys[j]) for j in range(40) if ids[j] < ids[i]], default=0) for i in range(40)]
        assert substring_dedup.longest_previous(keys, ids).tolist() == want


# ---- 9

def test_quality_rules(spark):
    rng = random.Random(2)
    texts = AWKWARD + [" ".join(rng.choice("a b c") for _ in range(n)) for n in (2, 3, 4, 5, 8, 60)] + ["x y z x y z x y z", "l 1\nl 1\n \nl 1\n\n l 1", "#$% &|< >*"]
    got = quality_rules.ledger(documents(spark, texts).withColumns({"N_Words": F.lit("clash"), "_words": F.lit("mine"), "_LINES": F.lit("too")})).collect()
    for r in got:
        assert (r._words, r._LINES) == ("mine", "too")
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(cover))
        assert bool(r.fail_bits & 1) == (len(w) < 50) and bool(r.fail_bits & 2) == (100 * len(cover) > 50 * len(w))


def test_policies(spark):
    df = quality_rules.ledger(documents(spark, AWKWARD + ["# " * 80, "fine words stand here " * 3 + " ".join(f"w{i}" for i in range(60))]))
    kept = quality_rules.accepted(documents(spark, AWKWARD + [" ".join(f"w{i}" for i in range(60))]))
    assert [r.text[:2] for r in kept.collect()] == ["w0"] and kept.columns[0] == "doc_id"
    a = {(r.policy, r.rule): r for r in quality_rules.ablations(df).collect()}
    bits = [r.fail_bits for r in df.collect()]
    for (v, rule), r in a.items():
        m, b = quality_rules.mask(quality_rules.POLICIES[v]), 1 << quality_rules.BIT[rule]
        assert (r.n_rows, r.n_rejected, r.n_failed, r.n_only_rule, r.n_kept_without) == (len(bits), sum(x & m != 0 for x in bits), sum(x & b != 0 for x in bits), sum(x & m == b for x in bits), sum(x & m & ~b == 0 for x in bits))
    assert quality_rules.ablations(df.where("false")).count() == 0


def test_native_operators_have_no_python(spark):
    for df in (quality_rules.op9_quality_rules(spark, SF), secrets.op5_secret_scan(spark, SF)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- 10

@pytest.mark.parametrize("limit", [1, 40, 500, 1 << 30])
def test_shards_fit(spark, limit):
    texts = AWKWARD + ["t" * (i % 37) for i in range(300)]
    docs = documents(spark, texts).withColumn("shard", F.lit("clash"))
    got = sharding.shard(docs, limit, "doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    size, n = Counter(), Counter()
    for r in got:
        size[r["shard"]] += len((r.text or "").encode())
        n[r["shard"]] += 1
    assert all(size[r["shard"]] == r.shard_bytes and n[r["shard"]] == r.shard_rows for r in got)
    # Beyond the limit there are only single rows (with rows of no bytes).
    for s, total in size.items():
        if total > limit:
            assert sum(1 for r in got if r["shard"] == s and r.text) == 1
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b and "-" not in a and "-" not in b)


def test_equal_rows_take_pages(spark):
    docs = documents(spark, ["x" * 10] * 200, [7] * 200)
    got = sharding.shard(docs, 100, "doc_id").collect()
    assert len(got) == 200 and max(r.shard_bytes for r in got) <= 100
    assert sharding.shard(docs.where("false"), 100, "doc_id").count() == 0


def test_pages_of_a_hot_key(spark):
    """One key with rows of many sizes, some over the limit: pages fit, are well filled, and are stated rightly."""
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 30, 45, 60, 90, 120]) if i % 50 == 0 else rng.randrange(12) for i in range(3000)]
    docs = documents(spark, ["x" * n for n in sizes], [7] * 2900 + list(range(100))).repartition(3)
    got = sharding.shard(docs, 100, "doc_id").collect()
    total = Counter()
    for r in got:
        total[r["shard"]] += len(r.text)
    assert len(got) == 3000 and all(r.shard_bytes == total[r["shard"]] for r in got)
    assert all(r.shard_bytes <= 100 or len(r.text) == r.shard_bytes or not r.text for r in got)
    assert len({r["shard"] for r in got if r.doc_id == 7}) < 1.6 * sum(sizes[:2900]) / 100


def test_shards_with_clashing_names(spark):
    docs = documents(spark, ["aa", None, "b" * 50]).withColumns({c: F.lit(f"own {c}") for c in ("prefix", "entry", "_entry", "_h", "_bytes", "h", "bytes", "row", "depth", "a.b", "rows")})
    got = sharding.shard(docs, 10, "doc_id")
    assert set(got.columns) == {*docs.columns, "shard", "depth", "shard_bytes", "shard_rows"}
    for r in got.collect():
        assert all(r[c] == f"own {c}" for c in ("prefix", "entry", "_entry", "_h", "_bytes", "h", "bytes", "row", "a.b", "rows")) and isinstance(r.depth, int)


# ---- all

def test_shared_folder_is_the_sessions(spark, tmp_path):
    own = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == (own.rstrip("/") if own else common.local_dir())
    df = common.stored(spark.range(3))
    assert df.count() == 3 and all(f.startswith("file:") for f in df.inputFiles())


def test_sessions_without_a_folder():
    class Session:
        """A session whose settings can't be changed and name no folder."""

        def __init__(self, master):
            self.conf, self.sparkContext = SimpleNamespace(get=lambda key, default: default), SimpleNamespace(master=master)

    assert common.shared_dir(Session("local[2]")) == common.shared_dir(Session("local[2]"))
    with pytest.raises(ValueError):
        common.shared_dir(Session("spark://host:7077"))


# ---- names and types


def test_names_with_dots(spark):
    """Operators that add columns by Arrow keep columns of any name."""
    docs = documents(spark, ["one two three four five", None, "x"]).withColumn("a.b", F.col("doc_id") * 2).withColumn("c.d e", F.lit("own"))
    model = language_mix.train(docs)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    import public_tokenizers

    for out in (language_mix.infer(docs, model), byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), quality_model.statistics(docs), decontaminate.find(docs, items)):
        assert {(r["doc_id"], r["a.b"], r["c.d e"]) for r in out.collect()} == {(i, 2 * i, "own") for i in range(3)}


def test_text_ids_are_refused_by_name(spark):
    docs = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    turns = spark.createDataFrame([("x", 0, "user", "hi")], "conv_id string, turn long, role string, text string")
    for run, name in ((lambda: near_dedup.components(docs), "doc_id"), (lambda: near_dedup.deduplicated(docs), "doc_id"), (lambda: substring_dedup.to_chunks(docs, "text"), "doc_id"), (lambda: chat.format_turns(turns), "conv_id")):
        with pytest.raises(TypeError, match=name):
            run()


# ---- 3, templates


def templates(n, own=60, shared=40, words=100, seed=1):
    """Documents of one template: common words, words that all but the smallest share, and words of their own; no two link."""
    rng = random.Random(seed)
    fresh = iter(range(10**9))
    word = lambda: f"t{next(fresh)}x{rng.randrange(1000)}"
    head, more = [word() for _ in range(words)], [word() for _ in range(shared)]
    return [" ".join(head + (more if i else []) + [word() for _ in range(own)]) for i in range(n)]


@pytest.mark.parametrize("n", [200, 400, 800])
def test_templates_meet_seldom(spark, monkeypatch, n):
    """Pair evaluations of documents of a template grow with the documents, not with their square."""
    met = []
    old = near_dedup.meetings

    def counted(*args):
        at = old(*args)
        each = at.groupBy("b", "e").agg(F.count(F.when(F.col("free"), 1)).alias("u"), F.count(F.lit(1)).alias("x"))
        met.append(each.agg(F.coalesce(F.sum(F.col("u") * F.col("x")), F.lit(0))).first()[0])
        return at

    monkeypatch.setattr(near_dedup, "meetings", counted)
    docs = spark.createDataFrame(list(enumerate(templates(n))), "doc_id long, text string")
    got = near_dedup.components(docs, k=1, percent=80).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and met[0] <= 20 * n


@pytest.mark.parametrize("sample", [64, 4])
def test_members_link_past_their_centre(spark, monkeypatch, sample):
    """Near copies of template documents, whose centres link with none of them, at and around the threshold."""
    monkeypatch.setattr(near_dedup, "SAMPLE", sample)
    rng = random.Random(7)
    texts = []
    for i, t in enumerate(templates(24, seed=2)):
        w = t.split()
        texts.append(t)
        for j in range(rng.choice([0, 1, 3])):
            cut = rng.choice([5, 15, 19, 20, 21, 22, 23, 25, 40])
            drop = set(rng.sample(range(len(w)), cut))
            texts.append(" ".join([x for k, x in enumerate(w) if k not in drop] + [f"n{i}y{j}y{k}" for k in range(rng.choice([0, 3, cut]))]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()}
    assert got == components(rows, 1)


def test_a_very_long_conversation(spark):
    """One conversation of 30,000 turns among short ones: streamed in the order of its turns."""
    text = lambda i: f"turn {i} <|im_end|>" if i % 7 else ""
    rows = [(5, i, "assistant" if i % 2 else "user", text(i)) for i in range(30_000)] + [(c, i, "user", "hi") for c in (1, 9) for i in range(2)]
    random.Random(1).shuffle(rows)
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))).collect()}
    own = sorted(r for r in rows if r[0] == 5)
    said = "".join(t for _, _, role, t in own if role == "assistant")
    assert set(got) == {1, 5, 9} and got[5].n_turns == 30_000 and got[5].valid and not got[1].valid
    assert got[5].turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in own)) and (got[5].loss_chars, got[5].loss_sha256) == (len(said), sha(said))
