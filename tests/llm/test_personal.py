"""Personal data against the plain expressions and a plain scoring of patterns."""

import hashlib
import math
import random
import re

import pytest

from lachesis.llm import personal, registry

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_base(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def card(rng, n=16):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next("".join(map(str, d + [c])) for c in range(10) if luhn(d + [c]))


def test_base_spans():
    rng = random.Random(1)
    letters = ["a", "b.c", "@", ".", "-", "_", "+", "%", "1", "22", "255", "256", "4.", " ", "\n", "(", ")", "é", "x@y.z", "+1 555 ", "1.2.3.4", "🙂"]
    for _ in range(20_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        assert personal.base_spans(t) == brute_base(t), t
    for _ in range(500):
        c = card(rng, rng.choice([12, 13, 16, 19, 20]))
        t = f"x {c} " + "-".join(c[i : i + 4] for i in range(0, len(c), 4)) + f" 0{c} +{c[:11]} +1 (555) 0100-{c[:4]} 0001.02.003.255 1.2.3.4.5.6.7.8"
        assert personal.base_spans(t) == brute_base(t), t


def test_long_runs_cost_their_length():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "a." * 150_000 + "@", "1." * 150_000, "+1 " * 100_000, "@b.c" * 80_000):
        personal.base_spans(t)


def brute_find(texts, rounds=3, seeds=5, confident=0.75):
    """Patterns in dictionaries."""
    base = [brute_base(t) for t in texts]
    found = [personal.instances(t or "", b) for t, b in zip(texts, base, strict=True)]
    ext, kinds, of_kind = {}, {}, {}
    for rows in found:
        for kind, _, _, value, patterns in rows:
            for p in patterns:
                ext.setdefault(p, set()).add(value)
                kinds.setdefault((p, value), set()).add(kind)
                if kind:
                    of_kind.setdefault((kind, p), set()).add(value)
    score, start = {}, {}
    for (k, p), v in of_kind.items():
        if len(v) >= seeds and 2 * len(v) >= len(ext[p]):
            start[k, p] = score[k, p] = len(v) / (len(ext[p]) + 1)
    open_ = {(k, p): {v for v in ext[p] if kinds[p, v] == {""}} for k, p in score}
    for _ in range(rounds):
        new = {}
        for k, p in score:
            gain = 0.0
            for v in open_[k, p]:
                doubt = [1 - min(score[k, q], 1 - 1e-9) for (k2, q) in score if k2 == k and q != p and v in open_[k2, q]]
                gain += 1 - math.prod(doubt)
            new[k, p] = (len(of_kind[k, p]) + gain) / (len(ext[p]) + 1)
        score = new
    out = []
    for b, rows in zip(base, found, strict=True):
        more = []
        for kind, s, e, _, patterns in rows:
            best = min(((-round(score[k, p], 9), k) for p in patterns if not kind for k in personal.KINDS if score.get((k, p), 0) >= confident), default=None)
            if best:
                more.append((best[1], s, e))
        order = sorted(b + more, key=lambda x: (personal.KINDS.index(x[0]), x[1], x[2]))
        out.append((b, order))
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registry.queries()["op12_personal_data"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r, (base, every) in zip(rows, brute_find([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert [g[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in base) for k in personal.KINDS]
        assert g.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest() and g.spans == text_of(every)


def corpus():
    rng = random.Random(3)
    texts = [f"Please call me at +1 555 01{i:02d} 77{i:02d} before noon" for i in range(16)]
    texts += [f"my card number: {card(rng)} expires soon" for _ in range(7)]
    texts += [f"written by {'abcdefgh'[i]}x{i}@mail.example.com in spring" for i in range(8)]
    # Unseen: no base expression describes these.
    texts += ["Please call me at 555-0199-22 tomorrow", "my card number: 4111-XXXX-XXXX-1111 expires soon", "written by jo77doe@localhost in spring"]
    # Contexts that seeds and other tokens share, contexts of clean texts, and too few seeds.
    texts += [f"the order {i}99{i}7A5 was sent" for i in range(9)] + [f"the order +1 555 01{i:02d} 66{i:02d} was sent" for i in range(5)]
    texts += ["host is 10.0.0.1 today", "host is 10.0.0.2 today", "host is SRV-00417 today", "page 123456 of 234567", "In 2024 about 1,234,567 people"]
    return texts + [None, "", "é 🙂 call me at 555-0144-77, please", "word " * 20_000 + "call me at 777-0123 now"]


def test_unseen_identifiers_of_known_contexts(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(0, texts[0], "own"), (None, texts[0], None)], "doc_id long, text string, `a.b` string").selectExpr("*", "1 as base", "2 as id", "3 as found", "4 as row", "5 as _")
    out, patterns = personal.find(docs)
    got = {}
    for r in out.collect():
        assert r["a.b"] in ("own", None) and (r.id, r.found, r.row, r["_"]) == (2, 3, 4, 5)
        got.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert all(g == [want[1]] * (2 if i == 0 else 1) for i, want in enumerate(brute_find(texts)) for g in [got[i]])
    gained = {texts[r.doc_id][g.start : g.end]: g.kind for r in out.where("size(gained) > 0").collect() for g in r.gained}
    assert gained == {"555-0199-22": "phone", "4111-XXXX-XXXX-1111": "card", "jo77doe@localhost": "email", "555-0144-77": "phone", "777-0123": "phone"}
    assert {r.pattern for r in patterns.where("score >= 0.75").collect()} >= {"me at _", "card number: _", "written by _"}
    assert not patterns.where("pattern like 'the order%' or pattern like 'host is%'").where("score >= 0.75").count()


def test_masked(spark):
    out, _ = personal.find(spark.createDataFrame([(1, "é a@b.c, +1 555 0100 77 and 1.2.3.4"), (2, None), (3, "x")], "doc_id long, text string"))
    got = {r.doc_id: r.m for r in out.select("doc_id", personal.masked(out["text"], out["spans"]).alias("m")).collect()}
    assert got == {1: "é [email], [phone] and [ip]", 2: None, 3: "x"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_small_tables(spark, rows):
    out, patterns = personal.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.text, r.base, r.spans) for r in out.collect()] == [(*r, [], []) for r in rows] and patterns.count() == 0
