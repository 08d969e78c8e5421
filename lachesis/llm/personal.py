"""Personal data by bootstrapped contextual extraction.

Seeds are the base matches: e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers, found in whole texts. Seeds induce
lexical patterns: the two words before an entity, or the word before and the word after it. A pattern extracts every
identifier-like token (LEAST letters and digits or more, DIGITS digits or an @) in its place, whatever its kind. Patterns and
instances form a bipartite graph with one edge a pair, which Spark scores in rounds for each kind:

- a pattern's score is the mean score of the different instances it extracts (instances that no base match covers start at 0), with
  SMOOTHING more instances of score 0, so that few instances prove little;
- seeds have score 1; another instance counts for a pattern by a noisy-or over its other patterns, so no pattern supports itself.

Only patterns with SEEDS or more different seeds of a kind, which are at least half of their instances, are scored for it. After the last round, patterns with CONFIDENT or more are
trusted, and tokens in their places become spans of their kind, if no base span overlaps them; of kinds with equal places, the
one with the larger score. So an identifier that no expression describes is found where its context is known, and clean texts, whose
contexts no seeds share, stay alone.

Documents are read once; what is kept of them is spans and the contexts of identifier-like tokens. Patterns and instances are counted
and joined by Spark, and no text is shuffled.

Nulls: a null text is empty. Repeated rows count each for spans; patterns count different instances. Input columns of the names
of added ones are replaced, others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, stored, table, unused, without

KINDS = ["email", "ip", "card", "phone"]
LEAST, DIGITS = 6, 3
SEEDS, ROUNDS, CONFIDENT, SMOOTHING = 5, 3, 0.75, 1.0
#: Longer tokens are no identifiers.
LONGEST = 64

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits before which there is a digit was tried from its start already.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9]\.[0-9]")
DIGIT, TOKEN = re.compile("[0-9]"), re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile("[0-9@]")
NOT_DIGIT = re.compile("[^0-9]+")


def emails(t: str) -> list[tuple[int, int]]:
    """Matches of letters of LOCAL, @ and a domain with a dot: each @ is looked at once, so long runs cost no more than their length."""
    out, after, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > after and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            after = m.end()
        else:
            after = max(after, at)
        at = t.find("@", at + 1 if not m else after)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(t)]
    if DIGIT.search(t) is None:
        return out
    for m in IP.finditer(t) if DOTTED.search(t) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Kept at the ends of context words, since they say what follows; all else at the ends goes, and at the ends of tokens these too.
ENDS = re.compile(r"^[^\w#@]+|[^\w#:=@]+$")
TRIM = re.compile(r"^[^\w+@(]+|[^\w)]+$")


def context_word(w: str) -> str:
    """A word of a context: lower case, numbers as 0, without marks at its ends."""
    return DIGIT.sub("0", ENDS.sub("", w[-LONGEST:].lower()))


def identifier(w: str) -> bool:
    solid = sum(c.isalnum() for c in w)
    return LEAST <= solid and len(w) <= LONGEST and ("@" in w[1:-1] or sum("0" <= c <= "9" for c in w) >= DIGITS)


def instances(t: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, list[str]]]:
    """(kind or "", start, end, value, patterns) of base spans and of identifier-like tokens outside them."""
    if not base and SIGN.search(t) is None:
        return []
    taken, at = sorted((a, b, k) for k, a, b in base), 0
    pieces: list[tuple[int, int, str]] = []
    for m in TOKEN.finditer(t):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        if SIGN.search(t, a, b) is None:
            pieces.append((a, b, "word"))
            continue
        own = TRIM.sub("", t[a:b])
        start = t.index(own, a) if own else a
        pieces.append((start, start + len(own), "" if own and identifier(own) else "word"))
    pieces += taken
    pieces.sort()
    # Tokens in order; a span that lies over several kinds stands once for each.
    word = lambda i: "" if not 0 <= i < len(pieces) else (f"<{pieces[i][2]}>" if pieces[i][2] not in ("word", "") else context_word(t[pieces[i][0] : pieces[i][1]]))
    out = []
    for i, (a, b, kind) in enumerate(pieces):
        if kind != "word":
            before, last, after = word(i - 2), word(i - 1), word(i + 1)
            patterns = ([f"{before} {last} _"] if before and last else []) + ([f"{last} _ {after}"] if last and after else [])
            value = t[a:b][:LONGEST].lower()
            out.append((kind, a, b, value, patterns))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
INSTANCE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))
INSTANCE_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))


def read(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs[keep] with `base` spans and the `found` instances of each whole text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        base, found = [], []
        for i in range(batch.num_rows):
            t = batch.column(text)[i].as_py() or ""
            own = base_spans(t)
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
            found.append([dict(zip(("kind", "start", "end", "value", "patterns"), s, strict=True)) for s in instances(t, own)])
        return [pa.array(base, SPAN_ARROW), pa.array(found, INSTANCE_ARROW)]

    return append_arrow(docs, [T.StructField("base", SPAN), T.StructField("found", INSTANCE)], run, keep)


def scored(edges: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, smoothing: float = SMOOTHING) -> DataFrame:
    """(kind, pattern, score, n_seeds, n_instances) of patterns with enough seeds; edges: different (pattern, value, kind), kind "" for
    an instance that is no seed. Seeds of other kinds are strangers to a kind."""
    n = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n_instances"))
    seeded = edges.where("kind != ''").groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n_seeds")).where(F.col("n_seeds") >= seeds)
    patterns = stored(seeded.join(n, "pattern").where(2 * F.col("n_seeds") >= F.col("n_instances")))
    # Instances of scored patterns: seeds of another kind stay strangers, so only unseeded ones can gain.
    others = edges.withColumn("seed", F.col("kind") != "").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    open_ = stored(others.where("not seed").select("pattern", "value").join(patterns.select("kind", "pattern"), "pattern"))
    now = patterns.withColumn("score", F.col("n_seeds") / (F.col("n_instances") + smoothing))
    for _ in range(rounds):
        doubt = open_.join(now.select("kind", "pattern", "score"), ["kind", "pattern"]).withColumn("log", F.log1p(-F.least(F.col("score"), F.lit(1 - 1e-9))))
        value = doubt.groupBy("kind", "value").agg(F.sum("log").alias("all"))
        gain = doubt.join(value, ["kind", "value"]).groupBy("kind", "pattern").agg(F.sum(1 - F.exp(F.col("all") - F.col("log"))).alias("gain"))
        now = patterns.join(gain, ["kind", "pattern"], "left")
        now = stored(now.select(*patterns.columns, ((F.col("n_seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n_instances") + smoothing)).alias("score")))
    return now.select("kind", "pattern", "score", "n_seeds", "n_instances")


def edges_of(rows: DataFrame) -> DataFrame:
    each = rows.select(F.explode("found").alias("f")).select("f.kind", "f.value", F.explode("f.patterns").alias("pattern"))
    return each.select("pattern", "value", "kind").distinct()


ADDED = ["base", "spans", "gained"]


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, confident: float = CONFIDENT, **options) -> tuple[DataFrame, DataFrame]:
    """(docs[keep] with `base` spans, `gained` spans (with the pattern and score that found each) and `spans`, all of them by kind, then
    start; and the scored patterns)."""
    names = [c for c in without(docs, ADDED).columns if keep is None or c in keep]
    row = unused(docs, "row")
    packed = docs.select(F.struct(F.lit(0).alias(unused(docs, "_")), *[docs[f"`{c}`"] for c in names]).alias(row), docs[f"`{text}`"].alias("text"))
    rows = stored(read(packed, "text", [row]).withColumn("id", F.monotonically_increasing_id()))
    patterns = scored(stored(edges_of(rows)), **options)
    trusted = patterns.where(F.col("score") >= confident).select("kind", "pattern", "score")
    some = rows.select("id", F.explode(F.filter("found", lambda f: f["kind"] == "")).alias("f"))
    some = some.select("id", "f.start", "f.end", F.explode("f.patterns").alias("pattern")).join(trusted, "pattern")
    # The best reading of each place: the largest score, then the order of the kinds' names and patterns.
    place = some.groupBy("id", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind", "pattern")).alias("b"))
    span = F.struct(F.col("b.kind").alias("kind"), "start", "end", F.col("b.pattern").alias("pattern"), (-F.col("b.less")).alias("score"))
    gained = place.groupBy("id").agg(F.sort_array(F.collect_list(span)).alias("gained"))
    out = rows.drop("found").join(gained, "id", "left")
    kind = F.array(*map(F.lit, KINDS))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,pattern:string,score:double>>")
    out = out.withColumn("gained", F.coalesce("gained", none))
    plain = F.transform("gained", lambda g: F.struct(g["kind"].alias("kind"), g["start"].alias("start"), g["end"].alias("end")))
    ordered = F.array_sort(F.transform(F.concat("base", plain), lambda s: F.struct(F.array_position(kind, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    spans = F.transform(ordered, lambda s: F.struct(F.element_at(kind, s["k"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(*[F.col(row)[c].alias(c) for c in names], "base", "gained", spans.alias("spans")), patterns


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(order, start, step, end)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    found, _ = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op12_personal_data": op12_personal_data}
#: Patterns are scored in rounds; tests hold the query to a brute-force version.
ORACLES: dict[str, str] = {}
