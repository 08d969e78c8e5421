"""Secret scans with linking of multipart credentials, by DataFrame functions only.

Base spans (assignments, access keys, long hex runs) are always reported. Weak candidates - key-like tokens, account
names and endpoints - are reported only if a part that completes them starts within SCOPE code points in the same text:
an endpoint or account needs a secret or access key, a key-like token needs an access key, account or endpoint.

Everything happens inside the row by array functions: nothing is shuffled, joined or numbered, so a result can never
land on another row. The interval join works on the parts of one text in order of their starts: matches of one kind don't
overlap and have a least length, so at most `reach` parts start within the scope on either side, and each part meets only
these neighbours. Its records (`credentials`) name, for each secret, the nearest identifier and endpoint within the scope.
Places come from the lengths of the pieces between matches by a two-level running sum. The work of a text is in proportion
to its length and parts.

Nulls: a null text is empty; other columns may hold anything, names that begin with _ included. Repeated rows are scanned
alike. Input columns with the names of added ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

SCOPE = 300


def either(word: str) -> str:
    """A pattern for the word in either letter case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kinds in the order of their numbers: name, pattern, group whose length counts, least length of that, and of a whole match.
KEYWORDS = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
KINDS = [
    ("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24, 24),
    ("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}", 0, 40, 40),
    ("account", rf"""({either("client_id")}|{either("user")}({either("name")})?|{either("login")}|{either("account")})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+""", 0, 1, 6),
    ("endpoint", r"(?:[a-z][a-z0-9+]{1,10}://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]{2,5})?)|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9])", 0, 1, 6),
]
BASE = 3
#: For each weak kind, the kinds that complete it.
COMPLEMENTS = {3: (1, 4, 5), 4: (0, 1, 2, 3), 5: (0, 1, 2, 3)}
#: What a secret, an identifier and an endpoint may be in a record.
SECRET, IDENTIFIER, ENDPOINT = (0, 2, 3), (1, 4), (5,)
SPAN = "struct<start:int,kind:int,end:int>"
CREDENTIAL = f"struct<secret:{SPAN},identifier:{SPAN},endpoint:{SPAN}>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is worked out once, though f names it often."""
    return F.get(F.transform(F.array(x), f), 0)


#: Elements of a block of `running`.
BLOCK = 64


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place, `step` over all values up to it: blocks first, then inside the blocks, so n values cost n * BLOCK
    steps and (n / BLOCK)^2 copies."""

    def inside(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(own, b * BLOCK + 1, F.lit(BLOCK)), zero, step))
        before = F.aggregate(blocks, F.array(zero), lambda a, x: F.array_append(a, step(F.element_at(a, -1), x)))
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return let(before, lambda b: F.transform(own, lambda _, i: F.aggregate(F.slice(own, at(i) * BLOCK + 1, i - at(i) * BLOCK + 1), F.get(b, at(i)), step)))

    return let(values, lambda own: F.when(F.size(own) > 0, inside(own)).otherwise(F.slice(own, 1, 0)))


def matches(text: Column, kind: int) -> Column:
    """The spans of a kind whose length suffices, in order."""
    _, pattern, group, least, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), group), F.length) if group else own
    steps = F.zip_with(F.slice(gaps, 1, F.size(own)), own, lambda g, n: g + n)
    spans = lambda o, c: F.transform(running(steps, F.lit(0), lambda a, x: a + x), lambda e, i: F.struct((e - F.get(o, i)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), F.get(c, i).alias("n")))
    kept = let(F.struct(own.alias("o"), counted.alias("c")), lambda s: F.filter(spans(s["o"], s["c"]), lambda x: x["n"] >= least))
    return F.transform(kept, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def hints(text: Column, low: Column) -> list[Column]:
    """For each kind a cheap test that is true for every text with a match; `low` is the text in lower case."""
    some = lambda x, *words: reduce(or_, [x.contains(w) for w in words])
    given = some(text, ":", "=")
    return [
        given & some(low, "password", "passwd", "secret", "token", "apikey", "api_key"), some(text, "AKIA"), text.rlike("[0-9a-f]{24}"), text.rlike("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}"),
        given & some(low, "client_id", "user", "login", "account"), some(text, "://") | (some(text, ":") & text.rlike(r"[0-9]\.[0-9]{1,3}:[0-9]")),
    ]


def parts(text: Column) -> Column:
    """All candidates of a text in order of their starts: array of start, kind number, end (code points, end exclusive)."""
    none = F.array().cast(f"array<{SPAN}>")

    def found(x: Column) -> Column:
        return F.array_sort(F.concat(*[F.when(h, matches(x["t"], k)).otherwise(none) for k, h in enumerate(hints(x["t"], x["low"]))]))

    body = F.coalesce(text, F.lit(""))
    return let(F.struct(body.alias("t"), F.lower(body).alias("low")), found)


def reach(scope: int) -> int:
    """How many parts at most start within the scope on one side of a part."""
    return sum(scope // shortest + 1 for *_, shortest in KINDS)


def joined(found: Column, scope: int, each: Callable[[Column, Column], Column]) -> Column:
    """each(part, those parts that start within the scope of its start) for every part: the interval join."""
    w = reach(scope)
    near = lambda x, i: F.filter(F.slice(found, F.greatest(F.lit(1), i + 1 - w), F.lit(2 * w + 1)), lambda y: F.abs(y["start"] - x["start"]) <= scope)
    return F.transform(found, lambda x, i: let(near(x, i), lambda n: each(x, n)))


def among(kinds: tuple[int, ...]) -> Callable[[Column], Column]:
    return lambda y: y["kind"].isin(*kinds)


def reported(found: Column, scope: int = SCOPE) -> Column:
    """Base spans, and weak ones that a complement within the scope completes."""

    def told(x: Column, near: Column) -> Column:
        keep = x["kind"] < BASE
        for weak, others in COMPLEMENTS.items():
            keep = keep | ((x["kind"] == weak) & F.exists(near, among(others)))
        return F.struct(x.alias("x"), keep.alias("keep"))

    weak = F.exists(found, lambda x: x["kind"] >= BASE)
    return F.when(weak, F.transform(F.filter(joined(found, scope, told), lambda s: s["keep"]), lambda s: s["x"])).otherwise(found)


def linked(spans: Column, scope: int = SCOPE) -> Column:
    """A record for each reported secret with an identifier or endpoint within the scope: the nearest of either kind, the
    earlier one of two equally near."""

    def nearest(x: Column, near: Column, kinds: tuple[int, ...]) -> Column:
        return F.array_min(F.transform(F.filter(near, among(kinds)), lambda y: F.struct(F.abs(y["start"] - x["start"]).alias("d"), y.alias("y"))))["y"]

    def record(x: Column, near: Column) -> Column:
        return F.struct(x.alias("secret"), nearest(x, near, IDENTIFIER).alias("identifier"), nearest(x, near, ENDPOINT).alias("endpoint"))

    full = lambda r: r["secret"]["kind"].isin(*SECRET) & (r["identifier"].isNotNull() | r["endpoint"].isNotNull())
    several = F.exists(spans, among(IDENTIFIER + ENDPOINT))
    return F.when(several, F.filter(joined(spans, scope, record), full)).otherwise(F.array().cast(f"array<{CREDENTIAL}>"))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with `spans` (array of start, kind number, end, in that order, of all reported spans) and `credentials` (array
    of secret, identifier, endpoint)."""
    out = ["spans", "credentials"]
    names = without(docs, out).columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), parts(docs[f"`{text}`"]).alias("found"))
    rows = rows.select("row", reported(F.col("found"), scope).alias("spans"))
    return rows.select(*[F.col("row")[c].alias(c) for c in names], "spans", linked(F.col("spans"), scope).alias("credentials"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, overlapping spans by the first one's."""
    names = F.array(*[F.lit(f"[{k[0].upper()}]") for k in KINDS])

    def put(s: Column, ends: Column) -> Column:
        # The furthest end of the spans before each one.
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        piece = lambda x, b: F.when(x["start"] >= b, F.concat(F.substring(text, b + 1, x["start"] - b), F.get(names, x["kind"]))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(s, lambda x, i: piece(x, before(i))), ""), F.substring(text, F.element_at(ends, -1) + 1, F.lit(2147483647)))

    furthest = lambda s: running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(furthest(s), lambda e: put(s, e)))).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", scope: int = SCOPE, chars: str | None = None) -> DataFrame:
    """docs with each reported span replaced by its kind in brackets; `chars` names a column that holds the text's length.
    Texts without spans stay as they are, and null ones null."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), docs[f"`{text}`"].alias("text"), parts(docs[f"`{text}`"]).alias("found"))
    rows = rows.select("row", "text", reported(F.col("found"), scope).alias("spans"))
    rows = rows.select("row", (F.size("spans") > 0).alias("hit"), masked(F.col("text"), F.col("spans")).alias("new"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("new").alias(c)
        own = F.col("row")[c]
        return (F.when(F.col("hit"), F.length("new").cast(docs.schema[c].dataType)).otherwise(own) if c == chars else own).alias(c)

    return rows.select(*[column(c) for c in names])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans, and how many secrets are linked with an identifier or endpoint."""
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans", "credentials")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return df.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("credentials").cast("long").alias("n_linked"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
