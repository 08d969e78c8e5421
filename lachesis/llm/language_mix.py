"""Language identification by a mixture of languages in each document.

Training counts hashed byte trigrams of words for each language over all training rows (`train`): workers add up
counts, Spark sums them by (language, bucket), and a model of languages x BUCKETS log-probabilities results, whatever the
number of rows. Inference (`infer`) lets each word of a document come from one language of the document's mixture, with
the likelihood of its trigrams. Expectation-maximisation estimates the proportions; then languages are added to the set
in the order of their proportions while the likelihood, less `penalty * log(words) / 2` for each proportion that is free,
still grows. The prediction is the most frequent language of the chosen set. Words are parted by white space, so in scripts
without spaces a sentence is one word.

Rounds go on until a document's proportions stay and its likelihood is known to be within TOLERANCE of the largest one: the likelihood
is concave in the proportions, so it lies at most words * log(g) below that, where g is the largest mean, over words, of a
language's likelihood by the mixture's. By the same bound, sets that cannot pay their penalty need no fit: no set of languages is
likelier than the mixture of all of them.

Documents of an Arrow batch are worked on together, in runs of about RUN scores; a text is worked on by its different words and
their counts, so a long one needs memory by its vocabulary. Nothing is shuffled.

Nulls: null texts, and texts without a letter, give `und` and score 0; a model without languages gives `und` too. Null
languages and null texts are not trained on. Repeated rows count as often as they occur in training and are judged
alike. Ties go to the language that is first in alphabetical order. Input columns with the names of added ones are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, stored, table

BUCKETS = 1 << 14
#: More languages than this are refused: the model is collected and broadcast.
MAX_LANGUAGES = 400
#: Scores (a word in a language) that a worker remembers, and scores of texts' different words that it works on at once; different words
#: of a language that training adds up before it counts their trigrams.
REMEMBERED, RUN, COUNTED = 800_000, 600_000, 200_000
#: A fit ends if its likelihood is within TOLERANCE (and the rounding of its words) of the largest and no proportion moves by more than
#: STILL, and in any case after ROUNDS.
TOLERANCE, STILL, ROUNDS = 0.01, 1e-4, 1000
LETTER = regex.compile(r"\p{L}")


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of ` word `, one after another, and how many each word has."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    b = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8)
    inside = np.flatnonzero(b[1:-1] != 32)
    x = b.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[inside]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), np.fromiter(map(len, coded), np.int64, len(coded))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language: languages x words."""
        buckets, n = trigrams(words)
        starts = np.cumsum(n) - n
        return np.add.reduceat(self.log_p[:, buckets], starts, axis=1).astype(np.float32)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Trigram log-probabilities of every language over all rows that have a text and a language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def settle(lang: str) -> None:
            if own := seen.pop(lang, None):
                buckets, n = trigrams(list(own))
                weights = np.repeat(np.fromiter(own.values(), np.float64, len(own)), n)
                sums[lang] = sums.get(lang, 0) + np.bincount(buckets, weights, BUCKETS)

        for batch in batches:
            for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = seen.setdefault(x, Counter())
                own.update(words_of(t))
                if len(own) > COUNTED:
                    settle(x)
        for x in list(seen):
            settle(x)
        for x, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "bucket", "n"])

    def pack(group: pa.Table) -> pa.Table:
        n = np.zeros(BUCKETS)
        n[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table({"lang": group.column("lang").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    counts = rows.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A language has at most BUCKETS counts.
    packed = stored(counts.groupBy("lang").applyInArrow(pack, "lang string, n binary"))
    if packed.select("lang").limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted(packed.collect())
    n = np.array([np.frombuffer(r.n) for r in found]).reshape(len(found), BUCKETS) + smoothing
    return Model([r.lang for r in found], np.log(n / n.sum(axis=1, keepdims=True)))


def mixtures(scores: np.ndarray, times: np.ndarray, kinds: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) with all languages, and with the chosen set, for documents whose different words'
    scores (languages x words) follow one another. times: how often each word comes; kinds: different words of each document. No
    document is empty."""
    k = len(scores)
    top = scores.max(axis=0)
    like = np.exp(scores - top)
    starts = np.cumsum(kinds) - kinds
    sizes = np.add.reduceat(times, starts)
    weight = times.astype(np.float32)
    base = np.add.reduceat(top.astype(np.float64) * times, starts)

    def fit(pi: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions, likelihoods and how far below the largest these may lie, for some documents from a start; languages that
        start at 0 are no part of the mixture."""
        which = np.flatnonzero(docs)
        out, value, gap = np.zeros((k, len(which)), np.float32), np.zeros(len(which)), np.zeros(len(which))
        act, member = np.arange(len(which)), pi > 0
        for r in range(ROUNDS):
            if r == 0 or len(left) < len(act):
                act, pi, member = (act, pi, member) if r == 0 else (act[left], pi[:, left], member[:, left])
                n = kinds[which[act]]
                some = np.repeat(np.isin(np.arange(len(kinds)), which[act]), kinds)
                p, w, begin, size = like[:, some], weight[some], np.cumsum(n) - n, sizes[which[act]]
            mixed = np.maximum((p * np.repeat(pi, n, axis=1)).sum(axis=0), 1e-30)
            g = np.add.reduceat(p * (w / mixed), begin, axis=1) / size
            new = (pi * g).astype(np.float32)
            short = size * np.log(np.maximum(np.where(member, g, 0).max(axis=0), 1))
            done = ((short <= TOLERANCE + 1e-6 * size) & (np.abs(new - pi).max(axis=0) <= STILL)) | (r == ROUNDS - 1)
            if done.any():
                at = act[done]
                out[:, at], gap[at] = pi[:, done], short[done]
                value[at] = np.add.reduceat(np.log(mixed.astype(np.float64)) * w, begin)[done] + base[which[at]]
            left, pi = np.flatnonzero(~done), new
            if not len(left):
                break
        return out, value, gap

    every = np.ones(len(sizes), bool)
    each = np.arange(len(sizes))
    full, most, gap = fit(np.full((k, len(sizes)), 1 / k, np.float32), every)
    full = full.T
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros_like(full)
    best[each, order[:, 0]] = 1
    value = np.add.reduceat(scores[np.repeat(order[:, 0], kinds), np.arange(scores.shape[1])].astype(np.float64) * times, starts)
    due = penalty * np.log(np.maximum(sizes, 2)) / 2
    grows = every
    for m in range(2, k + 1):
        # What no mixture can reach need not be fitted.
        grows = grows & (most + gap - (m - 1) * due > value)
        if not grows.any():
            break
        start = np.zeros((int(grows.sum()), k), np.float32)
        np.put_along_axis(start, order[grows, :m], 1 / m, axis=1)
        pi, likelihood, _ = fit(np.ascontiguousarray(start.T), grows)
        now = likelihood - (m - 1) * due[grows]
        better = now > value[grows]
        at = np.flatnonzero(grows)[better]
        best[at], value[at] = pi.T[better], now[better]
        grows = np.zeros(len(sizes), bool)
        grows[at] = True
    return full, best


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]


class Known:
    """Scores of the words met so far, in one growing array."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.empty((len(self.model.languages), 0), np.float32)
        self.used = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.place) * len(self.scores) > REMEMBERED:
            self.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.place]:
            need = self.used + len(new)
            if need > self.scores.shape[1]:
                grown = np.empty((len(self.scores), 2 * need), np.float32)
                grown[:, : self.used] = self.scores[:, : self.used]
                self.scores = grown
            self.scores[:, self.used : need] = self.model.word_scores(new)
            self.place.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        return self.scores[:, np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def infer(docs: DataFrame, model: Model, text: str = "text", penalty: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """docs[keep] with lang_pred, score (its proportion among all languages) and mixture (the chosen set's proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        model = shared.value
        names = model.languages
        known = model.__dict__.setdefault("known", Known(model))
        out: list[tuple] = [("und", 0.0, [])] * batch.num_rows
        texts = batch.column(text).to_pylist()

        def settle(rows: list[int], words: list[str], times: list[int], kinds: list[int]) -> None:
            if rows:
                full, best = mixtures(known.lookup(words), np.array(times), np.array(kinds), penalty)
                for i, f, b in zip(rows, full.astype(float), best.astype(float), strict=True):
                    x = int(b.argmax())
                    out[i] = (names[x], min(1.0, max(0.0, f[x])), [(names[j], b[j]) for j in np.flatnonzero(b > 0)])

        rows, words, times, kinds = [], [], [], []
        for i, t in enumerate(texts):
            if names and t and LETTER.search(t):
                own = Counter(words_of(t))
                rows.append(i)
                words += own
                times += own.values()
                kinds.append(len(own))
                if len(words) * len(names) > RUN:
                    settle(rows, words, times, kinds)
                    rows, words, times, kinds = [], [], [], []
        settle(rows, words, times, kinds)
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.map_(pa.string(), pa.float64()))]

    return append_arrow(docs, FIELDS, run, keep)


def remainder(n: int):
    """crc32 of doc_id as text (a null one: empty), modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op7_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder(3) != 1))
    return infer(docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


QUERIES = {"op7_language_mix": op7_language_mix}
ORACLES: dict[str, str] = {}
