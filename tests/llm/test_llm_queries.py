"""Registered queries against DuckDB, and the pipeline against a brute-force version of its stages."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lachesis.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "conversations", "embeddings"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, con, name):
    ours, theirs = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracles()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    rows = lambda df: Counter(tuple(map(str, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)


def test_every_row_comes_back(spark):
    for n in (*range(1, 11), 12):
        name = next(x for x in registry.queries() if x.startswith(f"op{n}_"))
        df = registry.queries()[name](spark, SF)
        table = "conversations" if n == 2 else "documents"
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        assert df.count() == (rows.select("conv_id").distinct().count() + 1 if n == 2 else rows.count())


def test_pipeline(spark, con):
    """Stage by stage in plain Python: rules, groups, benchmark, secrets, tokens."""
    import public_tokenizers
    import tiktoken
    from lachesis.llm import byte_bpe
    from test_operators import brute_hits, brute_masked, components

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = set(con.sql(f"SELECT doc_id FROM ({registry.oracles()['op9_quality_rules']}) WHERE kept").df()["doc_id"])
    docs = {i: t for i, t in docs.items() if i in kept}
    comp = components(list(docs.items()), 5)
    docs = {i: t for i, t in docs.items() if comp[i] == i}
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    hits = {i: brute_hits(t, items) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    docs = {i: brute_masked(t) for i, t in docs.items()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.TOKENIZER), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(docs)
    assert all(got[i]["ids"] == enc.encode_ordinary(t) and got[i].round_trip for i, t in docs.items())


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, repeated rows, a very long text and columns with the names that stages use inside."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i}" for i in range(40_000))
    body = " ".join(f"v{i}" for i in range(70))
    rows = [(1, body, "en", "s", 5), (1, body, "en", "s", 5), (None, body, None, None, None), (2, None, "de", "s", 0), (3, "", None, "t", None), (4, long, "en", "s", len(long)), (5, long + " end", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("_row", "row", "kept", "spans", "n_words", "component_id", "id", "_gone", "hit", "items", "h", "a.b")})
    want = {"quality rules": [1, 1, 4, 5, None], "MinHash near-dedup": [1, 2, 3, 4, None, None], "benchmark decontamination": [1, 1, 2, 3, 4, 5, None, None], "secret scans": [1, 1, 2, 3, 4, 5, None, None]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == want[name]
        assert all(r[c] == f"own {c}" for r in got for c in ("_row", "row", "kept", "spans", "id", "hit", "a.b"))
        assert {r.text for r in got} <= {r[1] for r in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(rows) and all(r.round_trip for r in last)


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "lachesis"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", p.read_text(), re.M)
