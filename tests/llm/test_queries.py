"""The registered queries and the pipeline on the smallest data set."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from turnscope.llm import decontaminate, minhash, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        order = [want.columns.index(c) for c in columns]
        assert rows == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))
    else:
        assert rows


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decision on planted rows, then the whole run."""
    rng = random.Random(11)
    pool = [f"w{i}x{i * 31 % 97}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [text(30) for _ in range(3)]
    clean = [text(80) for _ in range(60)]
    near = clean[0].split()
    near[40] = "changed"
    rows = clean + [" ".join(near), clean[1].upper(), f"{text(50)} {items[0]} {text(20)}", f"{text(20)} idiot moron scum pathetic {text(20)}", None]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), gone in zip(corpus_pipeline.STAGES[:-1], ({63}, {1}, {60}, {62}), strict=True):
        before = {r["doc_id"] for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).collect(), schema)
        assert before - {r["doc_id"] for r in kept.collect()} == gone
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}


def test_parameters():
    assert (minhash.SHINGLE, minhash.SIMILARITY, toxicity.THRESHOLD) == (5, 0.8, 0.7) and decontaminate.THRESHOLD <= 0.5
    assert len(queries.QUERIES) == 10 and 4 <= len(corpus_pipeline.STAGES) <= 5
