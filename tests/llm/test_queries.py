"""The numbered queries on the smallest tables: against their SQL, else against plain versions; and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import queries
from sightline.llm.pii import all_spans, base_spans, masked, trained_tagger
from sightline.llm.quality_rules import QualityRules, judge
from tests.llm import helpers as plain
from tools.check import TABLES

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_matches_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_op2(spark, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = [f"{k}:{a}:{b}" for k, a, b in plain.personal_data(t or "")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}


def test_op6(spark, db, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_rules"](spark, SF).collect()}
    for i, t in texts.items():
        want = plain.quality_counts(t)
        assert {k: got[i][k] for k in want} == want
    # Labelled documents of good quality that pass the base rules are kept, those of bad quality are not.
    for i, good in db.execute("SELECT doc_id, quality FROM labels").fetchall():
        assert got[i]["kept"] == bool(good and not got[i]["base_failed"])


def test_op9(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_ngram_join"](spark, SF).collect()}
    assert got == plain.near_groups(texts)


def test_op10_and_op3(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    for r in queries.QUERIES["op10_bpe"](spark, SF).collect():
        want = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for r in sorted(queries.QUERIES["op3_token_files"](spark, SF).collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"]) == (start, len(ids[r["doc_id"]]) + 1)
        start += r["n_tokens"]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    items = {0: plain.prose(rng, 30), 1: plain.prose(rng, 14)}
    texts = [". ".join(plain.prose(rng, 12) for _ in range(8)) + "." for _ in range(12)]
    texts += [texts[0], texts[1].replace(texts[1].split()[5], "other", 1), f"{texts[2]} {items[0]}", f"{texts[3]}\n{plain.prose(rng, 40)} me@mail.example.com"]
    texts += [None, "", "too short", " ".join(w + "###" for w in texts[4].split()), "Home | About | Jobs\n" + plain.prose(rng, 60), texts[0]]
    df = plain.documents(spark, texts, extra=True)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "personal_data", "bpe"]

    left = {i: v["clean"] for i, t in enumerate(texts) if (v := judge(t or "", QualityRules()))["kept"]}
    groups = plain.near_groups(left)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    hit = plain.contamination(left, items)
    left = {i: t for i, t in left.items() if not hit[i][1]}
    tagger = trained_tagger(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    assert base_spans(left[15])
    left = {i: masked(t, all_spans([t], tagger)[0][1]) for i, t in left.items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    assert got == {i: (len(x), x) for i, x in want.items()}
    assert 12 not in got and 13 not in got and 14 not in got and 16 not in got

    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns


def test_pipeline_on_an_empty_table(spark, tmp_path):
    plain.documents(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
