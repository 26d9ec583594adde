"""The pipeline's stages against brute force on a small table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from replisift.llm import oracle as sql
from replisift.llm import packing, toxicity
from replisift.llm.queries import WORDS
from tests import oracle
from tests.llm.test_ngram_join import brute, shingles
from tests.llm.test_toxicity import plainly

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_toxicity_stage(spark, table):
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    score = plainly(model)
    kept = corpus_pipeline.drop_toxic(spark, table, SF)
    assert kept.columns == table.columns
    assert rows(kept) == Counter(tuple(r) for r in table.select(*COLUMNS).collect() if score(r.text.encode()) < 0.3)


def test_quality_stage(spark, table):
    good = {r[0] for r in oracle.connect(SF).execute(f"SELECT doc_id FROM ({sql.QUALITY}) WHERE kept").fetchall()}
    kept = corpus_pipeline.keep_quality(spark, table, SF)
    assert rows(kept) == Counter(tuple(r) for r in table.select(*COLUMNS).collect() if r.doc_id in good)


def test_near_duplicate_stage(spark, table):
    kept = corpus_pipeline.drop_near_duplicates(spark, table, SF)
    texts = [(r.doc_id, r.text) for r in table.collect()]
    want = {c for _, _, c in brute(texts, 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == table.columns
    assert rows(kept) <= rows(table) and len(want) < len(texts)
    assert shingles("a b", 5)


def test_secret_stage(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, table, SF).collect()}
    changed = 0
    for r in table.collect():
        got = out[r.doc_id]
        assert len(got.text) == got.n_chars
        if got.text != r.text:
            changed += 1
            plain = got.text.split("[SECRET]")
            assert re.fullmatch(".+".join(map(re.escape, plain)), r.text, re.S)
    assert changed and len(out) == table.count()


def test_packing_stage(spark, table):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    got = corpus_pipeline.pack(spark, table, SF).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole[r.doc_id] = whole.get(r.doc_id, []) + list(r.ids)
    assert whole == {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in table.collect()}
    assert packing.decompose(2049, 2048) == [2048, 1]


def test_run_is_its_stages(spark, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "packing" or docs.columns == table.columns
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == Counter(map(tuple, docs.select(*key).collect()))


def test_awkward_rows(spark, table):
    rng = random.Random(2)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, words + " x.", "en", "s", 5), (3, words, "en", "s", 9), (3, words, "en", "s", 9), (4, words.upper() + " y", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 1, "k", 2.0) for r in odd], table.schema.simpleString()[7:-1].replace(":", " ") + ", n_tokens int, KEPT_id string, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert "KEPT_id" in docs.columns
    got = docs.collect()
    assert sorted((r.doc_id for r in got), key=str) == [3, None]
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
