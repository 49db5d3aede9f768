"""The corpus pipeline against plain Python over the smallest tables."""

import re
from pathlib import Path


import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from newsloom.llm import language, toxicity
from newsloom.llm.queries import table, tokenizer_file
from newsloom.llm.sample import held_out, labelled_sample, own_sample
from newsloom.llm.words import utf8

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def sets(text, pattern):
    words = [w for w in re.split(pattern, text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet' ORDER BY doc_id").df()
    texts = lambda: utf8(pa.array(rows.text.tolist(), pa.large_string()))
    taken = labelled_sample(docs, labels, "toxic", ~held_out("doc_id", 3, 1), 1000, 20_000)
    model = toxicity.fit(taken.text.tolist(), (taken.label == "1").to_numpy())
    rows = rows[toxicity.score(model, *texts()) < 0.7]
    mine = docs.join(spark.createDataFrame([(int(i),) for i in rows.doc_id], "doc_id long"), "doc_id", "left_semi")
    taken = own_sample(mine, "lang", ~held_out("doc_id", 4, 2), 500, 20_000)
    model = language.fit(taken.text.tolist(), taken.label.tolist())
    names, _ = language.predict(model, *texts())
    rows = rows[(names != "und") & (language.familiar(model, *texts()) == 1)]
    own = {i: sets(re.sub("[A-Z]", lambda m: m[0].lower(), t), r"[\x20\x09-\x0D]+") for i, t in zip(rows.doc_id, rows.text, strict=True)}
    label = {i: i for i in own}
    for _ in range(20):
        for a in own:
            for b in own:
                if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                    label[a] = label[b] = min(label[a], label[b])
    rows = rows[[label[i] == i for i in rows.doc_id]]
    items = [sets(t.lower(), r"[^\w]+|_") for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    clean = [not any(100 * len(s & sets(t.lower(), r"[^\w]+|_")) >= 80 * len(s) for s in items if s) for t in rows.text]
    return rows[clean]


def test_pipeline_is_that_of_plain_python(spark):
    expected = brute(spark)
    found = corpus_pipeline.run(spark, DATA).toPandas().sort_values("doc_id")
    assert found.doc_id.tolist() == expected.doc_id.tolist() and found.text.tolist() == expected.text.tolist()
    library = Tokenizer.from_file(tokenizer_file())
    for text, ids, lossless in zip(found.text, found.ids, found.lossless, strict=True):
        assert np.array_equal(ids, library.encode(text, add_special_tokens=False).ids) and lossless


def test_stages_take_odd_tables(spark):
    schema = "text string, doc_id long, lang string, source string, n_chars long, label string, score double"
    docs = spark.createDataFrame([(None, 1, None, "s", 0, "l", 1.0), ("", 2, "en", None, 0, "l", 1.0), ("Der eine " * 3_000, None, "de", "s", 1, "l", None), ("a b c d e f", 4, "en", "s", 1, None, 1.0), ("a b c d e f", 4, "en", "s", 1, None, 1.0)], schema)
    for table_ in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table_, DATA)
            assert out.count() <= table_.count(), name
            assert name == "bpe" or out.columns == docs.columns


