"""Held-out accuracy of the trained models, and what they do with odd rows."""

import re
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import language, quality, toxicity
from newsloom.llm.sample import held_out, labelled_sample
from newsloom.llm.words import utf8

DATA = Path("/root/testdata/sf0.1")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def rows():
    sql = f"SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM '{DATA}/documents.parquet' d LEFT JOIN '{DATA}/labels.parquet' l USING (doc_id) ORDER BY doc_id"
    return duckdb.sql(sql).df()


def split(rows, modulus, rest, label):
    crc = np.array([crc32(str(i).encode()) % modulus for i in rows.doc_id])
    known = rows[label].notna() & (rows.text.str.len() <= 20_000)
    return rows[known & (crc != rest)], rows[rows[label].notna() & (crc == rest)]


def column(texts):
    return utf8(pa.array(list(texts), pa.large_string()))


def area(p, y):
    rank = np.empty(len(p))
    rank[np.argsort(p)] = np.arange(len(p))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def balanced(train, label, n):
    import pandas as pd

    return pd.concat([train[train[label] == v].head(n) for v in sorted(train[label].unique())])


def test_toxicity_held_out(rows):
    train, test = split(rows, 3, 1, "toxic")
    train = balanced(train, "toxic", 1000)
    model = toxicity.fit(train.text.tolist(), train.toxic.to_numpy())
    p, y = toxicity.score(model, *column(test.text)), test.toxic.to_numpy()
    insults = test.text.str.lower().str.contains("idiot|clown|moron|scum|pathetic|worthless|loser").to_numpy()
    assert (p[insults] >= 0.7).mean() > 0.93 and (p[(y == 0) & ~insults] < 0.7).mean() > 0.98


def test_language_held_out(rows):
    train, test = split(rows, 4, 2, "lang")
    train = balanced(train, "lang", 500)
    model = language.fit(train.text.tolist(), train.lang.tolist())
    names, score = language.predict(model, *column(test.text))
    assert (names == test.lang.to_numpy()).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_unlearned_languages_are_unfamiliar(rows):
    train, test = split(rows, 4, 2, "lang")
    train = balanced(train, "lang", 500)
    model = language.fit(train.text.tolist(), train.lang.tolist())
    kept = language.familiar(model, *column(test.text))
    assert (np.bincount(test.lang.map(model.languages.index), kept) >= 0.998 * np.bincount(test.lang.map(model.languages.index))).all()
    assert not language.familiar(model, *column(FOREIGN)).any() and (language.predict(model, *column(FOREIGN))[1] >= 0.2).all()
    assert language.familiar(model, *column(["", "a", "12", test.text.iloc[0] * 3, train.text[train.lang == "de"].iloc[0] + train.text[train.lang == "fr"].iloc[0]])).all()


FOREIGN = [
    "Il governo italiano ha annunciato ieri che le nuove misure economiche saranno approvate dal parlamento entro la fine del mese. Secondo il ministro, gli investimenti cresceranno ancora.",
    "Правительство вчера объявило, что новые меры будут утверждены парламентом до конца месяца.",
    "政府昨天宣布新措施将在月底前获得议会批准",
    "Xqzv kjwpt bfgdh qqwrz lkvcx, mnbzp xcvbq wjkqz. Pldkx qzzrt vvbnq wrtpl kjhgz.",
]


def test_pipeline_drops_unlearned_languages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.drop_foreign(spark, docs.union(planted), "").select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.filter("text rlike '\\\\p{L}'").select("doc_id").collect()}
    assert left == lettered


def test_quality_held_out(rows):
    train, test = split(rows, 4, 2, "quality")
    train = balanced(train, "quality", 1000)
    model = quality.fit(train.text.tolist(), train.quality.to_numpy())
    p, y = quality.score(model, *column(test.text)), test.quality.to_numpy()
    assert area(p, y) > 0.97 and (p[y == 1] >= 0.7).mean() > 0.95 and (p[y == 0] >= 0.7).mean() < 0.1


def test_chunks_leave_no_byte_out():
    offsets = np.cumsum([0, 0, 1, 384, 385, 745, 5_000])
    starts, ends, row = quality.chunks(np.zeros(offsets[-1], np.uint8), offsets)
    for r in range(6):
        seen = set()
        for s, e in zip(starts[row == r], ends[row == r], strict=True):
            seen |= set(range(s, min(s + quality.CHUNK, e)))
        assert seen == set(range(offsets[r], offsets[r + 1])) and (row == r).sum() >= 1


def test_scores_do_not_depend_on_neighbours(rows):
    texts = [*rows.text.head(40), "", "x", "ÀÉ", "a" * 50_000]
    model = toxicity.fit(texts, np.arange(len(texts)) % 2)
    network = quality.fit(texts, np.arange(len(texts)) % 2, epochs=1)
    kernel = language.fit(texts, ["a", "b"] * (len(texts) // 2))
    for score in (lambda v, o: toxicity.score(model, v, o), lambda v, o: quality.score(network, v, o), lambda v, o: language.predict(kernel, v, o)[1]):
        together = score(*column(texts))
        assert np.allclose(together, [score(*column([t]))[0] for t in texts], atol=1e-4)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "1234 ?!"), (5, "日本語"), (6, "word " * 30_000), (6, "word"), (None, "Der eine und die andere."), (8, "🙂🙂")]


def test_odd_rows_are_scored(spark):
    docs = spark.createDataFrame([(i, t, "en" if t else None, 5, 7.0) for i, t in ODD], "doc_id long, text string, lang string, predicted int, Score double")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for model, use in ((toxicity.train(docs, labels, F.lit(True)), toxicity.toxicity), (quality.train(docs, labels, F.lit(True)), quality.quality)):
        out = use(docs, model)
        assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
        found = out.collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
        assert use(docs.limit(0), model).count() == 0
    found = language.language(docs, language.train(docs, F.lit(True))).collect()
    assert {r["text"]: r["lang_pred"] for r in found if r["text"] is None or len(r["text"]) < 20} == {None: "und", "": "und", " \n\t": "und", "1234 ?!": "und", "日本語": "en", "word": "en", "🙂🙂": "und"}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, toxicity.train(docs, labels, F.lit(True))).first()["predicted"] == 0
    assert quality.quality(docs, quality.train(docs, labels, F.lit(True))).first()["score"] == pytest.approx(0.5)
    assert language.language(docs, language.train(docs, F.lit(True))).first()["lang_pred"] == "und"


def test_toxic_sentences_are_located(spark):
    bad = [f"The weather in town {k} was fine. You are a good moron and guide! We left at noon" for k in range(40)]
    good = [f"The weather in town {k} was fine. You are a good friend and guide! We left at noon" for k in range(40)]
    model = toxicity.fit(bad + good, np.repeat([1, 0], 40))
    docs = spark.createDataFrame([(1, "All is well. You are a good moron and guide!\nGood bye."), (2, "All is well."), (3, None)], "doc_id long, text string")
    found = toxicity.toxic_sentences(docs, model).collect()
    assert [(r["doc_id"], r["sentence"]) for r in found] == [(1, "You are a good moron and guide!")]


def test_noisy_or_equals_a_plain_loop(spark):
    """Sentences cut by a pattern, words and beginnings one by one; wide sentence ends; the worst sentence."""
    random = np.random.default_rng(3)
    model = toxicity.ToxicityModel(random.normal(0, 2.0, 1 << toxicity.BITS), -1.0, 0.05)
    texts = ["Fine day。Vile moron！ah… so？yes", "one. two three! four\nfive", "", None, "...", "。", "tie tie. tie tie.", "Größe。x" * 50]
    texts += [" ".join(random.choice(["alpha", "beta.", "gamma", "delta!", "omega…", "été。"], 30)) for _ in range(20)]

    def logits(text):
        out = []
        for part in re.findall("[^.?!\n。！？…]*[.?!\n。！？…]|[^.?!\n。！？…]+", text or ""):
            feature, sentence, _, _ = toxicity._bags(*column([re.sub("[。！？…]", " ", part)]))
            if len(feature):
                out.append((part.strip(), model.bias + sum(model.weights[f] for f in feature)))
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.toxicity(rows.repartition(3), model, sentences=True).collect():
        parts = logits(r["text"])
        clean = (1 - model.leak) * np.prod([1 - 1 / (1 + np.exp(-z)) for _, z in parts])
        assert abs(r["score"] - (1 - clean)) < 1e-9
        bad = [(round(z, 9), -i, t) for i, (t, z) in enumerate(parts) if z >= 0]
        assert r["toxic_sentences"] == len(bad)
        assert r["worst_sentence"] == (max(bad)[2].lstrip(".?!。！？… ") if bad else None)


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    taken = [labelled_sample(d, labels, "toxic", ~held_out("doc_id", 3, 1), 20, 100) for d in (docs.coalesce(1), docs.repartition(7))]
    assert taken[0].equals(taken[1]) and taken[0].label.value_counts().to_dict() == {"0": 20, "1": 20}
