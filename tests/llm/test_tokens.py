"""BPE against the tokenizers library, and Pitman-Yor scores against plain counting."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import bpe, pitman_yor
from newsloom.llm.pitman_yor import STRENGTH, Chain, Totals, pitman_yor_scores, seat
from newsloom.llm.queries import tokenizer_file
from newsloom.llm.sample import held_out
from newsloom.session import arrow_bytes

TEXTS = [
    "", " ", "a", "Hello world", "aaaaaaa aaaa", "don't I'LL we're 's", "x" * 3000, "tab\tand\n\n  lines \r\n end ",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "été Ünïcode ß ÀÉ½²", "日本語テキスト 🙂🙂 עברית", "​ 　\x85x",
    "1234567 8,9.0", "  leading", "trailing  ", "ᾴ combining", "Ⅷ ٣ ² ½",
]


@pytest.fixture(scope="module")
def model():
    return bpe.load(tokenizer_file())


def test_ids_and_text_are_those_of_the_library(model):
    library = Tokenizer.from_file(tokenizer_file())
    for text, ids in zip(TEXTS, model.encode(TEXTS), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert model.decode(ids) == library.decode(expected, skip_special_tokens=False) == text


def test_any_ids_decode_like_the_library(model):
    library = Tokenizer.from_file(tokenizer_file())
    random = np.random.default_rng(3)
    for _ in range(200):
        ids = random.integers(0, 50_257, 20)
        assert model.decode(ids.astype("<u4").tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_memory_may_be_small(model):
    short = bpe.load(tokenizer_file())
    short.held = 2
    for _ in range(2):
        assert [short.encode([t])[0] for t in TEXTS] == model.encode(TEXTS)


def test_rows_keep_their_columns(spark, model):
    rows = [(i, t, "x", -1) for i, t in enumerate([*TEXTS, None, "Hello world"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    out = {r["doc_id"]: r for r in bpe.with_tokens(docs, model, ids="ids", decoded="decoded", digests=True).collect()}
    assert len(out) == len(rows)
    for i, text, _, _ in rows:
        assert out[i]["decoded"] == (text or "") and out[i]["n_tokens"] == len(out[i]["ids"])
        assert out[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(out[i]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.with_tokens(docs.limit(0), model, ids="ids").count() == 0


def test_seats_follow_the_posterior():
    random = np.random.default_rng(1)
    drawn = seat(np.full(40_000, 3), np.full(40_000, 0.5), 0.3, random)
    one, two, three = (1 - 0.3) * (2 - 0.3) * 0.5, (1 - 0.3 + 2 - 0.6) * 0.25, 0.125
    expected = np.array([one, two, three]) / (one + two + three)
    assert np.abs(np.bincount(drawn, minlength=4)[1:] / len(drawn) - expected).max() < 0.01
    many = seat(np.array([0, 1, 5_000]), np.array([1.0, 1.0, 3.0]), 0.5, random)
    assert many[0] == 0 and many[1] == 1 and 1 < many[2] <= 5_000


def test_predictions_sum_to_one():
    word, context = np.divmod(np.arange(12), 3)
    chain = Chain(word, context, np.array([5, 0, 1, 30, 2, 0, 1, 1, 1, 0, 0, 7]), 4)
    state = lambda: Totals(np.bincount(context, chain.customers), np.bincount(context, chain.tables), chain.parent_customers.sum(), chain.parent_tables.sum(), 4, 48, 0.6, 0.4)
    for sweep in range(3):
        totals = state()
        p = chain.probability(totals).reshape(4, 3)
        new = (STRENGTH + totals.parent_discount * totals.parent_tables) / (totals.known + 1) / (totals.parent_customers + STRENGTH)
        unknown = (STRENGTH + totals.discount * totals.tables) / (totals.customers + STRENGTH) * new
        assert np.allclose(p.sum(0) + unknown, 1)
        chain.sweep(totals, np.random.default_rng(sweep))


def plain(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = [i is None or crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in words(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))
    return [(i, h, len(words(t)), sum(count[w] > 0 for w in words(t)), n, base(t)) for (i, t), h in zip(rows, held, strict=True)]


def test_scores_on_odd_rows(spark):
    random = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda: " ".join(random.choice(vocabulary, 60, p=np.arange(300, 0, -1) / 45_150))
    rows = [(i, text()) for i in range(120)] + [(200, None), (201, ""), (202, "Only New WORDS"), (203, "w1 " * 4_000), (7, "again w1"), (7, "again w1"), (None, "w2 w3")]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, key string")
    out = pitman_yor_scores(docs, held_out("doc_id", 10, 0)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    found = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in out), key=order)
    for a, b in zip(found, sorted(plain(rows), key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    held = [r for r in out if r["held_out"]]
    assert all(r["score"] < 0 for r in out) and sum(r["score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = pitman_yor_scores(docs, held_out("doc_id", 10, 0)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert abs(row["base_score"]) < 1e-9 and abs(row["score"]) < 1e-9
    assert pitman_yor_scores(docs.limit(0), held_out("doc_id", 10, 0)).count() == 0


def test_sums_of_16_million_tokens_are_one_task(spark):
    """A task sends a row per document it meets, so the tasks decide how much moves."""
    table = spark.createDataFrame([], "bucket int, hashes binary, contexts binary, keys binary, pairs binary, counts binary")
    sums = pitman_yor._far_sums(table.repartition(8), 0, [], 16_000_000, 4)
    assert "Repartition 1, false" in sums._jdf.queryExecution().optimizedPlan().toString() and sums.count() == 0


def test_sweeps_read_pairs_without_the_tokens(spark):
    """A bucket's row has its tokens once, as document keys; a sweep does without them."""
    rows = [(f"w{k % 7} w{k % 3} w1 w1", k % 4 != 0, k) for k in range(40)]
    docs = spark.createDataFrame(rows, "text string, train boolean, key long")
    vocabulary = pitman_yor.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    table = pitman_yor._occurrences(docs, vocabulary, 3).localCheckpoint()
    found = {r["bucket"]: [np.frombuffer(r[c], k) for c, k in (("sizes", np.uint32), ("customers", np.uint32), ("keys", np.int64))] for r in table.collect()}
    assert sum(sizes.sum() for sizes, _, _ in found.values()) == 40 * 5 and sum(customers.sum() for _, customers, _ in found.values()) == 30 * 5
    assert all(len(keys) == sizes.sum() for sizes, _, keys in found.values())
    assert sorted(Counter(np.concatenate([keys for _, _, keys in found.values()]).tolist()).items()) == [(k, 5) for k in range(40)]
    first = pitman_yor._sweep_totals(table.drop("keys", "sizes"), 0, [])
    assert (first.tokens, first.known, first.customers.tolist()) == (150, 8, [150.0])


def test_arrow_batches_are_bounded_and_the_setting_given_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    long = spark.range(12).coalesce(1).select(F.repeat(F.lit("x"), 1_000_000).cast("binary").alias("x"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with arrow_bytes(spark, 2 << 20):
        assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) < 4_000_000
        with arrow_bytes(spark, 64 << 20):  # a smaller bound stays
            assert spark.conf.get(name) == str(2 << 20)
    assert spark.conf.get(name) == before and name not in spark.conf.getAll


def test_scores_run_in_small_batches(spark, monkeypatch):
    """Jobs on bucket rows run under the bound; the result needs none of them again."""
    name, found = "spark.sql.execution.arrow.maxBytesPerBatch", []
    for function in ("_sweep_totals", "_far_sums"):
        whole = getattr(pitman_yor, function)
        monkeypatch.setattr(pitman_yor, function, lambda *a, whole=whole: (found.append(spark.conf.get(name)), whole(*a))[1])
    docs = spark.createDataFrame([(k, "a b c") for k in range(20)], "doc_id long, text string")
    out = pitman_yor_scores(docs, held_out("doc_id", 10, 0))
    assert set(found) == {str(pitman_yor._BATCH_BYTES)} and "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 20


def pairs(rows):
    """(score of each text) where every pair of words has one table: discounts from counts, no draws."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t) + [None]
    steps = lambda t: list(zip([None] + words(t)[:-1], words(t), strict=True))
    held = [crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(x for (_, t), h in zip(rows, held, strict=True) if not h for x in steps(t))
    customers, tables, parent = Counter(), Counter(), Counter()
    for (u, w), n in count.items():
        customers[u], tables[u], parent[w] = customers[u] + n, tables[u] + 1, parent[w] + 1
    discount = lambda ns: (lambda a, b: min(max(a / (a + 2 * b), 0.05), 0.95) if a else 0.5)(sum(n == 1 for n in ns), sum(n == 2 for n in ns))
    d, d0 = discount(count.values()), discount(parent.values())
    total, known = sum(parent.values()), len(parent)
    base = lambda w: (parent[w] - d0 * (parent[w] > 0) + (STRENGTH + d0 * known) / (known + 1)) / (total + STRENGTH)
    p = lambda u, w: (count[u, w] - d * (count[u, w] > 0) + (STRENGTH + d * tables[u]) * base(w)) / (customers[u] + STRENGTH)
    return [sum(math.log10(p(u, w)) for u, w in steps(t)) for _, t in rows]


@pytest.mark.parametrize("share", [1 / 400_000, 1 / 25, 1.0])
def test_every_word_is_a_context_of_its_own(spark, monkeypatch, share):
    """Whether words have numbers or not, and however their pairs lie in buckets."""
    random = np.random.default_rng(5)
    text = lambda: " ".join(f"w{k}" for k in np.minimum(random.zipf(1.4, 25), 90))
    rows = [(i, text()) for i in range(80)] + [(100, ""), (101, "new w1 new w2"), (102, "w1 w2 " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SWEEPS", 0), ("LOCAL_SHARE", share), ("TOKENS_PER_BUCKET", 150), ("TOKENS_PER_PACK", 200), ("TOKENS_PER_SUM", 500)):
        monkeypatch.setattr(pitman_yor, name, value)
    found = {r["doc_id"]: r["score"] for r in pitman_yor_scores(docs, held_out("doc_id", 10, 0)).collect()}
    for (i, _), score in zip(rows, pairs(rows), strict=True):
        assert math.isclose(found[i], score, rel_tol=1e-9)


def test_rare_words_predict_what_follows_them(spark, monkeypatch):
    """No word is frequent and each is always followed by the same one; so it is after sweeps, with and without numbers."""
    random, sums = np.random.default_rng(6), []
    text = lambda: " ".join(f"{a} x{a}" for a in random.choice(np.arange(400), 20, replace=False))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(pitman_yor, "TOKENS_PER_BUCKET", 2_000)
    for share in (1 / 400_000, 1 / 100):
        monkeypatch.setattr(pitman_yor, "LOCAL_SHARE", share)
        held = [r for r in pitman_yor_scores(docs, held_out("doc_id", 10, 0)).collect() if r["held_out"]]
        assert len(held) > 5
        sums.append([sum(r[c] for r in held) for c in ("score", "base_score")])
        assert sums[-1][0] > 0.75 * sums[-1][1]
    assert math.isclose(sums[0][0], sums[1][0], rel_tol=0.02) and math.isclose(sums[0][1], sums[1][1], rel_tol=1e-9)


def test_a_bucket_row_is_whole_whatever_its_parts():
    random = np.random.default_rng(7)
    hashes, rows = random.integers(1, 40, 5_000).astype(np.uint64), np.sort(random.integers(0, 60, 5_000))
    vocabulary = pitman_yor.Vocabulary(np.arange(1, 20, dtype=np.uint64), np.arange(19), 19)
    keys, train = random.integers(-(1 << 62), 1 << 62, 60), random.random(60) < 0.5
    hashes[np.append(rows[1:] != rows[:-1], True)] = pitman_yor._end_hash()
    before = pitman_yor._in_context(hashes, rows, pitman_yor._end_hash())
    code = lambda h: int(h) - 1 if h < 20 else int(h) | 1 << 63
    expected = Counter((code(w), code(u), int(keys[r]), bool(train[r])) for w, u, r in zip(hashes, before, rows, strict=True))
    found: Counter = Counter()
    parts: dict[int, list[bytes]] = {}
    for a, b in ((0, 17), (17, 60)):
        some = (rows >= a) & (rows < b)
        for k, part in pitman_yor._parts(hashes[some], rows[some] - a, train[a:b], keys[a:b], vocabulary, 7):
            parts.setdefault(k, []).append(part)
    trained = 0
    for k in parts:
        row = dict(zip(("words", "begins", "contexts", "customers", "sizes", "keys"), pitman_yor._merged(parts[k]), strict=True))
        assert (pitman_yor._merged(parts[k][::-1])[2] == row["contexts"]).all()
        words = row["words"][np.cumsum(row["begins"]) - 1]
        assert len(set(zip(words.tolist(), row["contexts"].tolist(), strict=True))) == len(words)
        by_key = dict(zip(keys.tolist(), train.tolist(), strict=True))
        found.update((w, u, key, by_key[key]) for w, u, key in zip(np.repeat(words, row["sizes"]).tolist(), np.repeat(row["contexts"], row["sizes"]).tolist(), row["keys"].tolist(), strict=True))
        trained += int(row["customers"].sum())
    assert found == expected and trained == train[rows].sum()
