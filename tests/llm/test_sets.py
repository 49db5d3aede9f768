"""Centroids, shards and fill-in-the-middle against plain Python; odd rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import centroids, fill_in_middle, sharding
from newsloom.llm.fill_in_middle import Frames


def plain_clusters(rows, k, rounds, dim):
    """rows: (id, whole numbers); the contract by loops."""
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    now = [list(v) for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in rows]

    for _ in range(rounds):
        best = assign()
        for n in range(len(now)):
            members = [v for (_, v), (_, m) in zip(rows, best) if m == n]
            if members:
                now[n] = [sum(v[d] for v in members) // len(members) for d in range(dim)]
    return sorted((i is None, i or 0, n, d) for (i, _), (d, n) in zip(rows, assign())), now


@pytest.mark.parametrize("width, chunk", [(1, 7), (2, 1 << 16), (3, 64)])
def test_clusters_are_those_of_plain_loops(spark, width, chunk):
    draw = random.Random(5)
    vectors = [[draw.randint(-6, 6) / 4 for _ in range(8)] for _ in range(150)]
    vectors += [vectors[0]] * 60 + [[-1e-9] * 8, [0.0] * 8, [400_000.0] * 8, [-400_000.0] * 8]
    rows = list(enumerate(vectors)) + [(None, vectors[3]), (4, vectors[9]), (4, vectors[9])]
    odd = [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [math.nan] + [1.0] * 7), (904, [math.inf] + [1.0] * 7), (905, []), (906, [1e300] * 8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    found, last = centroids.clusters(table, 12, 4, dim=8, width=width, chunk=chunk)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want, now = plain_clusters(whole, 12, 4, 8)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == want and last == now
    closed = centroids.with_inertia(found, last).collect()
    assert {r.inertia for r in closed} == {sum(d for *_, d in want)}
    for r in closed:
        assert r.cluster_inertia == sum(d for *_, n, d in want if n == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, now[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    found, last = centroids.clusters(table, 40, dim=2)
    assert {r.distance for r in found.collect()} == {0} and len(last) == 2 and {r.cluster for r in found.collect()} == {0}
    for empty in (table.limit(0), table.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))):
        found, last = centroids.clusters(empty, 40, dim=2)
        assert centroids.with_inertia(found, last).count() == 0 and last == []


def test_subvector_codes_lose_nothing():
    rows = np.random.default_rng(1).integers(-(1 << 27), 1 << 27, (300, 3))
    rows[100:200] = rows[:100]
    distinct, code = centroids._distinct(rows)
    assert (distinct[code] == rows).all() and len(distinct) == 200


def test_hypergeometric_follows_its_law():
    draws = np.random.default_rng(7)
    for good, bad, n in ((7, 5, 6), (40, 3, 20), (1, 90, 30), (200, 300, 100)):
        seen = Counter(sharding.hypergeometric(draws, good, bad, n) for _ in range(20_000))
        chance = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)}
        assert set(seen) <= set(chance)
        usual = {k: p for k, p in chance.items() if 20_000 * p >= 5}
        assert sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in usual.items()) < 3 * len(usual) + 25
    assert sharding.hypergeometric(draws, 0, 9, 4) == 0 and sharding.hypergeometric(draws, 9, 0, 4) == 4
    large = [sharding.hypergeometric(draws, 10**11, 39 * 10**11, 10**7) for _ in range(300)]
    assert abs(np.mean(large) - 250_000) < 6 * 494 / 300**0.5 and 350 < np.std(large) < 650


def test_matrix_has_its_sums():
    counts = [5, 0, 17, 1, 40, 2]
    table = np.array(sharding.matrix(counts, sharding.sizes(65, 7), 3))
    assert table.sum(1).tolist() == counts and table.sum(0).tolist() == sharding.sizes(65, 7)


def test_every_place_is_equally_likely(spark):
    """Where the first and the last of 12 rows in 5 partitions go, over many seeds."""
    rows = [(i, i % 5) for i in range(12)]
    seen = Counter()
    for seed in range(3_000):
        random_, counts = [], [sum(p == q for _, p in rows) for q in range(5)]
        table = sharding.matrix(counts, sharding.sizes(12, 4), seed, 0)
        for q in range(5):
            labels = np.repeat(np.arange(4), table[q])
            np.random.default_rng([seed, 2, q]).shuffle(labels)
            random_ += zip([i for i, p in rows if p == q], labels.tolist(), strict=True)
        seen.update(random_)
    assert all(abs(seen[i, j] - 750) < 130 for i in range(12) for j in range(4))


@pytest.mark.parametrize("n, shards, block", [(1_003, 40, 10_000), (1_003, 7, 20), (5, 40, 3), (0, 4, 10)])
def test_shards_are_exact_and_whole(spark, n, shards, block):
    rows = [(None if i % 3 else i, "same" if i % 2 else None, f"x{i}") for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, SHARD string").repartition(6)
    out = sharding.shuffled(table, shards, block=block)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    found = out.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in rows)
    assert Counter(r.shard for r in found) == Counter({j: s for j, s in enumerate(sharding.sizes(n, shards)) if s})
    for j in range(shards):
        assert sorted(r.slot for r in found if r.shard == j) == list(range(sharding.sizes(n, shards)[j]))
    again = out.collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_shuffled_order_is_not_that_of_the_rows(spark):
    found = sorted((r.shard, r.slot, r.id) for r in sharding.shuffled(spark.range(0, 4_000, 1, 4), 2, block=100).collect())
    order = np.array([i for *_, i in found])
    assert abs(np.corrcoef(order, np.arange(4_000))[0, 1]) < 0.06
    assert abs((order[1:] > order[:-1]).mean() - 0.5) < 0.04


def plain_middle(ident, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{ident}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or ident is None or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [3, 16, 1 << 16])
def test_fill_in_middle_is_that_of_plain_python(spark, frame):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab \n\né😀<PSM") for _ in range(draw.randint(1, 120))) for _ in range(120)]
    texts += [None, "", "\n", "\n\n", "a", "a\n", "\r\n\x85 x", "has <P> in it", "<M>", "<S", "a\n" * 3_000, "long " * 30_000, "é" * 70_000 + "\nend"]
    rows = [(i, t, "o", 5) for i, t in enumerate(texts)] + [(None, "one\ntwo\n", "o", 5), (3, texts[3], "o", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string, `Units` int").repartition(3)
    out = fill_in_middle.fill_in_middle(fill_in_middle.stored(table, frame=frame), frame=frame, output="output", digests=True)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    found = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored_sha256) for r in out.collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert found == Counter((i, *plain_middle(i, t), sha(t)) for i, t, *_ in rows)
    assert all(r.output_sha256 == sha(r.output) for r in out.collect())
    empty = fill_in_middle.fill_in_middle(fill_in_middle.stored(table.limit(0)), digests=True)
    assert empty.count() == 0


def test_parameters_of_fill_in_middle(spark):
    table = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id long, text string")
    forms = lambda **how: Counter(r.form for r in fill_in_middle.fill_in_middle(fill_in_middle.stored(table), **how).collect())
    assert forms(percent=0) == {"plain": 300} and forms(spm=100) == {"spm": 300} and forms(spm=0) == {"psm": 300}
    assert 100 < forms(percent=50)["plain"] < 200


def test_a_cut_reads_one_frame():
    text = "".join(f"line {i} é\n" for i in range(5_000))
    frames = Frames.pack([text.encode()], 1_000)
    read = []
    whole = frames.piece
    frames.piece = lambda k: read.append(k) or whole(k)
    at, chars = frames.cut(3_217)
    lines = text.splitlines(keepends=True)
    assert at == len("".join(lines[:3_217]).encode()) and chars == len("".join(lines[:3_217])) and len(read) == 1


def test_documents_of_the_queries(spark):
    """crc and size of what arrives are those of the texts."""
    from newsloom.llm.queries import QUERIES, table

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, data, "documents").collect()}
    found = QUERIES["op12_sharding"](spark, data).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    assert set(Counter(r.shard for r in found).values()) == {len(texts) // 40}
