import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import vectors
from newsloom.operators import similarity, stories
from newsloom.streaming import stories as streamed

START = datetime(2024, 3, 1)
SCHEMA = (
    "corpus_id int, item_id int, published_at timestamp, publisher_key string, headline array<double>, body array<double>, actions array<string>"
)
HOUR = 3600


def angle(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def rows(n=90):
    out = []
    for i in range(n):
        at = START + timedelta(hours=(i * 5) % 301 + (400 if i % 10 == 9 else 0))
        turn = (i % 6) * 50 + (i * i % 13)
        body = None if i % 7 == 0 else angle(turn + i % 5)
        out.append((i % 2, i, at, f"p{i % 4}", angle(turn), body, ["approve"] if i % 8 == 0 else ["reject"] if i % 8 == 1 else []))
    return out


def one_value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_cosine_and_running_mean(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.expr("cast(array() as array<double>)")
    assert one_value(spark, vectors.cosine(arr(1, 0), arr(1, 0))) == 1
    assert one_value(spark, vectors.cosine(arr(1, 0), arr(0, 1))) == 0
    assert one_value(spark, vectors.cosine(arr(1), arr(1, 0))) is None
    assert one_value(spark, vectors.cosine(arr(0, 0), arr(1, 0))) is None
    assert one_value(spark, vectors.running_mean(arr(1, 0), arr(0, 1), F.lit(1))) == [0.5, 0.5]
    assert one_value(spark, vectors.running_mean(arr(), arr(0.2, 0.8), F.lit(0))) == [0.2, 0.8]


@pytest.mark.parametrize(
    "centroid, representative, recent, own, theirs, want",
    [
        (1.0, 1.0, 1.0, "announce", "announce", "accepted"),
        (0.91, 0.73, 0.75, "announce", "announce", "rejectedRepresentativeSimilarity"),
        (0.90, 0.90, 0.90, "approve", "reject", "rejectedActionMismatch"),
        (0.99, 0.99, 0.99, "approve", "reject", "accepted"),
        (0.87, 0.87, (0.92 + 0.71) / 2, None, None, "accepted"),
        (0.80, 0.99, 0.99, None, None, "rejectedCentroidSimilarity"),
    ],
)
def test_gate(spark, centroid, representative, recent, own, theirs, want):
    terms = lambda t: F.array(F.lit(t)) if t else F.expr("cast(array() as array<string>)")
    got = vectors.gate_decision(F.lit(centroid), F.lit(representative), F.lit(recent), terms(own), terms(theirs), 0.82)
    assert one_value(spark, got) == want


def naive(spark, frame, threshold, window):
    """Assignment by plain loops over collected rows."""
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    result = {}
    by_corpus = {}
    for r in sorted(frame.collect(), key=lambda r: (r.published_at, r.item_id)):
        open_stories = by_corpus.setdefault(r.corpus_id, [])
        open_stories[:] = [s for s in open_stories if (r.published_at - s["at"]).total_seconds() <= window]
        best, best_cos = None, None
        for s in open_stories:
            c = cos(r.combined, s["centroid"])
            rep = cos(r.combined, s["members"][0])
            recent = [cos(r.combined, m) for m in s["members"][-3:]]
            clash = r.actions and s["actions"] and not set(r.actions) & set(s["actions"])
            ok = c >= threshold and not (clash and rep < 0.985) and rep >= threshold - 0.055
            ok = ok and sum(recent) / len(recent) >= threshold - 0.055
            if ok and (best is None or c > best_cos):
                best, best_cos = s, c
        if best is None:
            best = {"id": f"story-{r.item_id}", "members": [], "actions": r.actions}
            open_stories.append(best)
        best["members"].append(list(r.combined))
        best["at"] = r.published_at
        n = len(best["members"])
        best["centroid"] = [sum(m[d] for m in best["members"]) / n for d in range(len(r.combined))]
        result[r.item_id] = best["id"]
    return result


@pytest.mark.parametrize("batch", [4, 11, 5000])
def test_assignment_equals_plain_loop(spark, batch):
    """However many rows of a shard come at a time."""
    frame = stories.with_vectors(spark.createDataFrame(rows(), SCHEMA))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {r.item_id: r.story_id for r in stories.assign_stories(frame, 0.95, 72 * HOUR).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == naive(spark, frame, 0.95, 72 * HOUR)
    assert 1 < len(set(found.values())) < len(found)


def test_window_edge_is_inside(spark):
    base = [(0, 1, START, "p", angle(0), None, []), (0, 2, START + timedelta(hours=72), "q", angle(0), None, [])]
    late = [base[0], (0, 2, START + timedelta(hours=72, seconds=1), "q", angle(0), None, [])]
    for data, groups in [(base, 1), (late, 2)]:
        frame = stories.with_vectors(spark.createDataFrame(data, SCHEMA))
        assert len({r.story_id for r in stories.assign_stories(frame, 0.82, 72 * HOUR).collect()}) == groups


@pytest.mark.parametrize("lateness", [0, 60])
def test_stream_out_of_order_equals_batch(spark, tmp_path, lateness):
    """Three batches, up to 50 hours out of order: waited for, nothing is late; not waited for, what is late has no story."""
    frame = stories.with_vectors(spark.createDataFrame(rows(60), SCHEMA)).cache()
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    hours = F.floor((F.unix_seconds("published_at") - F.unix_seconds(F.lit(START))) / HOUR) + F.col("item_id") * 13 % 50
    marks, late = None, set()
    for part in range(3):
        some = frame.filter(F.least(F.floor(hours / 150), F.lit(2)) == part)
        rows_ = some.collect()
        late |= {r.item_id for r in rows_ if marks is not None and r.published_at < marks}
        newest = max((r.published_at for r in rows_), default=START) - timedelta(hours=lateness)
        marks = max(marks or newest, newest)
        some.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        streamed.start_assigning(stream, folder, 0.95, 72 * HOUR, lateness * HOUR).awaitTermination()
    for _ in range(2):  # closing twice changes nothing
        streamed.close(spark, folder, 0.95, 72 * HOUR)
    found = streamed.streamed_assignments(spark, folder).collect()
    assert len(found) == 60 and {r.item_id for r in found if r.late} == late and (lateness == 0) == bool(late)
    assert all((r.story_id is None) == r.late for r in found)
    kept = frame.filter(~F.col("item_id").isin([-1, *late]))
    want = {r.item_id: (r.story_id, r.similarity and round(r.similarity, 9), r.publisher_count) for r in stories.assign_stories(kept, 0.95, 72 * HOUR).collect()}
    assert {r.item_id: (r.story_id, r.similarity and round(r.similarity, 9), r.publisher_count) for r in found if not r.late} == want


def test_a_story_stays_in_its_shard(spark):
    frame = stories.with_vectors(spark.createDataFrame(rows(), SCHEMA))
    items = stories.in_order(frame)
    shard = {r.node: r.shard for r in stories.shards(items, 0.95).collect()}
    groups = {}
    for r in stories.states(items, 0.95, 72 * HOUR).filter("item_id is not null").collect():
        groups.setdefault(r.story_id, set()).add(shard[f"i{r.item_id}"])
    assert all(len(g) == 1 for g in groups.values()) and len(set(shard.values())) > 4


def test_diagnostics_list_the_nearest_and_the_joined(spark):
    frame = stories.with_vectors(spark.createDataFrame(rows(), SCHEMA))
    found = stories.diagnostics(frame, 0.95, 72 * HOUR, k=1).collect()
    joined = {r.item_id: r.story_id for r in stories.assign_stories(frame, 0.95, 72 * HOUR).collect() if r.story_id != f"story-{r.item_id}"}
    assert {r.item_id: r.candidate_id for r in found if r.selected} == joined
    assert all(r.decision == "accepted" for r in found if r.selected)
    assert all(r.actions_compatible or r.representative < 0.985 for r in found)
    three = [(0, 1, START, "p", angle(0), None, ["approve"]), (0, 2, START, "q", angle(24), None, ["reject"]), (0, 3, START, "r", angle(13), None, ["approve"])]
    found = stories.diagnostics(stories.with_vectors(spark.createDataFrame(three, SCHEMA)), 0.9, HOUR, k=1).filter("item_id = 3").orderBy("position").collect()
    assert [(r.position, r.candidate_id, r.decision, r.selected) for r in found] == [(0, "story-2", "rejectedActionMismatch", False), (1, "story-1", "accepted", True)]


def points(n):
    """Vectors of three clouds and noise, some of them equal, one without direction."""
    import numpy as np

    draw = np.random.default_rng(4)
    base = draw.normal(size=(3, 6))
    out = [(base[i % 3] + draw.normal(size=6) * 0.35).tolist() for i in range(n)]
    return [out[0] if i % 5 == 0 else [0.0] * 6 if i == 7 else v for i, v in enumerate(out)]


def cos(a, b):
    size = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else math.nan


@pytest.mark.parametrize("block", [4, 30, 20_000])
@pytest.mark.parametrize("how", [{"threshold": 0.9}, {"nearest": 3}, {"threshold": 0.9, "forest": True}])
def test_joins_over_cells_are_those_of_all_pairs(spark, monkeypatch, block, how):
    monkeypatch.setattr(similarity, "RUN", 25)
    given = points(90)
    data = [(i % 2, i, v, START + timedelta(hours=i * 7 % 40)) for i, v in enumerate(given)]
    right = spark.createDataFrame(data, "k int, right_id int, vector array<double>, right_at timestamp")
    left = right.withColumnsRenamed({"right_id": "left_id", "right_at": "left_at"})
    pairs = [(a, b, cos(given[a], given[b])) for _, a, _, s in data for _, b, _, t in data if a % 2 == b % 2 and timedelta(0) <= s - t <= timedelta(hours=20)]
    pairs = [p for p in pairs if not math.isnan(p[2])]
    found = similarity.cosine_join(left, right, ["k"], span_seconds=20 * HOUR, block=block, **how)
    linked = [(a, b) for a, b, c in pairs if c >= 0.9]
    if how.get("forest"):
        edges = [tuple(r) for r in found.collect()]
        want = dict(enumerate(range(90)))
        for _ in range(90):
            for a, b in linked:
                want[a] = want[b] = min(want[a], want[b])
        got = {r.node: r.component for r in similarity.components(spark.createDataFrame(edges, "a int, b int")).collect()}
        assert got == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    elif "threshold" in how:
        assert sorted((r.left_id, r.right_id) for r in found.collect()) == sorted(linked)
    else:
        want = {}
        for a, b, c in sorted(pairs, key=lambda p: (p[0], -round(p[2], 6), p[1])):
            want.setdefault(a, []).append(b)
        best = similarity.top_k(found, ["left_id"], [F.round("similarity", 6).desc(), F.col("right_id")], 3).orderBy("left_id", "rank").collect()
        got = {}
        for r in best:
            got.setdefault(r.left_id, []).append(r.right_id)
        assert got == {a: b[:3] for a, b in want.items()}


def test_cells_leave_out_what_cannot_match(spark):
    """Of 40 tight clouds a row meets its own and not the others; copies cost a row each."""
    import numpy as np

    base = np.random.default_rng(8).normal(size=(40, 16))
    data = [(1, i, (base[i % 40] + 0.01 * np.sin(np.arange(16) * (i + 1))).tolist(), START) for i in range(800)]
    right = spark.createDataFrame(data, "k int, id int, vector array<double>, at timestamp")
    side = similarity._side(right, ["k"], "id", "at", F.lit(0), F.lit(0))
    homed, cells = similarity._planned(side, 20, 128)
    routed = similarity._routed(side.withColumn("reach", F.lit(math.acos(0.9))), cells, "all")
    held = sum(cells.parts[r.cell] for r in routed.select("cell").collect())
    assert homed.count() == 800 and held < 800 * 16 and len(cells.parts) > 100


@pytest.mark.parametrize("block", [2_500, 20_000])
def test_many_copies_cost_an_edge_each(spark, block):
    rows_ = spark.range(10_000).select(F.lit(1).alias("corpus_id"), "id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(START).alias("at"))
    for window in (None, 72 * HOUR):
        graph = similarity.story_graph(rows_, "id", window, 0.9, block)
        assert graph.count() == 10_000 and graph.select("component").distinct().collect()[0][0] == 0
    left = rows_.withColumnsRenamed({"id": "left_id", "at": "left_at"})
    right = rows_.withColumnsRenamed({"id": "right_id", "at": "right_at"})
    edges = similarity.cosine_join(left, right, ["corpus_id"], threshold=0.9, block=block, forest=True).count()
    assert edges <= 10_000 * (1 + -(-10_000 // block))


@pytest.mark.parametrize("block", [3, 2000])
def test_cosine_join_blocks(spark, block):
    points = spark.createDataFrame(
        [(0, i, angle(i * 17 % 360), START + timedelta(hours=i % 9)) for i in range(40)], "k int, id int, vector array<double>, at timestamp"
    )
    left = points.select("k", F.col("id").alias("left_id"), "vector", F.col("at").alias("left_at"))
    right = points.select("k", F.col("id").alias("right_id"), "vector", F.col("at").alias("right_at"))
    found = {(r.left_id, r.right_id) for r in similarity.cosine_join(left, right, ["k"], threshold=0.9, block=block).collect()}
    data = points.collect()
    want = {
        (a.id, b.id) for a in data for b in data
        if b.at <= a.at and sum(x * y for x, y in zip(a.vector, b.vector)) >= 0.9
    }
    assert found == want


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (2, 1), (20, 21)]
    found = {r.node: r.component for r in similarity.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_vectors_of_unequal_length_have_no_similarity(spark):
    given = [(1, angle(0)), (2, angle(0) + [0.0]), (3, angle(1)), (4, angle(1) + [0.0]), (5, [1.0])]
    left = spark.createDataFrame([("c", i, v, START) for i, v in given], "corpus_id string, left_id int, vector array<double>, left_at timestamp")
    right = left.withColumnsRenamed({"left_id": "right_id", "left_at": "right_at"})
    found = similarity.cosine_join(left, right, ["corpus_id"], threshold=0.9).filter("left_id < right_id").collect()
    assert {(r.left_id, r.right_id) for r in found} == {(1, 3), (2, 4)}
    items = [(1, i, START + timedelta(hours=i), f"p{i}", v, None, []) for i, v in given]
    frame = stories.with_vectors(spark.createDataFrame(items, SCHEMA))
    groups = {r.item_id: r.story_id for r in stories.assign_stories(frame, 0.9, 100 * HOUR).collect()}
    assert groups[1] == groups[3] and groups[2] == groups[4] and len(set(groups.values())) == 3


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_centroids_over_slices(spark, parts):
    given = [("big" if i % 4 else f"s{i % 8}", i, START + timedelta(hours=i * 7 % 50), [float(i), 1.0, -i / 3]) for i in range(120)]
    table = spark.createDataFrame(given, "story_id string, item_id int, published_at timestamp, combined array<double>").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.story_id, r.item_id): (r.position, r.centroid) for r in stories.running_centroids(table).collect()}
        pooled = {r.story_id: r.vector for r in stories.mean_pooled(table, ["story_id"], "combined").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for story in {g[0] for g in given}:
        members = sorted((g for g in given if g[0] == story), key=lambda g: (g[2], g[1]))
        for n, g in enumerate(members, 1):
            position, centroid = found[story, g[1]]
            assert position == n and centroid == pytest.approx([sum(m[3][d] for m in members[:n]) / n for d in range(3)])
        assert pooled[story] == pytest.approx([sum(m[3][d] for m in members) / len(members) for d in range(3)])
    assert stories.mean_pooled(table.limit(0), ["story_id"], "combined").count() == 0 and stories.running_centroids(table.limit(0)).count() == 0


def test_uniting_a_dense_block_holds_marks_not_pairs():
    """A block whose rows are all alike has a link per mark; none of them becomes a Python object."""
    import tracemalloc

    import numpy as np

    draw = np.random.default_rng(2)
    for linked in (draw.random((300, 400)) < 0.004, np.ones((500, 2_000), bool), np.zeros((0, 5), bool)):
        held = object.__new__(similarity._Held)
        held.root, want = np.arange(linked.shape[1]), np.arange(linked.shape[1])
        for marks in linked:
            trees = want[marks]
            want = np.where(np.isin(want, trees), trees.min(initial=len(want)), want)
        tracemalloc.start()
        held.unite(linked)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held.root.tolist() == want.tolist() and peak < 1_000_000 + 24 * linked.size


def test_cells_are_planned_for_the_largest_group(spark):
    """Ten groups of 80 rows that no bound tells apart: a row is copied as its group needs, not as all rows would."""
    import numpy as np

    draw = np.random.default_rng(3)
    data = [(i % 10, i, draw.normal(size=32).tolist(), START) for i in range(800)]
    right = spark.createDataFrame(data, "k int, id int, vector array<double>, at timestamp")
    side = similarity._side(right, ["k"], "id", "at", F.lit(0), F.lit(0))
    _, cells = similarity._planned(side, 20, 128)
    routed = similarity._routed(side.withColumn("reach", F.lit(math.acos(0.2))), cells, "all")
    assert len(cells.parts) == 16 and routed.count() <= 800 * 16


def test_fold_reads_a_few_items_of_a_batch_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, dim = 5_000, 64
    vector = lambda k: pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), np.arange(n * dim) * float(k))
    recent = pa.array([[[float(i)] * dim] * 3 if i % 2 else None for i in range(n)], pa.list_(pa.list_(pa.float64())))
    names = ["item_id", "combined", "signature", "recent", "actions"]
    nothing = pa.array([None] * n, pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), vector(1), nothing, recent, pa.array([["a"]] * n)], names=names)
    tracemalloc.start()
    for i, row in enumerate(stories._read(batch)):
        assert row["item_id"] == i and row["combined"][0] == i * dim and row["combined"].base is None and row["signature"] is None
        assert row["actions"] == ["a"] and [r.tolist() for r in row["recent"]] == ([[float(i)] * dim] * 3 if i % 2 else [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i == n - 1 and peak < 4_000_000
