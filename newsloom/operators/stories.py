"""Online story assignment: items in time order join the best open story or start one.

The result depends on order, but not everywhere: an item can only join a story whose first member it
resembles, so a story never leaves its component of the graph that links items this similar, whatever
their times. These components are shards: each is folded on its own, in order, as rows stream through a
task, and only its open stories are in memory. Items alone in their component are stories at once. What an item
has to do with stories of other shards (the nearest ones, for the diagnostics) is a join with the states
that the fold gives out, each valid from one member to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import fixed, vectors
from newsloom.operators import similarity
from newsloom.operators.ranking import rank_all, top_k
from newsloom.session import durable

DIAGNOSTICS = 10
#: Items and states of the fold that are Python objects at once.
AT_ONCE = 256
#: Position after which no state was followed by another.
LAST = (1 << 63) - 1
#: Slack of the shard graph for sums that are added up in another order.
_ROUNDING = 1e-9
_VECTORS = ("headline", "body", "combined", "representative", "signature")
#: State of a story after a member, which is ``item_id``; null for a story that was open before.
_STATE = (
    "item_id {item}, story_id string, seq bigint, position bigint, until bigint, at_us bigint, similarity double, members bigint, "
    "publisher_count int, headline array<double>, body array<double>, combined array<double>, representative array<double>, "
    "signature array<double>, actions array<string>, recent array<array<double>>, publishers array<string>"
)


class _Story:
    """Open story; the representative, its signature and its actions stay those of the first member."""

    def __init__(self, row: dict):
        self.row = row
        self.recent, self.publishers = row["recent"], set(row["publishers"])
        self.actions = frozenset(row["actions"])

    def closed(self, until: int) -> dict:
        """The state as it was before the member at ``until``."""
        return self.row | {"until": until, "recent": self.recent[-fixed.RECENT_USED :], "publishers": None}

    def last(self) -> dict:
        return self.row | {"until": LAST, "recent": self.recent, "publishers": sorted(self.publishers)}

    def add(self, item: dict, similarity: float) -> None:
        n, old = self.row["members"], self.row
        self.publishers.add(item["publisher_key"])
        self.recent = [*self.recent, item["combined"]][-fixed.RECENT_KEPT :]
        body = _mean(old["body"], n, item["body"]) if item["body"] is not None else old["body"]
        self.row = old | {
            "item_id": item["item_id"], "position": item["position"], "at_us": item["at_us"], "similarity": similarity, "members": n + 1,
            "publisher_count": len(self.publishers), "headline": _mean(old["headline"], n, item["headline"]), "body": body,
            "combined": _mean(old["combined"], n, item["combined"]),
        }


def _mean(old: np.ndarray | None, n: int, new: np.ndarray) -> np.ndarray:
    return new if old is None or len(old) != len(new) else (old * n + new) / (n + 1)


def first_state(item: dict) -> dict:
    """State of the story that ``item`` starts."""
    return {
        "item_id": item["item_id"], "story_id": f"story-{str(item['item_id']).lower()}", "seq": item["position"], "position": item["position"],
        "at_us": item["at_us"], "similarity": None, "members": 1, "publisher_count": 1, "headline": item["headline"], "body": item["body"],
        "combined": item["combined"], "representative": item["combined"], "signature": item["signature"], "actions": item["actions"], "recent": [item["combined"]],
        "publishers": [item["publisher_key"]],
    }


class Shard:
    """The open stories of one shard; items come in order."""

    def __init__(self, threshold: float, window_us: int):
        self.threshold, self.floor, self.window_us = threshold, threshold - fixed.COHESION_SLACK, window_us
        self.stories: list[_Story] = []
        self.units = np.zeros((0, 0))  # centroids of the open stories; rows beyond them are spare

    def open(self, story: _Story) -> None:
        unit, n = _unit(story.row["combined"]), len(self.stories)
        if n == len(self.units):
            self.units = np.concatenate([self.units.reshape(n, len(unit)), np.zeros((n + 8, len(unit)))])
        self.units[n] = unit
        self.stories.append(story)

    def add(self, item: dict) -> Iterator[dict]:
        """Let ``item`` join or start a story; gives out the states that are now over."""
        gone = [k for k, s in enumerate(self.stories) if item["at_us"] - s.row["at_us"] > self.window_us]
        for k in gone:
            yield self.stories[k].last()
        if gone:
            kept = sorted(set(range(len(self.stories))) - set(gone))
            self.stories, self.units = [self.stories[k] for k in kept], self.units[kept]
        unit, best = _unit(item["combined"]), None
        near = self.units[: len(self.stories)] @ unit if self.stories else np.zeros(0)
        for k in np.argsort(-near, kind="stable").tolist():
            if near[k] < self.threshold:
                break
            if self._accepts(self.stories[k], item, unit):
                best = k
                break
        if best is None:
            self.open(_Story(first_state(item)))
        else:
            yield self.stories[best].closed(item["position"])
            self.stories[best].add(item, float(near[best]))
            self.units[best] = _unit(self.stories[best].row["combined"])

    def _accepts(self, story: _Story, item: dict, unit: np.ndarray) -> bool:
        event = _cosine(item["signature"], story.row["signature"])
        if event is not None and event < fixed.SIGNATURE_THRESHOLD:
            return False
        first = float(_unit(story.row["representative"]) @ unit)
        actions = frozenset(item["actions"])
        if actions and story.actions and not actions & story.actions and first < fixed.ACTION_OVERRIDE:
            return False
        if first < self.floor:
            return False
        recent = [float(_unit(r) @ unit) for r in story.recent[-fixed.RECENT_USED :] if len(r) == len(unit)]
        return bool(recent) and sum(recent) / len(recent) >= self.floor


def _unit(vector: np.ndarray) -> np.ndarray:
    return vector / np.linalg.norm(vector)


def _cosine(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """None where either is absent, of another length or without direction."""
    if a is None or b is None or len(a) != len(b):
        return None
    length = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / length) if length > 0 else None


def _arrays(column: pa.Array) -> list[np.ndarray | None]:
    ends, valid = column.offsets.to_pylist(), column.is_valid().to_pylist()
    begin = ends[0]
    flat = column.values.slice(begin, ends[-1] - begin).to_numpy(zero_copy_only=False)
    return [flat[a - begin : b - begin] if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)]


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, a few as Python objects at a time; what a story keeps of them does not hold the batch."""
    for start in range(0, batch.num_rows, AT_ONCE):
        part, columns = batch.slice(start, AT_ONCE), {}
        for name, column in zip(part.schema.names, part.columns, strict=True):
            columns[name] = [None if v is None else v.copy() for v in _arrays(column)] if name in _VECTORS else column.to_pylist()
        for values in zip(*columns.values(), strict=True):
            row = dict(zip(columns, values, strict=True))
            row["recent"] = [np.asarray(r, float) for r in row["recent"] or []]
            row["actions"] = row["actions"] or []
            yield row


def _folded(rows: DataFrame, threshold: float, window_us: int) -> DataFrame:
    """States of all stories; ``rows`` are open stories (side 0) and items (side 1) with corpus and shard.

    A task goes through its shards one after the other, whatever their length.
    """
    item_type, corpus_type = rows.schema["item_id"].dataType, rows.schema["corpus_id"].dataType
    schema = T.StructType([T.StructField("corpus_id", corpus_type), *T.StructType.fromDDL(_STATE.format(item=item_type.simpleString()))])
    arrow = {"headline": pa.list_(pa.float64()), "recent": pa.list_(pa.list_(pa.float64())), "actions": pa.list_(pa.string()), "publishers": pa.list_(pa.string())}
    arrow |= dict.fromkeys(_VECTORS, arrow["headline"]) | {"publisher_count": pa.int32(), "similarity": pa.float64(), "story_id": pa.string()}

    def run(batches):
        key, shard, known = None, Shard(threshold, window_us), {}

        def packed(corpus, states):
            for start in range(0, len(states), AT_ONCE):
                part = states[start : start + AT_ONCE]
                columns = [pa.array([corpus] * len(part), known["corpus_id"])]
                for name in schema.names[1:]:
                    columns.append(pa.array([s[name] for s in part], known["item_id"] if name == "item_id" else arrow.get(name, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            known = {n: batch.schema.field(n).type for n in ("corpus_id", "item_id")}
            out = []
            for row in _read(batch):
                if (row["corpus_id"], row["shard"]) != key:
                    out += [s.last() for s in shard.stories]
                    if out:
                        yield from packed(key[0], out)
                    key, shard, out = (row["corpus_id"], row["shard"]), Shard(threshold, window_us), []
                if row["side"] == 0:
                    shard.open(_Story(row | {"item_id": None, "similarity": None, "publisher_count": len(row["publishers"])}))
                else:
                    out += shard.add(row)
                if len(out) >= AT_ONCE:
                    yield from packed(key[0], out)
                    out = []
            if out:
                yield from packed(key[0], out)
        if shard.stories:
            yield from packed(key[0], [s.last() for s in shard.stories])

    given = ["corpus_id", "shard", "side", "position", "item_id", "at_us", "publisher_key", "headline", "body", "combined", "signature", "actions", "story_id", "seq", "members", "representative", "recent", "publishers"]
    ordered = rows.select(*given).repartition("corpus_id", "shard").sortWithinPartitions("corpus_id", "shard", "side", "seq", "position")
    return ordered.mapInArrow(run, schema)


def with_vectors(df: DataFrame) -> DataFrame:
    """Unit headline and body vectors and their blend; ``headline``/``body`` come from a model."""
    return (
        df.withColumn("headline", vectors.unit(F.col("headline")))
        .withColumn("body", vectors.unit(F.col("body")))
        .withColumn("combined", vectors.blend(F.col("headline"), F.col("body")))
    )


def in_order(df: DataFrame, offset: int = 0) -> DataFrame:
    """Items with their ``position`` in the corpus, after ``offset``, and their time in microseconds."""
    columns = ["corpus_id", "item_id", "published_at", "publisher_key", "headline", "body", "combined", "actions"]
    signature = F.col("signature") if "signature" in df.columns else F.lit(None)
    columns += [signature.cast("array<double>").alias("signature"), *[c for c in ("actors",) if c in df.columns]]
    ranked = rank_all(df.select(*columns), ["corpus_id"], [F.col("published_at"), F.col("item_id")], "position")
    return ranked.withColumn("position", F.col("position") + offset).withColumn("at_us", F.unix_micros("published_at"))


def shards(items: DataFrame, threshold: float, opened: DataFrame | None = None) -> DataFrame:
    """(node, shard, n): components of the graph that links items and the first members of open stories.

    Two are linked if they are similar enough for one to be accepted where the other is the first
    member. ``node`` is ``i`` and an item's id or ``s`` and a story's; ``n`` nodes are in the shard.
    """
    nodes = items.select("corpus_id", F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("node"), F.col("combined").alias("vector"))
    if opened is not None:
        nodes = nodes.unionByName(opened.select("corpus_id", F.concat(F.lit("s"), "story_id").alias("node"), F.col("representative").alias("vector")))
    graph = durable(similarity.story_graph(nodes, "node", None, threshold - fixed.COHESION_SLACK - _ROUNDING))
    sizes = graph.groupBy("component").agg(F.count("*").alias("n"))
    return graph.join(sizes, "component").select("node", F.col("component").alias("shard"), "n")


def states(items: DataFrame, threshold: float, window_seconds: int, opened: DataFrame | None = None) -> DataFrame:
    """Every state of every story, durable; ``items`` come from ``in_order``, ``opened`` are last states of before.

    A row is the state after its ``item_id`` joined, valid for items from ``position`` + 1 up to ``until``.
    Where nothing has followed, ``until`` is ``LAST`` and ``publishers`` and ``recent`` are complete.
    """
    split = shards(items, threshold, opened)
    node = F.concat(F.lit("i"), F.col("item_id").cast("string"))
    placed = items.withColumn("node", node).join(split, "node", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    actions = F.coalesce("actions", F.expr("cast(array() as array<string>)")).alias("actions")
    none = {"story_id": "string", "seq": "bigint", "members": "bigint", "representative": "array<double>", "recent": "array<array<double>>", "publishers": "array<string>"}
    rows = placed.filter("n > 1").select(
        "corpus_id", "shard", F.lit(1).alias("side"), "position", "item_id", "at_us", "publisher_key", "headline", "body", "combined", "signature", actions,
        *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()],
    )
    if opened is not None:
        before = opened.withColumn("node", F.concat(F.lit("s"), "story_id")).join(split, "node", "left")
        rows = rows.unionByName(before.select(
            "corpus_id", F.coalesce("shard", "node").alias("shard"), F.lit(0).alias("side"), "position", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
            "at_us", F.lit(None).cast("string").alias("publisher_key"), "headline", "body", "combined", "signature", "actions", *none,
        ))
    folded = _folded(rows, threshold, window_seconds * 1_000_000)
    alone = placed.filter("n = 1").select(
        "corpus_id", "item_id", F.concat(F.lit("story-"), F.lower(F.col("item_id").cast("string"))).alias("story_id"), F.col("position").alias("seq"), "position",
        F.lit(LAST).alias("until"), "at_us", F.lit(None).cast("double").alias("similarity"), F.lit(1).cast("bigint").alias("members"), F.lit(1).alias("publisher_count"),
        "headline", "body", "combined", F.col("combined").alias("representative"), "signature", actions, F.array("combined").alias("recent"), F.array("publisher_key").alias("publishers"),
    )
    return durable(folded.unionByName(alone))


def nearest_states(items: DataFrame, found: DataFrame, window_seconds: int, k: int) -> DataFrame:
    """(left_id, right_id, similarity, rank): the ``k`` most similar stories open when an item came.

    ``right_id`` names a state: the number of its story's first item, then that of the state's own, so that
    of equally similar stories the older one comes first.
    """
    at = F.timestamp_micros("at_us")
    state = F.format_string("%019d:%019d", "seq", "position")
    left = items.select("corpus_id", F.col("item_id").alias("left_id"), F.col("combined").alias("vector"), at.alias("left_at"), F.col("position").alias("left_order"))
    right = found.select(
        "corpus_id", state.alias("right_id"), F.col("combined").alias("vector"), at.alias("right_at"),
        (F.col("position") + 1).alias("right_start"), F.col("until").alias("right_until"),
    )
    return similarity.nearest_stories(left, right, window_seconds, k)


def assigned(items: DataFrame, found: DataFrame, window_seconds: int) -> DataFrame:
    """(item_id, story_id, similarity, publisher_count) of items; one that starts a story has the similarity of the nearest."""
    started = found.filter("item_id is not null and similarity is null").select("item_id")
    nearest = nearest_states(items.join(started, "item_id", "left_semi"), found, window_seconds, 1).select(F.col("left_id").alias("item_id"), F.col("similarity").alias("_nearest"))
    rows = found.filter("item_id is not null").select("item_id", "story_id", "similarity", "publisher_count")
    return rows.join(nearest, "item_id", "left").select("item_id", "story_id", F.coalesce("similarity", "_nearest").alias("similarity"), "publisher_count")


def assign_stories(df: DataFrame, threshold: float, window_seconds: int) -> DataFrame:
    """(item_id, story_id, similarity, publisher_count) for every item.

    ``df``: corpus_id, item_id (unique), published_at, publisher_key, headline, body, combined, actions and, if
    known, ``signature``, the vector of the reported event: unlike ones keep an item out of a story. Ties go by item id. Items with a null corpus or a combined vector without direction are stories of their own.
    """
    items = in_order(df)
    return assigned(items, states(items, threshold, window_seconds), window_seconds)


def assignments(df: DataFrame, threshold: float, window_seconds: int) -> DataFrame:
    """Assignment rows of all items: those not ready stay, without a story and with their reason."""
    ready = df.filter((F.col("readiness") == "ready") & F.col("combined").isNotNull())
    found = assign_stories(ready, threshold, window_seconds)
    missing = (F.col("readiness") == "ready") & F.col("combined").isNull()
    return df.join(found, "item_id", "left").select(
        "corpus_id", "item_id", "published_at", "publisher_key", "language",
        F.when(missing, "embeddingUnavailable").otherwise(F.col("readiness")).alias("readiness"),
        "story_id", "similarity", F.coalesce("publisher_count", F.lit(0)).alias("publisher_count"),
    )


def diagnostics(df: DataFrame, threshold: float, window_seconds: int, k: int = DIAGNOSTICS) -> DataFrame:
    """One row per examined story of an item: the ``k`` nearest open ones, then the joined one if it is not among them."""
    items = durable(in_order(df))
    found = states(items, threshold, window_seconds)
    near = nearest_states(items, found, window_seconds, k)
    candidates = near.select(F.col("left_id").alias("item_id"), F.split("right_id", ":")[1].cast("bigint").alias("_state"), (F.col("rank") - 1).alias("position"))
    order = items.select("corpus_id", F.col("position").alias("_order"), "item_id", *[F.col(c).alias(f"i_{c}") for c in ("headline", "body", "combined", "signature", *[c for c in ("actors",) if c in items.columns])], F.coalesce("actions", F.expr("cast(array() as array<string>)")).alias("i_actions"))
    members = found.filter("item_id is not null").select("item_id", "story_id", F.col("position").alias("_order"), "corpus_id", (F.col("members") > 1).alias("_joined"))
    before = found.select("corpus_id", "story_id", F.col("position").alias("_state"), F.col("until").alias("_order"))
    chosen = members.filter("_joined").join(before, ["corpus_id", "story_id", "_order"]).select("item_id", F.col("_state").alias("_chosen"))
    listed = candidates.join(chosen, "item_id", "left").withColumn("selected", F.coalesce(F.col("_state") == F.col("_chosen"), F.lit(False))).drop("_chosen")
    reached = listed.groupBy("item_id").agg(F.max("selected").alias("_listed"), F.count("*").alias("_n"))
    beyond = chosen.join(reached, "item_id", "left").filter(~F.coalesce("_listed", F.lit(False))).select("item_id", F.col("_chosen").alias("_state"), F.coalesce("_n", F.lit(0)).cast("int").alias("position"), F.lit(True).alias("selected"))
    seen = found.select("corpus_id", F.col("position").alias("_state"), "story_id", "seq", *[F.col(c).alias(f"s_{c}") for c in (*_VECTORS, "recent", "actions")])
    if "actors" in items.columns:  # joined to the states, which are one row each, not to the pairs, which are wide and many
        seen = seen.join(items.select("corpus_id", F.col("position").alias("seq"), F.col("actors").alias("s_actors")), ["corpus_id", "seq"], "left")
    pairs = listed.unionByName(beyond).join(order, "item_id").join(seen, ["corpus_id", "_state"])
    judged = evaluate_pairs(pairs, threshold)
    overlap = F.col("actor_overlap") if "actors" in items.columns else F.lit(None).cast("boolean")
    clash = (F.size("i_actions") > 0) & (F.size("s_actions") > 0) & ~F.arrays_overlap("i_actions", "s_actions")
    compatible = ~clash | F.coalesce(F.col("representative") >= fixed.ACTION_OVERRIDE, F.lit(False))
    return judged.select("item_id", "position", F.col("story_id").alias("candidate_id"), "centroid", "headline", "body", "representative", "recent", "signature", overlap.alias("actor_overlap"), compatible.alias("actions_compatible"), "decision", "selected")


def mean_pooled(tokens: DataFrame, keys: list[str], vector: str, dim: int | None = None) -> DataFrame:
    """(keys, vector): mean of token vectors per group, one aggregate per dimension of whole vectors.

    Tasks add up their own rows, so a group costs a row per task. ``dim`` is the longest vector's length, looked up
    where it is not given; a dimension is averaged over the vectors that have it.
    """
    if dim is None:
        dim = tokens.agg(F.max(F.size(vector))).first()[0] or 0
    means = tokens.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(F.get(vector, F.lit(i))).alias(f"_{i}") for i in range(dim)])
    whole = F.filter(F.array(*[F.col(f"_{i}") for i in range(dim)]), F.isnotnull) if dim else F.expr("cast(array() as array<double>)")
    return means.select(*keys, whole.alias("vector"))


def recent_support(members: DataFrame, last: int = fixed.RECENT_USED) -> DataFrame:
    """Mean similarity of each member to the ``last`` members before it in its story.

    Earlier members come by an equi join on (story, position), so a large story spreads out.
    """
    ranked = rank_all(members, ["story_id"], [F.col("published_at"), F.col("item_id")], "position")
    earlier = ranked.select(
        "story_id", F.col("combined").alias("_before"),
        F.explode(F.sequence(F.col("position") + 1, F.col("position") + last)).alias("position"),
    )
    return (
        ranked.join(earlier, ["story_id", "position"])
        .groupBy("story_id", "item_id", "position")
        .agg(F.avg(vectors.cosine(F.col("combined"), F.col("_before"))).alias("recent_support"))
    )


def _padded(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    size = max(len(old), len(new))
    return np.pad(old, (0, size - len(old))) + np.pad(new, (0, size - len(new)))


def _running(rows: DataFrame, keys: list[str], each_row: bool) -> DataFrame:
    """Running sums over rows in order of ``keys`` (which begin anew with every key).

    Rows have ``n`` and ``total`` (a vector). With ``each_row`` every row gets the sums up to and with itself;
    otherwise a key's rows become one, the sums of all of them.
    """
    at = [rows.columns.index(c) for c in (*keys, "n", "total")]
    kept = [c for c in rows.columns if c not in ("n", "total")] if each_row else keys
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def run(batches):
        key, n, total = None, 0, np.zeros(0)

        def ended(like):
            columns = [pa.array([k], like.column(i).type) for k, i in zip(key, at, strict=False)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n]), pa.array([total], pa.list_(pa.float64()))], names=schema.names)

        last = None
        for batch in batches:
            last = batch
            marks = list(zip(*[batch.column(i).to_pylist() for i in at[: len(keys)]], strict=True))
            counts, vectors_ = batch.column(at[-2]).to_pylist(), _arrays(batch.column(at[-1]))
            counted, sums = [], []
            for mark, count, vector in zip(marks, counts, vectors_, strict=True):
                if mark != key:
                    if key is not None and not each_row:
                        yield ended(batch)
                    key, n, total = mark, 0, np.zeros(0)
                n, total = n + count, _padded(total, vector)
                counted.append(n)
                sums.append(total)
            if each_row:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counted, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=schema.names)
        if key is not None and not each_row:
            yield ended(last)

    return rows.mapInArrow(run, schema)


def running_centroids(members: DataFrame) -> DataFrame:
    """(story_id, item_id, position, centroid): centroid of a story after each member, as a whole vector.

    A scan in two levels: members are cut into slices by story and order, a slice adds up its own, and what
    the earlier slices of a story come to is added to all rows of a later one. A large story is many slices.
    """
    order = ["published_at", "item_id"]
    rows = members.select("story_id", *order, F.lit(1).cast("bigint").alias("n"), F.col("combined").cast("array<double>").alias("total"))
    sliced = durable(rows.repartitionByRange("story_id", *order).withColumn("slice", F.spark_partition_id()))
    ordered = sliced.sortWithinPartitions("slice", "story_id", *order)
    each = _running(ordered, ["slice", "story_id"], True)
    sums = _running(ordered, ["slice", "story_id"], False)
    # All but a slice's first and last story lie in it whole; what begins in an earlier slice is one row per slice.
    spread = sums.join(sums.groupBy("story_id").agg(F.count("*").alias("slices")).filter("slices > 1"), "story_id").drop("slices")
    upto = _running(spread.repartition("story_id").sortWithinPartitions("story_id", "slice"), ["story_id"], True)
    before = upto.join(spread.withColumnsRenamed({"n": "own", "total": "own_total"}), ["story_id", "slice"]).select(
        "story_id", "slice", (F.col("n") - F.col("own")).alias("n_before"), F.zip_with("total", "own_total", lambda t, o: t - F.coalesce(o, F.lit(0.0))).alias("before")
    )
    joined = each.join(before.filter("n_before > 0"), ["story_id", "slice"], "left")
    position = F.col("n") + F.coalesce("n_before", F.lit(0))
    whole = F.coalesce(F.zip_with("total", "before", lambda t, o: F.coalesce(t, F.lit(0.0)) + F.coalesce(o, F.lit(0.0))), "total")
    return joined.select("story_id", "item_id", position.alias("position"), whole.alias("sums")).select(
        "story_id", "item_id", "position", F.transform("sums", lambda x: x / F.col("position")).alias("centroid")
    )


def evaluate_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """Offline evaluation of (item, story) rows by columns: all similarities and the decision.

    Columns i_headline, i_body, i_combined, i_actions and s_headline, s_body, s_combined,
    s_representative, s_recent, s_actions; optionally i_signature/s_signature (vectors),
    i_actors/s_actors (sets of keys), i_action/s_action and i_object/s_object (terms).
    """
    c = F.col
    used = F.slice("s_recent", F.greatest(F.lit(1), F.size("s_recent") - fixed.RECENT_USED + 1), fixed.RECENT_USED)
    similarities = F.filter(F.transform(used, lambda r: vectors.cosine(c("i_combined"), r)), F.isnotnull)
    support = F.aggregate(similarities, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(similarities), F.lit(0))
    out = pairs.select(
        "*",
        vectors.cosine(c("i_combined"), c("s_combined")).alias("centroid"),
        vectors.cosine(c("i_headline"), c("s_headline")).alias("headline"),
        vectors.cosine(c("i_body"), c("s_body")).alias("body"),
        vectors.cosine(c("i_combined"), c("s_representative")).alias("representative"),
        support.alias("recent"),
    )
    signature_ok = None
    if {"i_signature", "s_signature"} <= set(pairs.columns):
        out = out.withColumn("signature", vectors.cosine(c("i_signature"), c("s_signature")))
        signature_ok = c("signature") >= fixed.SIGNATURE_THRESHOLD
    if {"i_actors", "s_actors"} <= set(pairs.columns):
        known = (F.size("i_actors") > 0) & (F.size("s_actors") > 0)
        out = out.withColumn("actor_overlap", F.when(known, F.arrays_overlap("i_actors", "s_actors")))
    for name in ("action", "object"):
        if f"i_{name}" in pairs.columns:
            out = out.withColumn(f"{name}_similarity", vectors.term_similarity(c(f"i_{name}"), c(f"s_{name}")))
    decision = vectors.gate_decision(
        c("centroid"), c("representative"), c("recent"), c("i_actions"), c("s_actions"), threshold, signature_ok
    )
    return out.withColumn("decision", decision)
