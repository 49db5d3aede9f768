"""Curation: score items, then pick a diverse set per reader.

The pick is greedy and order-dependent. It is still exact on hot readers without ever grouping a
reader's whole candidate list: every round takes the best ``BLOCK`` candidates of each reader
(limited in every task before the shuffle), extends the bounded set of picks, and then drops every
remaining candidate the picks already rule out. All rules only get stricter as picks are added, so
dropping is safe, and the best survivor is always picked next; rounds end after a few steps.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import rules, text, urls
from newsloom.operators.ranking import top_k
from newsloom.session import durable

BLOCK = 500
#: Candidates of one reader that are joined with its reader's row in one task.
JOINED_ROWS = 100_000
NEAR_SECONDS = 172_800
TOPIC = 0.3
DUPLICATE = 0.65

_CARRIED = ["reader_id", "item_id", "score", "published_at", "link_key", "title_key", "source_key", "tokens", "is_vip"]


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("published_at").desc(), F.col("item_id")]


def scored(items: DataFrame, now: Column) -> DataFrame:
    """Items with age, candidate flag and score."""
    aged = items.withColumn("age", rules.age_hours(F.col("published_at"), now))
    noise = rules.is_promotional(F.col("title"), F.col("link"))
    return aged.withColumn("is_candidate", rules.is_candidate(F.col("age"), noise)).withColumn(
        "score", rules.score(F.col("age"))
    )


def budgets(marked: DataFrame) -> DataFrame:
    """Per reader: library size, candidates, budget and the caps that follow from it."""
    counts = marked.groupBy("reader_id").agg(
        F.count("*").alias("total"), F.count_if("is_candidate").alias("candidates")
    )
    budget = rules.selection_budget(F.col("total"), F.col("candidates"))
    return (
        counts.withColumn("budget", budget)
        .withColumn("source_cap", F.greatest(F.lit(6), F.ceil(F.col("budget") * 0.5)).cast("int"))
        .withColumn("topic_cap", F.greatest(F.lit(4), F.ceil(F.col("budget") / 6.0)).cast("int"))
    )


def _narrow(items: DataFrame, now: Column) -> DataFrame:
    """Scored items as narrow rows; the keys the pick compares are there for candidates only."""
    c = F.col
    keys = {
        "link_key": urls.canonical_link(c("link")), "title_key": text.normalize_title(c("title")), "tokens": text.title_tokens(c("title")),
        "source_key": urls.source_key(c("feed_id"), c("link"), c("author")),
    }
    return scored(items, now).select(
        "reader_id", "item_id", "score", "published_at", "is_vip", "is_starred", "is_candidate", *[F.when(c("is_candidate"), k).alias(n) for n, k in keys.items()]
    )


def prepared(items: DataFrame, now: Column) -> DataFrame:
    """The one durable table a curation reads: every item once, scored, narrow."""
    return durable(_narrow(items, now))


def candidates(items: DataFrame, now: Column) -> DataFrame:
    """Narrow candidate rows with the keys the pick compares."""
    return of_run(_narrow(items, now))


def of_run(run: DataFrame) -> DataFrame:
    """The candidates of a table of ``prepared``."""
    return run.filter("is_candidate").select(*_CARRIED)


def _extend(rows: pd.DataFrame) -> pd.DataFrame:
    """New picks of one reader from earlier picks (``position`` set) and one block of candidates."""
    earlier = rows[rows.position.notna()].sort_values("position")
    block = rows[rows.position.isna()].sort_values(
        ["score", "published_at", "item_id"], ascending=[False, False, True]
    )
    picks = list(earlier.itertuples())
    word_sets = [frozenset(p.tokens) for p in picks]
    links = {p.link_key for p in picks if p.link_key is not None}
    titles = {p.title_key for p in picks}
    per_source = earlier.source_key.value_counts().to_dict()
    position = len(picks)
    taken = []
    for row in block.itertuples():
        if position >= row.budget:
            break
        if row.link_key in links or (row.title_key and row.title_key in titles):
            continue
        if per_source.get(row.source_key, 0) >= row.source_cap * (2 if row.is_vip else 1):
            continue
        words = frozenset(row.tokens)
        related, duplicate = 0, False
        if len(words) >= 3:
            for other, other_words in zip(picks, word_sets):
                gap = abs((other.published_at - row.published_at).total_seconds())
                shared = len(words & other_words)
                if gap > NEAR_SECONDS or len(other_words) < 3 or shared < 3:
                    continue
                likeness = shared / len(words | other_words)
                related += likeness >= TOPIC
                long_enough = len(words) >= 4 and len(other_words) >= 4
                if likeness >= DUPLICATE and long_enough and other.source_key != row.source_key:
                    duplicate = True
                    break
        if duplicate or (not row.is_vip and related >= row.topic_cap):
            continue
        picks.append(row)
        word_sets.append(words)
        if row.link_key is not None:
            links.add(row.link_key)
        titles.add(row.title_key)
        per_source[row.source_key] = per_source.get(row.source_key, 0) + 1
        taken.append((row.Index, position))
        position += 1
    out = block.loc[[i for i, _ in taken], _CARRIED].copy()
    out["position"] = [p for _, p in taken]
    return out


def is_near(row_tokens: Column, row_time: Column, pick: Column) -> Column:
    return (
        (F.size(pick["tokens"]) >= 3)
        & (F.abs(F.unix_micros(pick["published_at"]) - F.unix_micros(row_time)) <= NEAR_SECONDS * 1_000_000)
        & (text.title_similarity(row_tokens, pick["tokens"]) >= TOPIC)
    )


def is_duplicate(row: dict[str, Column], pick: Column) -> Column:
    return (
        is_near(row["tokens"], row["published_at"], pick)
        & (pick["source_key"] != row["source_key"])
        & (F.size(row["tokens"]) >= 4)
        & (F.size(pick["tokens"]) >= 4)
        & (text.title_similarity(row["tokens"], pick["tokens"]) >= DUPLICATE)
    )


def _repeats(row: dict[str, Column], picks: Column, source_cap: Column) -> Column:
    """Same link, same title or source full, given the picks."""
    same = F.exists(
        picks,
        lambda p: F.coalesce(p["link_key"] == row["link_key"], F.lit(False))
        | ((p["title_key"] == row["title_key"]) & (row["title_key"] != "")),
    )
    cap = F.when(row["is_vip"], source_cap * 2).otherwise(source_cap)
    return same | (F.size(F.filter(picks, lambda p: p["source_key"] == row["source_key"])) >= cap)


def _ruled_out(row: dict[str, Column], picks: Column, source_cap: Column, topic_cap: Column) -> Column:
    enough = F.size(row["tokens"]) >= 3
    duplicate = enough & F.exists(picks, lambda p: is_duplicate(row, p))
    near = F.size(F.filter(picks, lambda p: is_near(row["tokens"], row["published_at"], p)))
    return _repeats(row, picks, source_cap) | duplicate | (enough & ~row["is_vip"] & (near >= topic_cap))


def packed_picks(picks: DataFrame) -> DataFrame:
    """One row per reader with its picks in order; a budget is at most 80, so rows stay small."""
    fields = ["position", *[c for c in _CARRIED if c != "reader_id"]]
    return picks.groupBy("reader_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("picks"))


def with_reader(rows: DataFrame, per_reader: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with the row of their reader; a reader with many candidates is met in parts.

    ``sizes`` has the number of ``candidates`` of every reader. The parts keep a hot reader's rows out of a single task, and what
    groups by reader afterwards is cut down in every task first. Only readers of several parts are broadcast: at most one
    per ``JOINED_ROWS`` candidates in all.
    """
    parts = F.ceil(F.col("candidates") / JOINED_ROWS).cast("bigint")
    large = F.broadcast(sizes.filter(F.col("candidates") > JOINED_ROWS).select("reader_id", parts.alias("_parts")))
    of = F.coalesce("_parts", F.lit(1).cast("bigint"))
    dealt = rows.join(large, "reader_id", "left").withColumn("_part", F.pmod(F.xxhash64("item_id"), of)).drop("_parts")
    copies = per_reader.join(large, "reader_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1))).drop("_parts")
    return dealt.join(copies, ["reader_id", "_part"]).drop("_part")


def curated_picks(items: DataFrame, now: Column, block: int = BLOCK, run: DataFrame | None = None) -> DataFrame:
    """(reader_id, item_id, position, ...) of the diverse pick, without the always-kept starred items.

    ``run`` is the table of ``prepared`` where it is there already; the items are not read again then.
    """
    run = prepared(items, now) if run is None else run
    limits = durable(budgets(run))
    bounds = limits.drop("total", "candidates")
    pool = of_run(run)
    schema = pool.select(*_CARRIED, F.lit(0).alias("position")).schema
    remaining, rounds = pool, []
    while True:
        earlier = None
        if rounds:
            picked = reduce(DataFrame.unionByName, rounds)
            earlier = picked.join(bounds, "reader_id")
        # The limits come after the cut: a join by reader before it would bring a reader's candidates into one task.
        best = top_k(remaining, ["reader_id"], best_first(), block).join(bounds, "reader_id")
        best = durable(best.withColumn("position", F.lit(None).cast("int")))
        work = best.drop("rank")
        if earlier is not None:
            work = work.unionByName(earlier.join(best.select("reader_id").distinct(), "reader_id", "left_semi"))
        rounds.append(durable(work.groupBy("reader_id").applyInPandas(_extend, schema)))
        picked = reduce(DataFrame.unionByName, rounds)
        # Readers whose block was full and whose budget is not: only they can have more.
        last = best.filter(F.col("rank") == block).select(
            "reader_id", F.struct(-F.col("score"), -F.unix_micros("published_at"), "item_id").alias("_last"), *bounds.drop("reader_id").columns
        )
        state = packed_picks(picked).withColumn("n_picks", F.size("picks"))
        still_open = durable(
            last.join(state, "reader_id", "left").filter(F.coalesce("n_picks", F.lit(0)) < F.col("budget")).drop("budget")
        )
        if still_open.isEmpty():
            return picked
        row = {name: F.col(name) for name in _CARRIED}
        later = F.struct(-F.col("score"), -F.unix_micros("published_at"), "item_id") > F.col("_last")
        ruled_out = F.when(
            F.col("picks").isNotNull(), _ruled_out(row, F.col("picks"), F.col("source_cap"), F.col("topic_cap"))
        ).otherwise(False)
        remaining = with_reader(pool, still_open, limits).filter(later & ~ruled_out).select(*pool.columns)


def coverage(items: DataFrame, now: Column, picks: DataFrame, run: DataFrame | None = None) -> DataFrame:
    """Per pick: outlets that ran the same story (itself included) and the score they earn it.

    A pure function of the final picks: each candidate looks only at picks ranked before it.
    """
    run = prepared(items, now) if run is None else run
    limits = durable(budgets(run))
    row = {name: F.col(name) for name in _CARRIED}
    rank = F.struct(-F.col("score"), -F.unix_micros("published_at"), "item_id")
    before = F.filter(
        "picks", lambda p: F.struct(-p["score"], -F.unix_micros(p["published_at"]), p["item_id"]) < rank
    )
    unpicked = of_run(run).join(picks.select("reader_id", "item_id"), ["reader_id", "item_id"], "left_anti")
    joined = with_reader(unpicked, packed_picks(picks).join(limits.select("reader_id", "budget", "source_cap"), "reader_id"), limits)
    others = (
        text.settle(joined, before=before)
        .filter((F.size("before") < F.col("budget")) & (F.size("tokens") >= 4))
        .filter(~_repeats(row, F.col("before"), F.col("source_cap")))
    )
    first = F.get(F.filter("before", lambda p: is_duplicate(row, p)), F.lit(0))
    hits = (
        others.select("reader_id", first["item_id"].alias("item_id"))
        .filter("item_id is not null")
        .groupBy("reader_id", "item_id")
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    return picks.join(hits, ["reader_id", "item_id"], "left").select(
        "reader_id", "item_id", "position", (n + 1).alias("coverage_count"), (F.col("score") + n * 20).alias("boosted_score")
    )


def curated(items: DataFrame, now: Column) -> DataFrame:
    """Ids of the curated feed: picks and every starred item."""
    run = prepared(items, now)
    picks = curated_picks(items, now, run=run).select("reader_id", "item_id")
    starred = run.filter("is_starred").select("reader_id", "item_id")
    return picks.unionByName(starred).dropDuplicates(["reader_id", "item_id"])


def curated_feed(items: DataFrame, now: Column) -> DataFrame:
    """Curated items as full rows."""
    return items.join(curated(items, now), ["reader_id", "item_id"], "left_semi")
