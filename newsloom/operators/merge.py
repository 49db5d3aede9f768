"""Merging fetched items and feed metadata into stored tables, and the state changes around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed, rules
from newsloom.operators.ranking import keep_first
from newsloom.session import durable, release

# Order of the checks; the first that hits names the reason.
REASONS = ["dup_guid", "dup_link", "dup_fallback"]


def _trim(column: str) -> Column:
    return F.regexp_replace(F.col(column), f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")


def _identity_keys(items: DataFrame, *keep: str) -> DataFrame:
    """One narrow row per usable identity: guid, link, and title with time."""
    fallback = F.concat_ws(":", "title", F.unix_micros("published_at").cast("string"))
    keys = F.array(
        F.struct(F.lit(0).alias("kind"), _trim("guid").alias("key")),
        F.struct(F.lit(1).alias("kind"), _trim("link").alias("key")),
        F.struct(F.lit(2).alias("kind"), fallback.alias("key")),
    )
    return items.select("feed_id", *keep, F.inline(keys)).filter(F.col("key") != "")


def merge_reasons(incoming: DataFrame, stored: DataFrame, drop_noise: bool = True) -> DataFrame:
    """Incoming items with ``reason``: inserted, dup_guid, dup_link, dup_fallback or noise.

    The three identities meet the store in one narrow join on (feed, kind, key); only the verdict
    per item is joined back to the wide rows.
    """
    known = _identity_keys(stored).distinct()
    hits = (
        _identity_keys(incoming, "item_id")
        .join(known, ["feed_id", "kind", "key"], "left_semi")
        .groupBy("item_id")
        .agg(F.min("kind").alias("_kind"))
    )
    duplicate = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("_kind"))
    noise = F.lit(drop_noise) & ~F.col("is_vip") & rules.is_promotional(F.col("title"), _trim("link"))
    reason = F.when(F.col("_kind").isNotNull(), duplicate).when(noise, "noise").otherwise("inserted")
    return incoming.join(hits, "item_id", "left").withColumn("reason", reason).drop("_kind")


def merge_new(incoming: DataFrame, stored: DataFrame, dedupe: bool = True, drop_noise: bool = True) -> DataFrame:
    """Rows of one fetch to append: new, unread, not starred; repeats within the fetch stay.

    With ``dedupe=False, drop_noise=False`` this is the initial load of a subscription.
    """
    rows = incoming
    if dedupe or drop_noise:
        judged = merge_reasons(incoming, stored if dedupe else stored.limit(0), drop_noise)
        rows = judged.filter(F.col("reason") == "inserted").drop("reason")
    return _cleaned(rows)


def _cleaned(rows: DataFrame) -> DataFrame:
    """Rows as they are stored: identities trimmed, unread, not starred."""
    return (
        rows.withColumn("guid", _trim("guid"))
        .withColumn("link", _trim("link"))
        .withColumn("is_read", F.lit(False))
        .withColumn("is_starred", F.lit(False))
    )


_KEY = ["feed_id", "kind", "h1", "h2"]


def identities(items: DataFrame, *keep: str) -> DataFrame:
    """Identities of items as narrow rows (feed_id, kind, h1, h2, ...): 128 bits of hash in place of the text."""
    return _identity_keys(items, *keep).select("feed_id", "kind", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), *keep)


def merge_in_order(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, discovered_at, feed_id, reason) of many fetches, as if those of a feed had been merged one after the other.

    ``incoming`` has item_id, feed_id, guid, title, link, published_at, is_vip and ``discovered_at``, the time
    of its fetch; items of a feed with one such time are one fetch. ``known`` holds the identities of the stored
    items. An item counts against later fetches only if it is inserted itself, so what happens to a fetch
    depends on those before it. That is settled in rounds: an item whose identities nobody earlier claims
    is inserted, and what meets it later is not. Only items with an identity that several fetches claim
    take part; a round settles the earliest of every such identity.
    """
    noise = ~F.col("is_vip") & rules.is_promotional(F.col("title"), _trim("link"))
    row = ["item_id", "discovered_at"]
    marked = incoming.withColumn("_noise", F.coalesce(noise, F.lit(False)))
    keys = durable(identities(marked, *row, "_noise"))
    stored = durable(keys.join(known.select(*_KEY).distinct(), _KEY, "left_semi"))
    claims = keys.filter("not _noise").join(stored.select(*row).distinct(), row, "left_anti").drop("_noise")
    several = claims.groupBy(*_KEY).agg(F.min("discovered_at").alias("first"), F.max("discovered_at").alias("last")).filter("first < last")
    tables = [keys, stored]
    open_ = durable(claims.join(claims.join(several, _KEY, "left_semi").select(*row).distinct(), row, "left_semi"))
    taken = claims.join(open_.select(*row).distinct(), row, "left_anti")
    while not open_.isEmpty():
        tables.append(open_)
        firsts = open_.groupBy(*_KEY).agg(F.min("discovered_at").alias("first"))
        free = open_.join(firsts, _KEY).groupBy(*row).agg(F.min((F.col("discovered_at") == F.col("first")).cast("int")).alias("free")).filter("free = 1")
        now = durable(open_.join(free, row, "left_semi"))
        held = now.groupBy(*_KEY).agg(F.min("discovered_at").alias("first"))
        late = open_.join(held, _KEY).filter("discovered_at > first").select(*row).distinct()
        settled = now.select(*row).distinct().unionByName(late).distinct()
        taken = taken.unionByName(now)
        tables.append(now)
        open_ = durable(open_.join(settled, row, "left_anti"))
    holders = taken.groupBy(*_KEY).agg(F.min("discovered_at").alias("first"))
    earlier = keys.join(holders, _KEY).filter("discovered_at > first").select(*_KEY, *row)
    hits = stored.select(*_KEY, *row).unionByName(earlier).groupBy(*row).agg(F.min("kind").alias("_kind"))
    duplicate = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("_kind"))
    reason = F.when(F.col("_kind").isNotNull(), duplicate).when(F.col("_noise"), "noise").otherwise("inserted")
    out = durable(marked.select(*row, "feed_id", "_noise").join(hits, row, "left").select(*row, "feed_id", reason.alias("reason")))
    release(*tables, open_)
    return out


def inserted(judged: DataFrame) -> DataFrame:
    """Items with the reasons of ``merge_in_order``: the rows to append."""
    return _cleaned(judged.filter("reason = 'inserted'").drop("reason"))


def merge_report(judged: DataFrame) -> DataFrame:
    """Counts per feed and reason."""
    return judged.groupBy("feed_id", "reason").agg(F.count("*").alias("n"))


def upsert_feed_metadata(feeds: DataFrame, fetched: DataFrame) -> DataFrame:
    """Take over non-empty fetched metadata; validators only when sent; the final url always."""
    new = fetched.select("feed_id", *[F.col(c).alias(f"_{c}") for c in fetched.columns if c != "feed_id"])
    joined = feeds.join(new, "feed_id", "left")
    filled = ["title", "site_url", "description", "icon_url"]
    for name in filled:
        joined = joined.withColumn(name, F.coalesce(F.nullif(F.col(f"_{name}"), F.lit("")), F.col(name)))
    for name, source in [("etag", "_etag"), ("last_modified", "_last_modified"), ("url", "_final_url")]:
        joined = joined.withColumn(name, F.coalesce(F.col(source), F.col(name)))
    return joined.select(*feeds.columns)


def refresh_state(fetches: DataFrame) -> DataFrame:
    """Latest refresh state per feed from a log of fetches (status, etag, error by time).

    304 and success set the success time and clear the error; only success carries validators.
    """
    done = F.col("status").isin(200, 304)
    time = F.col("fetched_at")
    order = F.struct("fetched_at", "fetch_id")
    with_etag = (F.col("status") == 200) & F.col("etag").isNotNull()
    with_modified = (F.col("status") == 200) & F.col("last_modified").isNotNull()
    return fetches.groupBy("feed_id").agg(
        F.max("fetched_at").alias("last_attempt"),
        F.max(F.when(done, time)).alias("last_success"),
        F.max_by("refresh_error", order).alias("refresh_error"),
        F.max_by("etag", F.when(with_etag, order)).alias("etag"),
        F.max_by("last_modified", F.when(with_modified, order)).alias("last_modified"),
        F.count_if(~done).alias("failures"),
    )


def conditional_headers(state: DataFrame, items: DataFrame) -> DataFrame:
    """Validators to send; none for a feed without stored items, so it is fetched whole."""
    stocked = items.select("feed_id").distinct().withColumn("_has_items", F.lit(True))
    joined = state.join(stocked, "feed_id", "left")
    return joined.select(
        "feed_id",
        F.when(F.col("_has_items"), F.col("etag")).alias("if_none_match"),
        F.when(F.col("_has_items"), F.col("last_modified")).alias("if_modified_since"),
    )


def apply_read_events(items: DataFrame, events: DataFrame) -> DataFrame:
    """Read state from an event log: the last event of an item wins; an undo is one more event."""
    return with_marks(items, last_marks(events.withColumn("set_starred", F.lit(None).cast("boolean"))).drop("set_starred"))


def last_marks(events: DataFrame) -> DataFrame:
    """(item_id, set_read, set_starred): the last event that sets each; null where none does."""
    order = F.struct("event_at", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return events.groupBy("item_id").agg(last("set_read"), last("set_starred"))


def with_marks(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items with the read and starred state that ``marks`` set."""
    out = items.join(marks, "item_id", "left")
    for name in ("read", "starred"):
        if f"set_{name}" in marks.columns:
            out = out.withColumn(f"is_{name}", F.coalesce(f"set_{name}", f"is_{name}"))
    return out.drop("set_read", "set_starred")


def mark_all_read(items: DataFrame, scope: Column, event_at: Column) -> DataFrame:
    """Events that mark the unread items of ``scope`` read; the same rows negated undo it."""
    return items.filter(scope & ~F.col("is_read")).select(
        "item_id", F.lit(True).alias("set_read"), event_at.alias("event_at")
    )


def delete_feeds(table: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that survive the deletion of feeds."""
    return table.join(deleted.select("feed_id"), "feed_id", "left_anti")


def delete_orphans(derived: DataFrame, items: DataFrame) -> DataFrame:
    """Derived rows whose item still exists."""
    return derived.join(items.select("item_id"), "item_id", "left_semi")


def clear_derived(table: DataFrame) -> DataFrame:
    """An empty table of the same shape, to overwrite derived results with."""
    return table.filter(F.lit(False))


def rename_folder(feeds: DataFrame, old: str, new: str) -> DataFrame:
    """Move the feeds of a folder; a blank name clears it."""
    name = F.nullif(F.trim(F.lit(new)), F.lit(""))
    in_folder = F.coalesce(F.trim("category"), F.lit("")) == old.strip()
    return feeds.withColumn("category", F.when(in_folder, name).otherwise(F.col("category")))


def new_subscriptions(found: DataFrame, feeds: DataFrame) -> DataFrame:
    """First occurrence of every url that is not subscribed yet."""
    fresh = keep_first(found, ["xml_url"], [F.col("doc_id"), F.col("position")])
    known = feeds.select(F.col("url").alias("xml_url")).distinct()
    return fresh.join(known, "xml_url", "left_anti")


def batch_numbers(df: DataFrame, keys: list[str], order: list[Column], size: int = 12) -> DataFrame:
    """Number rows into batches of at most ``size`` per group."""
    from newsloom.operators.ranking import rank_all

    ranked = rank_all(df, keys, order, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")
