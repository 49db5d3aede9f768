"""Oracle side of the derived tables and text functions, as DuckDB SQL fragments."""

from __future__ import annotations

import re

from newsloom.functions import fixed
from newsloom.plans.derived import BASE_SECONDS, NOW_TEXT

NOW = f"TIMESTAMP '{NOW_TEXT}'"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def sub(expr: str, pattern: str, into: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(into)}, 'g')"


def squash(expr: str) -> str:
    return f"trim({sub(expr, fixed.WHITESPACE + '+', ' ')})"


def words(expr: str) -> str:
    """Word count of an already squashed text."""
    return f"(CASE WHEN {expr} = '' THEN 0 ELSE length({expr}) - length(replace({expr}, ' ', '')) + 1 END)"


def entity(e: str) -> str:
    named = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.NAMED_ENTITIES.items())

    def scalar(number: str) -> str:
        return (
            f"(CASE WHEN {number} <= 1114111 AND NOT ({number} BETWEEN 55296 AND 57343) "
            f"THEN chr(CAST({number} AS INTEGER)) END)"
        )

    dec = f"TRY_CAST(substr({e}, 3, length({e}) - 3) AS BIGINT)"
    hexa = f"TRY_CAST('0x' || substr({e}, 4, length({e}) - 4) AS BIGINT)"
    return (
        f"coalesce(CASE WHEN {e} IS NULL THEN '' WHEN starts_with({e}, '&#x') THEN {scalar(hexa)} "
        f"WHEN starts_with({e}, '&#') THEN {scalar(dec)} "
        f"ELSE CASE lower(substr({e}, 2, length({e}) - 2)) {named} END END, {e}, '')"
    )


def decode(expr: str) -> str:
    e = lit(fixed.ENTITY)
    zipped = f"list_zip(regexp_split_to_array({expr}, {e}), regexp_extract_all({expr}, {e}))"
    joined = f"array_to_string(list_transform({zipped}, lambda z: coalesce(z[1], '') || {entity('z[2]')}), '')"
    return f"(CASE WHEN contains({expr}, '&') THEN {joined} ELSE {expr} END)"


def spaced(expr: str) -> str:
    return sub(expr, fixed.GLUED_SENTENCES, r"\1 \2")


def strip_tags(expr: str) -> str:
    return squash(spaced(decode(sub(expr, fixed.TAG, " "))))


def paragraphs(expr: str) -> str:
    broken = sub(sub(expr, fixed.BLOCK_BREAK, "\n\n"), fixed.TAG, " ")
    return (
        f"list_filter(list_transform(string_split({spaced(decode(broken))}, chr(10) || chr(10)), "
        f"lambda p: {squash('p')}), lambda p: p <> '')"
    )


def normalize_title(expr: str) -> str:
    return f"array_to_string({title_words(expr)}, ' ')"


def title_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> '')"


def tokens(expr: str) -> str:
    stop = ", ".join(lit(w) for w in fixed.STOP_WORDS)
    return (
        f"list_distinct(list_filter({title_words(expr)}, lambda w: (length(w) >= 3 OR "
        f"regexp_full_match(w, '\\p{{N}}+')) AND w NOT IN ({stop})))"
    )


def alternation(phrases: list[str]) -> str:
    return lit("|".join(re.escape(p).replace("\\ ", " ").replace("\\'", "'").replace("\\-", "-") for p in phrases))


def host(expr: str) -> str:
    return f"lower(nullif(regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1), ''))"


def path(expr: str) -> str:
    return f"lower(regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


def promotional(title: str, link: str | None = None) -> str:
    by_title = f"regexp_matches(lower({title}), {alternation(fixed.PROMOTIONAL_PHRASES)})"
    if link is None:
        return by_title
    by_path = f"coalesce(regexp_matches({path(link)}, {alternation(fixed.PROMOTIONAL_PATHS)}), false)"
    return f"({by_title} OR {by_path})"


def clickbait(title: str) -> str:
    return f"regexp_matches(lower({title}), {alternation(fixed.CLICKBAIT_PHRASES)})"


def canonical(expr: str) -> str:
    plain = f"split_part({expr}, '#', 1)"
    query = f"substr({plain}, length(split_part({plain}, '?', 1)) + 2)"
    kept = (
        f"array_to_string(list_filter(string_split({query}, '&'), "
        f"lambda p: NOT regexp_matches(p, {lit(fixed.TRACKING_PARAMETER)})), '&')"
    )
    return (
        f"CASE WHEN NOT regexp_matches({expr}, '[\\s<>]') THEN CASE WHEN {query} = '' THEN {plain} "
        f"WHEN {kept} = '' THEN split_part({plain}, '?', 1) ELSE split_part({plain}, '?', 1) || '?' || {kept} END END"
    )


_FIRST = "split_part(text, chr(10), 1)"
_WORDS = f"array_to_string(string_split({_FIRST}, ' ')[1:12], ' ')"
_SITE = "'https://' || source || '.example.com'"
_LINK_ID = "(CASE WHEN doc_id % 9 = 0 AND doc_id >= 40 THEN doc_id - 40 ELSE doc_id END)"
_PUBLISHED = f"make_timestamp(({BASE_SECONDS} + (doc_id * 37 % 720) * 3600) * 1000000)"

ITEMS_BASE = f"""
items_base AS (
  SELECT doc_id AS item_id, doc_id % 8 AS reader_id, source AS feed_id,
    CASE WHEN doc_id % 35 = 0 THEN '  ' WHEN doc_id % 5 <> 0 THEN 'g' || doc_id END AS guid,
    CASE WHEN doc_id % 23 = 0 THEN '[Sponsored] ' || {_WORDS}
         WHEN doc_id % 29 = 0 THEN 'You won''t believe ' || {_WORDS}
         WHEN doc_id % 31 = 0 THEN left({_WORDS}, 10) ELSE {_WORDS} END AS title,
    CASE WHEN doc_id % 19 = 0 THEN 'Translated ' || {_WORDS} END AS translated_title,
    CASE WHEN doc_id % 41 = 0 THEN {_SITE} || '/sponsored/' || doc_id WHEN doc_id % 37 = 0 THEN NULL
         ELSE {_SITE} || '/a/' || {_LINK_ID} || '?utm_source=x&id=' || {_LINK_ID} || '#top' END AS link,
    CASE WHEN doc_id % 13 <> 0 THEN 'Author ' || (doc_id % 50) END AS author,
    CASE WHEN doc_id % 10 <> 0 THEN '<p>' || {_FIRST} || '</p>Read&nbsp;on &amp; more&hellip;' END AS summary,
    CASE WHEN doc_id % 7 <> 0 THEN '<div><p>' || replace(text, chr(10), '</p><p>') || '</p></div>' END AS content,
    CASE WHEN doc_id % 4 = 0 THEN 'https://img.example.com/' || doc_id || '.jpg' WHEN doc_id % 4 = 1 THEN '   ' END AS image_url,
    {_PUBLISHED} AS published_at,
    {_PUBLISHED} + to_minutes(doc_id % 50) AS discovered_at,
    doc_id % 3 = 0 AS is_read, doc_id % 17 = 0 AS is_starred, doc_id % 6 = 0 AS has_full_text,
    CASE WHEN doc_id % 6 = 0 THEN list_filter(string_split(text, chr(10)), lambda s: s <> '') END AS block_texts,
    CASE WHEN doc_id % 11 = 0 THEN {NOW} - INTERVAL 3 HOUR WHEN doc_id % 11 = 1 THEN {NOW} - INTERVAL 30 HOUR END
      AS extraction_attempted_at,
    lang AS language, text AS body_text,
    (CAST(substr(source, 4) AS INTEGER) + doc_id % 8) % 6 = 0 AS is_vip
  FROM documents)"""

_CONTENT_WORDS = words("content_clean")
ITEMS = f"""{ITEMS_BASE},
items_clean AS (
  SELECT *, {strip_tags("(CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE content END)")} AS snip_clean,
    {strip_tags("content")} AS content_clean
  FROM items_base),
items AS (
  SELECT * EXCLUDE (snip_clean),
    CASE WHEN snip_clean <> '' THEN left(snip_clean, 200) END AS snippet,
    CASE WHEN {_CONTENT_WORDS} >= 200 THEN CAST(greatest(1, ceil({_CONTENT_WORDS} / 220.0)) AS INTEGER) END AS reading_minutes
  FROM items_clean)"""

FEEDS = """
feeds AS (
  SELECT source AS feed_id, 'Feed ' || source AS title, 'https://' || source || '.example.com/rss' AS url,
    CASE WHEN n % 3 <> 0 THEN 'https://www.' || source || '.example.com/' END AS site_url,
    CASE WHEN n % 4 = 0 THEN 'Tech' WHEN n % 4 = 1 THEN ' World ' WHEN n % 4 = 2 THEN '' END AS category,
    CASE WHEN n % 5 = 0 THEN 'https://cdn.example.com/' || source || '.png' WHEN n % 5 = 1 THEN 'icon.png' END AS icon_url,
    n % 10 <> 9 AS enabled
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents))"""

AGE = f"greatest(0.0, (epoch_us({NOW}) - epoch_us(published_at)) / 3600000000.0)"


def score(age: str, starred: str = "is_starred") -> str:
    return f"""(40
      + CASE WHEN {age} < 3 THEN 45 WHEN {age} < 8 THEN 35 WHEN {age} < 18 THEN 26 WHEN {age} < 36 THEN 18
             WHEN {age} < 72 THEN 8 WHEN {age} < 168 THEN 2 ELSE -15 END
      + CASE WHEN is_read THEN -18 ELSE 20 END + CASE WHEN {starred} THEN 45 ELSE 0 END
      + CASE WHEN is_vip THEN 35 ELSE 0 END
      + CASE WHEN reading_minutes >= 3 THEN 12 WHEN reading_minutes >= 1 THEN 6
             WHEN length(snippet) >= 140 THEN 6 ELSE 0 END
      + CASE WHEN has_full_text THEN 10 ELSE 0 END + CASE WHEN length(image_url) > 0 THEN 5 ELSE 0 END
      + CASE WHEN length(title) < 15 THEN -12 ELSE 0 END + CASE WHEN {clickbait("title")} THEN -25 ELSE 0 END)"""


FRESH = f"""({AGE} <= CASE WHEN is_read THEN CASE WHEN is_vip THEN 72 ELSE 48 END
                            ELSE CASE WHEN is_vip THEN 720 ELSE 336 END END)"""
CANDIDATE = f"""(CASE WHEN is_starred THEN {AGE} <= 720 OR NOT is_read
  ELSE (is_vip OR NOT {promotional("title", "link")}) AND {FRESH} END)"""
