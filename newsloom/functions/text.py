"""Text columns: cleaning, snippets, titles and tokens. Everything stays in JVM expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed


# The intersection rejects printable ASCII with one range check before the exact class is tried.
_SPACE = r"[\x00-\x20\x{85}-\x{3000}&&" + fixed.WHITESPACE + "]"
_ODD_SPACE = r"[\x00-\x1F\x{85}-\x{3000}&&" + fixed.WHITESPACE.replace(" ", "") + "]"
_TO_SQUASH = f" {_SPACE}+|{_ODD_SPACE}{_SPACE}*"


def squash(text: Column) -> Column:
    """Collapse every run of white space to one space and trim.

    Lone plain spaces, by far the most common run, do not match, so they cost no replacement.
    """
    return F.trim(F.regexp_replace(text, _TO_SQUASH, " "))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    Filters on them then test the computed values; through a plain projection Spark would push a
    filter down by repeating the whole expression in it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def count_squashed(flat: Column) -> Column:
    """Words of a text whose white space is already squashed."""
    return bind(
        flat, lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    )


def count_words(text: Column) -> Column:
    return count_squashed(squash(text))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict[str, str]) -> Column:
    """Constant map, built in one call."""
    return F.expr("map(" + ", ".join(_sql_text(x) for pair in values.items() for x in pair) + ")")


def literal_array(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(_sql_text(x) for x in values) + ")")


def space_sentences(text: Column) -> Column:
    """Restore the space after a sentence end; only the punctuation itself is a match candidate."""
    return F.regexp_replace(text, fixed.SENTENCE_END + r"(?<=\p{Ll}{2}" + fixed.SENTENCE_END + r")(?=\p{Lu})", "$0 ")


def _scalar_value(number: Column) -> Column:
    """Character of a code point, null when it is no Unicode scalar."""
    ok = number.isNotNull() & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    hexed = F.lpad(F.hex(number), 8, "0")
    return F.when(ok, F.decode(F.unhex(hexed), "UTF-32"))


def _entity_value(entity: Column) -> Column:
    body = entity.substr(F.lit(2), F.length(entity) - 2)
    named = literal_map(fixed.NAMED_ENTITIES)
    digits = F.regexp_replace(body, "^#x?0*(?=.)", "")
    short = F.length(digits) <= 10  # more digits are no character
    hexadecimal = F.conv(F.when(short, digits), 16, 10).cast("bigint")
    decimal = F.when(short, digits).try_cast("bigint")
    decoded = (
        F.when(body.startswith("#x"), _scalar_value(hexadecimal))
        .when(body.startswith("#"), _scalar_value(decimal))
        .otherwise(F.try_element_at(named, F.lower(body)))
    )
    return F.coalesce(decoded, entity)


def _decode_once(text: Column) -> Column:
    pieces = F.split(text, fixed.ENTITY, -1)
    found = F.regexp_extract_all(text, F.lit(fixed.ENTITY), 0)
    joined = F.array_join(
        F.zip_with(pieces, found, lambda p, e: F.concat(p, F.coalesce(_entity_value(e), F.lit("")))), ""
    )
    return F.when(text.contains("&"), joined).otherwise(text)


def decode_entities(text: Column) -> Column:
    """One left-to-right pass, so ``&amp;lt;`` becomes ``&lt;``; unknown entities stay."""
    return bind(text, _decode_once)


def strip_tags(html: Column) -> Column:
    return squash(space_sentences(decode_entities(F.regexp_replace(html, fixed.TAG, " "))))


def paragraphs(html: Column) -> Column:
    """Array of clean paragraphs: closing block tags and line breaks split, empty ones vanish."""
    broken = F.regexp_replace(F.regexp_replace(html, fixed.BLOCK_BREAK, "\n\n"), fixed.TAG, " ")
    parts = F.split(space_sentences(decode_entities(broken)), "\n\n", -1)
    return F.filter(F.transform(parts, squash), lambda p: p != "")


def clean_collected(text: Column) -> Column:
    """Cleaner of the corpus collector: tags, then five entities one after the other."""
    out = F.regexp_replace(text, fixed.TAG, " ")
    for name, value in [("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&")]:
        out = F.replace(out, F.lit(name), F.lit(value))
    return squash(out)


def snippet(summary: Column, content: Column, limit: int = 200) -> Column:
    raw = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(content)
    return F.nullif(F.substring(strip_tags(raw), 1, limit), F.lit(""))


def minutes_for_words(words: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / F.lit(220.0))).cast("int")


def reading_minutes(content: Column) -> Column:
    """Known only for texts of 200 words and more."""
    return bind(count_squashed(strip_tags(content)), lambda n: F.when(n >= 200, minutes_for_words(n)))


def feed_word_count(content: Column, summary: Column) -> Column:
    return count_squashed(strip_tags(F.coalesce(content, summary, F.lit(""))))


def normalize_title(title: Column) -> Column:
    """Lower-case words, joined by one space. Marks stay with their letter."""
    return F.array_join(_title_words(title), " ")


def _title_words(title: Column) -> Column:
    return F.filter(F.split(F.lower(title), r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != "")


def title_tokens(title: Column) -> Column:
    """Distinct substantive words: three letters and more or all digits, no stop words."""
    words = F.filter(_title_words(title), lambda w: (F.length(w) >= 3) | w.rlike(r"^\p{N}+$"))
    return F.array_except(words, literal_array(fixed.STOP_WORDS))


def title_similarity(left: Column, right: Column) -> Column:
    """Jaccard of two token arrays, 0 under three shared tokens."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(shared >= 3, shared / total).otherwise(F.lit(0.0))


def _fold_table() -> tuple[str, str]:
    """Every character that full canonical decomposition turns into one base character and marks."""
    source, target = [], []
    for code in range(0xC0, 0x30000):
        if 0xAC00 <= code <= 0xDFFF:  # syllables decompose into several letters, surrogates are none
            continue
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Case and accents removed."""
    return F.lower(F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), r"\p{Mn}+", ""))


def label_text(label: Column) -> Column:
    """White space, then punctuation, trimmed from both ends."""
    trimmed = F.regexp_replace(label, f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")
    return F.regexp_replace(trimmed, r"^\p{P}+|\p{P}+$", "")


def label_key(label: Column) -> Column:
    return F.nullif(squash(fold(label_text(label))), F.lit(""))


def leading_sentences(title: Column, content: Column) -> Column:
    """Extractive summary: the first two sentences over 30 characters, else the title."""
    parts = F.transform(
        F.split(content, r"[.!?\n]", -1),
        lambda s: F.regexp_replace(s, f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", ""),
    )
    long = F.filter(parts, lambda s: F.length(s) > 30)
    second = F.when(F.size(long) > 1, F.concat(F.lit(" "), F.try_element_at(long, F.lit(2)), F.lit("."))).otherwise("")
    return F.when(F.size(long) > 0, F.concat(F.try_element_at(long, F.lit(1)), F.lit("."), second)).otherwise(title)


def numbered_blocks(blocks: Column, limit: int = 4000) -> Column:
    """``[BLOCK i] text`` lines for a summariser prompt of bounded length."""
    lines = F.transform(blocks, lambda b, i: F.concat(F.lit("[BLOCK "), i.cast("string"), F.lit("] "), b))
    return F.substring(F.array_join(lines, "\n"), 1, limit)
