"""Link columns: hosts, canonical keys, resolution, click links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.text import bind

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def host(link: Column) -> Column:
    return F.lower(F.try_parse_url(link, F.lit("HOST")))


def path(link: Column) -> Column:
    return F.lower(F.try_parse_url(link, F.lit("PATH")))


def is_web_link(link: Column) -> Column:
    """http(s) link that names a host."""
    scheme = F.try_parse_url(link, F.lit("PROTOCOL"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host(link)) > 0), F.lit(False))


def canonical_link(link: Column) -> Column:
    """Link without fragment and tracking parameters; null when it cannot be a link."""
    plain = F.substring_index(link, "#", 1)
    stem = F.substring_index(plain, "?", 1)
    query = plain.substr(F.length(stem) + 2, F.length(plain))
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~p.rlike(fixed.TRACKING_PARAMETER)), "&")
    joined = F.when(query == "", plain).when(kept == "", stem).otherwise(F.concat(stem, F.lit("?"), kept))
    return F.when(~link.rlike(r"[\s<>]"), joined)


def source_key(feed_id: Column, link: Column, author: Column) -> Column:
    return F.coalesce(feed_id.cast("string"), host(link), F.lower(author), F.lit("unknown"))


def publisher_key(site_url: Column, feed_url: Column, item_id: Column) -> Column:
    site = F.coalesce(_filled(host(site_url)), _filled(host(feed_url)))
    return F.coalesce(
        F.regexp_replace(site, r"^www\.", ""), F.concat(F.lit("unknown-publisher-"), item_id.cast("string"))
    )


def dedupe_key(guid: Column, link: Column, feed_id: Column, title: Column, published_at: Column) -> Column:
    """Identity of an item: guid, else link, else feed, title and time."""
    return (
        F.when(F.trim(guid) != "", F.concat(F.lit("guid:"), guid))
        .when(F.trim(link) != "", F.concat(F.lit("link:"), link))
        .otherwise(
            F.concat_ws(
                ":",
                F.lit("fallback"),
                F.coalesce(feed_id.cast("string"), F.lit("nofeed")),
                title,
                F.unix_seconds(published_at).cast("string"),
            )
        )
    )


def _collapse_dots(path_text: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", done)
            .when(
                segment == "..",
                F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done),
            )
            .otherwise(F.concat(done, F.array(segment)))
        )

    walked = F.array_join(F.aggregate(F.split(path_text, "/", -1), F.array().cast("array<string>"), step), "/")
    collapsed = F.concat(walked, F.when(path_text.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(""))
    return F.when(path_text.contains("/."), collapsed).otherwise(path_text)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def placed(link: Column) -> Column:
        """Relative to the site or the page's folder."""
        stem = F.regexp_extract(link, r"^([^?#]*)", 1)
        tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
        full = F.when(link.startswith("/"), stem).otherwise(F.concat(folder, stem))
        return F.concat(site, bind(full, _collapse_dots), tail)

    def choose(link: Column) -> Column:
        return (
            F.when(link.isNull() | (link == ""), F.lit(None))
            .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("?"), F.concat(page, link))
            .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
            .otherwise(placed(link))
        )

    return bind(href, choose)


def favicon(icon_url: Column, site_url: Column, feed_url: Column) -> Column:
    absolute = F.when(icon_url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), icon_url)
    return F.coalesce(absolute, F.concat(F.lit("https://"), _filled(host(F.coalesce(site_url, feed_url))), F.lit("/favicon.ico")))


def normalize_address(text: Column) -> Column:
    """What a reader typed as a feed address, made a full link; null when it cannot be one."""
    typed = F.regexp_replace(text, f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")
    bare = F.when(
        F.lower(typed).startswith("feed:"), F.regexp_replace(typed.substr(F.lit(6), F.length(typed)), r"^/+|/+$", "")
    ).otherwise(typed)
    full = F.when(F.lower(bare).rlike(r"^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    usable = (typed != "") & ~typed.rlike(r"[ \n]") & F.coalesce(host(full).contains("."), F.lit(False))
    return F.when(usable, full)


def click_target(link: Column, schemes: list[str]) -> Column:
    """In-app link to (kind, id); null for foreign schemes and unknown shapes."""
    scheme = F.lower(F.regexp_extract(link, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    place = F.lower(F.regexp_extract(link, r"^[^:]+://([^/?#]*)", 1))
    ident = F.regexp_extract(link, r"^[^:]+://[^/?#]*/+([^/?#]*)", 1)
    kind = (
        F.when(place == "all", "all")
        .when(place.isin("feed", "feeds") & ident.rlike(UUID), "feed")
        .when(place.isin("article", "articles") & ident.rlike(UUID), "article")
        .when(~place.isin("feed", "feeds", "article", "articles") & place.rlike(UUID), "article")
    )
    target = F.when(kind == "all", F.lit(None)).when(place.rlike(UUID), place).otherwise(F.lower(ident))
    return F.when(scheme.isin(*schemes) & kind.isNotNull(), F.struct(kind.alias("kind"), target.alias("id")))


def first_image(html: Column) -> Column:
    return _filled(F.regexp_extract(html, fixed.INLINE_IMAGE, 1))
