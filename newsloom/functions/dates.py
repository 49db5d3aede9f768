"""Feed dates: two ISO shapes and the mail-style shapes publishers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.text import literal_map


def parse_feed_date(text: Column) -> Column:
    """UTC timestamp, null when no shape fits. A missing zone means UTC."""
    raw = F.regexp_replace(text, f"^{fixed.WHITESPACE}+|{fixed.WHITESPACE}+$", "")
    iso = F.regexp_replace(raw, r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    zoned = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
    plain = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
    from_iso = F.when(iso.rlike(zoned) | iso.rlike(plain), F.try_to_timestamp(iso))

    mail = F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_extract(mail, r" ([A-Z]{1,3})$", 1)
    offsets = literal_map(fixed.ZONE_OFFSETS)
    numeric = F.when(zone == "", mail).otherwise(
        F.concat(mail.substr(F.lit(1), F.length(mail) - F.length(zone)), F.try_element_at(offsets, zone))
    )
    full = r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"
    # Without seconds only the shape with a weekday exists.
    short = r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2} [+-]\d{4}$"
    from_mail = F.when(numeric.rlike(full), F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm:ss xx"))).when(
        numeric.rlike(short) & raw.rlike(r"^[A-Za-z]{3},"), F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm xx"))
    )
    return F.coalesce(from_iso, from_mail)


def start_of_day(now: Column, zone: str, back: int = 0) -> Column:
    """UTC instant of local midnight, ``back`` days before the local day of ``now``."""
    day = F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), back)
    return F.to_utc_timestamp(day.cast("timestamp"), zone)
