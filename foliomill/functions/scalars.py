"""Text, number and date cleaners as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that a title keeps in lower case
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "if", "in", "of", "on", "or", "the", "to", "with", "vs", "vs.", "v", "v."]
#: fixed values: named entities that are replaced without Python
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    """Text of an HTML column: entities replaced, tags to spaces, white space collapsed."""
    for entity, sign in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def escape_html(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def file_name(c: Column, longest: int = 50) -> Column:
    """Without characters that paths forbid, spaces collapsed, cut."""
    return F.rtrim(F.substring(squeeze(F.regexp_replace(c, r'[<>:"/\\|?*]', "")), 1, longest))


def safe_file_name(c: Column) -> Column:
    """Every character that is not a word character, space, dot or dash becomes _."""
    return F.regexp_replace(F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9_. -]", "_"), F.lit(". ")), "[ _]+", "_")


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def title_case(c: Column) -> Column:
    """Capitalised words; small words stay lower, but never first or last."""
    words = F.split(squeeze(c), " ")
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])
    cased = F.transform(words, lambda w, i: F.when((i > 0) & (i < F.size(words) - 1) & F.array_contains(small, F.lower(w)), F.lower(w)).otherwise(_capital(w)))
    return F.when(squeeze(c) == "", c).otherwise(F.array_join(cased, " "))


def plain(c: Column) -> Column:
    """Only ASCII letters, digits, dashes, apostrophes and white space."""
    return F.trim(F.regexp_replace(c, r"[^A-Za-z0-9\-'\s]", ""))


def tag_name(c: Column) -> Column:
    """Trimmed, letters capitalised after every non-letter, lower-cased otherwise."""
    parts = F.regexp_extract_all(F.trim(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, _capital), "")


def tag_words(c: Column) -> Column:
    """Each white-space word capitalised."""
    return F.array_join(F.transform(F.split(squeeze(c), " "), _capital), " ")


def invert_author(c: Column) -> Column:
    """'Last, First' as 'First Last'."""
    return F.trim(F.regexp_replace(c, r"^([^,]+),\s*(.+)$", "$2 $1"))


def clean_list(c: Column) -> Column:
    """Trimmed, blanks dropped, first of equal elements kept."""
    return F.array_distinct(F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v != ""))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def normalize_unicode(c: Column) -> Column:
    """NFKC; Spark has no built-in for it."""
    return F.pandas_udf(_nfkc, "string")(c)


def unescape_html(c: Column) -> Column:
    """All named and numeric entities; ``strip_html`` covers the common ones without Python."""
    return F.pandas_udf(_unescape, "string")(c)


def _weighted(digits: Column, weight) -> Column:
    """Sum of digit times weight(position from 0)."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * weight(i - 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _one_three(i: Column) -> Column:
    return F.when(i % 2 == 0, 1).otherwise(3)


def isbn13_check(twelve: Column) -> Column:
    """Check digit of the first twelve digits."""
    return (10 - _weighted(twelve, _one_three) % 10) % 10


def isbn10_to_13(c: Column) -> Column:
    """ISBN-10 as ISBN-13; other values as they are."""
    twelve = F.concat(F.lit("978"), F.substring(c, 1, 9))
    return F.when(c.rlike("^[0-9]{9}[0-9Xx]$"), F.concat(twelve, isbn13_check(twelve).cast("string"))).otherwise(c)


def valid_isbn(c: Column) -> Column:
    u = F.upper(c)
    last = F.when(F.substring(u, 10, 1) == "X", 10).otherwise(F.substring(u, 10, 1).try_cast("int"))
    ten = u.rlike("^[0-9]{9}[0-9X]$")
    sum10 = F.when(ten, _weighted(F.substring(u, 1, 9), lambda i: 10 - i) + last)
    thirteen = u.rlike("^[0-9]{13}$")
    sum13 = F.when(thirteen, _weighted(u, _one_three))
    return F.coalesce(F.when(ten, sum10 % 11 == 0).when(thirteen, sum13 % 10 == 0), F.lit(False))


def duplicate_key(title: Column, authors: Column, isbn: Column | None = None) -> Column:
    """Digits of the ISBN if given, else cleaned title and sorted authors."""
    bare = squeeze(F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", ""), r"\[[^\]]*\]", ""))
    names = F.array_join(F.array_sort(F.transform(authors, lambda a: F.lower(F.trim(a)))), "|")
    by_name = F.concat_ws("::", bare, names)
    if isbn is None:
        return by_name
    digits = F.regexp_replace(isbn, "[^0-9X]", "")
    return F.when(F.coalesce(digits, F.lit("")) != "", F.concat(F.lit("isbn:"), digits)).otherwise(by_name)


def weighted_similarity(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the similarities that are not null."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(s, F.lit(0.0)) * w for s, w in parts), F.lit(0.0)), total)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 1 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def human_size(c: Column) -> Column:
    """Bytes as B to TB with two decimals, rounded from the double itself: one that lies halfway goes to the even digit."""
    out = None
    for k, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        text = F.concat_ws(" ", F.call_function("format_number", c / F.lit(float(1024**k)), F.lit("0.00")), F.lit(unit))
        below = F.abs(c) < (float(1024 ** (k + 1)) if unit != "TB" else float("inf"))
        out = F.when(below, text) if out is None else out.when(below, text)
    return out.otherwise(F.format_string("%.2f %s", c.cast("double"), F.lit("TB")))


def parse_date(c: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM or YYYY, with any time of day cut off."""
    day = F.trim(F.substring_index(c, "T", 1))
    return F.coalesce(*[F.when(day.rlike(p), F.try_to_date(day, f)) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^\d{4}$", "yyyy"))])


def time_range(expression: Column, now: Column) -> tuple[Column, Column]:
    """First and last day of 'last week', 'this month' and the like, as of ``now``."""
    e, day = F.lower(F.trim(expression)), F.to_date(now)
    monday = F.date_sub(day, F.weekday(day))
    starts = {"last month": F.trunc(F.add_months(day, -1), "month"), "last week": F.date_sub(day, 7), "last year": F.trunc(F.add_months(day, -12), "year"), "this month": F.trunc(day, "month"), "this week": monday, "this year": F.trunc(day, "year")}
    ends = {"last month": F.date_sub(F.trunc(day, "month"), 1), "last year": F.date_sub(F.trunc(day, "year"), 1)}
    start = F.coalesce(*[F.when(e == k, v) for k, v in starts.items()])
    return start, F.coalesce(*[F.when(e == k, ends.get(k, day)) for k in starts])


def day_part(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 22), "evening").otherwise("night")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def shorten(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a word with an ellipsis."""
    cut = F.substring(c, 1, n - 3)
    at_word = F.when(cut.contains(" "), F.regexp_replace(cut, r"\s+\S*$", "")).otherwise(cut)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(at_word, F.lit("...")))


def stars(rating: Column) -> Column:
    return F.when(rating.isNull(), "").otherwise(F.repeat(F.lit("★"), rating))


def cell(c: Column, width: int) -> Column:
    """A fixed-width cell, truncated with an ellipsis."""
    c = F.coalesce(c, F.lit(""))
    return F.rpad(F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c), width, " ")


def format_path(path: Column, name: Column, fmt: Column) -> Column:
    """Path of a format's file, with its extension once."""
    ext = F.concat(F.lit("."), F.lower(fmt))
    return F.concat_ws("/", path, F.when(F.lower(name).endswith(ext), name).otherwise(F.concat(name, ext)))


def stable_id(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)


def pages_per_minute(pages: Column, minutes: Column) -> Column:
    return F.try_divide(pages.cast("double"), F.when(minutes > 0, minutes))


def standardize(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Map of the fields that a cleaner changes: name -> {old, new}."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(old.alias("old"), new.alias("new")).alias("value")) for k, (old, new) in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"])))
