"""Scalar normalisation as column expressions.  Null, NaN and blank count as missing; nothing throws on bad input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted spellings of stamps, in the order they are tried.
STAMP_FORMATS = ("yyyyMMddHHmmss", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def missing_as_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def timestamp_of(text: Column) -> Column:
    """A timestamp from any of STAMP_FORMATS, from ISO 8601 with fractions and offset, else from the first ten
    characters as a date, else null.  An offset is applied: the result is in the session's time zone."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in STAMP_FORMATS]
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"), t.try_cast("timestamp"))
    tries.append(iso)
    return F.coalesce(*tries, F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


def timestamp_of_number(n: Column) -> Column:
    """Epoch milliseconds above 1e12, epoch seconds above 1e9, else digits as a stamp."""
    x = n.cast("long")
    return (
        F.when((n > 1e12) & (n < 1e13), F.timestamp_millis(x))
        .when((n > 1e9) & (n < 1e10), F.timestamp_seconds(x))
        .otherwise(timestamp_of(x.cast("string")))
    )


def month_start(stamp: Column) -> Column:
    return F.trunc(stamp, "month")


def not_before(stamp: Column, threshold: Column) -> Column:
    """Whether the month of stamp is not before that of threshold; no stamp: false, no threshold: true."""
    return F.when(threshold.isNull(), True).otherwise(F.coalesce(month_start(stamp) >= month_start(threshold), F.lit(False)))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def finite_or_null(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def listed(text: Column) -> Column:
    """A JSON array of texts, or a list parted by semicolons; trimmed, blanks dropped."""
    parsed = F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))
    items = F.coalesce(parsed, F.split(text, ";"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def work_arrangement(text: Column) -> Column:
    t = F.lower(F.trim(text))
    onsite = t.contains("onsite") | t.contains("on-site") | t.contains("office")
    return F.when(t.contains("remote"), "remote").when(t.contains("hybrid"), "hybrid").when(onsite, "onsite").otherwise(t)


def remote_bucket(ratio: Column) -> Column:
    return F.when(ratio >= 90, "remote").when(ratio >= 30, "hybrid").when(ratio.isNotNull(), "onsite")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def hash_id(*parts: Column) -> Column:
    """md5 of the parts joined by two bars; null counts as empty."""
    return F.md5(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def token_set(text: Column, stop: list[str]) -> Column:
    """Distinct tokens of letters, digits, plus, hash and dot, without stop words."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9+#.]+"), lambda x: x != "")
    return F.array_except(tokens, F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def lookup_key(text: Column) -> Column:
    """Blanks collapsed, lower case, stray dots, stars and dashes stripped from the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), r"^[ .*-]+|[ .*-]+$", "")


def basic_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), r"^[ .,/-]+|[ .,/-]+$", "")


def resolve_names(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Add `name`, the canonical name of column's key in aliases (alias_key, name); unknown: the text itself."""
    keyed = df.withColumn("__key", lookup_key(F.col(column)))
    found = keyed.join(aliases.select(F.col("alias_key").alias("__key"), F.col("name").alias("__name")), "__key", "left")
    return found.withColumn("name", F.coalesce("__name", F.col(column))).drop("__key", "__name")


def tone(text: Column) -> Column:
    """The number before the first comma; 0 if there is none."""
    return F.coalesce(F.split_part(text, F.lit(","), F.lit(1)).try_cast("double"), F.lit(0.0))


def first_url(text: Column, mark: str = "<UDIV>") -> Column:
    return F.get(F.filter(F.split(text, mark), lambda u: u.rlike("^https?://")), F.lit(0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def title_from_url(url: Column, fallback: Column) -> Column:
    """Last path part without page suffix, dashes and underscores as blanks, at most 120 characters."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"\.(html?|php|aspx)$", ""), "[-_]+", " "))
    title = F.substring(words, 1, 120)
    return F.when((F.length(title) < 8) | ~title.rlike("[A-Za-z]{3}"), fallback).otherwise(title)


def title_signature(title: Column, words: int = 7) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1), 1, words), " ")


#: What is redacted, in this order.
REDACTIONS = (
    (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"(?i)(https?://|www\.|linkedin\.com/)[^ \n\t]+", "[URL]"),
    (r"\+?[0-9][0-9 ().\n\t-]{7,}[0-9]", "[PHONE]"),
    (r"[ \t]+", " "),
    (r"^[ \n\t]+|[ \n\t]+$", ""),
)


def redacted(text: Column) -> Column:
    """Addresses, links and numbers by marks; runs of blanks as one, ends trimmed."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), REDACTIONS, text)


def skill_list(text: Column) -> Column:
    """Items parted by comma, semicolon or bar; ends trimmed; the first spelling of each key is kept."""
    items = F.transform(F.split(text, "[,;|]"), lambda x: F.regexp_replace(x, r"^[ .*'\"\[\]]+|[ .*'\"\[\]]+$", ""))
    items = F.filter(items, lambda x: x != "")
    return F.aggregate(
        items,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def clamp_int32(n: Column) -> Column:
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(0)), F.lit(2147483647)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def with_zscores(df: DataFrame, columns: list[str], suffix: str = "_z", fill: float | None = None) -> DataFrame:
    """Add (x - mean) / population deviation over the whole table; all 0 where the deviation is null or 0.

    The statistics are one row, from one aggregate, so nothing is gathered into a window.  fill: replace
    nulls before the statistics are taken.
    """
    ready = df.fillna(fill, columns) if fill is not None else df
    stats = ready.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns]
    )
    joined = ready.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        z = (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")
        joined = joined.withColumn(f"{c}{suffix}", F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 0.0).otherwise(z))
    return joined.drop(*[f"__m_{c}" for c in columns], *[f"__s_{c}" for c in columns])


def hits(text: Column, hints: list[str]) -> Column:
    """How many of the hints the text holds."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(h)).cast("int") for h in hints])


def hint_sentiment(text: Column, positive: list[str], negative: list[str]) -> Column:
    t = F.coalesce(F.lower(text), F.lit(""))
    p, n = hits(t, positive), hits(t, negative)
    return (p - n) / F.greatest(p + n, F.lit(1))


def completeness(length: Column, skills: Column, flags: list[Column], full_length: int, full_skills: int) -> Column:
    """Share of a full record: half its length, three tenths its skills, the rest its flags."""
    share = 0.5 * F.least(length / full_length, F.lit(1.0)) + 0.3 * F.least(skills / full_skills, F.lit(1.0))
    each = 0.2 / len(flags)
    return F.round(reduce(lambda a, f: a + F.when(f, each).otherwise(0.0), flags, share), 6)


def role_phrase(name: Column, generic: list[str], least: int = 3) -> Column:
    """The name without generic nouns; null if nothing was dropped or too little is left."""
    words = F.split(F.lower(F.trim(name)), r"\s+")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(generic)), " ")
    whole = F.array_join(words, " ")
    return F.when((kept != whole) & (F.length(kept) >= least), kept)


def month_offset(month: Column, n: int) -> Column:
    return F.add_months(month_start(month), n)


def month_age(latest: Column, origin: Column) -> Column:
    """Whole months from latest to origin, at least 0."""
    return F.greatest(F.months_between(month_start(origin), month_start(latest)).cast("int"), F.lit(0))


def labelled_number(text: Column, label: str) -> Column:
    return F.round(F.regexp_extract(text, rf"(?i){label}[:= ]+(-?\d+(?:\.\d+)?)", 1).try_cast("double"), 3)


def event_key(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(url), 1, 12))


def clean_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, " ", " "), "[ \t\r\n\f]+", " "))
