"""Personal data: pattern spans, and terms that disclose them, by column expressions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers; beside them stand secrets (keys,
tokens and passwords behind their names, and forms that only keys have).  Protected entities are every distinct
value, the group that it belongs to (an address's domain, the first digits of a number) and its kind.  Over all
documents, each distinct text counting once, a term t discloses an entity c as far as it raises the
probability of c:

    PMI(t; c) / IC(c) = log(N n(t, c) / (n(t) n(c))) / log(N / n(c))

where n(t) counts texts with t anywhere and n(c) texts with c.  n(t, c) counts texts that hold both, if c is a
kind, and texts with t within `window` characters of c, if c is a value or a group: a kind has few values, so
whole texts stay linear there.  Pairs seen in at least `support` texts whose ratio reaches `threshold` are
disclosing; a group or kind must moreover be seen with the term beside two values at least, so that copies of
one text do not make all its words disclosing.  A disclosing term becomes a span of kind `term` wherever it
stands in a text that holds the entity.  sanitised() generalises all spans to their kind.

Patterns are possessive or bounded, so that long runs cost linear time.  Null text counts as empty; repeated
rows get equal spans; rows without id are kept; other columns pass through whatever their names.  Empty tables
give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import written

#: The four base kinds.  \\G and the lookbehinds only skip starts that could not match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"
#: Keys and passwords: behind a name and a sign of assignment; or of a form of their own.
NAMED = r"(?:token|secret|passwd|password|pwd|apikey|api[_-]key|access[_-]key|private[_-]key|auth)"
SECRET = (
    r"(?<=[:=\"' \t])(?=[A-Za-z0-9_./+-]{12})"  # of few places, before the costly look back
    rf"(?i)(?<={NAMED}[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?)[a-z0-9_./+=-]{{12,}}+"
    r"|(?-i)AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
)
#: What a text must hold before the whole pattern is tried: cheap tests, as nearly all texts fail them.
ASSIGNED = r"[:=][ \t]{0,3}[\"']?[A-Za-z0-9_./+=-]{12}"
MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ", "-----BEGIN")
CHUNK = 128
KINDS = ("email", "ip", "card", "phone")


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _total(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"])


def _starts(pieces: Column) -> Column:
    """Start of each match from the gaps before and the lengths: sums over chunks, then within the chunk."""
    last = F.floor((F.size(pieces) - 1) / CHUNK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda c: _total(F.slice(pieces, c * CHUNK + 1, CHUNK)))

    def placed(before: Column) -> Column:
        def start(x: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            return F.get(before, chunk) + _total(F.slice(pieces, chunk * CHUNK + 1, i % CHUNK)) + x["gap"]

        return F.transform(pieces, start)

    def prefix(s: Column) -> Column:
        return F.transform(s, lambda x, c: F.aggregate(F.slice(s, F.lit(1), c), F.lit(0), lambda a, b: a + b))

    return bound(sums, lambda s: bound(prefix(s), placed))


NONE = "cast(array() as array<struct<kind:string,start:int,stop:int,value:string>>)"


def found_spans(text: Column, pattern: str, kind: str, gate: Column | None = None) -> Column:
    """Array of (kind, start, stop, value), leftmost non-overlapping, in code points."""
    p = F.lit(pattern)

    def shaped(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("len")))
        starts = bound(pieces, _starts)
        return F.zip_with(
            starts, values,
            lambda s, v: F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("start"), (s + F.length(v)).cast("int").alias("stop"), v.alias("value")),
        )

    hit = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(hit, bound(F.regexp_extract_all(text, p, F.lit(0)), shaped)).otherwise(F.expr(NONE))


def may_hold_secret(text: Column) -> Column:
    return reduce(lambda a, m: a | text.contains(m), MARKS, text.rlike(ASSIGNED))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def added(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), added) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans, by kind and then by start."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    small = lambda v: F.forall(
        F.split(v, r"\."),
        lambda x: bound(F.regexp_replace(x, "^0+(?=.)", ""), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))),
    )
    email = found_spans(text, EMAIL, "email", text.contains("@"))
    ip = F.filter(found_spans(text, IP, "ip"), lambda s: small(s["value"]))
    card = F.filter(found_spans(text, CARD, "card"), lambda s: bound(digits(s["value"]), luhn))
    phone = F.filter(
        found_spans(text, PHONE, "phone", text.contains("+")), lambda s: F.length(digits(s["value"])).between(9, 15)
    )
    return F.concat(email, ip, card, phone)


def _group(span: Column) -> Column:
    """What a value belongs to: an e-mail's domain, the first half of an IP address, a number's first digits."""
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    domain = F.substring_index(F.lower(span["value"]), "@", -1)
    half = F.substring_index(span["value"], ".", 2)
    return (
        F.when(span["kind"] == "email", F.concat(F.lit("email@"), domain))
        .when(span["kind"] == "ip", F.concat(F.lit("ip~"), half))
        .when(span["kind"] == "card", F.concat(F.lit("card~"), F.substr(digits, F.lit(1), F.lit(6))))
        .when(span["kind"] == "phone", F.concat(F.lit("phone~"), F.substr(digits, F.lit(1), F.lit(4))))
    )


def _value(span: Column) -> Column:
    return F.concat(span["kind"], F.lit(":"), F.lower(span["value"]))


def _context(text: Column, span: Column, window: int) -> Column:
    """Words within window characters of the span: (value, group, term)."""
    size = F.length(text)
    left = F.greatest(F.lit(0), span["start"] - window)
    right = F.least(size, span["stop"] + window)

    def words(piece: Column, cut_left: Column, cut_right: Column) -> Column:
        whole = F.regexp_replace(piece, F.when(cut_left, F.lit(r"^\p{L}+")).otherwise(F.lit("^$")), "")
        whole = F.regexp_replace(whole, F.when(cut_right, F.lit(r"\p{L}+$")).otherwise(F.lit("^$")), "")
        return F.transform(
            F.regexp_extract_all(F.lower(whole), F.lit(WORD), F.lit(0)),
            lambda w: F.struct(_value(span).alias("value"), _group(span).alias("grp"), w.alias("term")),
        )

    ahead = words(F.substr(text, left + 1, span["start"] - left), left > 0, F.lit(False))
    after = words(F.substr(text, span["stop"] + 1, right - span["stop"]), F.lit(False), right < size)
    return F.concat(ahead, after)


def _masked(pattern: str, gate):
    def body(text: Column) -> Column:
        blank = F.regexp_replace(text, pattern, " ")
        return blank if gate is None else F.when(gate(text), blank).otherwise(text)

    return body


def _outside(text: Column) -> Column:
    """Distinct lower-cased words of the text without what the patterns match."""
    gates = {EMAIL: lambda t: t.contains("@"), PHONE: lambda t: t.contains("+"), SECRET: may_hold_secret}
    for pattern in (EMAIL, IP, CARD, PHONE, SECRET):
        gate = gates.get(pattern)
        text = bound(text, _masked(pattern, gate))
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def disclosing_pairs(
    docs: DataFrame, based: DataFrame, text: str, support: int, threshold: float, most_broadcast: int = 500_000
) -> DataFrame:
    """(entity, term) pairs whose disclosure reaches the threshold.

    based: __text_hash, __mark (hash of the text's least value), kinds, values, words, contexts of all texts
    with an entity.
    """
    once = written(based.dropDuplicates(["__text_hash"]), "pii-entities")
    total = docs.select(F.count("*")).first()[0]
    n = F.lit(float(max(total, 1)))
    entities = once.select(F.explode(F.concat("kinds", "values")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c"))
    seen = [F.count("*").alias("n_tc"), F.min("__mark").alias("low"), F.max("__mark").alias("high")]
    # of a kind in n_c texts no term in more than n_c^threshold N^(1 - threshold) texts can reach the threshold
    most = once.select(F.explode("kinds").alias("kind")).groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    bound_of = most**threshold * max(total, 1) ** (1 - threshold)
    words = once.select("__mark", F.explode("words").alias("term"))
    around = words.groupBy("term").agg(*seen).where(F.col("n_tc") >= support).withColumnRenamed("n_tc", "n_around")
    around = written(around, "pii-words")
    usual = around.where((F.col("n_around") <= bound_of) & (F.col("low") < F.col("high")))
    few = usual.count() <= most_broadcast  # a checked size; more terms are joined by a shuffle
    usual_terms = F.broadcast(usual.select("term")) if few else usual.select("term")
    whole = once.select("__mark", "kinds", F.explode("words").alias("term")).join(usual_terms, "term", "left_semi")
    whole = whole.select(F.explode("kinds").alias("entity"), "term", "__mark").groupBy("entity", "term").agg(*seen)
    near = once.select("__mark", F.explode(F.array_distinct("contexts")).alias("w"))
    near = near.select(F.explode(F.array("w.value", "w.grp")).alias("entity"), "w.term", "__mark", "w.value").where("entity IS NOT NULL")
    near = near.groupBy("entity", "term").agg(*seen)
    pairs = whole.unionByName(near).where((F.col("n_tc") >= support) & ((F.col("low") < F.col("high")) | F.col("entity").contains(":")))
    ic = F.log(n / F.col("n_c"))
    reaches = lambda n_t: (ic > 0) & (F.log(n * F.col("n_tc") / (n_t * F.col("n_c"))) / ic >= threshold)
    # texts with an entity and t are a lower bound of n(t): pairs that this alone rules out go first
    pairs = pairs.join(around.select("term", "n_around"), "term").join(entities, "entity").where(reaches(F.greatest("n_tc", "n_around")))
    pairs = written(pairs.select("entity", "term", "n_tc", "n_c"), "pii-pairs")
    terms = written(pairs.select("term").distinct(), "pii-terms")
    count = terms.count()
    if not count:
        return pairs.select("entity", "term")
    words = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))).alias("term"))
    if count <= most_broadcast:  # as above
        words = words.join(F.broadcast(terms), "term", "left_semi")
    else:
        words = words.join(terms, "term", "left_semi")
    texts = words.groupBy("term", "h").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_t"))
    ranked = pairs.join(texts, "term", "left").withColumn("n_t", F.coalesce("n_t", "n_tc"))
    return ranked.where(reaches(F.greatest("n_t", "n_tc"))).select("entity", "term")


def with_spans(
    docs: DataFrame, keep: list[str], text: str = "text", window: int = 48, support: int = 3, threshold: float = 0.9,
    most_broadcast: int = 500_000,
) -> DataFrame:
    """The keep columns, `base` (base spans), `secrets` and `terms` (disclosing spans) of every row.

    keep: any names but those three.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    given = [F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)]
    based = docs.select(*kept, t.alias("__t")).withColumn("base", base_spans(F.col("__t")))
    based = based.withColumn("secrets", found_spans(F.col("__t"), SECRET, "secret", may_hold_secret(F.col("__t"))))
    some = F.size("base") + F.size("secrets") > 0
    based = based.withColumn("__row", F.monotonically_increasing_id()).withColumn("__t", F.when(some, F.col("__t")))
    based = written(based, "pii-base")  # fixes the row numbers
    holds = F.col("__t").isNotNull()
    every = F.concat("base", "secrets")
    own = based.where(holds).select(
        "__row", F.xxhash64("__t").alias("__text_hash"), _outside(F.col("__t")).alias("words"),
        F.array_min(F.transform(every, lambda s: F.xxhash64(_value(s)))).alias("__mark"),
        F.array_distinct(F.transform(every, lambda s: s["kind"])).alias("kinds"),
        F.array_distinct(F.flatten(F.transform(every, lambda s: F.array(_value(s), F.coalesce(_group(s), _value(s)))))).alias("values"),
        F.flatten(F.transform(every, lambda s: _context(F.col("__t"), s, window))).alias("contexts"),
    )
    own = written(own, "pii-own")
    pairs = written(disclosing_pairs(docs, own.drop("__row"), text, support, threshold, most_broadcast), "pii-disclosing")
    words = own.select("__row", F.explode("words").alias("term"))
    words = words.join(F.broadcast(pairs) if pairs.count() <= most_broadcast else pairs, "term")  # a checked size
    held = own.select("__row", F.explode(F.concat("kinds", "values")).alias("entity"))
    hits = words.join(held, ["__row", "entity"]).groupBy("__row").agg(F.collect_set("term").alias("hits"))
    joined = based.where(holds).join(hits, "__row", "left").withColumn("all", every)

    def told(w: Column) -> Column:
        inside = F.exists("all", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"]))
        return F.array_contains("hits", F.lower(w["value"])) & ~inside

    terms = F.when(F.col("hits").isNotNull(), F.filter(found_spans(F.col("__t"), WORD, "term"), told)).otherwise(F.expr(NONE))
    joined = joined.withColumn("terms", terms).select(*given, "base", "secrets", "terms")
    return joined.unionByName(based.where(~holds).withColumn("terms", F.expr(NONE)).select(*given, "base", "secrets", "terms"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of base spans, all spans as text."""
    found = with_spans(docs, ["doc_id"])
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.concat("base", "secrets", "terms")
    return found.select(
        "doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(every).alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"),
        F.size(F.concat("base", "secrets")).cast("long").alias("n_private"),
    )


def merged(spans: Column) -> Column:
    """Spans by start, those that overlap united under the first one's kind."""
    slim = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    none = F.expr("cast(array() as array<struct<start:int,stop:int,kind:string>>)")

    def join(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wide = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (x["start"] < last["stop"])
        return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wide))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(slim, none, join)


def generalised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets."""

    def written_out(m: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            since = F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["stop"])
            return F.concat(F.substr(text, since + 1, x["start"] - since), F.lit("["), F.upper(x["kind"]), F.lit("]"))

        tail = F.get(m, F.size(m) - 1)["stop"]
        return F.concat(F.array_join(F.transform(m, piece), ""), F.substr(text, tail + 1, F.length(text)))

    return F.when(F.size(spans) > 0, bound(merged(spans), written_out)).otherwise(text)


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data and the terms that disclose it generalised in the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with those added here
    t = names[docs.columns.index(text)]
    found = with_spans(docs.toDF(*names), names, t)
    once = found.withColumn("__spans", F.concat("base", "secrets", "terms"))
    once = once.withColumn("__out", generalised(F.col(t), F.col("__spans")))
    # what was cut out may leave a new match behind, as of a number that a longer one had swallowed
    left = F.when(F.size("__spans") > 0, base_spans(F.col("__out"))).otherwise(F.expr(NONE))
    once = once.withColumn("__left", left)
    return once.withColumn(t, generalised(F.col("__out"), F.col("__left"))).select(*names).toDF(*docs.columns)
