"""Matching of terms, names and roles against text.

Vocabularies meet texts by equal tokens or n-grams, not by testing every pair: texts are exploded to their
1- to n-word grams, joined on the gram, and reduced again.  Only fixed rule lists are tested as expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from harborline.operators.relational import MOST_BROADCAST, MOST_DOCS, dealt

TOKENS = "[a-z0-9+#]+"
FEW_HEADS = 1000
#: Short skills that may be matched.
SHORT_SKILLS = ("c++", "c#", ".net", "aws", "sql")
TAGGED, UNTAGGED = re.compile(r"[A-Za-z0-9+#.]+(?:[-/][A-Za-z0-9+#.]+)*|[^\s]"), re.compile(r"[^a-z0-9+#.]+")
CJK = r"[\u2e80-\u9fff\uac00-\ud7af]"


def bounded_term(text: Column, term: str) -> Column:
    """Whether the lower-cased text holds the term, not next to a letter or digit."""
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in term.lower())
    return F.lower(text).rlike(f"(?<![a-z0-9]){quoted}(?![a-z0-9])")


def marked(text: Column) -> Column:
    """The lower-cased text with marks between its characters: \u0001 where no letter or digit stands before,
    \u0002 where none stands after.

    A term stands in a text, not next to a letter or digit, exactly if marked(term) is a substring of marked(text):
    within the term the marks agree, and at its ends the term asks for those that a boundary has.
    """
    low = F.translate(F.lower(text), "\x01\x02", "  ")
    return F.regexp_replace(F.regexp_replace(low, "(?<![a-z0-9])", "\x01"), "(?![a-z0-9\x01])", "\x02")


def contained_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, bounded: bool = True) -> DataFrame:
    """(key, term) for each distinct term that stands in a text, case aside; bounded: not next to a letter or digit.

    An inverted index has each term under its rarest key.  Keys of bounded terms are their runs of letters and
    digits, which must be whole runs of the text; other terms, and those of signs only, go by three characters, or
    by all if they have fewer.  Texts meet the index by equal keys and are then tested; no text meets every term.
    Trimmed terms that are empty are in no text.
    """
    form = marked if bounded else F.lower

    def pieces(x: Column, n: int) -> Column:
        places = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.concat(F.lit(f"{n}:"), F.substring(x, p, F.lit(n))))

    runs = lambda x: F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("w:"), w))
    each = terms.select(term).where(F.trim(term) != "").distinct().withColumn("__form", form(F.trim(term)))
    by_piece = F.when(F.length("__form") >= 3, pieces(F.col("__form"), 3)).when(F.length("__form") == 2, pieces(F.col("__form"), 2)).otherwise(pieces(F.col("__form"), 1))
    keys = F.when(F.size(runs(F.col(term))) > 0, runs(F.col(term))).otherwise(by_piece) if bounded else by_piece
    each = each.select(term, "__form", F.explode(F.array_distinct(keys)).alias("__k"))
    count = each.groupBy("__k").agg(F.count("*").alias("__n"))
    index = each.join(count, "__k").groupBy(term, "__form").agg(F.min(F.struct("__n", "__k")).alias("__m")).select(term, "__form", F.col("__m.__k").alias("__k"))
    held = index.agg(F.count("*").alias("n"), F.collect_set(F.substring("__k", 1, 1)).alias("kinds")).first()  # four kinds at most
    index, kinds = F.broadcast(index) if held.n <= MOST_BROADCAST else index, set(held.kinds)
    asked = texts.select(key, form(F.col(text)).alias("__x"), F.col(text).alias("__t"))
    found = [runs(F.col("__t"))] * ("w" in kinds) + [pieces(F.col("__x"), int(n)) for n in sorted(kinds - {"w"})]
    keyed = F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")
    met = asked.select(key, "__x", F.explode(keyed).alias("__k")).join(index, "__k")
    return met.where(F.contains("__x", F.col("__form"))).select(key, term)


def usable_skills(skills: Column, ambiguous=(), short=SHORT_SKILLS) -> Column:
    """Trimmed skills but empty and ambiguous ones, and those of one or two characters that are not of `short`."""
    low = lambda s: F.lower(F.trim(s))
    good = lambda s: (low(s) != "") & ~low(s).isin(*ambiguous, "") & ((F.length(low(s)) >= 3) | low(s).isin(*short))
    return F.transform(F.filter(skills, lambda s: F.coalesce(good(s), F.lit(False))), lambda s: F.trim(s))


def skill_hits(text: Column, skills: Column, ambiguous=(), short=SHORT_SKILLS) -> Column:
    """Struct (hits, share): usable skills that stand in the text, of any number of words, and their share of all usable."""
    usable = usable_skills(skills, ambiguous, short)
    hits = F.transform(F.array(marked(text)), lambda t: F.filter(usable, lambda s: F.contains(t, marked(s))))[0]  # a text is marked once
    return F.struct(hits.alias("hits"), F.round(F.size(hits) / F.greatest(F.size(usable), F.lit(1)), 6).alias("share"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0))


def grams(df: DataFrame, key: str, text: str, longest: int, heads: list[str] | None = None) -> DataFrame:
    """(key, pos, n, gram): all runs of 1 to longest tokens; with heads, only those that begin with one."""
    words = df.select(key, tokens(F.col(text)).alias("__w"))
    at = words.select(key, "__w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.size("__w") >= F.col("n"))
    places = F.sequence(F.lit(0), F.size("__w") - F.col("n"))
    if heads is not None:
        places = F.filter(places, lambda p: F.get("__w", p).isin(heads))
    runs = F.transform(places, lambda p: F.struct(p.alias("pos"), F.array_join(F.slice(F.col("__w"), p + 1, F.col("n")), " ").alias("gram")))
    return at.select(key, "n", F.explode(runs).alias("r")).select(key, "n", "r.pos", "r.gram")


def dictionary_matches(df: DataFrame, key: str, text: str, aliases: DataFrame, longest: int, most: int) -> DataFrame:
    """(key, names): canonical names whose alias stands in the text, without matches inside longer ones, by
    first place; at most `most`.  aliases: (alias, name), of at most `longest` words.

    Of a vocabulary of few first words only runs that begin with one of them leave the text.
    """
    df = dealt(df.select(key, text), key, MOST_DOCS // 10)
    heads = [r[0] for r in aliases.select(F.split_part("alias", F.lit(" "), F.lit(1))).distinct().limit(FEW_HEADS + 1).collect()]
    found = grams(df, key, text, longest, heads if len(heads) <= FEW_HEADS else None).join(aliases, F.col("gram") == F.col("alias"))
    spans = found.select(key, "pos", (F.col("pos") + F.col("n")).alias("stop"), "n", "name")
    before = Window.partitionBy(key).orderBy("pos", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, "pos")
    inside = (F.coalesce(F.max("stop").over(before), F.lit(-1)) >= F.col("stop")) | (F.col("n") < F.max("n").over(same))
    kept = spans.withColumn("inside", inside).where(~F.col("inside")).groupBy(key, "name").agg(F.min("pos").alias("pos"))
    lists = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return lists.select(key, F.slice(F.transform("l", lambda x: x["name"]), 1, most).alias("names"))


def frequent_terms(df: DataFrame, items: Column, least: int, shortest: int) -> DataFrame:
    """(term, n): trimmed items of the arrays that occur at least `least` times."""
    each = df.select(F.explode(items).alias("term")).select(F.trim("term").alias("term")).where(F.length("term") >= shortest)
    return each.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_repeats(df: DataFrame, parts: list[Column], order: list[Column]) -> DataFrame:
    """The first row in a total order of each key; texts in keys by lower case and trimmed."""
    key = F.xxhash64(*[F.lower(F.trim(p.cast("string"))) for p in parts])
    return df.withColumn("__k", key).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).where("__r = 1").drop("__k", "__r")


def demand_weight(score: Column, salary: Column) -> Column:
    return 0.8 + 0.4 * F.least(score, F.lit(1.0)) + F.least(F.coalesce(salary, F.lit(0.0)) / 500000, F.lit(0.2))


def labels_by_rules(text: Column, rules: dict[str, list[str]]) -> Column:
    """Names of the rules any of whose hints the text holds, in the rules' order."""
    any_hint = lambda hints: reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hints])
    return F.array_compact(F.array(*[F.when(any_hint(h), F.lit(n)) for n, h in rules.items()]))


def first_rule(text: Column, rules: dict[str, list[str]], otherwise: str) -> Column:
    return F.coalesce(F.get(labels_by_rules(text, rules), F.lit(0)), F.lit(otherwise))


def share_with_hints(parts: Column, hints: list[str]) -> Column:
    hit = F.filter(parts, lambda p: reduce(lambda a, b: a | b, [F.contains(p, F.lit(h)) for h in hints]))
    return F.round(F.size(hit) / F.greatest(F.size(parts), F.lit(1)), 6)


def theme_shares(themes: Column, risk: list[str], opportunity: list[str]) -> Column:
    """Struct (risk, opportunity): shares of the themes, parted by semicolons and cut at their #, that hold a hint as a substring."""
    parts = F.filter(F.split(F.coalesce(themes, F.lit("")), ";"), lambda p: F.trim(p) != "")
    names = F.transform(parts, lambda p: F.upper(F.trim(F.split_part(p, F.lit("#"), F.lit(1)))))
    return F.struct(share_with_hints(names, risk).alias("risk"), share_with_hints(names, opportunity).alias("opportunity"))


def merged_skills(raw: Column, matched: Column) -> Column:
    """Skills of a list parted by commas, trimmed and lower-cased, then those matched in the text; each once, where it came first."""
    listed = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    return F.array_distinct(F.concat(listed, F.coalesce(matched, F.array().cast("array<string>"))))


def record_id(given: Column, source: Column, *parts: Column) -> Column:
    """The given id, or the source and the first twelve digits of the parts' MD5 where there is none."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.coalesce(F.when(given.cast("string") != "", given.cast("string")), F.concat(source, F.lit("_"), F.substring(digest, 1, 12)))


def polarity(tone: Column, band: float, kind: Column, kinds: dict[str, str]) -> Column:
    by_kind = reduce(lambda a, kv: a.when(kind == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), ""))
    return F.when(tone > band, "positive").when(tone < -band, "negative").otherwise(F.coalesce(by_kind, F.lit("neutral")))


def majority(edges: DataFrame, node: str, sign: str) -> DataFrame:
    """Sign of the sum of edge signs per node; tie: 0."""
    return edges.groupBy(node).agg(F.signum(F.sum(sign)).cast("int").alias("majority"))


def coarse_bucket(text: Column, rules: dict[str, list[str]]) -> Column:
    """The rule with most hints in the text; the first in order wins ties; none: null."""
    counts = F.array(*[F.struct(sum((F.contains(text, F.lit(h)).cast("int") for h in hints), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("k")) for i, (name, hints) in enumerate(rules.items())])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["k"])


def spans_of_tags(df: DataFrame, key: str, pos: str, tag: str, token: str) -> DataFrame:
    """(key, start, phrase): runs of a B tag and the I tags after it."""
    w = Window.partitionBy(key).orderBy(pos)
    begins = (F.col(tag) == "B").cast("int")
    broken = (F.col(tag) == "O").cast("int")
    marked = df.withColumn("span", F.sum(begins).over(w)).withColumn("gap", F.sum(broken).over(w))
    marked = marked.where((F.col(tag) != "O") & (F.col("span") > 0))
    first_gap = F.min("gap").over(Window.partitionBy(key, "span"))
    inside = marked.withColumn("g", first_gap).where(F.col("gap") == F.col("g"))
    runs = inside.groupBy(key, "span").agg(F.min(pos).alias("start"), F.array_sort(F.collect_list(F.struct(pos, token))).alias("l"))
    return runs.select(key, "start", F.array_join(F.transform("l", lambda x: x[token]), " ").alias("phrase"))


#: Texts that are cut into tokens at a time.
FEW_TEXTS = 250


@F.pandas_udf(StructType([StructField("labels", ArrayType(StringType())), StructField("tokens", ArrayType(StringType()))]))
def weak_labels(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Struct (labels, tokens): the text's tokens, B and I where a skill stands, else O; null if no skill does.

    Skills go by length, longest first, those of one length by name.  One is marked wherever its words stand and its first token is
    not marked yet.  Words meet by an index of the text's tokens, so that a text's time goes with its own matches.  Few texts
    at a time are Python's lists.
    """
    for text, skills in batches:
        for at in range(0, len(text), FEW_TEXTS):
            yield _weakly_labelled(text.iloc[at : at + FEW_TEXTS], skills.iloc[at : at + FEW_TEXTS])


def _weakly_labelled(text: pd.Series, skills: pd.Series) -> pd.DataFrame:
    tokens = [TAGGED.findall(t or "") for t in text]
    out = []
    for words, names in zip(tokens, skills):
        plain = [UNTAGGED.sub("", w.lower()) for w in words]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(plain):
            places.setdefault(w, []).append(i)
        labels, any_hit = ["O"] * len(words), False
        for name in sorted({n for n in (names if names is not None else ()) if n}, key=lambda n: (-len(n), n)):
            wanted = [w for w in (UNTAGGED.sub("", t.lower()) for t in TAGGED.findall(name)) if w]
            for at in places.get(wanted[0], ()) if wanted else ():
                if labels[at] == "O" and plain[at : at + len(wanted)] == wanted:
                    labels[at : at + len(wanted)] = ["B", *["I"] * (len(wanted) - 1)]
                    any_hit = True
        out.append(labels if any_hit else None)
    return pd.DataFrame({"labels": out, "tokens": [w if y is not None else None for w, y in zip(tokens, out)]})


def conversation_records(turns: DataFrame, key: str, turn: str, role: str, text: str, marker: str | None = None) -> DataFrame:
    """(key, text, summary): the last user turn of each conversation, what follows the marker if it holds it, and its last
    assistant turn; blanks are one space, an empty summary is null, conversations without a text are left out."""
    last = lambda r: F.max_by(F.coalesce(text, F.lit("")), F.when(F.col(role) == r, F.col(turn)))
    rows = turns.groupBy(key).agg(last("user").alias("text"), last("assistant").alias("summary"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "\u00a0", " "), r"\s+", " "))
    said = F.col("text")
    if marker is not None:
        said = F.when(F.contains(said, F.lit(marker)), F.substring(said, F.locate(marker, said) + len(marker), F.length(said))).otherwise(said)
    rows = rows.select(key, clean(said).alias("text"), clean(F.col("summary")).alias("summary"))
    return rows.where(F.coalesce("text", F.lit("")) != "").withColumn("summary", F.nullif("summary", F.lit("")))


def without_negated(text: Column, skills: list[str], negations: list[str], before: int = 18, after: int = 8) -> Column:
    """The text without each skill that has a negation near its first place, case aside: `before` characters ahead of it, within
    it, or `after` behind it.  All places of the skill as it is spelled go; skills are tried in their order."""

    def one(x: Column, skill: str) -> Column:
        at = F.locate(skill.lower(), F.lower(x))
        start = F.greatest(F.lit(1), at - before)
        window = F.substring(x, start, at - start + len(skill) + after)
        negated = reduce(lambda a, w: a | F.contains(window, F.lit(w)), negations, F.lit(False))
        return F.when((at > 0) & negated, F.replace(x, F.lit(skill), F.lit(""))).otherwise(x)

    out = F.array(text)
    for skill in skills:
        out = F.transform(out, (lambda skill: lambda x: one(x, skill))(skill))
    return out[0]


def alias_in(text: Column, alias: str) -> Column:
    """Whether the text holds the alias: anywhere, if it has CJK signs, which no blanks part; else not next to a
    letter, digit, + or #."""
    if re.search(CJK, alias):
        return F.contains(F.lower(text), F.lit(alias.lower()))
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in alias.lower())
    return F.lower(text).rlike(f"(?<![a-z0-9+#]){quoted}(?![a-z0-9+#])")


def canonical_scan(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Names any of whose aliases the text holds, in the dictionary's order; a fixed list."""
    hit = lambda forms: reduce(lambda a, b: a | b, [alias_in(text, a) for a in forms])
    return F.array_compact(F.array(*[F.when(hit(forms), F.lit(name)) for name, forms in aliases.items()]))


def recent_matches(df: DataFrame, at: str, text: str, pattern: str, months: int, key: str, n: int) -> DataFrame:
    """The n newest rows of the last `months` months before the newest row whose text matches the pattern."""
    newest = df.agg(F.max(at).alias("__newest"))  # one row
    recent = df.crossJoin(F.broadcast(newest)).where(F.col(at) > F.add_months("__newest", -months))
    return recent.where(F.col(text).rlike(pattern)).orderBy(F.col(at).desc(), key).limit(n).drop("__newest")


def keyword_score(title: Column, body: Column, terms: list[str]) -> Column:
    """Two for each term in the title, one for each in the body."""
    hit = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    return reduce(lambda a, b: a + b, [2 * hit(title, w) + hit(body, w) for w in terms])


def required_and_nice(text: Column, skills: Column, marker: str) -> tuple[Column, Column]:
    """Skills of the array that the text holds: those of which no line has the marker, and those of which one has."""
    lines = F.split(F.lower(text), "\n", -1)
    nice = F.filter(skills, lambda s: F.exists(lines, lambda l: F.contains(l, F.lower(s)) & l.rlike(marker)))
    held = F.filter(skills, lambda s: F.contains(F.lower(text), F.lower(s)))
    return F.array_except(held, nice), nice


def clean_labels(labels: Column) -> Column:
    """Trimmed labels without blanks, case aside distinct and sorted; the first spelling in sorted order stays."""
    trimmed = F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    ordered = F.array_sort(F.transform(trimmed, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v"))))
    first = lambda o: F.filter(o, lambda x, i: (i == 0) | (x["k"] != F.get(o, i - 1)["k"]))
    return F.transform(F.transform(F.array(ordered), first)[0], lambda x: x["v"])


def labelled_rows(df: DataFrame, text: str, labels: str) -> DataFrame:
    """Rows with a text and a label; labels cleaned."""
    clean = df.withColumn(labels, clean_labels(F.col(labels)))
    return clean.where((F.trim(text) != "") & (F.size(labels) > 0))


def first_of(text: Column, values: list[str]) -> Column:
    """The value that stands first in the text; none: null."""
    low = F.lower(text)
    found = F.array(*[F.struct(F.instr(low, v.lower()).alias("at"), F.lit(v).alias("v")) for v in values])
    return F.array_min(F.filter(found, lambda x: x["at"] > 0))["v"]


def fields_of_text(text: Column, levels: dict[str, list[str]], label: str, cities: list[str], names: list[str], project: str) -> dict[str, Column]:
    """Columns from free text: education (the highest of the ordered levels named), years (most over two ways to
    say it), pay (low, high: a month; k is a thousand, a sum of ten thousands is a year's), the value after the
    label up to the line's end, the first city and name, and the blocks that begin with the project's mark."""
    low = F.lower(text)
    education = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name) for name, words in levels.items()])
    numbers = lambda p: F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: x.cast("int"))
    years = F.array_max(F.concat(numbers(r"(\d{1,2})\s*\+?\s*years?"), numbers(r"experience\s*:\s*(\d{1,2})")))
    part = lambda i: F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*(k|万)", i), F.lit(""))
    unit = F.when(part(3) == "k", 1000.0).otherwise(10000.0 / 12)
    blocks = F.filter(F.split(text, f"(?m)^(?={project})"), lambda b: b.startswith(project))
    return {
        "education": education, "years": years, "pay_low": part(1).cast("double") * unit, "pay_high": part(2).cast("double") * unit,
        "labelled": F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{label}\s*:\s*([^\n]*)", 1)), F.lit("")),
        "city": first_of(text, cities), "name": first_of(text, names), "projects": F.transform(blocks, lambda b: F.regexp_replace(b, r"\s+$", "")),
    }
