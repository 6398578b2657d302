"""Clause text as columns: numbers, scopes, definitions, references, durations, dates, wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a clause number, an annex heading, a definition, a reference.
NUMBER = r"\d{1,3}(?:\.\d{1,3})*(?:\([a-z0-9]+\))*"
CLAUSE = rf"(?i)^\s*(?:(?:article|section|clause)\s+)?({NUMBER})[.):]?(\s[\s\S]*)?$"
MONTH = r"(?i)^\s*\d+\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
SCOPE = r"(?i)^((?:annex|appendix|exhibit)\s+(?:[ivxlcdm]+|[a-z]|\d+))\b"
DEFINITION = r"(?m)^\s*[\"“‘]?([A-Z][\w &/\-]{1,70}?)[\"”’]?\s*(?::|\bmeans\b|\bshall mean\b|\bhas the meaning\b)"
REFERENCE = rf"(?i)\b(?:articles?|clauses?|sections?|paragraphs?|provisions?)\s+({NUMBER}(?:\s*(?:,|and|or|to|[-–])\s*{NUMBER})*)"
LAW_AFTER = r"^\s+(?:of\s+)?(?:the\s+)?(?i:Regulation|Directive|Data Act|GDPR)\b|^\s+of\s+(?:the\s+)?[A-Z][\w -]*Act\b"
LAW_BEFORE = r"(?i)\b(?:GDPR|Data Act|Regulation\s+\(EU\)\s+\d+/\d+)\s*[,:(]?\s*$"
MAIN_AFTER = r"(?i)^\s+of\s+(?:(?:the|this)\s+)?(?:main\s+(?:agreement|contract)|agreement|contract)\b"
ANNEX = r"(?:Annex|Appendix|Exhibit)\s+(?:[IVXLCDM]+|[A-Z]|\d+)"
ANNEX_AFTER = rf"(?i)^\s+(?:of|in)\s+(?:the\s+)?({ANNEX})\b"
PRECISE = r"(?i)\b(?:means|shall mean|has the meaning)\b"
DISCLAIMER = r"(?i)\b(?:not\s+a\s+substitute\s+for\s+(?:the\s+)?(?:licen[cs]e|agreement|contract)|non[- ]binding\s+summary|for\s+information(?:al\s+purposes)?\s+only)\b"
HEADER_STOP = r"(?i)\b(?:shall|must|may|only|not|no|means)\b"
OPERATIVE = r"(?i)\b(?:shall|must|may|can|will|cannot|permitted|prohibited|required|undertakes|obligation|only|entitled)\b|\b(?:has|have)\s+(?:the\s+)?right\b"
TITLE_STOP = r"(?i)\b(?:shall|must|may|means|is|are|will|can|only|not|no|without|delete|retain|notify|disclose|provide|return|process)\b|[;:]\s*\S"
DUTY = r"(?i)\b(?:shall|must)\s+(?:provide|supply|deliver|submit)\s+(?:(?:the|all|any|relevant|necessary|complete|detailed)\s+){0,3}(?:information|documentation|records|reports|data)\b"
ILLUSTRATIVE = r"(?i)\b(?:non[- ]binding|illustrative|example)\b"
DURATION = r"(?i)^P(?=\d|T\d)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
TIMING = (
    r"(?i)\b(without undue delay)\b",
    r"(?i)\b(For the duration of [^,.;]{1,90}),",
    r"(?i)\b(During [^,.;]{1,90},? and for (?:a )?subsequent period of [^,.;]{1,70}),",
)
CHECKBOX = "^\\s*[\u2610\u2611\u2612\u25a1\uf0a8]"
CHECKBOX_STOP = r"(?i)\b(?:shall|must|may|will|can|means)\b"
FAQ = (r"(?im)^About [^\n:]{1,80}:", r"(?im)^How (?:to|do) [^\n?]{1,100}\?", r"https?://")
FAQ_STOP = r"(?i)\b(?:must|shall)\b"
OWNS = (r"(?i)\bretains? ownership\b", r"(?i)\b(?:transfers no|does not transfer) ownership\b")
OWNS_STOP = r"(?i)\b(?:must|shall|may|can|required|entitled|access|use|shar\w*|disclos\w*|publish\w*|store|delete|notify|provide|grant|submit)\b"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clause_number(text: Column) -> Column:
    """The number a clause begins with, or null where the digits are a date, a quantity or a running sentence."""
    value, rest = F.regexp_extract(text, CLAUSE, 1), F.regexp_extract(text, CLAUSE, 2)
    first = F.regexp_extract(value, r"^(\d+)", 1).cast("int")
    bad = text.rlike(MONTH) | (first > 199) | rest.rlike(r"^\s*[\p{Ll}%/,–\d-]")
    return F.when((value != "") & ~bad, value)


def after_number(text: Column) -> Column:
    """Clause text with its leading number taken off."""
    return F.when(text.rlike(CLAUSE), F.regexp_extract(text, CLAUSE, 2)).otherwise(text)


def parent_number(value: Column) -> Column:
    return F.when(value.endswith(")"), F.regexp_extract(value, r"^(.*)\([^(]*$", 1)).when(value.contains("."), F.regexp_extract(value, r"^(.*)\.[^.]*$", 1))


def ancestors(value: Column) -> Column:
    """Numbers above value, nearest first: a lettered item's own clause comes before that clause's section."""
    parts = F.regexp_extract_all(value, F.lit(r"(\.?\d+|\([a-z0-9]+\))"), F.lit(1))
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), ""))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def scope_heading(text: Column) -> Column:
    """Upper-cased annex name of a heading line that is upper case, bare or closed by a colon."""
    first = F.regexp_replace(F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1)), r"(?i)^\[OPTION\]\s*", "")
    name = F.regexp_extract(first, SCOPE, 1)
    rest = F.trim(F.substring(first, F.length(name) + 1, F.length(first)))
    return F.when((name != "") & ((F.upper(first) == first) | (rest == "") | rest.startswith(":")), F.upper(name))


def word_count(text: Column) -> Column:
    t = stripped(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def standalone_heading(heading: Column, text: Column, has_children: Column | None = None) -> Column:
    """An explicit title, or a number line with a title under it that has child clauses; at most 14 words, none of them operative."""
    t, numbers = stripped(text), r"^[\d.() ]+$"
    first = F.regexp_extract(t, r"^([^\n]*)", 1)
    parent = F.coalesce(has_children, F.lit(False)) if has_children is not None else F.lit(False)
    given = stripped(F.coalesce(heading, F.lit("")))
    h = F.when((given == "") & parent & first.rlike(numbers), first).otherwise(given)
    numbered = parent & t.startswith(F.concat(h, F.lit("\n"))) & h.rlike(numbers)
    return F.coalesce((t != "") & (h != "") & ((h == t) | numbered) & (word_count(t) <= 14) & ~t.rlike(TITLE_STOP), F.lit(False))


def defined_term(text: Column) -> Column:
    """The first term a text defines."""
    return F.nullif(F.regexp_extract(text, DEFINITION, 1), F.lit(""))


def definition_only(text: Column) -> Column:
    """A definition, after its clause number, whose body obliges nobody."""
    t = F.ltrim(after_number(stripped(text)))
    start = r"^\s*" + DEFINITION.removeprefix(r"(?m)^\s*")
    return F.coalesce(t.rlike(start) & ~F.regexp_replace(t, start, "").rlike(OPERATIVE), F.lit(False))


def information_duty(text: Column) -> Column:
    return text.rlike(DUTY) & ~text.rlike(ILLUSTRATIVE)


def checkbox_option(text: Column, heading: Column | None = None, has_context: Column | None = None) -> Column:
    """A short option behind a box, without a heading, context or modal word of its own."""
    alone = F.lit(True) if has_context is None else ~F.coalesce(has_context, F.lit(False))
    bare = F.lit(True) if heading is None else F.coalesce(heading, F.lit("")) == ""
    return alone & bare & text.rlike(CHECKBOX) & (word_count(text) <= 14) & ~text.rlike(CHECKBOX_STOP)


def explanatory_faq(text: Column) -> Column:
    return text.rlike(FAQ[0]) & text.rlike(FAQ[1]) & text.rlike(FAQ[2]) & ~text.rlike(FAQ_STOP)


def ownership_declaration(text: Column) -> Column:
    return text.rlike(OWNS[0]) & text.rlike(OWNS[1]) & ~text.rlike(OWNS_STOP)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of pattern as struct(found: the whole, part: the group, start, after: the text up to the next match, before70 and after100: what stands around it).

    The text is taken apart once; a match's place follows from the lengths of what comes before it.
    """
    once = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"), F.split(text, pattern).alias("between"), text.alias("text"))

    def each(s: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            upto = F.aggregate(F.slice(s["whole"], F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(s["between"], F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x))
            return F.struct(m.alias("found"), F.get(s["part"], i).alias("part"), upto.alias("start"), F.get(s["between"], i + 1).alias("after"))

        def around(x: Column) -> Column:
            return x.withField("before70", F.substr(s["text"], F.greatest(x["start"] - 69, F.lit(1)), F.least(x["start"], F.lit(70)))).withField("after100", F.substr(s["text"], x["start"] + F.length(x["found"]) + 1, F.lit(100)))

        return F.transform(F.transform(s["whole"], at), around)

    return F.transform(F.array(once), each)[0]


def spread(listed: Column) -> Column:
    """Numbers of one citation: all it lists, or a range of two with one stem that is at most 100 wide spelled out."""
    numbers = F.regexp_extract_all(listed, F.lit(f"({NUMBER})"), F.lit(1))
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    stem = F.regexp_extract(a, r"^(.*?)\d+$", 1)
    low, high = F.regexp_extract(a, r"(\d+)$", 1).try_cast("int"), F.regexp_extract(b, r"(\d+)$", 1).try_cast("int")
    fits = ranged(listed) & a.rlike(r"\d$") & b.rlike(r"\d$") & (stem == F.regexp_extract(b, r"^(.*?)\d+$", 1)) & (high >= low) & (high - low <= 100)
    filled = F.transform(F.sequence(F.coalesce(low, F.lit(0)), F.greatest(F.coalesce(high, F.lit(0)), F.coalesce(low, F.lit(0)))), lambda n: F.concat(stem, n.cast("string")))
    return F.when(F.coalesce(fits, F.lit(False)), filled).otherwise(numbers)


def ranged(listed: Column) -> Column:
    """Whether a citation is of two numbers with `to` or a dash between."""
    return (F.size(F.regexp_extract_all(listed, F.lit(f"({NUMBER})"), F.lit(1))) == 2) & listed.rlike(r"(?i)\bto\b|[-–]")


def reference_numbers(text: Column) -> Column:
    """Clause numbers a text cites, ranges spelled out, in order of mention."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), spread))


def duration_seconds(value: Column) -> Column:
    """Seconds of an ISO duration without years and months, else null. The text is taken apart once."""

    def summed(p: Column) -> Column:
        part = lambda i: F.coalesce(F.nullif(p[i], F.lit("")), F.lit("0")).cast("decimal(38,9)")
        return F.when((p[0] == "") & (p[1] == ""), part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5))

    parts = F.split(F.regexp_replace(value, DURATION, "$1|$2|$3|$4|$5|$6"), r"\|")
    return F.when(value.rlike(DURATION), F.transform(F.array(parts), summed)[0])


def date_ordinal(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("0001-01-01").cast("date")) + 1)


def natural_key(value: Column) -> Column:
    """Digit runs padded to twelve, so that text order is number order."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def camel_words(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"([a-z])([A-Z])", "$1 $2"))


def modality(kind: Column) -> Column:
    return F.when(kind == "permission", "may").when(kind == "prohibition", "must not").otherwise("must")


def humanised(value: Column) -> Column:
    """PnD and PTnH in words; any other text as it is."""
    n, unit = F.coalesce(F.nullif(F.regexp_extract(value, r"^P(\d+)D$", 1), F.lit("")), F.nullif(F.regexp_extract(value, r"^PT(\d+)H$", 1), F.lit(""))), F.when(value.rlike(r"^PT\d+H$"), "hour").otherwise("day")
    return F.when(n.isNull(), value).otherwise(F.concat(n, F.lit(" "), unit, F.when(n == "1", "").otherwise("s")))


def time_terms(text: Column) -> Column:
    """Qualitative time limits as the source words them, white space made single; distinct, by pattern and then by place."""
    plain = F.regexp_replace(stripped(text), r"\s+", " ")
    return F.array_distinct(F.concat(*[F.regexp_extract_all(plain, F.lit(p), F.lit(1)) for p in TIMING]))


def folded(text: Column) -> Column:
    """ASCII form of text folding: apostrophes straight, white space single, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[‘’]", "'"), r"\s+", " ")))
