"""Clause text: numbers, scopes, headings, definitions, references, durations, dates, wording."""

import pytest
from pyspark.sql import functions as F

from policyspark.functions import text as tx


def values(spark, column, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", column(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_clause_numbers(spark):
    given = ["1. Terms", "2.3.1 Use", "Article 7 Duties", "4(a) First", "12 March 2024 it was", "250 people", "3 of the parties", "5% of sales", "6 - 7", "1.2", "Clause", "4 2 things", None]
    assert values(spark, tx.clause_number, given) == ["1", "2.3.1", "7", "4(a)", None, None, None, None, None, "1.2", None, None, None]


def test_parents_and_ancestors(spark):
    assert values(spark, tx.parent_number, ["1.2.3", "4(a)", "4(a)(i)", "7"]) == ["1.2", "4", "4(a)", None]
    assert values(spark, tx.ancestors, ["1.2.3", "2.1(a)(i)", "4(a)", "7"]) == [["1.2", "1"], ["2.1(a)", "2.1", "2"], ["4"], []]


def test_scope_headings(spark):
    given = ["ANNEX A", "Annex B", "Annex II: Prices", "Annex C says that", "[Option] EXHIBIT 4", "The annex"]
    assert values(spark, tx.scope_heading, given) == ["ANNEX A", "ANNEX B", "ANNEX II", None, "EXHIBIT 4", None]


def test_definitions_and_gates(spark):
    assert values(spark, tx.defined_term, ["“Data” means all files", "Data: the files", "the data means"]) == ["Data", "Data", None]
    assert values(spark, tx.definition_only, ["Data means all files", "2.1 Data means all files", "Data means files that R must keep", "R keeps files"]) == [True, True, False, False]
    assert values(spark, tx.word_count, ["\none two", " ", "a"]) == [2, 0, 1] and values(spark, lambda t: tx.standalone_heading(t, t), ["Use of Data\n"]) == [True]
    assert values(spark, lambda t: tx.standalone_heading(F.lit(None), t, F.lit(True)), ["2.1\nUse of Data", "2.1\nR must read"]) == [True, False]
    assert values(spark, tx.information_duty, ["P shall provide the relevant information", "P must supply goods", "As an example P must provide data"]) == [True, False, False]
    assert values(spark, lambda t: tx.standalone_heading(F.lit("Use of Data"), t), ["Use of Data", "Use of Data now", ""]) == [True, False, False]
    assert values(spark, tx.checkbox_option, ["☐ daily", "☐ R must pay"]) == [True, False]
    assert values(spark, tx.explanatory_faq, ["About us: x\nHow to join?\nhttp://a", "About us: must\nHow to join?\nhttp://a"]) == [True, False]


def test_references(spark):
    given = ["see clauses 3.1, 3.2 and 4.1", "clauses 4.1 to 4.3", "clauses 4.1–4.3", "sections 3.1-3.4", "Article 5", "section 1 to 400", "nothing"]
    assert values(spark, tx.reference_numbers, given) == [["3.1", "3.2", "4.1"], ["4.1", "4.2", "4.3"], ["4.1", "4.2", "4.3"], ["3.1", "3.2", "3.3", "3.4"], ["5"], ["1", "400"], []]


def test_time_terms(spark):
    given = ["Told without undue  delay, and without undue delay.", "For the duration of the work, it stays. During the term and for a subsequent period of two years, too.", "within 3 days"]
    assert values(spark, tx.time_terms, given) == [["without undue delay"], ["For the duration of the work", "During the term and for a subsequent period of two years"], []]


def test_matches_know_their_surroundings(spark):
    got = values(spark, lambda t: tx.matches(t, r"(\d)\d", 1), ["ab12cd34", "none"])
    assert [(m.found, m.part, m.start, m.after, m.before70, m.after100) for m in got[0]] == [("12", "1", 2, "cd", "ab", "cd34"), ("34", "3", 6, "", "ab12cd", "")] and got[1] == []


@pytest.mark.parametrize("value,seconds", [("P1D", 86400), ("PT2H", 7200), ("P1DT1M", 86460), ("pt1.5s", 1.5), ("P1Y", None), ("P2M", None), ("P", None), ("PT", None), ("x", None), (None, None)])
def test_durations(spark, value, seconds):
    got = values(spark, tx.duration_seconds, [value])[0]
    assert got == seconds if seconds is None else float(got) == seconds


def test_dates_keys_and_words(spark):
    from datetime import date

    assert values(spark, tx.date_ordinal, ["2024-02-29", "2023-02-29", "2024-2-3", ""]) == [date(2024, 2, 29).toordinal(), None, None, None]
    assert sorted(["10.2", "9.1", "2"], key=dict(zip(["10.2", "9.1", "2"], values(spark, tx.natural_key, ["10.2", "9.1", "2"]))).get) == ["2", "9.1", "10.2"]
    assert values(spark, tx.humanised, ["P1D", "PT12H", "P30D", "red"]) == ["1 day", "12 hours", "30 days", "red"]
    assert values(spark, tx.camel_words, ["keepConfidential"]) == ["keep confidential"]
    assert values(spark, tx.folded, ["  It’s \n Red "]) == ["it's red"]
