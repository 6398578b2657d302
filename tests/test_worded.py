"""readable_rules words each rule once for all agreements that word it alike: against SQL on odd names, flags, missing dates and repeated keys."""

from collections import Counter

import duckdb
import pytest

from policyspark.operators import policy
from policyspark.plans import corpus
from policyspark.plans.queries import ORACLES, QUERIES
from tests.test_classed import tables
from tests.test_queries import TINY, plain


def against_sql(spark, folder, con):
    cursor = con.execute(ORACLES["readable_rules"])
    columns = [d[0] for d in cursor.description]
    expect = Counter(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    made = QUERIES["readable_rules"](spark, folder)
    assert Counter(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in made.collect()) == expect


def test_odd_names(spark, tmp_path):
    against_sql(spark, *tables(tmp_path, True))


def test_marks_in_terms(spark, tmp_path):
    """Terms that hold the marks of the keys that rules are looked up by."""
    folder, con = tables(tmp_path, False)
    con.execute("CREATE TABLE c AS SELECT * REPLACE (CASE c_custkey % 3 WHEN 0 THEN 'A|1:B' WHEN 1 THEN '-' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
    con.execute(f"COPY c TO '{folder}/customer.parquet' (FORMAT parquet)")
    against_sql(spark, folder, con)


def test_repeated_keys_word_every_agreement(spark, tmp_path):
    folder, con = tables(tmp_path, False)
    con.execute("CREATE TABLE p AS SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_suppkey % 2 = 0")
    con.execute(f"COPY p TO '{folder}/supplier.parquet' (FORMAT parquet)")
    rows = lambda df: Counter(map(tuple, df.select("contract_id", "clause_id", "summary").collect()))
    assert rows(QUERIES["readable_rules"](spark, folder)) == rows(policy.readable(corpus.rules(spark, folder), corpus.conditions(spark, folder)))


def test_readable_sees_stand_ins_only(spark, monkeypatch):
    """Before, the rules and conditions of every agreement were grouped, joined and numbered."""
    seen, whole = [], policy.readable
    monkeypatch.setattr(policy, "readable", lambda rules, conditions: seen.append(rules.where("contract_id like 'k%'").count()) or whole(rules, conditions))
    made = QUERIES["readable_rules"](spark, TINY)
    assert seen == [0] and made.count() == corpus.rules(spark, TINY).count()


@pytest.mark.parametrize("number", [c.number for c in corpus.CATALOGUE if c.kind])
def test_every_rule_has_one_set_of_terms(number):
    assert sum(number in numbers for numbers in corpus.WORDED.values()) == 1


def test_small_tables(spark):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    against_sql(spark, TINY, con)
