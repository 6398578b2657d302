"""Queries that read one agreement a class: against SQL where names hold words that clauses are read by."""

import os
from collections import Counter

import duckdb
import pytest

from policyspark.plans import corpus
from policyspark.plans.queries import ORACLES, QUERIES
from tests.test_queries import TINY, plain

NAMES = {
    "annex_references", "clause_hierarchy", "clause_numbers", "context_priority", "definition_closure", "definition_uses", "definitions_index",
    "descendants_closure", "enrich_items", "gates", "greedy_budget", "main_scopes", "time_terms",
}
TABLES = ("customer", "supplier", "part", "orders", "lineitem")
ODD = {
    "supplier": "CASE s_suppkey % 4 WHEN 0 THEN 'Data, see clause 3.1 of Annex A' WHEN 1 THEN 'x\nAnvil means iron' ELSE s_name END AS s_name",
    "part": "CASE p_partkey % 3 WHEN 0 THEN 'personal data' WHEN 1 THEN 'blue anvil' ELSE p_name END AS p_name",
    "customer": "CASE c_custkey % 5 WHEN 0 THEN 'Provider without undue delay 12' ELSE c_name END AS c_name",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for t in TABLES:
        changed = f"SELECT * REPLACE ({ODD[t]}) FROM '{TINY}/{t}.parquet'" if t in ODD else f"SELECT * FROM '{TINY}/{t}.parquet'"
        con.execute(f"COPY ({changed}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(NAMES))
def test_odd_names_against_sql(spark, odd, name):
    folder, con = odd
    made, cursor = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expect = Counter(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    assert Counter(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in made.collect()) == expect


def test_classes_are_fewer_than_agreements_and_weigh_as_many(spark):
    rows, weights = corpus.agreement_classes(spark, TINY)
    n, classes = corpus.agreements(spark, TINY).count(), weights.count()
    assert weights.groupBy().sum("weight").first()[0] == n and classes < n
    assert rows.select("contract_id").distinct().count() == classes
    every = corpus.distinct_clauses(spark, TINY)
    assert every.groupBy().sum("n").first()[0] == corpus.clauses(spark, TINY).count() > 2 * every.count()
