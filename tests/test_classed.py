"""Queries that work out one agreement a class and spread or weigh what is found: against SQL on odd names, flags and repeated keys."""

from collections import Counter

import duckdb
import pytest

from policyspark.plans import corpus
from policyspark.plans.queries import ORACLES, QUERIES
from tests.test_classes import ODD, TABLES
from tests.test_queries import TINY, plain

NAMES = {
    "behaviour_probes", "classify_clauses", "compile_plan", "context_pool", "exchange_round_trip", "frozen_drift", "greedy_packing", "grounding_violations",
    "policy_from_clauses", "policy_status", "policy_violations", "rule_agreement", "rule_multiset_match", "segment_full", "source_verification",
}
ODDER = ODD | {"part": "CASE p_partkey % 4 WHEN 0 THEN 'personal data' WHEN 1 THEN 'blue anvil' WHEN 2 THEN 'above ring' ELSE p_name END AS p_name"}


def tables(folder, changed):
    con = duckdb.connect()
    for t in TABLES:
        source = f"SELECT * REPLACE ({ODDER[t]}) FROM '{TINY}/{t}.parquet'" if changed and t in ODDER else f"SELECT * FROM '{TINY}/{t}.parquet'"
        con.execute(f"COPY ({source}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("odd"), True)


@pytest.mark.parametrize("name", sorted(NAMES))
def test_odd_names_against_sql(spark, odd, name):
    folder, con = odd
    made, cursor = QUERIES[name](spark, folder), con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expect = Counter(tuple(plain(v) for _, v in sorted(zip(columns, row, strict=True))) for row in cursor.fetchall())
    assert Counter(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in made.collect()) == expect


@pytest.mark.parametrize("modulo", [1, 5])
def test_classes_weigh_and_spread_to_every_agreement(spark, modulo):
    found, every = corpus.classed(spark, TINY, corpus.RULE_TERMS, modulo), corpus.agreements(spark, TINY)
    assert found.terms.count() < every.count() == found.terms.groupBy().sum("weight").first()[0]
    told = found.spread(found.terms.select("contract_id", "o_orderkey"))
    assert {r.contract_id for r in told.collect()} == {r.contract_id for r in every.collect()}
    assert told.where(f"substring(contract_id, 2, 20) % {modulo} <> o_orderkey % {modulo}").count() == 0


@pytest.mark.parametrize("name", sorted(NAMES))
def test_models_and_operators_see_classes_only(spark, name, monkeypatch):
    """Before, clauses and conditions of every agreement were expanded."""
    seen, whole = [], corpus.expanded
    monkeypatch.setattr(corpus, "expanded", lambda terms, *rest: seen.append("weight" in terms.columns) or whole(terms, *rest))
    made = QUERIES[name](spark, TINY)
    assert made.columns and all(seen)
