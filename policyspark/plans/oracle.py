"""DuckDB SQL of the agreements' corpus: what the queries' checks start from."""

from __future__ import annotations

import re

from policyspark.functions import text as tx
from policyspark.plans.catalogue import CATALOGUE, FLAGS


def quoted(text: str | None) -> str:
    return "NULL::VARCHAR" if text is None else "'" + text.replace("'", "''") + "'"


def flag(name: str) -> str:
    i = FLAGS.index(name)
    return f"((o_orderkey + {i}) % {2 + i % 3} <> 0)"


def any_flag(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(map(flag, names)) + ")" if names else "TRUE"


def filled(text: str) -> str:
    return " || ".join(p[1:-1] if re.fullmatch(r"\{\w+\}", p) else quoted(p) for p in re.split(r"(\{\w+\})", text) if p)


def _struct(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


AGREEMENTS = """
    agreements AS (
      SELECT o_orderkey, 'k' || o_orderkey AS contract_id, o_custkey, s_name AS P, c_name AS R, p_name AS D, lower(c_mktsegment) || ' research' AS U,
             (1 + o_orderkey % 60)::VARCHAR AS days, (1 + o_orderkey % 96)::VARCHAR AS hours, (1 + o_orderkey % 30)::VARCHAR AS notice, (30 + o_orderkey % 90)::VARCHAR AS delay,
             o_orderdate::DATE::VARCHAR AS start, (o_orderdate::DATE + 365)::DATE::VARCHAR AS stop, o_orderstatus
      FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_suppkey = sk JOIN part ON p_partkey = pk)"""

CLAUSES = AGREEMENTS + """,
    clauses AS (
      SELECT contract_id, o_orderkey, c.ord, c.clause_id, c.heading, c.text, c.kind, c.action, c.asset, c.actor, c.label, c.true_scope FROM (
        SELECT contract_id, o_orderkey, unnest([""" + ", ".join(
    _struct(ord=str(i), clause_id=quoted(c.number or None), heading=quoted(c.text if c.heading else None), text=filled(c.text), kind=quoted(c.kind or None), action=quoted(c.action or None), asset=quoted(c.asset if c.kind else None), actor=quoted(c.actor if c.kind else None), label=quoted("RELEVANT" if c.relevant else "NOT_RELEVANT"), true_scope=str(c.scope), live=any_flag(c.flags))
    for i, c in enumerate(CATALOGUE)
) + """]) AS c FROM agreements) WHERE c.live)"""

CONDITIONS = AGREEMENTS + """,
    conditions AS (
      SELECT contract_id, o_orderkey, o_custkey, c.clause_id, c.kind, c.n, c.field, c.op, c.value FROM (
        SELECT contract_id, o_orderkey, o_custkey, unnest([""" + ", ".join(
    _struct(clause_id=quoted(c.number), kind=quoted(c.kind), n=str(n), field=quoted(f), op=quoted(op), value=filled(v), live=live)
    for c in CATALOGUE
    for n, ((f, op, v), live) in enumerate([(leaf, any_flag(c.flags)) for leaf in c.when] + [(leaf, any_flag(c.flags) + " AND " + flag(name)) for name, leaf in c.extra.items()])
) + """]) AS c FROM agreements) WHERE c.live)"""

def stripped(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def clause_number(t: str) -> str:
    value, rest = f"regexp_extract({t}, '{tx.CLAUSE}', 1)", f"regexp_extract({t}, '{tx.CLAUSE}', 2)"
    return rf"""CASE WHEN {value} <> '' AND NOT regexp_matches({t}, '{tx.MONTH}') AND regexp_extract({value}, '^(\d+)', 1)::INTEGER <= 199
        AND NOT regexp_matches({rest}, '^\s*[\p{{Ll}}%/,–\d-]') THEN {value} END"""


def after_number(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '{tx.CLAUSE}') THEN regexp_extract({t}, '{tx.CLAUSE}', 2) ELSE {t} END"


def found(rows: str, column: str, pattern: str, name: str) -> str:
    """CTE `name`: rows times the matches of pattern in column, with i, found, part, start and after (up to the next match)."""
    return f"""{name}_lists AS (SELECT *, regexp_extract_all({column}, '{pattern}', 0) AS w, regexp_extract_all({column}, '{pattern}', 1) AS g, regexp_split_to_array({column}, '{pattern}') AS b FROM {rows} WHERE regexp_matches({column}, '{pattern}')),
    {name}_each AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM {name}_lists),
    {name} AS (SELECT * EXCLUDE (w, g, b), w[i] AS found, g[i] AS part, b[i + 1] AS after, (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(b[1:i], lambda x: length(x))))::BIGINT AS start FROM {name}_each)"""


# Lines of documents as laid-out spans; all places are made from the line's number.
SPANS = r"""
    spans AS (
      SELECT *, CASE pos % 7 WHEN 0 THEN length(text) WHEN 1 THEN length(text) // 2 WHEN 2 THEN length(text) * 7 // 10 + 1 ELSE 0 END AS bold_chars FROM (
        SELECT doc_id, pos, 1 + pos // 40 AS page, 72.0 + (pos % 3) * 10 AS x0, 10.0 + (pos % 40) * 20.5 AS y0, 8 + length(line) % 5 AS size, 8 + length(line) % 5 - CASE WHEN pos % 5 = 3 THEN 2 ELSE 0 END AS min_size, CASE WHEN doc_id % 4 = 0 AND pos < 5 THEN line || ' ..... ' || pos ELSE line END AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
        WHERE trim(line) <> ''))"""
