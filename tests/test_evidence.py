"""Evidence of clauses: lettered parents, citations by their surroundings, definitions of any length and their chains."""

import time

from policyspark.operators import context

ROWS = "contract_id string, ord int, clause_id string, heading string, text string"


def scoped(spark, rows):
    return context.scoped(spark.createDataFrame([("k", i, n, h, t) for i, (n, h, t) in enumerate(rows)], ROWS))


PAPER = [
    ("1", "Words", "Words"),
    ("1.1", None, "Confidential Information means all secrets.\nKey Staff means people of R who keep Confidential Information.\nDate: ______"),
    ("2", "Use", "Use"),
    ("2.1", None, "R sees to it, see clause 9.9 and Article 4 of the GDPR, that:"),
    ("2.1(a)", None, "KEY  staff read clause 2.2 and the GDPR binder; and"),
    ("2.1(a)(i)", None, "nothing leaves."),
    ("2.2", None, "See Annex A, clause 1 of Annex A and clause 2 of this agreement."),
    (None, "ANNEX A", "ANNEX A"),
    ("1", None, "Clause 2.1 holds here; under the GDPR, Article 7 does too. Sections 3.1 to 4.2 don't."),
    ("2", None, "Confidential Information: annexed files."),
]


def test_lettered_parents_and_children(spark):
    got = {(r.clause_id, r.level, r.target_clause) for r in context.ancestry(scoped(spark, PAPER)).where("clause_id like '%(%'").collect()}
    assert got == {("2.1(a)", 1, "2.1"), ("2.1(a)", 2, "2"), ("2.1(a)(i)", 1, "2.1(a)"), ("2.1(a)(i)", 2, "2.1"), ("2.1(a)(i)", 3, "2")}


def test_citations(spark):
    got = {(r.ord, r.number, r.outcome, r.target_ord) for r in context.references(scoped(spark, PAPER)).collect()}
    own = {(3, "9.9", "missing", None), (3, "Article 4", "external", None), (4, "2.2", "resolved", 6), (6, "1", "resolved", 8), (6, "2", "resolved", 2)}
    assert own <= got and {(4, "9.9", "missing", None), (5, "2.2", "resolved", 6)} <= got  # parents' citations are the items' too
    assert {(8, "2.1", "resolved", 3), (8, "Article 7", "external", None), (8, "Sections 3.1 to 4.2", "range", None)} <= got
    assert {(r.ord, r.annex, r.outcome) for r in context.annex_mentions(scoped(spark, PAPER)).collect()} == {(6, "ANNEX A", "resolved"), (7, "ANNEX A", "own")}


def test_definitions(spark):
    rows = scoped(spark, PAPER)
    defs = {(r.scope, r.def_ord, r.term, r.by_means, r.def_text.split()[-1]) for r in context.definitions(rows).collect()}
    assert defs == {(0, 1, "Confidential Information", True, "secrets."), (0, 1, "Key Staff", True, "Information."), (1, 9, "Confidential Information", False, "files.")}
    uses = {(r.ord, r.name, r.def_ord) for r in context.definition_uses(rows).collect()}
    assert uses == {(4, "key staff", 1)}
    assert {(r.ord, r.name) for r in context.definition_closure(rows).collect()} == {(4, "key staff"), (4, "confidential information")}


def test_edges_of_all_kinds(spark):
    got = {(r.ord, r.target_ord, r.relationship, r.n) for r in context.edges(scoped(spark, PAPER)).collect()}
    assert {(4, 3, "parent", None), (4, 2, "parent", None), (3, 4, "other", None), (3, 5, "other", None), (4, 6, "reference", None), (6, 7, "reference", None), (6, 9, "reference", None), (4, 1, "definition", 0), (4, 1, "definition", 1)} <= got
    assert not [x for x in got if x[0] == 2 and x[2] == "other"]  # a mere heading needs no children
    notes = {(r.ord, r.note) for r in context.unresolved(scoped(spark, PAPER)).collect()}
    assert {(3, "missing 9.9"), (3, "external Article 4"), (8, "range Sections 3.1 to 4.2")} <= notes


def test_a_chain_of_twenty_definitions(spark):
    names = [f"Term {chr(65 + i)}" for i in range(20)]
    rows = [(f"1.{i + 1}", None, f"{n} means what {names[i + 1]} has." if i < 19 else f"{n} means the end.") for i, n in enumerate(names)] + [("2", None, "R keeps Term A.")]
    began = time.time()
    got = context.definition_closure(scoped(spark, rows)).where("ord = 20").collect()
    assert {r.def_ord for r in got} == set(range(20)) and time.time() - began < 60


def test_turns_without_pairs(spark):
    turns = spark.createDataFrame([(1, t) for t in range(500)] + [(2, 0), (2, 1), (2, 3), (2, 3), (3, None)], "conv_id int, turn int")
    got = {(r.conv_id, r.turn, r.above, r.root) for r in context.conversation_closure(turns).collect()}
    assert len(got) == 500 and (1, 499, 499, 0) in got and (2, 1, 1, 0) in got and not [x for x in got if x[:2] == (2, 3)]


BLOCK = "contract_id string, ord int, block_id string, page int, block_type string, text string, y0 double"


def test_table_rows_headers_and_notes(spark):
    given = [("paragraph", "Rates are:", 10.0), ("table", "Item", 30.0), ("table", "Price", 31.0), ("table", "Data", 50.0), ("table", "5", 51.0), ("table", "Logs", 70.0), ("other", "Page 1", 90.0), ("paragraph", "This is for information only.", 95.0)]
    blocks = spark.createDataFrame([("k", i, f"b{i}", 1, t, x, y) for i, (t, x, y) in enumerate(given)], BLOCK)
    clauses = spark.createDataFrame([("k", i, t, [1], [f"b{i}"]) for i, (_, t, _) in enumerate(given)], "contract_id string, ord int, text string, pages array<int>, block_ids array<string>")
    got = {(r.ord, r.target_ord) for r in context.table_context(blocks, clauses).collect()}
    assert {t for o, t in got if o == 3} == {0, 1, 2, 4} and {t for o, t in got if o == 5} == {0, 1, 2} and not [x for x in got if x[0] in (0, 6, 7)]
    known = blocks.selectExpr("*", "'t1' as table_id", "case when ord in (3, 4) then 1 end as table_row", "ord = 1 as table_header")
    got = {(r.ord, r.target_ord) for r in context.table_context(known, clauses).collect()}
    assert {t for o, t in got if o == 3} == {0, 1, 4} and not [x for x in got if 2 in x or 5 in x]  # rows nobody knows are left out
    assert {(r.ord, r.target_ord) for r in context.disclaimers(clauses).collect()} == {(i, 7) for i in range(7)}
