"""Plans, rules and their review; label references and reports; terms and frozen agreements; the client, settings and PDF."""

import http.server
import json
import random
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from policyspark.functions import truth as tr
from policyspark.operators import authoring, client, compiler, evaluation, generation, metrics, model
from policyspark.plans import authored
from policyspark.sources import config, pdf

TINY = "/root/testdata/sf0.001"


def clauses(spark, texts):
    return spark.createDataFrame([("k", i, str(i), None, t) for i, t in enumerate(texts)], "contract_id string, ord int, clause_id string, heading string, text string")


RULE = {"kind": "obligation", "actor": "R", "action": "keep", "asset": "Data", "evidence": "R must keep Data"}
LEAF = {"field": "a", "op": "eq", "value": 1}


def compiled(spark, text, plans, kind=None, texts=()):
    """What the compiler makes of answers (plans, or texts as they are) to one clause, or to a clause each."""
    rows = [("k", i, text if isinstance(text, str) else text[i], list(texts), ["1"], 4, kind, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(plans)]
    return compiler.compiled(spark.createDataFrame(rows, "contract_id string, ord int, text string, texts array<string>, ids array<string>, cap int, kind string, answer_json string")).orderBy("ord").collect()


def test_scenes_of_generation(spark):
    """Every way two attempts can go, with models that fail in every way there is."""
    got = {r.scene: (r.outcome, r.attempts, r.rules // r.clauses) for r in authored.generation_states(spark, TINY).collect()}
    assert got == {i: tuple(s[2:]) for i, s in enumerate(authored._SCENES)}


def test_rejected_clauses_give_no_rules_and_duties_stay(spark):
    rows = [("k", 1, "1", "rejected", [0]), ("k", 2, "2", "partial_needs_review", [0, 1])]
    one = lambda seat: (0, 0, seat, "duty" if seat else "rule", "0", "duty" if seat else "permission", "R", None, None, "keep", "Data", "e", ['{"field":"a","op":"eq","value":1}'], False)
    outcomes = spark.createDataFrame([(*r[:4], "", 2, 0, [one(s) for s in r[4]]) for r in rows], f"contract_id string, ord int, clause_id string, outcome string, reason string, attempts int, withheld int, rules {compiler.RULE}")
    made = generation.policy_rules(outcomes).collect()
    assert [(r.rule_id, r.kind, json.loads(r.conditions), json.loads(r.requires)) for r in made] == [("urn:k:r1", "permission", [LEAF], [{"actor": "R", "action": "keep", "asset": "Data", "conditions": [LEAF]}])]
    assert [(r.rules, r.status) for r in generation.policies(outcomes).collect()] == [(1, "draft_with_rejections")]


def test_no_answer_can_end_a_job(spark):
    forms = [None, "", "{", "[]", "5", "null", {}, {"rules": 1}, {"rules": [1]}, {"rules": [None]}, {"rules": [RULE | {"asset": {"a": 1}}]}, {"rules": [RULE | {"asset": []}]}, {"rules": [RULE | {"evidence": 5}]}, {"rules": [RULE | {"conditions": 5}]}, {"rules": [RULE | {"conditions": [5]}]}, {"rules": [RULE | {"conditions": [{"all": 5}]}]}, {"rules": [RULE | {"conditions": [{}]}]}, {"rules": [RULE], "parameters": 7}, {"rules": [RULE | {"duties": [{}], "kind": "permission"}]}, {"rules": [RULE | {"kind": ["x"]}]}]
    for r in compiled(spark, "R must keep Data.", forms):
        assert r.form and not r.rules, (r.ord, forms[r.ord])
    kept = compiled(spark, "R must keep Data.", [{"rules": [RULE | {"conditions": None}]}, {"rules": [RULE | {"conditions": [LEAF | {"value": {"b": [None]}}]}], "unrepresented": None, "reason": 3}])
    assert all(not r.form and len(r.rules) == 1 for r in kept)


def test_forms_of_plans(spark):
    ok = {"rules": [RULE | {"conditions": [{"all": [LEAF, {"any": [LEAF, LEAF]}]}], "source": "1"}]}
    bad = [{"rules": [RULE] * 5}, {"rules": [RULE | {"kind": "wish"}]}, {"rules": [RULE | {"source": "9"}]}, {"rules": [RULE | {"conditions": [LEAF] * 17}]}, {"rules": [RULE | {"conditions": [{"all": [LEAF]}]}]}, {"rules": [RULE | {"conditions": [{"all": [LEAF, {"all": [LEAF, {"all": [LEAF, LEAF]}]}]}]}]}, {"rules": [RULE | {"conditions": [LEAF | {"parameter": "p"}]}]}, {"rules": [RULE | {"conditions": [LEAF | {"op": "like"}]}]}, {"rules": [RULE], "parameters": [{"key": "p", "label": "x", "type": "y"}] * 2}]
    got = compiled(spark, "R must keep Data.", [ok, *bad])
    assert not got[0].form and all(r.form for r in got[1:])
    assert compiled(spark, "R must keep Data.", [ok], kind="permission")[0].form
    schema = generation.plan_schema(3, ["1"], "permission")
    assert schema["properties"]["rules"]["maxItems"] == 3 and schema["properties"]["rules"]["items"]["properties"]["kind"] == {"enum": ["permission"]}


def test_alternatives_against_their_numbers(spark):
    """Alternatives as columns are those that mixed radix numbers."""
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.4:
            return {"field": rng.choice("abc"), "op": "eq", "value": rng.randrange(9)}
        return {rng.choice(["all", "any", "exactly_one"]): [tree(depth - 1) for _ in range(rng.randrange(2, 4))]}

    trees = [t for t in ([tree(2) for _ in range(rng.randrange(1, 4))] for _ in range(40)) if max(tr.branch_counts(t)) <= tr.BRANCHES]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, j string").withColumn("nodes", F.from_json("j", compiler.NODES))
    made = rows.select("i", compiler.crossed(F.transform("nodes", lambda c: compiler.alternatives(c))).alias("b"), F.flatten(F.transform("nodes", lambda c: compiler.leaves_of(c))).alias("l")).collect()
    flat = lambda xs: [(x["field"], str(x["value"])) for x in xs]
    for r in made:
        assert sorted(map(flat, r.b)) == sorted(map(flat, tr.branches(trees[r.i]))) and flat(r.l) == flat(tr.leaves(trees[r.i]))


CASES = [
    ("evidence isn't in the clause", "R must keep Data.", {"evidence": "nothing"}), ("asset points elsewhere", "R must keep such Data.", {"asset": "such Data", "evidence": "keep"}), ("actor isn't in the clause", "R must keep Data.", {"actor": "Q"}),
    ("asset isn't in the clause", "R must keep Data.", {"asset": "Gold"}), ("party and asset are one", "R must keep R.", {"asset": "R", "evidence": "R must keep R"}), ("a qualifier of the asset is ambiguous", "R must keep Data not necessary for work.", {"asset": "Data not necessary for work"}),
    ("action is not one verb", "R must keep Data.", {"action": "keepAndHold"}), ("action isn't in the clause", "R must delete Data.", {"action": "publish", "evidence": "R must delete Data"}), ("a delivery is no grant of access", "R must share Data.", {"action": "provideAccess", "evidence": "R must share Data"}),
    ("invented address", "R must keep Data.", {"conditions": [{"field": "purpose", "op": "eq", "value": "marketing https://evil.example"}]}), ("invented date", "R must keep Data.", {"conditions": [{"field": "dateTime", "op": "eq", "value": "2020-01-01"}]}), ("a restriction needs an `only`", "R must keep Data.", {"kind": "restriction", "allowed_when": [LEAF]}),
    ("a restriction needs what is allowed", "R must only use Data.", {"kind": "restriction", "action": "use", "evidence": "R must only use Data"}), ("no complement", "R must only use Data.", {"kind": "restriction", "action": "use", "evidence": "R must only use Data", "allowed_when": [{"exactly_one": [LEAF, LEAF]}]}), ("no complement", "R must only use Data.", {"kind": "restriction", "action": "use", "evidence": "R must only use Data", "allowed_when": [LEAF | {"op": "isA"}]}),
    ("only a restriction has what is allowed", "R must keep Data.", {"allowed_when": [LEAF]}), ("duties belong to permissions, remedies to prohibitions", "R must keep Data.", {"duties": [{"actor": "R", "action": "keep", "asset": "Data"}]}), ("an exception isn't in the clause", "R must not use Data.", {"kind": "prohibition", "action": "use", "evidence": "use Data", "conditions": [{"field": "purpose", "op": "neq", "value": "x"}]}),
    ("a legal exception is missing", "R must delete Data unless retention is required by law.", {"action": "delete", "evidence": "R must delete Data", "conditions": [{"any": [{"field": "compliance", "op": "neq", "value": "retention required by law"}, LEAF]}]}), ("a period is missing", "For the duration of the work, R may keep Data.", {"kind": "permission", "evidence": "R may keep Data"}),
    ("completeness is missing", "R must maintain complete Records.", {"action": "maintain", "asset": "Records", "evidence": "R must maintain"}), ("a grant lacks its recipient", "P may grant Staff access to Data.", {"kind": "permission", "actor": "P", "action": "grantAccess", "evidence": "P may grant Staff access"}), ("the price is missing", "R may read Data free of charge.", {"kind": "permission", "action": "read", "evidence": "R may read Data", "conditions": [{"any": [{"field": "payAmount", "op": "eq", "value": 0}, LEAF]}]}),
    ("necessity is missing", "R may use Data necessary for work.", {"kind": "permission", "action": "use", "evidence": "R may use Data"}), ("a recipient is missing", "R must notify Provider of Data.", {"action": "notify", "evidence": "R must notify"}), ("another recipient is told", "R must notify Provider of Data.", {"action": "notify", "evidence": "R must notify", "conditions": [{"field": "recipient", "op": "eq", "value": "Staff"}]}),
    ("another party tells", "Provider must notify Staff of Data of R.", {"action": "notify", "evidence": "must notify"}), ("undue delay is missing", "R must report Data without undue delay.", {"action": "report", "evidence": "R must report"}), ("a time limit is missing", "R must report Data within 5 days after discovery.", {"action": "report", "evidence": "R must report", "conditions": [{"field": "elapsedTime", "op": "lteq", "value": "P6D"}, {"field": "event", "op": "eq", "value": "discovery"}]}),
    ("a time limit runs the wrong way", "R must keep Data within 5 days.", {"conditions": [{"field": "elapsedTime", "op": "gteq", "value": "P5D"}, {"field": "event", "op": "eq", "value": "x"}]}), ("a time limit lacks its event", "R must keep Data within 5 days.", {"conditions": [{"field": "elapsedTime", "op": "lteq", "value": "P5D"}]}), ("a waiting time is missing", "Once 5 days have elapsed R may keep Data.", {"kind": "permission", "evidence": "R may keep Data"}),
    ("a shorter period is missing", "R must notify Staff of Data unless a shorter period applies.", {"action": "notify", "evidence": "R must notify", "conditions": [{"field": "recipient", "op": "eq", "value": "Staff"}]}), ("an alternative authorisation is no condition", "R may keep Data or as agreed.", {"kind": "permission", "evidence": "R may keep", "conditions": [LEAF, {"field": "exception", "op": "eq", "value": "agreed"}]}), ("a list joined by `and` is no choice", "R must keep Data for Staff and Agents.", {"conditions": [{"field": "recipient", "op": "isAnyOf", "value": ["Staff", "Agents"]}]}),
    ("compliance is no purpose", "R may use Data for work.", {"kind": "permission", "action": "use", "evidence": "R may use", "conditions": [{"field": "purpose", "op": "isAnyOf", "value": ["work", "subject to law"]}]}), ("duration isn't ISO", "R must keep Data.", {"conditions": [{"field": "elapsedTime", "op": "lt", "value": "5 days"}]}), ("a parameter isn't declared", "R must keep Data.", {"conditions": [{"field": "scope", "op": "eq", "parameter": "p"}]}),
    ("a role isn't in the clause", "R must keep Data.", {"actor": "requester", "role": "requester"}), ("a citation is no condition", "R must keep Data.", {"conditions": [{"field": "clause_id", "op": "eq", "value": "1"}]}),
]


def test_each_fault_is_found(spark):
    for r, (fault, _, _) in zip(compiled(spark, [text for _, text, _ in CASES], [{"rules": [RULE | change]} for _, _, change in CASES]), CASES, strict=True):
        assert fault in r.why and not r.rules, (fault, r.form, r.why)


def test_right_plans_compile(spark):
    lit = lambda f, v, op="eq": {"field": f, "op": op, "value": v}
    good = [
        ("R must keep Data within 5 days after the end.", RULE | {"conditions": [lit("elapsedTime", "PT5D", "lteq"), lit("event", "end")]}, ['{"field":"elapsedTime","op":"lteq","value":"P5D"}', '{"field":"event","op":"eq","value":"end"}']),
        ("R must keep Data within 5 days after the notice was issued.", RULE | {"conditions": [lit("timing", "within 5 days after the notice was issued")]}, ['{"all":[{"field":"elapsedTime","op":"lteq","value":"P5D"},{"field":"event","op":"eq","value":"notice"}]}']),
        ("R must keep Data within 5 days.", RULE | {"conditions": [{"any": [lit("elapsedTime", "P5D", "lteq"), LEAF]}, lit("event", "x")]}, ['{"any":[{"field":"elapsedTime","op":"lteq","value":"P5D"},{"field":"a","op":"eq","value":1}]}', '{"field":"event","op":"eq","value":"x"}']),
        ("R must only use Data for work or with consent.", RULE | {"kind": "restriction", "action": "use", "evidence": "R must only use Data", "allowed_when": [lit("purpose", "work"), lit("approval", "consent")]}, ['{"field":"purpose","op":"neq","value":"work"}', '{"field":"approval","op":"neq","value":"consent"}']),
        ("R must only use Data for work.", RULE | {"kind": "restriction", "action": "use", "evidence": "R must only use Data", "allowed_when": [{"all": [lit("purpose", "work"), lit("payAmount", 5, "lt")]}]}, ['{"any":[{"field":"purpose","op":"neq","value":"work"},{"field":"payAmount","op":"gteq","value":5}]}']),
        ("R must keep Data in accordance with clause 5.", RULE | {"asset": "Data in accordance with clause 5"}, ['{"field":"compliance","op":"eq","value":"in accordance with clause 5"}']),
    ]
    grant = {"kind": "permission", "actor": "P", "action": "grantAccess", "asset": "Data", "evidence": "P may grant", "conditions": [lit("recipient", "R")]}
    more = [
        ("P may grant R access to Data if R keeps Logs.", [grant | {"asset": ["Data", "Logs"], "duties": [{"actor": "R", "action": "keep", "asset": "Logs"}]}]),
        ("P may grant R access to Data.", [grant | {"duties": [{"actor": "Q", "action": "keep", "asset": "Logs"}]}]),
        ("R may use Tools such as Hammers.", [RULE | {"kind": "permission", "action": "use", "asset": a, "evidence": "R may use Tools"} for a in ("Tools", "Hammers")]),
    ]
    made = compiled(spark, [x[0] for x in (*good, *more)], [*({"rules": [rule]} for _, rule, _ in good), *({"rules": rules} for _, rules in more)])
    for r, (text, _, conditions) in zip(made, good, strict=False):
        assert not r.form and not r.why and [x.conditions for x in r.rules] == [conditions], (text, r)
    r, fallen, example = made[len(good) :]
    assert [(x.spot, x.role, x.asset) for x in r.rules] == [(0, "rule", "Data"), (0, "duty", "Logs"), (1, "rule", "Logs"), (1, "duty", "Logs")]
    assert not fallen.rules and fallen.refused == ["0"]  # a rule falls with its duty
    assert [x.asset for x in example.rules] == ["Tools"] and example.why == ["an example repeats its general rule"]
    (r,) = compiled(spark, "as clause 2 says", [{"rules": [RULE | {"evidence": "as clause 2 says"}]}], texts=["R must keep Data"])
    assert len(r.rules) == 1  # named by the evidence given with it


def test_columns_of_generation(spark):
    rows = clauses(spark, ["R may read Data.", "R must not read and shall not copy.", "R must only read.", "R shall not read."])
    got = [(r.cap, r.kind) for r in rows.select("ord", generation.rule_cap(F.col("text")).alias("cap"), generation.forced_kind(F.col("text")).alias("kind")).orderBy("ord").collect()]
    assert got == [(3, "permission"), (4, None), (3, None), (3, "prohibition")]
    errors = spark.createDataFrame([("context limit: x",), ("invalid JSON",), ("boom",), (None,)], "e string").select(generation.error_outcome(F.col("e")).alias("o")).collect()
    assert [r.o for r in errors] == ["skipped", "rejected", "failed", None]
    sent = generation.coverage(rows, rows.where("ord < 2")).first()
    assert (sent.total, sent.submitted, sent.not_submitted) == (4, 2, [2, 3])


def test_rules_are_described_and_illustrated(spark):
    held = [{"field": "purpose", "op": "neq", "value": "research"}, {"field": "approval", "op": "neq", "value": "consent"}, {"field": "place", "op": "eq", "value": "here"}]
    rows = spark.createDataFrame([("prohibition", "R", "use", "Data", [json.dumps(c) for c in held])], "kind string, actor string, action string, asset string, conditions array<string>")
    more = F.concat("conditions", F.array(F.lit('{"field": "t", "op": "eq", "parameter": "p"}'), F.lit(json.dumps({"any": [LEAF, {"all": [LEAF, LEAF]}]}))))
    told = rows.select(generation.meaning(F.col("kind"), F.col("actor"), F.col("action"), F.col("asset"), more, F.create_map(F.lit("p"), F.lit("the term")))).first()[0]
    assert told == 'PROHIBITION: R | use | Data | purpose DOES NOT EQUAL "research" AND approval DOES NOT EQUAL "consent" AND place EQUALS "here" AND t EQUALS the term [UNRESOLVED] AND (a EQUALS 1 OR (a EQUALS 1 AND a EQUALS 1)) | says nothing of recipient, price, time limit'
    got = [({k: json.loads(v) for k, v in r.state.items()}, r.applies) for r in generation.examples(rows).collect()]
    assert len(got) == 4 and all(t == tr.truth(held, s) for s, t in got) and sum(t for _, t in got) == 1
    assert generation.examples(rows.withColumn("kind", F.lit("permission"))).count() == 0
    rows = spark.createDataFrame([("k", "1", 1, "permission", "R", "use", a, "R may use Tools such as Hammers.") for a in ("Tools", "Hammers")], "contract_id string, clause_id string, ord int, kind string, actor string, action string, asset string, text string")
    assert [(r.asset, r.general) for r in generation.example_assets(rows).collect()] == [("Hammers", "Tools")]


def test_seventy_probes_hold_for_right_rules(spark):
    assert len(authored.PROBES) == 70
    rows = authored.probes(spark, TINY).where("contract_id not like '%0' and contract_id not like '%5'")
    assert rows.where("not (truth <=> expected)").count() == 0 and rows.select("clause_id").distinct().count() == 24  # confidence and safe doors have no scenario


def test_references_load_review_and_run(spark, tmp_path):
    good = authored.reference(spark, TINY)
    assert evaluation.load(good) is good and evaluation.digest(good) == evaluation.digest(authored.reference(spark, TINY))
    with pytest.raises(ValueError, match="case"):
        evaluation.load(authored.reference(spark, TINY, True))
    packet = evaluation.review_packet(good, "test")
    assert {r.problem for r in evaluation.packet_faults(good, packet).collect()} == {"no completed review"}
    done = packet.withColumns({"label": F.lit("RELEVANT"), "review_status": F.lit("reviewed"), "reviewer": F.lit("x"), "rationale": F.lit("y")})
    assert evaluation.apply_reviews(good, done).cases.where("split = 'test' and review_status <> 'reviewed'").count() == 0
    for change, problem in (({"input_sha": F.lit("0")}, "evidence changed"), ({"rationale": F.lit(" ")}, "review without a rationale"), ({"reviewer": F.lit("")}, "reviewed without a reviewer"), ({"case_id": F.lit("none")}, "case is unknown"), ({"split": F.lit("dev")}, "case of the other split")):
        assert problem in {r.problem for r in evaluation.packet_faults(good, done.withColumns(change)).collect()}
    calls = []

    def label(rows):
        calls.append(rows.count())
        return rows.select("case_id", F.lit("RELEVANT").alias("label"), F.lit(None).cast("string").alias("error"))

    path = str(tmp_path / "run")
    first = evaluation.run(good, label, "test", path, most=3)
    again = evaluation.run(good, label, "test", path)
    n = good.cases.where("split = 'test'").count()
    assert first.count() == 3 and again.count() == n and calls == [3, n - 3]
    with pytest.raises(ValueError, match="evidence changed"):
        evaluation.scored(good, again.withColumn("input_sha", F.lit("0")), "test")
    with pytest.raises(ValueError):
        evaluation.scored(good, again, "test", require_reviewed=True)


def test_cluster_intervals_against_plain_resampling(spark):
    rng = random.Random(4)
    rows = [("a", c, g, rng.choice(metrics.LABELS[:2]), rng.choice((*metrics.LABELS, "ERROR"))) for c in ("x", "y") for g in "pqrs" for _ in range(6)]
    df = spark.createDataFrame(rows, "cohort string, contract_id string, group_id string, gold string, predicted string")
    got = metrics.bootstrap_macro(df, ["cohort"], "contract_id", "group_id", 60).first()
    import hashlib

    values = []
    for rep in range(60):
        drawn = []
        for c in ("x", "y"):
            for slot in range(4):
                i = int(hashlib.md5(f"{c}|{slot}|{rep}".encode()).hexdigest()[:8], 16) % 4
                drawn += [r for r in rows if r[1] == c and r[2] == "pqrs"[i]]
        f1 = []
        for x in metrics.LABELS[:2]:
            tp, s, p = sum(r[3] == r[4] == x for r in drawn), sum(r[3] == x for r in drawn), sum(r[4] == x for r in drawn)
            f1.append(2 * tp / (s + p) if s and s + p else 0.0)
        values.append(sum(f1) / 2)
    values.sort()
    assert (got.macro_low, got.macro_high) == (pytest.approx(values[int(59 * 0.025)]), pytest.approx(values[int(59 * 0.975)]))
    alone = metrics.bootstrap_macro(df.where("group_id = 'p' and contract_id = 'x'"), ["cohort"], "contract_id", "group_id", 20).first()
    assert alone.macro_low is None and evaluation.limited(df, 0, "group_id").count() == len(rows) and evaluation.limited(df, 2, "group_id").count() == 2


def test_terms_and_frozen_agreements(spark):
    rows = authored.terms(spark, TINY)
    good = rows.where(F.size(authoring.term_faults(authored.FLAGS)) == 0)
    assert good.count() and authoring.checked(good, authored.FLAGS).count() == good.count()
    with pytest.raises(ValueError):
        authoring.checked(rows, authored.FLAGS)
    old = authoring.with_defaults(spark.createDataFrame([("k", "a")], "contract_id string, title string"), {"title": "", "error_hours": 24, "storage_countries": ["Norway"]})
    assert tuple(old.first()) == ("k", "a", 24, ["Norway"])
    texts = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("m", 1, "z")], "contract_id string, ord int, text string")
    rules = spark.createDataFrame([("k", "s")], "contract_id string, signature string")
    was = authoring.frozen(texts, rules)
    assert authoring.load(was, was).count() == 2
    assert [(r.contract_id, r.problem) for r in authoring.drifted(authoring.frozen(texts.where("ord = 1"), rules.limit(0)), was).orderBy("contract_id").collect()] == [("k", "text changed")]


class Fake(http.server.BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def _send(self, code, *lines):
        self.send_response(code)
        self.end_headers()
        for line in lines:
            self.wfile.write((line if isinstance(line, str) else json.dumps(line)).encode() + b"\n")

    def do_GET(self):
        self._send(200, {"models": [] if self.path == "/api/ps" else [{"name": "m", "digest": "d"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/show":
            return self._send(200, {"capabilities": ["thinking"]})
        if body.get("keep_alive") == 0:
            return self._send(200, {})
        if isinstance(body.get("format"), dict):
            return self._send(400, "failed to parse grammar")
        room, prompt = body["options"]["num_predict"], body["prompt"]
        if prompt == "long" and room < 200:
            return self._send(200, {"response": "x"}, {"done": True, "done_reason": "length"})
        if prompt == "cut":
            return self._send(200, {"response": "x"})
        if prompt == "odd":
            return self._send(200, {"response": "no json"}, {"done": True})
        self._send(200, {"response": '{"ok":'}, {"response": f" {room}}}", "done": True, "prompt_eval_count": 3, "eval_count": 2})


def test_client_against_a_server():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = client.preflight(client.Endpoint(f"http://127.0.0.1:{server.server_port}", "m", model.Options(output=128), schema='{"type": "object"}'))
        assert e.digest == "d"
        value, usage, after = client.answer(e, "hi")
        assert value == {"ok": 128} and usage["tokens_out"] == 2 and after.schema == "json" and client.answer(after, "long")[0] == {"ok": 256}
        for prompt, kind in (("cut", "connection"), ("odd", "invalid JSON"), ("x" * 100_000, "context limit")):
            with pytest.raises(client.ModelError) as found:
                client.answer(after, prompt)
            assert found.value.kind == kind
        with pytest.raises(client.ModelError, match="schema"):
            client.answer(after, "hi", lambda v: ["bad"])
        with pytest.raises(client.ModelError, match="cancelled"):
            client.generate(after, "hi", cancelled=lambda: True)
        with pytest.raises(client.ModelError, match="not installed"):
            client.preflight(client.Endpoint(e.url, "other"))
        assert client.unload(e)
        frame = pd.DataFrame({"request_id": ["a", "b"], "value_json": ["hi", "odd"]})
        out = next(iter(client.Pool((after,)).checked().model(lambda v: v)(iter([frame]))))
        assert out["answer_json"][0] == '{"ok": 128}' and out["error"][1].startswith("invalid JSON")
    finally:
        server.shutdown()
    for bad in (lambda: client.Pool(()), lambda: client.Pool((e, e)), lambda: client.Pool((e, client.Endpoint("http://b", "n"))), lambda: client.Pool((e,), shared=True), lambda: client.sampling({"top_p": 2}), lambda: client.sampling({"x": 1})):
        with pytest.raises(ValueError):
            bad()


def test_settings():
    text = "provider: ollama\nexecution:\n  batch: 4 # small\n  context: 8192\nservice:\n  workers: 2\nurls:\n  - http://a\n  - 'b'\n"
    got = config.parse(text)
    assert got["urls"] == ["http://a", "b"] and config.options(got) == model.Options(batch=4, context=8192, workers=2) and config.parse('{"a": 1}') == {"a": 1}
    for bad in ({"provider": "x"}, {"provider": "rules", "execution": {"odd": 1}}, {"provider": "rules", "execution": 3}, {"provider": "rules", "execution": {"batch": 99}}):
        with pytest.raises(ValueError):
            config.options(bad)


def test_pdf_there_and_back():
    made = [("heading", "1 Use (all) \\ of it"), ("paragraph", "Recipient may read Data – “quoted” text. " * 60), ("heading", "2 End")]
    data = pdf.render(made, "A title")
    assert data == pdf.render(made, "A title")
    got = [(k, t.replace("\n", " ")) for _, k, t in pdf.blocks(data) if k != "other"]
    assert [t for k, t in got if k == "heading"] == ["1 Use (all) \\ of it", "2 End"] and " ".join(t for k, t in got if k == "paragraph").split() == made[1][1].split()
    for bad in (b"no", b"%PDF-1.4 /Encrypt 3 0 R", pdf.render([], "").replace(b"(", b"(")):
        with pytest.raises(ValueError):
            pdf.blocks(bad) if not bad.startswith(b"%PDF-1.4\n") else pdf.render([("paragraph", "漢")], "")
