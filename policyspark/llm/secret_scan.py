"""Secrets in text: candidates by pattern, false positives removed by a random forest.

Everything a row passes through is SQL: candidates come from one regular expression, features and
the forest are expressions over arrays of structs, so a row is scored where it is read, without a
shuffle. The forest grows on the driver from a bounded table of labelled findings whose features
are made by the same expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHARS = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{CHARS}])(?=[A-Za-z+/_-]*[0-9])[{CHARS}]{{16,}}={{0,2}}"
# Words that code and notes are made of, words that announce a secret, words that announce something else.
DICTIONARY = "account address admin api apple auth base board build cache change client cloud code config count data date demo device digest dummy email error event example field file foo bar first group header image index item key label last level line list local login main message model name node number object order page part pass password path placeholder port prod project public query region release report request sample secret section server service session size source stage start state string system table test text the this time title token trace type unit update user value version view week with word work your".split()
SECRET_WORDS = "token|secret|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?key|auth(?:orization)?|bearer|credentials?"
OTHER_WORDS = "sha-?[0-9]*|md5|commit|checksum|digest|revision|hash|uuid|guid|integrity|build|order|phone|card|account|isbn|call|number|example|sample|placeholder|dummy"
PATHS = "(?:^|[/._-])(?:tests?|examples?|samples?|fixtures?|mocks?|docs?|vendor|node_modules|lock)(?:$|[/._-])"
FEATURES = ["length", "transitions", "digits", "capitals", "symbols", "variety", "hexadecimal", "dictionary", "path", "secret_word", "secret_near", "other_near", "quoted"]


def _features(x: str) -> str:
    """Features of struct x(candidate, before, after, path) as SQL, in the order of FEATURES."""
    c, n = f"{x}.candidate", f"length({x}.candidate)"
    kinds = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', 'a'), '[A-Z]', 'B'), '[0-9]', '0'), '[^aB0]', '-')"
    share = lambda pattern: f"(1 - length(regexp_replace({c}, '{pattern}', '')) / {n})"
    flag = lambda column, pattern: f"cast({column} rlike r'{pattern}' as double)"
    parts = [
        f"cast({n} as double)",
        f"(length(regexp_replace({kinds}, r'(.)\\1*', '$1')) - 1) / {n}",
        share("[0-9]"), share("[A-Z]"), share("[^A-Za-z0-9]"),
        f"size(array_distinct(split({c}, ''))) / least({n}, 64)",
        flag(c, "^[0-9a-fA-F]+$"),
        f"(1 - length(regexp_replace(lower({c}), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / {n})",
        flag(f"lower({x}.path)", PATHS),
        flag(f"{x}.before", rf"(?:{SECRET_WORDS})[^a-z0-9]{{0,8}}$"),
        flag(f"{x}.before", rf"\b(?:{SECRET_WORDS})"),
        flag(f"{x}.before", rf"\b(?:{OTHER_WORDS})\b[^a-z0-9]{{0,8}}[^.]{{0,16}}$"),
        f"cast(right({x}.before, 1) in ('\\'', '\"') and left({x}.after, 1) in ('\\'', '\"') as double)",
    ]
    return "array(" + ", ".join(f"cast({p} as double)" for p in parts) + ")"


def labelled_findings(spark: SparkSession, rows: int = 3800) -> DataFrame:
    """Findings (candidate, before, after, path, label) in nineteen forms, nine of them secrets, made by rule from hashes."""
    h = "sha2(cast(id as string), 512)"
    b64 = f"regexp_replace(base64(unhex({h})), '[^A-Za-z0-9]', '')"
    pick = lambda words, salt: f"element_at(array({', '.join(repr(w) for w in words)}), cast(pmod(xxhash64(id, {salt}), {len(words)}) as int) + 1)"
    word = lambda salt: pick(DICTIONARY[:60], salt)
    name = pick(["token", "secret", "password", "api_key", "access_key", "auth", "client_key", "passwd"], 1)
    other = pick(["sha256", "commit", "checksum", "revision", "md5", "build", "digest", "hash"], 2)
    prose = pick(["was sent to the", "in the report of", "as shown by", "and then came", "", "see the entry"], 3)
    n = "cast(16 + pmod(xxhash64(id, 4), 32) as int)"
    forms = [
        (f"substring({h}, 1, 40)", f"concat({name}, ' = \"')", "'\"'", 1),
        (f"substring({b64}, 1, {n})", f"concat({name}, ': ')", "' '", 1),
        (f"concat('AKIA', upper(substring({h}, 1, 16)))", pick(["aws_access_key_id=", "key: ", "access key "], 5), "' '", 1),
        (f"concat('ghp_', substring({b64}, 1, 36))", f"concat({prose}, ' \\'')", "'\\''", 1),
        (f"upper(substring({h}, 1, {n}))", f"concat({name}, ' = \"')", "'\"!!'", 1),
        (f"substring({b64}, 1, 40)", "'authorization: bearer '", "' '", 1),
        (f"substring({h}, 1, 40)", f"concat({other}, ' ')", "' '", 0),
        (f"concat(substring({h}, 1, 8), '-', substring({h}, 9, 4), '-4', substring({h}, 13, 3), '-a', substring({h}, 16, 3), '-', substring({h}, 19, 12))", pick(["id ", "uuid: ", "request \"", "uuid=\""], 6), "'\"'", 0),
        (f"lpad(cast(abs(xxhash64(id)) as string), 16, '4')", f"concat({prose}, ' ')", "' '", 0),
        (f"concat({word(7)}, '-', {word(8)}, '_', {word(9)}, cast(pmod(id, 1000) as string))", f"concat({prose}, ' ')", "' '", 0),
        (f"concat('your_', {word(10)}, '_', {word(11)}, '_here_', cast(pmod(id, 100) as string))", f"concat({name}, ' = \"')", "'\"'", 0),
        (f"concat('/', {word(12)}, '/', {word(13)}, '/', {word(14)}, cast(pmod(id, 90) as string), '/', {word(15)})", f"concat({prose}, ' ')", "' '", 0),
        (f"concat('sk_live_', substring({b64}, 1, 24))", f"concat({name}, '=')", "' '", 1),
        (f"concat('AIza', substring({b64}, 1, 35))", pick(["key=", "api_key: \"", "apikey = \""], 17), "'\"'", 1),
        (f"concat('xoxb-', lpad(cast(pmod(abs(xxhash64(id)), 1000000000000) as string), 12, '1'), '-', substring({b64}, 1, 24))", f"concat({name}, ': \"')", "'\"'", 1),
        (f"substring({b64}, 1, {n})", "'src=\"data:image/png;base64,'", "'/'", 0),
        (f"concat('sha256-', substring({b64}, 1, 43), '=')", "'integrity=\"'", "'\"'", 0),
        (f"concat({word(18)}, '_', {word(19)}, '_', {word(20)}, '_v', cast(pmod(id, 20) as string))", f"concat({word(21)}, ' = ')", "';'", 0),
        (f"concat(initcap({word(22)}), initcap({word(23)}), initcap({word(24)}), cast(pmod(id, 50) as string), initcap({word(25)}))", f"concat({word(26)}, ' ')", "' '", 0),
    ]
    case = lambda i: "case " + " ".join(f"when pmod(id, {len(forms)}) = {k} then {f[i]}" for k, f in enumerate(forms)) + " end"
    path = f"case when pmod(xxhash64(id, 16), 5) = 0 then 'src/app/main.py' when pmod(xxhash64(id, 16), 5) = 1 and pmod(id, {len(forms)}) between 6 and 11 then 'tests/fixtures/data.json' else '' end"
    return spark.range(rows).selectExpr(f"{case(0)} as candidate", f"{case(1)} as before", f"{case(2)} as after", f"{path} as path", f"cast({case(3)} as int) as label")


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 4, seed: int = 0) -> list:
    """Random forest of Gini trees on bootstrap rows and square-root feature draws. A tree: probability or (feature, cut, low, high)."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray, level: int):
        p = float(y[rows].mean())
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return p
        best = (1e9, None, None)
        for f in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))]:
            for cut in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 13))):
                low = x[rows, f] <= cut
                a, b = int(low.sum()), int((~low).sum())
                if min(a, b) >= least:
                    pa, pb = y[rows[low]].mean(), y[rows[~low]].mean()
                    gini = a * pa * (1 - pa) + b * pb * (1 - pb)
                    if gini < best[0]:
                        best = (gini, int(f), float(cut))
        if best[1] is None:
            return p
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], node(rows[low], level + 1), node(rows[~low], level + 1)

    return [node(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]


def _tree(tree, array: str) -> str:
    if isinstance(tree, float):
        return f"{tree:.4f}D"
    f, cut, low, high = tree
    return f"if({array}[{f}] <= {cut!r}D, {_tree(low, array)}, {_tree(high, array)})"


def learn(findings: DataFrame, most: int = 20_000, **options: int) -> list:
    """A forest from labelled findings (candidate, before, after, path, label); at most `most` rows, the same at every run."""
    rows = findings.where(F.col("candidate").isNotNull() & (F.length("candidate") > 0) & F.col("label").isin(0, 1))
    rows = rows.select("candidate", F.lower(F.coalesce("before", F.lit(""))).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.coalesce("path", F.lit("")).alias("path"), "label")
    made = rows.select(F.struct("candidate", "before", "after", "path").alias("x"), "label").orderBy(F.xxhash64("x"), "label").limit(most).selectExpr(f"{_features('x')} as f", "label").collect()
    if not made:
        return [0.0]
    return grow(np.array([r[0] for r in made]), np.array([r[1] for r in made], float), **options)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _judged(text: str, path: str, forest: list, least: float, body: str) -> Column:
    """body, an expression of `s` (found: a text's candidates in order, between: what stands around them) and `best`, the distinct secrets among them.

    A text is cut once; every candidate is judged at every place it has. Null text: null.
    """
    # three candidates of 16 characters fill the 48 before, one the 8 after
    cut = f"named_struct('found', regexp_extract_all({text}, r'{CANDIDATE}', 0), 'between', split({text}, r'{CANDIDATE}'))"
    part = lambda name, i: f"coalesce(get(s.{name}, {i}), '')"
    before = ", ".join(["''", *(part(name, f"i - {back}") for back, name in ((3, "found"), (2, "between"), (2, "found"), (1, "between"), (1, "found"), (0, "between")))])
    near = f"transform(s.found, (c, i) -> named_struct('candidate', c, 'i', i, 'before', lower(right(concat({before}), 48)), 'after', left(concat({part('between', 'i + 1')}, {part('found', 'i + 1')}), 8), 'path', {path}))"
    made = f"transform({near}, x -> named_struct('candidate', x.candidate, 'i', x.i, 'f', {_features('x')}))"
    vote = " + ".join(_tree(t, "x.f") for t in forest)
    rated = f"transform({made}, x -> named_struct('candidate', x.candidate, 'less', -({vote}) / {len(forest)}, 'i', x.i))"
    best = _let(f"array_sort(filter({rated}, x -> -x.less >= {least}))", "r", "filter(r, (x, j) -> j = 0 or x.candidate <> get(r, j - 1).candidate)")
    return F.expr(_let(cut, "s", _let(best, "best", body)))


def scored(text: str, path: str, forest: list, least: float) -> Column:
    """Array of the distinct candidates of a text column that the forest takes for secrets at one of their places at least.

    struct(candidate, start: code point from 0 of the first place with its best probability,
    probability: the best of its places, occurrences: its places). Null text: null.
    """
    chars = lambda name, n: f"aggregate(slice(s.{name}, 1, {n}), 0, (n, t) -> n + length(t))"
    placed = f"transform(best, x -> named_struct('candidate', x.candidate, 'start', {chars('found', 'x.i')} + {chars('between', 'x.i + 1')}, 'probability', -x.less, 'occurrences', size(filter(s.found, c -> c = x.candidate))))"
    return _judged(text, path, forest, least, placed)


def scan(docs: DataFrame, forest: list, least: float = 0.5, path: str | None = None) -> DataFrame:
    """A row per document and distinct secret: doc_id, start, secret, occurrences, probability.

    Null, empty and blank texts give none; repeated rows give theirs each; an empty table gives
    none; other columns are not read. path: a column of docs, or none.
    """
    kept = docs.select("doc_id", "text", *([F.coalesce(F.col(path), F.lit("")).alias("_path")] if path else []))
    rows = kept.select("doc_id", F.explode(scored("text", "_path" if path else "''", forest, least)).alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), F.col("x.candidate").alias("secret"), F.col("x.occurrences").alias("occurrences"), F.round("x.probability", 6).alias("probability"))


def redact(docs: DataFrame, forest: list, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with every place of a secret in text, inside longer strings too, replaced and n_chars counted anew; all rows and columns stay.

    A text is put together again from its parts in one pass. Null, empty and blank texts stay as
    they are; repeated rows are redacted alike.
    """
    shown = mark.replace("\\", "\\\\").replace("'", "\\'")
    inside = f"aggregate(array_sort(best, (a, b) -> length(b.candidate) - length(a.candidate)), c, (t, x) -> replace(t, x.candidate, '{shown}'))"
    one = f"case when exists(best, x -> x.candidate = c) then '{shown}' when exists(best, x -> length(c) > length(x.candidate) and contains(c, x.candidate)) then {inside} else c end"
    joined = f"array_join(transform(s.between, (b, i) -> concat(b, coalesce({_let('get(s.found, i)', 'c', one)}, ''))), '')"
    out = docs.withColumn("text", F.coalesce(_judged("text", "''", forest, least, f"if(size(best) = 0, cast(null as string), {joined})"), "text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
