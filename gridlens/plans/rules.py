"""Queries on the rule pipeline. Documents stand for candidates, ``labels`` for verdicts, languages for files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import register
from ..operators import rules as R
from ..operators import shield as H
from ..schemas import RULE_FIELDS
from ..sources.readers import pages_to_document, table


def _pick(values: list[str | None], by: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))


_ENTITY = ["bus", "Line", "TRANSFORMER", "cable", "generator", "Grid", "load", None]
_ACTION = ["block", "ALERT", "trip", "reconnect", "shed_load"]
_SEVERITY = ["HIGH", "low", "medium", "Critical", "low", "high", "urgent"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("r"), i.cast("string")).alias("rule_id"),
        "source",
        _pick(_ENTITY, i).alias("entity"),
        F.concat(F.lit("rho > "), (i % 13).cast("string")).alias("condition"),
        _pick(_ACTION, i).alias("action"),
        _pick(_SEVERITY, i).alias("severity"),
        F.col("text").alias("explanation"),
    )


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_CAND = f"""cand AS (SELECT doc_id, lang, 'r' || doc_id AS rule_id, source, {_sql_list(_ENTITY)}[doc_id % 8 + 1] AS entity, 'rho > ' || (doc_id % 13) AS condition,
  {_sql_list(_ACTION)}[doc_id % 5 + 1] AS action, {_sql_list(_SEVERITY)}[doc_id % 7 + 1] AS severity, text AS explanation FROM documents),
checked AS (SELECT doc_id, lang, rule_id, source, entity, condition, CASE WHEN upper(action) IN {tuple(R.ACTIONS)} THEN upper(action) ELSE 'OTHER' END AS action, lower(severity) AS severity, explanation
  FROM cand WHERE lower(entity) IN {tuple(R.ENTITIES)} AND lower(severity) IN {tuple(R.SEVERITIES)} AND source IS NOT NULL AND explanation IS NOT NULL)"""


def rule_check(spark, d):
    return R.check_rules(candidates(spark, d)).where("rule IS NOT NULL").select("doc_id", "lang", *[F.col(f"rule.{f}").alias(f) for f in RULE_FIELDS])


def _verdicts(spark, d):
    v = table(spark, d, "labels").where("doc_id IS NOT NULL")
    i = F.col("doc_id")
    word = F.when(F.col("toxic") == 1, "reject").when(i % 29 == 0, "MAYBE").when(i % 4 == 0, "Correct").otherwise("CONFIRM")
    nothing = F.lit(None).cast("string")
    fix = F.when(i % 12 == 0, F.create_map(F.lit("entity"), F.lit("x"))).when(i % 8 == 0, F.create_map(F.lit("severity"), nothing)).otherwise(F.create_map(F.lit("severity"), F.lit("LOW")))
    first = v.select("doc_id", word.alias("verdict"), fix.alias("corrected"), F.lit(0).alias("pos"))
    again = v.where(i % 10 == 0).select("doc_id", F.lit("confirm").alias("verdict"), F.create_map().cast("map<string,string>").alias("corrected"), F.lit(1).alias("pos"))
    return first.unionByName(again)


def _routed(spark, d):
    rules = R.check_rules(candidates(spark, d)).where("rule IS NOT NULL").select("doc_id", "lang", "rule")
    return R.route(rules, _verdicts(spark, d), ["doc_id"], failed=F.col("doc_id") % 101 == 0)


def verdict_route(spark, d):
    return _routed(spark, d).select("doc_id", "outcome", "reason", F.col("final_rule.severity").alias("severity"), F.col("final_rule.entity").alias("entity"))


_ROUTE = _CAND + """, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'CONFIRM' WHEN toxic = 1 THEN 'REJECT' WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'CORRECT' ELSE 'CONFIRM' END AS verdict FROM l),
routed AS (SELECT c.doc_id, c.lang, CASE WHEN c.doc_id % 101 = 0 THEN 'flagged' WHEN verdict = 'CONFIRM' THEN 'confirmed' WHEN verdict = 'CORRECT' AND c.doc_id % 12 <> 0 AND c.doc_id % 8 <> 0 THEN 'corrected'
    WHEN verdict = 'REJECT' THEN 'rejected' ELSE 'flagged' END AS outcome,
  CASE WHEN c.doc_id % 101 = 0 THEN 'VALIDATOR_FAIL' WHEN verdict IS NULL THEN 'NO_VERDICT' WHEN verdict = 'CORRECT' AND (c.doc_id % 12 = 0 OR c.doc_id % 8 = 0) THEN 'INVALID_CORRECTION' END AS reason, severity, entity
  FROM checked c LEFT JOIN v USING (doc_id))"""


def rule_figures(spark, d):
    return R.run_figures(_routed(spark, d), "lang", (F.col("doc_id") % 50).cast("double")).withColumn("ms_per_rule", F.round("ms_per_rule", 6))


def rule_numbers(spark, d):
    valid = R.check_rules(candidates(spark, d)).where("rule IS NOT NULL").select("doc_id", "lang")
    return R.numbered(valid, "lang", ["doc_id"]).select("doc_id", "rule_id")


def stand_in_validator(prompt: str) -> str:
    """A fixed opinion on each rule in place of a model's: by its number, action and severity."""
    chunk, listed = prompt.split("\n", 1)
    if int(chunk.removeprefix("part ")) % 13 == 0:
        raise TimeoutError("no answer")
    out = []
    for rule in json.loads(listed):
        i = int(rule["rule_id"][1:])
        if i % 9 == 0:
            continue
        fix = {"entity": "nowhere"} if i % 10 == 0 else {"severity": "HIGH"}
        word = "MAYBE" if i % 11 == 0 else "Reject" if rule["action"] == "ALERT" else "CORRECT" if rule["severity"] == "low" else "confirm"
        out.append({"rule_id": rule["rule_id"], "verdict": word, "corrected_fields": fix if word == "CORRECT" else None, "reason": "[so]"})
    return f"<think>[{len(out)} rules]</think>```json\n{json.dumps(out)}\n```"


def dry_run(spark, d):
    def refused(prompt: str) -> str:
        raise AssertionError("a dry run makes no call")

    docs = table(spark, d, "documents")
    return R.extract(docs, "doc_id", "text", "{chunk}", refused, dry_run=True, sep="\n")


def extracted_rules(spark, d):
    """Documents as files: rules of a stand-in model, one to three a chunk, numbered through all files."""

    def complete(prompt: str) -> str:
        rule = _rule_json(json.dumps("own"))
        return f"<think>hm</think>[{', '.join([rule] * (1 + len(prompt) % 3))}, 7]"

    out = R.extract(table(spark, d, "documents"), "doc_id", "text", "Text: {chunk}", complete, sep="\n")
    return out.select("doc_id", "chunk", "rule.rule_id", "rule.action", "rule.severity")


def validated_rules(spark, d):
    """Valid candidates in parts of seven documents, one validator call for each part."""
    part = F.floor(F.col("doc_id") / 7)
    rules = R.check_rules(candidates(spark, d)).where("rule IS NOT NULL").select("doc_id", part.alias("part"), "rule")
    parts = rules.select("part", F.concat(F.lit("part "), F.col("part").cast("string")).alias("text")).distinct()
    out = R.validate(rules, parts, "part", "text", "{chunk}\n{rules}", stand_in_validator)
    return out.select("doc_id", "outcome", "reason", F.col("final_rule.severity").alias("severity"), F.col("final_rule.entity").alias("entity"), (F.col("validate_ms") >= 0).alias("timed"))


def unvalidated_rules(spark, d):
    """Validation left out: all valid candidates are confirmed as they are."""
    rules = R.check_rules(candidates(spark, d)).where("rule IS NOT NULL").select("doc_id", F.floor(F.col("doc_id") / 7).alias("part"), "rule")
    parts = rules.select("part", F.lit("").alias("text")).distinct()
    out = R.validate(rules, parts, "part", "text", "{chunk}{rules}", None)
    return out.select("doc_id", "outcome", F.col("final_rule.severity").alias("severity"), F.col("final_rule.action").alias("action"))


def extraction_rates(spark, d):
    """Rules known are those of documents labelled good."""
    c = R.check_rules(candidates(spark, d))
    known = candidates(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").where("entity IS NOT NULL")
    out = R.extraction_rates(c, known, ["entity", "condition", "severity"])
    return out.select(*[F.round(x, 6).alias(x) for x in ("coverage", "precision", "parse_rate")])


def candidates_by_chunk(spark, d):
    turns = table(spark, d, "conversations")
    out = R.by_chunk(turns, "conv_id", "turn", "role")
    return out.select("conv_id", "first_seen", "n_rules", F.array_join("rules", ",").alias("rules"))


def merge_duplicates(spark, d):
    return R.merge_duplicates(table(spark, d, "documents"), ["lang", "text"], "doc_id", "source").select("doc_id", "lang", "sources", "n")


def merge_exact(spark, d):
    return R.merge_duplicates(table(spark, d, "documents"), ["lang", "text"], "doc_id", "source", exact=True).select("doc_id", "lang", "sources", "n")


def chunk_documents(spark, d):
    out = X.chunk(table(spark, d, "documents"), "doc_id", "text", sep="\n")
    return out.select("doc_id", "chunk", "start", "end", F.md5("text").alias("digest"))


def chunk_sql(spark, d):
    """The same from SQL, by the table function; other columns pass through."""
    register(spark)
    return spark.sql(
        """SELECT doc_id, lang, chunk, start, `end`, md5(piece) AS digest
        FROM chunk_table(rows => TABLE(SELECT doc_id, lang, text FROM {docs}), text_col => 'text', separator => '\n')""",
        docs=table(spark, d, "documents"),
    )


def chunk_lateral(spark, d):
    """The same by a lateral join, as figures of each document."""
    register(spark)
    return spark.sql(
        """SELECT doc_id, count(*) AS n_chunks, sum(length(piece)) AS n_chars FROM {docs} AS d, LATERAL chunk_text(d.text, 1200, 200, '\n') GROUP BY doc_id""",
        docs=table(spark, d, "documents"),
    )


def _answers(spark, d):
    head = F.col("text")
    kinds = [
        F.concat(F.lit("<think>[0] "), head, F.lit('\n</think> ```json [{"rule_id":"R_'), F.col("doc_id").cast("string"), F.lit('"}] ``` end')),
        F.concat(F.lit("no array: "), head),
        F.concat(F.lit("]x["), F.translate(head, "[]", "()")),
        F.concat(F.lit("```json\n[1, 2, "), head, F.lit("]\n ```  \n")),
        F.concat(F.lit("[a [b] "), head, F.lit(" c] ]tail")),
    ]
    return table(spark, d, "documents").select("doc_id", F.get(F.array(*kinds), (F.col("doc_id") % 5).cast("int")).alias("answer"))


def carve_arrays(spark, d):
    a = F.col("answer")
    found = _answers(spark, d).select("doc_id", X.strip_think(a).alias("bare"), X.carve_array(a).alias("carved"), X.carve_array_leading_fence(a).alias("carved_leading"))
    return found.select("doc_id", *[F.md5(c).alias(c) for c in ("bare", "carved", "carved_leading")])


def _rule_json(rule_id: str) -> str:
    return json.dumps({"source": "s", "entity": "bUs", "condition": "c", "action": "trip", "severity": "HIGH", "explanation": "e", "extra": 1})[:-1] + f', "rule_id": {rule_id}}}'


def rule_json(spark, d):
    """Answers that hold the documents themselves as rules, every fourth with a number as its id, beside items that are no rules."""
    rule = F.to_json(F.struct(*[F.when(F.col("doc_id") % 4 != 1, F.col(f)).alias(f) if f == "rule_id" else f for f in RULE_FIELDS]))
    answer = F.concat(F.lit("the rules: ```json ["), F.when(F.col("doc_id") % 4 == 1, F.regexp_replace(rule, r"^\{", '{"rule_id":7,')).otherwise(rule), F.lit(', 7, {"entity": "bus"}] ```'))
    out = R.parse_candidates(candidates(spark, d).select("doc_id", answer.alias("answer")), "answer").where("rule IS NOT NULL")
    return out.select("doc_id", "pos", *[F.col(f"rule.{f}").alias(f) for f in ("rule_id", "entity", "action", "severity")], F.md5("rule.explanation").alias("digest"))


def prompt_fill(spark, d):
    prompt = X.fill("Text: {chunk}\nRules: {rules}", chunk=F.col("text"), rules=F.col("lang"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", prompt.alias("prompt"))


def file_stems(spark, d):
    named = F.concat(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit("_candidates.v2.jsonl"))
    return table(spark, d, "pages").select("page_id", X.stem(named).alias("stem"))


def page_documents(spark, d):
    return pages_to_document(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


#: Rules of the shield's example.
SHIELD = [
    {"rule_id": "R_001", "entity": "line", "condition": "rho > 1.0", "explanation": "overloaded line"},
    {"rule_id": "R_002", "entity": "Line", "condition": "rho > 1.2 AND temp > 0", "explanation": "hot and overloaded"},
    {"rule_id": "R_003", "entity": "bus", "condition": "(rho < 0.2 OR rho >= 1.5) AND temp < 5000", "explanation": "bus out of range"},
]


def _shielded(spark, d):
    i = F.col("s_suppkey")
    p = table(spark, d, "supplier").select("s_suppkey", _pick(["bus", "Line", "generator", "load"], i).alias("entity"), ((i % 17) / 10).alias("rho"), F.col("s_acctbal").alias("temp"))
    return H.shield(p, SHIELD, "s_suppkey", ("rho", "temp"))


def shield_eval(spark, d):
    return _shielded(spark, d)


def shield_rates(spark, d):
    out = H.shield_rates(_shielded(spark, d), F.col("s_suppkey") % 17 > 8)
    return out.select(*[F.round(c, 6).alias(c) for c in ("compliance", "false_block_rate", "block_precision")])


def rule_pipeline(spark, d):
    """Chunks through a deterministic stand-in for the model, then parsing, numbering and merging: figures per language."""

    def complete(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise TimeoutError("no answer")
        return f"<think>about {len(prompt)} characters</think>```json\n[{_rule_json(json.dumps('R_' + str(len(prompt) % 50)))}]\n```"

    docs = table(spark, d, "documents")
    chunks = X.chunk(docs, "doc_id", "text", sep="\n").join(docs.select("doc_id", "lang"), "doc_id").withColumn("prompt", X.fill("Text: {chunk}", chunk=F.col("text")))
    answered = R.call_model(chunks.select("doc_id", "lang", "chunk", "prompt"), "prompt", complete)
    parsed = R.parse_candidates(answered.select("doc_id", "lang", "chunk", "answer", "error"), "answer")
    return parsed.groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("rule").alias("n_rules"), F.count("error").alias("n_errors"), F.countDistinct("rule.rule_id").alias("distinct_ids"))


_SHIELD = """p AS (SELECT s_suppkey, s_suppkey % 4 AS e, (s_suppkey % 17) / 10.0::DOUBLE AS rho, s_acctbal AS temp FROM supplier),
x AS (SELECT s_suppkey, list_sort(list_filter([CASE WHEN e = 1 AND rho > 1 THEN 'overloaded line' END, CASE WHEN e = 1 AND rho > 1.2::DOUBLE AND temp > 0 THEN 'hot and overloaded' END,
  CASE WHEN e = 0 AND (rho < 0.2::DOUBLE OR rho >= 1.5::DOUBLE) AND temp < 5000 THEN 'bus out of range' END], lambda v: v IS NOT NULL)) AS hits FROM p),
s AS (SELECT s_suppkey, CASE WHEN len(hits) > 0 THEN 'BLOCK' ELSE 'PASS' END AS decision, array_to_string(hits, ' | ') AS explanation, CAST(len(hits) AS BIGINT) AS n_violated FROM x)"""
_CUT = """CASE WHEN start + 1200 >= n THEN n WHEN strpos(reverse(substr(text, start + 961, 240)), chr(10)) BETWEEN 1 AND 239 THEN start + 1200 - strpos(reverse(substr(text, start + 961, 240)), chr(10)) ELSE start + 1200 END"""
_CHUNKS = f"""d AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT doc_id, CAST(0 AS BIGINT) AS start FROM d WHERE n > 0
UNION ALL SELECT doc_id, CAST(e - 200 AS BIGINT) FROM (SELECT s.doc_id, n, {_CUT} AS e FROM s JOIN d USING (doc_id)) WHERE e < n),
c AS (SELECT doc_id, start, CAST({_CUT} AS BIGINT) AS "end", text FROM s JOIN d USING (doc_id)),
t AS (SELECT doc_id, start, "end", regexp_replace(substr(text, start + 1, "end" - start), '^\\s+|\\s+$', '', 'g') AS piece FROM c)"""
_MERGE = """SELECT min(doc_id) AS doc_id, lang, {} AS sources, count(*) AS n FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, source FROM documents) GROUP BY lang, text"""
_SPACE = r"[\t-\r\x{85}\p{Z}]+"


def _trim(text: str) -> str:
    """White space of any alphabet off both ends."""
    return f"regexp_replace({text}, '^{_SPACE}|{_SPACE}$', '', 'g')"



PLANS = {
    "rule_check": (rule_check, f"WITH {_CAND} SELECT * FROM checked"),
    "verdict_route": (verdict_route, f"WITH {_ROUTE} SELECT doc_id, outcome, reason, CASE WHEN outcome = 'corrected' THEN 'low' ELSE severity END AS severity, entity FROM routed"),
    "rule_figures": (
        rule_figures,
        f"""WITH {_ROUTE} SELECT lang AS file, count(*) AS n_candidates, count(*) FILTER (outcome = 'confirmed') AS n_confirmed, count(*) FILTER (outcome = 'corrected') AS n_corrected,
  count(*) FILTER (outcome = 'rejected') AS n_rejected, count(*) FILTER (outcome = 'flagged') AS n_flagged, CAST(sum(doc_id % 50) AS DOUBLE) AS total_ms, round(avg(doc_id % 50), 6) AS ms_per_rule,
  count(*) FILTER (outcome IN ('confirmed', 'corrected')) AS n_kept FROM routed GROUP BY ROLLUP (lang)""",
    ),
    "rule_numbers": (rule_numbers, f"WITH {_CAND} SELECT doc_id, printf('R_%03d', row_number() OVER (ORDER BY lang, doc_id)) AS rule_id FROM checked"),
    "candidates_by_chunk": (candidates_by_chunk, "SELECT conv_id, min(turn) AS first_seen, count(*) AS n_rules, string_agg(role, ',' ORDER BY turn, role) AS rules FROM conversations GROUP BY 1"),
    "merge_duplicates": (
        merge_duplicates,
        _MERGE.format("list_reduce(list(source ORDER BY doc_id), lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE acc || '; ' || x END)"),
    ),
    "merge_exact": (
        merge_exact,
        """WITH f AS (SELECT coalesce(lang, '') AS lang, coalesce(text, '') AS text, source, min(doc_id) AS o, count(*) AS c FROM documents GROUP BY 1, 2, 3)
SELECT min(o) AS doc_id, lang, string_agg(source, '; ' ORDER BY o) AS sources, CAST(sum(c) AS BIGINT) AS n FROM f GROUP BY lang, text""",
    ),
    "chunk_documents": (
        chunk_documents,
        f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk, start, "end", md5(piece) AS digest FROM t WHERE piece <> ''""",
    ),
    "chunk_sql": (
        chunk_sql,
        f"""WITH RECURSIVE {_CHUNKS}
SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk, start, "end", md5(piece) AS digest FROM t JOIN documents USING (doc_id) WHERE piece <> ''""",
    ),
    "chunk_lateral": (chunk_lateral, f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(piece)) AS BIGINT) AS n_chars FROM t WHERE piece <> '' GROUP BY 1"),
    "carve_arrays": (
        carve_arrays,
        f"""WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<think>[0] ' || text || chr(10) || '</think> ```json [{{"rule_id":"R_' || doc_id || '"}}] ``` end' WHEN 1 THEN 'no array: ' || text
  WHEN 2 THEN ']x[' || translate(text, '[]', '()') WHEN 3 THEN '```json' || chr(10) || '[1, 2, ' || text || ']' || chr(10) || ' ```  ' || chr(10) ELSE '[a [b] ' || text || ' c] ]tail' END AS answer FROM documents),
b AS (SELECT doc_id, {_trim("regexp_replace(answer, '<think>.*?</think>', '', 'gs')")} AS bare FROM a), c AS (SELECT doc_id, bare, string_split(bare, chr(10)) AS lines FROM b),
f AS (SELECT doc_id, bare, {_trim("regexp_replace(bare, '```(json)?', '', 'g')")} AS plain, CASE WHEN starts_with(bare, '```') THEN array_to_string(lines[2:CASE WHEN starts_with({_trim("lines[-1]")}, '```') THEN len(lines) - 1 ELSE len(lines) END], chr(10)) ELSE bare END AS led FROM c),
m AS (SELECT *, strpos(plain, '[') AS o, length(plain) - strpos(reverse(plain), ']') + 1 AS c, strpos(led, '[') AS o2, length(led) - strpos(reverse(led), ']') + 1 AS c2 FROM f)
SELECT doc_id, md5(bare) AS bare, md5(CASE WHEN o > 0 AND contains(plain, ']') AND c > o THEN substr(plain, o, c - o + 1) END) AS carved,
  md5(CASE WHEN o2 > 0 AND contains(led, ']') THEN CASE WHEN c2 >= o2 THEN substr(led, o2, c2 - o2 + 1) ELSE '' END END) AS carved_leading FROM m""",
    ),
    "rule_json": (rule_json, f"WITH {_CAND} SELECT doc_id, CAST(0 AS BIGINT) AS pos, rule_id, entity, action, severity, md5(explanation) AS digest FROM checked WHERE doc_id % 4 <> 1"),
    "prompt_fill": (prompt_fill, "SELECT doc_id, 'Text: ' || text || chr(10) || 'Rules: ' || lang AS prompt FROM documents WHERE text IS NOT NULL"),
    "file_stems": (file_stems, "SELECT page_id, replace(regexp_replace(regexp_extract(regexp_extract(url, '://([^?#]*)', 1) || '_candidates.v2.jsonl', '([^/]*)$', 1), '\\.[^.]*$', ''), '_candidates', '') AS stem FROM pages"),
    "page_documents": (
        page_documents,
        """WITH p AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS t FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(10)) <> ''),
g AS (SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY 1) SELECT conv_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n_chars FROM g""",
    ),
    "shield_eval": (shield_eval, f"WITH {_SHIELD} SELECT * FROM s"),
    "shield_rates": (
        shield_rates,
        f"""WITH {_SHIELD}, u AS (SELECT decision = 'BLOCK' AS b, s_suppkey % 17 > 8 AS unsafe FROM s) SELECT round(coalesce(count(*) FILTER (b AND unsafe)::DOUBLE / nullif(count(*) FILTER (unsafe), 0), 0), 6) AS compliance,
  round(coalesce(count(*) FILTER (b AND NOT unsafe)::DOUBLE / nullif(count(*) FILTER (NOT unsafe), 0), 0), 6) AS false_block_rate, round(coalesce(count(*) FILTER (b AND unsafe)::DOUBLE / nullif(count(*) FILTER (b), 0), 0), 6) AS block_precision FROM u""",
    ),
    "dry_run": (dry_run, f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, (SELECT count(*) FROM t WHERE t.doc_id = u.doc_id AND piece <> '') AS n_chunks FROM (SELECT DISTINCT doc_id FROM documents) u"),
    "extracted_rules": (
        extracted_rules,
        f"""WITH RECURSIVE {_CHUNKS}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk, length(piece) + 6 AS n FROM t WHERE piece <> ''),
r AS (SELECT doc_id, chunk, unnest(range(1 + n % 3)) AS pos FROM k) SELECT doc_id, chunk, printf('R_%03d', row_number() OVER (ORDER BY doc_id, chunk, pos)) AS rule_id, 'OTHER' AS action, 'high' AS severity FROM r""",
    ),
    "validated_rules": (
        validated_rules,
        f"""WITH {_CAND}, v AS (SELECT *, doc_id // 7 % 13 = 0 AS failed, CASE WHEN doc_id % 9 = 0 OR doc_id % 11 = 0 THEN NULL WHEN action = 'ALERT' THEN 'REJECT' WHEN severity = 'low' THEN 'CORRECT' ELSE 'CONFIRM' END AS verdict FROM checked),
o AS (SELECT *, CASE WHEN failed THEN 'flagged' WHEN verdict = 'CONFIRM' THEN 'confirmed' WHEN verdict = 'CORRECT' AND doc_id % 10 <> 0 THEN 'corrected' WHEN verdict = 'REJECT' THEN 'rejected' ELSE 'flagged' END AS outcome FROM v)
SELECT doc_id, outcome, CASE WHEN failed THEN 'VALIDATOR_FAIL' WHEN verdict IS NULL THEN 'NO_VERDICT' WHEN verdict = 'CORRECT' AND doc_id % 10 = 0 THEN 'INVALID_CORRECTION' END AS reason,
  CASE WHEN outcome = 'corrected' THEN 'high' ELSE severity END AS severity, entity, true AS timed FROM o""",
    ),
    "unvalidated_rules": (unvalidated_rules, f"WITH {_CAND} SELECT doc_id, 'confirmed' AS outcome, severity, action FROM checked"),
    "extraction_rates": (
        extraction_rates,
        f"""WITH {_CAND}, known AS (SELECT DISTINCT lower(entity) AS e, lower(condition) AS c, lower(severity) AS s FROM cand WHERE entity IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
found AS (SELECT lower(entity) AS e, lower(condition) AS c, lower(severity) AS s FROM checked), hits AS (SELECT k.e IS NOT NULL AS hit FROM found f LEFT JOIN known k USING (e, c, s))
SELECT round((SELECT count(*) FROM known WHERE (e, c, s) IN (SELECT (e, c, s) FROM found))::DOUBLE / nullif((SELECT count(*) FROM known), 0), 6) AS coverage,
  round((SELECT avg(hit::INT) FROM hits), 6) AS precision, round((SELECT count(*) FROM checked)::DOUBLE / (SELECT count(*) FROM cand), 6) AS parse_rate""",
    ),
    "rule_pipeline": (
        rule_pipeline,
        f"""WITH RECURSIVE {_CHUNKS}, a AS (SELECT lang, length(piece) + 6 AS n FROM t JOIN documents USING (doc_id) WHERE piece <> '')
SELECT lang, count(*) AS n_chunks, count(*) FILTER (n % 7 <> 0) AS n_rules, count(*) FILTER (n % 7 = 0) AS n_errors, count(DISTINCT n % 50) FILTER (n % 7 <> 0) AS distinct_ids FROM a GROUP BY 1""",
    ),
}
