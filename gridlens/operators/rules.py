"""The data side of a rule pipeline: extraction, schema checks, verdict routing, numbering, merging and run figures.

The model call is a parameter (``Completer``): text in, text out. It runs inside tasks, once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import unused
from ..schemas import RULE_FIELDS
from ..sources.scratch import written
from .splits import with_ordinal

Completer = Callable[[str], str]

#: The domains of a rule's fields.
ENTITIES = ("bus", "line", "transformer", "generator", "load", "protectiondevice", "grid")
SEVERITIES = ("critical", "high", "medium", "low")
ACTIONS = ("BLOCK", "DISCONNECT", "ALERT", "REDISPATCH", "RECONNECT", "RESPOND_WITHIN_2S", "SHED_LOAD", "OTHER")
VERDICTS = ("CONFIRM", "REJECT", "CORRECT")


def checked(fields: dict[str, Column]) -> Column:
    """The normalised rule as a struct, or null: every field a string, entity in its domain in any case (kept as written),
    severity in its domain (lower-cased), action upper-cased with OTHER for unknown ones."""
    action = F.upper(fields["action"])
    values = dict(fields)
    values["severity"] = F.lower(fields["severity"])
    values["action"] = F.when(action.isin(*ACTIONS), action).otherwise("OTHER")
    ok = F.lower(fields["entity"]).isin(*ENTITIES) & F.lower(fields["severity"]).isin(*SEVERITIES)
    for f in RULE_FIELDS:
        ok = ok & fields[f].isNotNull()
    return F.when(ok, F.struct(*[values[f].alias(f) for f in RULE_FIELDS]))


def check_rules(rows: DataFrame) -> DataFrame:
    """Adds ``rule`` (null if invalid) from seven columns of the rules' field names."""
    return rows.withColumn("rule", checked({f: F.col(f) for f in RULE_FIELDS}))


def string_field(value: Column, name: str) -> Column:
    """A field of a variant object if it is a string there: numbers and missing fields are null rather than converted."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))


def parse_candidates(rows: DataFrame, answer_col: str) -> DataFrame:
    """One row per item of the carved JSON array: the columns of ``rows``, ``pos``, ``item`` (variant) and the checked ``rule``."""
    return array_items(rows, answer_col).withColumn("rule", checked({f: string_field(F.col("item"), f) for f in RULE_FIELDS}))


def array_items(rows: DataFrame, answer_col: str) -> DataFrame:
    """One row per item of the JSON array in an answer: the columns of ``rows``, ``pos``, ``item``; nulls if there is none."""
    parsed = unused([*rows.columns, "pos", "key", "value"], "parsed")
    carved = rows.withColumn(parsed, F.try_parse_json(X.carve_array(F.col(answer_col))))
    items = carved.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col(parsed).outer()))
    return items.select(*rows.columns, F.col("pos").cast("long").alias("pos"), F.col("value").alias("item"))


def call_model(chunks: DataFrame, prompt_col: str, complete: Completer, retries: int = 1) -> DataFrame:
    """Adds ``answer``, ``error`` and ``elapsed_ms``; a failing call leaves no answer and no time, only its error."""
    import time

    names = chunks.columns

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            answers, errors, times = [], [], []
            for prompt in b[prompt_col]:
                answer, error, took = None, None, 0.0
                for _ in range(1 + retries):
                    began = time.perf_counter()
                    try:
                        answer, error, took = complete(prompt), None, (time.perf_counter() - began) * 1000
                        break
                    except Exception as e:  # a model's failure is data here
                        answer, error, took = None, f"{type(e).__name__}: {e}", 0.0
                answers.append(answer)
                errors.append(error)
                times.append(took)
            yield b[names].assign(answer=answers, error=errors, elapsed_ms=times)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, answer string, error string, elapsed_ms double")


def extract(docs: DataFrame, file_col: str, text_col: str, template: str, complete: Completer, dry_run: bool = False, size: int = 1200, overlap: int = 200, sep: str = "\n\n") -> DataFrame:
    """Valid rules of all files, numbered through: file, chunk and ``rule`` with its new ``rule_id``. With ``dry_run`` no call
    is made and each file's ``n_chunks`` is given, 0 for a file without text."""
    chunks = X.chunk(docs, file_col, text_col, size, overlap, sep)
    if dry_run:
        counted = chunks.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_chunks"))
        return docs.select(file_col).distinct().join(counted, file_col, "left").select(file_col, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    answered = call_model(chunks.select(file_col, "chunk", X.fill(template, chunk=F.col("text")).alias("prompt")), "prompt", complete)
    found = parse_candidates(answered.select(file_col, "chunk", "answer"), "answer").where("rule IS NOT NULL").select(file_col, "chunk", "pos", "rule")
    return numbered(found, file_col, ["chunk", "pos"]).select(file_col, "chunk", F.col("rule").withField("rule_id", F.col("rule_id")).alias("rule"))


def by_chunk(candidates: DataFrame, chunk_col: str, order_col: str, rule_col: str) -> DataFrame:
    """Rules of each chunk in order, chunks by their first rule: one validator call a chunk."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(rule_col).alias("r"))))
    return candidates.groupBy(chunk_col).agg(F.min(order_col).alias("first_seen"), F.count(F.lit(1)).alias("n_rules"), F.transform(listed, lambda x: x["r"]).alias("rules"))


def validate(rules: DataFrame, chunks: DataFrame, chunk_col: str, text_col: str, template: str, complete: Completer | None) -> DataFrame:
    """``rules``: chunk and ``rule``; ``chunks``: chunk and its text. Adds outcome, reason, the final rule and ``validate_ms``.

    One model call for each chunk that has rules, with all of them as JSON in the prompt (``{chunk}``, ``{rules}``); a
    call that fails flags all its rules. The call's time is shared out evenly among them. Without ``complete`` validation is
    left out, and every rule is confirmed.
    """
    if complete is None:
        return rules.select("*", F.lit("confirmed").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.col("rule").alias("final_rule"), F.lit(0.0).alias("validate_ms"))
    keyed = rules.withColumn("rule_id", F.col("rule.rule_id"))
    asked = by_chunk(keyed, chunk_col, "rule_id", "rule").join(chunks.select(chunk_col, F.col(text_col).alias("chunk_text")), chunk_col, "left")
    prompt = X.fill(template, chunk=F.coalesce("chunk_text", F.lit("")), rules=F.to_json("rules"))
    # calls are made once: their answers serve as verdicts, as failures and for their times
    answered = written(call_model(asked.select(chunk_col, "n_rules", prompt.alias("prompt")), "prompt", complete).drop("prompt"), "answers")
    item = F.col("item")
    verdicts = array_items(answered.where("error IS NULL"), "answer").select(
        chunk_col, "pos", string_field(item, "rule_id").alias("rule_id"), string_field(item, "verdict").alias("verdict"), F.try_variant_get(item, "$.corrected_fields", "map<string,string>").alias("corrected")
    )
    calls = answered.select(chunk_col, F.col("error").isNotNull().alias("failed"), (F.col("elapsed_ms") / F.greatest("n_rules", F.lit(1))).alias("validate_ms"))
    return route(keyed.join(calls, chunk_col), verdicts, [chunk_col, "rule_id"], failed=F.col("failed")).drop("failed", "rule_id")


def last_verdicts(verdicts: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Well-formed verdicts only, upper-cased; of several for one rule the last counts."""
    word = F.upper("verdict")
    return verdicts.withColumn("verdict", word).where(word.isin(*VERDICTS)).groupBy(*keys).agg(F.max_by(F.struct("verdict", "corrected"), order_col).alias("v"))


def route(rules: DataFrame, verdicts: DataFrame, keys: list[str], order_col: str = "pos", failed: Column | None = None) -> DataFrame:
    """``rules``: keys and ``rule``; ``verdicts``: keys, verdict, corrected (map) and an order. Adds outcome, reason and the final rule.

    CONFIRM confirms; CORRECT merges its fields, a key with a null value included, and needs the result to be valid, else
    the original is flagged; REJECT only counts; no verdict flags NO_VERDICT; a failed call flags VALIDATOR_FAIL.
    """
    joined = rules.join(last_verdicts(verdicts, keys, order_col), keys, "left")
    fix = F.coalesce(F.col("v.corrected"), F.create_map().cast("map<string,string>"))
    merged = checked({f: F.when(F.array_contains(F.map_keys(fix), f), F.try_element_at(fix, F.lit(f))).otherwise(F.col(f"rule.{f}")) for f in RULE_FIELDS})
    word = F.col("v.verdict")
    m = unused([*joined.columns, "outcome", "reason", "final_rule"], "merged")
    out = joined.withColumn(m, merged)
    outcome = (
        F.when(word == "CONFIRM", "confirmed").when((word == "CORRECT") & F.col(m).isNotNull(), "corrected").when(word == "REJECT", "rejected").otherwise("flagged")
    )
    reason = F.when(word.isNull(), "NO_VERDICT").when((word == "CORRECT") & F.col(m).isNull(), "INVALID_CORRECTION")
    if failed is not None:
        outcome, reason = F.when(failed, "flagged").otherwise(outcome), F.when(failed, "VALIDATOR_FAIL").otherwise(reason)
    final = F.when(outcome == "corrected", F.col(m)).otherwise(F.col("rule"))
    return out.select(*rules.columns, outcome.alias("outcome"), reason.alias("reason"), final.alias("final_rule"))


def numbered(rules: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rule_id`` R_001, R_002, ... in the order of (group, order)."""
    return with_ordinal(rules, group, *order).withColumn("rule_id", X.rule_id(F.col("ordinal") + 1)).drop("ordinal")


def merge_duplicates(rows: DataFrame, keys: list[str], order: str, source: str, exact: bool = False) -> DataFrame:
    """First row of each key with the sources of all, joined by ``; ``. A source that is a substring of what is joined so
    far is left out; with ``exact`` only equal sources are. Keys without value count as empty, and case matters.

    Equal (key, source) pairs are reduced to their first occurrence beforehand, so that a key copied very often stays small.
    """
    named = rows.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys], F.col(order).alias("__o"), F.col(source).alias("__s"))
    fewer = named.groupBy(*keys, "__s").agg(F.min("__o").alias("__o"), F.count(F.lit(1)).alias("__n"))
    listed = F.array_sort(F.collect_list(F.struct("__o", "__s")))
    merged = fewer.groupBy(*keys).agg(F.min("__o").alias("first"), F.sum("__n").alias("n"), listed.alias("l"))
    if exact:
        sources = F.array_join(F.transform("l", lambda x: x["__s"]), "; ")
    else:
        rest = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
        sources = F.aggregate(rest, F.col("l")[0]["__s"], lambda acc, x: F.when(F.contains(acc, x["__s"]), acc).otherwise(F.concat(acc, F.lit("; "), x["__s"])))
    return merged.select(*keys, F.col("first").alias(order), sources.alias("sources"), "n")


def run_figures(routed: DataFrame, file_col: str, ms: Column | None = None) -> DataFrame:
    """Outcome counts per file and in all (``file`` null), with the mean latency a rule if given."""
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("confirmed", "corrected", "rejected", "flagged")]
    extra = [F.sum(ms).alias("total_ms"), F.avg(ms).alias("ms_per_rule")] if ms is not None else []
    return routed.rollup(F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("n_candidates"), *counts, *extra).withColumn("n_kept", F.col("n_confirmed") + F.col("n_corrected"))


def extraction_rates(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of the known rules that were extracted, share of extracted rules that are known ones, and share of
    candidates that parse. ``candidates`` has the checked ``rule``; rules are compared by ``keys``, in any case."""
    own = lambda of: [F.lower(F.col(of + k)).alias(k) for k in keys]
    found = candidates.groupBy(*own("rule.")).agg(F.count(F.lit(1)).alias("n"), F.count("rule").alias("n_valid"))
    listed = known.select(*own("")).distinct().withColumn("listed", F.lit(True))
    met = found.join(listed, keys, "full_outer")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    known_valid = F.sum(F.when(F.col("listed"), F.col("n_valid")))
    return met.agg(
        share(F.count_if(F.col("listed") & (F.col("n_valid") > 0)), F.count_if("listed")).alias("coverage"),
        share(F.coalesce(known_valid, F.lit(0)), F.sum("n_valid")).alias("precision"),
        share(F.sum("n_valid"), F.sum("n")).alias("parse_rate"),
    )
