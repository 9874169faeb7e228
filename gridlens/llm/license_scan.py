"""License scans by ordered signature rules, in DataFrame functions only.

A text's words are gone through once for keywords, and only around a keyword's places the rules of that keyword are
tried, on the words as they stand there. Detections are intervals of words. One that lies within another of the same or
higher priority is suppressed; of equal intervals and priorities the earlier rule stays. Base rules are counted at all
their places and never suppressed. All of it happens within the row, so nothing is shuffled and no text is long enough
to gather anything beside itself.

Cases: null, empty and blank texts have no words and no detections; repeated rows give equal results; texts of any
length are scanned whole; an empty table gives no rows; a column called like a result is replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import NOTICE, RADIUS, RULES, SURE, Rule

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sorts by start, longest first, then highest priority, then order of rules.
HIT = "struct<start:int,back:int,lower:int,rule:int,end:int,label:string,priority:int,base:boolean>"
BLOCK = 256


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def _by_keyword(rules: Sequence[Rule]) -> Column:
    """Keyword to its rules; a constant."""
    found: dict[str, list[Column]] = {}
    for k, r in enumerate(rules):
        one = F.struct(F.lit(k).alias("rule"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.base).alias("base"))
        for word in r.keywords:
            found.setdefault(word, []).append(one)
    return F.create_map(*[c for word, own in found.items() for c in (F.lit(word), F.array(*own))])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _hits(words: Column, rules: Sequence[Rule]) -> Column:
    keywords = sorted({w for r in rules for w in r.keywords})
    known = _by_keyword(rules)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(keywords))
    places = F.when(F.size(words) > 0, places).otherwise(F.array().cast("array<int>"))

    def around(i: Column) -> Column:
        """The words about place ``i`` as one string, with a mark before it."""
        left = F.slice(words, F.greatest(i - RADIUS, F.lit(0)) + 1, F.least(i, F.lit(RADIUS)))
        return F.concat(F.array_join(left, " "), F.lit(" <"), F.array_join(F.slice(words, i + 1, RADIUS + 1), " "))

    def tried(i: Column) -> Column:
        near = F.get(F.transform(F.array(around(i)), lambda s: F.transform(F.element_at(known, F.get(words, i)), lambda r: F.struct(r.alias("r"), F.call_function("regexp_extract", s, r["pattern"], F.lit(1)).alias("said")))), 0)

        def hit(x: Column) -> Column:
            start = i - _blanks(F.substring_index(x["said"], "<", 1))
            end = start + _blanks(x["said"]) + 1
            r = x["r"]
            return F.struct(start.alias("start"), (-end).alias("back"), (-r["priority"]).alias("lower"), r["rule"].alias("rule"), end.alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["base"].alias("base")).cast(HIT)

        return F.transform(F.filter(near, lambda x: x["said"] != ""), hit)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(places, tried))))


def _unsuppressed(hits: Column) -> Column:
    """Sorted hits without those that lie in an earlier one of their priority or a higher one.

    ``ends`` holds the furthest end met so far by least priority. Hits are folded in blocks, so that what is kept is
    not copied for each of them.
    """
    none, kind = F.array().cast(f"array<{HIT}>"), f"array<{HIT}>"

    def step(acc: Column, h: Column) -> Column:
        stays = h["base"] | (F.get(acc["ends"], h["priority"]) < h["end"])
        ends = F.transform(acc["ends"], lambda e, level: F.when(level <= h["priority"], F.greatest(e, h["end"])).otherwise(e))
        return F.struct(F.when(stays, F.concat(acc["kept"], F.array(h))).otherwise(acc["kept"]).cast(kind).alias("kept"), ends.alias("ends"))

    def block(acc: Column, hs: Column) -> Column:
        inner = F.aggregate(hs, F.struct(none.alias("kept"), acc["ends"].alias("ends")), step)
        return F.get(F.transform(F.array(inner), lambda a: F.struct(F.concat(acc["kept"], F.array(a["kept"])).cast(f"array<{kind}>").alias("kept"), a["ends"].alias("ends"))), 0)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(hits, b * BLOCK + 1, BLOCK))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.array(*[F.lit(-1)] * (NOTICE + 1)).alias("ends"))
    return F.when(F.size(hits) > 0, F.flatten(F.aggregate(blocks, start, block)["kept"])).otherwise(none)


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``n_words`` and ``detections``: array<struct<start, end, label, rule, priority, base>> in words, by start."""
    names = ("n_words", "detections")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    rest = docs.select(*kept, F.struct(words_of(docs[text_col]).alias("words")).alias("detections"))
    rest = rest.select(*kept, F.size("detections.words").cast("long").alias("n_words"), _hits(F.col("detections.words"), rules).alias("detections"))
    final = F.transform(_unsuppressed(F.col("detections")), lambda h: F.struct(*[h[c].alias(c) for c in ("start", "end", "label", "rule", "priority", "base")]))
    return rest.select(*kept, "n_words", final.alias("detections"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    named = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: d["label"]))), ",")
    sure = F.aggregate("detections", F.lit(0.0), lambda best, d: F.greatest(best, F.get(F.array(*map(F.lit, SURE)), d["priority"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("detections")).alias("labels"),
        sure.alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same rules as a table; suppression by its definition, as an anti-join.
OP11_SQL = rf"""
WITH rules(rule, keyword, pattern, label, priority, base) AS (VALUES
  {", ".join(f"({k}, {_quoted(w)}, {_quoted(r.pattern)}, {_quoted(r.label)}, {r.priority}, {str(r.base).lower()})" for k, r in enumerate(RULES) for w in r.keywords)}
), docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{NOT_WORD}'), lambda w: w <> '') AS w FROM documents
), placed AS (SELECT d, w, i, w[i + 1] AS keyword FROM docs, unnest(range(len(w))) AS u(i)),
near AS (
  SELECT d, i, keyword, coalesce(list_aggregate(w[greatest(i - {RADIUS}, 0) + 1 : i], 'string_agg', ' '), '') || ' <' || list_aggregate(w[i + 1 : i + {RADIUS} + 1], 'string_agg', ' ') AS words
  FROM placed WHERE keyword IN (SELECT keyword FROM rules)
), said AS (SELECT d, i, rule, label, priority, base, regexp_extract(words, pattern, 1) AS said FROM near JOIN rules USING (keyword)),
hits AS (
  SELECT DISTINCT d, rule, label, priority, base, i - (length(left(said, strpos(said, '<'))) - length(replace(left(said, strpos(said, '<')), ' ', ''))) AS s,
    length(said) - length(replace(said, ' ', '')) + 1 AS n
  FROM said WHERE said <> ''
), kept AS (
  SELECT * FROM hits h WHERE base OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.d = h.d AND o.s <= h.s AND o.s + o.n >= h.s + h.n AND o.priority >= h.priority
    AND (o.s < h.s OR o.n > h.n OR o.priority > h.priority OR o.rule < h.rule))
), per AS (
  SELECT d, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) AS most
  FROM kept GROUP BY d
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(CASE most WHEN 0 THEN {SURE[0]} WHEN 1 THEN {SURE[1]} WHEN 2 THEN {SURE[2]} WHEN 3 THEN {SURE[3]} ELSE 0 END AS DOUBLE) AS score
FROM docs LEFT JOIN per USING (d)
"""
