import random
import re

from oracle import check
from pyspark.sql import functions as F

from gridlens.llm import license_scan as S
from gridlens.llm import queries
from gridlens.llm.license_rules import RADIUS, RULES, Rule


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_scan(text, rules):
    """Every rule at every word, then suppression by its definition."""
    words, hits = words_of(text), set()
    for i in range(len(words)):
        near = " ".join(words[max(0, i - RADIUS) : i]) + " <" + " ".join(words[i : i + RADIUS + 1])
        for k, r in enumerate(rules):
            if m := re.search(r.pattern, near):
                start = i - m[1].split("<")[0].count(" ")
                hits.add((start, start + m[1].count(" ") + 1, r.label, k, r.priority, r.base))

    def stays(h):
        inside = [o for o in hits if o[0] <= h[0] and o[1] >= h[1] and o[4] >= h[4] and o != h]
        return h[5] or not any(o[0] < h[0] or o[1] > h[1] or o[4] > h[4] or o[3] < h[3] for o in inside)

    return sorted(filter(stays, hits), key=lambda h: (h[0], -h[1], -h[4], h[3]))


def example(rule):
    """Words that the rule finds: first alternatives, without what may be left out."""
    text = rule.body.replace("<", "").replace("[cs]", "s").replace("[0-9]", "7").replace("[a-z0-9]*", "oo").replace("[123]", "2")
    while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?|\{0,8\})?|([^() ])\?", lambda m: "" if m[2] or m[3] else m[1], text)) != text:
        text = new
    return " ".join(text.split())


def widest(body):
    """The most blanks that a rule reads."""
    body = re.sub(r"\(\?:([^()]*)\)\{0,8\}", lambda m: " x" * 8, body)
    while "(" in body:
        body = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m[1].split("|"), key=lambda s: s.count(" ")), body)
    return body.count(" ")


def test_rules_find_their_words():
    assert len(RULES) > 300 and len({r.body for r in RULES}) == len(RULES)
    for r in RULES:
        assert widest(r.body) <= RADIUS, r
        found = plain_scan(example(r), [r])
        assert found and found[0][2] == r.label, (r, example(r))
        assert r.body.count("<") == 1 and not re.search(r"\((?!\?:)", r.body)


def test_known_notices(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0,licensed",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl,gpl-2.0-or-later",
        "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "All rights reserved. All rights reserved": "reserved",
        "https://creativecommons.org/licenses/by-sa/3.0/": "cc-by-sa-3.0",
        "mit der Lizenz; the public; by cc": "",
        "All rights": "",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = S.scan_licenses(df).select("doc_id", F.array_join(F.array_sort(F.array_distinct("detections.label")), ",").alias("labels")).collect()
    assert {r.doc_id: r.labels for r in got} == dict(enumerate(cases.values()))


def test_scan_against_plain_version(spark):
    """Random texts of parts of rules, with rules of all priorities that overlap, and more hits than a block holds."""
    rules = [Rule(str(k), b, k % 4, base=k == 3) for k, b in enumerate(["<a", "a <b", "<b a", "<b b", "a b <c", "<(?:c|d)(?: a)? b", "b (?:c )?<d", "a <b(?: c)?", "<a b", "(?:d )?c <c"])]
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [" ".join(rng.choice("abc") for _ in range(900))]
    rows = S.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=rules).collect()
    for r in rows:
        assert [tuple(d) for d in r.detections] == plain_scan(r.text, rules)
    assert max(len(r.detections) for r in rows) > S.BLOCK


def test_licenses_against_sql(spark, data):
    check(queries.QUERIES["op11_license_scans"](spark, data), queries.ORACLE_SQL["op11_license_scans"], data)


def test_no_python_in_plan(spark, data):
    plan = queries.QUERIES["op11_license_scans"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("Detections", F.lit(1)).withColumn("words", F.lit("w"))
    got = S.scan_licenses(docs).collect()
    assert len(got) == docs.count() and set(docs.columns) - {"Detections"} <= set(got[0].asDict())
    for r in got:
        assert r.n_words == len(words_of(r.text)) and r.detections == []
    rights = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" ALL\x00Rights-reserved "), F.repeat(F.lit("é"), 5)))
    for r in S.scan_licenses(rights).collect():
        assert [(d.start, d.end, d.label) for d in r.detections] == [(r.n_words - 4, r.n_words - 1, "reserved")]
    assert S.scan_licenses(no_docs).count() == 0
