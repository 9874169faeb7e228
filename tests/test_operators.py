"""Small cases with known results, above all those that the given tables lack."""

import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridlens import schemas
from gridlens.functions import arrays as A
from gridlens.functions import text as X
from gridlens.operators import attention, audit, features, labels, metrics, rules, scoring, shield, splits, stats
from gridlens.sources import readers, writers

INF, NAN = float("inf"), float("nan")


def one(df):
    return df.collect()[0]


def test_cleaning_orders(spark):
    df = spark.createDataFrame([([0.5, 1.2, INF, NAN, -3.0],)], "a array<double>")
    r = one(df.select(A.fill_nonfinite(F.col("a")).alias("f"), A.clean_then_cap(F.col("a"), 1.0).alias("w"), A.clip_then_clean(F.col("a"), 2.0).alias("r")))
    assert r.f == [0.5, 1.2, 0.0, 0.0, -3.0]
    assert r.w == [0.5, 1.0, 0.0, 0.0, -3.0]
    assert r.r == [0.5, 1.2, 2.0, 0.0, 0.0]


def test_assert_finite(spark):
    df = spark.createDataFrame([([1.0],), ([NAN],)], "a array<double>")
    with pytest.raises(Exception, match="non-finite value in rho"):
        df.select(A.assert_finite(F.col("a"), "rho")).collect()


def test_argmax_and_masks(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, NAN], [True, False, True], [False, False, True])], "a array<double>, b array<boolean>, n array<boolean>")
    r = one(
        df.select(
            A.argmax(F.col("a")).alias("at"),
            A.first_true(F.col("n")).alias("first"),
            A.first_true(F.transform("n", lambda x: x & ~x)).alias("none"),
            A.places(A.newly_off(F.col("b"), F.col("n"))).alias("off"),
            A.count_nan(F.col("a")).alias("nan"),
            A.gather(F.col("a"), F.lit(9)).alias("beyond"),
        )
    )
    assert (r["at"], r["first"], r["none"], r["off"], r["nan"], r["beyond"]) == (1, 2, None, [0], 1, None)


def test_node_features(spark):
    rho = [0.5, 1.2, INF]
    volt = [150.0, 75.0, NAN]
    rows = [(i, s, d, rho[i], volt[i], st) for i, (s, d, st) in enumerate([(0, 1, True), (1, 2, False), (0, 2, True)])]
    lines = spark.createDataFrame(rows, "id int, src int, dst int, rho double, v double, status boolean")
    lines = lines.select("id", "src", "dst", "status", F.least(F.greatest(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)), F.lit(2.0)).alias("rho"), F.nanvl("v", F.lit(0.0)).alias("v_or"))
    nodes = spark.range(4).select(F.col("id").cast("int").alias("node"))
    loads = features.scatter_add(spark.createDataFrame([(1, 10.0), (2, 20.0)], "b int, p double"), "b", "p", "load_p")
    gens = features.scatter_add(spark.createDataFrame([(0, 30.0)], "b int, p double"), "b", "p", "gen_p")
    got = {r.node: (r.load_p, r.gen_p, r.mean_v, r.max_rho, r.connected) for r in features.node_features(nodes, loads, gens, lines).collect()}
    assert got == {0: (0, 30, 0.5, 2.0, 1.0), 1: (10, 0, 0.75, 1.2, 0.5), 2: (20, 0, 0.25, 2.0, 0.5), 3: (0, 0, 0, 0, 1.0)}
    edges = features.both_directions(lines.select("id", "src", "dst")).collect()
    assert sorted((e.id, e.src, e.dst, e.reversed) for e in edges) == [(0, 0, 1, False), (0, 1, 0, True), (1, 1, 2, False), (1, 2, 1, True), (2, 0, 2, False), (2, 2, 0, True)]


LADDER = [
    (1.2, [], None, 4, "maintenance", 4),
    (1.2, [3], 3, None, "overload", 0),
    (0.5, [3], 3, None, "line_trip", 3),
    (0.5, [5], None, None, "cascade", 5),
    (0.5, [3, 7], 3, None, "cascade", 7),
    (0.5, [], None, None, "normal", None),
    (0.8, [3], 3, None, "overload", 0),
    (0.75, [3], 3, None, "line_trip", 3),
]


def test_priority_ladder(spark):
    df = spark.createDataFrame([([top, 0.1], trips, inj, m) for top, trips, inj, m, _, _ in LADDER], "rho array<double>, trips array<bigint>, inj int, m int")
    args = [F.col(c) for c in ("rho", "trips", "inj", "m")]
    got = df.select(labels.priority_label(*args, F.lit("normal")).alias("l"), labels.priority_line(*args).alias("at")).collect()
    assert [(r.l, r["at"]) for r in got] == [(x[4], x[5]) for x in LADDER]


def test_screening_of_empty_arrays(spark):
    df = spark.createDataFrame([([], [], []), ([2.0], [False], []), ([NAN, 0.2], [True], [True])], "r array<double>, s array<boolean>, m array<boolean>")
    got = [r.l for r in df.select(labels.screening_label(F.col("r"), F.col("s"), F.col("m")).alias("l")).collect()]
    assert got == ["normal", "overload", "maintenance"]


COUNTS = {"normal": 115, "overload": 55, "line_trip": 48, "cascade": 16}


def test_class_weights(spark):
    rows = spark.createDataFrame([(k,) for k, n in COUNTS.items() for _ in range(n)], "label string")
    got = {r.label: round(r.weight, 6) for r in stats.class_weights(rows, "label", tuple(COUNTS)).collect()}
    assert got == {"normal": 0.508696, "overload": 1.063636, "line_trip": 1.21875, "cascade": 3.65625}
    five = {r.label: r.weight for r in stats.class_weights(rows, "label", (*COUNTS, "maintenance")).collect()}
    assert five["maintenance"] == 0 and math.isclose(five["normal"], 0.508696 * 0.8, rel_tol=1e-5)
    assert one(stats.imbalance(rows, "label")).ratio == 7.19
    assert one(stats.missing_labels(rows, "label", schemas.LABELS, ("cascade", "maintenance"))).severity == "high"


@pytest.mark.parametrize(("n", "cut"), [(10, (7, 1, 2)), (20, (14, 3, 3)), (234, (163, 35, 36)), (1000, (700, 150, 150))])
def test_ordered_split(spark, n, cut):
    got = splits.ordered_split(spark.range(0, n * 3, 3).repartition(3), "id").collect()
    assert [r.id // 3 for r in sorted(got, key=lambda r: r.ordinal)] == list(range(n))
    assert tuple(sum(r.split == s for r in got) for s in ("train", "val", "test")) == cut
    assert [r.split for r in sorted(got, key=lambda r: r.id)] == ["train"] * cut[0] + ["val"] * cut[1] + ["test"] * cut[2]


LETTERS = "abcdefghijklmnopqrstuvwxy"


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        (LETTERS, 10, 2, [(0, 10), (8, 18), (16, 25)]),
        ("abcdefghi\n\nklmnopqrst", 12, 2, [(0, 12), (10, 21)]),
        ("abcdefghij\n\nlmnopqrst", 12, 2, [(0, 10), (8, 20), (18, 21)]),
        ("     ", 10, 2, []),
        ("", 10, 2, []),
        (None, 10, 2, []),
    ],
)
def test_chunker(spark, text, size, overlap, want):
    got = X.chunk(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", size, overlap).collect()
    assert [(r.start, r.end) for r in got] == want
    assert all(r.text in text and r.text == r.text.strip() for r in got)


def test_chunker_refuses_wide_overlap():
    with pytest.raises(ValueError):
        list(X.spans("abc", 10, 8, "\n"))


def test_carving(spark):
    rows = ['<think>[0]</think>```json\n[{"rule_id":"R_1"}]\n```', "no array", "]x[", "[1"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    assert [r.c for r in df.select(X.carve_array(F.col("a")).alias("c")).collect()] == ['[{"rule_id":"R_1"}]', None, None, None]
    assert one(spark.range(1).select(X.rule_id(F.lit(7)).alias("a"), X.rule_id(F.lit(1234)).alias("b"))) == Row(a="R_007", b="R_1234")


def rule(**change):
    return {"rule_id": "R_1", "source": "S1", "entity": "bus", "condition": "c", "action": "BLOCK", "severity": "low", "explanation": "e"} | change


def test_rule_schema(spark):
    items = [rule(entity="bUs"), rule(severity="HIGH"), rule(action="trip"), rule(entity="cable"), {k: v for k, v in rule().items() if k != "source"}, rule(rule_id=5), rule(extra=1), 7, None]
    got = rules.parse_candidates(spark.createDataFrame([(1, json.dumps(items)), (2, "nothing")], "id int, answer string"), "answer").where("id = 1").orderBy("pos").collect()
    kept = [r.rule for r in got]
    assert [k is not None for k in kept] == [True, True, True, False, False, False, True, False, False]
    assert kept[0].entity == "bUs" and kept[1].severity == "high" and kept[2].action == "OTHER"


def test_verdict_routes(spark):
    r = rule()
    data = [("a", r), ("b", r), ("c", r), ("d", r), ("e", r), ("f", r), ("g", r), ("h", r)]
    df = spark.createDataFrame([(k, Row(**v)) for k, v in data], "k string, rule struct<rule_id:string,source:string,entity:string,condition:string,action:string,severity:string,explanation:string>")
    v = [
        ("a", "CONFIRM", {}, 0),
        ("b", "correct", {"severity": "LOW"}, 0),
        ("c", "CORRECT", {"entity": "x"}, 0),
        ("d", "REJECT", {}, 0),
        ("e", "MAYBE", {}, 0),
        ("f", "REJECT", {}, 0),
        ("f", "CONFIRM", {}, 1),
        ("g", "CORRECT", {"severity": None}, 0),
    ]
    got = {x.k: (x.outcome, x.reason, x.final_rule.entity) for x in rules.route(df, spark.createDataFrame(v, "k string, verdict string, corrected map<string,string>, pos int"), ["k"]).collect()}
    assert got == {
        "a": ("confirmed", None, "bus"),
        "b": ("corrected", None, "bus"),
        "c": ("flagged", "INVALID_CORRECTION", "bus"),
        "d": ("rejected", None, "bus"),
        "e": ("flagged", "NO_VERDICT", "bus"),
        "f": ("confirmed", None, "bus"),
        "g": ("flagged", "INVALID_CORRECTION", "bus"),
        "h": ("flagged", "NO_VERDICT", "bus"),
    }
    failed = rules.route(df, spark.createDataFrame(v, "k string, verdict string, corrected map<string,string>, pos int"), ["k"], failed=F.lit(True)).collect()
    assert {x.reason for x in failed} == {"VALIDATOR_FAIL"}


def test_merge_duplicates(spark):
    rows = [(1, "Bus", "c1", "S1"), (2, "Bus", "c1", "S2"), (3, "Bus", "c1", "S1"), (4, "bus", "c1", "S3"), (5, "Bus", "c1", "S"), (6, None, "c1", "S9")]
    df = spark.createDataFrame(rows, "i int, e string, c string, s string")
    got = {(r.e, r.c): (r.i, r.sources, r.n) for r in rules.merge_duplicates(df, ["e", "c"], "i", "s").collect()}
    assert got == {("Bus", "c1"): (1, "S1; S2", 4), ("bus", "c1"): (4, "S3", 1), ("", "c1"): (6, "S9", 1)}
    assert {r.sources for r in rules.merge_duplicates(df, ["e", "c"], "i", "s", exact=True).collect()} == {"S1; S2; S", "S3", "S9"}


def test_model_calls_and_numbers(spark):
    calls = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")

    def complete(prompt):
        if prompt == "bad":
            raise TimeoutError("late")
        return "[]"

    got = {r.id: r for r in rules.call_model(calls, "prompt", complete).collect()}
    assert got[1].answer == "[]" and got[1].error is None
    assert got[2].answer is None and got[2].error == "TimeoutError: late" and got[2].elapsed_ms == 0
    numbers = rules.numbered(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "f string, p int"), "f", ["p"]).collect()
    assert {(r.f, r.p): r.rule_id for r in numbers} == {("a", 1): "R_001", ("a", 2): "R_002", ("b", 1): "R_003"}


def test_early_stop(spark):
    scores = [(0, i, s) for i, s in enumerate([0.5, 0.5005, 0.502, 0.5025, 0.5026, 0.9])]
    df = spark.createDataFrame(scores, "k int, i int, s double")
    assert one(scoring.early_stop(df, "k", "i", "s", 0.001, 2)) == Row(k=0, best=0.502, counter=2, stopped=True, epochs=5)
    assert [r.i for r in scoring.improvements(df, "k", "i", "s").where("improved").orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]


def test_scorecard(spark):
    envs = [
        ("small", 36, 59, 735.3525949096493, 0.00800711743772242, 0.3830071174377224, 2 / 3),
        ("large", 118, 186, 501.0591024581618, 0.06464646464646465, 0.22121212121212122, 2 / 3),
    ]
    card = scoring.scorecard(spark.createDataFrame(envs, "env_name string, n_sub int, n_line int, steps_per_sec double, overload_rate double, non_normal_rate double, class_diversity double"))
    names = ("scope_fit_score", "efficiency_score", "event_richness_score", "simplicity_score", "final_score", "integration_score", "scale_score")
    got = {r.env_name: tuple(r[n] for n in names) for r in card.collect()}
    assert got == {"small": (1.0, 1.0, 0.7167, 1.0, 0.9433, 1.0, 0.7725), "large": (0.65, 0.6814, 0.9, 0.3125, 0.6572, 0.5766, 0.7753)}
    assert one(scoring.recommendation(card)) == Row(start_with="small", scale_to="large")


def test_audit(spark):
    df = spark.createDataFrame([("a", [1.0, NAN]), ("b", [INF]), ("a", None)], "label string, rho array<double>")
    got = {r.id: (r.severity, r.detail) for r in audit.issues(df, "label", ("a", "b", "cascade", "maintenance"), ("cascade", "maintenance"), {"rho": 2}).collect()}
    assert got == {"missing_labels": ("medium", "cascade,maintenance"), "shape_rho": ("high", "rho: 1"), "nan_rho": ("high", "rho: 1"), "inf_rho": ("high", "rho: 1")}
    only = audit.issues(df.where("label = 'z'"), "label", ("a",), (), {"rho": 2}).collect()
    assert "empty" in {r.id for r in only}
    page = writers.render_report({"rows": 3}, audit.issues(df, "label", ("a", "b"), (), {"rho": 2}).collect(), "A <b>")
    assert "A &lt;b&gt;" in page and "nan" not in page.lower().split("<ul>")[0]


def test_shield(spark):
    rs = [
        {"rule_id": "R_011", "entity": "line", "condition": "rho > 1.0", "explanation": "R_011"},
        {"rule_id": "R_019", "entity": "line", "condition": "(rho >= 0.9 AND pair >= 0.9) OR rho > 2", "explanation": "R_019"},
    ]
    df = spark.createDataFrame([(1, "Line", 0.4, 0.1), (2, "line", 1.15, 0.1), (3, "LINE", 1.2, 0.95), (4, "bus", 9.0, 9.0), (5, None, 9.0, 9.0)], "k int, entity string, rho double, pair double")
    got = {r.k: (r.decision, r.explanation) for r in shield.shield(df, rs, "k", ("rho", "pair")).collect()}
    assert got == {1: ("PASS", ""), 2: ("BLOCK", "R_011"), 3: ("BLOCK", "R_011 | R_019"), 4: ("PASS", ""), 5: ("PASS", "")}
    for bad in ("rho > 1; drop", "secret > 1", "rho >", "(rho > 1", "rho > 1 rho"):
        with pytest.raises(ValueError):
            shield.condition(bad, {"rho": F.col("rho")})


def test_conditions_as_clauses():
    got = shield.clauses("(a > 1 OR b <= 2.5) AND 3 != a", ("a", "b"))
    assert got == [[("a", None, ">", None, 1.0), (None, 3.0, "!=", "a", None)], [("b", None, "<=", None, 2.5), (None, 3.0, "!=", "a", None)]]
    with pytest.raises(ValueError):
        shield.clauses("c > 1", ("a", "b"))


def test_many_rules_in_one_plan(spark):
    rs = [{"rule_id": f"R_{k:05}", "entity": "line" if k % 2 else "bus", "condition": f"rho > {k} AND rho < {k + 2}", "explanation": f"R_{k:05}"} for k in range(3000)]
    df = spark.createDataFrame([(1, "line", 1001.5), (2, "bus", 0.5), (3, "load", 5.0), (4, "line", None)], "k int, entity string, rho double")
    got = {r.k: r.explanation for r in shield.shield(df, rs, "k", ("rho",)).collect()}
    assert got == {1: "R_01001", 2: "R_00000", 3: "", 4: ""}


def test_ordinals_of_equal_keys_beside_clashing_names(spark):
    rows = [(k % 3, k, k, "x") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, part int, At int, tie string").repartition(7)
    got = splits.with_ordinal(df, "k").collect()
    assert sorted(r.ordinal for r in got) == list(range(300)) and all(r.ordinal // 100 == r.k for r in got)
    assert sorted((r.k, r.part, r.At, r.tie) for r in got) == sorted(rows)
    empty = df.where("k = 9")
    assert splits.with_ordinal(empty, "k").count() == 0
    edges = features.both_directions(spark.createDataFrame([(1, 2, 5)], "src int, dst int, `end` int")).collect()
    assert sorted((r.src, r.dst, r["end"], r.reversed) for r in edges) == [(1, 2, 5, False), (2, 1, 5, True)]


def test_shuffled_keeps_every_row(spark):
    df = spark.range(500).withColumnRenamed("id", "key")
    one_, two = ([r.key for r in splits.shuffled(df, "key", seed).orderBy("ordinal").collect()] for seed in (1, 2))
    assert sorted(one_) == sorted(two) == list(range(500)) and one_ != two != sorted(two)
    assert one_ == [r.key for r in splits.shuffled(df.repartition(3), "key", 1).orderBy("ordinal").collect()]


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 50 + [1.0], [float(k * k % 97) / 7 for k in range(500)], [1e300, -1e300, 3.0, 1e-300], []])
def test_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = stats.quantiles(df, "x", (0.0, 0.5, 0.95, 0.99, 1.0), cells=4)
    assert got == [None] * 5 if not values else np.allclose(got, np.quantile(values, (0.0, 0.5, 0.95, 0.99, 1.0)), rtol=1e-12)


def test_quantiles_end(spark):
    """Values of all sizes take six passes at most."""
    import random
    import struct

    class Counted:
        def __init__(self, df):
            self.df, self.passes = df, 0

        def select(self, *columns):
            self.passes += 1
            return self.df.select(*columns)

    rng = random.Random(4)
    doubles = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    for values in (
        [-1.7e308, 0.0, 1.7e308],
        [5e-324, 1e-323, -5e-324, 0.0, -0.0, 2.2e-308, 1.5e-323],
        [7.25] * 1000,
        [1.0 + k * 2.0**-52 for k in range(5)] + [1.9],
        [x for x in doubles if x - x == 0],
        [-1.7e308] * 3 + [1.7e308] * 3 + [None] * 2,
    ):
        df = Counted(spark.createDataFrame([(v,) for v in values], "x double"))
        kept = sorted(v for v in values if v is not None)
        shares = [k / (len(kept) - 1) for k in {0, len(kept) // 3, len(kept) // 2, len(kept) - 1}]
        got = stats.quantiles(df, "x", shares)
        assert df.passes <= 6
        for share, v in zip(shares, got, strict=True):
            assert v == pytest.approx(kept[round(share * (len(kept) - 1))], rel=1e-9)
    half = stats.quantiles(spark.createDataFrame([(-1.7e308,), (1.7e308,)], "x double"), "x", (0.25, 0.5))
    assert half == [pytest.approx(-0.85e308), 0.0]


def test_validator_calls(spark):
    given = [rule(rule_id=f"R_{k}") for k in range(6)]
    rows = [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)]
    names = ", ".join(f"{f} string" for f in schemas.RULE_FIELDS)
    df = spark.createDataFrame([(c, *[given[k][f] for f in schemas.RULE_FIELDS]) for c, k in rows], f"chunk string, {names}")
    checked_rules = rules.check_rules(df).select("chunk", "rule")
    prompts = spark.createDataFrame([("a", "text a"), ("b", "text b"), ("c", "no rules")], "chunk string, text string")

    def complete(prompt):
        if "text b" in prompt:
            raise TimeoutError("late")
        verdicts = [{"rule_id": "R_0", "verdict": "confirm"}, {"rule_id": "R_1", "verdict": "CORRECT", "corrected_fields": {"severity": "LOW"}}, {"rule_id": "R_2", "verdict": "REJECT"}, {"rule_id": 3, "verdict": "CONFIRM"}, "junk"]
        return f"<think>{prompt.count('R_')}</think>{json.dumps(verdicts)}"

    got = {r.final_rule.rule_id: r for r in rules.validate(checked_rules, prompts, "chunk", "text", "{chunk}: {rules}", complete).collect()}
    assert {k: (r.outcome, r.reason) for k, r in got.items()} == {
        "R_0": ("confirmed", None), "R_1": ("corrected", None), "R_2": ("rejected", None), "R_3": ("flagged", "NO_VERDICT"), "R_4": ("flagged", "VALIDATOR_FAIL"), "R_5": ("flagged", "VALIDATOR_FAIL")
    }
    assert got["R_1"].final_rule.severity == "low" and got["R_4"].validate_ms == 0 <= got["R_0"].validate_ms
    skipped = rules.validate(checked_rules, prompts, "chunk", "text", "{chunk}", None).collect()
    assert len(skipped) == 6 and {(r.outcome, r.reason) for r in skipped} == {("confirmed", None)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    got = {r.label: (r.precision, r.recall, round(r.f1, 6), r.support) for r in metrics.per_class(df, "t", "p").collect()}
    assert got == {0: (1.0, 0.5, 0.666667, 2), 1: (1 / 3, 1.0, 0.5, 1), 2: (0.0, 0.0, 0.0, 1)}
    assert round(one(metrics.macro_f1(df, "t", "p")).macro_f1, 6) == 0.388889


def test_attention_of_equal_neighbours(spark):
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "node int, x array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    got = attention.attention_layer(nodes, edges, [[1.0, 0.0], [0.0, 1.0]], [0.5, 0.1], [0.2, 0.2]).collect()
    assert all(abs(a - b) < 1e-12 for r in got for a, b in zip(r.x, [1.0, 2.0], strict=True))


def test_sources(spark, tmp_path):
    good = {"rho": [0.5, 1.0], "line_status": [True, False], "label": "normal", "timestep": 3, "chronic_id": 1}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"rho": [NAN]}) + "\n")
    rows = readers.with_sample_id(readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))).collect()
    assert rows[0].line_status == [True, False] and rows[0].sample_id == Row(episode=1, step=3) and math.isnan(rows[1].rho[0])
    (tmp_path / "b.json").write_text(json.dumps([good, good]))
    assert readers.read_json_array(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.jsonl").write_text(json.dumps(rule()) + "\n{broken\n" + json.dumps(rule(rule_id="R_2")) + "\n")
    parsed, dropped = readers.read_jsonl_tolerant(spark, str(tmp_path / "c.jsonl"))
    assert parsed.cache().count() == 2 and dropped.cache().count() == 1
    topology = {"line_or_bus": [0, 1], "line_ex_bus": [1, 2], "load_to_sub": [2], "gen_to_sub": [0]}
    (tmp_path / "meta.json").write_text(json.dumps({"env_name": "e", "topology": topology}, indent=2))
    tables = readers.topology_tables(readers.read_metadata(spark, str(tmp_path / "meta.json")))
    assert [(r.element, r.bus) for r in tables["line_ex_bus"].collect()] == [(0, 1), (1, 2)]
    writers.write_split(spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/split=val")).collect()[0].i == 2
    writers.write_jsonl(parsed, str(tmp_path / "rules"))
    assert readers.read_glob(spark, str(tmp_path / "rules"), schemas.RULE).count() == 2


def test_trips_batch_and_stream(spark, tmp_path):
    from gridlens.streaming import trips

    steps = [(1, 0, None, 3, [], False), (1, 1, None, None, [5, 6], False), (1, 2, 5, None, [], True), (1, 3, None, 1, [], False), (2, 0, 9, None, [], False)]
    schema = "episode long, step long, reconnect long, inject long, trips array<long>, done boolean"
    want = {(1, 0): [3], (1, 1): [3, 5, 6], (1, 2): [3, 6], (1, 3): [1], (2, 0): []}
    got = {(r.episode, r.step): r.tripped for r in trips.tripped_sets(spark.createDataFrame(steps, schema)).collect()}
    assert got == want
    for k, part in enumerate((steps[:2], steps[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = trips.tripped_stream(stream).writeStream.format("memory").queryName("trips").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.episode, r.step): r.tripped for r in spark.table("trips").collect()} == want


def test_label_counts_over_a_stream(spark, tmp_path):
    from gridlens.streaming import trips

    rows = [(f"2024-01-01 0{h}:{m:02}:00", "a" if m % 2 else "b") for h in range(3) for m in range(0, 60, 7)]
    spark.createDataFrame(rows, "ts string, kind string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, kind string").json(str(tmp_path / "in"))
    counted = trips.label_counts_stream(stream, "ts", "kind")
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.start)[11:13], r.label): r.n for r in spark.table("counts").collect()}
    assert got == {(f"{h:02}", k): n for h in range(3) for k, n in (("a", 4), ("b", 5))}
