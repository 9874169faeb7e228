import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridlens.operators import collate, knowledge, shield
from gridlens.sources import lines


def test_closure_of_cycles_and_long_paths(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)} | {(k, k + 1) for k in range(100, 112)} | {(112, 100), (7, 7)}
    edges = spark.createDataFrame([("x", str(a), str(b)) for a, b in pairs] + [("y", "100", "0")], "kind string, source string, target string")
    starts = spark.createDataFrame([(str(k),) for k in (0, 7, 100, 106, 999)], "node string")

    def plain(start, pairs):
        met, front, k = {start: 0}, [start], 0
        while front:
            k += 1
            front = sorted({b for a, b in pairs if a in front} - set(met))
            met |= dict.fromkeys(front, k)
        return met

    got = {}
    for r in knowledge.closure(starts, edges, ["x"]).collect():
        assert (r.start, r.node) not in got
        got[r.start, r.node] = r.hops
    assert got == {(str(s), str(n)): h for s in (0, 7, 100, 106, 999) for n, h in plain(s, pairs).items()}
    both = knowledge.closure(starts.where("node = '100'"), edges)
    assert both.where("node = '0'").first().hops == 1
    assert knowledge.closure(starts.where("node = 'none'"), edges).count() == 0


def test_closure_of_many_starts_in_few_rows(spark, monkeypatch):
    """A row holds up to 64 starts, and edges into nodes that all have reached are left out: most nodes here, but for a part out of reach."""
    rng = random.Random(4)
    pairs = [(str(rng.randrange(300)), str(rng.randrange(300))) for _ in range(1500)] + [(str(k), str((k + 1) % 300)) for k in range(300)] + [(f"far{k}", f"far{k + 1}") for k in range(20)]
    edges = spark.createDataFrame([("x", a, b) for a, b in pairs] * 2, "kind string, source string, target string")
    starts = spark.createDataFrame([(str(k),) for k in range(130)], "node string")
    labels = []
    monkeypatch.setattr(knowledge, "written", lambda df, label, old=knowledge.written: labels.append(label) or old(df, label))
    numbered, sets = knowledge.reached(starts, edges)
    assert labels.count("graph-steps") > 1
    beyond = {}
    for a, b in pairs:
        beyond.setdefault(a, set()).add(b)
    want = {}
    for s in [r.node for r in starts.collect()]:
        front, k = {s}, 0
        while front:
            want |= {(s, b): k for b in front}
            k += 1
            front = {b for a in front for b in beyond.get(a, ()) if (s, b) not in want}
    got = {(r.start, r.node): r.hops for r in knowledge.by_start(sets, numbered).select("start", "node", "hops").collect()}
    assert got == want
    rows = {(r.node, r.block, r.hops) for r in sets.collect()}
    assert len(rows) == sets.count() < len(want) / 10
    assert numbered.agg(F.max("block"), F.max("bit")).first() == (2, 63)


def test_kinds_and_dangling_edges(spark):
    keys = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "key long, label string")
    ends = spark.createDataFrame([(1, 2), (1, 2), (1, 9), (None, 1)], "source long, target long")
    nodes = knowledge.nodes({"Bus": keys, "Line": keys})
    assert sorted((r.kind, r.node, r.attributes["label"]) for r in nodes.collect()) == [("Bus", "Bus_1", "a"), ("Bus", "Bus_2", None), ("Line", "Line_1", "a"), ("Line", "Line_2", None)]
    edges = knowledge.edges([("connected_to", "Bus", "Line", ends)])
    assert sorted(r.target for r in edges.collect()) == ["Line_2", "Line_9"]
    assert [r.target for r in knowledge.dangling(edges, nodes).collect()] == ["Line_9"]
    with pytest.raises(ValueError):
        knowledge.nodes({"Tower": keys})
    for wrong in (("feeds", "Bus", "Line", ends), ("near", "Bus", "Line", ends)):
        with pytest.raises(ValueError):
            knowledge.edges([wrong])


def test_chain_from_entity_to_device(spark):
    e = lambda kind, a, b: (kind, a, b)
    rows = [e("has_rule", "Line_1", "Rule_r"), e("triggers", "Rule_r", "ProtectionDevice_d"), e("connected_to", "Line_1", "Bus_3"), e("protected_by", "Bus_3", "ProtectionDevice_d"), e("has_rule", "Bus_3", "Rule_r"), e("triggers", "Rule_r", "ProtectionDevice_q")]
    got = knowledge.chains(spark.createDataFrame(rows, "kind string, source string, target string")).collect()
    assert sorted((r.entity, r.device[-1], r.own, r.near) for r in got) == [("Bus_3", "d", True, False), ("Bus_3", "q", False, False), ("Line_1", "d", False, True), ("Line_1", "q", False, False)]


def test_collated_graphs(spark, tmp_path):
    rng = random.Random(5)
    sizes = {g: rng.randrange(1, 40) for g in rng.sample(range(10_000), 300)}
    nodes = [(g, k, rng.random(), [float(k), float(g)]) for g, n in sizes.items() for k in range(n)]
    edges = [(g, rng.randrange(n), rng.randrange(n), k) for g, n in sizes.items() for k in range(rng.randrange(0, 2 * n) if n > 1 else 0)]
    n = spark.createDataFrame(nodes, "graph long, place long, x double, features array<double>").repartition(7)
    e = spark.createDataFrame(edges, "graph long, src long, dst long, number long").repartition(5)
    path = f"{tmp_path}/data"
    collate.collate(n, e, "graph", ["place"], ["number"], path, **{"parquet.block.size": "20000", "parquet.page.size": "1000", "parquet.block.size.row.check.min": "10"})
    order = sorted(sizes)
    for ordinal in (0, 17, 299):
        g = order[ordinal]
        a, b = collate.graph_at(spark, path, ordinal)
        assert [tuple(r) for r in a.collect()] == [x[1:] for x in nodes if x[0] == g]
        assert [tuple(r) for r in b.collect()] == [x[1:] for x in edges if x[0] == g]
    for wrong in (-1, 300):
        with pytest.raises(IndexError):
            collate.graph_at(spark, path, wrong)
    a, b = collate.all_graphs(spark, path, "graph")
    assert sorted((r.graph, r.place, r.x) for r in a.collect()) == sorted(x[:3] for x in nodes)
    assert sorted((r.graph, r.src, r.dst, r.number) for r in b.collect()) == sorted(edges)
    # the filter reaches the scan, which leaves out what lies elsewhere
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one, _ = collate.graph_at(spark, path, 150)
        one.collect()
        leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
        assert leaves.size() == 1 and "GreaterThanOrEqual(row" in leaves.apply(0).toString()
        assert sizes[order[150]] <= leaves.apply(0).metrics().apply("numOutputRows").value() < len(nodes) / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_batches(spark):
    rng = random.Random(6)
    sizes = {g: rng.randrange(1, 9) for g in range(1000, 1900, 3)}
    got = collate.batched(spark.createDataFrame(list(sizes.items()), "graph long, n long"), "graph", "n", 5, 64)
    loc = F.col("graph") % 12 - 2
    rows = got.withColumn("target", collate.batch_target(loc, F.col("ptr"), F.col("n"))).orderBy("batch", "place").collect()
    assert sorted(r.graph for r in rows) == sorted(sizes) and [r.graph for r in rows] != sorted(sizes)
    at = 0
    for k, r in enumerate(rows):
        assert (r.batch, r.place) == divmod(k, 64)
        at = 0 if r.place == 0 else at
        assert r.ptr == at
        want = None if r.graph % 12 - 2 < 0 else min(at + r.graph % 12 - 2, at + r.n - 1)
        assert r.target == want
        at += r.n
    edges = spark.createDataFrame([(g, 0, n - 1) for g, n in sizes.items()], "graph long, src long, dst long")
    ptr = {r.graph: r.ptr for r in rows}
    assert all((e.src, e.dst) == (ptr[e.graph], ptr[e.graph] + sizes[e.graph] - 1) for e in collate.batch_edges(edges, got, "graph").collect())


def test_lines_by_number_over_blocks(spark, tmp_path):
    rng = random.Random(7)
    texts = ["" if k % 5 == 0 else f"{k} " + "x" * rng.randrange(60) for k in range(3000)]
    cuts = [0, 0, 1, 900, 1700, 3000]
    for f, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{f}.txt").write_text("".join(t + "\n" for t in texts[a:b]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        index = lines.index_lines(spark, str(tmp_path))
        assert [(r["first"], r.n) for r in index.orderBy("file").collect()] == [(0, 1), (1, 899), (900, 800), (1700, 1300)]
        numbers = [0, 2999, 5, 5, 899, 900, 1699, 1700] + [rng.randrange(3000) for _ in range(40)]
        wanted = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "k long, number long")
        got = {r.k: r.value for r in lines.lookup_lines(spark, index, wanted, step=100).collect()}
        assert got == {k: texts[n] for k, n in enumerate(numbers)}
        few = lines.lookup_lines(spark, index, wanted.where("number = 5"))
        assert "part-2.txt" in "".join(few.inputFiles()) and "part-4.txt" not in "".join(few.inputFiles())
        for lost in (3000, -1):
            with pytest.raises(IndexError):
                lines.lookup_lines(spark, index, spark.createDataFrame([(lost,), (1,)], "number long"))
        assert lines.lookup_lines(spark, index, wanted.where("k < 0")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rules_by_index(spark):
    """The same as without index for rules of all forms, of which few are looked at."""
    rng = random.Random(8)
    forms = ["rho > {a}", "rho >= {a} AND temp < {b}", "{a} > rho", "rho = {a}", "temp <= {b} OR rho > {a}", "rho < temp", "rho != {a}", "{a} <= temp AND (rho > {b} OR rho = {a})", "1 < 2"]
    rules = [{"entity": rng.choice(["Bus", "line"]), "rule_id": f"r{k}", "condition": rng.choice(forms).format(a=rng.randrange(-50, 50), b=rng.randrange(100) / 2), "explanation": f"e{k:04d}"} for k in range(400)]
    rows = [(k, rng.choice(["bus", "LINE", "none"]), rng.choice([float(rng.randrange(-60, 60)), None, float("nan")]), float(rng.randrange(60))) for k in range(150)]
    predictions = spark.createDataFrame(rows, "k long, entity string, rho double, temp double")
    parsed = shield.parsed_rules(spark.createDataFrame([{**r} for r in rules]), ("rho", "temp"))
    want = {r.k: tuple(r) for r in shield.shield(predictions, rules, "k", ("rho", "temp")).collect()}
    got = {r.k: tuple(r)[:4] for r in shield.indexed_shield(predictions, parsed, "k", ("rho", "temp"), cell=8).collect()}
    assert got == want and {v[1] for v in got.values()} == {"BLOCK", "PASS"}


def test_many_rules_of_which_few_are_crossed(spark):
    n = 100_000
    rules = spark.range(n).select(F.lit("bus").alias("entity"), F.col("id").cast("string").alias("rule_id"), F.concat(F.lit("rho > "), (F.col("id") / 10).cast("string"), F.lit(" AND temp < 0")).alias("condition"), F.lit("e").alias("explanation"))
    predictions = spark.createDataFrame([(k, "bus", float(k), -1.0) for k in range(20)], "k long, entity string, rho double, temp double")
    got = {r.k: r for r in shield.indexed_shield(predictions, shield.parsed_rules(rules, ("rho", "temp")), "k", ("rho", "temp")).collect()}
    assert all(r.n_violated == 10 * k and r.looked_at <= 10 * k + 1 for k, r in got.items())


def test_many_rules_on_few_conditions(spark, monkeypatch):
    """Rules of one condition are tried as one, and texts put together in blocks and groups are those of the shield without index."""
    monkeypatch.setattr(shield, "_BLOCK", 3)
    monkeypatch.setattr(shield, "_GROUP", 4)
    rng = random.Random(9)
    forms = ["rho > {a}", "temp <= {a} AND rho >= 2", "{a} = rho OR temp < 1", "rho > temp", "rho != {a}"]
    texts = [f.format(a=a) for f in forms for a in range(4)]
    rules = [{"entity": rng.choice(["Bus", "line"]), "rule_id": f"r{k}", "condition": rng.choice(texts), "explanation": rng.choice([f"e{k}", "é | ", "", None])} for k in range(900)]
    rows = [(k, rng.choice(["bus", "LINE", "none", None]), rng.choice([*map(float, range(6)), None]), float(rng.randrange(6))) for k in range(120)]
    predictions = spark.createDataFrame(rows, "k long, entity string, rho double, temp double")
    parsed = shield.parsed_rules(spark.createDataFrame(rules, "entity string, rule_id string, condition string, explanation string"), ("rho", "temp"))
    want = {r.k: tuple(r) for r in shield.shield(predictions, rules, "k", ("rho", "temp")).collect()}
    got = {r.k: r for r in shield.indexed_shield(predictions, parsed, "k", ("rho", "temp"), cell=8).collect()}
    assert {k: tuple(r)[:4] for k, r in got.items()} == want
    assert max(r.n_violated for r in got.values()) > 100
    # 17 different conditions, of which four have two alternatives
    assert max(r.looked_at for r in got.values()) <= len(set(texts)) + 4
    digests = {r.k: r.explanation for r in shield.indexed_shield(predictions, parsed, "k", ("rho", "temp"), cell=8, digest=True).collect()}
    assert digests == {k: hashlib.md5(w[2].encode()).hexdigest() for k, w in want.items()}
