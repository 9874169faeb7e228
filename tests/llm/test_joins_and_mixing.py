import random
import zlib

import numpy as np
import pytest

from gridlens.llm import mixing as M
from gridlens.llm import ngram_join as J
from gridlens.llm import queries


def plain_components(rows, width=5):
    """Shingle sets as strings, all pairs compared, smallest reachable id."""
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [out[k], f"ins{rng.randrange(10**6)}"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    passage = [f"pas{k}" for k in range(60)]
    texts = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice((8, 30, 120)))]
        texts += [" ".join(edited(base, rng.randrange(0, 1 + len(base) // 14), rng)) for _ in range(rng.choice((1, 2, 14, 30)))]
    texts += [" ".join(passage + [f"own{k}x{j}" for j in range(rng.randrange(2, 60))]) for k in range(40)]
    texts += ["One two THREE", "one two three", "one two", "", None, " \n", "a b c d e", "A B C D E", "a b c d e f"]
    texts += [texts[0]] * 25
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = J.jaccard_components(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, cls string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_join_of_dealt_buckets_and_bands(spark):
    """Buckets over several tasks, families in bands and blocks: the result is the same."""
    rng = random.Random(8)
    passage = [f"pas{k}" for k in range(60)]
    texts = [" ".join(edited(passage, rng.randrange(0, 9), rng)) for _ in range(150)]
    texts += [" ".join(passage + [f"own{k}x{j}" for j in range(rng.randrange(2, 60))]) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_components(list(enumerate(texts)))
    for options in ({"deal": 4, "block": 8, "small": 2}, {"block": 8, "small": 3, "heavy": 40}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, **options).collect()} == want


def test_join_of_buckets_that_nothing_told(spark):
    """No counts at all, so that buckets of the passage aren't dealt out beforehand: they are worked on in pieces."""
    rng = random.Random(11)
    passage = [f"pas{k}" for k in range(40)]
    texts = [" ".join(edited(passage, rng.randrange(0, 7), rng)) for _ in range(120)] + [" ".join(passage + [f"own{k}x{j}" for j in range(rng.randrange(2, 30))]) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = J.jaccard_components(df, heavy=0, piece=20, small=3, block=16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(list(enumerate(texts)))


def test_ids_beyond_what_a_double_holds(spark):
    rows = [(2**60 + 1, "one two three four five six"), (2**60 + 3, "one two three four five six"), (None, "else")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {2**60 + 1: 2**60 + 1, 2**60 + 3: 2**60 + 1, None: None}


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    got = J.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(1, 6)] == 1 and by[(None, 6)] is None and by[(2, 0)] == 2 and by[(5, 1)] == 5 and by[(3, 0)] == 3
    assert J.jaccard_components(no_docs).count() == 0


def test_join_of_a_copy_behind_a_row_without_id(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(words)), (7, " ".join(words)), (3, " ".join(words[:-1] + ["other"])), (9, "a text of its own here")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in got} == {None: None, 7: 3, 3: 3, 9: 9}


def test_join_against_sql(spark, data):
    from oracle import check

    check(queries.QUERIES["op9_ngram_jaccard_join"](spark, data), queries.ORACLE_SQL["op9_ngram_jaccard_join"], data)


def test_tree_leaves_out_no_partner():
    rng = np.random.default_rng(4)
    t = J.Threshold(3, 4)
    pool = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in rng.integers(3, 200, 60)]
    sets = [np.unique(np.concatenate((p[rng.random(len(p)) > 0.1], rng.integers(0, 2**63, len(p) // 12, dtype=np.uint64)))) for p in pool for _ in range(6)]
    sets = [s for s in sets if len(s)]
    counts = np.stack([J.group_counts(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = J.CountTree(counts, sizes, t)
    for i, s in enumerate(sets):
        near = set(tree.query(counts[i], len(s)).tolist())
        for j, o in enumerate(sets):
            both = len(np.intersect1d(s, o))
            if 4 * both >= 3 * (len(s) + len(o) - both):
                assert j in near
    full = J._vectors(np.array([zlib.compress(bytes([255] + [0] * 511))], dtype=object), np.array([900]))
    assert full[0, 0] == 900


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in J.connected(links).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1001: 1000}


def test_join_stage_keeps_one_of_each(spark, odd_docs):
    kept = J.stage(spark, odd_docs.dropDuplicates(["doc_id"]), "")
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.dropDuplicates(["doc_id"]).count()


def test_stages_keep_columns_of_clashing_names(spark, odd_docs):
    for stage in (J.stage, M.stage):
        kept = stage(spark, odd_docs, "")
        assert kept.columns == odd_docs.columns and {(r["__met"], r["__gone"], r.copies) for r in kept.collect()} == {(1, 2, 3)}


def test_join_stage_decides_for_each_row(spark):
    words = [f"w{k}" for k in range(40)]
    near, text = " ".join(words[:-1] + ["other"]), " ".join(words)
    eighth = "the eighth of these rows is told twice"
    own, else_ = "a clean text of its own that stays", "and one more that nothing else is like"
    rows = [(1, text, 1), (5, near, 2), (5, own, 3), (5, else_, 4), (1, text, 5), (8, eighth, 6), (8, eighth, 6), (None, text, 7), (None, text, 7), (9, "", 8), (9, "", 8)]
    kept = J.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", text), ("5", own), ("5", else_), ("8", eighth), ("None", text), ("None", text), ("9", "")])


def test_mixing_stage_puts_out_the_mix(spark):
    rng = random.Random(3)
    docs = [(k if k % 50 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 150))), f"s{k % 3}", k) for k in range(1500)]
    docs += [(7, "one id on", "s0", -1), (7, "two texts", "s1", -2), (3, "", "s2", -3), (4, None, "s2", -4)] + [docs[10]] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n int")
    targets = {r.source: r.target for r in M.mix(df)[0].collect()}
    out = [tuple(r) for r in M.stage(spark, df, "").collect()]
    assert set(out) <= set(docs)
    words = {k: sum(len(t.split()) for _, t, s, _ in out if s == k) for k in targets}
    assert all(abs(words[k] - targets[k]) <= 64 + 2 * 150 for k in targets)
    assert words["s0"] > 4 * words["s2"] and max(out.count(d) for d in set(docs) - {docs[10]}) in (2, 3)


@pytest.mark.parametrize("sizes", [[10, 0, 1000, 7], [5], [0, 0], [], [100] * 7, [1, 10**6]])
def test_capped_shares(sizes):
    got = M.capped_shares(sizes, [M.WEIGHTS[k % 3] for k in range(len(sizes))], 3)
    assert abs(sum(got) - sum(sizes)) < 1e-6 and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 257):
        key = np.full(n, 12345, dtype=np.uint64)
        got = M.permuted(np.arange(n), np.full(n, n), key)
        assert sorted(got.tolist()) == list(range(n))
        assert n < 10 or got.tolist() != list(range(n))


def mixed(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


def test_mix_of_given_documents(spark, data):
    got = queries.QUERIES["op8_mixing_sources"](spark, data)
    rows = got.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and r.taken <= 3 * r.size
        s = by.setdefault(docs[r.doc_id].source, [r.source_size, r.target, 0, 0])
        s[2], s[3] = s[2] + r.taken, s[3] + r.size
    assert all(abs(t - taken) <= 64 and size == n for size, t, taken, n in by.values())
    assert mixed(got) == mixed(queries.QUERIES["op8_mixing_sources"](spark, data))


def test_taken_words_against_plain_packing(spark, data):
    """Draws, quotas and words packed into blocks once more, in plain loops; only the permutation is the operator's."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{data}/documents.parquet")
    docs, _, _ = M.mix(df, block=16, shard_slots=100)
    per = {}
    for r in df.select("doc_id", "source", "text", F.xxhash64("doc_id").alias("h")).collect():
        if n := len((r.text or "").encode().split()):
            per.setdefault(r.source, []).append((r.h, r.doc_id, n))
    names = sorted(per, key=lambda x: (x is None, x or ""))
    sizes = [sum(n for *_, n in per[k]) for k in names]
    targets = M.capped_shares(sizes, [M.WEIGHTS[k % 3] for k in range(len(names))], 3)
    blocks = [-(-n // 16) for n in sizes]
    quota = [min(3 * b, round(t * b / n)) for t, b, n in zip(targets, blocks, sizes, strict=True)]
    want = {}
    for src, name in enumerate(names):
        uses = [0] * blocks[src]
        for slot in range(quota[src]):
            turn = slot // blocks[src]
            key = M.mix64(np.array([(11 << 48) + (src << 8) + turn], dtype=np.uint64))
            uses[int(M.permuted(np.array([slot % blocks[src]]), np.array([blocks[src]]), key)[0])] += 1
        at = 0
        for _, i, n in sorted(per[name]):
            want[i] = sum(uses[w // 16] for w in range(at, at + n))
            at += n
    got = {r.doc_id: r.taken for r in docs.collect()}
    assert got == {i: want.get(i, 0) for i in got}


def test_mix_takes_whole_slots(spark, odd_docs, no_docs):
    docs, slots, spans = M.mix(odd_docs)
    rows = docs.collect()
    assert len(rows) == odd_docs.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    uses = {}
    for s in slots.collect():
        uses[s.src, s.block, s["pass"]] = uses.get((s.src, s.block, s["pass"]), 0) + 1
    assert set(uses.values()) == {1} and {k[2] for k in uses} <= {0, 1, 2}
    assert sum(r.words for r in spans.collect()) == sum(r.size for r in rows)
    assert M.mix(no_docs)[0].count() == 0


def test_frequent_ends_of_pairs_are_dealt_from_constants(spark):
    from pyspark.sql import functions as F

    from gridlens.llm.common import frequent, spread_join

    pairs = spark.range(1000).select((F.col("id") % 2 * F.col("id")).alias("a"), F.col("id").alias("b")).localCheckpoint()
    side = spark.range(1200).select(F.col("id").alias("a"), (-F.col("id")).alias("x"))
    often = frequent(pairs, ("a", "b"), 1000)
    assert {k: [tuple(r) for r in v.collect()] for k, v in often.items()} == {"a": [(0, 2)]}
    assert spread_join(pairs, side.withColumnRenamed("a", "b"), "b", "a", often).count() == 1000
    met = spread_join(pairs, side, "a", "b", often)
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b, r.x) for r in met.collect()) == sorted((r.a, r.b, -r.a) for r in pairs.collect())


def test_no_pairs_take_no_further_joins(spark, monkeypatch):
    """Texts that share nothing: neither pairs nor links are looked for any more, on plans that would find none."""
    called = []
    for name in ("_confirm", "_tree_pairs", "contract"):
        monkeypatch.setattr(J, name, lambda *a, name=name, f=getattr(J, name), **b: called.append(name) or f(*a, **b))
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(20)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (5, k) for k in range(20)} and not called


def test_each_star_of_a_contraction_is_a_plan_of_few_shuffles(spark, monkeypatch):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1300)] + [tuple(rng.sample(range(2000, 2400), 2)) for _ in range(300)]
    root = {k: k for p in links for k in p}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    plans = []
    write = J.materialize

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(J, "materialize", kept)
    edges = J.contract(spark.createDataFrame([(max(p), min(p)) for p in links], "u long, v long"))
    assert sorted((r.u, r.v) for r in edges.collect()) == sorted((k, find(k)) for k in root if find(k) != k)
    # a join, the smallest neighbours, and repeats taken out; no star within another's plan
    assert len(plans) > 2 and max(p.count("Exchange") for p in plans) <= 3 and not any("Union" in p for p in plans)
