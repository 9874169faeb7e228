import numpy as np
from pyspark.sql import functions as F

from gridlens.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v string"


def brute(rows, k=10, every=100):
    """Exact answers over usable (id, vector) rows."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    got = answers(queries.QUERIES["op4_approximate_nearest_neighbours"](spark, folder))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(got, brute(rows)) >= 0.9


def test_few_visits_find_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 8
    rows = [(k, (centres[k % 40] + rng.normal(size=16)).astype(np.float32).tolist(), None, None, "x") for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(ann.search(df, F.col("vec_id") % 100 == 0, visit=0.08, least=100))
    assert recall(got, brute([r[:2] for r in rows])) >= 0.9


def test_copies_ties_and_unusable_rows(spark):
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(k, hot, 1, 0.5, "x") for k in range(0, 900)] + [(1000 + k, [float(k), 0.0, 1.0, -1.0], 1, None, None) for k in range(60)]
    usable = [r[:2] for r in rows]
    inf, nan = float("inf"), float("nan")
    bad = [(2000, None), (2100, [0.0] * 4), (2200, [1.0, nan, 1.0, 1.0]), (2300, [1.0, inf, 1.0, 1.0]), (2400, [1.0, None, 1.0, 1.0]), (2500, [1.0]), (None, hot), (2600, [])]
    df = spark.createDataFrame(rows + [(i, v, 1, 0.5, "x") for i, v in bad] + rows[:3], SCHEMA)
    got = answers(ann.search(df, F.col("vec_id") % 100 == 0, block=64))
    want = brute(usable)
    assert got == want
    assert [v for v, _ in got[100]] == list(range(10)) and [v for v, _ in got[0]] == list(range(1, 11))


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.1, "x"), (1, [0.0, 1.0], 1, 0.1, "x")], SCHEMA)
    q = F.col("vec_id") % 100 == 0
    assert answers(ann.search(df, q)) == {0: [(1, 2**0.5)]}
    assert answers(ann.search(df.where("vec_id = 0"), q)) == {}
    assert ann.search(df.where("vec_id = 7"), q).collect() == []


def test_doubles_keep_their_precision(spark):
    rows = [(k, [1.0 + k * 1e-9, 2.0]) for k in range(30)] + [(1000, [3.0, 4.0, 5.0]), (1001, [3.0, 4.0, 6.0])]
    got = answers(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0))
    assert [v for v, _ in got[0]] == list(range(1, 11)) and all(abs(s - v * 1e-9) < 1e-15 for v, s in got[0])
    assert got[1000] == [(1001, 1.0)]


def test_cells_in_order():
    rng = np.random.default_rng(3)
    d1, d2 = rng.random(7), rng.random(5)
    sizes = {(i, j): 1 for i in range(7) for j in range(5) if (i + j) % 3}
    got = ann.cells_in_order(d1, d2, sizes, 10**9)
    assert got == sorted(sizes, key=lambda c: d1[c[0]] + d2[c[1]])
    assert ann.cells_in_order(d1, d2, sizes, 4) == got[:4]
