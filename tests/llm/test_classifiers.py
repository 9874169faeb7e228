import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.llm import quality as Q
from gridlens.llm import queries
from gridlens.llm import toxicity as X


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_maximal_segments_by_definition(values):
    """Recursively: the best segment, then what lies before it and after it."""
    x = np.array(values, dtype=float)

    def plain(lo, hi):
        best = max(((x[i:j].sum(), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, n = -best[2], -best[1]
        return plain(lo, i) + [(i, i + n, best[0])] + plain(i + n, hi)

    got = X.maximal_segments(x)
    want = plain(0, len(x))
    assert sorted(round(s[2], 6) for s in got) == sorted(round(s[2], 6) for s in want)
    assert all(abs(x[a:b].sum() - v) < 1e-9 for a, b, v in got)
    assert all(p[1] <= n[0] for p, n in zip(got, got[1:], strict=False))


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.85
    assert got.score.between(0, 1).all()


@pytest.fixture()
def labelled(spark):
    rows = [(k, ("you utter idiot fool " if k % 5 == 0 else "a calm and plain remark ") + f"number w{k % 7} here today", k % 5 == 0) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, label int")


def test_passages_and_odd_rows(spark, labelled, odd_docs, no_docs):
    m = X.learn(*labelled)
    text = "nothing here but calm words " * 30 + "you utter idiot fool and then calm words again " + "plain remark " * 30
    got = X.score(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), m).collect()[0]
    assert got.toxic_score > 0.7 and any("idiot" in p.text for p in got.toxic_passages) and sum(len(p.text) for p in got.toxic_passages) < 100
    out = X.score(odd_docs, m).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.toxic_score < 0.7 for r in out)
    assert X.score(no_docs, m).count() == 0


def test_repeated_passages_and_words(spark, labelled):
    m = X.learn(*labelled)
    calm, passage = "nothing here but calm words and plain remark " * 12, "you utter idiot fool "
    texts = {
        1: calm + passage + calm + passage + calm,
        2: "".join(f"{w} {calm}" for w in passage.split()) + passage + calm,
        3: calm + passage + calm,
        4: "idiot fool " * 6,
        5: calm * 4,
    }
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), m).collect()}
    found = {k: sum("idiot" in p.text and "fool" in p.text for p in r.toxic_passages) for k, r in got.items()}
    assert found == {1: 2, 2: 1, 3: 1, 4: 1, 5: 0}
    assert all(got[k].toxic_score > 0.7 for k in (1, 2, 3, 4)) and got[5].toxic_score < 0.7


def test_labels_of_one_class(spark, labelled, odd_docs):
    docs, labels = labelled
    for part in (labels.where("label = 0"), labels.where("doc_id = -1")):
        scores = {round(r.toxic_score, 9) for r in X.score(odd_docs, X.learn(docs, part)).collect()}
        assert len(scores) == 1


def plain_segments(x):
    """The best segment, then what lies before it and after it."""
    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        best, total, start = (0.0, 0, 0), 0.0, lo
        for i in range(lo, hi):
            if total <= 0:
                total, start = 0.0, i
            total += x[i]
            if total > best[0]:
                best = (total, start, i + 1)
        if best[0] > 0:
            out.append(best[0])
            todo += [(lo, best[1]), (best[2], hi)]
    return out


def plain_toxicity(docs, labels):
    """The score of every text, token by token with dicts; only the fits of the two curves are the operator's."""
    import math
    import re

    def tokens(text):
        return [w for w in re.split(b"[" + re.escape(bytes(np.flatnonzero(X.SEPS).tolist())) + b"]+", (text or "").encode().lower()) if w]

    cut = [*X.ROOTS, 10**9]
    sample = [(t, labels[i]) for i, t in docs if i in labels]
    known = [{} for _ in cut]
    for text, y in sample:
        for k, n in enumerate(cut):
            for key in {w[:n] for w in tokens(text)}:
                known[k].setdefault(key, [0, 0])[1 - y] += 1
    pos = sum(y for _, y in sample)
    base = (pos + 0.5) / (len(sample) + 1)

    def segments(text, y=None):
        last, x = {}, []
        words = tokens(text)
        for at, w in enumerate(words):
            share = base
            for k, n in enumerate(cut):
                toxic, clean = known[k].get(w[:n], (0, 0))
                if y is not None:
                    toxic, clean = toxic - (y == 1), clean - (y == 0)
                share = (toxic + 4 * share) / (toxic + clean + 4)
            v = math.log(share / (1 - share)) - math.log(base / (1 - base)) - 2
            if v > 0:
                if at - last.get(w, -(10**9)) <= X.NEAR:
                    v *= X.REPEAT
                last[w] = at
            x.append(v)
        return len(words), plain_segments(x)

    seen = [(y, *segments(t, y)) for t, y in sample]
    scale, size = X._gumbel(np.array([max(s, default=0.0) for y, _, s in seen if y == 0]), np.array([n for y, n, _ in seen if y == 0]))

    def summed(n, found):
        e = [scale * s - math.log(size * max(n, 1)) for s in [*found, 0.0]]
        return sum(v for v in e if v > 0) or max(e)

    slope, offset = X._logistic(np.array([min(summed(n, s), 40) for _, n, s in seen]), np.array([y for y, _, _ in seen]))
    return {i: 1 / (1 + math.exp(-min(max(slope * min(summed(*segments(t)), 40) + offset, -30), 30))) for i, t in docs}


def test_toxicity_against_a_plain_version(spark):
    import zlib

    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    want = plain_toxicity(docs, labels)
    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, folder).collect()}
    assert set(got) == set(want) and max(abs(got[i].score - w) for i, w in want.items()) < 1e-6
    assert all(got[i].predicted == (got[i].score >= 0.7) for i in want)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(300).select("id", X.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.2
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    right = rng.random((len(truth), 5)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = Q.fit_labels(patterns, counts.astype(float))
    assert abs(m.poor - 0.2) < 0.02
    assert np.abs(m.given_poor[:, 2] - accuracy).max() < 0.05
    assert ((m.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_quality_on_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op10_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good = got[got.quality == 1]
    assert (good.predicted == 1).mean() > 0.99 and (got[got.quality == 0].predicted == 0).mean() > 0.95


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    m = Q.learn(odd_docs)
    out = Q.score(odd_docs, m).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.poor_score <= 1 for r in out)
    assert len({r.poor_score for r in out if not (r.text or "").strip()}) == 1
    assert Q.score(no_docs, Q.learn(no_docs)).count() == 0


def mixed(x):
    """The finaliser of a 64-bit hash, in integers."""
    m = (1 << 64) - 1
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 32


def plain_hash(word):
    """The polynomial hash of a word's bytes."""
    base = 0x9E3779B97F4A7C15 | 1
    return mixed(sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(word)) & ((1 << 64) - 1))


def plain_quality(text, weights):
    """The chance of being poor by the learned weights, word by word."""
    import math
    import re

    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return 1 / (1 + math.exp(-weights[-1]))
    n, inside = len(words), b"".join(words)
    kind = {b: chr(Q._CLASS[b]) for b in range(256)}
    marks, letters = bytes(np.flatnonzero(Q._MARK).tolist()), [b for b in inside if kind[b] in "aA"]
    times = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    stats = {
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "symbols": sum(b in marks for b in inside) / len(inside),
        "shouts": inside.count(b"!") / n,
        "capitals": sum(kind[b] == "A" for b in letters) / max(len(letters), 1),
        "bars": inside.count(b"|") / n,
        "variety": len(times) / min(n, math.sqrt(n * 200)),
        "stops": (inside.count(b".") + inside.count(b",")) / n,
        "commonest": max(times.values()) / n,
        "word_length": len(inside) / n,
        "marked": sum(any(b in marks for b in w) for w in words) / n,
        "runs": sum(a == b and kind[a] not in "aA0 " for a, b in zip(raw, raw[1:], strict=False)) / n,
    }
    z = weights[-1]
    for k, (name, (poor, good, _)) in enumerate(Q.VOTES.items()):
        x = stats[name] / (2 * good if name in Q._LOWER_IS_POOR else 4 * poor)
        z += weights[(1 << Q.WORD_BITS) + (1 << Q.SHAPE_BITS) + k * Q._BINS + int(math.sqrt(min(max(x, 0), 0.9999)) * Q._BINS)]
    for w in words:
        shape = re.sub(r"(.)\1+", r"\1", "".join(kind[b] for b in w), flags=re.S).encode()
        z += (weights[plain_hash(w) >> (64 - Q.WORD_BITS)] + weights[(1 << Q.WORD_BITS) + (mixed(plain_hash(shape)) >> (64 - Q.SHAPE_BITS))]) / n
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_quality_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    m = Q.learn(docs)
    for r in Q.score(docs, m).collect():
        assert abs(r.poor_score - plain_quality(r.text, m.weights)) < 1e-9


def test_scores_beside_clashing_names(spark, labelled, odd_docs):
    """A column named as a result is replaced; the stages keep it, and ids aren't rounded on the way."""
    big = 2**60 + 1
    rows = spark.createDataFrame([(big, "a calm text", 0.25, "x"), (None, "a calm text", None, None)], "doc_id long, text string, toxic_score double, poor_score string")
    assert X.score(rows, X.learn(*labelled), passages=False).columns == ["doc_id", "text", "poor_score", "toxic_score"]
    kept = Q.score(rows, Q.learn(rows)).collect()
    assert [r.doc_id for r in kept] == [big, None] and [r.toxic_score for r in kept] == [0.25, None]
    stage = Q.stage(spark, odd_docs, "")
    assert stage.columns == odd_docs.columns and {r.poor_score for r in stage.collect()} == {"poor"}
    folder = "/root/testdata/sf0.001"
    stage = X.stage(spark, odd_docs, folder)
    assert stage.columns == odd_docs.columns and {r.toxic_score for r in stage.collect()} == {0.5}


def test_features_by_plain_counting():
    texts = ["Stop stop stop!! NOW | x*y", "", "a b a b a b", "  ", "Über größe 12"]
    stats, n, words, shapes = Q.features([t.encode() for t in texts])
    at = {name: k for k, name in enumerate(Q.STATS)}
    assert n.tolist() == [6, 0, 6, 0, 3] and len(words) == len(shapes) == 15
    # "Stop stop stop!!": case matters, and the marks make the third another word
    assert stats[0, at["repeats"]] == 0 and stats[2, at["commonest"]] == 0.5
    assert stats[0, at["shouts"]] == 2 / 6 and stats[0, at["bars"]] == 1 / 6 and stats[0, at["marked"]] == 1 / 6
    assert not stats[1].any() and not stats[3].any()


def test_bytes_bound_what_is_learned_from(labelled):
    docs, labels = labelled
    whole, part, none = X.learn(docs, labels), X.learn(docs, labels, most_bytes=2000), X.learn(docs, labels, most_bytes=5)
    n = [sum(int(c.sum()) for _, c in m.tables) for m in (whole, part, none)]
    assert n[0] > 4 * n[1] > 0 and n[2] == 0


def test_calibration_of_classes_that_are_nearly_apart():
    """Toxic texts all at the cap, and of the clean ones a few as well: whole Newton steps ended with slope nought."""
    rng = np.random.default_rng(2)
    for spread in (1.5, 2.0, 2.5, 3.0, 3.5, 4.0):
        for high in (1, 3, 10, 30):
            clean = np.minimum(rng.gumbel(4, spread, 8000), 40)
            clean[:high] = 40
            x, y = np.append(clean, np.full(920, 40.0)), np.append(np.zeros(8000), np.ones(920))
            slope, offset = X._logistic(x, y)
            p = 1 / (1 + np.exp(-(slope * x + offset)))
            assert (p[y == 1] >= X.THRESHOLD).all() and (p[y == 0] >= X.THRESHOLD).mean() < 0.01, (spread, high, slope, offset)
            # no better fit near by
            assert abs(p.mean() - y.mean()) < 1e-4
