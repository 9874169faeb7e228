import hashlib
import random

import pytest
from oracle import check
from pyspark.sql import functions as F

from gridlens.llm import period_runs as P
from gridlens.llm import queries


def plain_runs(words, least=24, times=3):
    """Every stretch of words that agree q apart, for every q; of equal stretches the smallest q."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    out, kinds = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.4:
            out += [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        else:
            out += ([rng.randrange(kinds) for _ in range(rng.randint(1, 12))] * 100)[: rng.randint(1, 100)]
    return [f"w{k}" for k in out]


def test_runs_against_definition():
    rng = random.Random(7)
    met = 0
    for _ in range(150):
        lists = [some_words(rng) for _ in range(rng.randint(1, 8))]
        runs, collapsed = P._batch([" ".join(w).encode() for w in lists], 24, 3)
        for words, got, kept in zip(lists, runs, collapsed, strict=True):
            want = plain_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert kept.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
            met += len(want)
    assert met > 500


def test_grammar_gives_back_the_text():
    rng = random.Random(3)
    lists = [some_words(rng) for _ in range(20)]
    names = {}
    symbols = P.np.array([names.setdefault((k, w), len(names)) for k, words in enumerate(lists) for w in words])
    text = P.np.repeat(P.np.arange(len(lists)), [len(x) for x in lists])
    name, place, left, size = P.repair(symbols, text, len(names))
    # every place of a nonterminal has the same words, and no text's tree reaches into another
    said = {}
    for x, at in zip(name.tolist(), place.tolist(), strict=True):
        words = tuple(symbols[at : at + size[x]])
        assert said.setdefault(x, words) == words and 0 < left[x] < size[x] and text[at] == text[at + size[x] - 1]
    whole = {(int(at), int(size[x])) for x, at in zip(name.tolist(), place.tolist(), strict=True)}
    at = 0
    for words in lists:
        assert len(words) < 2 or (at, len(words)) in whole
        at += len(words)


def test_long_periods_and_equal_words():
    rng = random.Random(1)
    block = [str(rng.randrange(5000)) for _ in range(9000)]
    texts = [" ".join(["a"] * 30_000), " ".join(["x", *block * 3, "y"]), "b " * 23, "b " * 24]
    runs, collapsed = P._batch([t.encode() for t in texts], 24, 3)
    assert runs == [[{"start": 0, "length": 30_000, "period": 1}], [{"start": 1, "length": 27_000, "period": 9000}], [], [{"start": 0, "length": 24, "period": 1}]]
    assert collapsed == [b"a", " ".join(["x", *block, "y"]).encode(), b" ".join([b"b"] * 23), b"b"]
    with pytest.raises(ValueError):
        P.find_runs(None, times=2)


def test_runs_of_documents(spark, data):
    check(queries.QUERIES["op12_period_runs"](spark, data), queries.ORACLE_SQL["op12_period_runs"], data)


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    more = odd_docs.limit(1).withColumn("text", F.repeat(F.lit("uno dos\x0btres\n"), 9)).withColumn("doc_id", F.lit(None).cast("long"))
    got = P.find_runs(odd_docs.withColumn("runs", F.lit(1)).unionByName(more.withColumn("runs", F.lit(2))))
    assert set(odd_docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == odd_docs.count() + 1
    for r in rows:
        words = [w for w in (r.text or "").replace("\x0b", " ").split(" ") for w in w.split()]
        want = plain_runs(words) if len(words) < 100 else []
        assert [(x.start, x.length, x.period) for x in r.runs] == want
    looped = [r for r in rows if r.runs]
    assert len(looped) == 1 and looped[0].collapsed == "uno dos tres"
    assert P.find_runs(no_docs).count() == 0


def test_planted_loops(spark):
    import zlib

    rows = [(k, " ".join(f"w{(i * i + k) % 97}" for i in range(60 + k % 50))) for k in range(200)] + [(None, "a b"), (5, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", P.looped(F.col("doc_id"), F.col("text")).alias("out")).collect()
    changed = 0
    for r in got:
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        words = (r.text or "").split()
        if h % 10 or not words:
            assert r.out == r.text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.out == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        changed += 1
    assert changed > 10
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
