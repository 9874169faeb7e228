import hashlib

from pyspark.sql import functions as F

from gridlens.llm import chat_format as C
from gridlens.llm import queries
from gridlens.llm import url_filter as U

TURNS = "conv_id long, turn long, role string, text string, segments string, valid int"


def test_conversations_against_sql(spark, data):
    from oracle import check

    check(queries.QUERIES["op1_chat_formatting"](spark, data), queries.ORACLE_SQL["op1_chat_formatting"], data)


def test_escapes_and_odd_turns(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<||<|<||n|>", None, "", "a<", "|>b\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t, "s", 1) for k, t in enumerate(nasty)]
    rows += [(2, 0, None, "x", "s", 1), (2, None, "we<|ird\nrole", "y", "s", 1), (None, 0, "user", "z", None, None), (None, 0, "user", "z", None, None)]
    rows += [(3, k, r, str(k), "s", 1) for k, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(4, k, "assistant" if k % 2 else "user", "t", "s", 1) for k in range(500)]
    df = spark.createDataFrame(rows, TURNS)
    out = {r.conv_id: r for r in C.read_back(C.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in out[1].turns_back] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(nasty)]
    assert [(t.role, t.text) for t in out[2].turns_back] == [("we<|ird\nrole", "y"), ("", "x")]
    assert out[None].n_turns == 2 and not out[2].valid and out[2].first_bad_turn == 0
    assert out[3].valid and out[3].first_bad_turn is None and out[4].valid and out[4].n_turns == 500
    assert [s.text for s in out[3].segments if s.loss] == ["2", "4"]
    assert out[1].formatted.count("<|im_start|>") == len(nasty)
    assert C.format_conversations(df.where("turn = -5")).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    tail = rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:end]


def plain_rule(host, path):
    best = None
    for r in U.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


def test_urls_against_plain_version(spark, data):
    got = {r.page_id: r for r in queries.QUERIES["op2_url_filters"](spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        host, path = plain_url(p.url)
        rule = plain_rule(host, path)
        g = got[p.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule and rule.text)
        assert g.verdict == rule.verdict if rule else g.verdict in ("allow", "block")


def test_odd_urls_and_purity(spark):
    urls = [None, "", "nonsense", "http://", "http://COM", "http://Www.Example.com/en/x", "http://notexample.com/en/", "https://a.net/es/1?x=/fr/", "http://x.org?q=://b", "http://x.org#/en/", "http://a/b://c"]
    rows = [(k, u, "p", 1) for k, u in enumerate(urls)] + [(3, "http://", "p", 1), (None, "http://q.org/a", None, None)]
    # one host whose branch /spam/ is poor and whose branch /good/ isn't, both with variable last segments
    rows += [(1000 + k, f"http://mix.org/{'spam' if k % 2 else 'good'}/{k}", "p", 1) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, key int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (0, None)], "key long, bad int")
    got = U.judge(df, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, r)
    for k, u in enumerate(urls):
        assert (by[k].host, by[k].path) == plain_url(u), u
        want = plain_rule(*plain_url(u))
        assert by[k].rule == (want and want.text)
    assert {by[1000 + k].verdict for k in range(0, 200, 2)} == {"allow"} and {by[1000 + k].verdict for k in range(1, 200, 2)} == {"block"}
    assert by[1001].template == "/spam/*"
    assert U.judge(df.where("page_id = -1"), labels).count() == 0


def test_flags_and_roles_read_back_agree(spark, data):
    """The loss mask of the output's segments is the one of the roles that are read back from the string."""
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    for r in C.read_back(C.format_conversations(turns)).select("segments", "formatted", "turns_back").collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.text.replace("<||", "<|") for s in r.segments if s.loss] == [t.text for t in r.turns_back if t.loss]
        assert any(s.loss for s in r.segments) == any(t.role == "assistant" for t in r.turns_back)


def test_digest_is_of_read_back_text(spark, data):
    r = queries.QUERIES["op1_chat_formatting"](spark, data).where(F.col("conv_id") == -1).collect()[0]
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.loss_chars == len(text) and r.n_turns == 2
