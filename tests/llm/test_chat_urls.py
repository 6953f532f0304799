import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, queries, urlfilter

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", None, "\\", "\\\\", "<|", "<\\|", "<\\\\|", "<|turn|>", "<|end|><|turn|>assistant<|text|>", "</s>[INST] ok [/INST]", "[\\INST]", "<", "|end|>", "a\nb", "\U0001f600é", "<<|s>", "<s", "s></s>\\"]


def chats():
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool<|end|>", None]), r.choice(HARD) if r.random() < 0.6 else f"word {r.random()}") for c in range(40) for t in range(r.randrange(1, 7))]
    rows += [(50, 0, "assistant", "same")] * 2 + [(50, None, "user", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "x")]
    rows += [(60, i, "assistant" if i % 2 else "user", "t" * 50) for i in range(120)]
    return rows


def by_conv(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(x) for c, x in out.items()}


def escaped(text):
    text = text.replace("\\", "\\\\")
    for c in chat.CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def test_escape_round_trip(spark):
    r = random.Random(1)
    texts = [*(t for t in HARD if t), *("".join(r.choice(["\\", "<", "|", "s>", "/s>", "[", "INST]", "/INST]", "x"]) for _ in range(8)) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in chat.CONTROL)


def test_examples(spark):
    rows = chats()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("example", F.lit("clash")).withColumn("n_turns", F.lit("clash"))
    got = {}
    for e in chat.format_chats(df).collect():
        got.setdefault(e.conv_id, []).append(e)
    want = by_conv(rows)
    assert got.keys() == want.keys()
    for c, examples in got.items():
        targets = [i for i, t in enumerate(want[c]) if t[2] == "assistant"]
        ends = sorted({*targets, len(want[c]) - 1})
        assert len(examples) == len(ends)
        for e, end in zip(sorted(examples, key=lambda e: e.example), ends, strict=True):
            assert e.text.count(chat.TURN) == end + 1  # all turns before it, no other
            if end in targets:
                masked = e.text[e.loss_start : e.loss_start + e.loss_length]
                assert e.text[e.loss_start + e.loss_length :] == chat.END
                assert masked == escaped(want[c][end][3])
            else:
                assert e.loss_start is None and e.loss_length is None


def test_digest(spark):
    rows = chats()
    found = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = by_conv(rows)
    assert found.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), sha(loss))


def table(rows, names):
    return pa.table({n: pa.array([r[i] for r in rows], pa.string() if i > 1 or n == "url" else pa.int64()) for i, n in enumerate(names)})


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()) == sorted(repr(tuple(r)) for r in df.collect())


def test_chat_sql(spark):
    rows = chats()
    same(chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))), chat.oracle(), conversations=table(rows, ["conv_id", "turn", "role", "text"]))


def test_chat_empty_and_native(spark):
    df = chat.digest(chat.format_chats(spark.createDataFrame([], SCHEMA)))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


PAGES = [
    (0, "http://a.example.org/es/1", "<html>"),
    (1, "HTTP://A.EXAMPLE.ORG/es/1?x#y", ""),
    (2, "https://example.org/en/12", None),
    (3, "https://xexample.org/en/12", ""),
    (4, "http://b.com/de/1", ""),
    (5, "http://b.com/fr/1", ""),
    (6, "http://b.com", ""),
    (7, None, "<link rel=canonical href=/x>"),
    (8, "no scheme/fr/", '<link rel="canonical" href="http://b.com/de/9">'),
    (9, "http://c.net/1", '<head><LINK href="http://b.com/de/1" REL="canonical"></head>'),
    (10, "http://c.net/2#frag", '<meta http-equiv="refresh" content="0; url=/1">'),
    (11, "http://c.net/2", ""),
    (12, "http://d.net/1", '<link rel="stylesheet" href="/s.css"><link rel="canonical" href="//e.net/1?a=1&amp;b=2">'),
    (13, "http://e.net/1?a=1&b=2", '<meta http-equiv=refresh content="5;URL=http://b.com/fr/2">'),
    (14, "http://f.net/1", '<link rel="canonical" href="http://b.com/de/1"><meta http-equiv="Refresh" content="1; url=http://b.com/fr/7">'),
    (15, "http://b.com/de/8", '<link rel="canonical" href="http://b.com/fr/8">'),
    (16, "http://g.net/", '<link rel="canonical" href="http://g.net/">'),
    (16, "http://g.net/", '<link rel="canonical" href="http://g.net/">'),
    (None, "http://u@c.net:80/1", ""),
    (20, "http://H.net/a/b/c?q#f", '<link rel="canonical" href="../x">'),
    (21, "HTTP://h.NET/a/x", ""),
    (22, "http://h.net/a/./y/../x#z", '<link rel=canonical href="http://B.com/de/./5">'),
    (23, "http://i.net/p/q?old", '<link rel="canonical" href="?new">'),
    (24, "http://i.net/p/q?new", '<meta http-equiv="refresh" content="0; url=r.html#top">'),
    (25, "http://i.net/p/r.html", '<link rel="canonical" href="http://b.com/fr/1">'),
    (26, "http://j.net", '<link rel="canonical" href="go?to=http://b.com/de/1">'),
    (27, "http://j.net/go?to=http://b.com/de/1", '<link rel="canonical" href="mailto:a@b.com"><link rel="canonical" href="http://b.com/de/3/..">'),
    (28, "http://j.net/", ""),
    (17, "http:///fr/", ""),
    (18, "http://com/fr/", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as rule", "'z' as alias", "'r' as root", "'v' as v")


def test_urls(pages):
    rows = urlfilter.judge_urls(pages).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][3] == "block" and got[5][3] == "allow"
    assert got[6] == ("b.com", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("", "", None, "block")
    assert [got[i][3] for i in (9, 10, 11)] == ["allow"] * 3  # an alias is allowed through page 14
    assert got[12][3] == got[13][3] == "allow"
    assert got[15][2:] == ("com/de/", "block")  # its own rule decides
    assert [got[i][3] for i in (20, 21, 22)] == ["block"] * 3  # relative, dot segments, case of the host
    assert [got[i][3] for i in (23, 24, 25)] == ["allow"] * 3
    assert [got[i][3] for i in (26, 27, 28)] == ["block"] * 3
    assert got[22][:2] == ("h.net", "/a/./y/../x")  # host and path stay as the URL has them
    assert got[None][0] == "u@c.net:80" and got[17][:2] == ("", "/fr/") and got[18][2] == "com/fr/"


def test_blocks_reach_aliases(pages):
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages.where("page_id <> 14")).collect()}
    assert [got[i] for i in (9, 10, 11)] == ["block"] * 3
    more = pages.sparkSession.createDataFrame([("http://c.net/1", "http://b.com/fr/5")], "a string, b string")
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages.where("page_id <> 14"), redirects=more).collect()}
    assert [got[i] for i in (9, 10, 11)] == ["allow"] * 3


def test_url_sql(pages):
    t = table([(p[0], None, p[1], p[2]) for p in PAGES], ["page_id", "x", "url", "html"]).drop(["x"])
    same(urlfilter.judge_urls(pages), urlfilter.oracle(), pages=t)
    cut = [p for p in PAGES if p[0] != 14]
    t = table([(p[0], None, p[1], p[2]) for p in cut], ["page_id", "x", "url", "html"]).drop(["x"])
    same(urlfilter.judge_urls(pages.where("page_id is null or page_id <> 14")), urlfilter.oracle(), pages=t)


def test_url_edge_cases(pages):
    assert urlfilter.judge_urls(pages.where("false")).count() == 0
    with pytest.raises(ValueError):
        urlfilter.parse_rule("deny", "x/")
    plan = urlfilter.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def fitting(host, path, rules):
    fits = [(len(r.host + r.path), -i, r) for i, r in enumerate(rules) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[2] if fits else None


def test_many_rules(spark, pages):
    """A hundred thousand rules are joined; a plain search over them says the same."""
    r = random.Random(2)
    label, part = lambda: r.choice("abcdefg"), lambda: "/" + "/".join(r.choice(["x", "xy", "z", ""]) for _ in range(r.randrange(4)))
    host = lambda n: ".".join(label() for _ in range(n))
    some = [urlfilter.Rule(r.choice(["allow", "block"]), host(r.randrange(1, 4)), part()) for _ in range(600)]
    rules = tuple(some) + tuple(urlfilter.Rule("block", f"h{i % 300}.net", f"/{i}") for i in range(100_000))
    urls = [f"http://{host(r.randrange(1, 6))}{part()}?q" for _ in range(300)] + [f"http://w.h{i}.net/{i}7" for i in range(0, 300, 3)] + ["http://h5.net./5", None, "none", "http://h7.net/7"] + ["http://same.net/"] * 200
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("<p>"))
    by_host = {}
    for i, x in enumerate(rules):
        by_host.setdefault(x.host, []).append((i, x))
    got = urlfilter.judge_urls(df, rules=rules).collect()
    assert len(got) == len(urls)
    for g in got:
        own = sorted(x for h in {g.host[i:] for i in range(len(g.host)) if i == 0 or g.host[i - 1] == "."} for x in by_host.get(h, []))
        rule = fitting(g.host, g.path, [x for _, x in own])
        assert (g.rule, g.verdict) == ((rule.text, rule.verdict) if rule else (None, "allow"))
    few = urlfilter.judge_urls(pages).collect()
    table_of = spark.createDataFrame([(x.verdict, x.host, x.path, i) for i, x in enumerate(urlfilter.RULES)], "verdict string, host string, path string, i long")
    assert sorted(map(str, few)) == sorted(map(str, urlfilter.judge_urls(pages, rules=table_of).collect()))


def test_rows_without_alias_are_spread(spark):
    df = spark.range(2000).selectExpr("id as page_id", "'http://x.org/1' as url", "'' as html")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = urlfilter.judge_urls(df)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and max(s["count"] for s in sizes) < 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_long_conversation(spark):
    """Prefixes are built one by one: 500 turns of 3000 characters, of which each reply has all before it."""
    df = spark.range(500).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 1, 'assistant', 'user') as role", "repeat('wo<|rd ', 500) as text")
    found = chat.digest(chat.format_chats(df)).collect()
    assert len(found) == 1 and found[0].n_turns == 500 and found[0].loss_chars == 250 * 3500


def test_registered_sql_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
