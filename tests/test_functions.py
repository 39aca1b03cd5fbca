"""Semantics on handcrafted rows, against plain Python."""

import re
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import conversations, html, payloads, text, urls
from corpusloom.operators import audit, sampling


def column(spark, values, function):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in frame.select("k", function(F.col("v")).alias("x")).orderBy("k").collect()]


def test_white_space_over_the_bmp(spark):
    chars = [chr(c) for c in range(1, 0xFFFF) if not 0xD800 <= c <= 0xDFFF]
    stripped = column(spark, chars, text.strip)
    assert [c for c, s in zip(chars, stripped, strict=True) if s == ""] == [c for c in chars if c.isspace()]


def test_lines(spark):
    cases = ["a\r\nb\x0bc\x1cd\x85e f g\x1fh", " A \n\na\nB b\n b  B\nA", "", "\n \n", "x" * 50]

    def expected(t):
        seen, out = set(), []
        for line in t.splitlines():
            line = re.sub(r"\s+", " ", line).strip()
            if line and line.lower() not in seen:
                seen.add(line.lower())
                out.append(line)
        return out

    assert column(spark, cases, text.clean_lines) == [expected(t) for t in cases]


def test_simplify_cuts_before_stripping(spark):
    cases = ["  a " * 2000, "x" * 3499 + "  y", "　a​ ", "é" * 4000]
    assert column(spark, cases, text.simplify) == [re.sub(r"\s+", " ", t)[:3500].strip() for t in cases]


def test_tokens_break_at_accents(spark):
    assert column(spark, ["Café THE The2 ab abc naïve", ""], text.tokens) == [["caf", "the2", "abc"], []]
    assert column(spark, ["", " a  b c "], text.word_count) == [0, 3]


URLS = ["HTTP://Host.COM:80/a/b//", "https://h/a;p=1?q#f", "https://h", "mailto:a@b", "tel:1", "//h/x/", "/only/path/", "https://h/a;b/c;d", "a b", "https://h/?q", ""]


def test_urls(spark):
    def normal(u):
        p = urlparse(u)
        return f"{p.scheme}://{p.netloc}{p.path.rstrip('/') or '/'}"

    assert column(spark, URLS, urls.normalize) == [normal(u) for u in URLS]
    assert column(spark, URLS, urls.netloc) == [urlparse(u).netloc for u in URLS]
    assert column(spark, ["https://h/", "https://h/A b/C.html/", "https://h/!!/"], urls.slug) == ["home", "a-b-c.html", "page"]
    assert column(spark, ["https://h/x.PDF", "https://h/x.pdf", "https://h/wp-a", "https://h/wp"], urls.skipped) == [False, True, True, False]


def test_salvage(spark):
    cases = ['x ```json\n{"a":1}\n``` y', '{"a":1},{"b":2}', "[1,2]", "none", '```\n[1]\n``` ```json {"z":1}```', '[{"a":1}]']
    assert column(spark, cases, payloads.salvage) == ['{"a":1}', '{"a":1},{"b":2}', "[1,2]", None, "[1]", '{"a":1}']
    valid = column(spark, ['{"a":1}', '{"a":1},{"b":2}', "[1] x", "[1", "5", "", "1]"], lambda c: payloads.strict_json(c).isNotNull())
    assert valid == [True, False, False, False, True, False, False]


def sample(spark, turns, source):
    frame = spark.createDataFrame([(turns, source)], "m array<struct<role:string,content:string>>, s array<string>")
    return frame.select(
        conversations.reject_reason(F.col("m"), F.col("s")).alias("r"), conversations.structural(F.col("m")).alias("st"), conversations.loose(F.col("m")).alias("lo")
    ).first()


@pytest.mark.parametrize(
    ("turns", "reason", "structural", "loose"),
    [
        ([("user", "q"), ("assistant", " alpha beta and so ")], None, True, True),
        ([("user", "q"), ("assistant", "alpha beta so")], "answer length", True, True),
        ([("user", "q"), ("assistant", "alpha beta so " + "w " * 43)], "answer length", True, True),
        ([("user", "q"), ("assistant", "alpha gamma so it")], "not grounded", True, True),
        ([("user", "q"), ("assistant", "I'm NOT sure of alpha beta")], "bad phrase", True, True),
        ([("user", "q"), ("assistant", "alpha beta"), ("user", "x")], "turn count", False, True),
        ([("system", "q"), ("assistant", "alpha beta")], "first role", False, False),
        ([("user", "q"), ("user", "alpha beta")], "alternation", False, True),
        ([("user", " "), ("assistant", "alpha beta")], "invalid message", False, False),
        ([("user", "q"), ("assistant", None)], "invalid message", False, False),
        ([("user", "q")], "turn count", False, False),
        (None, "not a list", False, False),
    ],
)
def test_validators(spark, turns, reason, structural, loose):
    found = sample(spark, turns, ["alpha", "beta"])
    assert (found.r, found.st is not None, found.lo is not None) == (reason, structural, loose)


def test_messages_must_be_strings(spark):
    cases = ['{"messages":[{"role":"user","content":5}]}', '{"messages":[1]}', '{"messages":"x"}', "[1]", '{"messages":[{"role":"user","content":"a","z":1}]}', "{}"]
    found = column(spark, cases, lambda c: payloads.messages(payloads.strict_json(c)))
    assert [None if f is None else [tuple(m) for m in f] for f in found] == [[("user", None)], None, None, None, [("user", "a")], None]


def test_audit_rules(spark):
    cases = ["", "a", "ok", "x" * 181, "ends:", "why? a a a", "According to this article", "a b c a b"]
    got = [[i.issue for i in x] for x in column(spark, cases, audit.issues)]
    assert got == [["too short"], ["too short"], [], ["too long"], ["bad ending"], ["question in answer", "repetition"], ["bad phrase", "bad phrase"], []]


def test_audit_summary_of_nothing(spark):
    rows = spark.createDataFrame([], "question string, answer string, k long")
    assert tuple(audit.summary(audit.audit(rows, ["k"])).first()) == (0, 0, None)


PAGES = [
    ("<html><title> A &amp; B </title><body><nav>n<a href='/n'>n</a></nav><p>x<b>y</b>z</body>", ("A & B", "xyz")),
    ("<main>m</main><article>a</article>", (None, "m")),
    ("<article>a<div class='x nav'>n<p>q</div>b<!-- c --><script>'</p>'</script></article>", (None, "ab")),
    ("plain", (None, "")),
    ("", (None, "")),
    ("<body>a &amp; b<br>c</body>", (None, "a & bc")),
]


@pytest.mark.parametrize(("page", "expected"), PAGES)
def test_html(page, expected):
    title, found, _, _ = html.parse_page(page)
    assert (title, found.replace("\n", "")) == expected


def test_links_and_resolution():
    page = "<body><a href=' /x '>1</a><a>2</a><a href='http://[bad'>3</a></body>"
    assert html.parse_page(page)[2] == [" /x ", "http://[bad"]
    assert html.resolve_one("https://h/a/b", " ../c#d ") == "https://h/c"
    assert html.resolve_one("https://h/a/b", "http://[bad") is None


def test_mix_target_rounds_half_to_even():
    assert [sampling.mix_target(n, 1000) for n in (0, 1, 17, 85)] == [max(1, round(n * 0.15 / 0.85)) for n in (0, 1, 17, 85)]
    assert sampling.mix_target(850, 3) == 3


@settings(max_examples=8, deadline=None)
@given(n=st.integers(0, 60), k=st.integers(0, 70))
def test_exact_sample(spark, n, k):
    rows = spark.range(n)
    assert sampling.sample_exact(rows, "id", k).count() == min(n, k)


def test_split_sizes_and_compat(spark):
    import random

    rows = spark.range(101).withColumnRenamed("id", "k")
    for mode in ("hash", "compat"):
        counts = {r.split: r["count"] for r in sampling.split_exact(rows, "k", mode=mode).groupBy("split").count().collect()}
        assert counts == {"train": 90, "valid": 11}
    got = sorted(r.k for r in sampling.sample_exact(rows, "k", 7, mode="compat").collect())
    assert got == sorted(random.Random(42).sample(range(101), 7))


def test_json_as_python_reads_it(spark):
    cases = ['{"a":1,"a":2}', '{"a":NaN}', '[-Infinity]', '{"a":{"b":1,"b":"x"}}', '{"a":1,"a":', "NaN", "nan", '{"a":1} {"a":2}', None]
    got = column(spark, cases, lambda c: F.to_json(payloads.strict_json(c)))
    assert got == ['{"a":2}', '{"a":null}', "[null]", '{"a":{"b":"x"}}', None, "null", None, None, None]


def test_references_without_semicolon_stay_text():
    page = "<title>a&&&amp</title><!-- &lt --><script>x&lt</script><body>&lt b &ampx; &amp; &copy; &nosuch;<a href='/?a=1&copy=2&amp;b'>c</a></body>"
    title, found, hrefs, _ = html.parse_page(page)
    assert (title, found.split("\n"), hrefs) == ("a&&&amp", ["&lt b &ampx; & © &nosuch;", "c"], ["/?a=1&copy=2&b"])
    assert "x&lt" in html.parse_page("<body><script>x&lt</script></body>", noise=[])[1]


def test_pages_are_parsed_a_few_at_once(spark):
    import pyarrow as pa

    assert [len(x) for x in html.slices([pa.array(["x"] * 250), pa.array([], pa.string())])] == [100, 100, 50]
    pages = [None if k % 50 == 7 else f"<title>t{k}</title><main>m{k}<a href='/{k}'>a</a></main>" for k in range(250)]
    frame = spark.createDataFrame(list(enumerate(pages)), "k long, html string").coalesce(1)
    parts = frame.select("k", html.page_parts(F.col("html")).alias("p")).select("k", "p.*", html.resolve(F.lit("http://h/"), F.col("p.hrefs")).alias("links"))
    expected = [html.parse_page(p) for p in pages]
    assert [tuple(r) for r in parts.orderBy("k").collect()] == [(k, *e, [html.resolve_one("http://h/", h) for h in e[2]]) for k, e in enumerate(expected)]
