import time

import duckdb
import numpy as np
import pytest

from lodestar.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><meta charset="utf-8"><style>p{}</style></head><body class="has-sidebar">
<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies</div><script>var t="</p>";</script>
<article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>&nbsp; three<br>four</p><p>Un<i>broken</i> a &lt; b
<div class='ad banner'>Buy <p>now</p></div><ul><li>first<li>second</ul><form><p>Mail <input></p></form>
<table><tr><td>cell</td><td>next</td></tr></table><aside>side</aside><section id="comments"><p>I disagree</p></section>
<p hidden>no</p></article><footer>&copy; host</footer></body></html>"""


def test_blocks():
    assert [t for t, _ in html_text.blocks(PAGE)] == ["Title & more", "One two three four", "Unbroken a < b", "first", "second", "cell", "next"]
    for odd in (None, "", "<", "<p", "plain", "<p>a<p>b", "<!-- open", "<script>x", "<article>", "</div></p>"):
        html_text.blocks(odd)
    assert html_text.blocks("plain &amp; text") == [("plain & text", html_text.OPEN)]


@pytest.mark.parametrize(
    "tag",
    ['p title="a hidden gem"', 'p data-id="notice-7"', 'p data-role="dialog"', 'p onclick="role=menu"', "p onclick='class=\"ad\"'", 'p class="ad-hoc"', 'p id="social-contract"', 'p class="share-price"', 'section id="notice-of-meeting"', 'ul class="menu-items"', "p class=admin", 'p data-hidden', 'p title=hidden'],
)
def test_names_within_other_names_and_values_dont_count(spark, tag):
    name = tag.split()[0]
    page = f"<article><{tag}><p>Body A</p></{name}><p>B</p></article>"
    assert [t for t, _ in html_text.blocks(page)] == ["Body A", "B"]
    assert html_text.unique_text([html_text.blocks(page)]) == ["Body A\nB"]


@pytest.mark.parametrize("tag", ["p hidden", 'p HIDDEN=""', "p role=dialog", "p class='x ad'", 'p class="x\nNotice"', "p id=comments", 'p style="display : none"', "p aria-hidden=true", 'p title="a" class="ad"', "p/class=ad", 'p class="&#97;d"'])
def test_names_that_count(tag):
    assert [t for t, _ in html_text.blocks(f"<article><{tag}>Body A</p><p>B</p></article>")] == ["B"]


def slow_attributes(source):
    """Sign by sign."""
    out, i, n = {}, 0, len(source)
    space = lambda c: c.isspace()
    while i < n:
        if space(source[i]) or source[i] in "/>":
            i += 1
            continue
        start = i
        i += 1
        while i < n and not space(source[i]) and source[i] not in "/>=":
            i += 1
        name, j, value = source[start:i], i, ""
        while j < n and space(source[j]):
            j += 1
        if j < n and source[j] == "=":
            j += 1
            while j < n and space(source[j]):
                j += 1
            quote = source[j] if j < n and source[j] in "\"'" and source.find(source[j], j + 1) > 0 else ""
            if quote:
                end = source.index(quote, j + 1)
                value, i = source[j + 1 : end], end + 1
            else:
                end = j
                while end < n and not space(source[end]) and source[end] != ">":
                    end += 1
                value, i = source[j:end], end
        out.setdefault(name.lower(), value)
    return out


def test_attributes_sign_by_sign():
    import random

    rng = random.Random(8)
    for _ in range(20_000):
        source = "".join(rng.choice(["a", "b", "class", "=", "=", '"', "'", " ", "/", ">", "\n"]) for _ in range(rng.randint(0, 14)))
        assert html_text.attributes_of(source) == slow_attributes(source), source
    assert html_text.attributes_of("a='" + "x " * 500_000 + "' class=b") == {"a": "x " * 500_000, "class": "b"}


def test_doubtful_names_need_other_pages(spark):
    story = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    same = "Sign up to our weekly letter and never miss one of them again"
    page = lambda k, text: f'<article><p>{story(k)}</p><div class="letter-signup"><p>{text}</p></div></article>'
    rows = [(k, f"http://a/{k}", page(k, same)) for k in range(3)] + [(3, "http://b/3", page(3, same)), (4, "http://a/4", page(4, story(44)))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: story(0), 1: story(1), 2: story(2), 3: f"{story(3)}\n{same}", 4: f"{story(4)}\n{story(44)}"}


def brute_shared(pages):
    """Runs of RUN tokens of a block, and short blocks, that two unlike pages have; each page's text without them where no article has them."""
    n, has = html_text.RUN, {}
    for p in pages:
        for t, k in p:
            w = t.split(" ")
            for i in range(len(w) - n + 1):
                has.setdefault(tuple(w[i : i + n]), set()).add(str(p))
            if k != html_text.ARTICLE and len(w) < n:
                has.setdefault(t, set()).add(str(p))
    out = []
    for p in pages:
        lines = []
        for t, k in p:
            w = t.split(" ")
            gone = set()
            for i in range(len(w) - n + 1):
                if len(has[tuple(w[i : i + n])]) > 1:
                    gone |= set(range(i, i + n))
            if k != html_text.ARTICLE and (len(has.get(t, ())) > 1 if len(w) < n else gone):
                t = "" if len(w) < n else " ".join(x for i, x in enumerate(w) if i not in gone)
            if t:
                lines.append(t)
        out.append("\n".join(lines))
    return out


def test_shared_runs_by_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(60):
        pages = [[(" ".join(rng.choice("ab") for _ in range(rng.randint(1, 24))), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        pages += [pages[0]] * rng.randint(0, 2)  # copies of a page and ties between runs
        assert html_text.unique_text(pages) == brute_shared(pages)


def test_tags():
    read = lambda page: [(name, text) for text, name, _ in html_text.tags(page)]
    assert read('a<b title="x > <i>">c</b>d') == [("b", "a"), ("/b", "c"), ("", "d")]
    assert read("a <3 b<!-- <p> -->c<script>'<p>'</SCRIPT >d<svg/>e") == [("", "a <3 b c d e")]
    assert read("<p open <b>x") == [("b", "<p open "), ("", "x")]
    assert read("x<p") == [("", "x<p")] and read("x<script>y") == [("", "x ")] and read('<p a="b>c') == [("p", ""), ("", "c")]


@pytest.mark.parametrize("page", ["<script " * 130_000, "<div>" * 100_000 + "</section>" * 100_000, '<a "' * 250_000, '<a b="' * 160_000, "<a \"><b ' '" * 100_000, "<" * 1_000_000, "<!--" * 250_000, "<div><p>" * 60_000 + "</p></div>" * 60_000, "<title>" * 150_000, "<head>" + "<body>" * 150_000, "word " * 250_000])
def test_odd_pages_of_a_megabyte(page):
    start = time.monotonic()
    html_text.blocks(page)
    assert time.monotonic() - start < 15


def test_suffix_array():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 300)
    order, same = html_text.suffix_array(tokens, 8)
    heads = [tuple(tokens[i : i + 8]) + (-1,) * (8 - len(tokens[i : i + 8])) for i in order]
    assert heads == sorted(heads)
    assert same.tolist()[1:] == [a == b for a, b in zip(heads, heads[1:])]


def test_boilerplate_of_a_host():
    common = "all rights reserved by the owners of this site since 1999"
    pages = [[(f"unique story number {k} told in its own words " + " ".join(f"w{k}x{j}" for j in range(20)), 1), (common, 1), ("Share", 1)] for k in range(3)]
    texts = html_text.unique_text(pages)
    assert texts == [p[0][0] for p in pages]
    article = [[(t, 2) for t, _ in p] for p in pages]
    assert html_text.unique_text(article) == ["\n".join(t for t, _ in p) for p in article]  # too few pages to call it boilerplate
    copies = [[(common, 1)], [(common, 1)]]
    assert html_text.unique_text(copies) == [common, common]


def test_all_pages(spark):
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in html_text.op1_html_text(spark, d).collect()}
    rows = duckdb.sql(f"select page_id, url, html from '{d}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    import html as h
    import re

    for ident, url, page in rows:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[ident]["text"] == "\n".join(x for x in want if x)
        assert got[ident]["n_chars"] == len(got[ident]["text"]) and got[ident]["url"] == url


def test_articles_stay_whole_on_small_hosts(spark):
    """As above at scale 0.1, where one heading or passage is on a fifth of a host's articles."""
    import html as h
    import re

    d = "/root/testdata/sf0.1"
    got = {r["page_id"]: r["text"] for r in html_text.op1_html_text(spark, d).collect()}
    rows = duckdb.sql(f"select page_id, html from '{d}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for ident, page in rows:
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert got[ident] == "\n".join(x for x in want if x)


@pytest.mark.parametrize("shard", [1, 2, 1000])
def test_boilerplate_across_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(html_text, "SHARD", shard)
    common = "all rights reserved by the owners of this site since 1999"
    story = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(k, f"http://a/{k}", f"<p>{story(k)}</p><p>{common}</p><p>Share</p>") for k in range(7)]
    rows += [(7, "http://b/7", f"<p>{story(7)}</p><p>{common}</p>"), (8, "http://c/8", f"<p>{story(8)}</p>"), (9, "http://c/9", f"<article><p>{story(8)}</p></article>")]
    rows += [(10, "http://c/10", f"<article><p>{story(10)}</p></article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(7)] == [story(k) for k in range(7)]
    assert got[7] == f"{story(7)}\n{common}"  # on one page of its host
    assert got[8] == "" and got[9] == story(8) and got[10] == story(10)


@pytest.mark.parametrize("shard", [1, 1000])
def test_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(html_text, "SHARD", shard)
    rows = [(1, None, None), (None, "http://a/x", "<p>word"), (2, "http://a/x", "<p>word"), (2, "http://a/x", "<p>word"), (3, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    got = sorted((r["page_id"] or -1, r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == [(-1, "word", 4), (1, "", 0), (2, "word", 4), (2, "word", 4), (3, "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []
