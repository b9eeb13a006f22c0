import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import url_filters
from lodestar.llm.url_filters import Rule


def brute_parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([k for k, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]), rest[cut:]
    return host, re.split("[?#]", tail)[0], host + tail


def matches(pattern, text, site):
    """Whether a pattern matches, by trying all places sign by sign."""
    if not site:
        pattern, text = (re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in (pattern, text))
    ends = pattern.endswith("|")
    body = pattern[:-1] if ends else pattern
    host = re.match("[^/?#]*", text)[0]
    starts = range(len(text) + 1)
    if body.startswith("||"):
        body, starts = body[2:], [0] + [k + 1 for k, c in enumerate(host) if c == "."]
    elif body.startswith("|"):
        body, starts = body[1:], [0]
    at = set(starts)
    for c in body:
        if c == "*":
            at = {k for s in at for k in range(s, len(text) + 1) if "\n" not in text[s:k]}
        elif c == "^":
            at = {k + 1 for k in at if k < len(text) and not re.match(r"[A-Za-z0-9_.%-]", text[k])} | {k for k in at if k == len(text)}
        else:
            at = {k + 1 for k in at if text[k : k + 1] == c}
    return len(text) in at if ends else bool(at)


def brute(rows, rules):
    out = []
    for ident, url in rows:
        host, path, text = brute_parts(url)
        fit = [(r.site, len(r.pattern), -k, r) for k, r in enumerate(rules) if text is not None and matches(r.pattern, text, r.site)]
        best = max(fit, key=lambda x: x[:3])[3] if fit else None
        verdict = best.verdict if best else "allow" if host else "block"
        out.append((ident, host, path, best.pattern[2:] if best and best.site else None, best.pattern if best and not best.site else None, verdict))
    return sorted(out, key=str)


ODD = ["http://example.org/es/x", "http://Example.ORG/es/x", "http://www.example.org/en/1", "http://www.example.org/en/123", "http://www.example.org/en/2", "http://badexample.org/es/x", "http://example.org/ES/x", "https://example.org", "http://example.org?x=/es/", "http://x.com/fr/", "http://x.com/de/", "http://com/de/1", "http://x.com.net/de/1", "http://x.com:80/de/1", "https://a.b#/c", "://", "://x/", "nothing", "", None, "a://b://c/d?e", "http://x.net/a?utm_source=b", "http://x.net/a?UTM_SOURCE=b", "http://x.net/utm_source=b", "http://x.net/xutm_source=b", "http://x.net/wp-login.php", "http://x.net/wp-login.phpx", "http://x.net/cart", "http://x.net/cart?x", "http://x.net/carts", "http://ads.x.net/a/click", "http://x.net/search?q=a&about=b", "http://x.net/a.jpg", "http://x.net/a.jpg?x", "http://x.net/feed/", "http://x.net/calendar/a/print", "http://é.net/ſearch?", "http://x.net/a\nb/cart^", "http://x.net/" + "a/" * 200_000 + "cart"]
COLUMNS = ("page_id", "host", "path", "rule", "pattern", "verdict")


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "path", "rest", "address", "site", "at", "said", "html")})

    return make


def got(frame, *rules):
    return sorted((tuple(r[c] for c in COLUMNS) for r in url_filters.judge(frame, *rules).collect()), key=str)


def test_given_rules(pages):
    rows = [(k // 2, u) for k, u in enumerate(ODD)] + [(None, "http://x.org/")]
    want = brute([r for r in rows if len(r[1] or "") < 1000], url_filters.SITES + url_filters.PATTERNS)
    assert [r for r in got(pages(rows)) if len(r[2]) < 1000] == want
    assert [r[5] for r in got(pages(rows)) if len(r[2]) > 1000] == ["block"]


@pytest.mark.parametrize("block", [50_000, 7])
def test_random_rules_in_blocks(pages, monkeypatch, block):
    monkeypatch.setattr(url_filters, "BLOCK", block)
    rng = random.Random(4)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(rng.randint(1, n)))
    rules = [Rule(rng.choice(["allow", "block"]), rng.choice(["", "|", "||", ""]) + pick("aB1./^*?_-", 6) + rng.choice(["", "|"]), rng.random() < 0.3) for _ in range(60)]
    rules = [Rule(r.verdict, "||" + r.pattern.strip("|"), True) if r.site else r for r in rules if r.pattern.strip("|")]
    rows = [(k, "http://" + pick("aB1..", 5) + pick("aB1./?_-#é", 12)) for k in range(400)]
    assert got(pages(rows), tuple(rules)) == brute(rows, rules)


def test_no_rows_and_no_rules(pages):
    assert got(pages([(1, "x")]).limit(0)) == []
    assert got(pages([(1, "http://x.org/a?b")]), ()) == [(1, "x.org", "/a", None, None, "allow")]


def test_tokens_and_index():
    assert Rule("block", "||example.org/en/1", True).tokens == {"example", "org", "en"}
    assert Rule("block", "^utm_source=").tokens == {"utm", "source"}
    assert Rule("block", "*ab.cd*").tokens == frozenset()
    assert Rule("block", "|x.jpg|").tokens == {"x", "jpg"}
    rules = [Rule("block", "/a/b/"), Rule("block", "/b/c/"), Rule("block", "x")]
    assert url_filters.index(rules, {"a": 5, "b": 2, "c": 9}) == ({"b": [0, 1]}, [2])


def test_only_candidates_run(monkeypatch):
    asked = []

    class Spy:
        def __init__(self, name):
            self.name = name

        def search(self, _):
            asked.append(self.name)

    import pyarrow as pa

    rules = [Rule("block", f"/word{k}/") for k in range(50)]
    for r in rules:
        r.__dict__["regex"] = Spy(r.pattern)
    names = ["page_id", "host", "path", "address", "site", "size", "at", "pattern", "said"]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["h"]), pa.array(["/word7/"]), pa.array(["h/word7/"]), *[pa.array([None], t) for t in (pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.string())]], names=names)
    list(url_filters._matcher(rules, {}, 0)(iter([batch])))
    assert asked == ["/word7/"]
