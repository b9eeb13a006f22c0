"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern with a verdict. In a pattern, `||` at the start is the host or the start of any domain that it ends
in, `|` at the start or end is that of the address, `^` is a character that isn't one of `A-Za-z0-9_.%-`, or the end, `*` is
any run, all else stands for itself. Patterns are matched against the address without its scheme: the host, A-Z
lower-cased, and all that follows it. Site rules (a domain and the start of a path, told by the address's letters as
they are) go before pattern rules (told without regard to case of A-Z). Of the rules of a kind that match, the longest
pattern decides, of equally long ones the first in the list; an address that none matches is allowed, one without a host
is blocked.

A literal token is a run of letters and digits in a pattern that can only match a whole run of the address. How many
addresses have each of the rules' tokens is counted over all rows; a rule is indexed by the token in fewest of them. An
address's tokens fetch the rules indexed by them, and only those run their regular expressions, besides the rules that
have no token. Rules are sent to the tasks in blocks of BLOCK; if there are more, the blocks pass over the rows one after
the other, so that what is sent stays bounded and no row is shuffled.

Defined results: a null url and one without `://` has an empty host and path and no rule. Rows that repeat an id are
judged each by itself. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    site: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        body, start, end = self.pattern, "", ""
        if body.startswith("||"):
            body, start = body[2:], r"^(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, start = body[1:], "^"
        if body.endswith("|"):
            body, end = body[:-1], r"\Z"
        special = {"*": "[^\n]*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return re.compile(start + "".join(special.get(c) or re.escape(c) for c in body) + end, re.ASCII | (0 if self.site else re.IGNORECASE))

    @cached_property
    def tokens(self) -> frozenset[str]:
        """Runs of letters and digits that can only match a whole run of an address, lower-cased."""
        return frozenset(m[2].lower() for m in _BOUNDED.finditer(self.pattern) if m[1] != "*" and m[3] != "*" and m[2])


#: A run with the signs beside it; the start or the end of the pattern without a bar leaves a run open, as `*` does.
_BOUNDED = re.compile(r"([^A-Za-z0-9])([A-Za-z0-9]+)(?=([^A-Za-z0-9]))")
_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: Rules that are sent to tasks at a time.
BLOCK = 50_000

#: Fixed by the contract: a domain and the start of a path.
SITES = tuple(Rule(verdict, f"||{name}", True) for verdict, name in [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")])
#: What a crawl fetches besides pages of text: copies under tracking names, forms, lists, files that aren't pages.
PATTERNS = tuple(
    Rule(verdict, pattern)
    for verdict, pattern in [
        ("block", "^utm_source="),
        ("block", "^sessionid="),
        ("block", "^replytocom="),
        ("block", "/wp-admin/"),
        ("block", "/wp-login.php^"),
        ("block", "/login^"),
        ("block", "/signup^"),
        ("block", "/cart^"),
        ("block", "/checkout^"),
        ("block", "/search?"),
        ("block", "/feed/|"),
        ("block", "/calendar/*/print^"),
        ("block", "||ads.*/click^"),
        ("block", ".jpg|"),
        ("block", ".zip|"),
        ("allow", "/search?*^about="),
    ]
)


def addresses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path and address, the host with all that follows it (null without `://`)."""
    rest = F.expr(f"CASE WHEN locate('://', `{url_col}`) > 0 THEN substring(`{url_col}`, locate('://', `{url_col}`) + 3) END")
    split = pages.select(F.col(id_col).alias("page_id"), rest.alias("rest")).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.expr("substring(rest, length(host) + 1)")
    return split.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit("")).alias("path"), F.concat(host, after).alias("address"))


def token_counts(rows: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many addresses each of the rules' tokens is."""
    spark, wanted = rows.sparkSession, sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.translate("address", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z0-9]+)")))).alias("token"))
    known = spark.createDataFrame([(t,) for t in wanted], "token string")
    if len(wanted) <= BLOCK:
        known = F.broadcast(known)
    return dict(map(tuple, found.join(known, "token", "left_semi").groupBy("token").count().collect()))


def index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules' numbers by the rarest of their tokens, and those of rules without one."""
    by_token: dict[str, list[int]] = {}
    bare = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            bare.append(k)
    return by_token, bare


def _rank(rule: Rule, at: int) -> tuple[bool, int, int]:
    return rule.site, len(rule.pattern), -at


def _matcher(rules: list[Rule], counts: dict[str, int], first: int) -> Callable:
    """Of the block's rules that match an address the strongest, or what earlier blocks found if that is stronger."""
    by_token, bare = index(rules, counts)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.tenant("url_filters")
        for batch in batches:
            out = []
            for address, *held in zip(*(batch.column(k).to_pylist() for k in range(3, 9))):
                best = tuple(held)
                if address is not None:
                    ask = set(bare)
                    for token in set(_TOKEN.findall(address.translate(_LOWER))):
                        ask.update(by_token.get(token, ()))
                    for k in ask:
                        rank = _rank(rules[k], first + k)
                        if (best[0] is None or rank > best[:3]) and rules[k].regex.search(address):
                            best = *rank, rules[k].pattern, rules[k].verdict
                out.append(best)
            types = pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.string()
            found = [pa.array([b[k] for b in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *found], names=batch.schema.names)

    return match


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITES + PATTERNS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (a site rule's domain and path), pattern (another rule that decided) and verdict."""
    common.small_batches(pages.sparkSession, 10_000)
    rows, rules = addresses(pages, id_col, url_col), list(rules)
    counts = token_counts(rows, rules)
    found = {"site": "boolean", "size": "int", "at": "long", "pattern": "string", "said": "string"}
    held = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in found.items()])
    for first in range(0, len(rules), BLOCK):
        if first:
            held = common.materialize(held, "addresses")
        held = held.mapInArrow(_matcher(rules[first : first + BLOCK], counts, first), held.schema)
    verdict = F.coalesce("said", F.when(F.col("host") == "", "block").otherwise("allow"))
    return held.select("page_id", "host", "path", F.when(F.col("site"), F.expr("substring(pattern, 3)")).alias("rule"), F.when(~F.col("site"), F.col("pattern")).alias("pattern"), verdict.alias("verdict"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))


#: Written out by hand, not made from the patterns.
ORACLE = {
    "op12_url_filters": r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, coalesce(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path, coalesce(substr(rest, length(h) + 1), '') AS tail FROM b),
s AS (SELECT *, '.' || host AS sub, host || tail AS u FROM c),
r AS (SELECT *, CASE WHEN sub LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN sub LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN sub LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN sub LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN sub LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM s),
m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(u, '(?i)/calendar/.*/print([^A-Za-z0-9_.%-]|$)') THEN '/calendar/*/print^'
  WHEN regexp_matches(u, '(?i)/search[?].*[^A-Za-z0-9_.%-]about=') THEN '/search?*^about='
  WHEN regexp_matches(u, '(?i)/wp-login[.]php([^A-Za-z0-9_.%-]|$)') THEN '/wp-login.php^'
  WHEN regexp_matches(u, '(?i)^([^/?#]*[.])?ads[.].*/click([^A-Za-z0-9_.%-]|$)') THEN '||ads.*/click^'
  WHEN regexp_matches(u, '(?i)[^A-Za-z0-9_.%-]utm_source=') THEN '^utm_source='
  WHEN regexp_matches(u, '(?i)[^A-Za-z0-9_.%-]replytocom=') THEN '^replytocom='
  WHEN regexp_matches(u, '(?i)[^A-Za-z0-9_.%-]sessionid=') THEN '^sessionid='
  WHEN regexp_matches(u, '(?i)/wp-admin/') THEN '/wp-admin/'
  WHEN regexp_matches(u, '(?i)/checkout([^A-Za-z0-9_.%-]|$)') THEN '/checkout^'
  WHEN regexp_matches(u, '(?i)/signup([^A-Za-z0-9_.%-]|$)') THEN '/signup^' WHEN regexp_matches(u, '(?i)/search[?]') THEN '/search?'
  WHEN regexp_matches(u, '(?i)/login([^A-Za-z0-9_.%-]|$)') THEN '/login^' WHEN regexp_matches(u, '(?i)/feed/$') THEN '/feed/|'
  WHEN regexp_matches(u, '(?i)/cart([^A-Za-z0-9_.%-]|$)') THEN '/cart^'
  WHEN regexp_matches(u, '(?i)[.]jpg$') THEN '.jpg|' WHEN regexp_matches(u, '(?i)[.]zip$') THEN '.zip|' END AS pattern FROM r)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('org/', 'com/fr/') OR pattern = '/search?*^about=' THEN 'allow'
  WHEN rule IS NOT NULL OR pattern IS NOT NULL OR host = '' THEN 'block' ELSE 'allow' END AS verdict FROM m"""
}
QUERIES = {"op12_url_filters": op12_url_filters}
