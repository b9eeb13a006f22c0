"""Text functions, as Column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def quoted(value: str) -> str:
    """A string as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: Column, body: str) -> Column:
    """Like let, with body an SQL expression of p: one call to the JVM for many terms."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"p -> {body}")), 1)


def pattern(terms: Iterable[str]) -> str:
    """A regular expression that finds any of the terms as they stand: a tree by their characters."""
    terms = set(terms)
    if "" in terms:
        return ""
    by_first: dict[str, set[str]] = {}
    for t in terms:
        by_first.setdefault(t[0], set()).add(t[1:])
    parts = [re.escape(c) + pattern(rest) for c, rest in sorted(by_first.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def contains_any(terms: Iterable[str], text: Column) -> Column:
    """Whether the text holds any of the terms as they stand: one search, however many terms there are."""
    terms = list(terms)
    return text.rlike(pattern(terms)) if terms else F.lit(False)


def words(values: Iterable[str]) -> Column:
    values = list(values)
    return F.expr(f"array({', '.join(map(quoted, values))})") if values else F.array()


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(columns: Iterable[Column], start: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0) if start is None else start)


def tokens(text: Column, stopwords: Iterable[str] = V.STOPWORDS, phrases: Iterable[str] = V.PHRASES) -> Column:
    """Lower-case tokens without stopwords, then one marker for each phrase that the text holds."""
    stop = list(dict.fromkeys(stopwords))

    def split(low: Column) -> Column:
        found = F.regexp_extract_all(low, F.lit(V.TOKEN), F.lit(0))
        plain = F.call_function("filter", found, F.expr(f"w -> NOT w IN ({', '.join(map(quoted, stop))})")) if stop else found
        if not phrases:
            return plain
        markers = ", ".join(f"CASE WHEN contains(p, {quoted(x)}) THEN {quoted(x.replace('/', '_').replace(' ', '_'))} END" for x in phrases)
        return F.concat(plain, let_sql(low, f"array_compact(array({markers}))"))

    return let(F.lower(F.coalesce(text, F.lit(""))), split)


def looked_up(kind: str, type_: pa.DataType, look):
    """A function of a column of texts: tasks call look with each text of a batch, null for null."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else look(x) for x in texts.to_pylist()], type_)

    return run


def concepts(text: Column) -> Column:
    """Names of the concepts of which an alias is in the text."""
    named = [(f"concept_{name}", aliases) for name, aliases in V.CONCEPTS.items()]
    look = looked_up("array<string>", pa.list_(pa.string()), lambda low: [name for name, aliases in named if any(a in low for a in aliases)])
    return look(F.lower(F.coalesce(text, F.lit(""))))


def join_nonempty(parts: Iterable[Column], separator: str = " ") -> Column:
    """Trimmed parts that aren't empty."""
    return F.array_join(F.filter(F.array(*[strip(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), lambda x: x != ""), separator)


#: White space as Unicode has it. In classes, what is below 256 stands in a class of single characters, which is a table,
#: and comes first; the rest is asked only within its range.
_NEAR, _FAR = "\t\n\x0b\x0c\r \x85\xa0", "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = _NEAR + _FAR
_BEYOND = f"[\u1680-\u3000&&[{_FAR}]]"
_OTHER = f"[^[abcdefghijklmnopqrstuvwxyz0123456789+#{_NEAR}]{_BEYOND}]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def norm(text: Column) -> Column:
    """Lower case; what isn't a-z, 0-9, +, # or white space becomes a space; stripped. Inner white space stays."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _OTHER, " "))


def norm_literal(term: str) -> str:
    """norm of a term of ASCII characters, on the driver."""
    return "".join(c if c.isascii() and c.isalnum() or c in "+#" or c.isspace() else " " for c in term.lower()).strip()


def padded(terms: Iterable[str]) -> list[str]:
    """Terms with a space before and after, as they stand in a padded text."""
    cleaned = (norm_literal(t.replace(".", " ").replace("/", " ").replace("-", " ")) for t in terms)
    return [f" {t} " for t in cleaned if t]


def pad(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def has_term(terms: Iterable[str], padded_text: Column) -> Column:
    return contains_any(padded(terms), padded_text)


def count_terms(terms: Iterable[str], padded_text: Column, token_set: Column | None = None) -> Column:
    """Single words count once each if they are tokens (parted by plain spaces); each phrase counts if the text holds it."""
    all_terms = padded(terms)
    singles = list(dict.fromkeys(t.strip() for t in all_terms if " " not in t.strip()))
    phrases = [t for t in all_terms if " " in t.strip()]
    found = token_set if token_set is not None else F.split(padded_text, " ")
    single = F.size(F.array_intersect(words(singles), found)) if singles else F.lit(0)
    return single + let_sql(padded_text, " + ".join(f"int(contains(p, {quoted(t)}))" for t in phrases)) if phrases else single


def hits(terms: Iterable[str], padded_text: Column, token_list: Column | None = None) -> Column:
    """Those of the terms that count_terms finds, each once: one look at the text for all lists of terms that are counted by count_hits.

    Tokens are the text's own, parted by plain spaces; a list of them is not needed. A task looks for phrases as strings
    and for words in the set of tokens, which costs a small part of what expressions cost.
    """
    every = list(dict.fromkeys(padded(terms)))
    singles = frozenset(t.strip() for t in every if " " not in t.strip())
    phrases = [(t, t.strip()) for t in every if " " in t.strip()]
    look = looked_up("array<string>", pa.list_(pa.string()), lambda p: [*singles.intersection(p[1:-1].split(" ")), *(t for x, t in phrases if x in p)])
    return look(padded_text)


def any_hit(terms: Iterable[str], found: Column) -> Column:
    """Whether count_hits is above 0."""
    return F.arrays_overlap(words(dict.fromkeys(t.strip() for t in padded(terms))), found)


def count_hits(terms: Iterable[str], found: Column) -> Column:
    """count_terms, from the hits of a list that holds these terms: a phrase that is listed twice counts twice."""
    times = Counter(padded(terms))
    rounds = max((n for t, n in times.items() if " " in t.strip()), default=1)
    listed = [[t.strip() for t, n in times.items() if n > k and (k == 0 or " " in t.strip())] for k in range(rounds)]
    return total([F.size(F.array_intersect(words(x), found)) for x in listed])


def alias_match(aliases: Iterable[str], skill_terms: Column, padded_text: Column, token_set: Column) -> Column:
    """1 if an alias is a listed skill, 0.7 if the text mentions one, else 0."""
    normal = [norm_literal(a) for a in aliases]
    return F.when(F.arrays_overlap(words(normal), skill_terms), 1.0).when(count_terms(normal, padded_text, token_set) > 0, 0.7).otherwise(0.0)


def loose_tokens(text: Column) -> Column:
    """Distinct tokens parted by white space, commas and full stops."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), f"[[,.{_NEAR}]{_BEYOND}]+")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of lists without repeats."""

    def shared(x: Column) -> Column:
        return let(F.size(F.array_intersect(b, x)), lambda n: F.when(F.size(x) + F.size(b) > 0, n / (F.size(x) + F.size(b) - n)).otherwise(0.0))

    return let(a, shared)


def word_jaccard(normal: Column, values: Iterable[str]) -> Column:
    """jaccard of the loose tokens of a normalised text and of words without repeats."""
    wanted = frozenset(values)

    def look(text: str) -> float:
        own = set(text.split())  # white space is as SPACES has it; norm leaves no commas, full stops and other separators
        n = len(own & wanted)
        return n / (len(own) + len(wanted) - n) if own or wanted else 0.0

    return looked_up("double", pa.float64(), look)(normal)


def ochiai(a: Column, b: Column) -> Column:
    """Shared elements over the root of the product of sizes."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(0.0)


def signature(text: Column, n: int = 6) -> Column:
    """The first words, digits as #: what texts of one template share."""
    return F.regexp_replace(F.lower(F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")), "[0-9.]+", "#")


def digest_mod(text: Column, n: int) -> Column:
    """The MD5 digest as a number, modulo n, digit by digit."""
    digits = F.split(F.md5(text.cast("binary")), "")
    return F.aggregate(F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int")), F.lit(0), lambda a, d: (a * 16 + d) % n)


def days_since(date_text: Column, reference: str = V.REFERENCE_DATE) -> Column:
    """Days up to the reference date, none below 0; 9999 if there is no date."""
    days = F.datediff(F.lit(reference).cast("date"), F.try_to_date(F.substring(date_text, 1, 10), "yyyy-MM-dd"))
    return F.when(days.isNull(), 9999).otherwise(F.greatest(F.lit(0), days))


def occurrences(text: Column, term: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def integrity_flags(text: Column) -> Column:
    """Hidden characters, instructions to a reader that is a model, and blocks of repeated keywords."""

    def flags(raw: Column, low: Column) -> Column:
        markers = let(F.array(*[occurrences(low, k) for k in V.KEYWORDS]), lambda n: (F.aggregate(n, F.lit(0), lambda a, x: a + x) >= 60) & (F.size(F.filter(n, lambda x: x > 0)) / F.greatest(F.aggregate(n, F.lit(0), lambda a, x: a + x), F.lit(1)) <= 0.35))
        return F.array_compact(
            F.array(
                F.when(raw.rlike(V.HIDDEN), F.lit("hidden_text_control_chars")),
                F.when(any_of(low.contains(m) for m in V.INJECTION_MARKERS) & low.rlike(V.INJECTION), F.lit("prompt_injection_text")),
                F.when(markers, F.lit("repeated_keyword_block")),
            )
        )

    return let(F.coalesce(text, F.lit("")), lambda raw: let(F.lower(raw), lambda low: flags(raw, low)))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def snippet(text: Column, needle: str, radius: int = 160) -> Column:
    """What stands around the first occurrence of a needle, in any case; the head of the text if there is none."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + len(needle) + radius - start)).otherwise(F.substring(text, 1, 2 * radius))


def inferred_years(text: Column, default: float = 5.0) -> Column:
    """The largest number of years up to 40 that the text names, kept within 1 and 15."""
    found = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]{1,2})\+?\s*(years|yrs)"), F.lit(1)), lambda x: x.cast("double")), lambda x: x <= 40)
    return F.coalesce(F.least(F.greatest(F.array_max(found), F.lit(1.0)), F.lit(15.0)), F.lit(default))


def variant(ident: Column, salt: int, n: int) -> Column:
    """A choice among n by the sum of an id's code points."""
    return (F.aggregate(F.transform(F.split(ident, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c) + salt) % n


def article(title: Column) -> Column:
    """'an' before a vowel or an initialism that is spoken with one."""
    return F.when(F.lower(title).rlike("^[aeiou]") | title.rlike(r"^(ML|NLP|SRE|HR|LLM|MLOps|SDE|FPGA)\b"), F.lit("an")).otherwise(F.lit("a"))
