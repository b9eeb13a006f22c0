"""Main text of web pages by suffix arrays over hosts.

A page is read into blocks. What its elements, roles, classes and ids name as menu, header, footer, sidebar, notice,
advert, form, script, style or comments isn't text. If there is an article or main element, the blocks in it are the
candidates; else all blocks are but those made of links. In an article or main element structure alone decides: what
its text shares with other pages (passages, copied articles) stays. A name is a whole word of a class or id. Where such a
name is only a part of one (`ad-hoc`, `notice-of-meeting`) it is a doubt: text under it in an article stays but for what
other pages of the host share.

Outside of one, tokens covered by a run of RUN tokens that two pages of the host share are boilerplate, as are short
blocks met on two; copies of a whole page count once. Runs are found in shards, sets of pages of one input partition:
the tokens of a shard, each with its host, become one stream with a border at each block, over which a suffix array is
built by doubling; neighbours that share RUN tokens are one run. A shard tells of each run, by a 64-bit hash, the least
and the greatest hash of the contents that have it; taken together over all shards, the two differ if two pages of the
host share it, so the verdict doesn't depend on how pages fall into shards. The runs that are shared come back to the
shards that have them by a join. Memory is bounded by a shard, whatever the host's size. Pages of which no block is
outside an article take no part but as evidence for hosts that have others.

Defined results: null and empty html, and pages without main text, give an empty text. A null url is a host of its
own. Rows that repeat an id are pages of their own. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tokens that a repeated run has at least.
RUN = 8
#: Pages, and tokens, in one suffix array.
SHARD, SHARD_TOKENS = 1000, 1 << 20
#: Bits of the bitmap of hosts with pages that have no article.
HOSTS = 1 << 20

#: Elements of which nothing inside is read.
_RAW = frozenset("script style noscript template svg iframe object canvas textarea select button title math audio video".split())
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAMED = re.compile(r"/?[a-zA-Z][\w:-]*")
#: What a tag is read up to: its end, another tag, or a value in quotes.
_STOP = re.compile(r"[<>\"']")
#: One attribute: its name, then its value in quotes or without.
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"[a-z0-9]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = frozenset("nav footer aside form menu dialog head".split())
#: Elements whose opening and closing is followed; others only end blocks or are inline.
FOLLOWED = frozenset("article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section table td tr ul p li span blockquote".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments respond disqus replies pagination pager toolbar skip masthead".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())

DROPPED, OPEN, ARTICLE, DOUBTFUL = 0, 1, 2, 3


def attributes_of(source: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name, read one after the other, so that nothing inside a value is taken for a name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def _kind(tag: str, attributes: str, above: int) -> int:
    """The kind of what an element holds, given that of what holds it."""
    inside = above in (ARTICLE, DOUBTFUL)
    if above == DROPPED or tag in NOT_TEXT or (tag == "header" and not inside):
        return DROPPED
    given = {k: html.unescape(v).lower() for k, v in attributes_of(attributes).items()} if attributes else {}
    role, names = given.get("role", "").strip(), {*given.get("class", "").split(), *given.get("id", "").split()}
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return DROPPED
    if role in ROLES:
        return DROPPED
    if tag == "article" or tag == "main" or role in ("main", "article"):
        return DROPPED if names & {"comment", "comments", "related", "ad", "sponsored", "promo"} else ARTICLE
    if tag not in ("body", "html") and (names & NAMES or (not inside and "header" in names)):
        return DROPPED
    if above == ARTICLE and any(NAMES.intersection(_PART.findall(x)) for x in names):
        return DOUBTFUL
    return above


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name, attributes) of each tag, and last the text after them with an empty name; a closing tag's name begins with /.

    Comments, declarations and what raw elements hold are one space; raw elements that nothing closes go on to the end.
    A value in quotes may hold tags. A tag that nothing ends is text. Each character is passed a bounded number of times.
    """
    find, size, at, text = page.find, len(page), 0, []
    open_quote = {'"': True, "'": True}  # whether such a quote is still to come

    def end_of(i: int) -> tuple[int, bool]:
        """From within a tag: where it ends, and whether it does."""
        while m := _STOP.search(page, i):
            c, i = m[0], m.end()
            if c == ">":
                return i, True
            if c == "<":
                return i - 1, False
            if open_quote[c]:
                j = find(c, i)
                if j < 0:
                    open_quote[c] = False
                else:
                    i = j + 1
        return size, False

    while (start := find("<", at)) >= 0:
        text.append(page[at:start])
        if page.startswith("<!--", start):
            stop = start + 5 if page.startswith("<!-->", start) else find("-->", start + 4) + 3
            at = stop if stop >= start + 5 else size
            text.append(" ")
            continue
        if page.startswith(("<!", "<?"), start):
            stop = find(">", start)
            at = stop + 1 if stop >= 0 else size
            text.append(" " if stop >= 0 else page[start:])
            continue
        named = _NAMED.match(page, start + 1)
        if not named:
            text.append("<")
            at = start + 1
            continue
        at, whole = end_of(named.end())
        if not whole:
            text.append(page[start:at])
            continue
        name, attributes = named[0].lower(), page[named.end() : at - 1]
        if name in _RAW:
            if not (name in ("svg", "math") and attributes.endswith("/")):
                closer = _CLOSERS[name].search(page, at)
                at = closer.end() if closer else size
            text.append(" ")
            continue
        yield "".join(text), name, attributes
        text.clear()
    text.append(page[at:])
    yield "".join(text), "", ""


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks that may be main text, in page order."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()  # how often each tag is in the stack
    kind, text, linked, in_link, any_article = OPEN, [], 0, 0, False

    def end() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words and kind != DROPPED:
                whole = " ".join(words)
                if kind in (ARTICLE, DOUBTFUL) or linked < 0.7 * len(whole):
                    out.append((whole, kind))
            text.clear()
        linked = 0

    def cut(i: int) -> None:
        for tag, _ in stack[i:]:
            held[tag] -= 1
        del stack[i:]

    for piece, name, attributes in tags(page):
        if piece and kind != DROPPED:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not name:
            break
        close = name[0] == "/"
        tag = name[1:] if close else name
        if tag == "a":
            in_link = not close
            continue
        if tag not in BLOCKS:
            if tag == "br":
                text.append(" ")
                continue
            if tag != "span":
                continue
        else:
            end()
            in_link = False
        if tag not in FOLLOWED:
            continue
        if close:
            if held[tag]:  # what it closes is left with all that is open inside
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag == "span" and stack[i][1] != kind:
                    end()
                kind = stack[i][1]
                cut(i)
            continue
        if tag == "body":
            if held["head"]:  # a head that isn't closed ends here
                i = next(i for i, (t, _) in enumerate(stack) if t == "head")
                kind = stack[i][1]
                cut(i)
        elif stack and tag in BLOCKS and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            kind = stack[-1][1]  # closed by what follows
            cut(len(stack) - 1)
        new = _kind(tag, attributes, kind)
        if tag == "span" and new != kind:
            end()
        if not (tag == "span" and new == kind):
            stack.append((tag, kind))
            held[tag] += 1
        kind = new
        any_article |= new == ARTICLE
    end()
    return [b for b in out if b[1] != OPEN] if any_article else out


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their suffixes' first depth tokens (a power of two), and whether each shares all of them with the one before."""
    rank, width, n = tokens.astype(np.int64), 1, len(tokens)
    while True:
        order = np.argsort(rank, kind="stable")
        same = np.concatenate(([False], rank[order[1:]] == rank[order[:-1]])) if n else np.empty(0, bool)
        if width >= depth:
            return order, same
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(~same)
        rank = fresh << 32 | np.concatenate((fresh[width:], np.zeros(min(width, n), np.int64)))
        width *= 2


Page = list[tuple[str, int]]


def content_of(page: Page) -> int:
    """A hash of a page's blocks that fits a signed long."""
    return xxhash.xxh64_intdigest("\0".join(f"{k}{t}" for t, k in page), 5) >> 1


def _run_codes(words: list[list[str]], host: str) -> np.ndarray:
    """For one page: by block and place, the code of the run that starts there, 0 at the last RUN - 1 places of a block and at its border."""
    sizes = [len(w) + 1 for w in words]
    total = sum(sizes)
    h = np.fromiter((x for w in words for x in (*map(xxhash.xxh64_intdigest, w), 0)), np.uint64, total)
    x = np.full(total, xxhash.xxh64_intdigest(host, 7), np.uint64)
    for k in range(RUN):
        x = (x ^ np.concatenate((h[k:], np.zeros(min(k, total), np.uint64)))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    left = np.concatenate([np.arange(n - 1, -1, -1) for n in sizes]) if sizes else np.empty(0, np.int64)
    return np.where(left >= RUN, x, np.uint64(0))


def _short_code(text: str, host: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{text}", 11)


def _is_short(text: str, kind: int) -> bool:
    return kind != ARTICLE and text.count(" ") < RUN - 1


def runs(pages: list[Page], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the runs and short blocks of a shard, with the least and the greatest content that has each."""
    ids: dict[tuple[str, str], int] = {}
    distinct = {(h, content_of(p)): p for p, h in zip(pages, hosts)}
    tokens, codes, contents, border = [], [], [], -1
    short: list[tuple[int, int]] = []
    for (host, content), page in distinct.items():
        words = [t.split(" ") for t, _ in page]
        for w in words:
            tokens += [ids.setdefault((host, t), len(ids)) for t in w]
            tokens.append(border)  # each border is unlike all other tokens
            border -= 1
        codes.append(_run_codes(words, host))
        contents.append(np.full(len(codes[-1]), content, np.int64))
        short += [(_short_code(t, host), content) for t, k in page if _is_short(t, k)]
    found = np.array([c for c, _ in short], np.uint64)
    content = np.array([c for _, c in short], np.int64)
    if tokens:
        order, same = suffix_array(np.unique(np.array(tokens, np.int64), return_inverse=True)[1], RUN)
        ordered, owners = np.concatenate(codes)[order], np.concatenate(contents)[order]
        first = np.flatnonzero(~same)
        low, high = np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
        whole = ordered[first] != 0
        found = np.concatenate((found, found, ordered[first][whole], ordered[first][whole]))
        content = np.concatenate((content, content, low[whole], high[whole]))
    each, place = np.unique(found, return_inverse=True)
    low, high = np.full(len(each), np.iinfo(np.int64).max), np.full(len(each), -1, np.int64)
    np.minimum.at(low, place, content)
    np.maximum.at(high, place, content)
    return each, low, high


def without(page: Page, host: str, shared: np.ndarray) -> str:
    """A page's text without the blocks' parts, outside articles, whose codes are shared (sorted)."""

    def met(codes: np.ndarray) -> np.ndarray:
        if not len(shared):
            return np.zeros(len(codes), bool)
        return shared[np.minimum(np.searchsorted(shared, codes), len(shared) - 1)] == codes

    words = [t.split(" ") for t, _ in page]
    codes = _run_codes(words, host)
    starts = np.flatnonzero((codes != 0) & met(codes))
    cover = np.zeros(len(codes) + RUN + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + RUN, -1)
    covered = np.cumsum(cover) > 0
    lines, at = [], 0
    for (t, k), w in zip(page, words):
        gone = covered[at : at + len(w)]
        at += len(w) + 1
        if k != ARTICLE and gone.any():
            t = " ".join(x for x, g in zip(w, gone.tolist()) if not g)
        elif _is_short(t, k) and met(np.array([_short_code(t, host)], np.uint64))[0]:
            t = ""
        if t:
            lines.append(t)
    return "\n".join(lines)


def unique_text(pages: list[Page]) -> list[str]:
    """Each page's text without the boilerplate that these pages of one host share."""
    codes, low, high = runs(pages, [""] * len(pages))
    return [without(p, "", codes[low < high]) for p in pages]


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2]


_PARSED = "page_id long, url string, host string, shard long, open boolean, texts array<string>, kinds array<tinyint>"
_TEXTS = "page_id long, url string, text string, n_chars long"


def _read(shard_pages: int):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shard", pa.int64()), ("open", pa.bool_()), ("texts", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for ident, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = blocks(page)
                opened = any(k != ARTICLE for _, k in found)
                if opened:
                    if held >= shard_pages or size > SHARD_TOKENS:
                        shard, held, size = shard + 1, 0, 0
                    held += 1
                    size += sum(t.count(" ") + 2 for t, _ in found)
                out.append((ident, url, host_of(url), shard, opened, [t for t, _ in found], [k for _, k in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return run


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, and of each run in it: code, low, high. Rows: host, shard, texts, kinds."""
    pages, hosts, shard, size = [], [], None, 0

    def done() -> pa.RecordBatch:
        codes, low, high = runs(pages, hosts)
        pages.clear()
        hosts.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), shard, np.int64)), pa.array(codes.view(np.int64)), pa.array(low), pa.array(high)], names=["shard", "code", "low", "high"])

    for batch in batches:
        for host, own, texts, kinds in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if pages and (own != shard or size > SHARD_TOKENS):
                yield done()
                size = 0
            shard = own
            pages.append(list(zip(texts, kinds)))
            hosts.append(host)
            size += sum(t.count(" ") + 2 for t in texts)
    if pages:
        yield done()


def _of(hosts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(hosts[batch.column(0).to_numpy()]))
            yield found.select(["host", "shard", "texts", "kinds"])

    return run


def _texts(idents: pa.Array, urls: pa.Array, texts: list[str]) -> list[pa.Array]:
    return [idents, urls, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(_texts(batch.column(0), batch.column(1), ["\n".join(x) for x in batch.column(2).to_pylist()]), names=["page_id", "url", "text", "n_chars"])


def _cut(pages: pa.Table, shared: pa.Table) -> pa.Table:
    codes = np.sort(shared.column("code").to_numpy().astype(np.int64).view(np.uint64))
    texts = [without(list(zip(t, k)), h, codes) for h, t, k in zip(*(pages.column(c).to_pylist() for c in ("host", "texts", "kinds")))]
    return pa.Table.from_arrays(_texts(pages.column("page_id").combine_chunks(), pages.column("url").combine_chunks(), texts), names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(_read(SHARD), _PARSED)
    rows = common.materialize(rows, "pages")
    opened, closed = rows.where("open"), rows.where("NOT open")
    told = opened.select("host", "shard", "texts", "kinds").mapInArrow(_tell, "shard long, code long, low long, high long")
    # A bitmap of the hosts with such pages: at most HOSTS bits come to the driver, and a host let through in vain changes nothing.
    bit = F.xxhash64("host").bitwiseAND(HOSTS - 1)
    hosts = np.zeros(HOSTS, bool)
    for at, bits in opened.groupBy(F.shiftright(bit, 6)).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64(host) & 63 AS int))"))).collect():
        hosts[at * 64 : at * 64 + 64] = [bits >> k & 1 for k in range(64)]
    if hosts.any():
        told_of = closed.select(bit.alias("bit"), "host", "shard", "texts", "kinds").mapInArrow(_of(hosts), "host string, shard long, texts array<string>, kinds array<tinyint>")
        evidence = told.union(told_of.mapInArrow(_tell, "shard long, code long, low long, high long"))
    else:
        evidence = told
    shared = evidence.groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("code")
    back = told.select("shard", "code").join(shared, "code").select("shard", "code")
    cut = opened.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(_cut, _TEXTS)
    return closed.select("page_id", "url", "texts").mapInArrow(_whole, _TEXTS).union(cut)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))


QUERIES = {"op1_html_text": op1_html_text}
ORACLE: dict[str, str] = {}
