import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import divergence


def brute(rows, least):
    """From (doc_id, text, lang, source), the operator's rows."""
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for x, s in counts if x == lang]

        def p(count):
            whole = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // whole for t in kept}

        own = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - q[t]) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found in ("pair", pairs), ("term", terms):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(ranked[: 50 if part == "term" else None], 1)]
    return sorted(out)


def got(docs, least):
    return sorted(map(tuple, divergence.audit(docs, least=least).select("lang", "source", "part", "item", "value", "rank").collect()))


def prose(rng, n, words):
    return " ".join(rng.choice(words) + rng.choice(["", ",", "'s", "-x", "9", "\n"]) for _ in range(n))


@pytest.mark.parametrize("held,pairs,bucket", [(400_000, 1 << 22, 8192), (20, 10, 7)])
def test_all_rows(table, monkeypatch, held, pairs, bucket):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(held)
    words = ["the", "The", "é", "É", "straße", "日本", "a\x85b", "K", "x\xa0y"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    rows = [(k, prose(rng, rng.randint(0, 60), words[: rng.randint(5, len(words))]), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["hot", "hot", "b", "é", "z", None, ""])) for k in range(260)]
    rows += [(7, None, "en", "only null"), (7, "", "fr", "a"), (7, "123 .", "fr", "b"), (8, "one", "it", "alone"), (9, "long " * 200_000 + "tail", "en", "b"), (9, "long", "en", "b"), (9, "long", "en", "z")]
    assert got(table(rows), 3) == brute(rows, 3)


def test_ties_and_ranks(table):
    rows = [(k, " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "en", "many") for k in range(2)]
    rows += [(k, "filler " * 40, "en", s) for k in range(2) for s in ("c", "a", "b")]
    found = got(table(rows), 2)
    assert found == brute(rows, 2)
    assert max(r[5] for r in found if r[2] == "term") == 50
    assert [r[3] for r in sorted(found, key=lambda r: r[5]) if r[:3] == ("en", "a", "pair") and r[4] == 0] == ["b", "c"]


def test_no_rows(table):
    assert divergence.audit(table([(1, "x")]).limit(0)).collect() == []


def test_shares_are_exact():
    rng = random.Random(3)
    whole = [rng.randint(10, 9 * 10**15) for _ in range(2000)]
    counts = [rng.randint(0, w - 5) for w in whole]
    want = [1 + 10**9 * (c + 5) // w for c, w in zip(counts, whole)]
    assert divergence.shares(np.array(counts), np.array(whole)).tolist() == want
