import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, quality, suffix_tree_lm, toxicity

SF = "/root/testdata/sf0.01"


# ---- language -------------------------------------------------------------------------------------------------------
def test_language_accuracy(spark):
    got = langid.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(table):
    rows = [(None, "the cat and the dog of this", "en", None), (1, None, "en", None), (2, "", "en", None), (3, "123 !!", "fr", None), (4, "le chat et le chien", "fr", None), (4, "le chat et le chien", "fr", None), (5, "der hund und die katze", None, None), (6, "the end of the day " * 5000, "en", None)]
    docs = table(rows)
    out = langid.predict(docs, langid.train(docs, F.lit(True))).collect()
    assert len(out) == 8
    by = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in out}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "fr" and by[6][0] == "en"
    alone = table([(1, "the cat", "en", None), (2, "7", "en", None)])
    assert sorted(r["lang_pred"] for r in langid.predict(alone, langid.train(alone, F.lit(True))).collect()) == ["en", "und"]
    nothing = table([(1, "the cat", None, None)])
    assert langid.train(nothing, F.lit(True)) is None
    assert [r["lang_pred"] for r in langid.predict(nothing, None).collect()] == ["und"]
    assert langid.predict(docs.limit(0), None).collect() == []


def test_languages_that_tie_and_very_long_texts(table):
    """Two languages with the same texts: the one that sorts first is told, everywhere alike; a text of two million letters is told as its sentence is."""
    rows = [(k, "the cat and the dog of this", "en" if k % 2 else "zz", None) for k in range(20)] + [(50 + k, "le chat et le chien dans la maison", "fr", None) for k in range(6)]
    model = langid.train(table(rows), F.lit(True))
    asked = table([(1, "the cat and the dog of this"), (2, "the cat and the dog of this"), (3, "le chat et le chien dans la maison " * 60_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked.repartition(3), model).collect()}
    assert got[1] == got[2] and got[1][0] in ("en", "zz") and got[3][0] == "fr"


def plain_prediction(model, v):
    """Family, votes and score again, in plain loops."""
    dot = lambda w: sum(float(a) * float(b) for a, b in zip(w[:-1], v)) + float(w[-1])
    sure = lambda m: 1 / (1 + math.exp(-3 * m))
    score, family = 1.0, 0
    if model.rest is not None:
        margins = [dot(w) for w in model.rest]
        family = margins.index(max(margins))
        score = sure(margins[family])
    won, least = {}, {}
    for a in model.families[family]:
        duels = [dot(model.pairs[a, b]) if (a, b) in model.pairs else -dot(model.pairs[b, a]) for b in model.families[family] if b != a]
        won[a], least[a] = sum(d >= 0 if (a, b) in model.pairs else d > 0 for d, b in zip(duels, [b for b in model.families[family] if b != a])), min(duels, default=math.inf)
    best = max(model.families[family], key=lambda n: (won[n], least[n]))
    return best, score * (sure(least[best]) if len(won) > 1 else 1.0)


def test_predictions_in_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    assert sorted(x for f in model.families for x in f) == sorted({r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]})
    for r in docs.limit(80).collect():
        v = langid.features(r["text"])
        if v is not None:
            (lang, score), (want, sure) = model.predict(v), plain_prediction(model, v)
            assert lang == want and abs(score - sure) < 1e-5


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 > 0, 1.0, -1.0)
    w = langid.svm(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


# ---- toxicity -------------------------------------------------------------------------------------------------------
def test_fold():
    assert toxicity.fold("IDIOT, 1d10t! іdіоt $cum tr@sh id​iot ｍｏｒｏｎ 2020 ok!!") == " idiot idiot idiot scum trash idiot moron ok "
    assert toxicity.fold(None) == "  " and toxicity.fold("") == "  "


def test_toxicity_held_out(spark):
    got = toxicity.op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in got)
    assert hits[0, 1] <= 2 and hits[1, 1] >= 0.7 * (hits[1, 0] + hits[1, 1])
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_that_tie_and_very_long_texts(spark, table):
    """Words that toxic and other documents hold alike say nothing; labels that a document has twice count as the worse; two megabytes are scored."""
    rows = [(k, "same words in each of them " + ("vile" if k % 2 else "kind") + f" w{k % 7}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 0), (2, 0)], "doc_id long, toxic int")
    scorer = toxicity.train(table(rows), labels, F.lit(True))
    asked = table([(1, "same words in each of them"), (2, "vile " * 400_000), (3, "kind " * 400_000), (4, None), (5, "")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(asked, scorer).collect()}
    assert got[1] == got[3] == got[4] == got[5] < 0.5 < got[2] <= 1
    even = spark.createDataFrame([(k, k // 2 % 2) for k in range(60)], "doc_id long, toxic int")
    assert not toxicity.train(table([(k, "all alike") for k in range(60)]), even, F.lit(True)).lexicon


def plain_score(scorer, total, density):
    b, x, y = scorer.weights
    return 1 / (1 + math.exp(-(b + x * math.log(1 + total) + y * math.log(1 + 100 * density))))


def test_logistic_score_in_plain_arithmetic():
    scorer = toxicity.Scorer({"vile": 2.0})
    scorer.weights = (-2.0, 1.5, 0.25)
    for total, density in ((0.0, 0.0), (3.0, 0.2), (40.0, 1.0)):
        assert abs(scorer.score(total, density) - plain_score(scorer, total, density)) < 1e-12


def test_fit_is_at_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.random((300, 2)) * [5, 0.3]
    y = (rng.random(300) < 1 / (1 + np.exp(3 - 2 * np.log1p(x[:, 0]) - np.log1p(100 * x[:, 1]) / 3))).astype(float)
    w = np.array(toxicity.fit(x, y))
    z = np.column_stack((np.ones(300), np.log1p(x[:, 0]), np.log1p(100 * x[:, 1])))
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - np.array([1e-6, 0.05, 0.05]) * w
    assert (np.abs(slope[w > 0]) < 1e-6).all() and abs(slope[0]) < 1e-6


def test_lexicon_and_exceptions(spark, table):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["one", "two", "three", "four"]) + str(rng.choice("abcdef")) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        extra = " badword" + rng.choice(["s", "ed", ""]) if toxic else " not vexing" if k % 4 == 1 else ""
        extra += " vexing" if toxic and k % 8 == 0 else ""
        rows.append((k, prose(20) + extra + " " + prose(20)))
        labels.append((k, 0, int(toxic)))
    labels += [(0, 0, 0), (9999, 1, 1), (None, 1, 1), (5, 1, None)]
    docs = table([*rows, (None, "badword"), (500, None), (501, "b4dw0rd " * 3), (1, rows[1][1])])
    scorer = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert "badword" in scorer.lexicon
    out = {}
    for r in toxicity.score(docs, scorer).collect():
        out.setdefault(r["doc_id"], r["score"])
    assert out[0] > 0.7 > out[1] and out[501] > 0.7 and out[500] < 0.3 and out[None] > 0.7
    none = toxicity.train(docs, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_hits_and_measure_by_brute_force():
    """All stems at word starts, the longest of those that start together, less those in exception phrases."""
    rng = random.Random(8)
    stems = ["ab", "abc", "abcd", "b", "ca", "cab"]
    lexicon = {s: 1.0 + k for k, s in enumerate(stems)}
    exceptions = frozenset({"x ab", "cab y", "b x"})
    scorer = toxicity.Scorer(lexicon, exceptions, (-2.0, 1.5, 0.5))
    for _ in range(500):
        words = [rng.choice(["ab", "abcde", "abce", "xab", "cabby", "cab", "x", "y", "b", "ca"]) for _ in range(rng.randint(0, 12))]
        total = 0.0
        for i, w in enumerate(words):
            met = [s for s in stems if w.startswith(s)]
            if met:
                s = max(met, key=len)
                before = f"{words[i - 1]} {s}" if i else ""
                after = f"{s} {words[i + 1]}" if i + 1 < len(words) else ""
                total += 0.0 if before in exceptions or after in exceptions else lexicon[s]
        got = scorer.measure(" ".join(words).upper())
        assert math.isclose(got[0], total) and math.isclose(got[1], total / max(1, len(words)))
        a, b, c = scorer.weights
        assert math.isclose(scorer.score(*got), 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * got[1])))))


def test_lexicon_has_no_cap():
    counts = [(f"st{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}", 0, 60) for k in range(7000)]
    assert len(toxicity.choose(counts, 5000, 1000, 50_000)) == 7000


# ---- language model -------------------------------------------------------------------------------------------------
def scored(docs, where):
    tree, vocab = suffix_tree_lm.train(docs.where(where).select("text"))
    return tree, suffix_tree_lm.score(docs, tree, vocab).collect()


def test_model_counts_and_contexts(table):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["New York", "new delhi", "old Rome"]) for _ in range(30))) for k in range(60)] + [(None, None), (61, ""), (62, "unseen york"), (0, rows0 := "new york")]
    docs = table(rows)
    tree, out = scored(docs, "doc_id < 50 OR doc_id IS NULL")
    c = Counter()
    for i, t in rows:
        if i is None or i < 50:
            c.update((t or "").lower().split())
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in out if r["doc_id"] != 0}
    for i, t in rows:
        if i == 0:
            continue
        words = [*(t or "").lower().split(), "\n"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in c for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), abs_tol=1e-9)
    assert tree.depth >= 1  # "new" and "old" say what follows
    held = [got[k] for k in range(50, 60)]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.8
    assert len([r for r in out if r["doc_id"] == 0]) == 2


def brute_model(train):
    """By plain dictionaries: what gives each token of a text its probability."""
    read = lambda t: [*(t or "").lower().split(), "\n"]
    c = Counter(w for t in train for w in read(t))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    unknown = discount * v / n / max(1, v, once * once / (2 * twice + 1))
    root = lambda w: (c[w] - discount) / n if w in c else unknown
    often, levels, chance = {(w,): k for w, k in c.items()}, [], None
    for level in range(1, suffix_tree_lm.DEPTH + 1):
        seen = {}
        for t in train:
            seq = ["\n", *read(t)]
            for i in range(level - 1, len(seq) - 1):
                context = tuple(seq[i + 1 - level : i + 1])
                if often.get(context, 0) >= suffix_tree_lm.LEAST:
                    seen.setdefault(context, Counter())[seq[i + 1]] += 1
        new, often, state = {}, {}, {}
        for context, counts in seen.items():
            total, kinds = sum(counts.values()), len(counts)
            told = {w: k for w, k in counts.items() if k >= suffix_tree_lm.SEEN}
            if total < suffix_tree_lm.LEAST or not told:
                continue
            low = total - sum(told.values())
            q = {w: chance[(*context[1:], w)] if chance is not None else root(w) for w in told}
            gain = sum(k * math.log((k - 1 + (kinds + low) * q[w]) / (total - 1 + kinds) / q[w]) for w, k in told.items())
            gain += low * math.log(max(kinds + low - 2, 1e-300) / (total + kinds - 2)) if low else 0
            kept, keep = gain > suffix_tree_lm.GAIN * total, (kinds + low) / (total + kinds)
            if kept:
                state[context] = (keep, {w: k / (total + kinds) for w, k in told.items()})
            for w, k in told.items():
                new[(*context, w)] = k / (total + kinds) + keep * q[w] if kept else q[w]
                often[(*context, w)] = k
        chance = new
        levels.append(state)
        if not any(k >= suffix_tree_lm.LEAST for k in often.values()):
            break

    def chances(text):
        seq, out = ["\n", *read(text)], []
        for i in range(len(seq) - 1):
            p = root(seq[i + 1])
            for level, state in enumerate(levels[: i + 1], 1):
                found = state.get(tuple(seq[i + 1 - level : i + 1]))
                if found:
                    p = p * found[0] + found[1].get(seq[i + 1], 0.0)
            out.append(p)
        return out

    return chances, levels, c


@pytest.mark.parametrize("small", [False, True])
def test_score_by_brute_force(table, monkeypatch, small):
    if small:  # small parts of everything: buckets, flushes, groups, hot contexts
        for name, value in (("FLUSH", 20), ("BUCKET", 300), ("ANSWERS", 50), ("GROUP", 7000), ("CHUNK", 700), ("BITS", 1 << 10)):
            monkeypatch.setattr(suffix_tree_lm, name, value)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["a b c", "a b d", "x y", "x z b", "q"]) + rng.choice(["", f" r{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 25)))
    rows = [(k, text()) for k in range(150)] + [(150, None), (151, "a b unseen c"), (152, "a b " * 4000)]
    rows += [(160, rows[3][1])] * 2
    tree, out = scored(table(rows), "doc_id < 120 OR doc_id = 152")
    chances, levels, _ = brute_model([t for k, t in rows if k < 120 or k == 152])
    assert tree.depth == len(levels) and sum(map(len, levels)) > 5 and len(levels[2]) > 0
    want = [(k, sum(map(math.log10, chances(t)))) for k, t in rows]
    got = sorted((r["doc_id"], r["score"]) for r in out)
    assert len(got) == len(want)
    assert all(i == j and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for (i, a), (j, b) in zip(got, sorted(want)))


def test_probabilities_sum_to_one():
    """Over all known words; the unknown ones have the rest."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    train = [" ".join(rng.choice(words[j % 5 :: 5]) for j in range(20)) for _ in range(100)]
    chances, levels, c = brute_model(train)
    assert len(levels) > 1
    for text in (train[0], "w1 w7", ""):
        p = sum(chances(f"{text} {w}".strip())[len(text.split())] for w in c if w != "\n") + chances(text)[-1]
        assert 0.9 < p <= 1 + 1e-9


def test_codes_are_found():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 1000):
        codes = np.unique(np.concatenate((rng.integers(0, 1 << 64, n, dtype=np.uint64), np.array([0, (1 << 64) - 1][: min(n, 2)], np.uint64))))
        held = suffix_tree_lm.Codes(codes, np.arange(len(codes), dtype=float))
        asked = np.concatenate((codes, rng.integers(0, 1 << 64, 500, dtype=np.uint64)))
        at = {x: k for k, x in enumerate(codes.tolist())}
        assert held.get(asked, -1.0).tolist() == [float(at.get(x, -1)) for x in asked.tolist()]


def test_nothing_to_learn_from(table):
    docs = table([(1, "a b"), (2, None)])
    tree, out = scored(docs, "false")
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == [(1, 0, 0), (3, 0, 0)]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in out)
    assert suffix_tree_lm.score(docs.limit(0), tree, suffix_tree_lm.train(docs.select("text"))[1]).collect() == []


def test_contexts_by_count_whatever_the_corpus(table):
    """A context met some dozen times says what follows, however much else there is, and to a depth of three."""
    rng = random.Random(5)
    phrase = lambda k: rng.choice(["left red stone gate", "right red stone wall"]) + f" f{k}a f{k}b f{k}c f{k}d"
    filler = [(k, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(500))) for k in range(200)]
    rows = filler + [(1000 + k, phrase(k)) for k in range(40)] + [(5000, "left red stone gate"), (5001, "left red stone wall")]
    docs = table(rows)
    tree, out = scored(docs, "doc_id < 5000")
    got = {r["doc_id"]: r["score"] for r in out}
    assert tree.depth >= 3
    assert got[5000] > got[5001] + 0.5
    assert got[5000] > -9  # the root alone gives about -16


# ---- quality --------------------------------------------------------------------------------------------------------
def brute_repeats(words):
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)})


def test_repeated_words():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_depleted_documents_go(table):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    common = words("c", 15)
    rows = [(k, f"{words(k, 40)}\n{common.upper()}", None, "h") for k in range(30)] + [(50, common, None, "h"), (51, common, None, "other"), (52, words(52, 30), None, None), (None, words(53, 12), None, "h"), (54, None, None, "h"), (55, "", None, None), (56, "a b", None, "h")]
    rows += [(60, words(60, 30), None, "h")] * 40  # copies are one content
    got = [(r["doc_id"], r["kept"], r["n_words"]) for r in quality.judge(table(rows)).collect()]
    kept = {i: k for i, k, _ in got}
    assert len(got) == len(rows)
    assert all(kept[k] for k in range(30)) and not kept[50] and kept[51] and kept[52] and kept[None] and kept[60]
    assert not kept[54] and not kept[55] and not kept[56]
    assert quality.judge(table(rows).limit(0)).collect() == []


def test_very_long_texts_and_lines(table):
    """A text of 300,000 words, two of its lines a megabyte long, measured as by hand."""
    line = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, line + "\n" + "one two\n" * 5 + line), (2, None), (3, "x" * 1_000_000)]
    got = {r["doc_id"]: r for r in quality.judge(table(rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_dup_lines"]) == (300_010, 5) and got[1]["n_repeat_words"] == 300_010 and not got[1]["kept"]
    assert (got[2]["n_words"], got[2]["kept"]) == (0, False) and (got[3]["n_words"], got[3]["word_chars"]) == (1, 1_000_000)


def test_a_very_long_text_is_scored_as_its_parts(table):
    """A text of 300,000 words: rows with the same words have the same score."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 50)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "w1 w2")]
    docs = table(rows)
    tree, facts = suffix_tree_lm.train(docs.where("doc_id = 1").select("text"))
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(docs, tree, facts).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 300_001 and got[1]["score"] == got[2]["score"] and math.isfinite(got[1]["score"])
    assert got[1]["score"] > got[1]["base_score"] * 1.05 and got[3]["n_tokens"] == 3
