from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import exact_dedup, quality, repeats, simhash


def test_stages_take_effect(spark, table):
    long = " ".join(f"w{k * k % 977}" for k in range(300))
    passage = " ".join(f"p{k * k % 997}" for k in range(120))
    rows = [(1, long), (1, long), (2, long.replace(" ", "\n", 1)), (3, "too short"), (4, passage + " first tail " + " ".join(f"q{k}" for k in range(200))), (5, " ".join(f"r{k}" for k in range(200)) + " " + passage), (None, " ".join(f"s{k}" for k in range(30))), (6, None)]
    docs = table(rows)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "simhash_dedup", "repeats", "packing"]
    kept = steps["quality_rules"](spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "4", "5", "None"]
    one = steps["exact_dedup"](spark, kept, "")
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "4", "5", "None"]
    near = steps["simhash_dedup"](spark, one, "")
    cut = steps["repeats"](spark, near, "")
    for frame in (kept, one, near, cut):
        assert frame.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert passage[10:300] not in texts[4][0] and texts[4][1] == len(texts[4][0]) and texts[1][0] == long
    assert {r["doc_id"] for r in steps["packing"](spark, cut, "").collect()} == {1, 4, 5, None}
    for stage in list(steps.values()):
        assert stage(spark, docs.limit(0), "").collect() == []


def test_stages_match_their_operators(spark):
    """The pipeline's rows on the small tables against the operators' own verdicts, stage by stage."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    a = docs.join(quality.judge(docs).where("kept").select("doc_id"), "doc_id")
    b = a.join(exact_dedup.owners(a).where("kept").select("doc_id"), "doc_id")
    c = b.join(simhash.near_duplicates(b).where("doc_id = component_id").select("doc_id"), "doc_id")
    bytes_left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in repeats.measure(c, length=corpus_pipeline.WINDOW).collect()}
    last = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        last = stage(spark, last, d)
    got = {r["doc_id"]: len(r["text"].encode()) for r in last.collect()}
    assert got.keys() == bytes_left.keys()
    assert all(0 <= bytes_left[k] - n <= 6 * 8 for k, n in got.items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == got.keys()


def test_clashing_names_and_very_long_texts(spark, table):
    long = " ".join(f"w{k}" for k in range(250_000))
    rows = [(1, long), (2, long + " more"), (3, " ".join(f"v{k}" for k in range(100))), (4, None)]
    names = ("__id", "__text", "__body", "__ident", "__hash", "__spans", "__at", "__bits", "u", "v", "m")
    docs = table(rows)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    last = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        last = stage(spark, last, "")
        assert last.columns == docs.columns
    got = {r["doc_id"]: r for r in last.collect()}
    assert set(got) == {1, 3} and got[1]["text"] == long and got[3]["text"] == rows[2][1]
    assert all(r[n] == f"{n}{i}" for i, r in got.items() for n in names)
    pieces = dict(corpus_pipeline.STAGES)["packing"](spark, last, "").collect()
    assert {r["doc_id"] for r in pieces} == {1, 3}


def test_one_of_rows_that_share_an_id_stays(spark, table):
    base = " ".join(f"w{k * k % 977}" for k in range(300))
    rows = [(3, base), (3, base + " word"), (5, base + " more"), (3, " ".join(f"u{k}" for k in range(100))), (None, " ".join(f"v{k}" for k in range(100)))]
    got = corpus_pipeline.near(spark, table(rows), "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None"]
    assert sum(r["text"].startswith("w") for r in got) == 1


def test_passages_of_over_fifty_words_go(spark, table):
    """Passages planted in documents of their own words, by length; those of over 50 words go whatever they hold."""
    import random

    rng = random.Random(7)
    word = lambda low, high: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
    planted = {n: " ".join(word(1, 6) for _ in range(n)) for n in (20, 51, 60, 100)}
    rows = [(10 * n + k, " ".join(word(3, 9) for _ in range(80)) + f" {passage} " + " ".join(word(3, 9) for _ in range(80))) for n, passage in planted.items() for k in range(3)]
    rows += [(k, " ".join(word(3, 9) for _ in range(120))) for k in range(5)]
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, table(rows), "").collect()}
    for n, passage in planted.items():
        for k in range(3):
            assert (passage in texts[10 * n + k]) == (n == 20)
    assert all(texts[i] == t for i, t in rows if i < 5)
