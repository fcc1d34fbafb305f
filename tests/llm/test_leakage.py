import random

import numpy as np

from plumbline.llm import leakage

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def test_words():
    assert leakage.words("Éáb-C_d­9 STRASSE Straße ​x‍y") == ["eab", "c", "d9", "strasse", "strasse", "xy"]
    assert leakage.words("ASCII Only, it's_9") == ["ascii", "only", "it", "s", "9"] and leakage.words("") == []


def brute(docs, items, size):
    out = set()
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - size + 1):
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    for d, t in docs:
        w = leakage.words(t or "")
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + size]), ())}
    return out


def test_leaks_match_brute_force(spark):
    r = random.Random(1)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))) for i in range(40)] + [(900, None), (901, ""), (902, "short one")]
    items.append((903, items[0][1]))
    docs = []
    for d in range(300):
        parts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 80)))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items[:40])[1].split()
            a = r.randint(0, len(w) - 1)
            parts.append(" ".join(w[a : a + r.randint(3, 30)]).upper())
        docs.append((d, "\n".join(parts)))
    docs += [(1000, None), (1001, " "), (1002, ("x " * 50_000) + items[3][1] + " y" * 50_000), docs[5]]
    for block in (10**6, 60):
        df = leakage.leaked(spark.createDataFrame([(a, b, "q") for a, b in docs], "doc_id long, text string, item_id string").select("doc_id", "text"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 12, block)
        got = [(x["doc_id"], x["item_id"]) for x in df.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 12)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", empty, "item_id", "text").count() == 0


def test_tiles_cover_reordered_passages():
    passage = np.arange(1, 61)
    document = np.concatenate([passage[30:], [0], passage[:30], [0, 0], passage[10:25]])
    seeds = [(i, int(np.flatnonzero(passage == document[i])[0])) for i in range(len(document) - 11) if 0 not in document[i : i + 12] and np.array_equal(document[i : i + 12], passage[int(document[i]) - 1 : int(document[i]) + 11])]
    got = leakage.tiles(document, passage, seeds, 12)
    assert sorted(got) == [(0, 30, 30), (31, 0, 30)]  # the third part's words are covered already


def test_rolling_hash_is_the_same_anywhere():
    x = np.random.default_rng(1).integers(1, 2**62, 50, dtype=np.uint64)
    assert leakage.rolling(np.concatenate([x[:7], x]), 12)[7] == leakage.rolling(x, 12)[0]
    assert len(leakage.rolling(x[:5], 12)) == 0


def test_threshold_of_coverage_counts_reordered_parts(spark):
    w = WORDS[:60]
    docs = [(1, " ".join(w[30:] + ["between"] + w[:30])), (2, " ".join(w[:20])), (3, " ".join(WORDS[100:160]))]
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {x["doc_id"]: (x["covered"], x["tiles"]) for x in leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items, "item_id", "text", least_share=0.8).collect()}
    assert got == {1: (60, 2)}
