"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import LOWER, documents

from plumbline.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    """Sorted (item_id, rank, doc_id, score) by scoring every pair."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // length
            score = 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    df = documents(spark, [t for _, t in docs], ids=[i for i, _ in docs]).withColumnRenamed("shard", "m")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, class int")
    return sorted(map(tuple, lexical_search.search(df, asked, **options).collect()), key=repr)


def random_tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20 + ["É", "é", "ÀB", "x-y", "3.5"]

    def said(n):
        return " ".join(rng.choice(words) for _ in range(n))

    bases = [said(rng.randint(1, 40)) for _ in range(30)]
    # copies, copies in capitals, and copies with words that no item asks for
    texts = [rng.choice(bases) for _ in range(150)] + [b.upper() for b in bases] + [b + " zz" for b in bases]
    texts += [said(3000), "", None, "...", "the"] + ["the w1"] * 60
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts)) + [(None, bases[0]), (ids[0], "w2 w3"), (ids[0], "w2 w3")]
    items = [(i, said(rng.randint(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "nobody says this")]
    return docs, items + [(53, "the w1"), (None, "w1 w1 w1 w2"), (53, "the w1")]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed):
    docs, items = random_tables(seed)
    want = plain(docs, items)
    assert len(want) > 150
    assert found(spark, docs, items) == want


def test_blocks_of_items(spark):
    docs, items = random_tables(2)
    assert found(spark, docs, items, k=5, block_terms=20) == plain(docs, items, k=5)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(0, "other")] * 50 + [(-5, "Same, words; here!")]
    got = found(spark, docs, [(9, "same here")])
    assert [(r, i) for _, r, i, _ in sorted(got, key=lambda x: x[1])] == [(r, i) for r, i in zip(range(1, 21), [-5, *range(1, 20)])]


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert found(spark, [(1, "a")], [(1, None)]) == []


def test_best_classes_of_a_task():
    rng = np.random.default_rng(4)
    best, rows = lexical_search._Best(3, 4), []
    for _ in range(40):
        item, score, first = rng.integers(0, 3, 700), rng.integers(1, 40, 700), rng.integers(0, 10**6, 700)
        may = score >= best.least[item]
        rows += zip(item.tolist(), (-score).tolist(), first.tolist())
        best.add(item[may], score[may], first[may], lambda places: [])
    got = best.columns
    want = [r for i in range(3) for r in sorted(r for r in rows if r[0] == i)[:4]]
    assert [(i, -s, f) for i, s, f in zip(*(c.tolist() for c in got))] == want
