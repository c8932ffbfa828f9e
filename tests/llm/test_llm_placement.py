"""Sharding and mixing."""

import re
import zlib

import numpy as np
import pytest
from llm_cases import documents, table_rows

from plumbline.llm import mixing, queries, sharding


def test_shards_of_documents(spark, sf_dir):
    rows = queries.QUERIES["op3_sharding"](spark, sf_dir).collect()
    texts = dict(table_rows(spark, sf_dir, "documents", "doc_id", "text"))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(40))
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        by_slot = [r.doc_id for r in sorted(own, key=lambda r: r.slot)]
        assert by_slot == sorted(by_slot)


def test_shards_are_even_and_keep_copies_together(spark):
    rng = np.random.default_rng(3)
    texts = [f"{'word ' * int(n)}{k}" for k, n in enumerate(rng.integers(1, 60, 3000))]
    # groups of copies under several sources, and one that is larger than a shard
    texts += [f"copy {k % 100}" * 3 for k in range(1000)] + ["same text of many copies " * 8] * 1500
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    docs = documents(spark, texts, sources=["hot" if k % 3 else f"s{k % 20}" for k in range(len(texts))])
    rows = sharding.shard_documents(docs, 7).collect()
    sizes = np.bincount([r.shard for r in rows], weights=[r.size for r in rows], minlength=7)
    assert sizes.max() - sizes.min() < 0.03 * sizes.mean()
    places, held = {}, {}
    for r in rows:
        places.setdefault(texts[r.doc_id], set()).add(r.shard)
        held[texts[r.doc_id]] = held.get(texts[r.doc_id], 0) + r.size
    assert max(held.values()) > sizes.mean()
    assert {t for t, shards in places.items() if len(shards) > 1} == {t for t, n in held.items() if n > sizes.mean()}


def test_copies_share_a_shard(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = dict(table_rows(spark, sf_dir, "documents", "doc_id", "text"))
    places = {}
    for r in queries.QUERIES["op3_sharding"](spark, sf_dir).collect():
        places.setdefault(texts[r.doc_id], []).append(r.shard)
    groups = [shards for shards in places.values() if len(shards) > 1]
    assert len(groups) > 50 and all(len(set(shards)) == 1 for shards in groups)


def test_shards_of_odd_tables(spark):
    docs = documents(spark, [None, "", "a", "a"], ids=[None, 1, 2, 2], sources=[None] * 4)
    rows = sharding.shard_documents(docs, 3).collect()
    assert sorted(r.size for r in rows) == [16, 16, 17, 17]
    assert sharding.shard_documents(documents(spark, []), 5).collect() == []
    assert {r.shard for r in sharding.shard_documents(docs, 1).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


def test_water_fill():
    assert mixing.water_fill([10, 10], [1, 1], 3) == [10, 10]
    assert mixing.water_fill([1, 99], [5, 2], 3) == [3, 97]
    assert mixing.water_fill([1, 1, 98], [5, 2, 1], 3) == [3, 3, 94]
    assert mixing.water_fill([0, 5], [5, 2], 3) == [0, 5]
    assert mixing.water_fill([], [], 3) == []


def test_fit_budget_is_exact_where_it_can_be():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 400, 30))
        counts = rng.integers(1, 9, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(budget - (lengths * taken).sum()) <= 2 or budget < 400
    even = mixing.fit_budget(np.array([10, 20]), np.array([5, 5]), 77)
    assert even @ [10, 20] == 80
    # one long document: repeating the short ones comes nearer than any subset
    few = mixing.fit_source(np.array([30, 50, 3000]), np.array([1, 1, 1]), 200, 3)
    assert abs(few @ [30, 50, 3000] - 200) <= 10 and (few <= 3).all()


@pytest.mark.parametrize("scale", [1, 10, 1000, 100_000])
def test_fit_source_does_not_depend_on_scale(scale):
    lengths, counts = np.array([100, 10_000]) * scale, np.array([30, 1])
    assert mixing.fit_source(lengths, counts, 9_000 * scale, 3).tolist() == [90, 0]
    # off any common measure: fifteen short ones and long ones above the rest
    lengths = np.array([97, 101, 9_973, 10_007]) * scale + np.array([1, 2, 3, 4])
    counts = np.array([8, 7, 1, 1])
    for target in (9_000, 12_000, 22_000, 31_000):
        taken = mixing.fit_source(lengths, counts, target * scale, 3)
        sums = [
            lengths @ [a, b, c, d] for a in range(25) for b in range(22) for c in range(4) for d in range(4)
        ]
        best = min(abs(int(x) - target * scale) for x in sums)
        assert (taken >= 0).all() and (taken <= 3 * counts).all()
        assert abs(int(lengths @ taken) - target * scale) <= best + 2 * target * scale / mixing.KNAPSACK


def test_fit_source_meets_large_targets_to_the_word():
    rng = np.random.default_rng(11)
    lengths = np.unique(np.append(rng.integers(100, 1_200, 60), [400_000, 900_000]))
    counts = np.ones(len(lengths), dtype=np.int64)
    for target in (70_000, 95_000, 440_000, 1_000_003, 1_234_567):
        taken = mixing.fit_source(lengths, counts, target, 3)
        assert int(lengths @ taken) == target and (taken <= 3).all()


def test_fit_budget_gives_the_knapsack_the_true_rest():
    lengths, counts = np.array([140_000, 200_000]), np.array([1, 1])
    assert mixing.fit_budget(lengths, counts, 80_000).tolist() == [1, 0]


def test_mix(spark, sf_dir):
    rows = queries.QUERIES["op4_mixing"](spark, sf_dir).collect()
    texts = {i: (t, s) for i, t, s in table_rows(spark, sf_dir, "documents", "doc_id", "text", "source")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in texts.items()}
    sources = sorted({s for _, s in texts.values()}, key=lambda s: s.encode())
    sums = [sum(size[i] for i in texts if texts[i][1] == s) for s in sources]
    targets = dict(zip(sources, mixing.water_fill(sums, [(5, 2, 1)[k % 3] for k in range(len(sources))], 3)))
    taken = dict.fromkeys(sources, 0)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert r.target == pytest.approx(targets[texts[r.doc_id][1]])
        taken[texts[r.doc_id][1]] += r.taken
    for s in sources:
        assert abs(taken[s] - targets[s]) <= max(2, 0.02 * targets[s])  # sources of ten documents
    again = queries.QUERIES["op4_mixing"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_tables(spark):
    docs = documents(spark, [None, "", "a b", "a b", "c"], ids=[1, 2, 3, 3, None], sources=[None, "x", "x", "x", None])
    rows = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 1, 2, 2]
    targets = {r["source"]: (r["source_size"], round(r["target"], 6)) for r in rows}
    assert targets == {"x": (4, 3.571429), None: (1, 1.428571)}
    assert sum(r["taken"] for r in rows if r["source"] is None) == 1
    assert mixing.mix(documents(spark, [])).collect() == []
    assert {r["taken"] for r in mixing.mix(documents(spark, ["", None])).collect()} == {0}
