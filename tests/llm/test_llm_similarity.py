"""Jaccard join, line dedup and the graph engine below them."""

import random

import numpy as np
import pytest
from llm_cases import documents, edit_distance, jaccard_classes, table_rows, union_find

from plumbline.llm import graph, jaccard_join, line_dedup, queries


def as_classes(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_jaccard_join_against_all_pairs(spark, sf_dir):
    rows = table_rows(spark, sf_dir, "documents", "doc_id", "text")
    assert as_classes(queries.QUERIES["op5_jaccard_join"](spark, sf_dir)) == jaccard_classes(rows, 4, 85)


def test_jaccard_join_at_the_edges(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    texts = [None, "", " \t\n", "one two", "ONE two", "one two three", "É x y z", "é x y z"]
    for k in range(120):  # a large group of near copies, chained
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(60)] = f"v{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += ["long " * 30_000, "la " * 5 + "end"]
    docs = documents(spark, texts)
    for k, percent in ((5, 80), (4, 85), (1, 100)):
        got = as_classes(jaccard_join.near_duplicates(docs, k, percent))
        assert got == jaccard_classes(list(enumerate(texts)), k, percent)


def test_jaccard_join_of_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "x", "a b c d e"], ids=[4, 4, None, None])
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(4, 1, 4), (4, 1, 4), (None, 1, None), (None, 1, 4)], key=repr)
    assert jaccard_join.near_duplicates(documents(spark, [])).collect() == []


def test_filed_keys_meet_for_all_similar_sets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, percent = int(rng.integers(1, 400)), int(rng.choice([80, 85, 90]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        most = jaccard_join.most_difference(2 * len(a), percent)
        gone, new = (int(v) for v in rng.multinomial(rng.integers(0, most + 1), [0.5, 0.5]))
        b = np.unique(np.append(a[min(gone, len(a) - 1) :], rng.integers(0, 1 << 63, new).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            keys = [set(jaccard_join._filed_keys(s, percent).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(500, 560)]
    found = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    root = union_find(nodes, [x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in found} == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rtree_pairs_are_those_within_the_bound():
    rng = np.random.default_rng(4)
    points = np.repeat(rng.integers(0, 20, (40, 8)), 5, axis=0) + rng.integers(0, 3, (200, 8))
    points[:3] += 300
    points = np.minimum(points, 255).astype(np.uint8)
    sizes = points.sum(axis=1).astype(np.int64)

    def need(a, b):
        return (a + b) * 45 // 100

    i, j, over = graph.rtree_pairs(points[:90], sizes[:90], points[90:], sizes[90:], need)
    bound = graph.overlap_bound(points[:90, None], points[None, 90:])
    want = np.nonzero(bound >= need(sizes[:90, None], sizes[None, 90:]))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(w.tolist() for w in want)))
    assert (over == bound[i, j] - need(sizes[:90][i], sizes[90:][j])).all()


def test_open_buckets_are_joined_block_by_block(spark, monkeypatch):
    """One bucket for all: every link between components must be found, with blocks of few members."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    values = [random.Random(9).randrange(4000) for _ in range(150)]
    nodes = spark.createDataFrame([(k,) for k in range(150)], "node long")
    members = nodes.selectExpr("node", "7L AS key")
    points = nodes.selectExpr("node", "10L AS size", "cast('aa' AS binary) AS point")
    table = spark.createDataFrame(list(enumerate(values)), "id long, v long")

    def verify(pairs, _nodes):
        a, b = (table.withColumnsRenamed({"id": c, "v": f"v{c}"}) for c in "ab")
        return pairs.join(a, "a").join(b, "b").filter("abs(va - vb) <= 40").select("a", "b")

    found = graph.linked_classes(members, points, 2, lambda a, b: 0 * (a + b), verify).collect()
    links = [(a, b) for a in range(150) for b in range(a) if abs(values[a] - values[b]) <= 40]
    root = union_find(range(150), links)
    assert {r.node: r.root for r in found} == {k: v for k, v in root.items() if any(k in x for x in links)}


def test_live_members_over_batch_edges(spark):
    rows = [(k // 7, k % 7 if k % 3 else 0) for k in range(20_000)] + [(-1, 5), (-2, 6), (-2, 6)]
    rows += [(99_999, k) for k in range(25_000)]
    got = graph.live_members(spark.createDataFrame(rows, "key long, node long").coalesce(1)).collect()
    groups = {}
    for key, node in rows:
        groups.setdefault(key, set()).add(node)
    want = {(k, n, min(g)) for k, g in groups.items() if len(g) > 1 for n in g}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_banded_edit_distance(threshold):
    rng, left, right = random.Random(threshold), [], []
    for _ in range(700):
        a = [rng.choice("abé") for _ in range(rng.randint(10, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 1)
        left.append("".join(a))
        right.append("".join(b))
    want = [edit_distance(a, b) <= threshold for a, b in zip(left, right)]
    assert line_dedup.close_pairs(left, right, threshold).tolist() == want


def line_classes(rows, threshold, least):
    """Per document the text without repeated lines, by comparing every pair of lines."""
    lines = {}
    for i, t in rows:
        for j, line in enumerate((t or "").split("\n")):
            lines.setdefault(line, []).append((i, j))
    long = [x for x in lines if len(x) >= least]
    links = [
        (a, b) for k, a in enumerate(long) for b in long[:k]
        if abs(len(a) - len(b)) <= threshold and edit_distance(a, b) <= threshold
    ]
    root = union_find(lines, links)
    first = {}
    for line, places in lines.items():
        first[root[line]] = min(first.get(root[line], (1 << 60, 0)), min(places))
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        out[i] = [j for j, x in enumerate(own) if x.strip() and first[root[x]] != (i, j)]
    return out


def test_lines_against_all_pairs(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 34))) for _ in range(40)]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                i = rng.randrange(len(line))
                line[i : i + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
            own.append("".join(line))
        texts.append("\n".join(own))
    texts += ["short", "short", "\n\n \n\n", "a" * 700, "a" * 701, "a" * 698]
    want = line_classes(list(enumerate(texts)), 2, 24)
    for r in line_dedup.deduplicate_lines(documents(spark, texts), 2, 24).collect():
        lines = texts[r.doc_id].split("\n")
        assert list(r.dropped) == want[r.doc_id]
        assert r.text == "\n".join(x for j, x in enumerate(lines) if j not in want[r.doc_id])
        assert (r.n_lines, r.n_dropped) == (len(lines), len(want[r.doc_id]))


def test_lines_of_odd_tables(spark):
    docs = documents(spark, [None, "x\ny", "x\ny", "y"], ids=[None, 2, 2, 3])
    got = sorted((tuple(r)[:4] for r in line_dedup.deduplicate_lines(docs).collect()), key=repr)
    assert got == sorted([(None, None, 0, 0), (2, "x\ny", 2, 0), (2, "x\ny", 2, 0), (3, "", 1, 1)], key=repr)
    assert line_dedup.deduplicate_lines(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        line_dedup.deduplicate_lines(docs, 40)
