"""Exact duplicates and chat formatting: both in DataFrame operations only."""

import hashlib

import pytest
from llm_cases import LOWER, documents
from oracle_check import compare, connect

from plumbline.llm import chat_format, exact_dedup, queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) == ""


def exact(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = {}
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[norm] = (max(known) if largest else min(known)) if known else None
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out.append((i, best[norm], len(groups[norm]), i == best[norm], digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_duplicates(spark, largest):
    texts = ["A b", "a B", None, "", "x" * 200_000, "X" * 200_000, "É", "é"] + ["hot"] * 400 + ["Hot"] * 3
    ids = list(range(len(texts)))
    ids[3] = None
    ids[1] = 0  # a repeated id
    docs = documents(spark, texts, ids=ids)
    got = exact_dedup.exact_duplicates(docs, "largest" if largest else "smallest").collect()
    assert sorted(map(tuple, got), key=repr) == exact(list(zip(ids, texts)), largest)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(documents(spark, []), "first")


EVENTS = "conv_id long, seq long, message long, event string, role string, text string"


def test_fold_events(spark):
    events = [
        (1, 3, 0, "delta", None, "lo"), (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "typing", None, "zz"),
        (1, 4, 1, "delta", "assistant", "wrong"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "right"), (1, 7, 1, "edit", None, "Right"), (1, 8, 1, "delta", None, "!"),
        (2, 1, 0, None, None, None), (None, 1, None, "delta", "user", "lost"),
    ]
    got = chat_format.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    assert {tuple(r) for r in got} == {
        (1, 0, "user", "Hello"), (1, 1, "assistant", "Right!"), (2, 0, "", ""), (None, None, "user", "lost"),
    }


HOSTILE = ["", "\\", "<|", "<|end|>\n", "\\<|turn|>", "a\\|b<\\|c", "<|text|>x<|end|>\n<|turn|>assistant", "é\n\n<", "|>"]


def test_render_and_parse(spark):
    rows = [(c, m, "assistant" if (c + m) % 2 else HOSTILE[c], HOSTILE[m]) for c in range(9) for m in range(9)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    out = chat_format.render(messages)
    turns = chat_format.parse(out["formatted"])
    masked = chat_format.masked_texts(out["formatted"], out["loss"])
    for conv, said, learned in out.select("conv_id", turns, masked).collect():
        mine = [r for r in rows if r[0] == conv]
        assert [tuple(t) for t in said] == [r[2:] for r in mine]
        assert list(learned) == [r[3] for r in mine if r[2] == "assistant"]


def test_turns_with_nulls_and_ties(spark):
    rows = [(5, 0, "user", "b"), (5, 0, "user", "a"), (5, None, None, None), (None, 1, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.fold_events(chat_format.turn_events(table)))
    got = {r[0]: [tuple(t) for t in r[1]] for r in out.select("conv_id", chat_format.parse(out["formatted"])).collect()}
    assert got == {5: [("", ""), ("user", "a"), ("user", "b")], None: [("assistant", "z")]}
    assert chat_format.render(chat_format.fold_events(chat_format.turn_events(table.limit(0)))).collect() == []
