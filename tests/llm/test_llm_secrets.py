"""The secret scan against a search per rule, and its automaton on its own."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import documents, table_rows

from plumbline.llm import automaton, queries, secret_scan

PATTERNS = [
    (re.compile(f"(?:{r.head})({r.tail})", re.ASCII | (re.IGNORECASE if r.fold else 0)), r) for r in secret_scan.RULES
]


def plain(text):
    """(start, rule, end) by searching for every rule on its own."""
    out = []
    for k, (pattern, rule) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            if len(m[0] if rule.whole else m.groups()[-1]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def scanner():
    return secret_scan.Scanner(secret_scan.RULES)


def test_random_texts(scanner):
    rng = random.Random(3)
    bits = (
        ["password", "passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "AKIA", "AB9"]
        + ["f" * 31, "0123456789abcdef" * 2, "é", "ſ", "K", "-", "_", ".", "ghp_", "a" * 36, "xoxb-", "AIza", "eyJ"]
        + ["-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "\n", "sk_live_", "日本", " " * 600, "a" * 700, "x", "hex"]
    )
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None]
    found = list(scanner.rows(pa.array(texts, pa.string())))
    assert sum(map(bool, found)) > 1000
    assert found == [plain(t) for t in texts]


@pytest.mark.parametrize(
    "text, want",
    [
        ("token=abcdefg", []),
        ("token=abcdefgh", [(0, "assign", 14)]),
        ("token=secret:abcdefghij", []),  # the short first match is passed over with all it holds
        ("PassWord' := x", []),
        ("é my api_key\" = 'AbC/d+e.f_g'", [(5, "assign", 28)]),
        ("AKIA" + "Z" * 11, []),
        ("xAKIA" + "Z" * 12 + "z", [(1, "access", 17)]),
        ("日" + "0a" * 16 + "G", [(1, "hex", 33)]),
        ("ghp_" + "aZ" * 18, [(0, "github", 40)]),
        ("eyJabcdefghijkl.eyJmnopqrstuvwxyz.0123456789", [(0, "webtoken", 44)]),
        ("-----BEGIN RSA PRIVATE KEY-----", [(0, "private_key", 31)]),
    ],
)
def test_cases(scanner, text, want):
    (found,) = scanner.rows(pa.array([text]))
    assert [(s, secret_scan.RULES[r].kind, e) for s, r, e in found] == want


@pytest.mark.parametrize("text", ["password" + " " * 300_000, "a" * 300_000, "0" * 31 + "g" * 200_000, "token=" * 50_000])
def test_long_texts_whose_state_passes_through_all_lanes(scanner, text):
    assert list(scanner.rows(pa.array([text, "token: 12345678", text]))) == [plain(text), [(0, 0, 15)], plain(text)]


PATTERNS_ALONE = ["a|bc*", "(ab|a)b{2,3}", "[a-c]+x?", r"\x20*a", "a{3}", "(a|b)*abb", r"[\]\-a]+", "ab{0,2}c"]


@pytest.mark.parametrize("pattern", PATTERNS_ALONE)
@pytest.mark.parametrize("fold", [False, True])
def test_automaton_against_the_library(pattern, fold):
    machine = automaton.compile_rules([automaton.parse(pattern, fold)], search=False)
    table, accepts = automaton.rows_of(machine)
    rng, wanted = random.Random(5), re.compile(pattern, re.I if fold else 0)
    for _ in range(2000):
        text = "".join(rng.choice("abcxABX ]-") for _ in range(rng.randint(0, 7)))
        state = 0
        for byte in text.encode():
            state = table[state][byte] if state >= 0 else -1
        assert (state >= 0 and accepts[state]) == bool(wanted.fullmatch(text)), text


def test_automaton_is_minimal():
    # strings over a, b whose third letter from the end is an a need eight states
    machine = automaton.compile_rules([automaton.parse("(a|b)*a(a|b)(a|b)")], search=False)
    assert len(machine.accepts) == 8 + 1  # and one that nothing leaves


@pytest.mark.parametrize("pattern", ["a(b", "a)", "a*", "[a", "*a", r"\d", "é", "a{x}", "a]"])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        automaton.compile_rules([automaton.parse(pattern)], search=True)


def test_lanes_agree_with_one_byte_after_the_other(scanner):
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"pasword=:' tokenAKI0f\xff", dtype=np.uint8), 20_000)
    machine, state, want = scanner.machine, 0, []
    for byte in data:
        state = int(machine.table[state + int(machine.column[byte])])
        want.append(state)
    assert automaton.run(machine, data).tolist() == want


def test_rows(spark):
    texts = ["token=12345678 " * 3, None, "", "plain", "token=12345678"]
    df = documents(spark, texts, ids=[4, 4, None, 2, None]).withColumnRenamed("shard", "spans")
    found = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.scan(df).collect()]
    three = [("assign", 15 * k, 15 * k + 14) for k in range(3)]
    assert sorted(found, key=repr) == sorted(
        [(4, three), (4, []), (None, []), (2, []), (None, [("assign", 0, 14)])], key=repr
    )
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_secret_scan"](spark, sf_dir).collect()}
    want = {}
    for doc_id, text in table_rows(spark, sf_dir, "documents", "doc_id", "text"):
        spans = [f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in plain(text)]
        kinds = [s.split(":")[0] for s in spans]
        base = ",".join(s for s, k in zip(spans, kinds) if k in ("assign", "access", "hex"))
        counts = [kinds.count(k) for k in ("assign", "access", "hex")]
        want[doc_id] = (doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(spans))
    assert got == want
    assert sum(map(bool, (w[-1] for w in want.values())))
