"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter

import pytest
from llm_cases import LOWER

from plumbline.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, chunk string, freq long, own int, piece string"


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def plain(rows, least=30, longest=4, cover=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * a >= cover * candidates[part]:
                    covered.add(part)
    by_lang = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            cuts = []
            for k in range(1, len(words)):
                left, right = f[lang, words[:k]], f[lang, words[k:]]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def table(spark, rows):
    """Extra columns bear the names that the operator uses inside."""
    return spark.createDataFrame([(None, t, l, "x", 1, 2, "y") for t, l in rows], SCHEMA)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "the", "the", "of", "a", "New", "york", "City", "É", "日本", "x-y", "\x01", "\xa0", "don't"]
    breaks = [" ", " ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", " \x0b", " ! ", "\x1f"]
    base = "the quick new york city never sleeps in the big apple of new york city"
    out = []
    for _ in range(150):
        said = "".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["", " "]) + said, rng.choice(["en", "en", "fr", None, "und"])))
    out += [(base, "en")] * 70 + [(base.upper() + "!", "en"), (None, "en"), ("", None), ("...", "fr"), ("a", "fr")]
    return out + [("a " * 3000, "fr"), ("b" * 100_000 + " of the a", "fr"), ("x y " * 40, None), ("x y " * 40, "und")]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("options", [{}, {"least": 5, "top": 25}, {"longest": 2}, {"longest": 3, "cover": 50}])
def test_against_counting(spark, seed, options):
    rows = texts(seed)
    got = sorted(map(tuple, c.collocations(table(spark, rows), **options).collect()))
    want = plain(rows, **options)
    assert len(want) > 5
    assert got == want


def test_empty(spark):
    assert c.collocations(table(spark, [])).count() == 0
    assert c.collocations(table(spark, [(None, None), ("", "en"), ("a b c", "en")])).count() == 0
    with pytest.raises(ValueError):
        c.collocations(table(spark, []), longest=1)


@pytest.mark.parametrize("longest", [2, 4])
def test_parse_assigns_every_phrase_once(spark, longest):
    rows = texts(3)
    got = Counter()
    for r in c.dictionary(table(spark, rows), longest).collect():
        said = re.split("([ \n])", r.chunk)
        for i in range(r.own):
            for k in range(1, longest + 1):
                phrase = said[2 * i : 2 * (i + k) - 1]
                if 2 * (i + k) - 1 <= len(said) and "\n" not in phrase:
                    got[r.lang, "".join(phrase)] += r.freq
    want = Counter()
    for text, lang in rows:
        for words in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    want["und" if lang is None else lang, " ".join(words[i : i + k])] += 1
    assert got == want


def test_copies_cost_one_entry(spark):
    rng = random.Random(7)
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(2000))
    one = c.dictionary(table(spark, [(base, "en")])).collect()
    many = c.dictionary(table(spark, [(base, "en")] * 40)).collect()
    assert len(one) == len(many) > 40
    assert {r.freq for r in many} == {40}
    # a passage inside other words is cut like the whole, but for its ends
    moved = c.dictionary(table(spark, [("other words first " + base, "en")])).collect()
    assert len({r.chunk for r in moved} & {r.chunk for r in one}) >= len(one) - 2


def test_long_runs_are_cut(spark):
    rows = c.dictionary(table(spark, [("a " * 10_000, "en")])).collect()
    assert max(r.own for r in rows) <= c.CHUNK_MOST
    assert sum(r.own * r.freq for r in rows) == 10_000


def test_scores_beyond_64_bits(spark):
    a = 7 * 10**15
    phrases = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")
    parts = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 2)], "lang string, phrase string, f long")
    (row,) = c._best_cuts(phrases, parts, 2_000_000).collect()
    assert (row.l, row.r, row.score) == (a + 1, a + 2, 2_000_000 * a // (2 * a + 3))


def test_parse_cuts_texts_into_slices(spark):
    """Texts past one slice, a null and an empty one, are parsed whole."""
    rows = [("Long Text, ends. " * 20_000, None), (None, "en"), ("", "en"), ("one", "en")]
    found = c.dictionary(table(spark, rows)).collect()
    assert sum(r["own"] * r["freq"] for r in found if r["lang"] == "und") == 60_000
    assert [(r["own"], r["chunk"], r["freq"]) for r in found if r["lang"] == "en"] == [(1, "one", 1)]
