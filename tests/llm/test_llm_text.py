"""HTML extraction, token store, quality classifier, decontamination, and the pipeline."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, table_rows
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import decontaminate, html_extract, quality, queries, token_store

ZERO = np.zeros(6)


def test_pages(spark, sf_dir):
    pages = dict(table_rows(spark, sf_dir, "pages", "page_id", "html"))
    for r in queries.QUERIES["op2_html_extract"](spark, sf_dir).collect():
        page = pages[r.page_id]
        article = page[page.index("<article>") : page.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain", ""),
        ("<article><p>a<p>b &amp; c&#33;</article>", "a\n\nb & c!"),
        ("<article><h1>T</h1><div>one<br>two</div>tail</article>", "T\n\none two\n\ntail"),
        ("<main><p>keep</p><aside>no</aside><div class='comments'><p>no</p></div><p>keep</p></main>", "keep\n\nkeep"),
        ("<header>no</header><nav>no</nav><article><header><h1>T</h1></header>x</article><footer>no</footer>", "T\n\nx"),
        ("<article><form>no<input></form><script>if (a < b) '</p>'</script><p>x</p><style>p{}</style></article>", "x"),
        ("<article><p>a < b and c > d</p><!-- no --><p hidden>no</p></article>", "a < b and c > d"),
        ("<div class='siteHeader'>no</div><article><div class=header>T</div><p>x</p><p class=adBox>no</p></article>", "T\n\nx"),
        ("<article><ul><li>i<li>j</ul><table><tr><td>k<td>l</table></article>", "i\n\nj\n\nk\n\nl"),
        ("<article><p>open <b>bold<p>next</article></b></p><div id=cookie-notice>no</div>", "open bold\n\nnext"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page, ZERO) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>a</p><embed src=x><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><svg viewBox='0'/><math /><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><svg/><p>b</p><svg><title/><path/><text>no</text></svg>c</article>", "a\n\nb\n\nc"),
        *(
            (f"<article><p>a</p><{name} id=x><p>b</p></article>{more}", "a\n\nb")
            for name in "noscript object audio video canvas select datalist iframe template svg".split()
            for more in ("", f"<nav>no</nav><{name}>no</{name}>", f"</{name}>")
        ),
        ("<article><p>a<video><p>no</p></video>b</p><noscript><div>no</noscript><p>c</p></article>", "ab\n\nc"),
        ("<article><object><object>no</object>no</object>a<canvas><audio>no</audio></canvas>b</article>", "ab"),
        ("<article><audio><p>b</p><audio>no</audio><p>c</p></article>", "b\n\nc"),
        ("<article><p>a</p><script>if (a < b) '<p>'</script x><p>b</p><style>p{}", "a\n\nb"),
        ("<article><p>if a < b then c", "if a < b then c"),
        ("<article>1 < 2 <3 </ x", "1 < 2 <3 </ x"),
        ("<article><p>a < b<a href='x", "a < b"),
    ],
)
def test_nothing_is_lost_behind_elements_without_an_end(page, want):
    assert html_extract.main_text(page, ZERO) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<body><div class='content has-sidebar'><p>one</p></div>", "one"),
        ("<div class='content no-header with_comments'><p>one</p></div><div class='sidebar content'>no</div>", "one"),
        ("<article><p data-id='share'>one</p><p title='the hidden truth'>two</p><p alt='class=ad'>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<article><p title=it's>one</p><p>don't</p></article>", "one\n\ndon't"),
        ("<article><p class=\"a>one</p></article>", "one"),
        ("<article><p title='a > b' lang = en>one</p><p class= 'ad' >no</p></article>", "one"),
        ("<article><p>x</p><button>no3</button><label>no4</label></article>", "x"),
        ("<article><p>a <button>no</button>b<label>no</label></p>c</article>", "a b\n\nc"),
        ("<article><p>a <span hidden>no</span>b <span class='ad'>no <b>no</b></span>c</p></article>", "a b c"),
        ("<article><p>a <span class=ad>no<p>b</p></article>", "a\n\nb"),
        ("<article><p>a <b style='display : none'>no</b>b</p><div aria-hidden=true>no</div></article>", "a b"),
        ("<article><p>one</p></article><div><p>Great post</p><p>Me too</p></div>", "one"),
        ("<!--><article><p>a</p><!-- <p>no</p>", "a"),
    ],
)
def test_real_attributes_and_elements_apart(page, want):
    assert html_extract.main_text(page, ZERO) == want


def test_labels_that_only_the_cut_explains():
    weights = np.array([0, 0, 0, 0, 0.8, 0])
    page = "<article><p>One.</p><section id=discussion><h2>Discussion</h2><p>Two.</p></section><p>Three.</p></article>"
    tree = html_extract.read_page(page)
    own = [b.markup + (0 if b.heading else 0.8) for b in tree.blocks]
    assert [b.text for b, o in zip(tree.blocks, own) if o < 0] == ["Discussion"]
    assert html_extract.main_text(page, weights) == "One.\n\nDiscussion\n\nTwo.\n\nThree."
    # The same heading falls where nothing near it speaks for it.
    lone = "<article><p>One.</p><section id=discussion><h2>Discussion</h2><p>login or register</p></section></article>"
    assert html_extract.main_text(lone, weights) == "One."


@pytest.mark.parametrize(
    "piece, times",
    [
        ("<a ", 300_000), ("<a href=\"x\" ", 80_000), ("<p class='", 100_000), ("<div>", 200_000), ("<div>x", 40_000),
        ("<b><div>", 60_000), ("<i></b>", 100_000), ("<script></script ", 60_000), ("<!-- ", 200_000), ("<td><i>", 60_000),
        ("<noscript><p>", 60_000), ("<svg><title>", 60_000), ("</", 400_000), ("<a b= ", 100_000), ("<p>one two</p>", 30_000),
    ],
)
def test_time_grows_with_the_page(piece, times):
    start = time.process_time()
    html_extract.main_text(piece * times, ZERO)
    assert time.process_time() - start < 6


def test_features_look_at_all_words():
    text = "a " * 300 + "B " * 300
    assert html_extract.features(html_extract.Block(text.strip(), 0, 0, 0.0, 0, False))[5] == 0.5


def test_min_cut_against_all_labellings():
    rng = random.Random(0)
    for _ in range(150):
        n = rng.randint(1, 8)
        odds = [rng.choice([rng.uniform(-2, 2), rng.uniform(-0.2, 0.2)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 1)) for _ in range(2 * n)]

        def cost(label):
            own = sum(abs(o) for o, x in zip(odds, label) if (o > 0) != x)
            return own + sum(c for a, b, c in edges if label[a] != label[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.min_cut(odds, edges)) == pytest.approx(best)


def test_extract_odd_tables(spark):
    rows = [(None, None, None, 1), (1, "u", "<article>x</article>", 2), (1, "u", "<article>x</article>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((tuple(r) for r in html_extract.extract(pages).collect()), key=repr)
    assert got == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)], key=repr)
    assert html_extract.extract(pages.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**60 - 1)), max_size=300))
def test_words_round_trip(ids):
    assert token_store.decode(token_store.encode(np.array(ids, dtype=np.uint64))).tolist() == ids


def test_small_ids_are_packed_densely():
    assert len(token_store.encode(np.ones(6000, dtype=np.uint64))) == 100
    assert len(token_store.encode(np.full(300, 2**15 - 1))) == 75


def library():
    return Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))


def test_words_are_encoded_as_the_library_does():
    tool, own = library(), token_store._Encoder(public_tokenizers.path(queries.TOKENIZER))
    texts = ["", "Don't STOP", "a\x01b \x01 c", "x<|endoftext|>y", "é Å ΑΣ İ", "  wide　", "日本 12,5 ½"]
    texts += ["".join(random.Random(k).choice("aé 'st\n\x85​.9") for _ in range(80)) for k in range(60)]
    for text, raw in zip(texts, own.encode_texts(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


def test_separators_that_are_no_white_space_to_the_vocabulary():
    tool, own = library(), token_store._Encoder(public_tokenizers.path(queries.TOKENIZER))
    texts = ["a\x1cb", "\x1d", " \x1e x\x1f", "a\x1c\x85b\u2028c", "a\x1f \x01 b"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aé 's\n\x85\x1c\x1d\x1e\x1f\u3000.9") for _ in range(80)) for _ in range(60)]
    for text, raw in zip(texts, own.encode_texts(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


def test_tokens_from_files(spark, sf_dir):
    tool, at = library(), 0
    got = {r.doc_id: r for r in queries.QUERIES["op7_token_store"](spark, sf_dir).collect()}
    rows = sorted(table_rows(spark, sf_dir, "documents", "doc_id", "text"))
    assert len(got) == len(rows)
    for i, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(raw))
        at += len(ids)


def test_tokens_of_odd_tables(spark, tmp_path):
    path = public_tokenizers.path(queries.TOKENIZER)
    docs = documents(spark, ["b", None, "", "long word " * 40_000, "a"], ids=[3, 1, None, 2, 3])
    token_store.write_tokens(docs, path, 1, str(tmp_path / "t"))
    rows = token_store.read_tokens(spark, str(tmp_path / "t")).collect()
    assert sorted(r.start for r in rows) == [0, 1, 2, 80_003, 80_005]
    ends = {r.start + r.n_tokens for r in rows}
    assert ends == {1, 2, 80_003, 80_005, 80_007}
    token_store.write_tokens(docs.limit(0), path, 1, str(tmp_path / "e"))
    assert token_store.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_quality_on_held_out_rows(spark, sf_dir):
    labels = {i: q for i, q in table_rows(spark, "/root/testdata/sf0.01", "labels", "doc_id", "quality")}
    rows = queries.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").collect()
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in judged) >= 0.97 * len(judged) > 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_tables(spark):
    docs = documents(spark, [None, "", "fine words here", "zz zz zz zz"], ids=[None, 1, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 0), (None, 0, 0), (1, None, 0)], none.schema)
    for labels in (none, one):
        scored = quality.with_quality(docs, quality.fit_quality(docs, labels))
        assert scored.count() == 4 and set(docs.columns) <= set(scored.columns)
        assert {r.held_out for r in scored.filter("doc_id IS NULL").collect()} == {False}
        assert scored.filter("score IS NULL OR score < 0.3").count() == 0
    assert quality.with_quality(docs.limit(0), quality.RuleModel(0.0)).collect() == []


def judged(rows, items, window=10):
    out = {}
    for i, text in rows:
        said = decontaminate.words(text)
        hit, found = set(), set()
        for item, its in items:
            own = decontaminate.words(its)
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for at in range(len(said) - n + 1):
                    if said[at] == own[k] and said[at : at + n] == own[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(said), len(hit), len(found), digest, bool(hit))
    return out


def test_contamination_of_documents(spark, sf_dir):
    rows = table_rows(spark, sf_dir, "documents", "doc_id", "text")
    items = table_rows(spark, sf_dir, "benchmark", "item_id", "text")
    got = queries.QUERIES["op10_decontaminate"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == judged(rows, items)


def test_contamination_at_the_edges(spark):
    rng = random.Random(8)
    said = [[f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 40))] for _ in range(80)]
    items = [(k, " ".join(said[k][:14])) for k in range(0, 60, 3)]
    items += [(100, "w1"), (101, "W3, w4"), (102, None), (103, "!?"), (None, "w5 w5 w5"), (9, "w2 w3 w4 w5")]
    texts = [" ".join(s) for s in said] + [None, "", "é w1é", "w5 w5 " * 20_000]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    got = decontaminate.contamination(documents(spark, texts), benchmark).collect()
    want = judged([(i, t) for i, t in enumerate(texts)], items)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
        assert sum(s.behind - s.first for s in r.spans) == r.n_hit
    assert not any(r.contaminated for r in decontaminate.contamination(documents(spark, texts), benchmark.limit(0)).collect())
    assert decontaminate.contamination(documents(spark, []), benchmark).collect() == []


def test_contamination_of_repeated_ids(spark):
    item = "one two three four five six seven eight nine ten"
    docs = documents(spark, [item, "nothing", item, None], ids=[1, 1, None, None])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r.doc_id is None, r.n_hit) for r in decontaminate.contamination(docs, benchmark).collect())
    assert got == [(False, 0), (False, 10), (True, 0), (True, 10)]


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = dict(table_rows(spark, sf_dir, "labels", "doc_id", "quality"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf_dir)
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    known = [i for i in labels]
    assert sum((i in ids) == bool(labels[i]) for i in known) >= 0.98 * len(known)
    small = docs.filter("doc_id < 150")
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    one = stages["near_duplicates"](spark, small, sf_dir)
    from llm_cases import jaccard_classes

    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in jaccard_classes(rows, 5, 80).items() if i == c}
    clean = stages["decontaminate"](spark, small, sf_dir)
    items = table_rows(spark, sf_dir, "benchmark", "item_id", "text")
    assert {r.doc_id for r in clean.collect()} == {i for i, x in judged(rows, items).items() if not x[4]}
    mixed = stages["mix"](spark, small, sf_dir)
    assert good.columns == one.columns == clean.columns == mixed.columns == columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    sharded = stages["shard"](spark, mixed, sf_dir)
    assert sharded.count() == mixed.count()


def test_pipeline_of_nothing(spark, sf_dir):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []


@pytest.fixture
def odd_names(spark):
    """Documents with columns whose names the stages use inside, or that have to be quoted."""
    rows = [(i, f"some words of document number {i} and more of them {i * 7}", "en", f"s{i % 2}", i, 1, 2, 3, 4) for i in range(12)]
    names = ["doc_id", "text", "lang", "source", "id", "_copies", "_time", "a.b", "_doc"]
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("stage", ["keep_quality", "keep_one_of_near_duplicates", "drop_contaminated", "mix_sources"])
def test_stages_keep_columns_of_any_name(spark, sf_dir, odd_names, stage):
    kept = getattr(corpus_pipeline, stage)(spark, odd_names, sf_dir)
    assert kept.columns == odd_names.columns
    known = {tuple(r) for r in odd_names.collect()}
    assert {tuple(r) for r in kept.collect()} <= known


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, sf_dir):
    item = table_rows(spark, sf_dir, "benchmark", "text")[0][0]
    docs = documents(spark, [item, "clean one", f"x {item}", "clean two", None], ids=[None, None, 7, 7, 7])
    kept = corpus_pipeline.drop_contaminated(spark, docs, sf_dir).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, "clean one"), (7, "clean two"), (7, None)], key=repr)
