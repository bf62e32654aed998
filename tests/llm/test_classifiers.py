"""Language, toxicity and page text: held-out accuracy, odd inputs, and structure."""

import os
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import langid, pagetext, toxicity, zdict
from sparktrail.llm.common import fold, table

#: The smaller tables have some 30 toxic documents to learn from, half of them without a toxic word.
SF, MIDDLE, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1", "/root/testdata/check_s"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_language_held_out(spark, docs):
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    held = langid.identify(docs.filter(fold("doc_id", 4) == 2), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.accepted == (r.margin >= model.min_margin) for r in held if r.lang_pred != "und")
    assert np.mean([r.accepted for r in held]) > 0.97
    odd = spark.createDataFrame([(None, "a"), ("", "b"), (" 12 !", "c"), ("é" * 200000, "d"), (held[0].text, "e")], "text string, told string")
    got = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got[:3]] == [("und", 0.0, False)] * 3
    assert got[3].lang_pred in model.dictionaries and got[4].lang_pred == held[0].lang_pred and [r.told for r in got] == list("abcde")
    assert langid.identify(odd.limit(0), model).count() == 0


def test_language_is_that_of_the_smallest_length(spark, docs):
    """The prediction against every text compressed whole under every dictionary, one after another."""
    import zstandard

    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    how = {k: zstandard.ZstdCompressionParameters.from_level(model.level, dict_size=len(v), source_size=model.window, write_content_size=False, write_checksum=False, write_dict_id=False, **langid._SEARCH) for k, v in model.dictionaries.items()}
    for r in langid.identify(docs.filter(F.length("text") < 3000).limit(100), model).collect():
        raw = langid.plain(r.text).encode()
        sizes = {k: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how[k]).compress(raw)) for k, v in model.dictionaries.items()}
        assert sizes[r.lang_pred] <= min(sizes.values()) + 1


def test_language_without_labels(spark, docs):
    model = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), model).collect()} == {"und"}


def test_sample_is_bounded_and_by_label(spark):
    rows = spark.range(3000).select(F.col("id"), F.concat(F.lit("text "), "id").alias("text"))
    keys = rows.select("id", F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("most").alias("label"))
    got = zdict.labelled_sample(rows.unionAll(rows.filter("id < 300")), keys, 40, 2, 6)
    assert [r["label"] for r in got] == ["most"] * 40 + ["some"] * 40 and all(len(r["text"]) <= 6 for r in got) and len({r["id"] for r in got}) == 80


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no larger tables here")
def test_toxicity_held_out(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = toxicity.fit(toxicity.learnable(docs), labels)
    held = docs.filter(fold("doc_id", 3) == 1).join(labels.filter("toxic is not null").select("doc_id", "toxic"), "doc_id").filter(F.col("doc_id") % 4 == 0)
    rated = toxicity.rate(held, model).select("toxic", "score", "predicted").collect()
    assert np.mean([r.predicted for r in rated if not r.toxic]) < 0.01
    assert np.mean([r.predicted for r in rated if r.toxic]) > 0.92
    for ordinary, toxic in model.pairs:
        assert len(ordinary) == len(toxic), "both dictionaries have one size"
    odd = spark.createDataFrame([(None, 1), ("", 2), ("x " * 100000, 3)], "text string, told int")
    got = toxicity.rate(odd, model).collect()
    assert all(0 <= r.score < 0.5 and r.predicted == 0 for r in got) and [r.told for r in got] == [1, 2, 3]


@pytest.fixture(scope="module")
def toxicity_model(spark):
    return toxicity.fit(toxicity.learnable(table(spark, MIDDLE, "documents")), table(spark, MIDDLE, "labels"))


def test_toxicity_of_all_held_out_rows(spark, toxicity_model):
    """Half of the toxic labels of this table have no toxic word, so recall cannot be much over a half."""
    labels = table(spark, MIDDLE, "labels").filter("toxic is not null").select("doc_id", "toxic")
    held = table(spark, MIDDLE, "documents").filter(fold("doc_id", 3) == 1).join(labels, "doc_id")
    rated = toxicity.rate(held.repartition(8), toxicity_model).select("toxic", "predicted").collect()
    assert len(rated) == held.count() > 1000
    assert np.mean([r.predicted for r in rated if not r.toxic]) < 0.03
    assert np.mean([r.predicted for r in rated if r.toxic]) > 0.4


def test_toxicity_equals_a_plain_recompression(spark, toxicity_model):
    """Windows compressed one by one with fresh compressors, and the curve written out."""
    import zstandard

    m = toxicity_model
    options = toxicity._SEARCH

    def length(window, dictionary):
        how = zstandard.ZstdCompressionParameters.from_level(m.level, dict_size=len(dictionary), source_size=m.window, write_content_size=False, write_checksum=False, write_dict_id=False, **options)
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(window + toxicity._MARKER))

    def score(text):
        cut = zdict.windows(zdict.plain(text or ""), m.window)
        gain = [sum(length(w, ordinary) - length(w, toxic) for ordinary, toxic in m.pairs) / len(m.pairs) for w in cut]
        top = sorted(gain, reverse=True) + [0.0] * 4
        good = [max(g, 0) for g in gain]
        found = [1.0, top[0], top[1], top[2] + top[3], np.log1p(sum(good)), sum(good) / len(gain), sum(min(g, 0) for g in gain) / len(gain), np.log(len(gain))]
        found += [np.log1p(sum(g >= bar for g in gain)) for bar in (3, 4, 5, 6)] + [sum(g >= bar for g in gain) / len(gain) for bar in (3, 4, 5)]
        z = sum((f - a) / b * w for f, a, b, w in zip(found, m.means, m.scales, m.weights, strict=True))
        return 1 / (1 + np.exp(-z))

    docs = table(spark, MIDDLE, "documents").filter("length(text) < 5000").limit(40).select("doc_id", "text")
    docs = docs.unionAll(docs.limit(3)).unionAll(spark.createDataFrame([(10**7, None), (10**7 + 1, ""), (10**7 + 2, "\u4e2d\u6587 " * 300)], "doc_id long, text string"))
    rows = toxicity.rate(docs, m).collect()
    assert len(rows) == 46
    for r in rows:
        want = score(r.text)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(want >= 0.7)
    assert toxicity.rate(docs.limit(0), m).collect() == []


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(toxicity.learnable(docs), table(spark, SF, "labels").limit(0))
    assert {r.predicted for r in toxicity.rate(docs.limit(5), model).collect()} == {0}


@pytest.fixture(scope="module")
def page_model():
    return pagetext.fit(pagetext.training_pages())


def test_pages_held_out(page_model):
    pages = pagetext.training_pages(200, seed=77)
    right = [pagetext.main_text(page_model, html) == "\n".join(kept) for html, kept in pages]
    assert np.mean(right) > 0.88


def test_pages_of_the_table(spark, page_model):
    pages = table(spark, SF, "pages")
    for r in pagetext.extract(pages.limit(60), page_model).collect():
        html = r.html
        article = html[html.index("<article>") : html.index("</article>")]
        assert r.text == "\n".join(b[0] for b in pagetext.blocks(article)) and r.n_chars == len(r.text)


def test_decoding_is_viterbi(page_model):
    named = pagetext.features(pagetext.blocks(pagetext.training_pages(1, seed=5)[0][0]))[:9]
    weight = lambda b: page_model.weights.get("", 0.0) + sum(page_model.weights.get(f, 0.0) * v for f, v in b.items())

    def score(path):
        total = page_model.start * path[0]
        for i, y in enumerate(path):
            total += weight(named[i]) * y + (page_model.transitions[path[i - 1]][y] if i else 0)
        return total

    import itertools

    best = max(itertools.product((0, 1), repeat=len(named)), key=score)
    assert score(tuple(pagetext.labels(page_model, named))) == pytest.approx(score(best))


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</div></p>", "<!-- x", "<script>a", "<p>" * 3000, "&", "<a href='>'>x</a>", "text only", "<b><i></b>", "<p a=\"'>x", "\x00"])
def test_odd_pages(page_model, html):
    assert isinstance(pagetext.main_text(page_model, html), str)


def test_blocks():
    html = "<head><title>no</title></head><body><p>a &amp; b<br>c&nbsp; d<p><b>e<div>f</div>g<script>var x='</p>'</script><ul><li>h<li>i</ul><!-- <p>no</p> --><style>p{}</style> j</body>"
    assert [b[0] for b in pagetext.blocks(html)] == ["a & b c d", "e", "f", "g", "h", "i", "j"]
    assert pagetext.blocks("<nav class='Top Menu'><a href=x>l k</a> m</nav>")[0][1:] == (("in:nav", "of:top", "of:menu", "is:nav"), 3)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one</p><video-js></video-js><p>two</p>", ["one", "two"]),
        ("<p>one<svg-icon></svg-icon><audio-player>x</audio-player></p><title-bar>two</title-bar>", ["onex", "two"]),
        ("<p>one</p><VIDEO controls>no</VIDEO><p>two</p>", ["one", "two"]),
        ("<p>one <svg width='1'/>two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg/>two</p><svg><text>no</text></svg><p>three</p>", ["one two", "three"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>two<math/> three</p>", ["so x=2 holds", "two three"]),
        ("<html><head><meta charset=a><title>no</title><link rel=x><p>one</p><p>two</p></html>", ["one", "two"]),
        ("<head><title>no</title><style>p{}</style> one <p>two", ["one", "two"]),
        ("<head><title>no</title><video>no</video>one", ["one"]),
        ("<head><title>no</title>one", ["one"]),
        ("<head><title>no</title> <script>x</script> </head> <body><p>one", ["one"]),
    ],
)
def test_article_text_is_kept(html, want):
    assert [b[0] for b in pagetext.blocks(html)] == want


@pytest.mark.parametrize("piece", ["<svg ", '<a "', "<a ", "<!--", "<script>", '<p a="', "<div>", "<p>", "<b>x", "</", "<![", "</script ", "&#", "<a b='>", "= "])
def test_time_grows_with_the_page(page_model, piece):
    """Broken markup of half a megabyte and more takes seconds."""
    began = time.perf_counter()
    pagetext.main_text(page_model, piece * (600_000 // len(piece)))
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(("html", "want"), [('<p title="unclosed>two</p><p>three</p>', ["two", "three"]), ("<p data=it's>one</p><p>don't</p>", ["one", "don't"]), ("<p>one</p><p class=", ["one"]), ("<p>1 < 2 and <3</p>", ["1 < 2 and <3"]), ("<p>one</p><a href='x", ["one"])])
def test_markup_does_not_come_out(html, want):
    assert [b[0] for b in pagetext.blocks(html)] == want


def test_pages_with_columns_of_any_name(spark, page_model):
    pages = spark.createDataFrame([(1, "<p>Some words that make a sentence, and some more of them.</p>" * 3, "a", "b", "c", "d")] * 2 + [(2, None, "a", "b", "c", "d")], "page_id long, html string, _page string, told string, `a.b` string, text string")
    rows = pagetext.extract(pages, page_model).collect()
    assert rows[0]["_page"] == "a" and rows[0]["told"] == "b" and rows[0]["a.b"] == "c" and rows[0].text == rows[1].text
    assert [r.n_chars for r in rows if r.page_id == 2] == [0]
    assert pagetext.extract(pages.limit(0), page_model).collect() == []


def test_head_that_is_left_open():
    assert pagetext.blocks("<head><title>no</title><p>one</p>") == pagetext.blocks("<p>one</p>")
    assert pagetext.blocks("<head><title>no</title>one") == pagetext.blocks("one")
