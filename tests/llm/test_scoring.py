"""Classifiers on held-out rows, the field's passes against enumeration, HTML extraction."""

import itertools
import zlib

import numpy as np

from clickstack.llm import html_extract, labelled_pages, quality, toxicity
from clickstack.llm.labelled import training_sample
from tests.conftest import SF_MID


def held_out_accuracy(spark, scored, column):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").toPandas()
    return (rows.predicted == rows[column]).mean(), rows


def test_quality_held_out(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    accuracy, _ = held_out_accuracy(spark, quality.score_quality(docs, model), "quality")
    assert accuracy > 0.95
    got = quality.score_quality(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(nothing, model).count() == 0
    kept = quality.keep_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


def test_models_without_labels(odd, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, quality.fit_quality(odd, labels)).count() == 10
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)).count() == 10
    assert toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing, labels)).count() == 0


def test_sample_is_bounded_under_repeated_ids(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:2]
    docs = spark.range(5000).selectExpr(f"if(id < 4000, {ids[0]}, {ids[1]}) as doc_id", "repeat('x', cast(1 + id % 50 as int)) as text")
    labels = spark.createDataFrame([(ids[0], 1)] * 30 + [(ids[1], 0), (ids[1], 1), (None, 1)], "doc_id long, toxic int")
    for max_rows, max_chars in ((10, 100), (200, 10**6)):
        got = training_sample(docs, labels, "toxic", max_rows, max_chars)
        assert 0 < len(got) <= max_rows and sum(len(t) for t, _ in got) <= max_chars
    assert sorted(t for t, y in got if y == 1)[:50] and {y for _, y in got} == {0, 1}
    # All distinct (text, label) pairs fit into the larger bound: 50 under the first id, 50 twice under the other.
    assert len(got) == 150
    assert training_sample(docs, labels.limit(0), "toxic", 10, 100) == []


def test_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, field)
    accuracy, _ = held_out_accuracy(spark, scored, "toxic")
    assert accuracy > 0.9
    got = toxicity.score_toxicity(odd, field).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    row = scored.where("predicted = 1 and size(spans) > 0").join(docs, "doc_id").first()
    assert all(not row.text[s.start : s.end].isspace() and " " not in row.text[s.start : s.end] for s in row.spans)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = [1, 7, 3, 9]
    emission = rng.normal(0, 3, sum(lengths))
    first = np.zeros(len(emission), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    move, start = np.array([[1, 0.2], [0.3, 0.5]]), np.array([1, 0.3])
    got = toxicity.marginals(emission, first, move, start)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = start[states[0]] * np.exp(sum(emission[at + i] for i in range(n) if states[i]))
            for a, b in zip(states, states[1:]):
                w *= move[a, b]
            total += w
            on += w * np.array(states)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_best_region_against_all_runs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(1, 12)).tolist()
        a, b = html_extract.best_region(scores)
        best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))
        assert sum(scores[a:b]) == max(best, 0)


def test_pages(spark):
    weights = html_extract.fit_weights(labelled_pages.PAGES)
    assert weights.word > 0 and all(w < 0 for w in weights.tags.values())
    text = lambda h: html_extract.main_text(h, weights)
    page = ('<body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, many of them, on every page.</div>'
            '<article><h1>Tea &amp; t<b>ime</b></h1><p>Two  cups\n of tea.<script>var x="</p>";</script><p>One&nbsp;more &#x41;.'
            '<aside>Buy tea pots now, cheap.</aside><form><input name=q>Mail me</form><p>End.</article>'
            '<section class="comments"><p>I like this article a lot, said one reader.</p></section><footer>All rights</footer>')
    assert text(page) == "Tea & time Two cups of tea. One more A. End."
    assert text(None) == text("") == text("<nav><a>x</a></nav>") == ""
    rows = spark.createDataFrame([(1, "u", None, "e"), (None, None, page, "e"), (None, None, page, "e")],
                                 "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(rows, weights).collect()
    assert sorted(r.n_chars for r in got) == [0, len(text(page)), len(text(page))]
    assert html_extract.extract_main_text(rows.limit(0), weights).count() == 0


def test_names_do_not_lose_content():
    """Names lower scores or leave small parts out, but never the main part; only whole attribute names count."""
    weights = html_extract.fit_weights(labelled_pages.PAGES)
    text = lambda h: html_extract.main_text(h, weights)
    prose = "The longest of the rivers rises in the hills and crosses three plains before it meets the sea."
    around = '<body><nav><a href="/">Home</a></nav>%s<div class="sidebar"><a href="/x">The well</a></div><footer>All rights</footer></body>'
    for tag, attributes in (("article", "class='post has-comments'"), ("main", "class='with-sidebar'"), ("div", "class='content no-sidebar'"),
                            ("article", "class='hentry category-social tag-newsletter'"), ("article", "class='widget'"),
                            ("div", "role=main class=banner"), ("div", "id='page-widget'"), ("div", "class='menu'"),
                            ("div", "data-title='Hidden treasures'"), ("div", "aria-label='the hidden valley'"), ("div", "data-hidden='false'"),
                            ("div", "data-class='ad' title=hidden data-style='display:none'")):
        assert text(around % f"<{tag} {attributes}><h1>Rivers</h1><p>{prose}</p></{tag}>") == f"Rivers {prose}", (tag, attributes)
    article = "<article>%s<p>{}</p><p>{}</p></article>".format(prose, prose)
    titled = around % (article % "<div class='article-header'><h1>Rivers</h1></div>")
    assert text(titled) == f"Rivers {prose} {prose}"
    for lost in ("<div class='ad'>Buy two boats now.</div>", "<ul class='post-share'><li><a href='#'>Share</a><li><a href='#'>Print</a></ul>",
                 "<p hidden>Not yet</p>", "<p class=x HIDDEN=''>Not yet</p>", "<p title='>' aria-hidden=true>Not yet</p>",
                 "<p style='color:red; display: none'>Not yet</p>", "<section class='cookie-notice'><p>We use cookies.</p></section>"):
        assert text(around % (article % lost)) == f"{prose} {prose}", lost


def test_long_parts_that_are_no_content():
    """Comments, notices and adverts are left out even where they have most of the page's words; a page in a misnamed
    element is kept; very long and deeply nested pages come whole."""
    weights = html_extract.fit_weights(labelled_pages.PAGES)
    text = lambda h: html_extract.main_text(h, weights)
    prose = "The longest of the rivers rises in the hills and crosses three plains before it meets the sea. " * 3
    prose = prose.strip()
    remarks = "".join(f"<p>I like this article a lot, said reader {i}, and would read it again any day.</p>" for i in range(12))
    for page in ("<body><main><h1>Rivers</h1><p>%s</p>%s</main></body>", "<body><div><h1>Rivers</h1><p>%s</p></div>%s</body>",
                 "<body><div class=content><h1>Rivers</h1><p>%s</p></div>%s<footer>All rights</footer></body>"):
        for opening in ("<div id='comments'>", "<section class='cookie-banner'>", "<div class='ad'>", "<ul class='x sidebar'>"):
            for inner in (remarks, f"<div class='replies'>{remarks}</div>"):
                close = "</" + opening[1:].split()[0] + ">"
                assert text(page % (prose, opening + inner + close)) == f"Rivers {prose}", (page, opening)
    wrapped = "<body><div class='social'><h1>Rivers</h1><p>%s</p><div class='comments'>%s</div></div><p>Imprint</p></body>"
    assert text(wrapped % (prose, remarks)).startswith(f"Rivers {prose}") and "reader" not in text(wrapped % (prose, remarks))
    long = " ".join(f"word{i}" for i in range(200_000))
    assert text(f"<body><nav><a>x</a></nav><article><p>{long}</p></article><footer>f</footer></body>") == long
    assert text("<body><article>" + "<div>" * 5000 + prose + "</div>" * 5000 + "</article></body>") == prose
