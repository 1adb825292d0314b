"""Main text of pages: held-out accuracy of the model, decoding, and broken markup."""

import html as entities
import itertools
import re

import numpy as np
import pytest

from cohortloom.llm import html_extract
from cohortloom.llm.html_pages import PageMaker

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_held_out_accuracy(model):
    maker, dom = PageMaker(4711), html_extract.Dom()
    right = total = 0
    for _ in range(150):
        nodes = dom.parse(maker.page()).nodes
        kept = html_extract.decode(nodes, model.odds(html_extract.features(nodes, model.tokens)))
        for node, k in zip(nodes, kept, strict=True):
            if node.label is not None and node.own:
                right += k == node.label
                total += 1
    assert right / total >= 0.97


def test_articles_of_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.main_text(pages, model).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S)
        blocks = re.split(r"</?(?:p|h1|br)>", article[1]) if article else []
        texts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
        want = "\n".join(t for t in texts if t)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(8)
    for _ in range(30):
        parents = [-1] + [int(rng.integers(0, i)) for i in range(1, 9)]
        nodes = [html_extract.Node("div", p, 0, ()) for p in parents]
        odds = rng.normal(0, 3, len(nodes)).tolist()

        def gain(labels, odds=odds, parents=parents):
            full = (True, *labels)
            if any(k and not full[p] for k, p in zip(full, parents, strict=True) if p >= 0):
                return -np.inf
            return sum((o if k else 0) for k, o in zip(full[1:], odds[1:], strict=True))

        best = max(gain(x) for x in itertools.product([False, True], repeat=len(nodes) - 1))
        assert abs(gain(tuple(html_extract.decode(nodes, odds)[1:])) - best) < 1e-6


BODY = "".join(f"<p>Sentence number {i}, with some words in it. And another one follows.</p>" for i in range(6))


def test_awkward_pages(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "   \n "), (4, "u", "<"), (5, "u", "</p></div>"), (6, "u", deep),
        (7, "u", f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{BODY}<script>var x = '<p>no</p>'"),
        (8, "u", f"<article>{BODY}</article><div class=comments><ul><li><p>First reader comment!</p></ul></div>"),
        (9, "u", f"<main><p>A &amp; B&nbsp;&lt;c&gt; &#233;&eacute;\n\n  d<b>old</b>er</p>{BODY}</main><footer>&copy; x</footer>"),
        (None, "u", f"<article>{BODY}</article>"), (10, "u", f"<article>{BODY}</article>"), (10, "u", f"<article>{BODY}</article>"),
    ]
    got = html_extract.main_text(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in (1, 2, 3, 5):
        assert text[i] == ""
    plain = "\n".join(re.findall(r"<p>(.*?)</p>", BODY))
    for i in (7, 8, None, 10):
        assert text[i] == plain
    assert text[9] == "A & B <c> éé dolder\n" + plain
    assert all(r.n_chars == len(r.text) for r in got)


ADVERT = "Buy cheap pills here now"


@pytest.mark.parametrize("page", [
    f"<html><body><article>{BODY}</article>{ADVERT}</body></html>",
    f"<html><body><article>{BODY}</article></body>{ADVERT}</html>",
    f"<article>{BODY}</article>{ADVERT}",
    f"<html><body>{ADVERT}<main>{BODY}</main></body></html>",
    f"<html><body><div class=x1>{BODY}</div><p></p>{ADVERT} <a href=/b>now</a></body></html>",
])
def test_text_beside_blocks_is_judged_by_itself(model, page):
    assert html_extract.texts([page], model) == ["\n".join(re.findall(r"<p>(.*?)</p>", BODY))]


def test_text_beside_blocks_can_be_main(model):
    long_ = "A sentence of the article stands here, right beside the paragraphs. It goes on for a while, as text does."
    page = f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{BODY}{long_}{BODY}</article></body></html>"
    want = re.findall(r"<p>(.*?)</p>", BODY)
    assert html_extract.texts([page], model) == ["\n".join([*want, long_, *want])]


def test_line_breaks_are_white_space(model):
    page = f"<article><p>One line<br>and another,<br/><br>and a third.</p>{BODY}</article>"
    got = html_extract.texts([page], model)[0]
    assert got.startswith("One line and another, and a third.\nSentence number 0")


@pytest.mark.parametrize("odd", ["<![ x", "<![foo[x]]>", "<![CDATA[a > b]]>", "<![if !IE]>", "<!>", "<!x", "</>", "<?php echo 1 ?>", "<!-- x", "<![endif]-->", "&#x110000;", "<p <b", "\x00<\x00>"])
def test_odd_markup_is_read(model, odd):
    want = re.findall(r"<p>(.*?)</p>", BODY)
    got = html_extract.texts([f"<article>{BODY}{odd}</article>", f"<article>{BODY}{odd}<p>{BODY}</article>"], model)
    assert all(g.split("\n")[: len(want)] == want for g in got)


def test_any_cut_of_a_page_is_read(spark):
    """Ten thousand pages with pieces cut out, doubled and mixed; the parser must give nodes for all."""
    rng = np.random.default_rng(12)
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    pages += [PageMaker(i).page() for i in range(20)]
    odd = ["<![", "<!", "</", "<!--", "-->", "]]>", "&#", "<b", "<li", "'", '"', ">", "<table><td>", "</p>", "<br>", "<![a[", "<?"]
    dom = html_extract.Dom()
    for _ in range(10_000):
        page = pages[rng.integers(len(pages))]
        for _ in range(rng.integers(1, 5)):
            lo = int(rng.integers(0, len(page) + 1))
            hi = min(len(page), lo + int(rng.integers(0, 200)))
            page = page[:lo] + odd[rng.integers(len(odd))] * int(rng.integers(0, 3)) + page[hi : hi + 2000]
        nodes = dom.parse(page).nodes
        assert all(n.parent < i for i, n in enumerate(nodes)) and all(0 <= r.node < len(nodes) for r in dom.runs)


@pytest.mark.parametrize("piece", ["<i>x", "<b><i></b>x", "<div><b>x</div>", "<li><i>x", "<td><div>", "</b></i>x", "<p><a>x"])
def test_hostile_nesting_takes_linear_time(piece):
    import time

    dom, took = html_extract.Dom(), []
    for n in (4_000, 32_000):
        page = "<i>" * n + piece * n + "</b></li></td>" * n
        began = time.process_time()
        dom.parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * max(took[0], 0.02)


def test_token_weights_are_learnt():
    """A word the code has never seen, on elements with a label, gets its weight from the pages."""
    dom = html_extract.Dom()
    pages = [dom.parse(f'<body data-m="1"><div class="zorg" data-m="0">{i}</div><p id="kumquat" data-m="1">x</p></body>').nodes for i in range(30)]
    weights = html_extract.token_weights(pages)
    of = lambda word: weights[html_extract.crc32(word.encode()) % html_extract.TOKEN_BUCKETS]
    assert of("zorg") < -1 < 0 < of("kumquat") and of("unseen") == 0


def test_empty_and_clashing(spark, model):
    clash = spark.createDataFrame([], SCHEMA + ", text string, n_chars int")
    assert html_extract.main_text(clash, model).count() == 0


def test_boosting_learns_an_interaction():
    from cohortloom.llm.boosting import fit

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] > 0) ^ (x[:, 1] > 0.5)
    model = fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.93
