import itertools
import random
import re
import time

import numpy as np
import pytest

from peptrove.llm import extraction as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<!-- ad 1 --><div class="ad">Buy now, it is cheap and good.</div><article><h1>A title of the page</h1><p><b>First  paragraph&nbsp;&amp; more, with words.<br><p>Second one, quite a bit longer than the first was.</p>
<div class="ad">Another advert here.</div><p>Third &lt;one&gt; ends it all here.</p></article><div id="comments"><h3>Comments</h3><p>Nice text, I liked it.</p></div><footer>&copy; 2020 site &middot; All of it.</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return X.default_model()


def test_a_page(model):
    assert X.main_texts([PAGE, "", "   ", "no markup"], model)[0] == "A title of the page\n\nFirst paragraph & more, with words.\n\nSecond one, quite a bit longer than the first was.\n\nThird <one> ends it all here."


def test_held_out_pages(model):
    pages = X.labelled_pages(150, seed=5)
    got = X.main_texts([p for p, _ in pages], model)
    assert sum(g == "\n\n".join(m) for g, (_, m) in zip(got, pages, strict=True)) >= 140


def test_blocks_of_bad_markup():
    texts = lambda h: [b[0] for b in X.blocks(h)]
    assert texts("<p>a<p>b</div>c<li>d<li>e") == ["a", "b", "c", "d", "e"]
    assert texts("a < b & c &lt; <script>x<y") == ["a < b & c <"]
    assert texts("x<!-- <p>y</p> ") == ["x"] and texts("<p title='a>b'>z</p>") == ["z"] and texts("<td>1<td>2") == ["1", "2"]
    block, = X.blocks("<div class='x sidebar'><p>t</p></div>")
    assert block.names == {"div", "p"} and block.leaf == "p" and block.hints == {"side"}
    assert texts("a <b 'c> d <i>e</i>") == ["a d e"] and texts("<p>a <q") == ["a <q"] and texts("</script <p>x") == ["x"] and texts("<script>a</script\n>b") == ["b"]


def plain_tokens(page):
    """Tags by trying the whole pattern at every place (for comparison on short pages)."""
    pattern = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
    out, at = [], 0
    while m := pattern.search(page, at):
        name, closing, rest = (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        end = m.end()
        if name in X.RAW and not closing and not rest.endswith("/"):
            e = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, end)
            end = e.end() if e else len(page)
        out.append((page[at : m.start()], name, closing, rest))
        at = end
    return [*out, (page[at:], "", False, "")]


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(4)
    parts = ["<a ", "</p ", ">", '"', "'", "x", " y=", "<b>", "<!-- ", "-->", "<script>", "</script>", "<", "/", "<!x", "<![CDATA[", "]]>", "<p class='", "\n"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert list(X.tokens(page)) == plain_tokens(page), page


def test_time_in_proportion_to_the_length():
    n = 1 << 20
    pages = [
        "<a ", "</p ", "<a x=\"'>", "<a '\"'", "<script></script ", "<x><y>t", "</y><x>", "<div>x", "<title>", "<title><p>x</p>", "<x><p>", "<!--", "<![CDATA[", "<body><x>", "<p class='", "<td>1", "&amp", "<",
    ]
    model = X.default_model()
    for unit in pages:
        for page in (unit * (n // len(unit)), "<p>t</p>" + unit * (n // len(unit)) + ">"):
            began = time.process_time()
            X.main_texts([page], model)
            assert time.process_time() - began < 20, unit  # a quadratic reader takes hours


def test_a_deep_page_beside_many_short_ones(model):
    pages = [PAGE] * 100 + ["<div>x" * 30_000]
    assert X.main_texts(pages, model)[:100] == X.main_texts([PAGE], model) * 100


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    chain = X.Chain(rng.normal(size=len(X.NAMES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [rng.integers(0, 2, (n, len(X.NAMES))).astype(np.float32) for n in (1, 0, 6, 3)]
    for x, path in zip(pages, chain.decode(pages), strict=True):
        e = chain.emissions(x)
        def score(y, e=e):
            return chain.start[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])) if y else 0.0
        best = max(itertools.product((0, 1), repeat=len(x)), key=score)
        assert tuple(path) == best


def test_training_follows_the_likelihood():
    x = np.zeros((4, len(X.NAMES)), np.float32)
    x[:, X.PLACE["bias"]] = 1
    x[2:, X.PLACE["stop"]] = 1
    chain = X.train([(x, np.array([0, 0, 1, 1]))] * 20, steps=150)
    assert chain.decode([x])[0].tolist() == [0, 0, 1, 1] and X.train([]).decode([x])[0].shape == (4,)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", PAGE, "t"), (3, "u", PAGE, "t"), (None, "u", "<article><p>" + "word, and more. " * 20_000, "t")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in X.extract(df, ["page_id", "url"]).collect()}
    assert rows[1] == rows[2] == "" and rows[3].startswith("A title") and len(rows[None]) == 20_000 * 16 - 1
    assert X.extract(df.limit(0), ["page_id"]).collect() == [] and X.extract(df, ["page_id"]).count() == 5


def test_query_against_all_labellings(spark, tmp_path, model):
    """Every row of the query against the likeliest of all label sequences of short pages."""
    pages = [p for p, _ in X.labelled_pages(60, seed=21) if 0 < len(X.blocks(p)) <= 11] + ["", None, "<p>one</p>", "no markup at all", PAGE.replace("Third", "&#84;hird")]
    spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    want = {}
    for i, p in enumerate(pages):
        own = X.blocks(p or "")
        e = model.emissions(X.features(own)) if own else np.zeros((0, 2))
        weigh = lambda y, e=e: model.start[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:])) if y else 0.0
        best = max(itertools.product((0, 1), repeat=len(own)), key=weigh)
        want[i] = "\n\n".join(b.text for b, y in zip(own, best, strict=True) if y)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in X.op8_linear_chain(spark, str(tmp_path)).collect()}
    assert got == {i: (f"u{i}", t, len(t)) for i, t in want.items()} and sum(map(bool, want.values())) > 10
