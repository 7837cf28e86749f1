"""Operator 1: the region scan by brute force, and whole pages."""

import random
import re
import html

import pytest

from corpuslens.llm import extract as X

PAGES = {
    "plain": ("<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head&amp;line</h1><p>One  two\nthree.</p><p>Four &lt;five&gt;</p></article><footer>Foot</footer></body></html>", "Head&line\nOne two three.\nFour <five>"),
    "unclosed": ("<body><div class='ad'>Buy now this</div><article><h1>A b</h1><p><b>Bold start.<br><p>Next</b> para</article><footer>x", "A b\nBold start.\nNext para"),
    "inside": ("<main><h1>T</h1><p>Text of it.</p><div class=\"advert box\">Buy!</div><p>More <i>of</i> it.</p><section id=comments><h2>Comments</h2><p>Nice post</p></section></main>", "T\nText of it.\nMore of it."),
    "no content element": ("<div id=header>Site name</div><div class=menu><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div class=content><h2>Title here</h2><p>A long enough paragraph of words.</p><p>And another one.</p></div><div class=sidebar>Side words</div><div class='cookie-notice'>We use cookies</div>", "Title here\nA long enough paragraph of words.\nAnd another one."),
    "wrapped": ("<div class='page-with-sidebar'><article><p>Kept words here.</p></article></div>", "Kept words here."),
    "raw": ("<article><p>a</p><script>if (a < b) document.write('</p><p>no')</script><style>p{}</style><p>b &copy; &#233; &#x41;</p><form><input value=q>Search</form></article>", "a\nb © é A"),
    "list": ("<article><p>Things:</p><ul><li>one thing<li>two <a href=x>linked</a> things</ul><table><tr><td>c1<td>c2</table></article>", "Things:\none thing\ntwo linked things\nc1\nc2"),
    "quotes": ("<article><p title='a > b' class=\"x\">Text 1 < 2 here</p></article>", "Text 1 < 2 here"),
    "null": (None, ""),
    "empty": ("", ""),
    "only furniture": ("<nav>Home</nav><footer>Foot</footer>", ""),
    "text": ("just words &amp; more", "just words & more"),
    "comment article": ("<article><h1>Main</h1><p>Body text.</p></article><div class='comments'><article><p>I disagree with all</p></article></div>", "Main\nBody text."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert X.main_text(page, X.DEFAULT) == want


def plain_reference(page):
    """For the generated pages, whose content is one well-known element."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1|br)>", body)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_generated_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = X.fit_weights(pages)
    assert weights["word"] > 0 > weights["beside"] and all(v < 0 for k, v in weights.items() if k.startswith("tag"))
    changed = {k for k, v in weights.items() if v != X.DEFAULT.get(k)}
    assert {"word", "mark:<nav>", "mark:<footer>", "tag:p", "tag:li"} <= changed
    want = {r.page_id: plain_reference(r.html) for r in pages.collect()}
    for r in X.extract_report(pages).collect():
        assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)


HAND_MADE = {
    "heading ids": ("<article><h2 id=\"search-trees\">Search trees</h2><p>They are balanced.</p><section id=\"comments-on-method\"><p>On the method.</p></section><p class=\"market-share\">Its share grew.</p><p title=\"the hidden life\">Of trees.</p></article>", "Search trees\nThey are balanced.\nOn the method.\nIts share grew.\nOf trees."),
    "math and labels": ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><p>Press <button>OK</button> or <label>Stop</label> now.</p></article>", "Let x=1 be.\nPress OK or Stop now."),
    "links in content": ("<article><p>See these pages for more about it:</p><ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(20)) + "</ul><p>The end.</p></article>", "See these pages for more about it:\n" + "\n".join(f"Page {i}" for i in range(20)) + "\nThe end."),
    "hidden": ("<article><p>Seen here.</p><p hidden>Not this.</p><div style='color:red; display: none'>Nor this.</div><span aria-hidden=true>x</span><p data-hidden='no'>But this.</p></article>", "Seen here.\nSeen too."),
    "links only": ("<div><a href=/>Home</a> <a href=/a>About us</a> <a href=/b>Contact</a></div><div><h2>A title of it</h2><p>The first paragraph has words enough to count.</p><p>So does this second one here.</p></div><div><a href=1>More</a> <a href=2>Even more</a></div>", "A title of it\nThe first paragraph has words enough to count.\nSo does this second one here."),
    "role": ("<div role=navigation>Go here go there</div><div id=content><p>These are the words of the text.</p></div><div role=contentinfo>All rights</div>", "These are the words of the text."),
}
HAND_MADE["hidden"] = (HAND_MADE["hidden"][0], "Seen here.\nBut this.")


@pytest.mark.parametrize("name", HAND_MADE)
def test_hand_made_pages(name):
    page, want = HAND_MADE[name]
    assert X.main_text(page, X.DEFAULT) == want


def test_the_scan_decides(monkeypatch):
    pages = [HAND_MADE["links only"], PAGES["no content element"]]
    assert [X.main_text(p, X.DEFAULT) for p, _ in pages] == [w for _, w in pages]
    monkeypatch.setattr(X, "best_region", lambda scores: (0, len(scores) - 1))
    assert X.main_text(HAND_MADE["links only"][0], X.DEFAULT) == "Home About us Contact\n" + HAND_MADE["links only"][1] + "\nMore Even more"


def test_weights_are_learned():
    usual = "<html><body><nav><a href=/>Home page</a></nav><div class=teaser>Read this other story now please</div><article><p>{}</p></article><footer>Foot words</footer></body></html>"
    inverted = "<html><body><nav><a href=/>Home page</a></nav><article><div class=teaser><p>{}</p></div></article><div class=prose>Words beside it that nobody needs</div></body></html>"

    def fitted(page):
        totals = {}
        for i in range(30):
            for k, (a, b) in X.counts(page.format(" ".join(f"w{i}x{j}" for j in range(20)))).items():
                x, y = totals.get(k, (0, 0))
                totals[k] = (x + a, y + b)
        assert totals
        return X.weights_from(totals)

    a, b = fitted(usual), fitted(inverted)
    assert a["mark:teaser"] < -3 and b["mark:teaser"] > 1 and b["mark:prose"] < -3 and "mark:prose" not in a
    assert all(w != X.DEFAULT for w in (a, b))
    page = "<div class=teaser>Some words of the one</div><div class=prose>Some words of the other</div>"
    assert X.main_text(page, a) == "Some words of the other" and X.main_text(page, b) == "Some words of the one"
    # A mark that the prior calls furniture is content where pages use it so.
    assert X.main_text("<div class=comments>Words that stay here</div>", fitted(inverted.replace("teaser", "comments"))) == "Words that stay here"
    assert X.main_text("<div class=comments>Words that go from here</div>", X.DEFAULT) == ""


def test_region_is_best():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = X.best_region(s)
        best = max([0, *(sum(s[i : j + 1]) for i in range(len(s)) for j in range(i, len(s)))])
        assert sum(s[a : b + 1]) == best


def test_random_bytes_do_not_crash():
    rng = random.Random(5)
    bits = ["<", ">", "</", "<p", "<article>", "</article>", "<!--", "-->", "\"", "'", "=", " ", "a", "&amp", "<script>", "</script", "<div class='ad'>", "</div>", "<br/>", "\x00", "é"]
    for _ in range(500):
        X.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 80))), X.DEFAULT)


def test_null_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGES["plain"][0]), (1, None, None), (None, "u", "")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = X.extract_report(df)
    assert sorted((r.page_id or -1, r.text) for r in got.collect()) == [(-1, ""), (1, ""), (1, PAGES["plain"][1])]
    assert X.extract_report(df.limit(0)).count() == 0


def test_unclosed_raw_elements_take_linear_time():
    import time

    for name in ("select", "title", "textarea", "svg"):
        began = time.time()
        X.main_text(f"<{name}>x" * 100_000, X.DEFAULT)
        assert time.time() - began < 8


def test_values_that_read_hidden_hide_nothing():
    page = "<article><p title=hidden>first words</p><p data-x='hidden'>second words</p><p hidden>gone</p><p HIDDEN=''>gone</p><p hidden=until-found>gone</p><p class=hidden>third words</p></article>"
    assert X.main_text(page, X.DEFAULT) == "first words\nsecond words\nthird words"


def test_comments_of_readers_are_no_content():
    page = "<main><article class='post comment-count'><p>" + "the article has words of its own " * 8 + "</p></article><section><article class='comment'><p>" + "i think that this is wrong " * 9 + "</p></article><article id=reply-7><p>so do i and i say so</p></article></section></main>"
    got = X.main_text(page, X.DEFAULT)
    assert got.startswith("the article has words") and "i think" not in got and "so do i" not in got
