"""Pages whose articles lie in or beside elements that often are no main text."""

import pytest
from pyspark.sql import functions as F

from lodetrace.llm import html_text

LONG = "This is what the page is about and it goes on for quite some while."
OTHER = "A second paragraph of the same text says something else again."
FOOT = "<footer>foot</footer>"

PAGES = {
    "form with an article": (f'<form id="aspnetForm"><nav><a>Home</a></nav><article><p>{LONG}</p></article></form>{FOOT}', LONG),
    "form with the text": (f'<form id="aspnetForm"><div><p>{LONG}</p><p>{OTHER}</p></div></form>{FOOT}', f"{LONG}\n{OTHER}"),
    "form beside the text": (f"<p>{LONG}</p><form>Name <input> <button>Send</button></form>{FOOT}", LONG),
    "form in the article": (f"<article><p>{LONG}</p><form>Your mail <input></form><p>{OTHER}</p></article>", f"{LONG}\n{OTHER}"),
    "fieldset in the article": (f"<article><fieldset>{LONG}</fieldset></article>", LONG),
    "names that begin like marks": (f'<article><section id="advertising-history"><p>{LONG}</p></section><section class="related-work">{OTHER}</section><h2 id="comment-on-law">Law</h2></article>', f"{LONG}\n{OTHER}\nLaw"),
    "names of layout": (f'<article><p>{LONG}</p><div class="ad-slot-3">buy</div><div class="comments">nice</div><div class="related-posts">more</div></article>', LONG),
    "search round the text": (f'<div class="search">{LONG}</div>', LONG),
    "widget round the text": (f'<div class="widget"><p>{LONG}</p></div>{FOOT}', LONG),
    "search beside the text": (f'<div class="search">Find it</div><p>{LONG}</p>', LONG),
    "modal with an article": (f'<div class="modal"><p>Close</p><main><p>{LONG}</p></main></div>', f"Close\n{LONG}"),
    "heading and lead before": (f"<nav>menu</nav><h1>Head</h1><p>Lead of it.</p><article><p>{LONG}</p></article><div>else</div>", f"Head\nLead of it.\n{LONG}"),
    "comments with articles": (f'<article><p>{LONG}</p></article><div id="comments"><article>{OTHER}</article></div>', LONG),
    "aside with an article": (f"<main><p>{LONG}</p></main><aside><article>teaser</article></aside>", LONG),
    "references that are links": (f'<p>{LONG}</p><ol><li><a href="/1">Smith, J. (2010), On the nature of things</a></li><li><a>Jones and others, A reply to Smith</a></li></ol>',
                                  f"{LONG}\nSmith, J. (2010), On the nature of things\nJones and others, A reply to Smith"),
    "menu of links": (f"<ul><li><a>Home</a></li><li><a>About us</a></li></ul><p>{LONG}</p>", LONG),
    "other white space": ("<p>a b&emsp;c d e&#x3000;</p>", "a b c d e"),
    "advert alone": (f'<div class="ad">{LONG}</div>', ""),
}


@pytest.mark.parametrize("chars", [1 << 22, 20])
def test_articles_stay(spark, chars):
    rows = [(name, f"http://h{i}.org/", page) for i, (name, (page, _)) in enumerate(PAGES.items())]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("kinds", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, host_chars=chars).collect()}
    assert got == {name: text for name, (_, text) in PAGES.items()}


@pytest.mark.parametrize("chars", [1 << 22, 20])
def test_unique_runs_of_a_repeated_block_stay(spark, chars):
    """Boilerplate and text in one unmarked block: the repeated run goes, what is the page's own stays, short rests don't."""
    menu = "Home about contact imprint privacy terms jobs press help search"
    own = [" ".join(f"own{i}word{k}" for k in range(9)) for i in range(4)]
    rows = [(str(i), f"http://h.org/{i}", f"<div>{menu} {own[i]} {menu} page {i}</div><p>unlike{i}</p>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id string, url string, html string"), host_chars=chars).collect()}
    assert got == {str(i): f"{own[i]}\nunlike{i}" for i in range(4)}


def test_runs_left():
    import numpy as np

    words = " ".join(map(str, range(30)))
    assert html_text.unique_runs(words, np.zeros(30, bool)) == words and html_text.unique_runs(words, np.ones(30, bool)) == ""
    hit = np.zeros(30, bool)
    hit[8:10] = hit[15:20] = True
    assert html_text.unique_runs(words, hit) == " ".join(map(str, [*range(8), *range(20, 30)]))
