import html
import re

import pytest
from pyspark.sql import functions as F
from roadlens.llm import html_text as h

PROSE = "The house of the old man was in the middle of the town and it is said that he was not at home on the day of the great fire in the year of the flood."
LINKS = "<ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li><li><a href='/c'>Three</a></li></ul>"

CASES = {
    "article": (f"<html><head><title>t</title></head><body><nav>{LINKS}</nav><article><h1>Head &amp; foot</h1><p>Short.<p>{PROSE}</article><footer>&copy; me</footer>", f"Head & foot Short. {PROSE}"),
    "inside": (f"<article><p>{PROSE}</p><aside>Side text</aside><div class='ad-box'>Buy</div><p>End.</p><section id='comments'><p>{PROSE}</p></section></article>", f"{PROSE} End."),
    "menu": (f"<article><p>{PROSE}</p>{LINKS}<p>End.</p></article>", f"{PROSE} End."),
    "rules": (f"<div>{LINKS}</div><div><h2>Title</h2><p>{PROSE} {PROSE}</p><p>Short one.</p><p>{PROSE} {PROSE}</p></div><div>Menu: <a href=x>contact</a></div>", f"Title {PROSE} {PROSE} Short one. {PROSE} {PROSE}"),
    "scripts": (f"<article><script>var t='</p><article>';</script><style>p</style><p>{PROSE}<br>a<b>b</b>c&nbsp;d\n\t e</p><form>name <input></form></article>", f"{PROSE} abc d e"),
    "markup": (f"<article><!-- <p>no</p> --><p title='a > b'>{PROSE}</p><p>x &lt;b&gt; y</p>", f"{PROSE} x <b> y"),
    "wrapper": (f"<body class='with-sidebar'><div class='header-page'><main><p>{PROSE}</p></main></div><div class='sidebar'><p>{PROSE}</p></div>", PROSE),
    "comments": (f"<main><p>{PROSE}</p></main><div class=comments><article class=comment><p>{PROSE}</p></article><article><p>{PROSE}</p></article></div>", PROSE),
    "empty": ("", ""),
    "broken": ("<article><p class='x", ""),
    "unclosed": ("<!-- never closed <p>text</p>", ""),
    "script end": ("<script>never closed <p>text</p>", ""),
    "plain": (f"{PROSE} {PROSE}", f"{PROSE} {PROSE}"),
    "hidden": (f"<article><p>{PROSE}</p><div hidden>no</div><div style='display: none'>no</div><button>Go</button></article>", PROSE),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert h.main_text(page) == want


def test_table(spark):
    rows = [(i, f"u{i}", p, "x", 1) for i, (p, _) in enumerate(CASES.values())] + [(None, None, None, None, None), (0, "u0", "<p>", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = h.extract_text(pages).collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got) == sorted([(i, w) for i, (_, w) in enumerate(CASES.values())] + [(-1, ""), (0, "")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.extract_text(pages.limit(0)).collect() == []
    assert h.block_table(pages).where("good").agg(F.count("*")).first()[0] > 10


def test_shipped_pages(spark):
    """Against a plain reading of the shipped pages' one template."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html_of[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())
