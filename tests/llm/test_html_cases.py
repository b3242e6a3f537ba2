"""Pages whose wrappers, forms, headers, links, quotes or nesting must not cost text of the article."""

import time

import pytest

P = "one two, three four words of plain prose here and some more of it."
THREE, TWO = " ".join([P] * 3), " ".join([P] * 2)
ARTICLE = f"<article><h1>T</h1><p>{THREE}</p><p>{TWO}</p></article>"

PAGES = {
    "wrapper with a sidebar": (f'<body><div class="layout has-sidebar">{ARTICLE}<div class=sidebar><p>{P}</p></div></div>', ["T", THREE, TWO]),
    "open comments": (f'<body><div class="post comments-open">{ARTICLE}<div id=comments><p>{P * 9}</p></div></div>', ["T", THREE, TWO]),
    "free of ads": (f"<body><div class='post ad-free'>{ARTICLE}</div>", ["T", THREE, TWO]),
    "all inside a sidebar": (f"<body><div class='sidebar'>{ARTICLE}</div><p>x", ["T", THREE, TWO]),
    "form around the page": (f"<body><form id=aspnetForm><nav>n</nav>{ARTICLE}</form>", ["T", THREE, TWO]),
    "small form": (f"<body>{ARTICLE}<form><label>Your name</label></form>", ["T", THREE, TWO]),
    "header of an article": (f"<body><header><h1>Site</h1></header><article><header><h1>Head</h1><p>by X</p></header><p>{THREE}</p></article>", ["Head", "by X", THREE]),
    "links of an article": (
        f"<body><article><p>{THREE}</p><section><p><a href=1>{P}</a></p></section><h2>Sources</h2><ul><li><a href=2>source one is long enough to count</a></li></ul></article>",
        [THREE, P, "Sources", "source one is long enough to count"],
    ),
    "sources": (
        f"<body><div><p>{THREE}</p><p>{TWO}</p><h2>Sources</h2><ul><li><a href=2>source one is long enough, surely it is</a></li></ul></div>",
        [THREE, TWO, "Sources", "source one is long enough, surely it is"],
    ),
    "second part": (f"<body><div><h1>A</h1><p>{THREE}</p></div><div><h2>B</h2><p>{P}</p></div>", ["A", THREE, "B", P]),
    "quotes": (f"<body><article><p title=it's>{P}</p><p title=\"a>b\">{P}</p><p 'x>{P}</article>", [P, P, P]),
    "deep nesting": ("<div>" * 600 + f"<nav>navi</nav><p>{P}</p><div class=comments>bad comment</div>" + "</div>" * 600, [P]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    from lumenspan.llm.html_text import main_text

    page, wanted = PAGES[name]
    assert main_text(page).split("\n\n") == wanted


def test_work_is_in_proportion_to_length():
    from lumenspan.llm.html_text import main_text

    n = 30_000
    for page in ("<b>" * n + "x" + "</b>" * n, "<i>x" * n, "<div>" * n + "<p>a", "<b><div>" + "<i>" * n + "</b>" * n, "<a " + "x=y " * n, "<a x='" * n):
        began = time.time()
        main_text(page)
        assert time.time() - began < 10
