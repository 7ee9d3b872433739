"""Main texts: nothing of an only article is lost; trained weights are needed, and better, where no such element exists."""

import re

import pytest

from riftscan.llm import html

START = html.start_weights()
LINKS = "".join(f'<li><a href="/{k}">ref{k}</a></li>' for k in range(40))
NAV = "<nav><a>Home</a> <a>About us</a></nav>"


@pytest.mark.parametrize("kind", ["article", "main"])
@pytest.mark.parametrize(
    "inner, want",
    [
        (f"<h1>Title</h1><p>First one.</p><ul>{LINKS}</ul><p>Last one.</p>", ["Title", "First one.", *[f"ref{k}" for k in range(40)], "Last one."]),
        ("<p>Intro</p><table>" + "<tr><td>a</td><td>b</td></tr>" * 30 + "</table>", ["Intro", *["a", "b"] * 30]),
        ('<p>On trees.</p><div class="search">Binary search halves a sorted list.</div><div class="copyright">Copyright law protects works.</div>', ["On trees.", "Binary search halves a sorted list.", "Copyright law protects works."]),
        ('<p>Body.</p><div class="related"><a>One</a> <a>Two</a></div><div class="notice">We changed it</div><aside>Side</aside>', ["Body."]),
        ("<p>Before <noscript>plain words</noscript> after</p><svg><text>Label</text></svg>", ["Before plain words after", "Label"]),
        ("<p>One</p><form>Name <input></form><footer>Foot</footer><script>x()</script><p>Two</p>", ["One", "Two"]),
        ("", []),
    ],
)
def test_only_article(kind, inner, want):
    other = "<p>" + "Many words outside of it. " * 30 + "</p>"
    assert html.main_text(f"<body>{NAV}{other}<{kind}>{inner}</{kind}>{other}</body>", START) == "\n".join(want)


def test_several_articles():
    """Where a page has more than one, the weights decide: the longer one wins."""
    page = f"<article><p>{'long text ' * 40}</p></article><article><p>short</p></article>"
    assert html.main_text(page, START) == ("long text " * 40).strip()


def test_quiet_outside():
    assert html.main_text("<noscript>Please enable scripts</noscript><p>Words of the page</p>", START) == "Words of the page"


def test_trained_on_pages(spark):
    """On the given pages with the label's tags turned into others, trained weights find more of the article than untrained ones."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    trained = html.train(pages.where("page_id % 3 <> 0"))
    held = [r.html for r in pages.where("page_id % 3 = 0").collect()]
    right = {"trained": 0, "start": 0}
    for page in held:
        want = html.main_text(page, START)
        bare = re.sub("<(/?)article>", r"<\1div>", page)
        right["trained"] += html.main_text(bare, trained) == want
        right["start"] += html.main_text(bare, START) == want
    print(right, len(held))
    assert right["trained"] >= right["start"]
