import random
import re

import pyarrow.parquet as pq
import pytest

from pagelattice.llm import html_text

LONG = "A paragraph of the article with a good many words in it, and then some more. " * 3


def test_short_articles_and_plain_boilerplate():
    short = f"<article><p>Short news</p><p>Only a few words.</p></article><article><p>{LONG}</p></article>"
    assert html_text.main_text(short) == f"Short news\n\nOnly a few words.\n\n{LONG.strip()}"
    around = "".join(f"<div>Item {k}</div>" for k in range(12))
    assert html_text.main_text(f"<body>{around}<div><p>{LONG}</p><p>{LONG}</p></div>{around}</body>") == f"{LONG.strip()}\n\n{LONG.strip()}"
    for tag in ("div", "span", "li"):
        tags = "".join(f"<{tag}>tag {k}</{tag}>" for k in range(40))
        body = f"<ul>{tags}</ul>" if tag == "li" else f"<div>{tags}</div>" if tag == "span" else tags
        assert html_text.main_text(f"<body>{body}<div><h2>Title</h2><p>{LONG}</p><p>Yes.</p></div></body>").removeprefix("tag ").endswith(f"Title\n\n{LONG.strip()}\n\nYes.")
    assert "tag" not in html_text.main_text("<body>" + "".join(f"<div>tag {k}</div>" for k in range(40)) + f"<p>{LONG}</p></body>")


@pytest.mark.parametrize("seed", range(20))
def test_windows_against_every_sum(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 0, 3, 20, 90]) for _ in range(rnd.randint(0, 60))]
    least, window = rnd.choice([1, 50, 120]), rnd.randint(0, 3)
    high = [sum(sizes[max(0, k - window) : k + window + 1]) >= least for k in range(len(sizes))]
    marked = [False] * len(sizes)
    for first, last in html_text.surges(sizes, least, window):
        assert all(high[first : last + 1]) and (first == 0 or not high[first - 1]) and (last + 1 == len(high) or not high[last + 1])
        marked[first : last + 1] = [True] * (last + 1 - first)
    assert marked == high


def test_threshold_is_the_pages_own():
    line = lambda n, linked=0: html_text.Line("x" * n, linked=linked)
    sizes, least = html_text.line_sizes([line(10), line(30), line(20, 20)], 0.5)
    assert sizes == [10, 30, 0] and least == 0.5 * (100 + 900) / 40
    assert html_text.line_sizes([line(20, 20), line(8, 8)], 0.5)[0] == [20, 8], "a page of links alone"


def test_windows_alone_find_the_articles_of_the_test_pages():
    """Elements and names that tell the article or what is around it are taken away: the windows still drop something on
    every page, lose no line of an article, and give the very same text on nine pages of ten."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = dropped = 0
    for page in pages:
        plain = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)
        plain = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", plain)
        lines = [x.text for x in html_text.page_lines(plain)[0] if x.text]
        found, want = html_text.main_text(plain).split("\n\n"), html_text.main_text(page).split("\n\n")
        assert set(want) <= set(found)
        same += found == want
        dropped += len(found) < len(lines)
    assert dropped == len(pages) and same >= 0.9 * len(pages)
