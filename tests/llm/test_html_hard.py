"""Pages that are cut or hostile take linear time; an article keeps all that is its own."""

import random
import time

import pytest

from mixtura.llm import html_tree as tree
from mixtura.llm.html_extract import extract_text


@pytest.mark.parametrize(
    "page",
    [
        "<p>x</p><div " + " ".join(f'data-a{i}="v{i}"' for i in range(100_000)),
        "<p>x</p><div " + "\"' " * 100_000,
        "<p>x</p><div " + "a=\"b' " * 50_000,
        "<p>x</p>" + "<!" * 100_000,
        "<p>x</p><a " + "b" * 200_000 + ">y",
        "<p>x</p>" + "<script </script   " * 20_000,
        "<p>x</p>" + "<a b=" * 50_000,
        "<p>x</p>" + "</" * 100_000,
    ],
    ids=range(8),
)
def test_cut_and_hostile_pages_in_linear_time(page):
    began = time.perf_counter()
    text = tree.text_at(tree.parse(page), [])
    assert time.perf_counter() - began < 5 and text.startswith("x")


def got(spark, pages, url="https://h.example.com/{i}"):
    rows = [(i, url.format(i=i), p, "h", "p") for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    return {r.page_id: r.text for r in extract_text(df).collect()}


ARTICLE = "<html><body><nav>Menu</nav><article><time>1 May 2020</time><h1>Title {i}</h1><p>By Jane Roe</p><h2>Introduction</h2><p>Lead for all.</p><p>First {i}.</p><blockquote>A shared quote</blockquote><h2>Conclusion</h2><p>Last {i}.</p></article><footer>F</footer></body></html>"


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_what_pages_share_in_an_article_stays(spark, n):
    want = {i: f"1 May 2020 Title {i} By Jane Roe Introduction Lead for all. First {i}. A shared quote Conclusion Last {i}." for i in range(n)}
    assert got(spark, [ARTICLE.format(i=i) for i in range(n)]) == want


def test_names_do_not_remove_parts_of_an_article(spark):
    page = (
        "<html><body><div class='sidebar'>Side {i}</div><article><h1>T {i}</h1><p class='notice-of-motion'>The motion {i}</p><div class='login'>How to log in {i}</div><div class='widget-theory'>Widgets {i}</div>"
        "<table class='legal'><tr><td>Law {i}</td></tr></table><p>A <span class='social'>social {i}</span> phrase</p><div class='comments'>Nice {i}</div><div class='ad'>Buy {i}</div><p hidden>gone {i}</p></article></body></html>"
    )
    assert got(spark, [page.format(i=i) for i in range(4)]) == {i: f"T {i} The motion {i} How to log in {i} Widgets {i} Law {i} A social {i} phrase" for i in range(4)}


def test_generated_templates_keep_every_character_of_the_article(spark):
    """Templates with names of no meaning; the article's own text is known by construction."""
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    pages, want, urls = [], {}, []
    for host in range(6):
        outer, inner = f"k{rng.randrange(9)}x", f"z{rng.randrange(9)}y"
        head, foot = f"Welcome to {host}", f"Imprint {host}"
        for i in range(rng.choice([3, 5, 9])):
            body = [" ".join(rng.choices(words, k=rng.randint(8, 30))) + f" {host}-{i}-{j}." for j in range(rng.randint(2, 7))]
            extra = "<h2>Background</h2>" if rng.random() < 0.7 else ""
            parts = [f"Heading {host} {i}", body[0], *(["Background"] if extra else []), *body[1:]]
            pages.append(f"<html><body><div class='{outer}a'><p>{head}</p></div><div class='{inner}'><h1>{parts[0]}</h1><p>{body[0]}</p>{extra}" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"</div><div class='{outer}b'>{foot}</div></body></html>")
            urls.append(f"https://h{host}.example.org/{i}")
            want[len(pages) - 1] = " ".join(parts)
    rows = [(i, u, p) for i, (u, p) in enumerate(zip(urls, pages, strict=True))]
    found = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert found == want
