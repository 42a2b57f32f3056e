"""What a host's pages share goes, whatever its name; names on outer elements do not hide an article."""

import pytest

from mixtura.llm.html_extract import extract_text

PAGE = """<html><head><title>t</title></head><body class="{body}"><div class="zona"><p>Bienvenue chez nous<p>Alle Themen von A bis Z</div>
<div class="kasten"><div class="x1">Seit 1990 am Ort</div><p>Story {i} begins here.<p>It ends with {i}.<div class="x2">Rufen Sie uns an</div></div></body></html>"""


@pytest.mark.parametrize("body", ["", "single right-sidebar", "has-sidebar", "no-comments"])
def test_template_text_with_neutral_names_goes(spark, body):
    rows = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(i=i, body=body)) for i in range(6)]
    rows += [(100 + i, "https://same.example.com/", PAGE.format(i=0, body=body)) for i in range(2)]
    rows.append((200, "https://one.example.com/", PAGE.format(i=9, body=body)))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(6):
        assert got[i] == f"Story {i} begins here. It ends with {i}."
    assert all("Story 0 begins here." in got[i] for i in (100, 101)) and "Story 9 begins here." in got[200]


def test_names_do_not_hide_what_holds_the_article(spark):
    page = '<html><body class="right-sidebar"><div class="wrap has sidebar"><article><h1>Title {i}</h1><p>Body text {i}</article></div><div class="sidebar">Links {i}</div></body></html>'
    rows = [(i, "https://h.example.com/", page.format(i=i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Body text {i}" for i in range(3)}
