"""Extraction, pagination and crawl over generated catalogues."""

import random

from pyspark.sql import functions as F

from snapfeed.operators import extract
from tests.helpers import config_row, configs

SITE = "https://plants.example/"
BOOK = ("plants", "li.plant", [("latin", "em::text", "css", None), ("no", "::attr(data-no)", "css", None)], "no")


def catalogue(numbers, older=None):
    rows = "".join(f"<li class=plant data-no={n}><em>Planta {n}</em> height {n % 7}" for n in numbers)
    return f"<ul>{rows}</ul>" + (f"<p><a class=older href='{older}'>older</a>" if older else "")


def shelf(pages, size=5):
    """Pages of a catalogue linked in a row, as (page_id, url, html)."""
    urls = [SITE if i == 0 else f"{SITE}list/{i}" for i in range(pages)]
    return [(i, u, catalogue(range(i * size, (i + 1) * size), f"/list/{i + 1}" if i + 1 < pages else None)) for i, u in enumerate(urls)]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def config(spark, max_pages=1, next_sel=None, *more):
    return configs(spark, [config_row(*BOOK, url=SITE, next_sel=next_sel, max_pages=max_pages), *more])


def test_pages_meet_the_config_of_their_host(spark):
    other = config_row("ferns", "b", [("t", "::text", "css", None)], "t", url="https://ferns.example/x")
    own = [(7, "https://ferns.example/y", "<b>f1</b><b>f2</b>"), (8, "https://nobody.example/", "<b>no</b>")]
    cfg = config(spark, 1, None, other)
    rows = extract.extract_items(extract.match_pages(table(spark, shelf(2) + own), cfg), cfg).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.item_idx)):
        got.setdefault(r.source_id, []).append(r.data.get("no") or r.data.get("t"))
    assert got == {"plants": [str(n) for n in range(10)], "ferns": ["f1", "f2"]}


def test_every_config_of_a_source_is_applied(spark):
    cfg = config(spark, 1, None, config_row("plants", "em", [("t", "::text", "css", None)], "t"))
    rows = extract.extract_items(table(spark, shelf(1)).withColumn("source_id", F.lit("plants")), cfg)
    assert rows.count() == 10


def test_a_page_that_fails_is_one_error_row(spark):
    cfg = configs(spark, [config_row("plants", "li[[", BOOK[2], "no")])
    rows = extract.extract_items(table(spark, shelf(1)).withColumn("source_id", F.lit("plants")), cfg).collect()
    assert [(r.data, bool(r.error)) for r in rows] == [(None, True)]


def test_following_links_stops_at_the_bound_and_at_the_end(spark):
    rows = shelf(6)
    random.Random(1).shuffle(rows)
    for bound, want in ((1, 1), (4, 4), (6, 6), (50, 6)):
        cfg = config(spark, bound, "a.older::attr(href)")
        got = extract.crawl(table(spark, rows + [(99, f"{SITE}nobody-links-here", catalogue([1000]))]), cfg).collect()
        assert sorted({(r.page_no, r.page_id) for r in got}) == [(i + 1, i) for i in range(want)]
        assert sorted(int(r.data["no"]) for r in got) == list(range(5 * want))


def test_relative_links_and_several_next_links(spark):
    cfg = config(spark, 2, "a.older::attr(href)")
    pages = table(spark, [(1, "http://10.9.8.7:81/a/b.html", catalogue([1], "c.html")), (2, "http://10.9.8.7:81/a/", catalogue([2], "?p=2"))])
    got = {r.page_id: r.next_url for r in extract.page_links(pages.withColumn("source_id", F.lit("plants")), cfg).collect()}
    assert got == {1: "http://10.9.8.7:81/a/c.html", 2: "http://10.9.8.7:81/a/?p=2"}
    links = spark.createDataFrame([("s", "u", "z"), ("s", "u", "v"), ("s", "u", None)], "source_id string, url string, next_url string")
    seeds = spark.createDataFrame([("s", "u", 2)], "source_id string, url string, max_pages int")
    assert sorted((r.url, r.page_no) for r in extract.paginate(seeds, links).collect()) == [("u", 1), ("v", 2)]


def test_trying_selectors(spark):
    pages = spark.createDataFrame([("p", catalogue(range(6)))], "source_id string, html string")
    tries = [("li.plant em::text", "css", 6, False), ("strong", "css", 0, False), ("//li/@data-no", "xpath", 6, False), ("li[[", "css", 0, True)]
    props = spark.createDataFrame([("p", s, k) for s, k, _, _ in tries], "source_id string, selector string, selector_type string")
    got = {r.selector: (r.n_matches, r.selector_error is not None) for r in extract.test_selectors(props, pages).collect()}
    assert got == {s: (n, bad) for s, _, n, bad in tries}
