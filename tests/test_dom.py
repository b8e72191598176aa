"""Per-page extraction inside a task (no Spark): pages are generated, so what
must come out is what went in."""

import random

import pytest

from snapfeed.operators import dom

STATIONS = [("Brocken", "-4", "snow"), ("Kiel", "9", "rain"), ("Zugspitze", "-11", "clear")]


def forecast(rows, cell="dd"):
    """A weather page: a definition list per station, tags left open on purpose."""
    body = "".join(f"<section class='wx row-{i}' data-station='{n}'><dl><dt>Temp<{cell} class=t>{t}&deg;<dt>Sky<{cell} class=s> {s} </dl></section>"
                   for i, (n, t, s) in enumerate(rows))
    return f"<!doctype html><title>Weather &lt;today&gt;</title><main>{body}<footer><a rel=next href='?day=2'>tomorrow</a></footer></main>"


WX = {"container": "section.wx", "dedupe_key": "station", "fields": [
    {"name": "station", "selector": "::attr(data-station)"}, {"name": "temp", "selector": ".t::text"}, {"name": "sky", "selector": "dd.s::text"}]}


def items_of(html, item):
    return dom.extract_from_doc(dom.parse_html(html), item)


def test_generated_pages_give_back_their_rows():
    rng = random.Random(8)
    for n in (0, 1, 3, 40):
        rows = [(f"st{rng.randrange(10 ** 6)}", str(rng.randint(-30, 40)), rng.choice(["fog", "sun", "hail"])) for _ in range(n)]
        assert items_of(forecast(rows), WX) == [{"station": a, "temp": f"{t}°", "sky": f" {s} "} for a, t, s in rows]


def test_changed_layout_keeps_rows_with_nulls():
    found = items_of(forecast(STATIONS, "dd data-x").replace("class=t", "class=temperature"), WX)
    assert [f["station"] for f in found] == [s[0] for s in STATIONS] and {f["temp"] for f in found} == {None}


def test_rows_without_any_value_are_left_out():
    page = "<i class=k></i><i class=k data-v=''></i><i class=k data-v=7></i>"
    assert items_of(page, {"container": "i.k", "fields": [{"name": "v", "selector": "::attr(data-v)"}]}) == [{"v": ""}, {"v": "7"}]


def test_attribute_fields_read_the_container():
    item = {"container": "section.wx", "fields": [{"name": "where", "selector": "dl", "attr": "data-station"},
                                                 {"name": "none", "selector": "dl", "attr": "lang"}, {"name": "t", "selector": "dd.t::text"}]}
    assert [(f["where"], f["none"]) for f in items_of(forecast(STATIONS), item)] == [(s[0], None) for s in STATIONS]


def test_xpath_gives_what_css_gives():
    xp = {"container": "//section[contains(@class, 'wx')]", "container_type": "xpath", "fields": [
        {"name": "station", "selector": "./@data-station", "selector_type": "xpath"},
        {"name": "temp", "selector": ".//dd[@class='t']/text()", "selector_type": "xpath"}, {"name": "sky", "selector": "dd.s::text"}]}
    assert items_of(forecast(STATIONS), xp) == items_of(forecast(STATIONS), WX)


def test_next_link_and_title():
    page = dom.parse_html(forecast(STATIONS))
    assert dom.next_link(page, {"next": "footer a[rel=next]::attr(href)"}) == "?day=2"
    assert dom.next_link(page, {"next": "a.older::attr(href)"}) is None
    assert dom.select_values(page, page.root, "title::text") == ["Weather <today>"]


@pytest.mark.parametrize("selector", ["section.wx", ".row-1", "section:nth-child(2)", "main > section", "section + section", "section ~ footer",
                                      "[data-station$='el']", "[data-station^=Zug]", "section:not(.row-0)", "dl, footer", "section:last-child", "footer:last-child"])
def test_selectors_against_a_plain_walk(selector):
    """Each selector against a predicate on (tag, classes, place among siblings)."""
    page = dom.parse_html(forecast(STATIONS))
    got = [n.tag + "".join("." + c for c in (n.attrs.get("class") or "").split() if c.startswith("row")) for n in dom.select_nodes(page, page.root, selector)]
    want = {"section.wx": ["section.row-0", "section.row-1", "section.row-2"], ".row-1": ["section.row-1"], "section:nth-child(2)": ["section.row-1"],
            "main > section": ["section.row-0", "section.row-1", "section.row-2"], "section + section": ["section.row-1", "section.row-2"],
            "section ~ footer": ["footer"], "[data-station$='el']": ["section.row-1"], "[data-station^=Zug]": ["section.row-2"],
            "section:not(.row-0)": ["section.row-1", "section.row-2"], "dl, footer": ["dl", "dl", "dl", "footer"], "section:last-child": [],
            "footer:last-child": ["footer"]}[selector]
    assert got == want


def test_unclosed_and_foreign_markup():
    page = dom.parse_html("<ol><li>one<li>two<li>three</ol><style>li{}</style><p>x<hr>y<p>z<select><option>a<option>b</select>")
    assert dom.select_values(page, page.root, "ol > li::text") == ["one", "two", "three"]
    assert dom.select_values(page, page.root, "style::text") == ["li{}"]
    assert dom.select_values(page, page.root, "option::text") == ["a", "b"]


@pytest.mark.parametrize("good,kind", [("section.wx dd::text", "css"), ("a[rel=next]", "css"), ("//dl/dt[2]", "xpath"), ("count(//dt)", "xpath")])
def test_accepted_selectors(good, kind):
    assert dom.check_selector(good, kind) is None
    assert dom.check_selector(good + "[", kind) is not None


@pytest.mark.parametrize("bad,kind", [("", "css"), ("> dl", "css"), ("dl::nothing", "css"), ("//dl[", "xpath"), ("nothing(//dl)", "xpath"), ("dl", "other")])
def test_refused_selectors(bad, kind):
    assert dom.check_selector(bad, kind) is not None
