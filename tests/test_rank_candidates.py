from snapfeed.operators import repair


def page(menu, cards, ads):
    return ("<ul>" + "<li class='menu'>x</li>" * menu + "</ul>" + "<div class='box'>y</div>" * cards + "<p class='ad'>z</p>" * ads)


def test_the_container_comes_first_among_decoys(spark):
    pages = spark.createDataFrame([("a", i, page(25, 11 + i % 3, 3)) for i in range(6)] + [("b", 9, page(4, 30, 2)), ("c", 10, page(2, 5, 1))],
                                  "source_id string, page_id long, html string")
    runs = spark.createDataFrame([("a", "ok", 12), ("a", "ok", 13), ("a", "error", 400), ("a", "ok", 0), ("b", "ok", 4), ("c", "ok", 0)],
                                 "source_id string, status string, item_count long")
    out = repair.rank_candidates(repair.mine_candidates(pages, None), runs)
    order = {s: [r["selector"] for r in out.where(out.source_id == s).orderBy("place").collect()] for s in "abc"}
    assert order["a"] == ["div.box", "li.menu", "p.ad"] and order["b"][0] == "li.menu"
    assert order["c"] == ["div.box", "li.menu", "p.ad"]  # nothing to compare with: by count
    exact = out.where("source_id = 'b' AND place = 1").first()
    assert exact["misfit"] == 0 and exact["expected"] == 4
