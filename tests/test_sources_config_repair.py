import json

import pytest
from pyspark.sql import functions as F

from snapfeed.operators import config_checks as C
from snapfeed.operators import repair as RP
from snapfeed.operators import sources as S
from snapfeed.sources.configs import load_configs, parse_texts

BASE = {"name": "ok-source", "url": "https://example.com/", "schedule": "0 * * * *",
        "item": {"container": "div.card", "fields": [{"name": "id", "selector": "::attr(data-id)"}],
                 "dedupe_key": "id"}}


def checked(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw_json string")
    return {r.i: r for r in C.violations(df).collect()}


def variant(**changes):
    d = json.loads(json.dumps(BASE))
    for path, val in changes.items():
        cur = d
        keys = path.split("__")
        for k in keys[:-1]:
            cur = cur[k]
        if val is None:
            cur.pop(keys[-1], None)
        else:
            cur[keys[-1]] = val
    return d


@pytest.mark.parametrize("doc,fragment", [
    (variant(name="Bad"), "name:"), (variant(name="has space"), "name:"), (variant(name="under_score"), "name:"),
    (variant(name=""), "name:"), (variant(url="not a url"), "url:"), (variant(item__fields=[]), "item.fields"),
    (variant(item__dedupe_key="nope"), "item.dedupe_key"),
    (variant(actions=[{"type": "click", "selector": "a"}]), "render: actions"),
    (variant(wait_for="div"), "render: wait_for"),
    (dict(variant(render=True), actions=[{"type": "click"}]), "actions:"),
    (dict(variant(render=True), actions=[{"type": "wait"}]), "actions:"),
    (variant(pagination={"max_pages": 0}), "max_pages"), (variant(health={"min_items": -1}), "min_items"),
    (variant(colour="red"), "extra keys"),
    (variant(item__fields=[{"name": "id", "selector": "a"}, {"name": "id", "selector": "b"}]), "duplicate"),
    (variant(item__container="div["), "Invalid css selector"),
    (variant(item__container="//div[", item__container_type="xpath"), "Invalid xpath selector"),
    (variant(pagination={"next": "a[", "max_pages": 2}), "Invalid css selector"),
    (variant(item__fields=[{"name": "id", "selector": "a", "selector_type": "regex"}]), "selector_type"),
])
def test_each_rule_rejects(spark, doc, fragment):
    got = checked(spark, [BASE, doc])
    assert got[0].violations == []
    assert any(fragment in v for v in got[1].violations), got[1].violations


def test_defaults_applied(spark):
    r = checked(spark, [BASE])[0]
    assert r.config.render is False and r.config.pagination.max_pages == 1
    assert r.config.health.min_items == 1 and r.config.rate_limit.rps == 1
    assert r.config.item.container_type == "css" and r.config.item.fields[0].selector_type == "css"


def test_yaml_loading(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("name: b-src\nurl: https://b.example.com/\nschedule: '0 * * * *'\n"
                                     "item:\n  container: li\n  fields:\n    - {name: id, selector: 'a::attr(href)'}\n"
                                     "  dedupe_key: id\n")
    (tmp_path / "a.yaml").write_text("- just\n- a list\n")
    (tmp_path / "c.yaml").write_text("name: [unclosed\n")
    rows = load_configs(spark, str(tmp_path)).collect()
    assert [r.file.rsplit("/", 1)[-1] for r in rows] == ["a.yaml", "b.yaml", "c.yaml"]
    assert "mapping" in rows[0].violations[0] and rows[1].violations == [] and rows[2].violations
    texts = spark.createDataFrame([("x: 1",)], "config_yaml string")
    assert parse_texts(texts).first().raw_json == '{"x": 1}'


def sources_df(spark):
    rows = [("id-a", "a", "", "file", "name: a\n", "sha-a", None, None, None, None),
            ("id-b", "b", "", "api", "name: b\n", "sha-b", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, name string, description string, origin string, config_yaml string, "
                                     "config_sha string, created_at timestamp, updated_at timestamp, "
                                     "config struct<name:string,description:string,url:string>, base_url string")
    return df.withColumn("config_sha", F.substring(F.sha2("config_yaml", 256), 1, 12))


def test_sync_create_update_delete(spark):
    src = sources_df(spark)
    fc = spark.createDataFrame([("a", "name: a\n", {"name": "a", "description": "", "url": "https://a/"}),
                                ("b", "name: b\nx: 1\n", {"name": "b", "description": "d", "url": "https://b/"}),
                                ("c", "name: c\n", {"name": "c", "description": "", "url": "https://c/"})],
                               "name string, config_yaml string, config struct<name:string,description:string,url:string>")
    nxt, oc = S.sync(src, fc, "2024-01-01 00:00:00")
    assert {r.name: r.outcome for r in oc.collect()} == {"a": "unchanged", "b": "updated", "c": "inserted"}
    got = {r.name: r for r in nxt.collect()}
    assert got["b"].origin == "file" and got["c"].origin == "file" and got["a"].updated_at is None
    req = spark.createDataFrame([("a", 0, "name: a\n", {"name": "a", "description": "", "url": "u"}),
                                 ("z", 1, "name: z\n", {"name": "z", "description": "", "url": "u"}),
                                 ("z", 2, "name: z\n", {"name": "z", "description": "", "url": "u"})],
                                "name string, req_ix int, config_yaml string, "
                                "config struct<name:string,description:string,url:string>")
    nxt2, oc2 = S.create(src, req, "2024-01-01 00:00:00")
    assert sorted((r.name, r.req_ix, r.outcome) for r in oc2.collect()) == [
        ("a", 0, "rejected"), ("z", 1, "inserted"), ("z", 2, "rejected")]
    assert nxt2.count() == 3
    upd = spark.createDataFrame([("a", "y", {"name": "a", "description": "", "url": "u"}),
                                 ("b", "y", {"name": "other", "description": "", "url": "u"}),
                                 ("q", "y", {"name": "q", "description": "", "url": "u"})],
                                "path_name string, config_yaml string, config struct<name:string,description:string,url:string>")
    _, oc3 = S.update(src, upd, "2024-01-01 00:00:00")
    assert {r.path_name: r.outcome for r in oc3.collect()} == {"a": "immutable", "b": "name_mismatch", "q": "not_found"}
    _, oc3b = S.update(src, upd.where("path_name = 'a'"), "2024-01-01 00:00:00", allow_file_origin=True)
    assert oc3b.first().outcome == "updated"
    nxt4, oc4 = S.delete(src, spark.createDataFrame([("a",), ("b",), ("q",)], "name string"))
    assert {r.name: r.outcome for r in oc4.collect()} == {"a": "immutable", "b": "deleted", "q": "not_found"}
    items = spark.createDataFrame([("id-a", "1"), ("id-b", "2")], "source_id string, dedupe_key string")
    assert [r.source_id for r in S.cascade(items, oc4.where("outcome = 'deleted'")).collect()] == ["id-a"]
    heals = spark.createDataFrame([("h1", "r1"), ("h2", "r2")], "id string, run_id string")
    out = {r.id: r.run_id for r in S.null_deleted_runs(heals, spark.createDataFrame([("r1",)], "run_id string")).collect()}
    assert out == {"h1": None, "h2": "r2"}


def test_submit_host_guard(spark):
    docs = [dict(BASE, name="good", url="https://example.com/"), dict(BASE, name="local", url="http://127.0.0.1/"),
            dict(BASE, name="meta", url="http://169.254.169.254/"), dict(BASE, name="Bad", url="https://e.com/")]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "raw_json string")
    chk = C.violations(df).withColumn("config_yaml", F.col("raw_json"))
    src = sources_df(spark).drop("config").withColumn("config", F.lit(None).cast(chk.schema["config"].dataType))
    _, oc = S.submit(chk, src, "2024-01-01 00:00:00")
    got = {r.name: r.outcome for r in oc.collect()}
    assert got == {"good": "inserted", "local": "rejected", "meta": "rejected", "Bad": "rejected"}


def quarry(rows, tag="b"):
    """A page of stone samples: one <figure> per row."""
    return "".join(f"<figure data-no='{n}'><{tag}>{name}</{tag}></figure>" for n, name in rows)


STONES = [(11, "basalt"), (12, "gneiss"), (13, "slate")]
STONE_CONFIG = {"name": "stones", "url": "https://stones.example/", "item": {
    "container": "figure", "container_type": "css", "dedupe_key": "no", "fields": [
        {"name": "stone", "selector": "i::text", "selector_type": "css", "attr": None},
        {"name": "no", "selector": "::attr(data-no)", "selector_type": "css", "attr": None}]}, "health": {"min_items": 4}}
SOURCE_SCHEMA = ("id string, name string, description string, origin string, config_yaml string, config_sha string, "
                 "created_at timestamp, updated_at timestamp, config struct<name:string,url:string,item:struct<"
                 "container:string,container_type:string,fields:array<struct<name:string,selector:string,"
                 "selector_type:string,attr:string>>,dedupe_key:string>,health:struct<min_items:int>>, base_url string")
PROPOSALS = "source_id string, run_id string, target string, old_selector string, selector_type string, raw_json string"


def stone_sources(spark, origins):
    return spark.createDataFrame([(o, f"{o}-stones", "", o, "text", "sha", None, None, STONE_CONFIG, "https://stones.example/")
                                  for o in origins], SOURCE_SCHEMA)


def proposal(source, target, **said):
    return (source, None, target, "i::text", "css", json.dumps(said))


def test_what_needs_repair(spark):
    src = stone_sources(spark, ["api", "file"])
    raw = spark.createDataFrame([("api", {"stone": None, "no": str(n)}) for n, _ in STONES], "source_id string, data map<string,string>")
    assert {(r.source_id, r.target) for r in RP.targets(raw, src).collect()} == {("api", "stone"), ("file", "container")}
    runs = spark.createDataFrame([(i, "api", status, n) for i, (status, n) in enumerate([("ok", 3), ("ok", 4), ("error", 0), ("ok", 0)])],
                                 "run_id int, source_id string, status string, item_count long")
    assert sorted(r.run_id for r in RP.unhealthy(runs, src).collect()) == [0, 3]


def test_best_valid_proposal_is_applied(spark):
    src = stone_sources(spark, ["api", "file"])
    pages = spark.createDataFrame([(o, quarry(STONES)) for o in ("api", "file")], "source_id string, html string")
    rows = []
    for o in ("api", "file"):
        rows += [proposal(o, "stone", selector="figure > b::text", confidence=0.6, reasoning="low"),
                 proposal(o, "stone", selector="b::text", confidence=0.845, reasoning="high", sample_values=["basalt"]),
                 proposal(o, "stone", selector="u::text", confidence=0.99, reasoning="finds nothing"),
                 proposal(o, "stone", selector="figure b::text", confidence=3, reasoning="no such confidence"),
                 proposal(o, "stone", selector="b", confidence=0.9), proposal(o, "stone", selector=None, confidence=0.5, reasoning="none")]
    rows.append(("api", None, "no", "x", "css", "{"))
    parsed = RP.parse_proposals(spark.createDataFrame(rows, PROPOSALS))
    assert parsed.where("proposal_error IS NOT NULL").count() == 5
    nxt, heals, patches = RP.apply(RP.score(parsed, pages), src, as_of="2024-01-01 00:00:00")
    got = sorted((r.source_id, r.new_selector, r.applied) for r in heals.collect())
    each = [("b", False), ("b::text", True), ("figure > b::text", False), ("figure b::text", False), ("u::text", False)]
    assert got == [("api", s, ok) for s, ok in each] + [("file", s, False) for s, _ in each]
    selectors = {r.origin: [f.selector for f in r.config.item.fields] for r in nxt.collect()}
    assert selectors == {"api": ["b::text", "::attr(data-no)"], "file": ["i::text", "::attr(data-no)"]}
    record = patches.collect()
    assert len(record) == 1 and record[0].source_name == "file-stones" and "84%" in record[0].body and "basalt" in record[0].body
    assert "figure > b::text" not in record[0].body


def test_container_first_then_its_fields(spark):
    from snapfeed.operators import extract
    src = stone_sources(spark, ["api"])
    page = quarry(STONES, "em").replace("figure", "aside")
    pages = spark.createDataFrame([("api", "https://stones.example/", page)], "source_id string, url string, html string")
    for target, selector in (("container", "aside"), ("stone", "em::text")):
        raw = extract.extract_items(pages, src.select(F.col("id").alias("source_id"), "config")).where("data IS NOT NULL")
        assert [r.target for r in RP.targets(raw, src).collect()] == [target]
        one = spark.createDataFrame([proposal("api", target, selector=selector, confidence=0.9, reasoning="seen")], PROPOSALS)
        src = RP.apply(RP.score(RP.parse_proposals(one), pages), src)[0]
    raw = extract.extract_items(pages, src.select(F.col("id").alias("source_id"), "config"))
    assert sorted(r.data["stone"] for r in raw.collect()) == sorted(n for _, n in STONES)
    marked = pages.withColumn("html", F.lit("<p class='s1'>a</p><p class='s1'>b</p>")).withColumn("page_id", F.lit(1))
    assert [r.selector for r in RP.mine_candidates(marked, src).collect()] == ["p.s1"]


def test_repeated_requests_leave_one_row_per_name(spark):
    src = sources_df(spark)
    kind = "name string, req_ix int, config_yaml string, config struct<name:string,description:string,url:string>"
    row = lambda name, ix, text: (name, ix, text, {"name": name, "description": text, "url": "u"})
    twice = spark.createDataFrame([row("b", 1, "first"), row("b", 2, "second"), row("new", 2, "y"), row("new", 1, "x")], kind)
    nxt, _ = S.sync(src, twice, "2024-01-01 00:00:00")
    assert sorted((r.name, r.config_yaml) for r in nxt.collect() if r.name in ("b", "new")) == [("b", "second"), ("new", "y")]
    nxt, out = S.update(src, twice.withColumnRenamed("name", "path_name"), "2024-01-01 00:00:00")
    assert [r.config_yaml for r in nxt.collect() if r.name == "b"] == ["second"] and nxt.count() == src.count() and out.count() == 4
    same = spark.createDataFrame([row("q", 0, "t")] * 3, kind).drop("req_ix")
    nxt, out = S.create(src, same, "2024-01-01 00:00:00")
    assert sorted(r.outcome for r in out.collect()) == ["inserted", "rejected", "rejected"] and nxt.count() == src.count() + 1


@pytest.mark.parametrize("change,fault", [
    ({"pagination": {"max_pages": "two"}}, "pagination.max_pages: not"), ({"health": {"min_items": 1.5}}, "health.min_items: not"),
    ({"rate_limit": {"rps": None}}, "rate_limit.rps: not"), ({"render": "maybe"}, "render: not"), ({"description": 5}, "description: wrong"),
    ({"description": None}, "description: wrong"), ({"name": 7}, "name: wrong"), ({"pagination": []}, "pagination: wrong"),
    ({"actions": {}}, "actions: wrong"), ({"render": True, "actions": [{"selector": "a"}]}, "actions.type: field required"),
    ({"render": True, "actions": ["x"]}, "actions: not a mapping")])
def test_strict_kinds(spark, change, fault):
    chk = lambda doc: C.violations(spark.createDataFrame([(json.dumps(doc),)], "raw_json string")).first().violations
    assert chk(BASE) == []
    found = chk(dict(BASE, **change))
    assert any(f.startswith(fault) for f in found), found


@pytest.mark.parametrize("level,name", [("", "url"), ("", "schedule"), ("", "item"), ("item", "container"), ("item", "fields"), ("item", "dedupe_key"),
                                        ("field", "name"), ("field", "selector")])
def test_members_that_must_be_there(spark, level, name):
    doc = json.loads(json.dumps(BASE))
    at = doc if not level else doc["item"] if level == "item" else doc["item"]["fields"][0]
    del at[name]
    found = C.violations(spark.createDataFrame([(json.dumps(doc),)], "raw_json string")).first().violations
    assert any(f.endswith(f"{name}: field required") for f in found), found


def test_numbers_and_truth_written_as_text(spark):
    doc = dict(BASE, pagination={"max_pages": "3"}, health={"min_items": 2.0}, render="yes", wait_for="x")
    r = C.violations(spark.createDataFrame([(json.dumps(doc),)], "raw_json string")).first()
    assert r.violations == [] and (r.config.pagination.max_pages, r.config.health.min_items, r.config.render) == (3, 2, True)
