"""Small builders for operator tests."""

from pyspark.sql import functions as F

CONFIG_SCHEMA = ("source_id string, config struct<name:string,url:string,item:struct<container:string,"
                 "container_type:string,fields:array<struct<name:string,selector:string,selector_type:string,"
                 "attr:string>>,dedupe_key:string>,pagination:struct<next:string,next_type:string,max_pages:int>>")


def config_row(source_id, container, fields, key, url="https://example.com/", next_sel=None, max_pages=1,
               container_type="css"):
    return (source_id, {"name": source_id, "url": url,
                        "item": {"container": container, "container_type": container_type,
                                 "fields": [{"name": n, "selector": s, "selector_type": t, "attr": a}
                                            for n, s, t, a in fields],
                                 "dedupe_key": key},
                        "pagination": {"next": next_sel, "next_type": "css", "max_pages": max_pages}})


def configs(spark, rows):
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def items_df(spark, rows):
    """rows: (source_id, run_id, item_idx, dict)"""
    return spark.createDataFrame(
        [(s, r, 1, i, d) for s, r, i, d in rows],
        "source_id string, run_id string, page_no int, item_idx int, data map<string,string>")


def ts(s):
    return F.lit(s).cast("timestamp")
