"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A source's target is its weighted share of all words, held at ``max_epochs``
times its own size; what the cap cuts off goes to the other sources by weight,
again and again until no target is above its cap. A source then takes its
documents a whole number of times plus a fraction: the documents first in a
seeded order (MD5 of seed and doc_id) are taken once more up to the word that
meets the target.

Defined cases: null text has size 0; null source is a source of its own, last
in order; documents of size 0 take nothing; a source of size 0 has target 0;
rows with the same doc_id in one source share one place in the order and, at
the cut, split it in proportion to size; an empty table gives an empty result;
columns of the input named like the result's (size, source_size, target,
taken) are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, small, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 32
# The seeded order is refined by so many hex digits at a time; the rows that a
# source's last step orders one by one are its share of 16 ** -(2 * STEP).
STEP = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) by code point, null last: a range sort, then each
    partition's rows counted; no task sees more than its range."""
    spread = stored(sources.orderBy(F.col("source").asc_nulls_last())
                    .withColumn("_seq", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_seq", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy(part.alias("_part")).count()  # one row per partition
               .withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    return (spread.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("rank", F.col("_off") + F.col("_seq").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_off", "_seq"))


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size): adds weight and target."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stored(ranked(sources).withColumn("weight", w).drop("rank"), "mix-weights")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weight if weight else 0.0
    held = -1
    while total:
        is_held = cap <= F.lit(level) * F.col("weight")
        n, words, rest = weighed.agg(F.count_if(is_held), F.sum(F.when(is_held, cap)),
                                     F.sum(F.when(~is_held, F.col("weight")))).first()
        if n == held or not rest:
            break
        held, level = n, (total - (words or 0.0)) / rest
    return weighed.withColumn("target", F.least(cap, F.lit(float(level)) * F.col("weight")))


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: size, target, whole repetitions, and the key at which
    the fractional one ends (documents at it take cut_num / cut_den of their words)."""
    sized = stored(docs.select("source", size_of(F.col("text")).alias("size"), order_key(seed).alias("key"))
                   .groupBy("source", "key").agg(F.sum("size").alias("size")), "mix-sizes")
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    full = F.col("source_size") > 0
    per = stored(per.withColumn("whole", F.when(full, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
                 .withColumn("left", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
                 .withColumn("at", F.lit("")), "mix-targets")
    by = Window.partitionBy("source")
    last = 32
    for digits in (STEP, 2 * STEP, last):
        # keys below the place found so far are summed by their next digits; the
        # sum that passes the words left is the next place
        here = (sized.alias("a").join(small(per.select("source", "left", "at")).alias("b"),
                                      F.expr("a.source <=> b.source and startswith(a.key, b.at)"))
                .select("a.source", F.substring("key", 1, digits).alias("bucket"), "size", "left")
                .groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first("left").alias("left")))
        run = F.sum("size").over(by.orderBy("bucket"))
        found = (here.withColumn("run", run).where(F.col("run") > F.col("left"))
                 .groupBy("source").agg(F.min(F.struct("run", "bucket", "size")).alias("f"))
                 .select(F.col("source").alias("_s"), "f"))
        per = stored(per.join(found, F.expr("source <=> _s"), "left")  # one row per source on either side
                     .withColumn("left", F.when(F.col("f").isNotNull(), F.col("left") - F.col("f.run") + F.col("f.size")).otherwise(F.col("left")))
                     .withColumn("size", F.col("f.size"))
                     .withColumn("at", F.coalesce("f.bucket", F.lit("~"))).drop("_s", "f"), "mix-cut")
    return per.select("source", "source_size", "weight", "target", "whole", F.col("at").alias("cut_key"),
                      F.col("left").alias("cut_num"), F.coalesce("size", F.lit(1)).alias("cut_den"))


def with_plan(docs: DataFrame, per: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and taken. The plan is broadcast behind a
    count; beyond that it is repeated SALTS times and joined by source and salt,
    so a hot source is spread over SALTS tasks."""
    per = per.withColumnsRenamed({c: f"_{c}" for c in per.columns})
    sized = docs.drop("size", "source_size", "target", "taken").withColumn("size", size_of(F.col("text")))
    side = small(per)
    on = F.expr("source <=> _source")
    if side is per:
        sized = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        side = per.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_salt2"))
    key = order_key(seed)
    extra = (F.when(key < F.col("_cut_key"), F.col("size"))
             .when(key == F.col("_cut_key"), F.expr("size * _cut_num div _cut_den")).otherwise(F.lit(0)))
    return (sized.join(side, on)
            .withColumn("source_size", F.col("_source_size")).withColumn("target", F.col("_target"))
            .withColumn("taken", F.col("_whole") * F.col("size") + extra)
            .drop(*[c for c in ("_salt", "_salt2")], *per.columns))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes)."""
    return with_plan(docs, plan(docs, weights, max_epochs, seed), seed)


def mixed_rows(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken; the last
    repetition of the one document at a source's cut keeps its first words only."""
    rows = docs.select("doc_id", "text", "source", *aside(docs))
    out = mix(rows, weights, max_epochs, seed)
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(0)).cast("int")
    out = out.withColumn("_rest", F.col("taken") - whole * F.col("size"))
    times = F.concat(F.array_repeat(F.lit(False), whole), F.array_repeat(F.lit(True), F.when(F.col("_rest") > 0, 1).otherwise(0)))
    out = out.withColumn("_cut", F.explode(times))
    spans = F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))
    out = out.withColumn("text", F.when(F.col("_cut"), F.concat_ws("", F.slice(spans, F.lit(1), F.col("_rest").cast("int")))).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own = F.col(f"_in{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("_cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return out.select(*back(docs, **changed))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import prepare, table

    prepare(spark)
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS held,
             sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
lv AS (SELECT max((total - held) / rest) AS level FROM f WHERE (total - held) / rest <= ratio),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM f, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
k AS (SELECT source, key, sum(size)::BIGINT AS ksize FROM d GROUP BY source, key),
c AS (SELECT source, key, ksize, sum(ksize) OVER (PARTITION BY source ORDER BY key)::BIGINT - ksize AS before FROM k)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (p.whole * d.size + CASE WHEN c.ksize = 0 THEN 0 ELSE d.size * least(c.ksize, greatest(0, round(p.target)::BIGINT - p.whole * p.source_size - c.before)) // c.ksize END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key
"""
