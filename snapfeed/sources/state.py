"""SNK1 / SRC4: item state as immutable versions under one base folder.

Two layouts: whole snapshots (``publish`` / ``read_current``) and per-source
versions (``publish_sources`` / ``read_sources``), where a version rewrites
only the sources it touched (``sources.commits``, which the change feed uses).

``publish`` writes ``<base>/v=<n>`` (parquet, partitioned by source_id so a
scan for some sources prunes the rest) and Spark's committer marks it with
``_SUCCESS``; ``read_current`` reads the newest committed version. Nothing is
ever overwritten in place, so a reader never sees a half-written state and a
lost job leaves the previous version intact. Replays are idempotent: a
version number that is already committed is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import commits


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def committed_versions(spark: SparkSession, base: str) -> list[int]:
    fs, p, jvm = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                try:
                    out.append(int(name[2:]))
                except ValueError:
                    pass
    return sorted(out)


def current_version(spark: SparkSession, base: str) -> int | None:
    v = committed_versions(spark, base)
    return v[-1] if v else None


def read_current(spark: SparkSession, base: str, schema=None) -> DataFrame | None:
    v = current_version(spark, base)
    if v is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(f"{base.rstrip('/')}/v={v}")


def publish(df: DataFrame, base: str, version: int | None = None, partition_by: str | None = "source_id") -> int:
    """Write ``df`` as version ``version`` (default: next); returns the version.
    An already committed version is left untouched (idempotent replay)."""
    spark = df.sparkSession
    if version is None:
        cur = current_version(spark, base)
        version = 0 if cur is None else cur + 1
    if version in committed_versions(spark, base):
        return version
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(f"{base.rstrip('/')}/v={version}")
    return version


# ---------------------------------------------------------------------------
# Per-source versions: the commit log of ``sources.commits`` under explicit
# version numbers, for callers that are the only writer.


def manifest_versions(spark: SparkSession, base: str) -> list[int]:
    return commits.versions(spark, base)


def read_manifest(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    return commits.entries(spark, base, version) if commits.versions(spark, base) else None


def read_sources(spark: SparkSession, base: str, sources: DataFrame | None = None, version: int | None = None,
                 schema=None) -> DataFrame | None:
    """Current rows of all sources, or of ``sources`` (DataFrame with source_id),
    as of ``version`` (default: the newest)."""
    return commits.read_sources(spark, base, sources, version, schema)


def last_batch(spark: SparkSession, base: str) -> int | None:
    return commits.last_batch(spark, base)


def publish_sources(rows: DataFrame, touched: DataFrame, base: str, version: int, batch_id: int | None = None) -> int:
    """Commit ``version``: ``rows`` are the complete new rows of the ``touched``
    sources, computed from the version before; every other source keeps its
    rows. Idempotent: an already committed version is left as it is. With
    several writers use ``commits.update``, which reads again after a conflict."""
    if version in manifest_versions(rows.sparkSession, base):
        return version
    return commits.publish(rows, touched, base, min(version - 1, max(manifest_versions(rows.sparkSession, base), default=0)), batch_id=batch_id)


def compact(spark: SparkSession, base: str, version: int, schema=None) -> int:
    """Rewrite every source's current rows as ``version``; older files are then
    unreferenced (``commits.vacuum``). Idempotent like ``publish_sources``."""
    return version if version in manifest_versions(spark, base) else commits.compact(spark, base)
