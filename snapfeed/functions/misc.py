"""Small scalar helpers: durations, percentages, staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

def duration_ms(started, ended) -> Column:
    """max(0, whole milliseconds between two timestamps), truncating like int(); bigint."""
    micros = F.unix_micros(_col(ended)) - F.unix_micros(_col(started))
    ms = F.when(micros >= 0, F.floor(micros / 1000)).otherwise(F.ceil(micros / 1000))
    return F.greatest(F.lit(0).cast("long"), ms.cast("long"))


def percent_text(c) -> Column:
    """``format(x, '.0%')``: round half to even on x*100, then a percent sign."""
    return F.format_string("%d%%", F.rint(_col(c) * 100).cast("long"))


def staleness_interval(c) -> Column:
    """``24h`` / ``7d`` / ``30m`` / ``45s`` -> day-time interval (null when malformed)."""
    c = _col(c)
    n = F.regexp_extract(c, "^\\s*([0-9]+)\\s*([smhd])\\s*$", 1)
    unit = F.regexp_extract(c, "^\\s*([0-9]+)\\s*([smhd])\\s*$", 2)
    secs = n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600) \
        .when(unit == "d", 86400)
    return F.when(n != "", F.make_dt_interval(secs=secs.cast("decimal(18,6)")))


def slug_ok(c, max_len: int | None = None) -> Column:
    c = _col(c)
    ok = c.rlike("^[a-z0-9-]+\\z")
    return ok & (F.length(c) <= max_len) if max_len else ok
