"""Public-host guard for submitted source URLs (no DNS; syntax only)."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col

# Host names refused outright, and refused name suffixes.
BLOCKED_HOSTS = ("localhost", "metadata", "metadata.google.internal", "instance-data",
                 "kubernetes.default", "kubernetes.default.svc")
BLOCKED_SUFFIXES = (".local", ".internal", ".localdomain")

# IPv4 ranges that are not globally reachable (Python 3.13
# ipaddress ``is_global`` is False), as (first, last) dotted quads, and the two
# addresses inside them that are global.
IPV4_NOT_GLOBAL = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)
IPV4_GLOBAL_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_RE = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"


def _quad(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _ipv4_int(h: Column) -> Column:
    parts = F.split(h, "\\.")
    return sum((parts[i].cast("long") * F.lit(1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))


@F.pandas_udf(T.BooleanType())
def _ipv6_global_udf(s: pd.Series) -> pd.Series:
    def check(h):
        if h is None:
            return None
        try:
            return bool(ipaddress.ip_address(h).is_global)
        except ValueError:
            return True  # not an address: a host name
    return s.map(check).astype(object)


def host_is_public(host) -> Column:
    """False for empty, blocked, local-suffix, or non-global IP hosts."""
    raw = _col(host)
    h = F.lower(F.regexp_replace(raw, "^\\[+|\\]+$", ""))
    is_v4 = h.rlike(_IPV4_RE)
    n = _ipv4_int(h)
    v4_private = F.lit(False)
    for lo, hi in IPV4_NOT_GLOBAL:
        v4_private = v4_private | n.between(_quad(lo), _quad(hi))
    v4_exception = n.isin(*[_quad(x) for x in IPV4_GLOBAL_EXCEPTIONS])
    suffix = F.lit(False)
    for sfx in BLOCKED_SUFFIXES:
        suffix = suffix | F.endswith(h, F.lit(sfx))
    maybe_v6 = h.contains(":")
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(False))
        .when(h.isin(*BLOCKED_HOSTS) | suffix, F.lit(False))
        .when(is_v4, ~v4_private | v4_exception)
        .when(maybe_v6, _ipv6_global_udf(F.when(maybe_v6, h)))
        .otherwise(F.lit(True))
    )
