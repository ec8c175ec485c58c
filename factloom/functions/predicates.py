"""Checks on addresses, keys, heartbeats and headings."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not reachable from everywhere.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
PRIVATE_V6 = ("::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
_PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_PART}(?:\.{_PART}){{3}}$"

# Bounds of a maintenance heartbeat, in milliseconds.
MOST_AGE, MOST_AHEAD, MOST_DURATION, MOST_BUDGET = 900_000, 60_000, 50_000, 45_000


def _public_v6(addresses: pd.Series) -> pd.Series:
    networks = [ipaddress.IPv6Network(n) for n in PRIVATE_V6]

    def public(text: str | None) -> bool:
        try:
            address = ipaddress.IPv6Address(text or "")
        except ValueError:
            return False
        return not any(address in n for n in networks)

    return addresses.map(public).astype(bool)


def public_v4(address: Column) -> Column:
    """Whether an IPv4 address is outside all private networks; false for anything else."""
    parts = F.split(address, r"\.")
    number = sum(parts[i].cast("long") * (1 << (24 - 8 * i)) for i in range(4))
    inside = F.lit(False)
    for network in map(ipaddress.IPv4Network, PRIVATE_V4):
        inside = inside | number.between(int(network.network_address), int(network.broadcast_address))
    return F.coalesce(F.when(address.rlike(V4), ~inside), F.lit(False))


def public_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is reachable from everywhere."""
    return public_v4(address) | F.pandas_udf(_public_v6, "boolean", F.PandasUDFType.SCALAR)(address)


def allowed_url(url: Column, host: str) -> Column:
    """Whether a URL is HTTPS on the host, without credentials and on the usual port."""
    here = F.lower(F.try_parse_url(url, F.lit("HOST"))) == host.lower()
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & here & ~authority.contains("@") & authority.rlike(r"^[^:]+(?::443)?$"), F.lit(False))


def valid_request_key(key: Column) -> Column:
    """Whether an idempotency key is absent or 8 to 200 visible ASCII characters."""
    return F.coalesce(F.trim(key) == "", F.lit(True)) | F.trim(key).rlike(r"^[\x21-\x7e]{8,200}$")


def heartbeat_status(completed: Column, duration_ms: Column, budget_ms: Column, now: Column) -> Column:
    """missing, stale or fresh."""
    bounded = duration_ms.between(0, MOST_DURATION) & budget_ms.between(1, MOST_BUDGET) & (duration_ms <= budget_ms)
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(completed.cast("timestamp"))
    return F.when(completed.isNull(), "missing").when(bounded & age.between(-MOST_AHEAD, MOST_AGE), "fresh").otherwise("stale")


def amendment_in(heading: Column) -> Column:
    """The amendment or revision number of a heading, of three digits."""
    return F.lpad(F.nullif(F.regexp_extract(heading, r"(?i)(?:amendment\s*(?:no\.?\s*)?|revision\s+)(\d{1,3})(?![A-Za-z0-9_])", 1), F.lit("")), 3, "0")


def solicitation_in(heading: Column) -> Column:
    return F.nullif(F.regexp_extract(heading, r"(?i)solicitation\s*(?:no\.?|number)?\s*[:#]?\s*([A-Z0-9][A-Z0-9/-]{4,})", 1), F.lit(""))
