"""Addresses, endpoints and users in messages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import group, let

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def _ipv6(text: Column) -> Column:
    """Canonical text of an IPv6 address, null if it is none. Scope suffixes are not accepted."""
    dotted = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    octet = lambda k: F.get(F.split(dotted, r"\."), k).try_cast("int")
    pair = lambda k: F.lower(F.hex(octet(k) * 256 + octet(k + 1)))
    low = F.when(dotted == "", text).when(dotted.rlike(_IPV4), F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), pair(0), F.lit(":"), pair(2)))
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    sides = F.split(low, "::", -1)
    left, right = groups(F.get(sides, 0)), groups(F.coalesce(F.get(sides, 1), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    whole_ = F.concat(left, F.when(F.size(sides) == 2, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))).otherwise(F.array().cast("array<string>")), right)
    shaped = low.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & low.contains(":")
    good = shaped & (F.size(whole_) == 8) & ((F.size(sides) == 1) | (missing >= 1))
    return F.when(good, let(F.array_join(F.transform(whole_, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), _shortened))


def _shortened(joined: Column) -> Column:
    """Eight groups with their longest run of zeros left out: the first of equal ones, none of a single zero."""
    short = joined
    for n in range(2, 9):  # longer runs override
        run = rf"^(.*?)(?:^|(?<!:):|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
        exact = rf"(?:^|:)0(?::0){{{n - 1}}}(?:$|:)"
        short = F.when(joined.rlike(exact), F.regexp_replace(joined, run, "$1::$2")).otherwise(short)
    return short


def clean_ip(value: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 address, brackets around it dropped; empty if it is none."""
    text = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\[\]]+|[\[\]]+$", ""))
    return F.when(text.rlike(_IPV4), text).when(text.contains(":"), F.coalesce(let(text, _ipv6), F.lit(""))).otherwise("")


def _labelled(names: str, value: str) -> str:
    return rf"(?iU)\b(?:{names})\s*[=:]\s*{value}"


def with_endpoints(events: DataFrame) -> DataFrame:
    """Add network: struct(src, dst, src_port, dst_port, user, direction) named by the message.

    Addresses count where they are labelled, or after ``from`` in a login message. The host's own address gives
    the direction and is never taken for a peer. Needs message, category and host_ip.
    """
    message, address = F.col("message"), "([0-9a-fA-F:.]+)"
    port = lambda names: F.when(group(message, _labelled(names, r"(\d+)\b"), 1).try_cast("int").between(0, 65535), group(message, _labelled(names, r"(\d+)\b"), 1).try_cast("int"))
    named, logged = _labelled("user|username|account", r"([^\s,;]+)"), r"(?iU)\b(?:Failed password|Accepted password|Accepted publickey) for (?:invalid user )?(\S+)"
    user = F.coalesce(group(message, named, 1), group(message, logged, 1), F.lit(""))
    # In steps: each names what the one before has made, so that no expression is written out many times.
    texts = events.select(
        "*",
        group(message, _labelled("src|src_ip|source_ip|saddr", address), 1).alias("_src"),
        group(message, _labelled("dst|dst_ip|destination_ip|daddr", address), 1).alias("_dst"),
        F.when(F.col("category").isin("auth_failure", "auth_success"), group(message, rf"(?U)\bfrom\s+{address}", 1)).alias("_peer"),
        port("spt|sport|src_port").alias("_spt"), port("dpt|dport|dst_port").alias("_dpt"),
        F.regexp_replace(user, r"^[\"']+|[\"']+$", "").alias("_user"),
    )
    addresses = ("_src", "_dst", "_peer", "_own")
    told = texts.withColumn("_ips", F.transform(F.array("_src", "_dst", "_peer", "host_ip"), clean_ip))
    clean = told.withColumns({c: F.get("_ips", k) for k, c in enumerate(addresses)})
    known = clean.withColumn("_src", F.when(F.col("_src") == "", F.col("_peer")).otherwise(F.col("_src")))
    own, src, dst = F.col("_own"), F.col("_src"), F.col("_dst")
    direction = (
        F.when((own != "") & (src == own) & (dst != "") & (dst != own), "outbound")
        .when((own != "") & (dst == own) & (src != "") & (src != own), "inbound")
        .otherwise("unknown")
    )
    network = F.struct(src.alias("src"), dst.alias("dst"), F.col("_spt").alias("src_port"), F.col("_dpt").alias("dst_port"), F.col("_user").alias("user"), direction.alias("direction"))
    return known.withColumn("network", network).drop("_src", "_dst", "_peer", "_spt", "_dpt", "_user", "_own", "_ips")
