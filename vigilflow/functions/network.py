"""IP address checks and canonical text, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
GROUP = "[0-9a-f]{1,4}"


def is_ipv4(c: Column) -> Column:
    """Four decimal octets up to 255 without leading zeros."""
    return c.rlike(IPV4)


def _hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def _v4_tail_as_groups(c: Column) -> Column:
    """``::1.2.3.4`` -> ``::102:304``."""
    tail = F.regexp_extract(c, r"([0-9.]+)$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda o: o.cast("int"))
    high = _hex(octets[0] * 256 + octets[1])
    low = _hex(octets[2] * 256 + octets[3])
    return F.concat(F.regexp_replace(c, r"[0-9.]+$", ""), high, F.lit(":"), low)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _shortest(plain: Column) -> Column:
    """Eight groups without leading zeros to the shortest form.

    The first of the longest runs of two or more zero groups becomes ``::``; a
    mapped IPv4 address is written with dots.
    """
    mapped = plain.rlike("^0:0:0:0:0:ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$")
    pair = F.transform(F.slice(F.split(plain, ":"), 7, 2), lambda g: F.conv(g, 16, 10).cast("int"))
    quad = F.concat_ws(
        ".", F.shiftright(pair[0], 8), pair[0].bitwiseAND(255), F.shiftright(pair[1], 8), pair[1].bitwiseAND(255)
    )
    packed = plain
    for run in range(2, 9):  # the longest run is tested first in the finished chain
        zeros = f"(?:^|:)0(?::0){{{run - 1}}}(?::|$)"
        shorter = F.regexp_replace(plain, f"^(.*?){zeros}(.*)$", "$1::$2")
        packed = F.when(plain.rlike(zeros), shorter).otherwise(packed)
    return F.when(mapped, F.concat(F.lit("::ffff:"), quad)).otherwise(packed)


def _expanded(bare: Column) -> Column:
    """All eight groups without leading zeros; NULL when they are not there."""
    gaps = F.regexp_count(bare, F.lit("::"))
    full = bare.rlike(f"^{GROUP}(:{GROUP}){{7}}$")
    given = F.size(F.filter(F.split(bare, ":"), lambda g: g != ""))
    ends = f"({GROUP}(:{GROUP}){{0,6}})?"
    short = bare.rlike(f"^({ends})::({ends})$") & (gaps == 1) & (given <= 7)
    missing = F.array_join(F.array_repeat(F.lit("0"), (F.lit(8) - given).cast("int")), ":")
    left, right = F.substring_index(bare, "::", 1), F.substring_index(bare, "::", -1)
    groups = F.when(full, bare).when(
        short, F.concat_ws(":", F.when(left != "", left), missing, F.when(right != "", right))
    )
    return F.regexp_replace(groups, "(^|:)0+(?=[0-9a-f])", "$1")


def canonical_ipv6(text: Column) -> Column:
    """Shortest lower-case form; NULL when it is no IPv6 address."""
    low = F.lower(F.substring_index(text, "%", 1))
    zone = F.regexp_extract(text, "(%.*)$", 1)
    zone_ok = ~text.contains("%") | zone.rlike("^%[^%]+$")
    dotted = low.contains(".")
    tail_ok = F.regexp_extract(low, r":([0-9.]+)$", 1).rlike(IPV4)
    bare = F.when(~dotted, low).when(tail_ok, _v4_tail_as_groups(low))
    packed = _let(bare, lambda b: _let(_expanded(b), _shortest))
    return F.when(zone_ok, F.concat(packed, zone))


def canonical_ip(c: Column | str) -> Column:
    """Canonical IPv4 or IPv6 text; NULL when the text is neither."""
    text = F.btrim(c, F.lit(" \t\n\r\f\v"))
    return F.when(is_ipv4(text), text).when(text.contains(":"), canonical_ipv6(text))
