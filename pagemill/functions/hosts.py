"""IP address predicates as expressions (no look-up table, so no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind_sql, pattern

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_GROUP = r"[0-9A-Fa-f]{1,4}"

# Address ranges a crawler must not reach.
BLOCKED_RANGES = (
    "127.0.0.0/8",
    "::1/128",
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "169.254.0.0/16",
    "fe80::/10",
    "fc00::/7",
    "0.0.0.0/8",
    "100.64.0.0/10",
)


def is_ipv4_sql(ip: str) -> str:
    return f"rlike({ip}, {pattern(rf'\A{_IPV4}\z')})"


def ipv4_number_sql(ip: str) -> str:
    """The address as a number, NULL when it is not a dotted IPv4 address."""
    terms = " + ".join(
        f"try_cast(get(split({ip}, '[.]'), {i}) AS bigint) * {1 << (24 - 8 * i)}" for i in range(4)
    )
    return f"CASE WHEN {is_ipv4_sql(ip)} THEN {terms} END"


def _hex_only_sql(ip: str) -> str:
    """The address without zone, a dotted tail written as two hexadecimal groups."""
    bare = f"regexp_replace({ip}, {pattern(r'%[^%]+\z')}, '')"
    tail = f"regexp_extract(v6_bare, {pattern(rf':({_IPV4})\z')}, 1)"
    number = ipv4_number_sql("v6_tail")
    pair = "concat(hex(shiftright(v6_number, 16)), ':', hex(v6_number & 65535))"
    written = f"concat(regexp_replace(v6_bare, {pattern(rf'{_IPV4}\z')}, ''), {bind_sql(number, 'v6_number', pair)})"
    chosen = f"CASE WHEN v6_tail = '' THEN v6_bare ELSE {written} END"
    return bind_sql(bare, "v6_bare", bind_sql(tail, "v6_tail", chosen))


def _is_v6_form_sql(full: str) -> str:
    long_form = pattern(rf"\A{_GROUP}(?::{_GROUP}){{7}}\z")
    short_form = pattern(rf"\A(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?\z")
    groups = f"size(filter(split({full}, ':'), g -> g <> ''))"
    return f"(rlike({full}, {long_form}) OR (rlike({full}, {short_form}) AND {groups} <= 7))"


def is_ipv6_sql(ip: str) -> str:
    return bind_sql(_hex_only_sql(ip), "v6", _is_v6_form_sql("v6"))


def is_blocked_ip_sql(ip: str) -> str:
    ranges = []
    for cidr in BLOCKED_RANGES:
        net, bits = cidr.split("/")
        if ":" not in net:
            low = sum(int(octet) << (24 - 8 * i) for i, octet in enumerate(net.split(".")))
            ranges.append(f"v4 BETWEEN {low} AND {low + (1 << (32 - int(bits))) - 1}")
    in_v4 = bind_sql(ipv4_number_sql(ip), "v4", " OR ".join(ranges))
    # ::1 is "all zero but a final 1"; the other two are told by the first group
    first = f"try_cast(conv(regexp_extract(v6, {pattern(rf'\A({_GROUP}):')}, 1), 16, 10) AS int)"
    wide = " OR ".join(
        f"{first} BETWEEN {low} AND {low + (1 << (16 - int(bits))) - 1}"
        for low, bits in (
            (int(net.split("::")[0], 16), bits)
            for net, bits in (cidr.split("/") for cidr in BLOCKED_RANGES)
            if net.endswith("::")
        )
    )
    in_v6 = (
        f"CASE WHEN NOT {_is_v6_form_sql('v6')} THEN true "
        f"ELSE rlike(v6, {pattern(r'\A[0:]*:0{0,3}1\z')}) OR coalesce({wide}, false) END"
    )
    return f"CASE WHEN {is_ipv4_sql(ip)} THEN {in_v4} ELSE {bind_sql(_hex_only_sql(ip), 'v6', in_v6)} END"


def is_ipv6(ip: str) -> Column:
    return F.expr(is_ipv6_sql(ip))


def is_blocked_ip(ip: str) -> Column:
    """In a blocked range, or not an address at all."""
    return F.expr(is_blocked_ip_sql(ip))
