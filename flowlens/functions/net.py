"""Addresses and protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_IP = "0.0.0.0"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^\s*0*{_OCTET}(?:\.0*{_OCTET}){{3}}\s*$"
IPV4_CANONICAL = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Protocol names as they appear in lines, and labels shown on pages.
PROTOCOL_NUMBERS = {
    "tcp": 6, "udp": 17, "icmp": 1, "ipsec": 50, "gre": 47, "esp": 50, "ah": 51, "sctp": 132,
    "ospf": 89, "pim": 103, "igmp": 2, "ipv6": 41, "ipv6-icmp": 58,
}
PROTOCOL_LABELS = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def is_ipv4(address: Column) -> Column:
    """Four dotted numbers from 0 to 255; leading zeros are allowed. NULL is not an address."""
    return F.coalesce(address.rlike(IPV4), F.lit(False))


def clean_ipv4(address: Column) -> Column:
    return F.when(address.rlike(IPV4), F.trim(address)).otherwise(NO_IP)


def is_external(address: Column) -> Column:
    """Not private, not link-local and not 127.0.0.1. Prefix tests reach the Parquet reader."""
    return ~(
        address.startswith("10.")
        | address.startswith("192.168.")
        | address.startswith("169.254.")
        | (address == "127.0.0.1")
        | address.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\.")
    )


def subnet24(address: Column) -> Column:
    """The /24 network of an IPv4 address; anything else stands for itself."""
    return F.when(
        address.rlike(IPV4_CANONICAL), F.concat(F.substring_index(address, ".", 3), F.lit(".0/24"))
    ).otherwise(address)


def protocol_number(name: Column) -> Column:
    """Name or digits to a number, 0 when unknown."""
    key = F.lower(F.trim(name))
    return F.coalesce(
        F.try_element_at(literal_map(PROTOCOL_NUMBERS), key),
        F.when(key.rlike("^[0-9]+$"), key.try_cast("int")),
        F.lit(0),
    )


def protocol_label(number: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(PROTOCOL_LABELS), number.cast("int")), number.cast("string")
    )
