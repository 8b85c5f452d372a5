"""IP addresses by value, whatever their spelling."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An IPv4 address is held as its IPv4-mapped IPv6 address, so that both spellings have one value.
V4_MAPPED = 0xFFFF << 32


def _parsers():  # nested, so that executors get the code itself
    import ipaddress
    import re

    def parse(s):
        s = s.strip()
        if s.isascii() and s.isdigit() and int(s) < 1 << 32:
            return ipaddress.IPv4Address(int(s))
        try:
            a = ipaddress.ip_address(s)
        except ValueError:
            if not re.fullmatch(r"\d+(\.\d+){3}", s, re.A) or max(map(int, s.split("."))) > 255:  # leading zeros are decimal
                return None
            return ipaddress.IPv4Address(".".join(str(int(x)) for x in s.split(".")))
        return getattr(a, "ipv4_mapped", None) or a

    return parse


def canonical(c: Column | str) -> Column:
    """Dotted IPv4, or IPv6 as in RFC 5952; null if it is no address. Parses each spelling of a batch once."""
    make = _parsers

    import pandas as pd

    def text(s: pd.Series) -> pd.Series:
        parse = make()
        return s.map({x: None if (a := parse(x)) is None else str(a) for x in s.dropna().unique()})

    return F.pandas_udf(text, "string")(c)


def packed(c: Column | str) -> Column:
    """The address as BINARY of 4 bytes (IPv4) or 16 (IPv6), big-endian, so that bytes order as values; null if it is none."""
    make = _parsers

    import pandas as pd

    def raw(s: pd.Series) -> pd.Series:
        parse = make()
        return s.map({x: None if (a := parse(x)) is None else a.packed for x in s.dropna().unique()})

    return F.pandas_udf(raw, "binary")(c)


def dotted(c: Column | str) -> Column:
    """An unsigned 32-bit value as dotted IPv4, built-in functions only."""
    n = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)))
