"""Host text that needs Unicode tables: NFKC, IDNA names and IPv6 text.

Spark has no built-in for these, so one Arrow UDF handles the few hosts that are not plain ASCII names; rows that do not need it pass a null. Scripts, IPv4 in all
its spellings and the IPv4 ranges are column expressions in :mod:`urlrisk.operators.canonical`, for all hosts alike.
"""

from __future__ import annotations

import sys
from ipaddress import AddressValueError, IPv6Address, IPv6Network
from unicodedata import normalize
from urllib.parse import urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the functions of this module with the job, so executors do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: scripts whose mixture inside one label is flagged
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI")

# fixed values: IPv6 ranges that count as private, loopback, link-local or reserved, and the public ranges inside them
LOCAL_V6 = """
::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fe00::/9
2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10
""".split()
PUBLIC_V6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def _bounds(networks: list[str]) -> list[tuple[int, int]]:
    return [(int(n.network_address), int(n.broadcast_address)) for n in map(IPv6Network, networks)]


LOCAL_BOUNDS, PUBLIC_BOUNDS = _bounds(LOCAL_V6), _bounds(PUBLIC_V6)
MAPPED = 0xFFFF << 32  # IPv4 inside IPv6 starts here

HOST_TYPE = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("punycode_host", T.StringType()),
        T.StructField("is_idn", T.BooleanType()),
        T.StructField("has_punycode", T.BooleanType()),
        T.StructField("v6", T.StringType()),
        T.StructField("v6_local", T.BooleanType()),
        T.StructField("v4_number", T.LongType()),
    ]
)


def mixed_script(host: Column) -> Column:
    """Whether a label of ``host`` has letters of more than one of ``SCRIPTS``."""

    def several(label: Column) -> Column:
        present = [label.rlike(rf"[\p{{L}}&&\p{{Is{script.capitalize()}}}]").cast("int") for script in SCRIPTS]
        return sum(present[1:], present[0]) > 1

    # plain ASCII names have one script
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.exists(F.split(host, r"\."), several)).otherwise(F.lit(False))


def _idna(name: str) -> tuple[str, str, bool]:
    """Unicode form, ASCII form, whether the name is international. A name that the codec refuses stays as it is."""
    try:
        if name.isascii():
            return (name.encode().decode("idna"), name, True) if "xn--" in name else (name, name, False)
        return name, name.encode("idna").decode(), True
    except UnicodeError:
        return name, name, not name.isascii()


def _v6(name: str) -> tuple[str | None, bool, int | None]:
    """Compressed text, whether it lies in a local range, and the number of an IPv4 address inside it; such a number is judged as IPv4."""
    try:
        address = IPv6Address(name.strip("[]"))
    except AddressValueError:
        return None, False, None
    number = int(address)
    if number >> 32 == MAPPED >> 32:
        return str(address), False, number - MAPPED
    within = lambda bounds: any(low <= number <= high for low, high in bounds)
    return str(address), within(LOCAL_BOUNDS) and not within(PUBLIC_BOUNDS), None


def _split_error(netloc: str) -> str | None:
    try:
        urlsplit("http://" + netloc)
    except ValueError as refused:
        return f"Malformed URL: {refused}"
    return None


@F.pandas_udf(HOST_TYPE)
def unicode_host(netloc: pd.Series, host_text: pd.Series) -> pd.DataFrame:
    """Normalize special hosts; null in, null out. Each distinct pair of a batch is worked on once."""
    asked = pd.DataFrame({"netloc": netloc, "text": host_text}).dropna()
    out = pd.DataFrame(None, index=netloc.index, columns=HOST_TYPE.names, dtype=object)
    if asked.empty:
        return out
    distinct = asked.drop_duplicates()
    rows = []
    for pair in distinct.itertuples(index=False):
        folded = normalize("NFKC", pair.text.strip(".").lower())
        name, ascii_name, international = _idna(folded)
        encoded = folded.isascii() and "xn--" in folded
        rows.append((_split_error(pair.netloc), name, ascii_name, international, encoded, *_v6(name)))
    known = pd.DataFrame(rows, index=pd.MultiIndex.from_frame(distinct), columns=HOST_TYPE.names, dtype=object)
    out.loc[asked.index] = known.loc[pd.MultiIndex.from_frame(asked)].to_numpy()
    return out.where(out.notna(), None)
