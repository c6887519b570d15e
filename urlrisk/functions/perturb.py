"""String perturbations of URLs, used only to measure how far detection drops under them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------
LATIN, LOOKALIKE = "aceijopsxy", "асеіјорѕху"  # second string: Cyrillic letters
STUFFED_PREFIX = "secure-auth-update.signin."
BRAND_QUERY, BRAND_PATH = "&target=paypal_verification_portal", "/paypal-security-verification/signin.php"
ENCODED_LOGIN = "/%6c%6f%67%69%6e"
SPLIT_WORDS = (
    ("paypal", "pay-pal"),
    ("microsoft", "micro-soft"),
    ("netflix", "net-flix"),
    ("facebook", "face-book"),
    ("appleid", "apple-id"),
    ("signin", "sign-in"),
    ("login", "log-in"),
)
SPLIT_FALLBACK = "?client=auth-service-login"
PADDING = "support-secure-login"
# --- end of fixed values ----------------------------------------------------------------------------------

_HEAD = r"(?s)^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//)"


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Text up to the authority, the authority, and the rest; an address without ``//`` has no authority."""
    head = F.regexp_extract(url, _HEAD, 1)
    body = F.substr(url, F.length(head) + 1)
    authority = F.when(head != "", F.regexp_extract(body, r"^([^/?#]*)", 1)).otherwise(F.lit(""))
    return head, authority, F.substr(body, F.length(authority) + 1)


def homoglyph(url: Column) -> Column:
    """Replace the first eligible letter of the host by its Cyrillic look-alike."""
    head, authority, rest = _parts(url)
    has_host = authority != ""
    text = F.when(has_host, authority).otherwise(F.regexp_extract(rest, r"^([^?#]*)", 1))
    pattern = f"(?is)^([^{LATIN}]*)([{LATIN}])(.*)$"
    letter = F.translate(F.lower(F.regexp_extract(text, pattern, 2)), LATIN, LOOKALIKE)
    swapped = F.when(
        text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), letter, F.regexp_extract(text, pattern, 3))
    ).otherwise(text)
    return F.when(has_host, F.concat(head, swapped, rest)).otherwise(swapped)


def subdomain_stuffing(url: Column) -> Column:
    head, authority, rest = _parts(url)
    return F.when(authority == "", url).otherwise(F.concat(head, F.lit(STUFFED_PREFIX), authority, rest))


def _has_query(url: Column) -> Column:
    return F.contains(url, F.lit("?"))


def brand_in_path(url: Column) -> Column:
    return F.when(_has_query(url), F.concat(url, F.lit(BRAND_QUERY))).otherwise(
        F.concat(F.rtrim(url, F.lit("/")), F.lit(BRAND_PATH))
    )


def url_extension(url: Column) -> Column:
    base = F.substring_index(url, "?", 1)
    return F.when(_has_query(url), F.concat(base, F.lit(".html"), F.substr(url, F.length(base) + 1))).otherwise(
        F.concat(url, F.lit(".php"))
    )


def hex_encoding(url: Column) -> Column:
    """Percent-encode letters and digits of the path; an empty path gets an encoded ``/login``."""
    head, authority, rest = _parts(url)
    full = F.regexp_extract(rest, r"^([^?#]*)", 1)
    path = F.regexp_extract(full, r"(?s)^((?:.*/)?[^;/]*)", 1)  # without parameters of the last segment
    code = lambda ch: F.lpad(F.lower(F.hex(F.ascii(ch))), 2, "0")
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit("%"), code(ch))).otherwise(ch),
        ),
        "",
    )
    return F.when(path.isin("", "/"), F.concat(url, F.lit(ENCODED_LOGIN))).otherwise(
        F.concat(head, authority, encoded, F.substr(rest, F.length(path) + 1))
    )


def compound_split(url: Column) -> Column:
    """Hyphenate the first listed word that occurs, else add a query."""
    out = None
    for word, hyphenated in SPLIT_WORDS:
        hit = F.contains(F.lower(url), F.lit(word))
        value = F.regexp_replace(url, f"(?i){word}", hyphenated)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.concat(url, F.lit(SPLIT_FALLBACK)))


def benign_padding(url: Column) -> Column:
    return F.when(_has_query(url), F.concat(url, F.lit("&ref=" + PADDING))).otherwise(
        F.concat(F.rtrim(url, F.lit("/")), F.lit("/" + PADDING))
    )


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "homoglyph": homoglyph,
    "subdomain_stuffing": subdomain_stuffing,
    "brand_in_path": brand_in_path,
    "url_extension": url_extension,
    "hex_encoding": hex_encoding,
    "compound_split": compound_split,
    "benign_padding": benign_padding,
}
