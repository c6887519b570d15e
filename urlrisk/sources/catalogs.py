"""Small reference catalogs: brands, keywords, host sets, allowlist and reasons.

Everything here is a few dozen entries, so the operators turn a catalog into literals inside the plan.
Lists that can grow (feeds, user lists) are DataFrames and never pass through this module.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.functions.text import strip

# --- fixed values: results depend on them, so they are stated as they are -----------------------------

# domains of link shorteners
SHORTENER_DOMAINS = (
    "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly adf.ly bit.do cutt.ly rebrand.ly tiny.cc"
).split()

# hosting platforms with many tenants; never allowed as a whole
MULTITENANT_HOSTS = (
    "github.io web.app firebaseapp.com pages.dev vercel.app netlify.app blogspot.com sharepoint.com "
    "notion.site wordpress.com wixsite.com weebly.com glitch.me render.com railway.app fly.dev "
    "supabase.co azurewebsites.net s3.amazonaws.com storage.googleapis.com blob.core.windows.net"
).split()

# apex domains that are allowed by default
ALLOWED_DOMAINS = (
    "google.com microsoft.com apple.com amazon.com wikipedia.org github.com cloudflare.com mozilla.org "
    "stackoverflow.com linkedin.com nytimes.com cnn.com bbc.com medium.com nih.gov cdc.gov who.int"
).split()

# account and security words
KEYWORDS = (
    "login signin verify verification secure security account update confirm wallet bank banking invoice "
    "payment password support service portal auth authenticate billing"
).split()

# brand name, canonical domain, aliases (in catalog order: the order decides ties)
BRANDS = """
paypal         paypal.com         paypal
microsoft      microsoft.com      microsoft office365 outlook live onedrive azure
apple          apple.com          apple icloud
google         google.com         google gmail youtube
amazon         amazon.com         amazon primevideo
netflix        netflix.com        netflix
chase          chase.com          chase
wellsfargo     wellsfargo.com     wellsfargo
bankofamerica  bankofamerica.com  bankofamerica bofa
meta           facebook.com       facebook instagram whatsapp meta
dhl            dhl.com            dhl
steam          steampowered.com   steam steampowered
binance        binance.com        binance
coinbase       coinbase.com       coinbase
dropbox        dropbox.com        dropbox
linkedin       linkedin.com       linkedin
"""

# brands used when a catalog file is named but cannot be read
FALLBACK_BRANDS = """
paypal         paypal.com         paypal
microsoft      microsoft.com      microsoft office365 outlook live azure
apple          apple.com          apple icloud
google         google.com         google gmail youtube
amazon         amazon.com         amazon primevideo
netflix        netflix.com        netflix
chase          chase.com          chase
wellsfargo     wellsfargo.com     wellsfargo
bankofamerica  bankofamerica.com  bankofamerica bofa
facebook       facebook.com       facebook meta instagram whatsapp
binance        binance.com        binance
coinbase       coinbase.com       coinbase
steam          steampowered.com   steam steampowered
dhl            dhl.com            dhl
"""

# reason code | severity | part of the address | text
REASONS = """
brand_in_subdomain_not_regdomain|high|subdomain|The name of a well-known brand appears in the address, but the site isn't run by that brand.
brand_in_path_not_regdomain|high|path|The address uses a brand name in its path on an unrelated website.
typosquat_brand|high|registered_domain|The domain looks like a misspelling of a popular site.
combosquat_brand|high|registered_domain|The address combines a popular brand name with suspicious keywords like login or verify.
ip_host|high|host|The address uses numbers instead of a name, which real services rarely do.
userinfo_trick|high|host|Part of the address before an '@' is hiding the real destination.
punycode_mixed_script|medium|host|The address mixes letters from different alphabets that look alike.
long_random_subdomain|medium|subdomain|The address has a long string of random-looking characters.
high_entropy|medium|registered_domain|The web address contains an unusually high amount of random or obfuscated text.
excessive_subdomains|medium|subdomain|The address contains multiple levels of subdomains attempting to deceive readers.
suspicious_keywords|medium|path|The address asks you to sign in, verify, or update account credentials.
feed_hit|high|registered_domain|This address was reported as a scam by a threat-intelligence source.
user_denylist|high|registered_domain|This address matches a domain in your personal blocklist.
new_domain|medium|registered_domain|The domain was registered very recently.
elevated_ml_risk|medium|host|Statistical patterns in the address match characteristics of known phishing sites.
"""

# text of the user blocklist reason as the scan emits it (it differs from the catalog entry)
USER_DENY_TEXT = "The site was flagged on your custom blocklist."

# --- end of fixed values --------------------------------------------------------------------------------

MIN_ALIAS_LEN = 3


@dataclass(frozen=True)
class Alias:
    """One brand alias; ``ordinal`` is its place in the catalog."""

    ordinal: int
    brand: str
    domain: str
    alias: str


@dataclass(frozen=True)
class ReasonInfo:
    code: str
    severity: str
    target_segment: str
    text: str


def _brand_lines(block: str) -> list[tuple[str, str, list[str]]]:
    rows = [line.split() for line in block.strip().splitlines()]
    return [(r[0], r[1], r[2:]) for r in rows]


def _load_mapping(path: str) -> Mapping:
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return json.loads(text)


def brand_aliases(path: str | None = None) -> list[Alias]:
    """Aliases of the built-in catalog, or of a YAML/JSON file with a ``brands`` list.

    A file that is absent or cannot be read falls back to the shorter built-in catalog. Aliases under three
    characters are never matched and are dropped here.
    """
    brands = _brand_lines(BRANDS)
    if path is not None:
        try:
            entries = _load_mapping(path)["brands"]
            brands = [
                (
                    e["name"].lower(),
                    e["canonical_domain"].lower(),
                    [a.lower() for a in e.get("aliases", [e["name"]])],
                )
                for e in entries
            ]
        except Exception:  # unreadable catalog: documented fallback
            brands = _brand_lines(FALLBACK_BRANDS)
    flat = [(b, d, a) for b, d, aliases in brands for a in aliases if len(a) >= MIN_ALIAS_LEN]
    return [Alias(i, b, d, a) for i, (b, d, a) in enumerate(flat)]


def brand_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The catalog as a table, one row per alias."""
    rows = [(a.ordinal, a.brand, a.domain, a.alias) for a in brand_aliases(path)]
    return spark.createDataFrame(rows, "ordinal int, brand string, canonical_domain string, alias string")


def reason_catalog(path: str | None = None) -> dict[str, ReasonInfo]:
    """Reason catalog by code; entries of a YAML/JSON file with a ``reasons`` map replace the defaults."""
    fields = [line.split("|", 3) for line in REASONS.strip().splitlines()]
    catalog = {code: ReasonInfo(code, sev, seg, text) for code, sev, seg, text in fields}
    if path is not None:
        try:
            overrides = _load_mapping(path)["reasons"]
        except Exception:  # unreadable catalog: keep the defaults
            overrides = {}
        for code, info in overrides.items():
            catalog[code] = ReasonInfo(
                code,
                info.get("severity", "medium"),
                info.get("target_segment", "host"),
                info.get("text", f"Suspicious indicator detected: {code}."),
            )
    return catalog


def reason_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    rows = [(r.code, r.severity, r.target_segment, r.text) for r in reason_catalog(path).values()]
    return spark.createDataFrame(rows, "code string, severity string, target_segment string, text string")


def read_host_list(spark: SparkSession, path: str) -> DataFrame:
    """Host list file: one host per line, ``#`` starts a comment line."""
    host = F.lower(strip(F.col("value")))
    return (
        spark.read.text(path)
        .select(host.alias("host"))
        .filter((F.col("host") != "") & ~F.col("host").startswith("#"))
        .distinct()
    )


def pattern_table(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    """A short list of patterns as a table with the column the list joins expect."""
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")
