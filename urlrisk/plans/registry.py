"""Registered queries: name, Spark callable and, where SQL can express it, the DuckDB text.

Every query reads the parquet tables of a folder as a whole. URL shapes that the page table does not contain are
spliced from it (see :mod:`urlrisk.sources.corpus`), so the work grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.functions import privacy
from urlrisk.functions.text import char_tokens
from urlrisk.operators import brands, dataset, detect, store
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.features import FEATURE_NAMES, extract_features
from urlrisk.plans import oracle as o
from urlrisk.sources.corpus import url_corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = ["page_id", "tpl"]
K = "page_id, tpl"


def register(name: str, sql: str | None = None, ints: str = "", doubles: str = "", dates: str = ""):
    """Register a query. The named columns get plain types on the SQL side (and dates text on both sides), so
    that rows compare without type conversions."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return out.withColumns({d: F.col(d).cast("string") for d in dates.split()}) if dates else out

        QUERIES[name] = run
        casts = [(c, "BIGINT") for c in ints.split()] + [(c, "DOUBLE") for c in doubles.split()]
        casts += [(c, "VARCHAR") for c in dates.split()]
        if sql is not None:
            changes = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts)
            ORACLE[name] = f"SELECT * REPLACE ({changes}) FROM ({sql})" if casts else sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return url_corpus(table(spark, folder, "pages"))


def parsed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return canonicalize_urls(corpus(spark, folder))


def flag(col):
    return col.cast("int")


# --- canonicalization, privacy, features, brands -------------------------------------------------------

_BASE = "WITH " + o.CORPUS


@register(
    "url_risk_summary",
    f"""WITH src AS (SELECT page_id, 0 AS tpl, url FROM pages), {o.scan('src', K)}
SELECT registered_domain, verdict, count(*) AS n FROM scan GROUP BY ALL""",
)
def url_risk_summary(spark, folder):
    """Flagship: scan all pages and count verdicts per registered domain."""
    scans = detect.scan_urls(table(spark, folder, "pages").select("page_id", "url"), id_cols=["page_id"], columns=["registered_domain", "verdict"])
    return scans.groupBy("registered_domain", "verdict").agg(F.count("*").alias("n"))


@register(
    "canonical_urls",
    f"""{_BASE}, {o.canon('corpus', K)}
SELECT page_id, tpl, CAST(ok AS INTEGER) AS is_valid, error_message, CASE WHEN ok THEN u END AS canonical,
  CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN netloc END AS netloc, CASE WHEN ok THEN host END AS host,
  CASE WHEN ok THEN CAST(port AS BIGINT) END AS port, CASE WHEN ok THEN registered_domain END AS registered_domain,
  CASE WHEN ok THEN subdomain END AS subdomain, CASE WHEN ok THEN suffix END AS suffix, CASE WHEN ok THEN path END AS path,
  CASE WHEN ok THEN query END AS query, CASE WHEN ok THEN fragment END AS fragment, CASE WHEN ok THEN userinfo END AS userinfo,
  CASE WHEN ok THEN ip_address END AS ip_address, CASE WHEN ok THEN puny END AS punycode_host,
  CASE WHEN ok THEN CAST(inferred AS INTEGER) END AS scheme_inferred, CASE WHEN ok THEN CAST(has_userinfo AS INTEGER) END AS has_userinfo,
  CASE WHEN ok THEN is_ip END AS is_ip, CASE WHEN ok THEN is_private_ip END AS is_private_ip, CASE WHEN ok THEN is_idn END AS is_idn,
  CASE WHEN ok THEN is_mixed END AS is_mixed_script, CASE WHEN ok THEN has_punycode END AS has_punycode,
  CASE WHEN ok THEN has_double_encoding END AS has_double_encoding, CASE WHEN ok THEN fragment_has_url END AS fragment_has_url
FROM canon""",
)
def canonical_urls(spark, folder):
    p = F.col("parsed")
    text = "error_message canonical scheme netloc host port registered_domain subdomain suffix path query fragment userinfo"
    text += " ip_address punycode_host"
    flags = "is_valid scheme_inferred has_userinfo is_ip is_private_ip is_idn is_mixed_script has_punycode"
    flags += " has_double_encoding fragment_has_url"
    return parsed_corpus(spark, folder).select(
        *KEYS, *[p[c].alias(c) for c in text.split()], *[flag(p[c]).alias(c) for c in flags.split()]
    )


_AUTH = "regexp_extract(u, '^(?:https?)://([^/?#]*)', 1)"


@register(
    "private_urls",
    f"""{_BASE}, {o.canon('corpus', K)}
SELECT page_id, tpl, 'hxxp' || substr(u, 5, position('://' IN u) - 5) || '://' || replace({_AUTH}, '.', '[.]')
         || substr(u, position('://' IN u) + 3 + length({_AUTH})) AS defanged, u AS refanged, string_split(u, '?')[1] AS redacted,
       sha256(u) AS url_sha256, sha256('owner ' || CAST(page_id AS VARCHAR)) AS owner_key_hash
FROM canon WHERE ok""",
)
def private_urls(spark, folder):
    u = F.col("parsed.canonical")
    rows = parsed_corpus(spark, folder).filter("parsed.is_valid").select(*KEYS, u.alias("u"))
    rows = rows.withColumn("defanged", privacy.defang(F.col("u")))
    key = F.concat(F.lit(" owner "), F.col("page_id").cast("string"), F.lit(" "))
    return rows.select(
        *KEYS,
        "defanged",
        privacy.refang(F.col("defanged")).alias("refanged"),
        privacy.redact_query(F.col("u")).alias("redacted"),
        privacy.sha256_url(F.col("u")).alias("url_sha256"),
        privacy.hash_key(key).alias("owner_key_hash"),
    )


@register(
    "label_inversion",
    "SELECT doc_id, CASE toxic WHEN 1 THEN 0 WHEN 0 THEN 1 END AS label FROM labels",
)
def label_inversion(spark, folder):
    return table(spark, folder, "labels").select("doc_id", privacy.invert_label(F.col("toxic")).alias("label"))


@register("url_features", f"{_BASE}, {o.chain('corpus', K)}\nSELECT page_id, tpl, {', '.join(FEATURE_NAMES)} FROM feat")
def url_features_query(spark, folder):
    rows = extract_features(parsed_corpus(spark, folder)).filter(F.col("features").isNotNull())
    return rows.select(*KEYS, *[F.col(f"features.{n}").alias(n) for n in FEATURE_NAMES])


@register(
    "char_tokens",
    f"""{_BASE}, {o.canon('corpus', K)}
SELECT page_id, tpl, array_to_string(list_transform(list_resize(string_split(left(u, 200), ''), 200, NULL),
  lambda c: CASE WHEN c IS NULL THEN 0 WHEN ord(c) BETWEEN 1 AND 126 THEN ord(c) + 1 ELSE 1 END), ' ') AS tokens
FROM canon WHERE ok""",
)
def char_tokens_query(spark, folder):
    rows = parsed_corpus(spark, folder).filter("parsed.is_valid")
    tokens = char_tokens(F.col("parsed.canonical"))
    return rows.select(*KEYS, F.array_join(tokens.cast("array<string>"), " ").alias("tokens"))


@register(
    "brand_matches",
    f"""{_BASE}, {o.canon('corpus', K)}, {o.brands()}
SELECT c.page_id, c.tpl, b.insub AS brand_in_subdomain, b.inpath AS brand_in_path, b.typo AS typosquat, b.combo AS combosquat,
       b.closest AS closest_brand, b.min_d AS min_edit_distance, b.matched AS matched_brand_name
FROM canon c JOIN brand b USING (registered_domain, subdomain, path, query) WHERE c.ok""",
)
def brand_matches(spark, folder):
    rows = brands.match_brands(parsed_corpus(spark, folder)).filter(F.col("brand").isNotNull())
    b = F.col("brand")
    return rows.select(
        *KEYS,
        flag(b["brand_in_subdomain"]).alias("brand_in_subdomain"),
        flag(b["brand_in_path"]).alias("brand_in_path"),
        flag(b["typosquat_detected"]).alias("typosquat"),
        flag(b["combosquat_detected"]).alias("combosquat"),
        b["closest_brand"].alias("closest_brand"),
        b["min_edit_distance"].alias("min_edit_distance"),
        b["matched_brand_name"].alias("matched_brand_name"),
    )


@register(
    "brand_skeletons",
    f"SELECT doc_id, {o.skeleton('text')} AS skeleton FROM documents",
)
def brand_skeletons(spark, folder):
    return table(spark, folder, "documents").select("doc_id", brands.skeleton(F.col("text")).alias("skeleton"))


# --- layered scan ----------------------------------------------------------------------------------------

# ten owners; their lists come from the events, the deny list from the labels
_OWNED = "owned AS (SELECT *, 'user-' || CAST(page_id % 10 AS VARCHAR) AS owner FROM corpus)"
_LISTS = """lists AS (
  SELECT DISTINCT 'user-' || CAST(user_id % 10 AS VARCHAR) AS owner, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS kind,
         'evil' || CAST(event_id AS VARCHAR) || CASE WHEN event_type = 'view' THEN '.com' ELSE '.ru' END AS pattern FROM events)"""
_DENY = "denied AS (SELECT DISTINCT 'evil-attacker' || CAST(doc_id AS VARCHAR) || '.com' AS pattern FROM labels WHERE toxic = 1)"
_SCAN = f"{_BASE}, {_OWNED}, {_LISTS}, {_DENY}, {o.scan('owned', 'page_id, tpl, owner', 'lists', 'denied')}"


def owned_corpus(spark, folder):
    owner = F.concat(F.lit("user-"), (F.col("page_id") % 10).cast("string"))
    return corpus(spark, folder).withColumn("owner", owner).withColumn("owner_key_hash", privacy.hash_key(owner))


def event_lists(spark, folder):
    kind = F.when(F.col("event_type") == "error", "deny").otherwise("allow")
    ending = F.when(F.col("event_type") == "view", ".com").otherwise(".ru")
    return (
        table(spark, folder, "events")
        .select(
            F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("owner"),
            kind.alias("kind"),
            F.concat(F.lit("evil"), F.col("event_id").cast("string"), ending).alias("pattern"),
        )
        .distinct()
        .withColumn("owner_key_hash", privacy.hash_key(F.col("owner")))
    )


def label_denylist(spark, folder):
    name = F.concat(F.lit("evil-attacker"), F.col("doc_id").cast("string"), F.lit(".com"))
    return table(spark, folder, "labels").filter("toxic = 1").select(name.alias("pattern"))


def listed_scan(spark, folder, rows=None, **options):
    return detect.scan_urls(
        owned_corpus(spark, folder) if rows is None else rows,
        user_lists=event_lists(spark, folder).drop("owner"),
        denylist=label_denylist(spark, folder),
        id_cols=KEYS,
        **options,
    )


_CODES = "array_to_string(codes, ',')"


@register(
    "layered_scan",
    f"""{_SCAN}
SELECT page_id, tpl, owner, url_canonical, url_sha256, registered_domain, verdict, risk_score, probability, confidence, {_CODES} AS codes,
  CASE WHEN layer = 'invalid' THEN 'rejected' ELSE 'ok' END AS layer_canonicalize,
  CASE WHEN layer = 'invalid' THEN NULL WHEN layer = 'user_deny' THEN 'deny_hit' WHEN layer = 'user_allow' THEN 'allow_hit' ELSE 'none' END AS layer_user_list,
  CASE WHEN layer = 'invalid' THEN NULL WHEN layer = 'allowlist' THEN 'hit' ELSE 'miss' END AS layer_allowlist,
  CASE WHEN layer = 'invalid' THEN NULL WHEN layer = 'feed' THEN 'hit' ELSE 'miss' END AS layer_feeds,
  CASE WHEN layer = 'invalid' THEN NULL WHEN layer = 'model' THEN 'scored' ELSE 'skipped' END AS layer_ml
FROM scan""",
    doubles="probability",
)
def layered_scan(spark, folder):
    s = listed_scan(spark, folder)
    names = ("canonicalize", "user_list", "allowlist", "feeds", "ml")
    return s.select(
        *KEYS,
        "owner",
        "url_canonical",
        "url_sha256",
        "registered_domain",
        "verdict",
        "risk_score",
        "probability",
        "confidence",
        F.array_join(F.col("reasons")["code"], ",").alias("codes"),
        *[F.col("layers")[n].alias(f"layer_{n}") for n in names],
    )


@register("scan_batch", f"{_SCAN}\nSELECT owner, verdict, count(*) AS n FROM scan GROUP BY ALL")
def scan_batch(spark, folder):
    return listed_scan(spark, folder, columns=["verdict"]).groupBy("owner", "verdict").agg(F.count("*").alias("n"))


_CATALOG = o.values([(r.code, r.severity, r.target_segment, r.text) for r in o.catalogs.reason_catalog().values()])


@register(
    "scan_reasons",
    f"""{_SCAN}, cat(code, severity, segment, text) AS {_CATALOG},
r AS (SELECT layer, error_message, unnest(codes) AS code FROM scan)
SELECT r.code, CASE WHEN r.code = 'user_denylist' THEN 'high' ELSE coalesce(cat.severity, 'medium') END AS severity,
  CASE WHEN r.code = 'user_denylist' THEN 'host' ELSE coalesce(cat.segment, 'host') END AS target_segment,
  CASE WHEN r.code = 'user_denylist' THEN {o.lit(o.catalogs.USER_DENY_TEXT)} WHEN r.code = 'invalid_url' THEN 'Cannot assess: ' || error_message
       ELSE cat.text END AS text, count(*) AS n
FROM r LEFT JOIN cat USING (code) GROUP BY ALL""",
)
def scan_reasons(spark, folder):
    rows = listed_scan(spark, folder, columns=["reasons"]).select(F.explode("reasons").alias("r")).select("r.*")
    return rows.groupBy("code", "severity", "target_segment", "text").agg(F.count("*").alias("n"))


@register(
    "reason_evidence",
    f"""{_SCAN}, e AS (SELECT s.page_id, s.tpl, unnest(s.codes) AS code, generate_subscripts(s.codes, 1) AS place FROM scan s WHERE s.layer = 'model')
SELECT e.page_id, e.tpl, e.place, e.code, CASE e.code WHEN 'brand_in_subdomain_not_regdomain' THEN f.subdomain
  WHEN 'brand_in_path_not_regdomain' THEN f.path WHEN 'typosquat_brand' THEN f.registered_domain WHEN 'combosquat_brand' THEN f.registered_domain
  WHEN 'ip_host' THEN f.host WHEN 'userinfo_trick' THEN f.userinfo WHEN 'punycode_mixed_script' THEN f.puny
  WHEN 'long_random_subdomain' THEN f.subdomain WHEN 'excessive_subdomains' THEN CAST(f.n_subdomains AS VARCHAR)
  WHEN 'high_entropy' THEN CAST(f.entropy_url AS VARCHAR) END AS evidence
FROM e JOIN feat f ON e.page_id = f.page_id AND e.tpl = f.tpl""",
)
def reason_evidence(spark, folder):
    rows = listed_scan(spark, folder).filter(F.element_at("layers", "ml") == "scored")
    rows = rows.select(*KEYS, F.posexplode("reasons").alias("place", "r"))
    return rows.select(
        *KEYS,
        (F.col("place") + 1).alias("place"),
        F.col("r.code").alias("code"),
        F.element_at(F.map_values("r.evidence"), 1).alias("evidence"),
    )


_LOOKUP = hashlib.sha256(b"7\x1f10").hexdigest()


@register(
    "scan_lookup",
    f"""{_SCAN}
SELECT sha256(CAST(page_id AS VARCHAR) || chr(31) || CAST(tpl AS VARCHAR)) AS scan_id, url_sha256, registered_domain, verdict, risk_score
FROM scan WHERE sha256(CAST(page_id AS VARCHAR) || chr(31) || CAST(tpl AS VARCHAR)) = '{_LOOKUP}'""",
)
def scan_lookup(spark, folder):
    rows = detect.rows_of_scan(owned_corpus(spark, folder), _LOOKUP, KEYS)
    found = detect.find_scan(listed_scan(spark, folder, rows), _LOOKUP)
    return found.select("scan_id", "url_sha256", "registered_domain", "verdict", "risk_score")


# more queries are registered by these modules
from urlrisk.plans import registry_data, registry_models, registry_monitor, registry_stored, registry_text  # noqa: E402,F401
