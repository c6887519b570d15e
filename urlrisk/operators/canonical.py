"""Canonicalization: a table of URL strings to a table with a ``parsed`` struct.

The work is staged in a handful of ``select`` steps. A column that several later expressions read is computed
in an earlier step, so Catalyst evaluates it once per row. There is no shuffle; the same plan runs on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.hosts import mixed_script, unicode_host
from urlrisk.functions.planning import computed_stage
from urlrisk.functions.text import strip
from urlrisk.operators.skew import fits_broadcast
from urlrisk.sources.suffixes import MAX_RULE_ROWS, SuffixRules, builtin_rules

MAX_URL_LENGTH = 8192  # fixed value: longer URLs are rejected
RULE_SLOTS = 1 << 14

PARSED_FIELDS = (
    "raw canonical scheme netloc host port registered_domain subdomain suffix path query fragment "
    "scheme_inferred has_userinfo userinfo is_ip ip_address is_private_ip is_idn punycode_host "
    "is_mixed_script has_punycode has_double_encoding fragment_has_url is_valid error_message"
).split()

_HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_DOTTED = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
# first two characters after a percent sign that stand for an unreserved character
_UNRESERVED = r"^(?:2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])"

# fixed values: IPv4 ranges counted as private, loopback, link-local or reserved (first, last)
_PRIVATE_V4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
)


def _ip_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _decode_unreserved(text: Column) -> Column:
    """Decode percent escapes of unreserved characters in one pass; other escapes stay as written."""

    def piece(x: Column, i: Column) -> Column:
        char = F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("int"))
        return (
            F.when(i == 0, x)
            .when(x.rlike(_UNRESERVED), F.concat(char, F.substr(x, F.lit(3))))
            .otherwise(F.concat(F.lit("%"), x))
        )

    decoded = F.array_join(F.transform(F.split(text, "%"), piece), "")
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def _normalize_path(path: Column) -> Column:
    """Resolve dot segments and repeated slashes; exactly two leading slashes and a trailing slash stay."""
    root = F.when(path.rlike(r"^//(?!/)"), F.lit("//")).otherwise(F.lit("/"))
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, s)),
    )
    slow = F.concat(
        root,
        F.array_join(kept, "/"),
        F.when(path.endswith("/") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")),
    )
    # most paths have neither an empty segment nor one that starts with a dot
    return F.when(path == "", F.lit("/")).when(path.rlike(r"//|/\."), slow).otherwise(path)


def suffix_label_count(host: Column, rules: SuffixRules) -> Column:
    """Number of labels in the public suffix of ``host``; 0 when no rule matches. Hash lookups only."""
    by_depth: dict[int, list[str]] = {}
    for rule in rules.normal:
        by_depth.setdefault(rule.count(".") + 1, []).append(rule)
    wildcard_by_depth: dict[int, list[str]] = {}
    for parent in rules.wildcard:
        wildcard_by_depth.setdefault(parent.count(".") + 2, []).append(parent)
    labels = F.size(F.split(host, r"\."))
    last = lambda d: F.substring_index(host, ".", -d)
    chain = None

    def add(condition: Column, count: int) -> None:
        nonlocal chain
        chain = F.when(condition, count) if chain is None else chain.when(condition, count)

    for rule in rules.exception:
        depth = rule.count(".") + 1
        add(last(depth) == rule, depth - 1)
    for depth in range(rules.depth, 0, -1):
        if depth in wildcard_by_depth:
            add(last(depth - 1).isin(wildcard_by_depth[depth]) & (labels >= depth), depth)
        if depth in by_depth:
            add(last(depth).isin(by_depth[depth]), depth)
        if depth == 2 and rules.second_level:
            top, second = last(1), F.substring_index(last(2), ".", 1)
            country = top.rlike("^[a-z]{2}$") & ~top.isin(list(rules.direct_countries))
            add(country & second.isin(list(rules.second_level)) & (labels >= 2), 2)
    if rules.two_letter_countries:
        top = last(1)
        add(top.rlike("^[a-z]{2}$") & ~top.isin([w for w in rules.wildcard]), 1)
    return F.lit(0) if chain is None else chain.otherwise(0)


def packed_rules(rules: DataFrame) -> DataFrame:
    """One row with ``_rules``: a suffix rule table as an array of ``RULE_SLOTS`` short lists, a rule in the slot of its hash; and ``_depth``, the labels of the longest rule.

    The table's rows and bytes are checked first.
    """
    if not fits_broadcast(rules.select("rule", "kind"), MAX_RULE_ROWS):
        raise ValueError(f"the suffix rule table is larger than {MAX_RULE_ROWS} rows or the broadcast bound in bytes")
    is_kind = lambda kind: F.max(F.col("kind") == kind)
    kinds = rules.groupBy("rule").agg(is_kind("normal").alias("normal"), is_kind("wildcard").alias("wildcard"), is_kind("exception").alias("exception"))
    slots = kinds.groupBy(_rule_slot(F.col("rule")).alias("slot")).agg(
        F.collect_list(F.struct("rule", "normal", "wildcard", "exception")).alias("held"), F.max(F.size(F.split("rule", r"\."))).alias("depth")
    )
    every = rules.sparkSession.range(RULE_SLOTS).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(slots), "slot", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("slot", "held"))), lambda x: x["held"])
    return every.agg(listed.alias("_rules"), F.coalesce(F.max("depth"), F.lit(1)).alias("_depth"))


def _rule_slot(rule: Column) -> Column:
    return F.pmod(F.xxhash64(rule), F.lit(RULE_SLOTS)).cast("int")


def _suffix_count_from_table(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """Add ``_k``, the suffix label count: each ending of the host is looked up in its slot of the packed table, whatever the depth of the rules. One broadcast row, no shuffle."""
    name, labels = F.col(host), F.size(F.split(host, r"\."))
    depths = F.sequence(F.lit(1), F.greatest(F.least(labels, F.col("_depth")), F.lit(1)))

    def matched(d: Column) -> Column:
        ending = F.call_function("substring_index", name, F.lit("."), -d)
        rule = F.get(F.filter(F.get(F.col("_rules"), _rule_slot(ending)), lambda r: r["rule"] == ending), F.lit(0))
        return F.struct(
            F.when(rule["exception"], d - 1).alias("exception"),
            F.greatest(F.when(rule["normal"], d), F.when(rule["wildcard"] & (labels > d), d + 1)).alias("rule"),
        )

    found = F.transform(depths, matched)
    df = df.crossJoin(F.broadcast(packed_rules(rules)))
    df = df.withColumn("_found", F.when(name.isNotNull(), found))
    best = lambda field: F.array_max(F.transform("_found", lambda m: m[field]))
    return df.withColumn("_k", F.coalesce(best("exception"), best("rule"), F.lit(0))).drop("_rules", "_depth", "_found")


def canonicalize_urls(
    df: DataFrame,
    url_col: str = "url",
    out: str = "parsed",
    max_length: int = MAX_URL_LENGTH,
    suffix_rules: DataFrame | None = None,
) -> DataFrame:
    """Add struct ``out`` with the canonical form of ``url_col`` and its parts.

    A URL that cannot be assessed gets ``is_valid = false`` and an ``error_message``; its other fields are null.
    ``suffix_rules`` is a table from :func:`urlrisk.sources.suffixes.read_suffix_rules`; the default is the
    built-in set, which is looked up without any join.
    """
    keep = df.columns
    c = F.col

    # 1. clean and infer the scheme
    raw = F.coalesce(c(url_col).cast("string"), F.lit(""))
    clean = F.regexp_replace(strip(raw), r"[\x00-\x1F\x7F]", "")
    df = df.select(*keep, raw.alias("_raw"), clean.alias("_clean"))
    length = F.length("_clean")
    error = F.when(length == 0, F.lit("Empty URL")).when(
        length > max_length, F.lit(f"URL exceeds maximum allowed length of {max_length} chars")
    )
    inferred = ~c("_clean").rlike(_HAS_SCHEME)
    df = df.select(
        *keep,
        "_raw",
        error.alias("_err0"),
        inferred.alias("_inferred"),
        F.when(error.isNull(), F.when(inferred, F.concat(F.lit("http://"), c("_clean"))).otherwise(c("_clean"))).alias(
            "_full"
        ),
    )

    # 2. split
    # the pattern matches whatever begins with a scheme, and control characters are gone, so one of them can part the groups: one match gives all five
    groups = F.split(F.regexp_replace("_full", _PARTS, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01")
    df = df.select(*keep, "_raw", "_err0", "_inferred", groups.alias("_groups"))
    part = lambda i: F.get("_groups", F.lit(i))
    df = df.select(
        *keep,
        "_raw",
        "_err0",
        "_inferred",
        F.lower(part(0)).alias("_scheme"),
        part(1).alias("_netloc"),
        part(2).alias("_path"),
        part(3).alias("_query"),
        part(4).alias("_fragment"),
    )

    # 3. userinfo and port
    df = df.withColumn("_hostport", F.substring_index("_netloc", "@", -1))
    port_text = F.when(
        ~c("_hostport").endswith("]"), F.regexp_extract("_hostport", r"(?s)^.*:([0-9]+)\z", 1)
    ).otherwise(F.lit(""))
    df = df.withColumn("_port_text", port_text)
    host_text = F.when(
        c("_port_text") != "", F.substr(c("_hostport"), F.lit(1), F.length("_hostport") - F.length("_port_text") - 1)
    ).otherwise(c("_hostport"))
    df = df.withColumns(
        {
            "_host_text": host_text,
            "_has_userinfo": F.contains(c("_netloc"), F.lit("@")),
            "_userinfo": F.substr(
                c("_netloc"), F.lit(1), F.greatest(F.length("_netloc") - F.length("_hostport") - 1, F.lit(0))
            ),
        }
    )

    # 4. host: plain ASCII names stay in the JVM
    special = c("_netloc").rlike(r"[^\x00-\x7F]|[\[\]]|(?i:xn--)") | F.contains(c("_host_text"), F.lit(":"))
    df = df.withColumns({"_special": special, "_ascii": F.lower(F.btrim(c("_host_text"), F.lit(".")))})
    asked = lambda name: F.when(c("_special"), c(name))
    df = df.withColumn("_sp", unicode_host(asked("_netloc"), asked("_host_text")))
    df = df.withColumn("_named", F.when(c("_special"), c("_sp.host")).otherwise(c("_ascii")))
    # digits first: most names are done after one look
    digits = F.btrim(c("_named"), F.lit("[]"))
    octet = lambda i: F.element_at(F.split(digits, r"\."), i).cast("bigint")
    hex_digits = F.regexp_replace(F.substr(digits, F.lit(3)), "^0+", "")
    ip_number = F.when(
        c("_named").rlike(r"^\[?[0-9]"),
        F.when(digits.rlike(_DOTTED), ((octet(1) * 256 + octet(2)) * 256 + octet(3)) * 256 + octet(4))
        .when(digits.rlike(r"^(?:0+|[1-9][0-9]{0,9})\z"), F.substr(digits, F.lit(-10)).cast("bigint"))
        .when(
            digits.rlike(r"^0x[0-9a-f]+\z") & (F.length(hex_digits) <= 8),
            F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("bigint"),
        ),
    )
    df = df.withColumn("_ipn0", ip_number)
    df = df.withColumn("_ipn", F.when(c("_ipn0") <= 4294967295, c("_ipn0")))
    dotted = F.concat_ws(
        ".", *[F.shiftright("_ipn", s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )
    judged = F.coalesce("_ipn", "_sp.v4_number")
    private_v4 = F.lit(False)
    for first, last in _PRIVATE_V4:
        private_v4 = private_v4 | judged.between(_ip_number(first), _ip_number(last))
    is_v4 = c("_ipn").isNotNull()
    unsupported = ~c("_scheme").isin("http", "https")
    df = df.withColumns(
        {
            "_ip": F.when(is_v4, dotted).otherwise(c("_sp.v6")),
            "_host": F.when(is_v4, dotted).otherwise(F.coalesce(c("_sp.v6"), c("_named"))),
            "_puny": F.when(is_v4, dotted).otherwise(F.coalesce(c("_sp.v6"), c("_sp.punycode_host"), c("_ascii"))),
            "_private": F.when(judged.isNotNull(), private_v4).otherwise(F.coalesce(c("_sp.v6_local"), F.lit(False))),
            "_idn": F.coalesce(c("_sp.is_idn"), F.lit(False)),
            "_has_puny": F.coalesce(c("_sp.has_punycode"), F.lit(False)),
            "_mixed": mixed_script(c("_named")),
            "_error": F.coalesce(
                c("_err0"),
                c("_sp.error"),
                F.when(unsupported, F.concat(F.lit("Unsupported scheme: "), c("_scheme"))),
                F.when(c("_netloc") == "", F.lit("URL missing hostname / netloc")),
            ),
        }
    )

    # 5. port, path and query of the rows that are still valid
    valid = c("_error").isNull()
    port = F.when(c("_port_text") != "", F.regexp_replace("_port_text", r"^0+(?=[0-9])", ""))
    default_port = ((c("_scheme") == "http") & (port == "80")) | ((c("_scheme") == "https") & (port == "443"))
    df = df.withColumns(
        {
            "_valid": valid,
            "_port": F.when(valid & ~default_port, port),
            "_npath": F.when(valid, _normalize_path(c("_path"))),
            "_cquery": F.when(valid, _decode_unreserved(c("_query"))),
        }
    )
    df = df.withColumns(
        {
            "_cnetloc": F.concat(
                F.when(c("_has_userinfo"), F.concat(c("_userinfo"), F.lit("@"))).otherwise(F.lit("")),
                c("_host"),
                F.when(c("_port").isNotNull(), F.concat(F.lit(":"), c("_port"))).otherwise(F.lit("")),
            ),
            "_cpath": _decode_unreserved(c("_npath")),
            "_double": F.contains(c("_npath"), F.lit("%25")) | F.contains(c("_query"), F.lit("%25")),
            # the suffix lookup reads the host up to a stray colon
            "_psl_host": F.when(
                valid & c("_ip").isNull(), F.rtrim(F.substring_index("_puny", ":", 1), F.lit("."))
            ),
        }
    )

    # 6. registered domain
    if suffix_rules is None:
        df = df.withColumn("_k", suffix_label_count(c("_psl_host"), builtin_rules()))
    else:
        df = _suffix_count_from_table(df, "_psl_host", suffix_rules)
    host = c("_psl_host")
    df = df.withColumn("_n", F.size(F.split(host, r"\.")))
    known = c("_k") > 0
    registered = F.expr("substring_index(_psl_host, '.', -(_k + 1))")
    df = df.withColumns(
        {
            "_suffix": F.when(c("_ip").isNotNull(), "").when(known, F.expr("substring_index(_psl_host, '.', -_k)")).otherwise(""),
            "_registered": F.when(c("_ip").isNotNull() | ~known | (c("_k") >= c("_n")), c("_host")).otherwise(registered),
            # labels left of the registered name, or of the last label when no rule is known
            "_left": F.when(c("_ip").isNotNull(), 0).otherwise(c("_n") - c("_k") - 1),
        }
    )
    df = df.withColumn(
        "_sub", F.when(c("_left") > 0, F.expr("substring_index(_psl_host, '.', _left)")).otherwise(F.lit(""))
    )

    # 7. one struct
    canonical = F.concat(
        c("_scheme"),
        F.lit("://"),
        c("_cnetloc"),
        c("_cpath"),
        F.when(c("_cquery") != "", F.concat(F.lit("?"), c("_cquery"))).otherwise(F.lit("")),
    )
    df = df.withColumns(
        {
            "_canonical": canonical,
            "_portn": F.coalesce(
                F.expr("try_cast(_port AS bigint)"), F.when(c("_port").isNotNull(), F.lit(2**63 - 1))
            ),
            "_frag_url": c("_fragment").rlike("(?i)https?://"),
        }
    )
    source = {
        "raw": c("_raw"),
        "canonical": c("_canonical"),
        "scheme": c("_scheme"),
        "netloc": c("_cnetloc"),
        "host": c("_host"),
        "port": c("_portn"),
        "registered_domain": c("_registered"),
        "subdomain": c("_sub"),
        "suffix": c("_suffix"),
        "path": c("_cpath"),
        "query": c("_cquery"),
        "fragment": c("_fragment"),
        "scheme_inferred": c("_inferred"),
        "has_userinfo": c("_has_userinfo"),
        "userinfo": c("_userinfo"),
        "is_ip": c("_ip").isNotNull(),
        "ip_address": c("_ip"),
        "is_private_ip": c("_private"),
        "is_idn": c("_idn"),
        "punycode_host": c("_puny"),
        "is_mixed_script": c("_mixed"),
        "has_punycode": c("_has_puny"),
        "has_double_encoding": c("_double"),
        "fragment_has_url": c("_frag_url"),
        "is_valid": c("_valid"),
        "error_message": c("_error"),
    }
    always = {"raw", "is_valid", "error_message"}
    fields = [(source[f] if f in always else F.when(c("_valid"), source[f])).alias(f) for f in PARSED_FIELDS]
    return computed_stage(df, [k for k in keep if k != out], {out: F.struct(*fields)})
