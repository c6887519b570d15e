"""The registered queries as DuckDB SQL, for side-by-side checks.

Each query is a chain of common table expressions. The SQL states the semantics in its own way (joins against
rule tables, cross products with the alias list, window sums) and is not generated from the Spark plans.
"""

from __future__ import annotations

from urlrisk.sources import catalogs, corpus, suffixes

Q = "'"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return Q + str(value).replace(Q, Q * 2) + Q


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + ")"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def sql_list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


CORPUS = f"""
corpus AS (
  SELECT p.page_id, t.tpl, t.label, CASE WHEN t.label = 1 THEN 'malicious' ELSE 'benign' END AS source,
         replace(replace(t.template, '{{id}}', CAST(p.page_id AS VARCHAR)), '{{url}}', p.url) AS url,
         CAST(DATE '{corpus.FIRST_DAY}' + CAST(p.page_id % {corpus.N_DAYS} AS INTEGER) AS DATE) AS first_seen
  FROM pages p CROSS JOIN {values(corpus.TEMPLATES)} t(tpl, label, template))"""

# hosts with brackets or given in IDNA form, with the expected result of normalization
SPECIAL = [
    ("xn--zrich-reisen-dlb.ch", None, "zürich-reisen.ch", "xn--zrich-reisen-dlb.ch", 1, 1, 0, None, 0),
    ("[2001:db8:0:7::5]:8443", None, "2001:db8:0:7::5", "2001:db8:0:7::5", 0, 0, 0, "2001:db8:0:7::5", 1),
    ("[fd00::2", "Malformed URL: Invalid IPv6 URL", None, None, 0, 0, 0, None, 0),
    # after subdomain stuffing
    ("secure-auth-update.signin.[2001:db8:0:7::5]:8443", None, "secure-auth-update.signin.[2001:db8:0:7::5]",
     "secure-auth-update.signin.[2001:db8:0:7::5]", 0, 0, 0, None, 0),
    ("secure-auth-update.signin.[fd00::2", "Malformed URL: Invalid IPv6 URL", None, None, 0, 0, 0, None, 0),
]

_OTHER = "[^\\x00-\\x7F]"
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _punycode(label: str) -> str:
    """IDNA form of a label with one letter outside ASCII: its place and code point as a number in Punycode's base 36, whose
    thresholds are 1, 1, 26, 26 before any adaptation."""
    basic = f"regexp_replace({label}, '{_OTHER}', '')"
    place = f"length(regexp_extract({label}, '^[\\x00-\\x7F]*'))"
    delta = f"((unicode(regexp_extract({label}, '{_OTHER}')) - 128) * (length({basic}) + 1) + {place})"
    digit = lambda d: f"substr('{_DIGITS}', CAST({d} AS INTEGER) + 1, 1)"
    q1 = f"(({delta} - 1) // 35)"
    q2 = f"(({q1} - 1) // 35)"
    q3 = f"(({q2} - 26) // 10)"
    tail = f"CASE WHEN {q2} < 26 THEN {digit(q2)} ELSE {digit(f'26 + ({q2} - 26) % 10')} || {digit(q3)} END"
    rest = f"CASE WHEN {q1} < 1 THEN {digit(q1)} ELSE {digit(f'1 + ({q1} - 1) % 35')} || {tail} END"
    return f"'xn--' || {basic} || CASE WHEN {basic} = '' THEN '' ELSE '-' END || {digit(f'1 + ({delta} - 1) % 35')} || {rest}"


_LABELS = "string_split(host0, '.')"
_FOREIGN = f"(s.netloc IS NULL AND regexp_matches(host0, '{_OTHER}'))"
_IDNA = f"array_to_string(list_transform({_LABELS}, lambda l: CASE WHEN regexp_matches(l, '{_OTHER}') THEN {_punycode('l')} ELSE l END), '.')"
_MIXED = f"CAST(len(list_filter({_LABELS}, lambda l: regexp_matches(l, '\\p{{Cyrillic}}') AND regexp_matches(l, '\\p{{Latin}}'))) > 0 AS INTEGER)"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PRIVATE = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]


def _num(ip: str) -> int:
    out = 0
    for part in ip.split("."):
        out = out * 256 + int(part)
    return out


def _private(col: str) -> str:
    nets = " OR ".join(f"({col} >> {32 - bits}) = {_num(ip) >> (32 - bits)}" for ip, bits in _PRIVATE)
    return f"(({nets}) AND {col} NOT IN ({_num('192.0.0.9')}, {_num('192.0.0.10')}))"


def _decode(col: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({col}, '%'), lambda x, i: CASE WHEN i = 1 THEN x "
        "WHEN regexp_matches(x, '^[0-9a-fA-F]{2}') AND regexp_matches(chr(CAST('0x' || substr(x, 1, 2) AS INTEGER)), "
        "'^[A-Za-z0-9._~-]$') THEN chr(CAST('0x' || substr(x, 1, 2) AS INTEGER)) || substr(x, 3) "
        "ELSE '%' || x END), '')"
    )


def canon(src: str, keys: str) -> str:
    """CTEs ending in ``canon``; ``src`` has column ``url`` and the key columns ``keys``."""
    rules = suffixes.builtin_rules()
    rule_rows = [(r, "n") for r in rules.normal] + [(r, "w") for r in rules.wildcard] + [(r, "e") for r in rules.exception]
    parts = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    return f"""
c1 AS (SELECT {keys}, url AS raw, trim(url, ' \t\n\r') AS clean FROM {src}),
c2 AS (SELECT *, CASE WHEN clean = '' THEN 'Empty URL' WHEN length(clean) > 8192
                 THEN 'URL exceeds maximum allowed length of 8192 chars' END AS e0,
         NOT regexp_matches(clean, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS inferred FROM c1),
c3 AS (SELECT *, CASE WHEN inferred THEN 'http://' || clean ELSE clean END AS fullurl FROM c2),
c4 AS (SELECT *, lower(regexp_extract(fullurl, '{parts}', 1)) AS scheme, regexp_extract(fullurl, '{parts}', 2) AS netloc0,
         regexp_extract(fullurl, '{parts}', 3) AS path0, regexp_extract(fullurl, '{parts}', 4) AS query0,
         regexp_extract(fullurl, '{parts}', 5) AS fragment FROM c3),
c5 AS (SELECT *, regexp_extract(netloc0, '([^@]*)$', 1) AS hostport, contains(netloc0, '@') AS has_userinfo FROM c4),
c6 AS (SELECT *, CASE WHEN has_userinfo THEN left(netloc0, length(netloc0) - length(hostport) - 1) ELSE '' END AS userinfo,
         CASE WHEN ends_with(hostport, ']') THEN '' ELSE regexp_extract(hostport, ':([0-9]+)$', 1) END AS port_text FROM c5),
c7 AS (SELECT *, lower(trim(CASE WHEN port_text = '' THEN hostport
                  ELSE left(hostport, length(hostport) - length(port_text) - 1) END, '.')) AS host0 FROM c6),
c8 AS (SELECT c7.*, s.err AS s_err, s.host AS s_host, CASE WHEN {_FOREIGN} THEN {_IDNA} ELSE s.puny END AS s_puny,
         CASE WHEN {_FOREIGN} THEN 1 ELSE s.idn END AS s_idn, s.hasp AS s_hasp, CASE WHEN {_FOREIGN} THEN {_MIXED} ELSE s.mixed END AS s_mixed, s.ip AS s_ip, s.priv AS s_priv,
         CASE WHEN s.netloc IS NOT NULL THEN NULL
              WHEN regexp_full_match(host0, '{_OCTET}(\\.{_OCTET}){{3}}') THEN
                   list_reduce(list_transform(string_split(host0, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b)
              WHEN regexp_full_match(host0, '0+|[1-9][0-9]{{0,9}}') THEN CAST(host0 AS BIGINT)
              WHEN regexp_full_match(host0, '0x0*[0-9a-f]{{1,8}}') THEN CAST('0x' || right('0000000' || substr(host0, 3), 8) AS BIGINT)
         END AS ipn0
       FROM c7 LEFT JOIN {values(SPECIAL)} s(netloc, err, host, puny, idn, hasp, mixed, ip, priv) ON c7.netloc0 = s.netloc),
c9 AS (SELECT *, CASE WHEN ipn0 <= 4294967295 THEN ipn0 END AS ipn FROM c8),
c10 AS (SELECT *, (ipn // 16777216) || '.' || (ipn // 65536 % 256) || '.' || (ipn // 256 % 256) || '.' || (ipn % 256) AS v4 FROM c9),
c11 AS (SELECT *, coalesce(v4, s_ip) AS ip_address, coalesce(v4, s_host, host0) AS host, coalesce(v4, s_puny, host0) AS puny,
          CASE WHEN ipn IS NOT NULL THEN CAST({_private('ipn')} AS INTEGER) ELSE coalesce(s_priv, 0) END AS is_private_ip,
          coalesce(e0, s_err, CASE WHEN scheme NOT IN ('http', 'https') THEN 'Unsupported scheme: ' || scheme END,
                   CASE WHEN netloc0 = '' THEN 'URL missing hostname / netloc' END) AS error_message,
          CASE WHEN port_text <> '' THEN regexp_replace(port_text, '^0+([0-9])', '\\1') END AS port1 FROM c10),
c12 AS (SELECT *, CASE WHEN (scheme = 'http' AND port1 = '80') OR (scheme = 'https' AND port1 = '443') THEN NULL ELSE port1 END AS port,
          list_reduce(list_prepend('', string_split(path0, '/')), lambda acc, s:
             CASE WHEN s IN ('', '.') THEN acc WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END) AS walked
        FROM c11),
c13 AS (SELECT *, CASE WHEN walked = '' THEN (CASE WHEN regexp_matches(path0, '^//($|[^/])') THEN '//' ELSE '/' END)
             ELSE (CASE WHEN regexp_matches(path0, '^//($|[^/])') THEN '/' ELSE '' END) || walked
                  || (CASE WHEN ends_with(path0, '/') THEN '/' ELSE '' END) END AS npath FROM c12),
c14 AS (SELECT *, {_decode('npath')} AS path, {_decode('query0')} AS query,
          CAST(contains(npath, '%25') OR contains(query0, '%25') AS INTEGER) AS has_double_encoding,
          (CASE WHEN has_userinfo THEN userinfo || '@' ELSE '' END) || host || coalesce(':' || port, '') AS netloc,
          CASE WHEN error_message IS NULL AND ip_address IS NULL THEN rtrim(string_split(puny, ':')[1], '.') END AS ph FROM c13),
psl_rules(rule, kind) AS (SELECT * FROM {values(rule_rows)} UNION
  SELECT l || '.' || chr(CAST(a AS INTEGER)) || chr(CAST(b AS INTEGER)), 'n' FROM (SELECT unnest({sql_list(rules.second_level)}) AS l),
    (SELECT unnest(range(97, 123)) AS a), (SELECT unnest(range(97, 123)) AS b)
  WHERE chr(CAST(a AS INTEGER)) || chr(CAST(b AS INTEGER)) NOT IN {in_list(rules.direct_countries)}),
ph_labels AS (SELECT ph, string_split(ph, '.') AS ls, len(string_split(ph, '.')) AS n FROM (SELECT DISTINCT ph FROM c14 WHERE ph IS NOT NULL)),
ph_cand AS (SELECT ph, n, k, array_to_string(ls[n - k + 1 :], '.') AS cand FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM ph_labels)),
ph_hit AS (SELECT ph, max(CASE WHEN kind = 'e' THEN k - 1 END) AS ke,
             max(CASE WHEN kind = 'n' THEN k WHEN kind = 'w' AND k < n THEN k + 1
                      WHEN k = 1 AND regexp_full_match(cand, '[a-z]{{2}}') AND kind IS DISTINCT FROM 'w' THEN 1 END) AS kn
           FROM ph_cand LEFT JOIN psl_rules ON cand = rule GROUP BY ph),
ph_split AS (SELECT l.ph, l.ls, l.n, coalesce(h.ke, h.kn, 0) AS k FROM ph_labels l JOIN ph_hit h USING (ph)),
c15 AS (SELECT c14.*, CASE WHEN k > 0 THEN array_to_string(ls[n - k + 1 :], '.') ELSE '' END AS suffix,
          CASE WHEN k > 0 AND n > k THEN array_to_string(ls[n - k :], '.') ELSE host END AS registered_domain,
          CASE WHEN n - k - 1 > 0 THEN array_to_string(ls[1 : n - k - 1], '.') ELSE '' END AS subdomain
        FROM c14 LEFT JOIN ph_split USING (ph)),
canon AS (SELECT {keys}, raw, error_message IS NULL AS ok, error_message, scheme, netloc, host, port, suffix, registered_domain, subdomain,
            path, query, fragment, userinfo, puny, ip_address, inferred, has_userinfo, is_private_ip, has_double_encoding,
            CAST(ip_address IS NOT NULL AS INTEGER) AS is_ip, coalesce(s_idn, 0) AS is_idn, coalesce(s_hasp, 0) AS has_punycode,
            coalesce(s_mixed, 0) AS is_mixed, CAST(regexp_matches(fragment, '(?i)https?://') AS INTEGER) AS fragment_has_url,
            scheme || '://' || netloc || path || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS u
          FROM c15)"""


def defanged(url: str) -> str:
    """A URL with a ``hxxp`` scheme and bracketed dots in its authority."""
    head = f"regexp_extract({url}, '(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)"
    body = f"CASE WHEN {head} <> '' THEN substr({url}, length({head}) + 4) ELSE {url} END"
    authority = f"regexp_extract({body}, '^([^/?#]*)', 1)"
    shown = (
        f"CASE lower({head}) WHEN '' THEN '' WHEN 'http' THEN 'hxxp://' WHEN 'https' THEN 'hxxps://' ELSE {head} || '://' END"
    )
    return f"({shown} || replace({authority}, '.', '[.]') || substr({body}, length({authority}) + 1))"


def skeleton(col: str) -> str:
    out = f"translate(lower({col}), '01!|@$3458', 'olilaseasb')"
    for a, b in (("vv", "w"), ("rn", "m"), ("cl", "d")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def brands() -> str:
    """CTEs ending in ``brand``: one row per distinct (registered_domain, subdomain, path, query)."""
    rows = [(a.ordinal, a.brand, a.domain, a.alias) for a in catalogs.brand_aliases()]
    return f"""
aliases(ord, brand, dom, alias) AS {values(rows)},
keywords(kw) AS {values([(k,) for k in catalogs.KEYWORDS])},
b_in AS (SELECT DISTINCT registered_domain, subdomain, path, query FROM canon WHERE ok),
b_sld AS (SELECT DISTINCT registered_domain, string_split(lower(registered_domain), '.')[1] AS sld FROM b_in),
b_name AS (SELECT registered_domain, sld AS t FROM b_sld
           UNION SELECT registered_domain, unnest(list_filter(regexp_split_to_array(sld, '[-_]'), lambda x: x <> '')) FROM b_sld),
b_skel AS (SELECT registered_domain, t, {skeleton('t')} AS s FROM b_name),
b_dist AS (SELECT n.registered_domain, a.ord, min(least(levenshtein(n.t, a.alias), levenshtein(n.s, a.alias))) AS d,
             bool_or(n.t <> a.alias AND n.s = a.alias) AS imitation
           FROM b_skel n CROSS JOIN aliases a GROUP BY ALL),
b_combo AS (SELECT DISTINCT d.registered_domain, a.ord FROM b_sld d CROSS JOIN aliases a CROSS JOIN keywords k
            WHERE contains({skeleton('sld')}, alias || '-' || kw) OR contains({skeleton('sld')}, alias || kw)
               OR contains({skeleton('sld')}, kw || '-' || alias)),
b_dom AS (SELECT d.registered_domain, d.ord, a.brand, d.d,
            NOT (lower(d.registered_domain) = a.dom OR ends_with(lower(d.registered_domain), '.' || a.dom)) AS open_,
            d.imitation OR (d.d = 1 AND length(a.alias) >= 4) OR (d.d = 2 AND length(a.alias) >= 7) AS typo,
            c.ord IS NOT NULL AS combo, a.alias
          FROM b_dist d JOIN aliases a USING (ord) LEFT JOIN b_combo c ON c.registered_domain = d.registered_domain AND c.ord = d.ord),
b_hit AS (SELECT i.registered_domain, i.subdomain, i.path, i.query, d.ord, d.brand, d.d, d.open_ AND d.typo AS typo, d.open_ AND d.combo AS combo,
            d.open_ AND list_contains(regexp_split_to_array(lower(i.subdomain), '[._-]'), d.alias) AS insub,
            d.open_ AND list_contains(regexp_split_to_array(lower(i.path) || '?' || lower(i.query), '[/._?=&#-]'), d.alias) AS inpath
          FROM b_in i JOIN b_dom d USING (registered_domain)),
brand AS (SELECT registered_domain, subdomain, path, query, min(d) AS min_d, arg_min(brand, d * 1000 + ord) AS closest,
            CAST(bool_or(typo) AS INTEGER) AS typo, CAST(bool_or(combo) AS INTEGER) AS combo, CAST(bool_or(insub) AS INTEGER) AS insub,
            CAST(bool_or(inpath) AS INTEGER) AS inpath,
            coalesce(arg_max(brand, ord) FILTER (typo OR combo OR insub), arg_min(brand, ord) FILTER (inpath)) AS matched
          FROM b_hit GROUP BY ALL)"""


def ratio(num: str, den: str, digits: int) -> str:
    """Half-even rounding of an integer ratio, done in integers."""
    scale = 10**digits
    q, r = f"(({num}) * {scale} // ({den}))", f"(({num}) * {scale} % ({den}))"
    up = f"(CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({q} + {up}) / {scale}.0 END"


def entropy(col: str) -> str:
    return f"CASE WHEN {col} = '' THEN 0.0 ELSE round(abs(list_aggregate(string_split({col}, ''), 'entropy')), 4) END"


def features(keys: str) -> str:
    """CTEs ending in ``feat``: keys, ``raw``, parts and all features of the valid rows."""
    kws = sql_list(catalogs.KEYWORDS)
    count = lambda ch: f"(length(u) - length(replace(u, '{ch}', '')))"
    return f"""
f0 AS (SELECT canon.*, b.min_d, b.closest, b.matched, b.typo, b.combo, b.insub, b.inpath
       FROM canon JOIN brand b ON canon.ok AND b.registered_domain = canon.registered_domain AND b.subdomain = canon.subdomain
         AND b.path = canon.path AND b.query = canon.query),
f1 AS (SELECT *, length(u) AS n,
         length(regexp_replace(u, '\\P{{Nd}}', '', 'g')) AS nd, length(regexp_replace(u, '\\P{{L}}', '', 'g')) AS nl,
         list_transform(list_filter(regexp_split_to_array(path || '?' || query, '[/._?=&-]'), lambda x: x <> ''), lambda x: length(x)) AS toks,
         list_filter({kws}, lambda k: contains(lower(u), k)) AS kws FROM f0),
feat AS (SELECT {keys}, raw, u, host, registered_domain, subdomain, suffix, path, query, userinfo, puny, closest, matched, min_d,
  n AS url_len, length(host) AS host_len, length(path) AS path_len, length(query) AS query_len,
  {count('.')} AS n_dots, {count('-')} AS n_hyphens, {count('_')} AS n_underscores, nd AS n_digits, n - nd - nl AS n_special,
  CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END AS n_params,
  len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS path_depth,
  len(list_filter(string_split(subdomain, '.'), lambda x: x <> '')) AS n_subdomains,
  {ratio('nd', 'n', 4)} AS digit_ratio, {ratio('nl', 'n', 4)} AS letter_ratio,
  {ratio("length(regexp_replace(raw, '[^A-Z]', '', 'g'))", 'greatest(length(raw), 1)', 4)} AS uppercase_ratio,
  {ratio('n - nd - nl', 'n', 4)} AS special_ratio,
  {entropy('u')} AS entropy_url, {entropy('host')} AS entropy_host, {entropy('path')} AS entropy_path,
  coalesce(list_max(toks), 0) AS longest_token_len, {ratio('CAST(coalesce(list_sum(toks), 0) AS BIGINT)', 'len(toks)', 2)} AS avg_token_len,
  {ratio("length(regexp_replace(u, '[^aeiouAEIOU]', '', 'g'))", 'greatest(nl, 1)', 4)} AS vowel_ratio,
  is_ip AS is_ip_host, is_private_ip, CAST(port IS NOT NULL AS INTEGER) AS has_port, CAST(has_userinfo AS INTEGER) AS has_userinfo,
  is_idn, is_mixed AS is_mixed_script, has_punycode, has_double_encoding,
  CAST(suffix IN {in_list(catalogs.MULTITENANT_HOSTS)} OR registered_domain IN {in_list(catalogs.MULTITENANT_HOSTS)} AS INTEGER) AS is_multitenant_host,
  CAST(registered_domain IN {in_list(catalogs.SHORTENER_DOMAINS)} AS INTEGER) AS is_shortener,
  len(string_split(host, '.')) AS label_count, length(subdomain) AS subdomain_len,
  insub AS brand_in_subdomain, inpath AS brand_in_path, typo AS typosquat_detected, combo AS combosquat_detected,
  least(min_d, 20) AS min_brand_edit_distance, len(kws) AS suspicious_keyword_count,
  CAST(len(list_filter(kws, lambda k: contains(lower(path), k))) > 0 AS INTEGER) AS keyword_in_path,
  CAST(len(list_filter(kws, lambda k: contains(lower(subdomain), k))) > 0 AS INTEGER) AS keyword_in_subdomain,
  {ratio("3 * len(regexp_extract_all(u, '%[0-9a-fA-F]{2}'))", 'n', 4)} AS pct_encoded_ratio,
  CAST(regexp_matches(u, '[A-Za-z0-9+/]{{20}}') AS INTEGER) AS has_base64_like_token,
  CAST(regexp_matches(u, '[0-9a-fA-F]{{16}}') AS INTEGER) AS has_hex_blob, CAST(contains(path, '//') AS INTEGER) AS double_slash_in_path,
  CAST(contains(query, '@') AS INTEGER) AS at_symbol_in_query, CAST(regexp_matches(query, '(?i)https?://') AS INTEGER) AS url_in_query,
  CAST(length(subdomain) >= 18 AND {entropy('subdomain')} >= 3.5 AS INTEGER) AS long_random_subdomain
  FROM f1)"""


def chain(src: str, keys: str) -> str:
    return ",".join([canon(src, keys), brands(), features(keys)])


RULE_PROB = (
    "least(greatest((CASE WHEN is_ip_host = 1 THEN 0.45 ELSE 0 END) + (CASE WHEN brand_in_subdomain = 1 THEN 0.40 ELSE 0 END) "
    "+ (CASE WHEN typosquat_detected = 1 OR combosquat_detected = 1 THEN 0.40 ELSE 0 END) "
    "+ (CASE WHEN suspicious_keyword_count > 0 THEN 0.15 ELSE 0 END), 0.05), 0.95)"
)


def scan(src: str, keys: str, user_lists: str | None = None, denylist: str | None = None, owner: str = "owner") -> str:
    """CTEs ending in ``scan``. ``user_lists`` (owner, kind, pattern) and ``denylist`` (pattern) name earlier CTEs."""
    hit = lambda kind: (
        f"EXISTS (SELECT 1 FROM {user_lists} l WHERE l.owner = c.{owner} AND l.kind = '{kind}' "
        "AND l.pattern IN (c.u, c.registered_domain, c.host))"
        if user_lists
        else "FALSE"
    )
    denied = (
        f"EXISTS (SELECT 1 FROM {denylist} d WHERE d.pattern IN (c.u, c.registered_domain, c.host))" if denylist else "FALSE"
    )
    shared = f"(c.suffix IN {in_list(catalogs.MULTITENANT_HOSTS)} OR c.registered_domain IN {in_list(catalogs.MULTITENANT_HOSTS)})"
    codes = [
        ("brand_in_subdomain = 1", "brand_in_subdomain_not_regdomain"),
        ("brand_in_path = 1", "brand_in_path_not_regdomain"),
        ("typosquat_detected = 1", "typosquat_brand"),
        ("combosquat_detected = 1", "combosquat_brand"),
        ("is_ip_host = 1", "ip_host"),
        ("f.has_userinfo = 1", "userinfo_trick"),
        ("f.is_mixed_script = 1 OR f.has_punycode = 1", "punycode_mixed_script"),
        ("long_random_subdomain = 1", "long_random_subdomain"),
        ("n_subdomains >= 3", "excessive_subdomains"),
        ("suspicious_keyword_count >= 1 AND (keyword_in_path = 1 OR keyword_in_subdomain = 1)", "suspicious_keywords"),
        ("entropy_url >= 4.2", "high_entropy"),
    ]
    found = "[" + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in codes) + "]"
    on = " AND ".join(f"c.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return (
        chain(src, keys)
        + f""",
s1 AS (SELECT {mine}, c.raw, c.u, c.ok, c.error_message, c.registered_domain AS reg,
         CASE WHEN NOT c.ok THEN 'invalid' WHEN {hit('deny')} THEN 'user_deny' WHEN {denied} THEN 'feed'
              WHEN {hit('allow')} AND NOT {shared} THEN 'user_allow'
              WHEN c.registered_domain IN {in_list(catalogs.ALLOWED_DOMAINS)} AND NOT {shared} AND NOT c.has_userinfo THEN 'allowlist'
              ELSE 'model' END AS layer,
         {RULE_PROB} AS p, list_filter({found}, lambda x: x IS NOT NULL)[1:5] AS found
       FROM canon c LEFT JOIN feat f ON {on}),
scan AS (SELECT {', '.join(k.strip() for k in keys.split(','))}, raw, layer, coalesce(CASE WHEN ok THEN u END, '') AS url_canonical,
           sha256(CASE WHEN layer = 'invalid' THEN raw ELSE u END) AS url_sha256,
           CASE WHEN ok THEN reg ELSE '' END AS registered_domain, error_message,
           CASE WHEN layer = 'invalid' THEN 'unknown' WHEN layer IN ('user_deny', 'feed') THEN 'malicious'
                WHEN layer IN ('user_allow', 'allowlist') OR p < 0.35 THEN 'no_threat_found' WHEN p >= 0.70 THEN 'malicious'
                ELSE 'suspicious' END AS verdict,
           CASE WHEN layer IN ('invalid', 'user_allow', 'allowlist') THEN 0 WHEN layer IN ('user_deny', 'feed') THEN 99
                ELSE CAST(round(p * 100) AS INTEGER) END AS risk_score,
           CASE WHEN layer = 'invalid' THEN 0.0 WHEN layer IN ('user_deny', 'feed') THEN 0.99
                WHEN layer IN ('user_allow', 'allowlist') THEN 0.01 ELSE round(p, 4) END AS probability,
           CASE WHEN layer = 'invalid' THEN 'low' WHEN layer <> 'model' OR p >= 0.85 OR p <= 0.15 THEN 'high' ELSE 'medium' END AS confidence,
           CASE WHEN layer = 'invalid' THEN ['invalid_url'] WHEN layer = 'user_deny' THEN ['user_denylist'] WHEN layer = 'feed' THEN ['feed_hit']
                WHEN layer <> 'model' THEN [] WHEN p >= 0.35 AND len(found) = 0 THEN ['elevated_ml_risk'] ELSE found END AS codes
         FROM s1)"""
    )
