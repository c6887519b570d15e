"""Queries over the corpus operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from urlrisk.llm import (
    conversations,
    decontaminate,
    html_text,
    language,
    licenses,
    mixing,
    near_dedup,
    personal_data,
    quality_rules,
    sentence_dedup,
    spelling,
    url_filter,
    warc,
)
from urlrisk.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    counts = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return judged.select("doc_id", *counts, "base_failed", "kept")


def _quality_sql() -> str:
    rules = quality_rules.RULES
    tests = ", ".join(f"('{r}', {i}, {c})" for r, (_, _, cs) in rules.items() for i, c in enumerate(cs))
    left = " ".join(f"WHEN '{r}' THEN {x[0]}" for r, x in rules.items())
    right = " ".join(f"WHEN '{r}' THEN {x[1]}" for r, x in rules.items())
    p = quality_rules.ALPHA / len(rules)
    return f"""
WITH texts AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts WHERE len(words) >= 8)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, sum(least(8, i - before)) AS n
  FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeated) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN covered USING (doc_id)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), tests(rule, nr, cutoff) AS (VALUES {tests}
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1
), held AS (SELECT * FROM base WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
), sums AS (
  SELECT stratum, rule, nr, cutoff, count(*) AS n,
    count(*) FILTER (WHERE CASE rule {left} END * 1000 > cutoff * CASE rule {right} END) AS k
  FROM held, tests GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k > n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) END AS tail FROM sums
), certified AS (
  SELECT *, bool_and(tail <= {quality_rules.DELTA} / (SELECT count(*) FROM sums))
    OVER (PARTITION BY stratum, rule ORDER BY nr) AS ok FROM tails
), cutoffs AS (
  SELECT stratum, rule, min(cutoff) FILTER (WHERE rule <> 'none') AS cutoff FROM certified WHERE ok GROUP BY ALL
), rejected AS (
  SELECT DISTINCT doc_id FROM base b JOIN cutoffs c ON b.stratum IS NOT DISTINCT FROM c.stratum
  WHERE CASE rule {left} END * 1000 > cutoff * CASE rule {right} END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM base"""


ORACLE["op5_quality_rules"] = _quality_sql()

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


ORACLE["op7_url_filter"] = """
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(v, h, p) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + """
), best AS (
  SELECT page_id, h || p AS rule, v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) = 1
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)"""


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read_archive(spark, warc.write_archive(table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY digest) AS m FROM p)"""


@query
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "items", (F.size("items") > 0).alias("contaminated"))


@query
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op4_sentence_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_dedup.remove_repeated(table(spark, folder, "documents"))


@query
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digest_columns(personal_data.find_personal_data(table(spark, folder, "documents")))


@query
def op11_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversations.digest_columns(conversations.repair_conversations(conversations.damage(turns)), turns)


#: CRC-32 as the table-driven loop over bytes.
CRC_TABLE = """steps(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8"""


def _conversation_sql() -> str:
    """A label (cost, audit, text so far) for each state, turn by turn; structs compare by cost, then audit."""
    label = lambda cost, audit, text: "{'c': " + cost + ", 'a': " + audit + ", 't': " + text + "}"
    insert = lambda x, role: label(f"{x}.c + 5", f"{x}.a || 'I'", f"list_append({x}.t, '{role}:')")
    delete = lambda x: label(f"{x}.c + 2", f"{x}.a || 'D'", f"{x}.t")
    no = "(1000000000 + {x}.c)"
    keep = lambda x, ini: label(
        f"CASE WHEN ini = '{ini}' AND fault IN ('', 't') THEN {x}.c + CASE fault WHEN 't' THEN 5 ELSE 0 END ELSE {no.format(x=x)} END",
        f"{x}.a || 'K'", f"list_append({x}.t, role || ':' || text)")
    rerole = lambda x, role: label(
        f"CASE WHEN fault IN ('', 't') THEN {x}.c + CASE fault WHEN 't' THEN 6 ELSE 1 END ELSE {no.format(x=x)} END",
        f"{x}.a || 'R'", f"list_append({x}.t, '{role}:' || text)")
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    filled = f"SELECT *, {least('u', insert('b', 'user'), insert('s', 'user'), insert('a', 'user'))} AS u1 FROM"
    new_u = least(delete("u1"), *[f(x, r) for x in ("b", "s", "a1") for f, r in ((keep, "u"), (rerole, "user"))])
    new_a = least(delete("a1"), keep("u1", "a"), rerole("u1", "assistant"))
    none = label("1000000000", "''", "[]::VARCHAR[]")
    return f"""
WITH RECURSIVE {CRC_TABLE}
), hashed AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS kind
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations), crc_table
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hashed WHERE kind = 3
), ordered AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), faulty AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN copy > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM ordered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {label("0", "''", "[]::VARCHAR[]")} AS b, {none} AS s, {none} AS u, {none} AS a FROM counts
  UNION ALL
  SELECT conv_id, i, {delete("b")}, {least(delete("s"), keep("b", "s"))}, {new_u}, {new_a}
  FROM (SELECT *, {least("a", insert("u1", "assistant"))} AS a1 FROM
    ({filled} (SELECT f.conv_id, f.i, f.role, f.text, f.ini, f.fault, w.b, w.s, w.u, w.a FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))
), ends AS (
  SELECT w.conv_id, {least("b", "a", insert("u1", "assistant"))} AS best FROM ({filled} walk) w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.rows
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE["op11_conversations"] = _conversation_sql()


@query
def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest_columns(licenses.scan_licenses(table(spark, folder, "documents")))


def _license_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = [
        f"({nr}, {quoted(r.label)}, {r.priority}, {quoted(w)}, {back}, [{', '.join(map(quoted, r.also))}]::VARCHAR[], {quoted(f'^({r.pattern}) ')})"
        for nr, r in enumerate([*licenses.base_rules(licenses.BASE), *licenses.RULES])
        for w, back in r.keys
    ]
    weights = " ".join(f"WHEN {p} THEN {w}" for p, w in licenses.WEIGHTS.items())
    return f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), rules(rule, label, priority, word, back, also, pattern) AS (VALUES {", ".join(rows)}
), places AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM texts
), near AS (SELECT * FROM places JOIN rules ON w = word AND i >= back
), tried AS (
  SELECT r, i - back AS start, rule, label, priority,
    regexp_extract(array_to_string(list_slice(words, i - back + 1, i - back + {licenses.REACH}), ' ') || ' ', pattern, 1) AS m
  FROM near JOIN texts USING (r) WHERE len(also) = 0 OR list_has_any(words, also)
), found AS (SELECT DISTINCT r, start, start + len(string_split(m, ' ')) AS stop, rule, label, priority FROM tried WHERE m <> ''
), kept AS (
  SELECT * FROM found d WHERE priority > 0 AND NOT EXISTS (SELECT 1 FROM found o WHERE o.r = d.r AND o.priority > 0 AND (
    o.priority < d.priority AND o.start < d.stop AND o.stop > d.start
    OR o.priority = d.priority AND o.start <= d.start AND o.stop >= d.stop AND (o.start < d.start OR o.stop > d.stop OR o.rule < d.rule)))
), per_text AS (
  SELECT r, count(*) FILTER (WHERE priority = 0) AS n_base, min(start) FILTER (WHERE priority = 0) AS first_word, max(start) FILTER (WHERE priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    min(priority) FILTER (WHERE priority > 0) AS best
  FROM (SELECT * FROM found WHERE priority = 0 UNION ALL SELECT * FROM kept) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(greatest(CASE best {weights} ELSE 0 END, CASE WHEN n_base > 0 THEN {licenses.BASE_WEIGHT} ELSE 0 END) AS DOUBLE) AS score
FROM texts LEFT JOIN per_text USING (r)"""


ORACLE["op12_licenses"] = _license_sql()


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


ORACLE["op13_spelling"] = """
WITH RECURSIVE """ + CRC_TABLE + """
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), hashed AS (
  SELECT w, count, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(list_transform(string_split(id || ':' || w, ''), lambda c: unicode(c)),
    lambda u: CASE WHEN u < 128 THEN [u::UBIGINT] ELSE [(192 + u // 64)::UBIGINT, (128 + u % 64)::UBIGINT] END))),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM (SELECT id, w, count(*) AS count FROM runs GROUP BY ALL), crc_table
), words AS (
  SELECT word, CAST(sum(count) AS BIGINT) AS n FROM (
    SELECT count, CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(count) >= 3
), deletions AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM deletions a JOIN deletions b ON a.d = b.d AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM deletions a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM deletions a JOIN words b ON a.d = b.word
), near AS (
  SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word
), judged AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN near ON w.word = near.word
), chains(word, root) AS (
  SELECT word, coalesce(form, word) FROM judged
  UNION SELECT c.word, j.form FROM chains c JOIN judged j ON c.root = j.word WHERE j.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (
  SELECT word, arg_max(root, k) AS root FROM (SELECT c.word, c.root, j.n AS k FROM chains c JOIN judged j ON c.root = j.word) GROUP BY word) USING (word)"""


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: their metadata language is the declared one, their source the host."""
    docs = table(spark, folder, "documents")
    return language.identify_languages(docs, docs)


@query
def pages_language(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over all pages, with markup language, address suffix and host; trained on the documents."""
    pages = table(spark, folder, "pages")
    text = html_text.extract_main_text(pages)
    host = F.regexp_extract(F.lower("url"), r"://([^/?#]*)", 1)
    signs = pages.select(
        F.col("page_id").alias("_id"),
        F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1).alias("declared"),
        host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )
    known = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rows = text.join(signs, text["page_id"] == signs["_id"]).select("page_id", "text", known("declared"), known("host"), known("suffix"))
    found = language.identify_languages(
        rows, table(spark, folder, "documents"), id_col="page_id", declared_col="declared", suffix_col="suffix", host_col="host"
    )
    return found.withColumnRenamed("doc_id", "page_id")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
