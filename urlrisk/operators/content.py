"""Features of a page's HTML: password inputs, forms and links to other domains, hidden frames, a title that names a foreign brand.

Tags are found by column expressions in the scan. Hosts of links and forms are canonicalized once per distinct host and joined back, so a host that many pages name costs
one row. An attribute value ends a tag early if it holds a ``>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.planning import computed_stage
from urlrisk.operators.canonical import canonicalize_urls
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast, lookup_join
from urlrisk.sources.catalogs import Alias, brand_aliases

CONTENT_FEATURES = ("has_password_input", "off_domain_form", "ext_link_ratio", "hidden_iframe", "title_brand_mismatch")
IGNORED = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAGS = r"(?is)<(?:form|a|iframe|input)\b[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title>"
HOST = r"(?i)^\s*(?:https?:)?//([^/?#]*)"
HIDDEN_STYLE = r"(?is)display\s*:\s*none|visibility\s*:\s*hidden"


def attribute_pattern(name: str) -> str:
    """Three groups, of which the one that matches holds the value."""
    return rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, empty if there is none."""
    pattern = F.lit(attribute_pattern(name))
    return F.concat(*[F.call_function("regexp_extract", tag, pattern, F.lit(i)) for i in (1, 2, 3)])


def _is(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)^<{name}\b")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def _tiny(tag: Column) -> Column:
    return attribute(tag, "width").rlike("^[01](?:px)?$") | attribute(tag, "height").rlike("^[01](?:px)?$")


def content_features(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", brands: Sequence[Alias] | None = None) -> DataFrame:
    """(id_col, has_password_input, off_domain_form, ext_link_ratio, hidden_iframe, title_brand_mismatch); ids tell the pages apart.

    Relative links stay on the page's domain. A page without links has a ratio of 0; null HTML has no tags.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), IGNORED, ""), F.lit(TAGS), F.lit(0))
    title = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), TITLE, 1))
    rows = computed_stage(pages, [id_col, url_col], {"_tags": tags, "_title": title})
    targets = lambda tag, name: F.filter(
        F.transform(F.filter("_tags", lambda t: _is(t, tag)), lambda t: attribute(t, name)), lambda v: v != ""
    )
    hidden = lambda t: _is(t, "iframe") & (
        t.rlike(r"(?is)[\s\"']hidden(?:[\s=>/]|$)") | attribute(t, "style").rlike(HIDDEN_STYLE) | _tiny(t)
    )
    seen = computed_stage(
        rows,
        [id_col, "_title"],
        {
            "_host": F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)),
            "_links": F.transform(targets("a", "href"), _host),
            "_forms": F.transform(targets("form", "action"), _host),
            "has_password_input": F.exists("_tags", lambda t: _is(t, "input") & (F.lower(attribute(t, "type")) == "password")).cast("int"),
            "hidden_iframe": F.exists("_tags", hidden).cast("int"),
        },
    )
    seen = cut_lineage(seen)
    # one row for each page and host, whose registered domain comes from the table of distinct hosts
    named = F.concat(
        F.array(F.struct(F.lit("page").alias("kind"), F.col("_host").alias("host"))),
        F.transform("_links", lambda h: F.struct(F.lit("link").alias("kind"), h.alias("host"))),
        F.transform("_forms", lambda h: F.struct(F.lit("form").alias("kind"), h.alias("host"))),
    )
    flat = seen.select(id_col, F.explode(named).alias("_x")).where("_x.host <> ''").groupBy(id_col, "_x.kind", "_x.host").agg(F.count("*").alias("n"))
    flat = cut_lineage(flat)
    hosts = canonicalize_urls(flat.select("host").distinct().withColumn("_url", F.concat(F.lit("http://"), "host")), "_url")
    domains = cut_lineage(hosts.select("host", F.col("parsed.registered_domain").alias("domain")))
    known = lookup_join(flat, domains, ["host"])
    own = known.where("kind = 'page'").select(F.col(id_col).alias("_id"), F.col("domain").alias("_own"))
    own = cut_lineage(own)
    there = known.where("kind <> 'page'").join(bounded_broadcast(own), F.col(id_col) == F.col("_id"), "left")
    foreign = F.when(~F.col("domain").eqNullSafe(F.col("_own")), F.col("n")).otherwise(0)
    sums = there.groupBy(id_col).agg(
        F.sum(F.when(F.col("kind") == "link", foreign)).alias("_ext"), F.sum(F.when(F.col("kind") == "form", foreign)).alias("_off")
    )
    out = seen.join(sums, id_col, "left").join(own, F.col(id_col) == F.col("_id"), "left")
    foreign_brand = F.lit(False)
    for a in brands if brands is not None else brand_aliases():
        says = F.col("_title").rlike(f"(?:^|[^a-z0-9]){a.alias}(?:[^a-z0-9]|$)")
        foreign_brand = foreign_brand | (says & ~F.col("_own").eqNullSafe(F.lit(a.domain)))
    ratio = F.coalesce(F.try_divide(F.coalesce("_ext", F.lit(0)), F.size("_links")), F.lit(0.0))
    return out.select(
        id_col,
        "has_password_input",
        (F.coalesce("_off", F.lit(0)) > 0).cast("int").alias("off_domain_form"),
        F.round(ratio, 6).alias("ext_link_ratio"),
        "hidden_iframe",
        foreign_brand.cast("int").alias("title_brand_mismatch"),
    )
