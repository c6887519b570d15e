"""Brand lookalikes: edit distance, typosquats, combosquats and misplaced brand names.

The alias catalog is a literal array in the plan, so matching needs no join and no shuffle. Costly steps are
guarded by cheap ones: aliases are only compared pair by pair when the smallest distance allows a hit.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.distances import nearest_words
from urlrisk.functions.planning import computed_stage
from urlrisk.functions.text import literal_array, non_empty, regex_union
from urlrisk.sources.catalogs import KEYWORDS, Alias, brand_aliases

NO_DISTANCE = 999  # fixed value: distance when the catalog is empty
SHORTEST_SQUATTED = {1: 4, 2: 7}  # fixed values: shortest alias that a misspelling of this distance may stand for

# fixed values: look-alike characters and what they stand for, then look-alike pairs in the order applied
LOOKALIKE_FROM, LOOKALIKE_TO = "01!|@$3458", "olilaseasb"
LOOKALIKE_PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"))

# fixed values: characters (as in a regex class) that end a token of a subdomain, or of a path with its query
SUBDOMAIN_BREAKS, PATH_BREAKS = r".\-_", r"/.\-_?=&#"

BRAND_FIELDS = (
    "brand_in_subdomain brand_in_path typosquat_detected combosquat_detected closest_brand "
    "min_edit_distance matched_brand_name"
).split()


def skeleton(text: Column) -> Column:
    """Lower-case text with look-alike characters replaced by the letters they imitate."""
    out = F.translate(F.lower(text), LOOKALIKE_FROM, LOOKALIKE_TO)
    for pair, letter in LOOKALIKE_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def _alias_array(aliases: Sequence[Alias]) -> Column:
    """The catalog as one literal array of structs."""
    row = "named_struct('ordinal', {0.ordinal}, 'brand', '{0.brand}', 'domain', '{0.domain}', 'alias', '{0.alias}', 'len', {1})"
    for a in aliases:
        if not re.fullmatch(r"[^'\\\\]*", a.brand + a.domain + a.alias):
            raise ValueError(f"quote or backslash in brand alias: {a}")
    return F.expr("array(" + ", ".join(row.format(a, len(a.alias)) for a in aliases) + ")")


def match_brands(
    df: DataFrame,
    parsed: str = "parsed",
    out: str = "brand",
    aliases: Sequence[Alias] | None = None,
    keywords: Sequence[str] = KEYWORDS,
    details: bool = True,
) -> DataFrame:
    """Add struct ``out`` with the brand findings of each URL.

    ``details=False`` leaves out ``closest_brand`` and ``matched_brand_name`` (null), which the features do not
    need.
    """
    aliases = brand_aliases() if aliases is None else list(aliases)
    keep = [k for k in df.columns if k != out]
    c = F.col
    p = F.col(parsed)
    catalog = _alias_array(aliases) if aliases else None

    df = df.select(
        *keep,
        F.lower(p["registered_domain"]).alias("_dom"),
        F.lower(p["subdomain"]).alias("_subdomain"),
        F.lower(p["path"]).alias("_p"),
        F.lower(p["query"]).alias("_q"),
    )
    if catalog is None:
        empty = F.struct(
            *[F.lit(False).alias(f) for f in BRAND_FIELDS[:4]],
            F.lit(None).cast("string").alias("closest_brand"),
            F.lit(NO_DISTANCE).alias("min_edit_distance"),
            F.lit(None).cast("string").alias("matched_brand_name"),
        )
        return df.select(*keep, empty.alias(out))

    df = df.withColumn("_sld", F.substring_index("_dom", ".", 1))
    df = df.withColumn("_skel", skeleton(c("_sld")))
    # the name itself and its hyphen or underscore parts; a replaced pair never spans these, so the parts of the skeleton are the skeletons of the parts
    parts = lambda name: non_empty(F.split(name, "[-_]"))
    df = df.withColumn("_cands", F.array_distinct(F.concat(F.array("_sld", "_skel"), parts("_sld"), parts("_skel"))))
    # all aliases at once for the distinct names of a batch
    df = df.withColumn("_near", nearest_words([a.alias for a in aliases], SHORTEST_SQUATTED)(c("_cands")))
    df = df.withColumns({"_min": F.when(c("_near.distance") > NO_DISTANCE, NO_DISTANCE).otherwise(c("_near.distance")), "_nearest": c("_near.nearest"), "_misspelt": c("_near.misspelt")}).drop("_near")

    # names beside their skeletons, where an imitation is possible: it is at distance 0 once its look-alikes are replaced
    whole_and_parts = F.array_distinct(F.concat(F.array("_sld"), parts("_sld")))
    close = (c("_min") <= 0) | (F.size("_misspelt") > 0)
    df = df.withColumn("_pairs", F.when(close, F.transform(whole_and_parts, lambda t: F.struct(t.alias("t"), skeleton(t).alias("s")))))

    domains = sorted({a.domain for a in aliases})
    name, word = regex_union(a.alias for a in aliases), regex_union(keywords)
    legit = lambda a: (c("_dom") == a["domain"]) | c("_dom").endswith(F.concat(F.lit("."), a["domain"]))
    df = df.withColumns(
        {
            "_onsite": c("_dom").rlike(r"(?:^|\.)" + regex_union(domains) + r"\z"),
            "_stokens": F.split("_subdomain", f"[{SUBDOMAIN_BREAKS}]"),
            "_address": F.concat("_p", F.lit("?"), "_q"),
            "_named": c("_skel").rlike(name),
            # whether combo() holds for any alias, free or not
            "_combined": c("_skel").rlike(f"{name}-?{word}|{word}-{name}") if keywords else c("_skel").isNull(),
        }
    )
    # aliases of brands that do not own the site; kept as an expression so that rows never carry the catalog
    others = F.filter(catalog, lambda a: ~legit(a))
    free = F.when(c("_onsite"), others).otherwise(catalog)
    path_tokens = F.split("_address", f"[{PATH_BREAKS}]")
    in_sub = lambda a: F.array_contains(c("_stokens"), a["alias"])
    in_path = lambda a: F.array_contains(path_tokens, a["alias"])

    def names_token(text: Column, tokens: Column, breaks: str) -> Column:
        """Whether a token is a free alias; one search of the text rules out most rows, and no alias with a break in it is a token."""
        whole = [a.alias for a in aliases if not re.search(f"[{breaks}]", a.alias)]
        if not whole:
            return F.when(text.isNotNull(), False)
        found = text.rlike(rf"(?:^|[{breaks}]){regex_union(whole)}(?:[{breaks}]|\z)")
        return F.when(found & c("_onsite"), F.arrays_overlap(tokens, others["alias"])).otherwise(found)

    def typo(a: Column) -> Column:
        imitation = F.exists(c("_pairs"), lambda x: (x["t"] != a["alias"]) & (x["s"] == a["alias"]))
        return imitation | F.array_contains(c("_misspelt"), a["alias"])

    words = literal_array(keywords)

    def combo(a: Column) -> Column:
        # the alias itself comes first: most aliases end here
        return F.contains(c("_skel"), a["alias"]) & F.exists(
            words,
            lambda k: F.contains(c("_skel"), F.concat(a["alias"], F.lit("-"), k))
            | F.contains(c("_skel"), F.concat(a["alias"], k))
            | F.contains(c("_skel"), F.concat(k, F.lit("-"), a["alias"])),
        )

    df = df.withColumns(
        {
            # a name that is its own skeleton imitates nothing
            "_typo": F.when((F.size("_misspelt") == 0) & ((c("_min") > 0) | (c("_sld") == c("_skel"))), False).otherwise(F.exists(free, typo)),
            "_combo": F.when(~c("_named"), False).when(~c("_combined"), False).when(~c("_onsite"), True).otherwise(F.exists(free, combo)),
            "_insub": names_token(c("_subdomain"), c("_stokens"), SUBDOMAIN_BREAKS),
            "_inpath": names_token(c("_address"), path_tokens, PATH_BREAKS),
        }
    )
    nothing = F.lit(None).cast("string")
    if details:
        strong = F.filter(
            free,
            lambda a: (c("_typo") & typo(a)) | (c("_combo") & combo(a)) | (c("_insub") & in_sub(a)),
        )
        df = df.withColumn("_strong", F.when(c("_typo") | c("_combo") | c("_insub"), strong))
        matched = F.coalesce(
            F.try_element_at(c("_strong"), F.lit(-1))["brand"],
            F.when(c("_inpath"), F.try_element_at(F.filter(free, in_path), F.lit(1))["brand"]),
        )
        brand_of = dict(reversed([(a.alias, a.brand) for a in aliases]))  # the first of two equal aliases
        nearest = F.create_map(*[F.lit(x) for pair in brand_of.items() for x in pair])[c("_nearest")]
    else:
        matched, nearest = nothing, nothing
    result = F.struct(
        c("_insub").alias("brand_in_subdomain"),
        c("_inpath").alias("brand_in_path"),
        c("_typo").alias("typosquat_detected"),
        c("_combo").alias("combosquat_detected"),
        nearest.alias("closest_brand"),
        c("_min").alias("min_edit_distance"),
        matched.alias("matched_brand_name"),
    )
    return computed_stage(df, keep, {out: F.when(p["is_valid"], result)})
