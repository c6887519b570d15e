"""Public-suffix rules: a compact built-in set, or a full rule file.

The built-in set has common generic suffixes, the usual second-level labels under every country that is not known to
register directly, more of them by country, and the private suffixes of the multi-tenant hosts. A two-letter top label counts as a country code. Pass a rule file
to :func:`read_suffix_rules` for complete coverage.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.functions.text import strip

# --- fixed values -------------------------------------------------------------------------------------

GENERIC = (
    "com net org edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post arpa "
    "app dev page web xyz top site online club shop store tech live life world today news blog cloud host "
    "link click work space website fun icu vip win bid loan men date stream download review party science "
    "trade racing accountant cricket faith buzz monster cyou rest quest sbs zip mov support email services "
    "solutions agency center company digital group network systems security bank finance health media xn--p1ai"
).split()

# labels under which nearly every country registers third-level names, if it does so at all
SECOND_LEVEL = "ac co com edu gob gov mil net org".split()
# more of them, by country
COUNTRY_SECOND_LEVEL = """
uk: me ltd plc sch nhs police
au: id asn
nz: govt geek gen iwi kiwi maori school
jp: or ne go ed ad gr lg
br: art blog eco emp eng esp etc fm gen ind inf jus leg med mp nom pro psi rec srv tur tv wiki
in: gen firm ind nic res
za: nom law school web
kr: or ne go re pe
tr: gen web bel pol tel tv bbs k12 av dr
ua: in kiev lviv
il: k12 muni idf
id: or go sch web desa my
th: or go in mi
hk: idv
tw: idv game ebiz club
sg: per
my: name
vn: biz info name pro health int
pl: biz info art waw
ke: or ne go me sc info
ng: i name sch
gh: or
tz: or ne go me sc
ug: or ne go sc
zw: or
sa: med pub sch
ae: sch
eg: eun name sci
pk: fam biz web gok gop gos
bd: info
lk: sch web ltd assn grp hotel ngo
np: name
ph: ngo i
kh: per
at: gv or
hu: info sport szex
pt: int nome publ
ro: arts firm info nom nt rec store tm www
gr: info
cy: biz ekloges ltd name parliament press pro tm
il: k12 muni
es: nom
fr: asso nom prd tm
ve: info web
pe: nom
co: nom
ec: info fin med pro
uy: gub
py: coop
bo: int tv
cr: ed fi go or sa
do: art sld web
gt: ind
hn: info
ni: ing
pa: abo ing med nom sld
sv: red
"""
# countries that register directly under their label only
DIRECT_COUNTRIES = "de nl ch be dk no se fi cz sk eu us ca tv me io ai ly gg la cc to fm ws".split()
# what these have nevertheless
DIRECT_SECOND_LEVEL = "com.de co.nl co.no com.se gov.cz gc.ca co.ca co.me net.me org.me edu.me ac.me gov.me com.ai net.ai org.ai off.ai com.io com.ly net.ly gov.ly edu.ly org.ly com.ws net.ws org.ws gov.ws edu.ws com.fm net.fm org.fm edu.fm com.la net.la edu.la gov.la com.to net.to org.to gov.to edu.to mil.to com.tv".split()

# suffixes of hosting platforms, as listed in the private section of the rule file
PRIVATE = (
    "github.io web.app firebaseapp.com pages.dev vercel.app netlify.app blogspot.com notion.site "
    "wixsite.com weebly.com glitch.me fly.dev azurewebsites.net s3.amazonaws.com storage.googleapis.com "
    "blob.core.windows.net supabase.co herokuapp.com gitlab.io"
).split()

# every label directly under these is a suffix, except the names in the second line
WILDCARD_PARENTS = "ck er fk np".split()
EXCEPTIONS = ["www.ck"]

# --- end of fixed values --------------------------------------------------------------------------------

MAX_RULE_ROWS = 100_000


@dataclass(frozen=True)
class SuffixRules:
    normal: tuple[str, ...]
    wildcard: tuple[str, ...]
    exception: tuple[str, ...]
    two_letter_countries: bool
    # labels that are suffixes under every two-letter label, except these
    second_level: tuple[str, ...] = ()
    direct_countries: tuple[str, ...] = ()

    @property
    def depth(self) -> int:
        labels = [r.count(".") + 1 for r in self.normal + self.exception]
        return max(labels + [w.count(".") + 2 for w in self.wildcard] + [2 if self.second_level else 1])


def builtin_rules() -> SuffixRules:
    second = [
        f"{label}.{country}"
        for country, labels in (line.split(":") for line in COUNTRY_SECOND_LEVEL.strip().splitlines())
        for label in labels.split()
    ]
    second += DIRECT_SECOND_LEVEL
    names = tuple(dict.fromkeys(GENERIC + second + PRIVATE))
    direct = tuple(DIRECT_COUNTRIES + WILDCARD_PARENTS)
    return SuffixRules(names, tuple(WILDCARD_PARENTS), tuple(EXCEPTIONS), True, tuple(SECOND_LEVEL), direct)


def country_rules(rules: SuffixRules) -> list[str]:
    """The second-level rules of all countries, written out."""
    countries = [a + b for a in ascii_lowercase for b in ascii_lowercase if a + b not in rules.direct_countries]
    return [f"{label}.{country}" for country in countries for label in rules.second_level]


def builtin_rule_table(spark: SparkSession) -> DataFrame:
    """The built-in set in the shape :func:`read_suffix_rules` returns (country rule not included)."""
    r = builtin_rules()
    rows = [(x, "normal") for x in dict.fromkeys((*r.normal, *country_rules(r)))] + [(x, "wildcard") for x in r.wildcard]
    rows += [(x, "exception") for x in r.exception]
    return spark.createDataFrame(rows, "rule string, kind string")


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Read a public-suffix rule file: ``//`` comments, ``*.`` wildcards, ``!`` exceptions."""
    line = F.lower(F.element_at(F.split(strip(F.col("value")), r"\s"), 1))
    return (
        spark.read.text(path)
        .select(line.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("//"))
        .select(
            F.regexp_replace("line", r"^(\*\.|!)", "").alias("rule"),
            F.when(F.col("line").startswith("*."), "wildcard")
            .when(F.col("line").startswith("!"), "exception")
            .otherwise("normal")
            .alias("kind"),
        )
        .distinct()
    )
