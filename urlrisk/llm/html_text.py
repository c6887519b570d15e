"""Main text of web pages by template deduction from equivalence classes.

1. Every page becomes a sequence of tokens: block tags with the path of elements (name, class and id) that leads to
   them, and whole text blocks under their path. A token's occurrence vector over the distinct pages of its host is
   kept as a 64-bit fingerprint (xor of hashes of page and count), so one grouped aggregation finds for all hosts which tokens share a
   vector, and a host with a third of all pages is aggregated like any other.
2. Tokens with the same vector on at least half of a host's pages form an equivalence class. A class is valid if its
   tokens have one order; classes are nested by the span between their first and last token, and a class that
   crosses a larger one is dropped. The valid classes are the host's template. Its size is bounded by twice a page's.
3. What the template leaves of a page are slots: text between template tokens. A text block that is itself part of
   the template (on nearly all pages) is boilerplate, unless the page marks it as main text. A slot belongs to the region of the template that holds it: menus, headers,
   footers, sidebars, notices, adverts, forms and comments are named by their elements, classes, ids or roles, or, if
   nothing names them, by their share of link text over all pages of the host. The slots of the main region are the text: inside ``article`` or ``main``
   where a page has them, else everywhere.

Hosts with fewer than ``MIN_PAGES`` distinct pages have no template; the region rules act alone.

Cases: null and empty html give an empty text; a null url is a host of its own. Repeated rows and copies count once for
the template and are all returned. Broken or cut-off html is read as far as it goes. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

MIN_PAGES = 4
#: Share of a host's pages on which a class must occur, and on which a text block counts as template.
CLASS_SHARE = 0.5
TEXT_SHARE = 0.9
#: Share of link text above which an unnamed region counts as navigation.
LINK_SHARE = 0.5
TEMPLATE_HOSTS = 50_000

BLOCKS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text.
OPAQUE = frozenset("script style noscript template iframe object svg math canvas textarea select option datalist head title video audio".split())
#: An opening tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}} | {
    t: {"p"} for t in "div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre hr main figure fieldset".split()
}
SCOPES = frozenset("ul ol dl table article section div aside nav header footer form main body blockquote td th".split())
SIDE_ELEMENTS = frozenset("nav aside footer form menu dialog button fieldset".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo "
    "promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar "
    "widget widgets".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
#: Words that name a layout ("with-sidebar") or a part of the text ("post-header") rather than a side region.
LAYOUT_WORDS = frozenset("has layout no with without".split())
TEXT_WORDS = frozenset("article content entry post story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _region(name: str, attrs: str, inside_main: bool) -> tuple[bool, bool, str]:
    """(is a side region, is a main region, label of the element in paths)."""
    side = name in SIDE_ELEMENTS or name == "header" and not inside_main
    main = name in ("article", "main")
    label = name
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if key == "class":
                    label += "." + value
                if name not in ("html", "body"):
                    words = {w.lower() for w in PIECES.findall(value)}
                    if not words & LAYOUT_WORDS:
                        side |= bool(words & SIDE_WORDS) or bool(words & HEAD_WORDS) and not inside_main and not words & TEXT_WORDS
            elif key == "role":
                side |= value in SIDE_ROLES
                main |= value in ("main", "article")
            elif key == "itemprop":
                main |= value.lower() == "articlebody"
            elif key == "style":
                side |= "display:none" in value.lower().replace(" ", "")
            else:
                side |= key == "hidden" or value == "true"
    return side, main and not side, label


def parse(html: str) -> list[tuple[int, int, str, bool, bool, int]]:
    """Tokens in page order: (hash, parent's hash, text, side, main, characters in links). A tag has no text (None)."""
    out: list = []
    # open block elements: name, path hash, side, main
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    text: list[str] = []
    links = linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(unescape("".join(text)).split())
            if block:
                _, path, side, main = stack[-1]
                out.append((xxhash.xxh64_intdigest(block, path & 0xFFFFFFFF) - (1 << 63), path, block, side, main, min(linked, len(block))))
            text.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        closing = bool(m[1])
        if name in OPAQUE and not closing:
            flush() if name in BLOCKS else None
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>|<body\b" if name in ("head", "title") else rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = (stop.start() if stop[0][1] != "/" else stop.end()) if stop else end
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    links = 0
                    break
            continue
        ends = ENDS.get(name)
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        _, path, side, main = stack[-1]
        new_side, new_main, label = _region(name, m[3], main)
        own = xxhash.xxh64_intdigest(label, path & 0xFFFFFFFF) - (1 << 63)
        out.append((own, path, None, side or new_side, main or new_main, 0))
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, own, side or new_side, main or new_main))
    flush()
    return out


def _host(url: str) -> str:
    rest = url.partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


TOKENS = "host string, token long, is_text boolean, page long, n int, first int, last int, chars long, linked long"


def page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct tokens of each page: count, first and last place, characters and characters in links (of a tag: of the text right in it)."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    for batch in batches:
        rows = []
        for host, html in zip(batch["host"], batch["html"], strict=True):
            tokens = parse(html)
            page = xxhash.xxh64_intdigest(html) - (1 << 63)
            seen: dict[int, list] = {}
            for i, (own, parent, text, _, _, linked) in enumerate(tokens):
                row = seen.get(own)
                if row is None:
                    seen[own] = row = [text is not None, 0, i, i, 0, 0]
                row[1] += 1
                row[3] = i
                if text is not None and parent in seen:
                    seen[parent][4] += len(text)
                    seen[parent][5] += linked
            rows += [(host, own, r[0], page, *r[1:]) for own, r in seen.items()]
        yield pd.DataFrame(rows, columns=names)


def nest_classes(tokens: pd.DataFrame) -> pd.DataFrame:
    """The valid classes of one host. ``tokens``: host, token, vec, support, first, last (mean places), pages."""
    spans = tokens.groupby("vec").agg(lo=("first", "min"), hi=("last", "max"), support=("support", "max"), size=("token", "size"))
    spans = spans.sort_values(["support", "size", "lo"], ascending=[False, False, True], kind="stable")
    kept: list[tuple[float, float]] = []
    valid = set()
    for vec, lo, hi in zip(spans.index, spans["lo"], spans["hi"], strict=True):
        # half a token of play: places are means
        if all(hi <= a + 0.5 or lo >= b - 0.5 or (lo >= a - 0.5 and hi <= b + 0.5) or (lo <= a + 0.5 and hi >= b - 0.5) for a, b in kept):
            kept.append((lo, hi))
            valid.add(vec)
    return tokens[tokens["vec"].isin(valid)]


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, texts, menus): hashes of the template's text blocks, and of its regions that consist of links. ``pages``: host, html, copies of a host once."""
    found = pages.mapInPandas(page_tokens, TOKENS)
    vectors = found.groupBy("host", "token").agg(
        F.first("is_text").alias("is_text"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vec"),
        F.count("*").alias("support"),
        F.avg("first").alias("first"),
        F.avg("last").alias("last"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
    )
    sizes = cut_lineage(pages.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES))
    frequent = vectors.join(bounded_broadcast(sizes), "host").where(F.col("support") >= CLASS_SHARE * F.col("pages"))

    def nest(host: pd.DataFrame) -> pd.DataFrame:
        return nest_classes(host)

    nested = frequent.groupBy("host").applyInPandas(nest, frequent.schema)
    common_text = F.col("is_text") & (F.col("support") >= TEXT_SHARE * F.col("pages"))
    menu = ~F.col("is_text") & (F.col("linked") > LINK_SHARE * F.col("chars"))
    return nested.groupBy("host").agg(
        F.collect_list(F.when(common_text, F.col("token"))).alias("texts"),
        F.collect_list(F.when(menu, F.col("token"))).alias("menus"),
    )


def main_text(html: str, texts: set[int], menus: set[int]) -> str:
    """The slots of the main region."""
    tokens = [t for t in parse(html) if t[2] is not None]
    if any(t[4] and not t[3] for t in tokens):
        tokens = [t for t in tokens if t[4]]
    out = []
    for own, parent, text, side, main, linked in tokens:
        if side or not main and (own in texts or parent in menus or linked > LINK_SHARE * len(text)):
            continue
        out.append(text)
    return " ".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bound_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), html.alias("html"))

    # copies within a host count once: only pages whose content occurs again need a look
    marked = rows.select("host", "page_id", F.xxhash64("html").alias("_h"))
    again = marked.groupBy("host", "_h").agg(F.count("*").alias("_c"), F.min("page_id").alias("_first")).where("_c > 1")
    again = cut_lineage(again.select("host", "_h", "_first"))
    distinct = rows.withColumn("_h", F.xxhash64("html")).join(bounded_broadcast(again), ["host", "_h"], "left")
    distinct = distinct.where(F.col("_first").isNull() | (F.col("_first") == F.col("page_id"))).select("host", "html")
    templates = cut_lineage(deduce_templates(distinct))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                main_text(h, set(t) if t is not None else set(), set(m) if m is not None else set())
                for h, t, m in zip(batch["html"], batch["texts"], batch["menus"], strict=True)
            ]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})

    joined = rows.join(bounded_broadcast(templates, TEMPLATE_HOSTS), "host", "left").select("page_id", "url", "html", "texts", "menus")
    out = joined.mapInPandas(extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
