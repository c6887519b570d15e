"""Labelled URL corpus spliced from a table of pages and a list of URL shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: id, label (1 = malicious), template; {id} is the page id and {url} the page URL
TEMPLATES = (
    (0, 0, "{url}"),
    (1, 0, "https://www.spotify.com/account/orders/{id}"),
    (2, 0, "https://gitlab.com/team-{id}/board/-/milestones"),
    (3, 0, "HTTPS://Shop.Contoso-Books.ORG:443/Catalog/Item{id}.ASPX"),
    (4, 0, "http://harbor-museum.net:80/rooms/./east/../west/{id}"),
    (5, 0, "https://fr.wiktionary.org/wiki/mot_{id}"),
    (6, 0, "https://timetable.north-rail.org.nz:9443/lines/7?stop={id}&lang=mi#map"),
    (7, 0, "river-poems.info/verse/{id}"),
    (8, 0, "  https://gazette.island-post.com./issue-{id}/\t"),
    (9, 0, "https://seed-library.org/find?term=blue%20oat%2D{id}"),
    (10, 1, "http://netflix.com.member-check-{id}.icu/login"),
    (11, 1, "http://paypa1-helpdesk.org/verify/ticket/{id}"),
    (12, 1, "http://rnicrosoft.net/mailbox/{id}"),
    (13, 1, "https://amazon-billing.parcel-{id}.click/payment"),
    (14, 1, "http://10.44.7.19:8888/router/{id}"),
    (15, 1, "http://3232236033/panel/{id}"),
    (16, 1, "http://0xc0a80a21/panel{id}"),
    (17, 1, "https://city-library.org:reader@fast-transfer{id}.net/inbox"),
    (18, 1, "https://forum-archive.org//jump?to=https://drop-point.biz/box&sig=9f8e7d6c5b4a39281706f5e4d3c2b1a0&n={id}"),
    (19, 1, "https://invoice-{id}.netlify.app/login"),
    (20, 1, "http://tinyurl.com/q{id}z"),
    (21, 1, "https://forum-archive.org/find?term=red%2520oat&n={id}"),
    (22, 1, "http://q7w3z9k1v5b8n2m4t6r0.static-drop{id}.pw/secure/login"),
    (23, 1, "https://google.alert.signin.review.mail{id}.top/drive/signin"),
    (24, 1, "http://cheap-host{id}.ru/netflix/login.php?mail=someone@mail-box.org"),
    (25, 1, "https://chase-login.net/{id}/%73%69%67%6E%69%6e"),
    (26, 1, "http://faceb00k.com/{id}"),
    (27, 1, "ftp://mirror.seed-library.org/pack-{id}.zip"),
    (28, 1, "\t \t"),
    (29, 1, "https:///nohost/{id}"),
    (30, 0, "https://zürich-reisen{id}.ch/angebote"),
    (31, 0, "https://xn--zrich-reisen-dlb.ch/angebote/{id}"),
    (32, 1, "http://аpple-konto{id}.com/signin"),  # the first a is Cyrillic
    (33, 1, "http://[2001:db8:0:7::5]:8443/x/{id}"),
    (34, 1, "http://[fd00::2/x/{id}"),
    (35, 0, "https://box{id}.nosuchlabel/y"),
    (36, 0, "http://netlify.app/{id}"),
    (37, 1, "http://deal.store-{id}.pages.dev/?k=1&l=2&m=3"),
    (38, 1, "https://forum-archive.org/b%%352/{id}?then=HTTP://y.net"),
    (39, 1, "https://wellsfargo.com.account-safety.com.au/{id}"),
    (40, 0, "http://guest@seed-library.org/{id}#https://drop-point.biz"),
    (41, 1, "http://g00gle-drive-login.com:0090/c_d/{id}/../../../z"),
    (42, 0, "https://one.two.www.ck/{id}?v=%42%7e%2F&w="),
    (43, 1, "http://instagrram.co/photo-{id}/confirm"),
)
FIRST_DAY, N_DAYS = "2026-01-01", 270  # fixed values


#: Pages that one task makes URLs of (44 times as many): tasks grow in number with the table, not in length.
PAGES_PER_TASK = 1000


def spread(df: DataFrame, rows_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """Repartition a source with too few splits: at least one task per core, and at most about ``rows_per_task`` rows in each.

    The rows are counted first, which reads no column of a parquet table; a split of a file may hold any number of rows.
    """
    if df.isStreaming:
        return df
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def url_corpus(pages: DataFrame) -> DataFrame:
    """``page_id, tpl, label, source, url, first_seen`` for every page and template."""
    text = lambda t: F.replace(
        F.replace(F.lit(t), F.lit("{id}"), F.col("page_id").cast("string")), F.lit("{url}"), F.col("url")
    )
    shapes = F.array(
        *[F.struct(F.lit(i).alias("tpl"), F.lit(label).alias("label"), text(t).alias("url")) for i, label, t in TEMPLATES]
    )
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (F.col("page_id") % N_DAYS).cast("int"))
    pages = spread(pages.select("page_id", "url"))
    rows = pages.select("page_id", day.alias("first_seen"), F.explode(shapes).alias("_s"))
    source = F.when(F.col("_s.label") == 1, "malicious").otherwise("benign")
    return rows.select("page_id", "_s.tpl", "_s.label", source.alias("source"), "_s.url", "first_seen")

# fixed values: what pages of several kinds have besides their own content
INSERTS = (
    "",
    "<form method=post action='https://collect-{id}.drop-point.biz/in'><input name=user><input type=\"PASSWORD\" name=pw></form>",
    '<iframe src="/frame" style="border:0; display: none"></iframe><a href="https://news.island-post.com/{id}">more</a>',
    "<!-- <input type=password> --><title>PayPal: confirm</title><a href='//www.paypal.com/help'>help</a><a href=\"/x\">x</a>",
    "<form action=\"/search\"><input type=text></form><iframe width=1 src=//pixel.example.org></iframe>",
    '<a href="{url}">self</a><a href="https://a.b.co.uk/{id}">b</a><a href="mailto:x@y.org">mail</a><iframe src=/f hidden></iframe>',
)


def content_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, html``: each page with one of the inserts at its start, so that all content features occur."""
    kinds = F.array(*map(F.lit, INSERTS))
    insert = F.get(kinds, (F.col("page_id") % len(INSERTS)).cast("int"))
    insert = F.replace(F.replace(insert, F.lit("{id}"), F.col("page_id").cast("string")), F.lit("{url}"), F.col("url"))
    return pages.select("page_id", "url", F.concat(insert, F.col("html")).alias("html"))

# fixed values of the seeded corpus
SEED_WORDS = "river stone maple harbor cedar lantern orchard meadow copper willow summit garden anchor velvet amber quartz".split()
SEED_ENDINGS = "com org net info".split()
SEED_BAIT = "login verify billing secure support update".split()
SEED_PATHS = ("", "index.html", "about/team", "docs/guide", "account/settings", "news/2026/list")
#: How many of 16 draws go to the first, second, third and fourth ending.
SEED_SHARES = (8, 4, 3, 1)
PARAM_PERCENT = 30


def seeded_corpus(ids: DataFrame, id_col: str = "id", seed: int = 42, malicious_percent: int = 45) -> DataFrame:
    """``id, label, domain, url, first_seen`` of a labelled URL for each id: the same ids and seed give the same corpus, however it is partitioned.

    Draws are hashes of (seed, id, purpose). Endings are drawn from a table of slots by their shares; ``PARAM_PERCENT`` of the URLs have a parameter; all URLs of a domain share one date.
    """

    def hashed(*parts) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 8), 16, 10).cast("long")

    draw = lambda purpose, n: (hashed(F.col(id_col).cast("string"), F.lit(purpose)) % n).cast("int")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    slots = [e for e, share in zip(SEED_ENDINGS, SEED_SHARES, strict=True) for _ in range(share)]
    bad = draw("label", 100) < malicious_percent
    ending = pick(slots, draw("ending", len(slots)))
    first, second = pick(SEED_WORDS, draw("first", len(SEED_WORDS))), pick(SEED_WORDS, draw("second", len(SEED_WORDS)))
    name = F.when(bad, F.concat(first, F.lit("-"), pick(SEED_BAIT, draw("bait", len(SEED_BAIT))))).otherwise(F.concat(first, second))
    rows = ids.select(F.col(id_col).alias("id"), bad.cast("int").alias("label"), F.concat(name, F.lit("."), ending).alias("domain"))
    draw = lambda purpose, n: (hashed(F.col("id").cast("string"), F.lit(purpose)) % n).cast("int")
    path = pick(SEED_PATHS, draw("path", len(SEED_PATHS)))
    param = F.when(draw("param", 100) < PARAM_PERCENT, F.concat(F.lit("?ref="), draw("value", 1000).cast("string"))).otherwise("")
    scheme = F.when(rows["label"] == 1, "http://").otherwise("https://")
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (hashed(F.col("domain"), F.lit("day")) % N_DAYS).cast("int"))
    return rows.select("id", "label", "domain", F.concat(scheme, "domain", F.lit("/"), path, param).alias("url"), day.alias("first_seen"))
