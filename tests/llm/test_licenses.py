"""License scan against a plain version that tries every rule at every word."""

import random
import re

from urlrisk.llm import licenses as lic

SCHEMA = "doc_id long, text string, start string, rule string, base string"


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_found(words, rules):
    out = set()
    for nr, r in enumerate(rules):
        if r.also and not set(r.also) & set(words):
            continue
        for i in range(len(words)):
            m = re.match(f"({r.pattern}) ", " ".join(words[i : i + lic.REACH]) + " ")
            if m:
                out.add((i, i + len(m[1].split(" ")), r.priority, nr, r.label))
    return out


def plain_kept(found):
    def gone(d):
        for o in found:
            if o[2] < d[2] and o[0] < d[1] and o[1] > d[0]:
                return True
            if o[2] == d[2] and o[0] <= d[0] and o[1] >= d[1] and (o[0] < d[0] or o[1] > d[1] or o[3] < d[3]):
                return True
        return False

    return {d for d in found if not gone(d)}


def plain_base(words):
    return sorted((i, label) for phrase, label in lic.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def sample(pattern, rng):
    """A text that a pattern matches: first or second alternatives, optional parts at random."""
    import re._parser as parser

    def build(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "q"
            elif name == "IN":
                kind, value = arg[0] if str(arg[0][0]) != "NEGATE" else ("LITERAL", 113)
                out += chr(value[0]) if str(kind) == "RANGE" else chr(value)
            elif name == "SUBPATTERN":
                out += build(arg[3])
            elif name == "BRANCH":
                out += build(rng.choice(arg[1]))
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                out += build(inner) * rng.randint(low, min(high, low + 1))
            elif name == "ANY":
                out += "q"
        return out

    return build(parser.parse(pattern))


def texts():
    rng = random.Random(2)
    fill = "the of work software license mit gnu under by cc clause 2 3 public code free version all rights in domain Été ñandú".split()
    docs = []
    for n, r in enumerate(lic.RULES):
        words = [rng.choice(fill) for _ in range(rng.randrange(6))]
        text = " ".join([*words, *([rng.choice(r.also)] if r.also else []), sample(r.pattern, rng), *[rng.choice(fill) for _ in range(4)]])
        docs.append((n, "".join(c.upper() if rng.random() < 0.1 and c.isascii() else "-/\n,"[rng.randrange(4)] if c == " " and rng.random() < 0.3 else c for c in text)))
    docs += [(None, "All rights reserved."), (1, None), (1, ""), (2, " \n -- "), (3, "MIT License"), (3, "MIT License"), (4, "cc by cc by" * 3000)]
    return docs


def test_against_plain_version(spark):
    docs = texts()
    df = spark.createDataFrame([(a, b, "s", "r", "b") for a, b in docs], SCHEMA)
    got = lic.scan_licenses(df).collect()
    want = []
    for doc_id, text in docs:
        words = plain_words(text)
        kept = plain_kept(plain_found(words, lic.RULES)) if len(words) < 100 else None
        want.append((doc_id, len(words), plain_base(words), kept and {(a, b, p, label) for a, b, p, _, label in kept}))
    key = lambda x: (repr(x[0]), x[1], repr(x[2]), repr(sorted(x[3] or ())))
    rows = []
    for r in got:
        kept = {(d["start"], d["stop"], d["priority"], d["label"]) for d in r["found"] or ()} if r["n_words"] < 100 else None
        rows.append((r["doc_id"], r["n_words"], sorted((d["start"], d["label"]) for d in r["base"]), kept or None))
    assert sorted(rows, key=key) == sorted([(a, b, c, d or None) for a, b, c, d in want], key=key)


def test_each_rule_finds_its_text(spark):
    """A text made for a rule has a detection of at least its priority at its place."""
    docs = texts()[: len(lic.RULES)]
    df = spark.createDataFrame([(a, b, "", "", "") for a, b in docs], SCHEMA)
    found = {r["doc_id"]: r["found"] for r in lic.scan_licenses(df).collect()}
    for n, r in enumerate(lic.RULES):
        assert found[n] and min(d["priority"] for d in found[n]) <= r.priority, (r, docs[n])


def test_digest(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "plain words", None, "CC-BY, cc by"]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in lic.digest_columns(lic.scan_licenses(df)).collect()}
    assert (got[0]["base_labels"], got[0]["labels"], got[0]["score"], got[0]["first_word"]) == ("gpl", "gpl,gpl-3.0", 0.9, 7)
    assert (got[1]["n_base"], got[1]["labels"], got[1]["score"]) == (1, "reserved", 0.7)
    assert (got[2]["n_words"], got[2]["labels"], got[2]["score"], got[2]["last_word"]) == (2, "", 0.0, None)
    assert (got[3]["n_words"], got[3]["n_base"]) == (0, 0)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (2, 0, 2)


def test_suppression(spark):
    """Better priorities win where intervals overlap, longer ones among equals."""
    rows = [(1, 0, 5, 3, 7, "long"), (1, 1, 4, 3, 8, "inside"), (1, 4, 9, 2, 9, "better"), (1, 20, 22, 4, 1, "alone"), (1, 20, 22, 4, 2, "equal"), (2, 4, 6, 3, 3, "else")]
    df = spark.createDataFrame(rows, "_row long, start int, stop int, priority int, rule int, label string")
    assert {r["label"] for r in lic.resolve(df).collect()} == {"better", "alone", "else"}
    many = [(9, rng, rng + random.Random(rng).randrange(1, 9), random.Random(-rng).randrange(1, 5), rng % 17, "x") for rng in range(300)]
    df = spark.createDataFrame(many, "_row long, start int, stop int, priority int, rule int, label string")
    assert {tuple(r)[1:] for r in lic.resolve(df).collect()} == plain_kept({m[1:] for m in many})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lic.digest_columns(lic.scan_licenses(df)).count() == 0
