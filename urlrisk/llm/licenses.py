"""License scan by ordered signature rules.

A rule is a regular expression over the words of a text, with a priority, a label and keywords: words that stand at a given distance from the rule's start.
A text is split into words once; set intersections find which keywords it holds. Only rules whose keyword and whose further required word are in the text go
on, only the places of their keywords are looked at, and each rule is tried there, anchored at its start, on ``REACH`` words. So the cost is a split of
each text plus some work per keyword found.

Detections of a text may overlap. One is dropped if a detection of better priority overlaps it, or if one of equal priority contains it (of equal
intervals the rule listed first stays). The comparison is a running maximum of ends and a running minimum of starts per priority over
detections in order of their place, so it is linear in their number.

Base phrases are counted apart and never dropped; their labels stay beside those of the rules. Only DataFrame functions.

Cases: null and empty texts have no words, no labels and score 0. Repeated rows are kept and judged alike; a null id is kept. An empty table gives an empty result;
other columns are not read. The score is the largest weight among the priorities of what was found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.functions.planning import computed_stage
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that a rule can see from its start.
REACH = 24
#: Weight of a detection by its priority: whole texts and tags, notices, names, hints.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
BASE_WEIGHT = 0.6
#: Fixed values of the contract: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Rule(NamedTuple):
    label: str
    priority: int
    #: words and how far from the rule's start they stand; each is a keyword
    keys: tuple[tuple[str, int], ...]
    #: the text must hold one of these, too, if there are any
    also: tuple[str, ...]
    pattern: str


#: label | identifier | name | keywords (with their distance from the start) | words of which the text must hold one, too
LICENSES = """
mit | mit | mit licen[cs]e | license@1/licence@1 | mit
mit-0 | mit 0 | mit no attribution(?: licen[cs]e)? | attribution@2 | mit
x11 | x11 | x11 licen[cs]e | x11 | license/licence
0bsd | 0bsd | (?:0bsd|bsd zero clause|zero clause bsd)(?: licen[cs]e)? | 0bsd/clause@2/clause@1 | bsd/0bsd
bsd-2-clause | bsd 2 clause | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)? | clause@2/clause@1/simplified/freebsd | bsd/freebsd/simplified
bsd-3-clause | bsd 3 clause | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd)(?: licen[cs]e)? | clause@2/clause@1/new/modified | bsd
bsd-4-clause | bsd 4 clause | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)? | clause@2/clause@1/original | bsd
isc | isc | isc licen[cs]e | isc | license/licence
apache-1.0 | apache 1 0 | apache (?:software )?licen[cs]e (?:v ?|version )?1(?: 0)? | apache |
apache-1.1 | apache 1 1 | apache (?:software )?licen[cs]e (?:v ?|version )?1 1 | apache |
apache-2.0 | apache 2 0 | apache (?:software )?(?:licen[cs]e )?(?:v ?|version )?2(?: 0)?(?: licen[cs]e)? | apache |
gpl-1.0 | gpl 1 0(?: only| or later)? | (?:gnu )?(?:gpl|general public licen[cs]e)(?: gpl)? (?:v ?|version )?1(?: 0)? | gnu/gpl/general |
gpl-2.0 | gpl 2 0(?: only| or later)? | (?:gnu )?(?:gplv2|(?:gpl|general public licen[cs]e)(?: gpl)? (?:v ?|version )?2(?: 0)?) | gnu/gpl/gplv2/general |
gpl-3.0 | gpl 3 0(?: only| or later)? | (?:gnu )?(?:gplv3|(?:gpl|general public licen[cs]e)(?: gpl)? (?:v ?|version )?3(?: 0)?) | gnu/gpl/gplv3/general |
lgpl-2.0 | lgpl 2 0(?: only| or later)? | (?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e) (?:v ?|version )?2(?: 0)? | gnu/lgpl/lesser/library |
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu )?(?:lgpl|lesser general public licen[cs]e) (?:v ?|version )?2 1 | gnu/lgpl/lesser |
lgpl-3.0 | lgpl 3 0(?: only| or later)? | (?:gnu )?(?:lgplv3|(?:lgpl|lesser general public licen[cs]e) (?:v ?|version )?3(?: 0)?) | gnu/lgpl/lgplv3/lesser |
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu )?(?:agplv3|(?:agpl|affero general public licen[cs]e) (?:v ?|version )?3(?: 0)?) | gnu/agpl/agplv3/affero |
gfdl-1.1 | gfdl 1 1(?: only| or later)? | (?:gnu )?free documentation licen[cs]e (?:v ?|version )?1 1 | documentation@1/documentation@2 | license/licence
gfdl-1.2 | gfdl 1 2(?: only| or later)? | (?:gnu )?free documentation licen[cs]e (?:v ?|version )?1 2 | documentation@1/documentation@2 | license/licence
gfdl-1.3 | gfdl 1 3(?: only| or later)? | (?:gnu )?free documentation licen[cs]e (?:v ?|version )?1 3 | documentation@1/documentation@2 | license/licence
mpl-1.0 | mpl 1 0 | mozilla public licen[cs]e (?:v ?|version )?1(?: 0)? | mozilla |
mpl-1.1 | mpl 1 1 | mozilla public licen[cs]e (?:v ?|version )?1 1 | mozilla |
mpl-2.0 | mpl 2 0 | (?:mozilla public licen[cs]e|mpl) (?:v ?|version )?2(?: 0)? | mozilla/mpl |
npl-1.1 | npl 1 1 | netscape public licen[cs]e(?: (?:v ?|version )?1 1)? | netscape | license/licence
epl-1.0 | epl 1 0 | (?:eclipse public licen[cs]e|epl) (?:v ?|version )?1(?: 0)? | eclipse/epl |
epl-2.0 | epl 2 0 | (?:eclipse public licen[cs]e|epl) (?:v ?|version )?2(?: 0)? | eclipse/epl |
eupl-1.1 | eupl 1 1 | (?:european union public licen[cs]e|eupl) (?:v ?|version )?1 1 | european/eupl | eupl/european
eupl-1.2 | eupl 1 2 | (?:european union public licen[cs]e|eupl) (?:v ?|version )?1 2 | european/eupl | eupl/european
cddl-1.0 | cddl 1 0 | (?:common development and distribution licen[cs]e|cddl)(?: cddl)?(?: (?:v ?|version )?1 0)? | cddl/common | cddl/development
cddl-1.1 | cddl 1 1 | (?:common development and distribution licen[cs]e|cddl)(?: cddl)? (?:v ?|version )?1 1 | cddl/common | cddl/development
cpl-1.0 | cpl 1 0 | common public licen[cs]e(?: (?:v ?|version )?1 0)? | license@2/licence@2 | common
cpal-1.0 | cpal 1 0 | common public attribution licen[cs]e(?: (?:v ?|version )?1 0)? | attribution@2 | license/licence
ipl-1.0 | ipl 1 0 | ibm public licen[cs]e(?: (?:v ?|version )?1 0)? | ibm | license/licence
artistic-1.0 | artistic 1 0(?: perl| cl8)? | artistic licen[cs]e (?:v ?|version )?1(?: 0)? | artistic | license/licence
artistic-2.0 | artistic 2 0 | artistic licen[cs]e (?:v ?|version )?2(?: 0)? | artistic | license/licence
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | license/licence
libpng | libpng(?: 2 0)? | libpng licen[cs]e | libpng | license/licence
bsl-1.0 | bsl 1 0 | boost software licen[cs]e(?: (?:v ?|version )?1 0)? | boost | license/licence
busl-1.1 | busl 1 1 | business source licen[cs]e(?: (?:v ?|version )?1 1)? | business | license/licence
sspl-1.0 | sspl 1 0 | (?:server side public licen[cs]e|sspl)(?: (?:v ?|version )?1(?: 0)?)? | server/sspl | sspl/license
elastic-2.0 | elastic 2 0 | elastic licen[cs]e(?: (?:v ?|version )?2(?: 0)?)? | elastic | license/licence
postgresql | postgresql | postgresql licen[cs]e | postgresql | license/licence
psf-2.0 | (?:psf|python) 2 0 | python software foundation licen[cs]e(?: (?:v ?|version )?2(?: 0)?)? | python | license/licence
php-3.01 | php 3 01 | php licen[cs]e(?: (?:v ?|version )?3 01)? | php | license/licence
ruby | ruby | ruby licen[cs]e | ruby | license/licence
ofl-1.1 | ofl 1 1(?: no rfn| rfn)? | (?:sil )?open font licen[cs]e(?: (?:v ?|version )?1 1)? | font@1/font@2 | license/licence
w3c | w3c | w3c software (?:and document )?(?:notice and )?licen[cs]e | w3c | license/licence
wtfpl | wtfpl | wtfpl | wtfpl |
unlicense | unlicense | (?:the )?unlicense | unlicense/unlicense@1 |
cc0-1.0 | cc0 1 0 | (?:cc0|creative commons zero)(?: (?:v ?|version )?1 0)?(?: universal)? | cc0/creative |
cc-by-3.0 | cc by 3 0 | (?:creative commons attribution|cc by) 3 0(?: [a-z]+)? | cc/creative |
cc-by-4.0 | cc by 4 0 | (?:creative commons attribution|cc by) 4 0(?: international)? | cc/creative |
cc-by-sa-3.0 | cc by sa 3 0 | (?:creative commons attribution share ?alike|cc by sa) 3 0 | cc/creative |
cc-by-sa-4.0 | cc by sa 4 0 | (?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)? | cc/creative |
cc-by-nc-3.0 | cc by nc 3 0 | (?:creative commons attribution non ?commercial|cc by nc) 3 0 | cc/creative |
cc-by-nc-4.0 | cc by nc 4 0 | (?:creative commons attribution non ?commercial|cc by nc) 4 0(?: international)? | cc/creative |
cc-by-nd-4.0 | cc by nd 4 0 | (?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 4 0(?: international)? | cc/creative |
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0(?: international)? | cc/creative |
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 4 0(?: international)? | cc/creative |
lppl-1.3c | lppl 1 3(?:a|c) | latex project public licen[cs]e(?: (?:v ?|version )?1 3(?:a|c)?)? | latex | license/licence
ms-pl | ms pl | microsoft public licen[cs]e(?: ms pl)? | microsoft | license/licence
ms-rl | ms rl | microsoft reciprocal licen[cs]e(?: ms rl)? | microsoft | license/licence
ncsa | ncsa | (?:university of illinois|uiuc) ncsa open source licen[cs]e | university/uiuc | ncsa
openssl | openssl | openssl licen[cs]e | openssl | license/licence
osl-3.0 | osl 3 0 | open software licen[cs]e(?: (?:v ?|version )?3(?: 0)?)? | license@2/licence@2 | software
afl-3.0 | afl 3 0 | academic free licen[cs]e(?: (?:v ?|version )?3(?: 0)?)? | academic | license/licence
qpl-1.0 | qpl 1 0 | q public licen[cs]e(?: (?:v ?|version )?1 0)? | license@2/licence@2 | q
sleepycat | sleepycat | sleepycat(?: public)? licen[cs]e | sleepycat | license/licence
vim | vim | vim licen[cs]e | vim | license/licence
curl | curl | curl licen[cs]e | curl | license/licence
beerware | beerware | (?:the )?beer ?ware licen[cs]e | beerware/beer/beerware@1/beer@1 | license/licence
json | json | json licen[cs]e | json | license/licence
odbl-1.0 | odbl 1 0 | (?:open data commons )?open database licen[cs]e(?: odbl)?(?: (?:v ?|version )?1 0)? | database@1/database@4 | license/licence
odc-by-1.0 | odc by 1 0 | open data commons attribution licen[cs]e(?: (?:v ?|version )?1 0)? | commons@2 | license/licence
pddl-1.0 | pddl 1 0 | (?:open data commons )?public domain dedication and licen[cs]e(?: pddl)? | dedication@2/dedication@5 | license/licence
cecill-2.1 | cecill 2 1 | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: (?:v ?|version )?2 1)? | cecill |
cern-ohl-2.0 | cern ohl (?:p|s|w) 2 0 | cern open hardware licen[cs]e(?: (?:v ?|version )?2(?: 0)?)? | cern | license/licence
apsl-2.0 | apsl 2 0 | apple public source licen[cs]e(?: (?:v ?|version )?2(?: 0)?)? | apple | license/licence
rpl-1.5 | rpl 1 5 | reciprocal public licen[cs]e(?: (?:v ?|version )?1 5)? | reciprocal | license/licence
upl-1.0 | upl 1 0 | universal permissive licen[cs]e(?: upl)?(?: (?:v ?|version )?1 0)? | universal | license/licence
"""

#: label | priority | keywords | words of which the text must hold one, too | pattern
SIGNATURES = """
mit | 1 | granted@3 | charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 1 | copyright@1 | permission | above copyright notice and this permission notice shall be included in all copies or substantial portions
x11 | 2 | except | consortium | except as contained in this notice the name of the x consortium
bsd-2-clause | 1 | redistribution | binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
bsd-2-clause | 1 | redistributions | binary | redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
bsd-3-clause | 1 | neither | endorse | neither the names? of (?:the )?[^ ]+(?: [^ ]+){0,6} nor the names of (?:its|their|the) contributors may be used to endorse
bsd-4-clause | 1 | advertising@1 | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | 1 | permission | distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 2 | permission | distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
apache-2.0 | 1 | licensed | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 2 | apache | org | apache org licenses license 2 0
apache-2.0 | 2 | licensed | asf | licensed to the apache software foundation asf under one or more contributor license agreements
gpl-2.0 | 1 | software@4 | version | this program is free software you can redistribute it and or modify it under the terms of the gnu general
gpl-2.0 | 1 | either | version | either version 2 of the license or at your option any later version
gpl-3.0 | 1 | either | version | either version 3 of the license or at your option any later version
lgpl-2.1 | 1 | either | version | either version 2 1 of the license or at your option any later version
gpl | 2 | distributed | warranty | distributed in the hope that it will be useful but without any warranty
gpl | 3 | gnu | license | gnu general public licen[cs]e
gpl | 3 | gpl | | gpl
gpl | 4 | copyleft | | copyleft
lgpl | 3 | gnu | lesser | gnu (?:lesser|library) general public licen[cs]e
lgpl | 3 | lgpl | | lgpl
agpl | 3 | gnu | affero | gnu affero general public licen[cs]e
agpl | 3 | agpl | | agpl
mpl-2.0 | 1 | form@3 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | 3 | mozilla | license | mozilla public licen[cs]e
epl | 3 | eclipse | license | eclipse public licen[cs]e
eupl | 3 | eupl | | eupl
apache | 3 | apache | license | apache (?:software )?licen[cs]e
bsd | 3 | bsd | | bsd (?:style )?licen[cs]e
artistic | 3 | artistic | license | artistic licen[cs]e
perl | 2 | terms@3 | perl | under the same terms as perl(?: itself)?
boost | 1 | granted@3 | boost | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | 1 | provided@3 | implied | this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense | 1 | unencumbered@1 | domain | and unencumbered software released into the public domain
unlicense | 1 | unencumbered | domain | unencumbered software released into the public domain
wtfpl | 1 | do | fuck | do what the fuck you want to(?: public licen[cs]e)?
beerware | 1 | buy | beer | buy me a beer in return
vim | 2 | charityware | | charityware
json | 1 | good@6 | evil | the software shall be used for good not evil
ofl-1.1 | 1 | font@1 | sil | this font software is licensed under the sil open font licen[cs]e version 1 1
w3c | 2 | w3c | license | w3c(?: r)? (?:software|document) (?:and document )?(?:notice and )?licen[cs]e
cc | 3 | creative | commons | creative commons(?: licen[cs]e| attribution)?
cc-by | 3 | cc | by | cc by
cc-by-sa | 3 | cc | sa | cc by sa
cc-by-nc | 3 | cc | nc | cc by nc
cc-by-nd | 3 | cc | nd | cc by nd
cc-by-nc-sa | 3 | cc | sa | cc by nc sa
cc-by-nc-nd | 3 | cc | nd | cc by nc nd
cc-by | 2 | creativecommons | by | creativecommons org licenses by [0-9] [0-9]
cc-by-sa | 2 | creativecommons | sa | creativecommons org licenses by sa [0-9] [0-9]
cc-by-nc | 2 | creativecommons | nc | creativecommons org licenses by nc [0-9] [0-9]
cc0-1.0 | 2 | creativecommons | zero | creativecommons org publicdomain zero 1 0
cc-pdm | 2 | creativecommons | mark | creativecommons org publicdomain mark 1 0
public-domain | 2 | domain@3/domain@2 | public | (?:in|into|to) (?:the )?public domain
public-domain | 4 | domain@1 | public | public domain
reserved | 3 | reserved@2 | rights | all rights reserved
some-rights | 3 | reserved@2 | rights | some rights reserved
no-rights | 3 | reserved@2 | rights | no rights reserved
copyright | 4 | copyright | | copyright (?:c |© |by )?(?:19|20)[0-9][0-9]
copyright | 4 | copyrighted | | copyrighted (?:material|work|software|content)
proprietary | 2 | proprietary | confidential | proprietary and confidential
proprietary | 2 | proprietary@2 | confidential | confidential and proprietary
proprietary | 3 | proprietary | | proprietary (?:licen[cs]e|software|information)
proprietary | 2 | unauthorized/unauthorised | | unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this (?:file|work|software|document) )?(?:via any medium )?is strictly prohibited
proprietary | 2 | reproduced@3 | permission | may not be reproduced (?:in any form |or distributed )?without (?:prior |written |express )*permission
non-commercial | 2 | commercial@1 | use | non commercial use only
non-commercial | 2 | noncommercial | use | noncommercial use only
commercial | 3 | commercial | license | commercial licen[cs]e
eula | 2 | license@2/licence@2 | end | end user licen[cs]e agreement
eula | 3 | eula | | eula
fair-use | 4 | use@1 | fair | fair use
dual | 4 | dual | licensed | dual licensed
patent | 3 | license@1/licence@1 | patent | patent licen[cs]e
open-source | 4 | opensource | license | opensource org licenses [^ ]+
"""


def rule_list() -> list[Rule]:
    """All rules in their order. Each license gives a tag, a notice and a name; then come the signatures of texts and phrases."""

    def fields(table: str) -> list[list[str]]:
        return [[f.strip() for f in re.split(r"\s\|(?=\s|$)", line)] for line in table.strip().split("\n")]

    def keys(names: str) -> tuple[tuple[str, int], ...]:
        return tuple((k.split("@")[0], int((k.split("@") + ["0"])[1])) for k in names.split("/"))

    def words(names: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(k.split("@")[0] for k in names.split("/") if k))

    rules = []
    for label, ident, name, names, *also in fields(LICENSES):
        own = words(names) if set(words(names)) - {"license", "licence"} else words(*also)
        rules.append(Rule(label, 1, (("spdx", 0),), own, f"spdx license identifier {ident}"))
        rules.append(Rule(label, 2, (("under", 0),), own, f"under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:{name}|{ident})(?: licen[cs]e)?"))
        rules.append(Rule(label, 3, keys(names), words(*also), name))
    for label, priority, names, also, pattern in fields(SIGNATURES):
        rules.append(Rule(label, int(priority), keys(names), words(also), pattern))
    return rules


RULES = rule_list()


def _literal(rules: Sequence[Rule]) -> Column:
    """The rules as one constant: an array with an entry for each keyword of each rule. Base phrases come first, with priority 0."""
    text = lambda t: "'" + t.replace("'", "''") + "'"
    entries = [
        f"named_struct('rule', {nr}, 'label', {text(r.label)}, 'priority', {r.priority}, 'word', {text(w)}, 'back', {back}, "
        f"'also', cast(array({', '.join(map(text, r.also))}) as array<string>), 'pattern', {text(f'^({r.pattern}) ')})"
        for nr, r in enumerate(rules)
        for w, back in r.keys
    ]
    return F.expr(f"array({', '.join(entries)})")


def base_rules(phrases: Sequence[tuple[str, str]]) -> list[Rule]:
    """Phrases of plain words as rules of priority 0; the longest word of each is its keyword."""
    out = []
    for phrase, label in phrases:
        words = phrase.split(" ")
        at = max(range(len(words)), key=lambda i: len(words[i]))
        out.append(Rule(label, 0, ((words[at], at),), tuple(w for i, w in enumerate(words) if i != at)[:1], phrase))
    return out


def detections(words: Column, rules: Sequence[Rule]) -> dict[str, Column]:
    """Stages (name -> expression, each over the ones before) that end in ``_found``: (start, stop, priority, rule, label) of all matches."""
    anchors = sorted({a for r in rules for a in (r.also or [w for w, _ in r.keys])})
    named = sorted({w for r in rules for w, _ in r.keys} | set(anchors))
    strings = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    present = F.when(F.arrays_overlap(words, strings(anchors)), F.array_intersect(words, strings(named))).otherwise(none)
    known = F.col("_present")
    fits = lambda r: F.array_contains(known, r["word"]) & ((F.size(r["also"]) == 0) | F.arrays_overlap(r["also"], known))
    rows = _literal(rules)
    usable = F.when(F.size(known) > 0, F.filter(rows, fits)).otherwise(F.slice(rows, 1, 0))
    open_rules = F.col("_usable")
    keys = F.array_distinct(F.transform(open_rules, lambda r: r["word"]))
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    places = F.when(F.size(open_rules) > 0, F.filter(numbered, lambda x: F.array_contains(F.col("_keys"), x["w"])))

    def tried(x: Column) -> Column:
        near = F.filter(open_rules, lambda r: (r["word"] == x["w"]) & (x["i"] >= r["back"]))
        view = lambda r: F.concat(F.array_join(F.slice(words, x["i"] - r["back"] + 1, REACH), " "), F.lit(" "))
        seen = F.transform(near, lambda r: F.struct((x["i"] - r["back"]).alias("start"), F.call_function("regexp_extract", view(r), r["pattern"], F.lit(1)).alias("m"), r.alias("r")))
        hits = F.filter(seen, lambda h: h["m"] != "")
        return F.transform(
            hits,
            lambda h: F.struct(
                h["start"].alias("start"),
                (h["start"] + F.size(F.split(h["m"], " "))).alias("stop"),
                h["r"]["priority"].alias("priority"),
                h["r"]["rule"].alias("rule"),
                h["r"]["label"].alias("label"),
            ),
        )

    found = F.array_distinct(F.flatten(F.transform(F.col("_places"), tried)))
    return {"_present": present, "_usable": usable, "_keys": keys, "_places": places, "_found": found}


def resolve(found: DataFrame) -> DataFrame:
    """The detections (_row, start, stop, priority, rule, label) that no other one of the same row suppresses."""
    forward = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_row").orderBy("start", F.desc("stop"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda q, c: F.when(F.col("priority") == q, F.col(c))
    gone = F.lit(False)
    for q in WEIGHTS:
        better = F.lit(q) < F.col("priority")
        left = F.max(of(q, "stop")).over(forward) > F.col("start")
        right = F.min(of(q, "start")).over(backward) < F.col("stop")
        holds = F.max(of(q, "stop")).over(before) >= F.col("stop")
        gone = gone | F.coalesce(better & (left | right), F.lit(False)) | F.coalesce((F.col("priority") == q) & holds, F.lit(False))
    return found.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone")


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = tuple(RULES), base: Sequence[tuple[str, str]] = BASE
) -> DataFrame:
    """(doc_id, n_words, base, found) of every row: places of base phrases, and the detections of the rules that remain.

    Spans count words from 0, ``stop`` is exclusive.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = F.regexp_extract_all(F.translate("_t", UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    df = computed_stage(named, ["doc_id"], {"_words": words})
    for name, expression in detections(F.col("_words"), [*base_rules(base), *rules]).items():
        df = computed_stage(df, df.columns, {name: expression})
    read = cut_lineage(df.select("doc_id", F.size("_words").cast("long").alias("n_words"), "_found"))
    marked = read.withColumn("_row", F.monotonically_increasing_id())
    matched = marked.select("_row", F.explode(F.filter("_found", lambda d: d["priority"] > 0)).alias("d")).select("_row", "d.*")
    kept = resolve(matched).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "priority", "rule", "label"))).alias("found"))
    kept = cut_lineage(kept)  # of one text each
    none = F.array().cast("array<struct<start int, stop int, priority int, rule int, label string>>")
    places = F.coalesce(F.filter("_found", lambda d: d["priority"] == 0), none)
    joined = marked.join(bounded_broadcast(kept), "_row", "left")
    return joined.select("doc_id", "n_words", places.alias("base"), F.coalesce("found", none).alias("found"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels and score."""
    base, found = (F.transform(c, lambda d: d["label"]) for c in ("base", "found"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    best = F.array_min(F.transform("found", lambda d: d["priority"]))
    weight = F.lit(0.0)
    for priority, value in WEIGHTS.items():
        weight = F.when(best == priority, value).otherwise(weight)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, found)).alias("labels"),
        F.greatest(weight, F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"),
    )
