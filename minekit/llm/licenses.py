"""License scan by ordered signature rules; DataFrame functions only.

A text becomes its lower-case words joined by single blanks, so the rules need not care about
case, punctuation or line ends. A rule is a regular expression with a keyword and a priority. Only
texts with one of a few gate words are looked at, and of the rules only those whose keyword is in
the text are run; all that a rule matches holds its keyword and passes the gate. Rules know the names and
identifiers of licenses in the forms of notices, sentences of license texts and headers, and addresses.
Detections are resolved in the order of their places: one inside another is suppressed, of two that merely
overlap the one of better priority stays.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import let, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases of the base and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Parts of words; every rule and base phrase needs all parts of one line.
GATE = (("licen",), ("spdx",), ("all", "rights", "reserved"), ("public", "domain"), ("creative",))
GATE += (("cc", "by"), ("cc0",), ("gpl",), ("bsd",), ("gnu",), ("mit", "attribution"))
GATE += (("hereby", "granted"), ("redistribution",), ("endorse", "promote"), ("advertising", "acknowledg"))
GATE += (("held", "liable"), ("altered", "misrepresented"), ("unencumbered",), ("hope", "useful", "warranty"))
GATE += (("copy", "mpl", "distributed"), ("disclaims", "warranties"), ("without", "merchantability"))
GATE += (("permission", "portions"), ("mozilla",))

# Label, keyword, identifier as words, names as regular expressions over words. The keyword
# serves the names that hold it, all else gets its own. A name under "?" may miss the version that the label has; those without one are generic and come last.
FAMILIES = """
mit | mit | mit | mit license; expat license; mit expat license; x11 license
mit-0 | mit 0 | mit 0 | mit no attribution(?: license)?; mit 0 license
apache-1.1 | apache | apache 1 1 | apache (?:software )?license (?:version |v ?)?1 1
apache-2.0 | apache | apache 2 0 | apache (?:software )?license (?:version |v ?)?2(?: 0)?; apache 2 0 license
apache | apache | apache | apache (?:software )?license
gpl-1.0 | gpl-1 | gpl 1 0(?: only| or later)? | gnu general public license (?:version |v ?)?1(?: 0)?; gplv1; gpl (?:version |v ?)1(?: 0)?
gpl-2.0 | public license | gpl 2 0(?: only| or later)? | gnu general public license (?:version |v ?)?2(?: 0)?(?: or later)?; gnu gpl (?:version |v ?)?2; gplv2; gpl (?:version |v ?)2(?: 0)?
gpl-3.0 | public license | gpl 3 0(?: only| or later)? | gnu general public license (?:version |v ?)?3(?: 0)?(?: or later)?; gnu gpl (?:version |v ?)?3; gplv3; gpl (?:version |v ?)3(?: 0)?
gpl | public license | gpl | (?:gnu )?general public license; gnu gpl
lgpl-2.1 | lesser | lgpl 2 1(?: only| or later)? | gnu lesser general public license (?:version |v ?)?2 1; (?:gnu )?lgpl (?:version |v ?)?2 1; lgplv2 1
lgpl-3.0 | lesser | lgpl 3 0(?: only| or later)? | gnu lesser general public license (?:version |v ?)?3(?: 0)?; (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?; lgplv3
lgpl-2.0 | library general | lgpl 2 0(?: only| or later)? | gnu library general public license (?:version |v ?)?2(?: 0)?
lgpl | general public | lgpl | (?:gnu )?(?:lesser|library) general public license
agpl-3.0 | affero | agpl 3 0(?: only| or later)? | gnu affero general public license (?:version |v ?)?3(?: 0)?; (?:gnu )?agpl (?:version |v ?)?3(?: 0)?; agplv3
agpl | affero | agpl | (?:gnu )?affero general public license
gfdl-1.3 | documentation | gfdl 1 3(?: only| or later)? | gnu free documentation license (?:version |v ?)?1 3
gfdl | documentation | gfdl | (?:gnu )?free documentation license
bsd-2-clause | bsd | bsd 2 clause | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3-clause | bsd | bsd 3 clause | (?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: license)?
bsd-4-clause | bsd | bsd 4 clause | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd | bsd | bsd | bsd (?:style )?license
0bsd | bsd | 0bsd | (?:zero clause bsd|bsd zero clause)(?: license)?; 0bsd license
isc | isc | isc | isc license
zlib | zlib | zlib | zlib(?: libpng)? license
mpl-1.1 | mozilla | mpl 1 1 | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla | mpl 2 0 | mozilla public license (?:version |v ?)?2(?: 0)?
mpl | mozilla | mpl | mozilla public license
epl-1.0 | eclipse | epl 1 0 | eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | eclipse | epl 2 0 | eclipse public license (?:version |v ?)?2(?: 0)?
epl | eclipse | epl | eclipse public license
eupl-1.2 | european union | eupl 1 2 | european union public licen[cs]e (?:version |v ?)?1 2
eupl | european union | eupl | european union public licen[cs]e
cddl-1.0 | common development | cddl 1 0 | common development and distribution license (?:version |v ?)?1(?: 0)?
cddl | common development | cddl | common development and distribution license
bsl-1.0 | boost | bsl 1 0 | boost software license(?: (?:version |v ?)?1(?: 0)?)?
artistic-1.0 | artistic | artistic 1 0 | artistic license (?:version |v ?)?1(?: 0)?
artistic-2.0 | artistic | artistic 2 0 | artistic license (?:version |v ?)?2(?: 0)?
artistic | artistic | artistic | artistic license
unlicense | unlicense | unlicense | the unlicense; unlicense
wtfpl | public license | wtfpl | do what the fuck you want to public license
cc0-1.0 | cc0 | cc0 1 0 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-4.0 | nc | cc by nc 4 0 | cc by nc 4 0; creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nd-4.0 | nd | cc by nd 4 0 | cc by nd 4 0; creative commons attribution no ?derivatives 4 0(?: international)?
cc-by-sa-4.0 | sa | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-4.0 | share | cc by sa 4 0 | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | cc by sa | cc by sa 3 0 | cc by sa 3 0
cc-by-4.0 | cc by | cc by 4 0 | cc by 4 0
cc-by-4.0 | creative commons | cc by 4 0 | creative commons attribution 4 0(?: international)?
cc-by-3.0 | cc by | cc by 3 0 | cc by 3 0
cc | creative commons | cc | creative commons(?: attribution)?(?: license)?
ofl-1.1 | open font | ofl 1 1 | (?:sil )?open font license(?: (?:version |v ?)?1 1)?
odbl-1.0 | open database | odbl 1 0 | open database license(?: (?:version |v ?)?1(?: 0)?)?
python-2.0 | python | python 2 0 | python (?:software foundation )?license(?: version 2)?
php-3.01 | php | php 3 01 | php license(?: (?:version |v ?)?3 01)?
openssl | openssl | openssl | openssl license
postgresql | postgresql | postgresql | postgresql license
ms-pl | microsoft | ms pl | microsoft public license
ms-rl | microsoft | ms rl | microsoft reciprocal license
cecill-2.1 | cecill | cecill 2 1 | cecill(?: free software)? license(?: agreement)?
proprietary | rights | proprietary | all rights reserved
public-domain | public domain | public domain | (?:released into|placed in|dedicated to) the public domain; public domain dedication
"""
# Label, keyword and a sentence of the license's text, of its usual header, or its address.
BODIES = """
mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement
bsl-1.0 | hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
isc | hereby granted | permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | hereby granted | permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | disclaims all | the software is provided as is and the author disclaims all warranties with regard to this software
bsd | redistribution and | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse or | nor the names? of (?:its|the|his|her|their|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib | held liable | this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software
zlib | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
apache-2.0 | compliance | you may not use this file except in compliance with the license
apache-2.0 | applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | apache org | apache org licenses license 2 0
gpl-2.0 | version 2 | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | version 3 | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
lgpl-2.1 | version 2 1 | under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-3.0 | version 3 | under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
lgpl-2.0 | version 2 | under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2
agpl-3.0 | version 3 | under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
gpl | along with | you should have received a copy of the gnu general public license along with this
lgpl | along with | you should have received a copy of the gnu (?:lesser|library) general public license along with this
agpl | along with | you should have received a copy of the gnu affero general public license along with this
gpl | will be useful | this program is distributed in the hope that it will be useful but without any warranty
lgpl | will be useful | this library is distributed in the hope that it will be useful but without any warranty
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
wtfpl | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
gpl | gnu org | gnu org licenses gpl
gpl-2.0 | gnu org | gnu org licenses old licenses gpl 2 0
gpl-3.0 | gnu org | gnu org licenses gpl 3 0
lgpl | gnu org | gnu org licenses lgpl
lgpl-2.1 | gnu org | gnu org licenses old licenses lgpl 2 1
lgpl-3.0 | gnu org | gnu org licenses lgpl 3 0
agpl | gnu org | gnu org licenses agpl
agpl-3.0 | gnu org | gnu org licenses agpl 3 0
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | the mpl was | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | contents of | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mozilla org | mozilla org mpl 2 0
epl-1.0 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0
epl-2.0 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license v ?2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
"""
BODY_PRIORITY, BODY_STRENGTH = 1500, 0.9
# The Creative Commons licenses and their versions, as in their addresses.
CC_KINDS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# How a name or an identifier is put into a notice, with priority and strength.
FORMS = (
    (0, 1.0, r"spdx license identifier {identifier}"),
    (1, 1.0, r"(?:opensource|spdx) org licenses {identifier}"),
    (2, 0.95, r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}"),
    (3, 0.85, r"(?:under (?:the )?terms of|subject to|governed by) (?:the )?{name}"),
    (4, 0.8, r"licen[cs]e (?:type )?{identifier}(?! licen)"),
    (5, 0.6, r"{name}"),
)


def spelled(pattern: str) -> list[str]:
    """All texts that a name, an identifier or a form of FORMS matches, lookarounds left out.

    They are few: such a pattern has groups of alternatives, sets of letters and question marks only.
    """

    def choices(at: int) -> tuple[list[str], int]:
        out, parts = [], [[""]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out += map("".join, product(*parts))
                parts, at = [[""]], at + 1
                continue
            if pattern.startswith("(?!", at):
                at = pattern.index(")", at) + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = choices(at + 3)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part, at = list(pattern[at + 1 : end]), end
            else:
                part = [pattern[at]]
            at += 1
            if pattern[at : at + 1] == "?":
                part, at = ["", *part], at + 1
            parts.append(part)
        return out + list(map("".join, product(*parts))), at

    return list(dict.fromkeys(choices(0)[0]))


def keyword_of(pattern: str, wanted: str) -> str:
    """``wanted`` if all that ``pattern`` matches holds it, else the longest text that all of it holds."""
    texts = spelled(pattern)
    if all(wanted in text for text in texts):
        return wanted
    first = min(texts, key=len)
    parts = [first[i:j] for i in range(len(first)) for j in range(i + 1, len(first) + 1)]
    return max((part for part in parts if all(part in text for text in texts)), key=len)


def bodies() -> list[tuple[str, str, str]]:
    """Label, keyword and pattern of every sentence and address."""
    rows = [tuple(x.strip() for x in line.split(" | ")) for line in BODIES.strip().splitlines()]
    for kind, version in product(CC_KINDS, CC_VERSIONS):
        label = f"cc {kind} ".replace(" ", "-") + version.replace(" ", ".")
        rows.append((label, "creativecommons", f"creativecommons org licenses {kind} {version}"))
    return rows


def rules() -> list[dict]:
    """Every family in every form, and the bodies: the regular expressions with their priorities."""
    families = [tuple(x.strip() for x in line.split(" | ")) for line in FAMILIES.strip().splitlines()]
    out = []
    for form, strength, pattern in FORMS:
        for rank, (label, keyword, identifier, names) in enumerate(families):
            generic = 100 * (not any(c.isdigit() for c in label))
            for name in names.split(";"):
                body = pattern.format(identifier=identifier, name=f"(?:{name.strip()})")
                rule = {"label": label, "priority": 1000 * form + generic + rank, "strength": strength}
                if "{name}" in pattern or rule not in [{k: r[k] for k in rule} for r in out]:
                    own = keyword_of(name.strip() if "{name}" in pattern else identifier, keyword)
                    out.append({**rule, "keyword": own, "pattern": f"(?<= ){body}(?= )"})
    for rank, (label, keyword, body) in enumerate(bodies()):
        rule = {"label": label, "priority": BODY_PRIORITY + rank, "strength": BODY_STRENGTH}
        out.append({**rule, "keyword": keyword_of(body, keyword), "pattern": f"(?<= ){body}(?= )"})
    return out


_RULES = "array<struct<label:string,keyword:string,priority:int,strength:double,pattern:string>>"
_PLACES = "array<struct<start:int,last:int,priority:int,label:string,strength:double>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def base_places(words: Column) -> Column:
    """Starts of the base phrases as an array of (start, label), in the order of the text."""

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()

        def stands(i: Column) -> Column:
            out = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], start=1):
                out = out & (F.get(words, i + k) == part)
            return F.coalesce(out, F.lit(False))

        # cheap test on the last word of the phrase first
        hits = F.filter(
            F.transform(words, lambda w, i: F.when(w == parts[-1], i - (len(parts) - 1))),
            lambda i: i.isNotNull() & (i >= 0),
        )
        return F.transform(
            F.filter(hits, stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))
        )

    return F.array_sort(F.concat(*[starts(*b) for b in BASE]))


def detections(words: Column) -> Column:
    """All matches of the rules whose keyword is in the text, places in words, in their order."""
    table = F.from_json(F.lit(json.dumps(rules())), _RULES)

    def of_rule(normal: Column, rule: Column) -> Column:
        steps = F.zip_with(
            F.split(normal, rule["pattern"], -1),
            F.regexp_extract_all(normal, rule["pattern"], F.lit(0)),
            lambda gap, match: F.struct(_blanks(gap).alias("gap"), match.alias("match")),
        )

        def place(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + _blanks(x["match"])
            found = F.struct(
                (start - 1).alias("start"),
                (end - 1).alias("last"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
                rule["strength"].alias("strength"),
            )
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

        return F.aggregate(
            F.filter(steps, lambda x: x["match"].isNotNull()),
            F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out")),
            place,
            lambda acc: acc["out"],
        )

    def run(normal: Column) -> Column:
        wanted = F.filter(table, lambda r: F.contains(normal, r["keyword"]) & F.rlike(normal, r["pattern"]))
        return F.flatten(F.transform(wanted, lambda r: of_rule(normal, r)))

    order = lambda a, b: F.when(  # noqa: E731  by start, then the longer, then the better priority
        a["start"] != b["start"], F.signum(a["start"] - b["start"])
    ).when(a["last"] != b["last"], F.signum(b["last"] - a["last"])).otherwise(
        F.signum(a["priority"] - b["priority"])
    ).cast("int")
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.array_sort(let(spaced, run), order)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def resolved(found: Column) -> Column:
    """``detections`` without the suppressed ones.

    In the order of starts a detection lies inside an earlier one exactly if it ends no later than
    the last one kept, because only what reaches further than all before it is kept.
    """

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        better = x["priority"] < last["priority"]
        return (
            F.when(F.size(acc) == 0, F.array(x))
            .when(x["last"] <= last["last"], acc)
            .when(x["start"] > last["last"], F.concat(acc, F.array(x)))
            .when(better, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x)))
            .otherwise(acc)
        )

    return F.aggregate(found, F.array().cast(_PLACES), step)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, base, licenses)`` of every row, in place and without a shuffle.

    ``base`` holds (start, label) of the base phrases, ``licenses`` the kept detections as
    (start, last, priority, label, strength), places in words from 0. A missing text counts as
    empty: no words, empty arrays. Rows without an id, repeated rows and ties stay as they are;
    other columns are not looked at.
    """
    text = text_of(text_col)
    low = F.lower(text)
    gate = F.lit(False)
    for parts in GATE:
        held = F.lit(True)
        for part in parts:
            held = held & F.contains(low, F.lit(part))
        gate = gate | held
    rows = df.select(F.col(id_col).alias("doc_id"), words_of(text).alias("words"), gate.alias("gate"))
    none = F.array()
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("gate"), base_places(F.col("words")))
        .otherwise(none.cast("array<struct<start:int,label:string>>"))
        .alias("base"),
        F.when(F.col("gate"), resolved(detections(F.col("words")))).otherwise(none.cast(_PLACES)).alias("licenses"),
    )


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The query's columns from ``scan_licenses``; the score is the strongest form found."""
    base, own = F.col("base"), F.col("licenses")
    labels = lambda a: F.transform(a, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform(base, lambda x: x["start"])
    strongest = F.array_max(F.transform(own, lambda x: x["strength"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(labels(base)).alias("base_labels"),
        joined(F.concat(labels(base), labels(own))).alias("labels"),
        F.coalesce(strongest, F.when(F.size(base) > 0, 0.5), F.lit(0.0)).alias("score"),
    )
