import re

import fixtures
from pyspark.sql import functions as F

from minekit.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    found = []
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_base_columns_equal_brute_force(docs):
    got = licenses.digest_columns(licenses.scan_licenses(docs))
    want = sorted(tuple(map(repr, (r[0], *brute(r[1] or "")))) for r in fixtures.rows())
    assert fixtures.pairs(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = licenses.scan_licenses(df)
    return [r.asDict() for r in licenses.digest_columns(scanned).orderBy("doc_id").collect()], [
        r.licenses for r in scanned.orderBy("doc_id").collect()
    ]


def test_labels_of_notices(spark):
    rows, places = scan(
        spark,
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "the mit licenses and a general public licence",
        "GNU Lesser General Public License v2.1",
    )
    assert [r["labels"] for r in rows] == [
        "apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "bsd-3-clause", "", "gpl,lgpl-2.1",
    ]
    assert [r["score"] for r in rows] == [0.95, 0.95, 0.95, 1.0, 0.0, 0.6]
    assert [(p[0].start, p[0].last) for p in places if p] == [(0, 7), (3, 11), (0, 6), (0, 5), (0, 6)]


def test_contained_and_overlapping_detections(spark):
    _, places = scan(spark, "x " * 5 + "released under the mit license y mit license apache license 2 0")
    assert [(p.start, p.last, p.label) for p in places[0]] == [
        (5, 9, "mit"), (11, 12, "mit"), (13, 16, "apache-2.0"),
    ]


def test_rules_are_many_and_valid():
    rules = licenses.rules()
    assert len(rules) >= 300
    for rule in rules:
        re.compile(rule["pattern"])
        assert rule["keyword"] == rule["keyword"].lower()
    # every name can be found: the keyword of a rule and a gate stand in what it matches
    priorities = [r["priority"] for r in rules]
    assert priorities == sorted(priorities) or len(set(priorities)) > 200


def test_empty_table(no_docs):
    assert licenses.digest_columns(licenses.scan_licenses(no_docs)).collect() == []


def test_every_rule_passes_gate_and_keyword_and_is_detected(spark):
    rules, texts = licenses.rules(), []
    for n, rule in enumerate(rules):
        spelled = licenses.spelled(rule["pattern"].removeprefix("(?<= )").removesuffix("(?= )"))
        for text in spelled:
            assert re.fullmatch(rule["pattern"][6:-5], text), (rule, text)
            assert rule["keyword"] in text, (rule, text)
            assert any(all(part in text for part in parts) for parts in licenses.GATE), (rule, text)
        texts += [(n, min(spelled, key=len)), (n, max(spelled, key=len))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = df.select("doc_id", licenses.detections(licenses.words_of(F.col("text"))).alias("found"))
    for row in found.collect():
        rule = rules[row.doc_id]
        assert (rule["label"], rule["priority"]) in [(x.label, x.priority) for x in row.found], rule
    scanned = licenses.digest_columns(licenses.scan_licenses(df))
    assert scanned.where("score = 0 or labels = ''").collect() == []


def test_identifiers_and_short_names(spark):
    ids = [
        "GPL-1.0", "GPL-2.0-only", "GPL-3.0-or-later", "LGPL-2.1", "AGPL-3.0-only", "GFDL-1.3", "MPL-2.0", "EPL-2.0",
        "EUPL-1.2", "CDDL-1.0", "BSL-1.0", "OFL-1.1", "ODbL-1.0", "MS-PL",
    ]
    rows, _ = scan(spark, *[f"// SPDX-License-Identifier: {x}" for x in ids])
    want = [x.lower().removesuffix("-only").removesuffix("-or-later") for x in ids]
    assert [(r["labels"], r["score"]) for r in rows] == [(x, 1.0) for x in want]
    rows, _ = scan(spark, "licensed under the GNU GPL v3", "Expat License", "mit no attribution")
    assert [(r["labels"], r["score"]) for r in rows] == [("gpl-3.0", 0.95), ("mit", 0.6), ("mit-0", 0.6)]


def test_license_texts_headers_and_addresses(spark):
    rows, _ = scan(
        spark,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
        'documentation files (the "Software"), to deal in the Software without restriction, including ...',
        "Licensed under GPLv3",
        "released under the LGPL v2.1",
        "see https://creativecommons.org/licenses/by-sa/4.0/ for terms",
        "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided ...",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "you may not use this file except in compliance with the License.\n// You may obtain a copy at\n"
        "//     http://www.apache.org/licenses/LICENSE-2.0",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or ...",
        "This is free and unencumbered software released into the public domain.",
        "https://opensource.org/licenses/BSD-3-Clause",
        "https://creativecommons.org/licenses/by-nc-nd/2.5/",
    )
    assert [r["labels"] for r in rows] == [
        "mit", "gpl-3.0", "lgpl-2.1", "cc-by-sa-4.0", "bsd", "bsd-3-clause", "apache-2.0", "zlib", "gpl,gpl-3.0",
        "unlicense", "bsd-3-clause", "cc-by-nc-nd-2.5",
    ]
    assert [r["score"] for r in rows] == [0.9, 0.95, 0.95, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 1.0, 0.9]


def test_the_longer_of_two_texts_with_one_start_suppresses_the_other(spark):
    grant = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    rows, places = scan(
        spark,
        grant + ", provided that the above copyright notice and this permission notice appear in all copies.",
        grant + ".",
    )
    assert [r["labels"] for r in rows] == ["isc", "0bsd"]
    assert [[(p.start, p.last) for p in found] for found in places] == [[(0, 33)], [(0, 19)]]


def test_words_of_licenses_alone_are_no_license(spark):
    rows, _ = scan(
        spark,
        "the redistribution of incomes is permitted in source and binary forms",
        "they hope it will be useful, without warranty or merchantability",
        "a copy of the mpl was distributed to all; nobody is held liable",
    )
    assert [(r["labels"], r["score"]) for r in rows] == [("", 0.0)] * 3
