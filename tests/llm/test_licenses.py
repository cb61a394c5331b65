import doctest
import random
import re
import time
from re import _constants, _parser

import pytest

from chainloom.llm import licenses

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RULES = licenses.signature_rules()


def words_of(text):
    return re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id bigint, text string, words string, kept int, labels string")


def detect_by_hand(words, rules):
    joined, taken, kept = " " + " ".join(words) + " ", set(), []
    for r in sorted(rules, key=lambda r: r.priority):
        if not set(r.keywords) & set(words):
            continue
        for m in re.finditer(r.pattern, joined):
            a = joined[: m.start()].count(" ") - 1
            span = range(a, a + m.group().count(" ") + 1)
            if not taken & set(span):
                kept.append((a, span.stop, r.priority, r.label))
                taken |= set(span)
    return sorted(kept)


def test_doctests():
    assert doctest.testmod(licenses).failed == 0


def test_base_against_python(spark):
    texts = [None, "", "MIT License", "mit\n\nLICENSE!", "the mit license mit license", "General Public licenSe, Apache License 2.0", "mitlicense", "É mit license", "licence", "license " * 3000, " \x00 "]
    for r in licenses.license_scan(docs_of(spark, texts)).collect():
        words = words_of(texts[r.doc_id])
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


#: A written sample: texts and the labels a reader would give them; "general public license" is a base phrase wherever it stands.
SAMPLE = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("This tool is released under GPLv3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.\nfoo", "cc-by-nc"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
    ("subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the FSF", "gpl,lgpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "agpl,gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications", "zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("You can redistribute it and/or modify it under the same terms as Perl itself", "artistic"),
    ("Content on this wiki is available under the Creative Commons Attribution-ShareAlike License 4.0", "cc-by-sa"),
    ("published under CC0 1.0 Universal", "cc0"),
    ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl"),
    ("made available under the Open Database License", "odbl"),
    ("Licensed under the EUPL, Version 1.2 or later", "eupl"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"),
    ("Business Source License 1.1", "bsl"),
    ("PROPRIETARY AND CONFIDENTIAL. Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"),
    ("dual licensed: MIT license or Apache-2.0 licensed", "apache,mit"),
    ("the 3-Clause BSD License", "bsd"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("Copyright the authors, use as you like under the WTFPL license", "wtfpl"),
    ("my driver license. A commercial license applies to pilots", ""),
    ("the marriage license was issued under the old law", ""),
    ("he was released under the condition that he pays", ""),
    ("poetic license is distributed under many names", ""),
    ("students at MIT study hard", ""),
    ("the apache helicopter needs a license to fly", ""),
    ("the boost in sales was general and public", ""),
    ("creative people and the commons of the village", ""),
    ("redistribution of wealth in binary choices", ""),
    ("the eclipse was visible to the public", ""),
    ("python and ruby are gems and snakes", ""),
    ("cc by email the general manager", ""),
    ("permission was granted to enter, free of charge", ""),
    ("the study was released under MIT supervision", ""),
    ("courses offered under the Boost program", ""),
    ("the package is available under Python", ""),
    ("the module is available under Python 3.8 only", ""),
    ("aid distributed under the ISC charter", ""),
    ("games covered under EPL rules this season", ""),
    ("files provided under zlib compression", ""),
    ("maps published under artistic direction", ""),
    ("flights offered under Apache command", ""),
    ("Code released under MIT. See the file for more.", "mit"),
    ("It is distributed under the MIT and Apache licenses", "apache,mit"),
    ("released under Apache 2.0", "apache"),
    ("Licensed under MIT, contributions welcome", "mit"),
    ("available under the ISC license", "isc"),
    ("distributed under the Python Software Foundation License Version 2", "python"),
    ("made available under MPL 2.0", "mpl"),
]


def test_precision_and_recall_on_a_written_sample(spark):
    right = wrong = missed = 0
    for r in licenses.license_scan(docs_of(spark, [t for t, _ in SAMPLE])).collect():
        want, got = ({x for x in labels.split(",") if x} for labels in (SAMPLE[r.doc_id][1], r.labels))
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
        assert (r.score > 0) == bool(got)
    assert right / (right + wrong) == 1.0 and right / (right + missed) == 1.0, (right, wrong, missed)


def test_rules_against_python(spark):
    texts = [t for t, _ in SAMPLE] + [" ".join(t for t, _ in SAMPLE), "mit license " * 40 + "licensed under the mit license " * 10, "\n".join(reversed([t for t, _ in SAMPLE]))]
    for r in licenses.license_scan(docs_of(spark, texts)).collect():
        assert [(d.start, d.end, d.rule, d.label) for d in r.detections] == detect_by_hand(words_of(texts[r.doc_id]), RULES), texts[r.doc_id]


def test_priority_before_containment(spark):
    """The long match loses its last words to a better one, so the short match inside it, which the better one leaves alone, stays."""
    rule = lambda k, label, pattern: licenses.Rule(k, label, ("b",), f"(?<= )(?:{pattern})(?= )", 0.5)
    rules = [rule(0, "c", "d e"), rule(1, "a", "a b c d"), rule(2, "b", "b"), rule(3, "inside", "b x"), rule(4, "x", "x")]
    rows = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, ["a b c d e", "a b c d", "b x", "x"]), rules=rules).collect()}
    assert [(d.label, d.start, d.end) for d in rows[0].detections] == [("b", 1, 2), ("c", 3, 5)]
    assert [d.label for d in rows[1].detections] == ["a"] and [d.label for d in rows[2].detections] == ["b", "x"]
    assert rows[3].detections == []  # no keyword


def example(tree, rng):
    """A text that a pattern matches, by chance."""
    out = ""
    for op, a in tree:
        if op is _constants.LITERAL:
            out += chr(a)
        elif op is _constants.SUBPATTERN:
            out += example(a[3], rng)
        elif op is _constants.BRANCH:
            out += example(rng.choice(a[1]), rng)
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
            out += "".join(example(a[2], rng) for _ in range(rng.randint(a[0], min(a[1], a[0] + 3))))
        elif op is _constants.IN:
            kind, value = rng.choice(a)
            out += chr(value) if kind is _constants.LITERAL else chr(rng.randint(*value))
        else:
            assert op in (_constants.ASSERT, _constants.ASSERT_NOT)
    return out


def test_hundreds_of_rules_with_keywords_that_they_hold():
    assert len(RULES) >= 200 and len({r.pattern for r in RULES}) == len(RULES)
    assert [r.priority for r in RULES] == list(range(len(RULES)))

    rng = random.Random(1)
    for rule in RULES:
        for _ in range(200):
            text = example(_parser.parse(rule.pattern), rng)
            assert set(rule.keywords) & set(text.split()), (rule, text)
            assert re.search(rule.pattern, f" {text} ") or "(?!" in rule.pattern


def test_many_mentions_take_linear_time(spark):
    text = "licensed under the mit license and the apache license foo "
    licenses.license_scan(docs_of(spark, [text])).collect()
    seconds = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        row = licenses.license_scan(docs_of(spark, [text * n])).collect()[0]
        seconds.append(time.perf_counter() - began)
        assert len(row.detections) == 2 * n and row.n_base == 2 * n
    assert seconds[1] < 6 * seconds[0] + 3


def test_odd_tables(spark):
    assert licenses.license_scan(docs_of(spark, [])).count() == 0
    rows = [(None, "mit license"), (1, None), (1, None), (2, "x" * 1_000_000), (2, "mit license")]
    got = sorted((str(r.doc_id), r.labels, r.n_words) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "", 1), ("2", "mit", 2), ("None", "mit", 2)]


@pytest.mark.parametrize("text", ["", "a", "license", "spdx spdx spdx"])
def test_texts_without_detections(spark, text):
    row = licenses.license_scan(docs_of(spark, [text])).collect()[0]
    assert row.labels == "" and row.score == 0.0 and row.detections == []
