"""License texts, notices, expressions and the suppression of overlapping detections."""

import random
import re

import pytest
import regex
from re import _parser

from tidewarden.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. x 2. y"
ENDORSE = "Neither the name of the copyright holder may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"
CASES = [
    (MIT, "mit"),
    (BSD, "bsd-2-clause"),
    (f"{BSD} 3. {ENDORSE}", "bsd-3-clause"),
    (f"{BSD} 3. All advertising materials mentioning features or use of this software must display an acknowledgement. 4. {ENDORSE}", "bsd-4-clause"),
    (f"{BSD}. And then: {BSD} 3. {ENDORSE}", "bsd-2-clause,bsd-3-clause"),
    (f"{GPL}; either version 3 of the License, or (at your option) any later version.", "gpl-3-or-later"),
    (f"{GPL}, version 2 of the License.", "gpl-2-only"),
    ("distributed under the terms of the GNU Lesser General Public License version 2.1 or later", "lgpl-2.1-or-later"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause and more", "apache-2,bsd-3-clause,mit"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "classpath-exception-2,gpl-2-or-later"),
    ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3-only"),
    ("SPDX-License-Identifier: GPL-3.0", "gpl-3"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by-4"),
    ("SPDX-License-Identifier: CC-BY-SA-2.5", "cc-by-sa-2.5"),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "cc-by-nc,cc-by-nc-4"),
    ("Released under MIT and GPL v2.", "gpl-2,mit"),
    ("Licensed under either the MIT or the Apache License 2.0", "apache-2,mit"),
    ("Creative Commons Attribution 4.0 International License", "cc-by-4"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported", "cc-by-nc-sa-3"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4"),
    ("see http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("We asked for permission, and common goods are reserved.", ""),
    ("SPDX-License-Identifier: Nonsense-1.0", ""),
    ("", ""),
]


def _scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for _, r in sorted((r["doc_id"], r) for r in rows)]


def test_texts_notices_and_expressions(spark):
    rows = _scan(spark, [t for t, _ in CASES])
    assert [(t, r["labels"]) for (t, _), r in zip(CASES, rows)] == CASES


def _example(pattern, optional):
    """A text of the pattern, with or without its optional parts; a gap holds one word."""
    out = ""
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "x"
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "BRANCH":
            out += _example(arg[1][-1 if optional else 0], optional)
        elif name == "SUBPATTERN":
            out += _example(arg[-1], optional)
        elif name == "MIN_REPEAT":
            out += "x" if arg[0] else " filler "
        elif name == "MAX_REPEAT":
            out += _example(arg[2], optional) if optional else ""
    return out


def test_every_signature_by_itself(spark):
    pairs = [(r, _example(_parser.parse(r.pattern), optional)) for r in licenses.text_rules() for optional in (False, True)]
    assert [(r.pattern, t) for r, t in pairs if r.keyword not in t] == []
    rows = _scan(spark, [f"See. {t.title()}, so" for _, t in pairs])
    assert [(r.pattern, t) for (r, t), row in zip(pairs, rows) if not any(d["start"] <= 4 and d["stop"] >= 4 + len(t) and d["priority"] >= r.priority for d in row["detections"])] == []


def _plain(text):
    """Detections by the definition: all places of all rules, then those not inside another of their priority or a higher one."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    joined = " " + " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", low)) + " "
    found = set()
    for r in (*licenses.rules(), *licenses.text_rules()):
        found |= {(m.start(), m.end(), r.label, r.priority, r.weight) for m in regex.finditer(f" (?:{r.pattern})(?= )", joined)}
    known = licenses.identifiers()
    one = "|".join(sorted(known, key=len, reverse=True))
    for m in regex.finditer(f" spdx license identifier ((?:{one})(?: (?:and|or|with) (?:{one}))*)(?= )", joined):
        at, first = m.start(1), True
        for part in regex.split(" (?:and|with|or(?! later)) ", m[1]):
            at = joined.index(part, at)
            found.add((m.start() if first else at, at + len(part), known[part], 4, 1.0))
            at, first = at + len(part), False
    # A smaller key wins where two cover the same place.
    key = lambda d: (d[0], -d[1], -d[3], d[2])
    inside = lambda d, e: e[0] <= d[0] and d[1] <= e[1] and e[3] >= d[3] and (e[:2] != d[:2] or key(e) < key(d))
    return {d for d in found if not any(inside(d, e) for e in found)}


PARTS = [
    "Released under the MIT License", "SPDX-License-Identifier: MIT OR (GPL-2.0-or-later AND BSD-3-Clause)", "the GNU General Public License version 3", "or any later version", MIT, BSD, ENDORSE,
    "licensed under the terms of the GNU Affero General Public License v3", "Creative Commons Attribution Share-Alike 4.0", "CC BY-SA 4.0 license", "Mozilla Public License 2.0 license",
    "Apache License, Version 2.0", "public domain license", "under the Apache license 2", "license is BSD 3 clause", "words between", "and", "license", "Ünd",
]


@pytest.mark.parametrize("seed", range(2))
def test_suppression_by_its_definition(spark, seed):
    draw = random.Random(seed)
    texts = [draw.choice([" ", "\n", ". "]).join(draw.choices(PARTS, k=draw.randrange(1, 9))) for _ in range(150)]
    for text, row in zip(texts, _scan(spark, texts)):
        got = {tuple(d) for d in row["detections"]}
        want = _plain(text)
        # Names of a grant of several licenses come on top of the rules; they are inside nothing else either.
        assert want - got == set() or all(any(e[0] <= d[0] and d[1] <= e[1] and e[3] >= d[3] for e in got) for d in want - got), text
        assert all(d[3:] == (3, 0.9) for d in got - want), (text, got - want)
        assert not any(d != e and e[0] <= d[0] and d[1] <= e[1] and e[3] >= d[3] for d in got for e in got), text


def test_every_rule_holds_its_needed_parts():
    for r in (*licenses.rules(), *licenses.text_rules()):
        for optional in (False, True):
            text = f" {_example(_parser.parse(r.pattern), optional)} "
            assert any(all(w in text for w in parts) for parts in licenses._needed(r)), (r.pattern, text)
    assert licenses.holds("a(?: b)? (?:cd|e(?:f|g)h) ij?") == {frozenset({"a", "cd", " i"}), frozenset({"a", "e", "f", "h", " i"}), frozenset({"a", "e", "g", "h", " i"})}


def test_places_over_several_blocks(spark):
    """Places are worked out in blocks of 256: they keep their order and miss none."""
    row = _scan(spark, ["Licensed under the MIT License. " * 700])[0]
    assert [(d["start"], d["stop"]) for d in row["detections"]] == [(31 * i, 31 * i + 31) for i in range(700)]
