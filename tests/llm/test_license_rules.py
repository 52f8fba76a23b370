import random
import re

from attesta.llm import license_rules
from tests.llm.test_decontaminate import words


def base(text):
    w, out = words(text), []
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return sorted(out)


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in license_rules.scan_licenses(docs).orderBy("doc_id").collect()]


def test_base_places_and_rules(spark):
    texts = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "mit license mit-license general public\nLICENSE apache license " * 3,
        "SPDX-License-Identifier: MPL 2.0", "no such thing", "", None, "GNU Lesser General Public License version 2.1 or later", "general license mit x license",
    ]
    rows = scan(spark, texts)
    for text, row in zip(texts, rows):
        assert row.n_words == len(words(text))
        assert sorted((b.start, b.label) for b in row.base_starts) == base(text)
        assert set(row.base_labels) <= set(row.labels) and 0 <= row.score <= 1
    found = [set(r.labels) for r in rows]
    assert "mit" in found[0] and "apache-2.0" in found[1] and found[2] == {"cc-by-nc-4.0"} and "gpl-3" in found[3]
    assert found[5] == {"mpl-2.0"} and found[6] == found[7] == found[8] == set() and "lgpl-2.1-or-later" in found[9]
    assert "gpl-2.1" not in found[9] and "lgpl" not in found[9]  # inside the interval of an earlier rule


def brute(text):
    """All matches of all rules over all words, then every pair of them for suppression."""
    joined = " ".join(words(text))
    found = []
    for rank, rule in enumerate(license_rules.rules()):
        for m in re.finditer(rule.pattern, joined):
            start = joined[:m.start()].count(" ")
            found.append((start, rank, start + m.group().count(" ") + 1, rule.label))
    return sorted(d for d in found if not any(e[1] < d[1] and e[0] <= d[0] and e[2] >= d[2] for e in found))


def fragments():
    plain = [re.sub(r"\(\?:|\)|\?|\[|\]|\{v\}", "", t.replace("|", " ")) for _, t, _, _ in license_rules.TEXTS + license_rules.SHORT]
    return plain + [t.replace("{v}", v) for _, t, _, _ in license_rules.TEXTS if "{v}" in t and "(" not in t for v in ("2", "2 1", "3")] + """
        GNU | Lesser General Public License | General Public License | as published by the Free Software Foundation | version 2.1 | version 3 | either version 2
        of the License, or (at your option) any later version | only | or later | GPLv3 | LGPLv2 | BSD 3-Clause | Apache-2.0 | Licensed under the | MIT | license
        SPDX-License-Identifier: | MPL 2.0 | Creative Commons Attribution 4.0 | CC BY-SA 3.0 | in the public domain | mit\u2013x license | \u2013 | word | subject to the terms of the""".replace("\n", "|").split("|")


def test_detections_as_brute_force(spark):
    rng = random.Random(6)
    pieces = [f.strip() for f in fragments() if f.strip()]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(250)]
    texts += ["the mit license " * 400, " ".join(rng.choices(" ".join(pieces).split(), k=3000))]
    for text, row in zip(texts, scan(spark, texts)):
        assert [(d.start, d.rank, d.end, d.label) for d in row.detections] == brute(text), text
        assert row.labels == sorted({d[3] for d in brute(text)} | set(row.base_labels))


def test_standard_headers(spark):
    texts = {
        "GNU Lesser General Public License as published by the Free Software Foundation, version 2.1": {"lgpl-2.1"},
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"gpl-3-or-later"},
        "GPLv3": {"gpl-3"}, "LGPLv2": {"lgpl-2"}, "BSD 3-Clause": {"bsd-3-clause"}, "Apache-2.0": {"apache-2.0"},
    }
    for text, row in zip(texts, scan(spark, list(texts))):
        assert {d.label for d in row.detections} == texts[text], text


def test_every_match_holds_its_keyword_and_passes_the_gate():
    ruled = license_rules.rules()
    assert len({r.label for r in ruled}) > 100
    rng = random.Random(2)
    for rule in ruled:
        assert not re.search(r"[*+{]", rule.pattern) and 0 <= rule.confidence <= 1     # a match's length has a bound
        for _ in range(5):
            text = sampled(rule.pattern, rng)
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text and rule.also in text and any(k in rule.keyword for k in license_rules.keywords(ruled)), (rule, text)


def sampled(pattern, rng):
    """A text that a pattern of groups, alternatives, optional parts and character sets matches."""
    def walk(parts):
        out = ""
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "IN":
                out += chr(rng.choice([v for o, v in value if str(o) == "LITERAL"]))
            elif name == "MAX_REPEAT":
                out += walk(value[2]) * rng.randint(value[0], min(value[1], 1))
            elif name == "SUBPATTERN":
                out += walk(value[3])
            elif name == "BRANCH":
                out += walk(rng.choice(value[1]))
        return out
    return walk(re._parser.parse(pattern))


def test_odd_rows(odd_docs, no_docs):
    got = license_rules.scan_licenses(odd_docs)
    assert got.count() == odd_docs.count() and {r.score for r in got.collect()} == {0.0}
    assert license_rules.scan_licenses(no_docs).count() == 0
