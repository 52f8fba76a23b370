"""License scans: ordered signature rules, gated by keywords, overlaps resolved by priority.

The rules are regular expressions over the words of a text joined by single spaces. They stand in order: texts and headers of
licenses first, then names with versions, then bare names; a rule that stands earlier is more specific and wins. A text without any
rule's keyword is never split, and in the others a rule is tried only where its own keyword occurs. An admitted rule
runs over the whole text and gives all its matches. A detection whose interval lies inside that of an earlier rule is
suppressed, wherever in the text the two stand. Everything is one projection, without a shuffle.

Suppression looks back over a bounded number of detections: no rule has an unbounded repeat, so a match is at most as many words
long as the longest pattern has spaces, and only so many detections can start where one could hold another. The work is linear
in the words and detections of a text.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows each get their
result; ties between equal intervals go to the earlier rule; nulls and further columns pass through
``scan_licenses``, whose own columns are named in ``RESULT``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import let
from attesta.llm.words import fresh, lower_words, raw_words, whole

RESULT = ["n_words", "base_starts", "base_labels", "detections", "labels", "score"]
# a rule's match is made of whole words; words are joined by spaces and may hold any other character
HEAD, TAIL = r"(?<![^ ])", r"(?![^ ])"
BEGIN, END = "\x01", "\x02"      # around a match; no word holds them


class Rule(NamedTuple):
    label: str
    pattern: str
    keyword: str        # within one word of every match
    confidence: float
    also: str = ""      # so is this


# fixed values: phrases and their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# fixed values: label, name as spoken, keyword
NAMES = [
    ("mit", "mit", "mit"), ("mit-0", "mit 0", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd"), ("0bsd", "(?:0bsd|zero clause bsd)", "bsd"),
    ("bsd", "bsd", "bsd"), ("apache-1.0", "apache(?: software)?(?: license)? version 1 0", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?", "apache"),
    ("apache", "apache(?: software)?", "apache"), ("mpl-1.1", "mozilla public(?: license)?(?: version)? 1 1", "mozilla"),
    ("mpl-2.0", "mozilla public(?: license)?(?: version)?(?: v)? ?2 0", "mozilla"), ("mpl", "mozilla public", "mozilla"),
    ("epl-1.0", "eclipse public(?: license)?(?: version)?(?: v)? ?1 0", "eclipse"),
    ("epl-2.0", "eclipse public(?: license)?(?: version)?(?: v)? ?2 0", "eclipse"), ("epl", "eclipse public", "eclipse"),
    ("cddl", "common development and distribution", "development"), ("cpl", "common public", "common"),
    ("eupl", "european union public", "european"), ("artistic-2.0", "artistic(?: license)?(?: version)? 2 0", "artistic"),
    ("artistic", "artistic", "artistic"), ("bsl-1.0", "boost software", "boost"), ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "do what the fuck you want to public", "want"), ("postgresql", "postgresql", "postgresql"),
    ("python", "python software foundation", "python"), ("ruby", "ruby", "ruby"), ("php", "php", "php"),
    ("openssl", "openssl", "openssl"), ("ofl", "(?:sil )?open font", "font"), ("ms-pl", "microsoft public", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "microsoft"), ("osl-3.0", "open software", "software"),
    ("afl-3.0", "academic free", "academic"), ("odbl", "open database", "database"), ("qpl", "q public", "public"),
    ("beerware", "beer ware", "beer"), ("ncsa", "university of illinois ncsa", "ncsa"), ("x11", "x11", "x11"),
    ("busl", "business source", "business"), ("sspl", "server side public", "server"), ("elastic", "elastic", "elastic"),
    ("openrail", "open ?rail", "rail"), ("openrail", "responsible ai", "responsible"), ("llama", "llama community", "llama"),
]
# fixed values: label, name, keyword; each is offered in several versions
GNU = [("agpl", "(?:gnu )?affero general public", "affero"), ("lgpl", "(?:gnu )?(?:lesser|library) general public", "general"),
       ("gfdl", "gnu free documentation", "documentation"), ("gpl", "(?:gnu )?general public", "general")]
GNU_VERSIONS = ["1", "2 1", "2", "3"]
CC_PARTS = ["by", "by nc", "by nc nd", "by nc sa", "by nd", "by sa"]
CC_NAMES = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s(?: works)?", "sa": "share ?alike"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
LICENSE = "licen[cs]ed?"
FORMS = [  # lead-in, tail, confidence, word of every match
    (f"(?:{LICENSE}|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?", f"(?: {LICENSE})?", 0.95, "under"),
    ("subject to (?:the )?(?:terms of )?(?:the )?", f"(?: {LICENSE})?", 0.9, "subject"),
    ("governed by (?:the )?(?:terms of )?(?:the )?", f"(?: {LICENSE})?", 0.9, "governed"),
    ("covered by (?:the )?(?:terms of )?(?:the )?", f"(?: {LICENSE})?", 0.9, "covered"),
    ("", f" {LICENSE}", 0.7, "licen"),
]


# fixed values: label, sentence of the license or its header as words, keyword, confidence
TEXTS = [
    ("gpl-{v}-or-later", "under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version", "general", 1.0),
    ("lgpl-{v}-or-later", "under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version {v} of the license or at your option any later version", "general", 1.0),
    ("agpl-{v}-or-later", "under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version", "affero", 1.0),
    ("gpl-{v}-only", "under the terms of (?:the )?version {v} of the gnu general public license(?: as published by the free software foundation)?", "general", 0.95),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission", 0.9),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission", 0.95),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission", 1.0),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", "consortium", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising", 0.95),
    ("bsd-3-clause", "neither the name of (?:the )?(?:copyright holder|author|university|organization|company)(?: nor the names of its contributors)? may be used to endorse or promote products derived from this software", "endorse", 0.95),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution", 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", 0.8),
    ("apache-2.0", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license", "apache", 1.0),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed", 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 1.0),
    ("epl-{v}", "made available under the terms of the eclipse public license(?: v)? {v}(?: 0)?", "eclipse", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "development", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "warranty", 0.9),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented", 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim", 0.8),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", 0.8),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated", 1.0),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "font", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "package", 0.9),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 0.95),
    ("python", "psf is making python available to licensee on an as is basis", "psf", 0.95),
    ("ms-pl", "a contributor is any person that distributes its contribution under this license", "contributor", 0.8),
    ("ncsa", "deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "restriction", 0.7),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer", 1.0),
    ("eupl", "licensed under the eupl(?: version)?(?: v)? ?1 [12]", "eupl", 1.0),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor", 0.95),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service", "functionality", 0.9),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized", 0.9),
    ("proprietary", "confidential and proprietary information of", "proprietary", 0.6),
    ("all-rights-reserved", "all rights reserved", "reserved", 0.5),
    ("dual", "dual licensed under (?:the )?mit and (?:the )?gpl(?: licenses)?", "dual", 0.9),
    ("dual", "licensed under either of apache license(?: version)? 2 0 or mit license at your option", "apache", 0.95),
    ("no-warranty", "(?:the|this) software is provided as is without warranty of any kind", "warranty", 0.6),
    ("see-file", "see the license file(?: in the project root)? for (?:full )?license information", "license", 0.5),
    ("see-file", "that can be found in the license file", "license", 0.5),
]
# fixed values: short names as people write them
SHORT = [
    ("bsd-2-clause", "bsd 2 clause", "clause", 0.8), ("bsd-3-clause", "bsd 3 clause", "clause", 0.8), ("bsd-4-clause", "bsd 4 clause", "clause", 0.8),
    ("apache-2.0", "apache 2 0", "apache", 0.7), ("apache-2.0", "apache2", "apache2", 0.7),     ("gpl-2", "gpl ?v?2 0?(?: only)?", "gpl", 0.8), ("gpl-3-or-later", "gpl ?v?3 (?:0 )?or later", "gpl", 0.9), ("gpl-2-or-later", "gpl ?v?2 (?:0 )?or later", "gpl", 0.9),
    ("mpl-2.0", "mpl ?v? ?2 0", "mpl", 0.7), ("epl-2.0", "epl ?v? ?2 0", "epl", 0.7), ("epl-1.0", "epl ?v? ?1 0", "epl", 0.7),
    ("cc0", "cc0 1 0 universal", "cc0", 0.95), ("ofl", "ofl 1 1", "ofl", 0.7), ("bsl-1.0", "bsl 1 0", "bsl", 0.6),
]


def rules() -> list[Rule]:
    """All rules, the most specific first."""
    found = []
    for label, text, keyword, confidence in TEXTS:
        for v in GNU_VERSIONS if "{v}" in text else ("",):
            found.append(Rule(label.replace("{v}", v.replace(" ", ".")), f"{HEAD}{text.replace('{v}', v)}{TAIL}", keyword, confidence))
    for parts in CC_PARTS:
        names = " ".join(CC_NAMES[p] for p in parts.split())
        for v in CC_VERSIONS:
            label = f"cc-{parts} {v.replace(' ', '.')}".replace(" ", "-")
            found.append(Rule(label, f"{HEAD}cc {parts} {v}{TAIL}", "cc", 0.95))
            found.append(Rule(label, f"{HEAD}creative commons {names}(?: international| unported| generic)? {v}{TAIL}", "commons", 0.95))
        found.append(Rule(f"cc-{parts}".replace(" ", "-"), f"{HEAD}creative commons {names}{TAIL}", "commons", 0.8))
    found += [Rule("cc0", f"{HEAD}cc0(?: 1 0)?{TAIL}", "cc0", 0.95), Rule("cc0", f"{HEAD}creative commons zero(?: 1 0)?{TAIL}", "commons", 0.95),
              Rule("public-domain", f"{HEAD}(?:in|into|to) the public domain{TAIL}", "domain", 0.6)]
    for label, name, keyword in GNU:
        for v in GNU_VERSIONS:
            dotted = v.replace(" ", ".")
            version = f"(?: {LICENSE})?(?: as published by the free software foundation)?(?: either)? (?:version|v) ?{v}"
            later = f"(?: of the {LICENSE})? or (?:at your option )?(?:any )?later(?: version)?"
            found.append(Rule(f"{label}-{dotted}-or-later", f"{HEAD}{name}{version}{later}{TAIL}", keyword, 0.95))
            found.append(Rule(f"{label}-{dotted}-only", f"{HEAD}{name}{version} only{TAIL}", keyword, 0.95))
            found.append(Rule(f"{label}-{dotted}", f"{HEAD}{name}{version}{TAIL}", keyword, 0.9))
            found.append(Rule(f"{label}-{dotted}", f"{HEAD}spdx license identifier {label} {v}(?: 0)?(?: only| or later)?{TAIL}", "spdx", 1.0))
            found.append(Rule(f"{label}-{dotted}", f"{HEAD}{label} ?v?{v}{TAIL}", label, 0.8))
        found.append(Rule(label, f"{HEAD}{name} {LICENSE}{TAIL}", keyword, 0.8))
    found += [Rule(label, f"{HEAD}{text}{TAIL}", keyword, confidence) for label, text, keyword, confidence in SHORT]
    for label, _, _ in NAMES:
        found.append(Rule(label, f"{HEAD}spdx license identifier {label.replace('-', ' ').replace('.', ' ')}{TAIL}", "spdx", 1.0))
    for lead, tail, confidence, word in FORMS:
        found += [Rule(label, f"{HEAD}{lead}{name}{tail}{TAIL}", word, confidence, keyword) for label, name, keyword in NAMES]
    return found


HIT = "struct<start:int,rank:int,end:int,label:string,confidence:double>"


def longest_match(ruled: list[Rule]) -> int:
    """Words that a match can have at most: one more than the spaces of its pattern, none of which can repeat."""
    return max((r.pattern.count(" ") + 1 for r in ruled), default=1)


def keywords(ruled: list[Rule]) -> list[str]:
    """A text in which none of these occurs holds no rule's match and no base phrase: each needs its keyword within one word."""
    words = {r.keyword for r in ruled} | {p.split()[-1] for p, _ in BASE}
    return sorted(w for w in words if not any(other != w and other in w for other in words))


def has_keyword(text: Column, ruled: list[Rule]) -> Column:
    lowered = F.lower(text)     # lowers more than A to Z, which admits at most more texts
    return let(lowered, lambda t: reduce(lambda a, b: a | b, [t.contains(k) for k in keywords(ruled)]))


def _matches(joined: Column, rule: Column) -> Column:
    """All places of a rule in the joined words. A mark is set around every match, and the marked words are found by position."""
    marked = F.split(F.regexp_replace(joined, rule["pattern"], F.lit(BEGIN + "$0" + END)), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(BEGIN), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith(END), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a.cast("int").alias("start"), rule["rank"].alias("rank"), b.cast("int").alias("end"), rule["label"].alias("label"),
        rule["confidence"].alias("confidence")))


def detections(joined: Column, ruled: list[Rule]) -> Column:
    """Matches of all rules that no earlier rule's match holds, by place and rank."""
    listed = F.expr("array(" + ", ".join(
        f"named_struct('rank', {i}, 'label', '{r.label}', 'confidence', {r.confidence}D, 'pattern', r'{r.pattern}')"
        for i, r in enumerate(ruled)) + ")")
    reach = longest_match(ruled)

    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(ruled):
        by_keyword.setdefault(r.keyword, []).append(i)

    def found(text: Column) -> Column:
        """Rules with a match; a keyword that does not occur shuts out all its rules at once."""
        none = F.array().cast("array<int>")
        return F.array_compact(F.concat(*[
            F.when(text.contains(k), F.array(*[F.when(text.contains(ruled[i].also) & text.rlike(ruled[i].pattern), F.lit(i)) for i in mine])).otherwise(none)
            for k, mine in by_keyword.items()]))

    def kept(all_: Column, rules_met: Column) -> Column:
        # a holder starts at most ``reach`` words earlier, and each rule's matches start at different words
        back = (rules_met * reach).cast("int")
        free = F.transform(all_, lambda d, i: F.when(~F.exists(
            F.slice(all_, F.greatest(i - back, F.lit(0)) + 1, back), lambda e: (
                (e["rank"] < d["rank"]) & (e["start"] <= d["start"]) & (e["end"] >= d["end"]))), d))
        return F.array_compact(free)

    def placed(text: Column) -> Column:
        return let(found(text), lambda met: let(
            F.array_sort(F.flatten(F.transform(met, lambda i: _matches(text, F.get(listed, i))))).cast(f"array<{HIT}>"),
            lambda all_: kept(all_, F.size(met))))
    return let(joined, placed)


def base_places(words: Column) -> Column:
    """Every place where a base phrase stands: struct(start, label)."""
    def at(i):
        def ends(phrase: str) -> Column:
            parts = phrase.split()
            back = len(parts) - 1
            same = [F.get(words, i - (back - j)) == F.lit(w) for j, w in enumerate(parts[:-1])]
            met = i >= back
            for s in same:
                met = met & s
            return met
        hit = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in reversed(BASE):
            hit = F.when(ends(phrase), F.struct((i - (len(phrase.split()) - 1)).cast("int").alias("start"),
                                                F.lit(label).alias("label"))).otherwise(hit)
        return hit
    places = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())
    return F.array_compact(F.transform(places, at))


def scan_licenses(docs: DataFrame, text_col: str = "text", ruled: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the columns in ``RESULT`` added (replacing columns of these names)."""
    ruled = rules() if ruled is None else ruled
    base_type = "array<struct<start:int,label:string>>"
    gate, split = fresh(docs, "__gated", "__words")
    text, gated, words = whole(text_col), F.col(gate), F.col(split)
    kept = docs.drop(*RESULT).withColumn(gate, has_keyword(text, ruled))
    kept = kept.withColumn(split, F.when(gated, lower_words(text)))
    kept = kept.withColumn("n_words", F.when(gated, F.size(words)).otherwise(F.size(raw_words(text))).cast("long"))
    kept = kept.withColumn("base_starts", F.when(gated, base_places(words)).otherwise(F.array().cast(base_type)))
    kept = kept.withColumn("detections", F.when(gated, detections(F.array_join(words, " "), ruled)).otherwise(F.array().cast(f"array<{HIT}>")))
    base = F.array_sort(F.array_distinct(F.transform("base_starts", lambda b: b["label"])))
    own = F.transform("detections", lambda d: d["label"])
    sure = F.concat(F.transform("detections", lambda d: d["confidence"]), F.transform("base_starts", lambda b: F.lit(0.7)))
    return kept.withColumns({
        "base_labels": base, "labels": F.array_sort(F.array_distinct(F.concat(base, own))),
        "score": F.coalesce(F.array_max(sure), F.lit(0.0))}).drop(gate, split)
