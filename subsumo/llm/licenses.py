"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority.

A text is lower-cased and becomes its words with single blanks between. Rules are regular
expressions over such words. Some are written one by one, from sentences of the licenses' own texts and from short
names (``SIGNATURES``); the others are made from families of licenses, their versions and the forms
in which a license is named: a machine-readable tag, a notice with a version, a notice, a
title with a version, a title. The form is the priority; a sentence of a license ranks as a notice with a version. A text
is first tested for a few words of which every rule needs one, then for the keywords of rules; only rules with a keyword in
the text run. A plus behind a version is a separator, so ``GPLv2+`` counts as ``GPLv2``. A detection inside the interval of one with the same or a higher priority is
suppressed. Everything is columns of one row: no shuffle, no Python.

The four stated phrases are found for themselves, and no rule hides them. Nulls are empty texts
without words; rows that repeat are scanned each; of rules with equal intervals the first
one stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsumo.llm.common import Query, table

# Words of a text, and the stated phrases with their labels.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same before letters are lowered.
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
PHRASES = {"apache license": "apache", "cc by": "cc-by", "gnu general public license": "gpl", "mit license": "mit"}

LICENSE = "licen[cs]e"
#: Label, keyword, names as patterns over words, versions.
FAMILIES = [
    ("gpl", "general public", f"gnu general public {LICENSE}", ["1", "2", "3"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3"]),
    ("lgpl", "general public", f"gnu (?:lesser|library) general public {LICENSE}", ["2", "2 1", "3"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2 1", "3"]),
    ("agpl", "affero", f"(?:gnu )?affero general public {LICENSE}", ["1", "3"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3"]),
    ("gfdl", "free documentation", f"gnu free documentation {LICENSE}", ["1 1", "1 2", "1 3"]),
    ("apache", "apache", f"apache(?: software)? {LICENSE}", ["1", "1 1", "2"]),
    ("mit", "mit", f"(?:mit|expat) {LICENSE}", []),
    ("bsd-2-clause", "clause bsd", f"(?:2|two) clause bsd {LICENSE}", []),
    ("bsd-3-clause", "clause bsd", f"(?:3|three) clause bsd {LICENSE}", []),
    ("bsd-4-clause", "clause bsd", f"(?:4|four) clause bsd {LICENSE}", []),
    ("bsd", "bsd", f"bsd (?:style )?{LICENSE}", []),
    ("isc", "isc", f"isc {LICENSE}", []),
    ("mpl", "mozilla", f"mozilla public {LICENSE}", ["1", "1 1", "2"]),
    ("epl", "eclipse", f"eclipse public {LICENSE}", ["1", "2"]),
    ("edl", "eclipse", f"eclipse distribution {LICENSE}", ["1"]),
    ("cddl", "common development", f"common development and distribution {LICENSE}", ["1", "1 1"]),
    ("cpl", "common public", f"common public {LICENSE}", ["1"]),
    ("cpal", "common public", f"common public attribution {LICENSE}", ["1"]),
    ("ipl", "ibm public", f"ibm public {LICENSE}", ["1"]),
    ("eupl", "european union", f"european union public {LICENSE}", ["1", "1 1", "1 2"]),
    ("artistic", "artistic", f"artistic {LICENSE}", ["1", "2"]),
    ("zlib", "zlib", f"zlib {LICENSE}", []),
    ("libpng", "libpng", f"(?:zlib )?libpng {LICENSE}", ["2"]),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "do what the", f"do what the f\\w+ you want to public {LICENSE}", ["1", "2"]),
    ("bsl", "boost", f"boost software {LICENSE}", ["1"]),
    ("busl", "business source", f"business source {LICENSE}", ["1 1"]),
    ("sspl", "server side", f"server side public {LICENSE}", ["1"]),
    ("ofl", "open font", f"(?:sil )?open font {LICENSE}", ["1", "1 1"]),
    ("postgresql", "postgresql", f"postgresql {LICENSE}", []),
    ("python", "python", f"python (?:software foundation )?{LICENSE}", ["2"]),
    ("php", "php", f"php {LICENSE}", ["3", "3 01"]),
    ("ruby", "ruby", f"ruby {LICENSE}", []),
    ("openssl", "openssl", f"openssl {LICENSE}", []),
    ("ms-pl", "microsoft", f"microsoft public {LICENSE}", []),
    ("ms-rl", "microsoft", f"microsoft reciprocal {LICENSE}", []),
    ("zpl", "zope", f"zope public {LICENSE}", ["2", "2 1"]),
    ("afl", "academic free", f"academic free {LICENSE}", ["1 2", "2", "2 1", "3"]),
    ("osl", "open software", f"open software {LICENSE}", ["1", "2", "2 1", "3"]),
    ("ecl", "educational community", f"educational community {LICENSE}", ["1", "2"]),
    ("upl", "universal permissive", f"universal permissive {LICENSE}", ["1"]),
    ("odbl", "open database", f"open (?:data commons )?open database {LICENSE}|open database {LICENSE}", ["1"]),
    ("odc-by", "data commons", f"open data commons attribution {LICENSE}", ["1"]),
    ("cc0", "cc0", "(?:creative commons )?cc0", ["1"]),
    ("public-domain", "public domain", "(?:in|into) the public domain", []),
    ("cc-by", "attribution", f"creative commons attribution(?: international)?(?: {LICENSE})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-sa", "sharealike|share alike", f"creative commons attribution share ?alike(?: {LICENSE})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc", "noncommercial|non commercial", f"creative commons attribution non ?commercial(?: {LICENSE})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nd", "noderiv|no deriv", f"creative commons attribution no ?deriv(?:ative)?s?(?: {LICENSE})?", ["1", "2", "2 5", "3", "4"]),
    ("cc-by", "cc by", "cc by", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-sa", "cc by", "cc by sa", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc", "cc by", "cc by nc", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nd", "cc by", "cc by nd", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-sa", "cc by", "cc by nc sa", ["1", "2", "2 5", "3", "4"]),
    ("cc-by-nc-nd", "cc by", "cc by nc nd", ["1", "2", "2 5", "3", "4"]),
]
#: Families whose notices let a later version be chosen, with a label of its own for that.
OR_LATER = ("gpl", "lgpl", "agpl", "gfdl")
#: Label, keyword, level, pattern over words. Sentences of license texts, and short names that hold no "license".
SIGNATURES = [
    ("mit", "hereby", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial portions", 1, "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("bsl-1", "hereby", 1, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unicode", "hereby", 1, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("isc", "hereby", 1, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", 1, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("postgresql", "hereby", 1, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", 1, "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose (?:and )?(?:without fee )?is hereby granted"),
    ("mit-0", "hereby", 1, "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("python", "hereby", 1, "psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("bsd", "redistribution and", 1, "redistribution and use in source and binary forms with or without modification are permitted(?: subject to the limitations in the disclaimer below)? provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", 1, "neither the names? of (?:\\S+ ){1,16}?nor the names of (?:\\S+ ){0,3}?contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", 1, "the names? of (?:\\S+ ){1,8}?may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 1, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "implied warranty", 1, "this software is provided as is without any express or implied warranty in no event (?:will|shall) the authors? be held liable"),
    ("zlib", "misrepresented", 1, "the origin of this software must not be misrepresented"),
    ("apache-1.1", "the apache", 1, "this product includes software developed by the apache (?:software foundation|group)"),
    ("apache-2", "applicable law", 1, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("mpl-2", "mozilla", 1, "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2", "mozilla", 1, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", 1, "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-1", "eclipse", 1, "made available under the terms of the eclipse public licen[cs]e (?:v |version )?1 0"),
    ("epl-2", "eclipse", 1, "made available under the terms of the eclipse public licen[cs]e (?:v |version )?2 0"),
    ("unlicense", "unencumbered", 1, "this is free and unencumbered software released into the public domain"),
    ("cc0", "deed has", 1, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic-1", "intent of", 1, "the intent of this document is to state the conditions under which a package may be copied"),
    ("openssl", "openssl project", 1, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", "php software", 1, "this product includes php software freely available from"),
    ("wtfpl", "do what the", 1, "you just do what the f\\S+ you want to"),
    ("json", "good not evil", 1, "the software shall be used for good not evil"),
    ("beerware", "whatever you", 1, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("ofl", "font software", 1, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ncsa", "ncsa", 2, "university of illinois ncsa open source licen[cs]e"),
    ("vim", "vim", 4, "vim licen[cs]e"),
    ("apache-2", "apache 2", 3, "apache 2 0(?! [0-9])"),
    ("apache-1.1", "apache 1", 3, "apache 1 1(?! [0-9])"),
    ("artistic-2", "artistic 2", 3, "artistic 2 0"),
    ("0bsd", "0bsd", 3, "0bsd"),
    ("bsd-2-clause", "bsd", 3, "bsd (?:2|two) clause|(?:simplified|freebsd) bsd"),
    ("bsd-3-clause", "bsd", 3, "bsd (?:3|three) clause|(?:new|modified|revised) bsd"),
    ("bsd-4-clause", "bsd", 3, "bsd (?:4|four) clause|(?:original|old) bsd licen[cs]e"),
]
#: Labels of short names with versions, which stand apart or glued.
SHORT_NAMES = [
    ("apache-2", "asl", "2 0"), ("mpl-1.1", "mpl", "1 1"), ("mpl-2", "mpl", "2 0"), ("epl-1", "epl", "1 0"), ("epl-2", "epl", "2 0"),
    ("cddl-1", "cddl", "1 0"), ("cddl-1.1", "cddl", "1 1"), ("eupl-1.1", "eupl", "1 1"), ("eupl-1.2", "eupl", "1 2"),
    ("bsl-1", "bsl", "1 0"), ("ofl-1.1", "ofl", "1 1"),
]
SIGNATURES += [
    (label, f"{name}{between}{version[0]}", 3, f"{name}{between}{version}(?! [0-9])")
    for label, name, version in SHORT_NAMES for between in (" ", "", " v", "v", " v ")
]
UNDER = "(?:licensed|released|distributed|available|published|provided|covered|redistribut\\w+) (?:\\w+ ){0,2}?(?:under|by) (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the )?"
#: Score of a detection by its priority: tag, notice with version, notice, title with version, title.
SCORES = [1.0, 0.95, 0.9, 0.8, 0.6]


def signature_rules() -> list[dict]:
    """All rules in order: keyword, pattern, level (0 is the highest priority) and label."""
    rules = [
        {"keyword": keyword, "pattern": f"(?<= )(?:{pattern})(?= )", "level": level, "label": label, "rule": at}
        for at, (label, keyword, level, pattern) in enumerate(SIGNATURES)
    ]
    for label, keywords, name, versions in FAMILIES:
        forms = [(2, f"{UNDER}(?:{name})", label), (4, name, label)]
        spdx = label.replace("-", " ")
        forms.append((0, f"spdx {LICENSE} identifier {spdx}", label))
        if label in OR_LATER:
            forms.append((2, f"redistribute (?:\\S+ )?and or modify (?:\\S+ )?under the terms of (?:the |version [0-9] of the )?(?:{name})", label))
        for version in versions:
            # The version stands apart, or is glued to a short name.
            short = "" if LICENSE in name else "?"
            number = f"(?: {LICENSE})? {short}(?:version |v ?)?{version}(?: 0)?(?! [0-9])"
            own = f"{label}-{version.replace(' ', '.')}"
            later = " (?:or|and) (?:at your option )?(?:any )?(?:later|newer|above|higher)(?: versions?)?"
            published = f"(?:{name}) as published by the free software foundation (?:either )?version {version}(?: 0)?(?: of the {LICENSE})?"
            if label in OR_LATER:
                forms += [
                    (0, f"spdx {LICENSE} identifier {spdx} {version}(?: 0)? or later", f"{own}-or-later"),
                    (1, f"{UNDER}(?:{name}){number}{later}", f"{own}-or-later"),
                    (1, f"{published}{later}", f"{own}-or-later"),
                    (3, f"(?:{name}){number}{later}", f"{own}-or-later"),
                    (1, published, own),
                ]
                later = " only"
            forms += [
                (0, f"spdx {LICENSE} identifier {spdx} {version}(?: 0)?(?: only| or later)?", own),
                (1, f"{UNDER}(?:{name}){number}(?:{later})?", own),
                (3, f"(?:{name}){number}(?:{later})?", own),
            ]
        for level, pattern, own in forms:
            for keyword in ["identifier"] if level == 0 else keywords.split("|"):
                rules.append({"keyword": keyword, "pattern": f"(?<= )(?:{pattern})(?= )", "level": level, "label": own, "rule": len(rules)})
    return rules


#: Every rule and every stated phrase needs one of these letters, or of these words at the start of a word, with separators between.
GATES = ("licen", "gpl", "cc0")
WORD_GATES = ("creative commons", "public domain", "cc by", "do what the", *sorted({k for _, k, _, pattern in SIGNATURES if "licen" not in pattern}))
_RULE = "array<struct<keyword:string,pattern:string,level:int,label:string,rule:int>>"
_FOUND = "array<struct<start:int,end:int,level:int,rule:int,label:string>>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """The result for a value that is computed once."""
    return F.transform(F.array(value), result)[0]


def _places(text: Column, rule: Column) -> Column:
    """Intervals of words, ends exclusive, in which a rule matches."""
    marked = F.regexp_replace(text, rule["pattern"], F.lit("\x01$0\x02"))
    return _let(F.split(marked, "\x01"), lambda pieces: _intervals(pieces, rule))


def _intervals(marked: Column, rule: Column) -> Column:
    first = F.struct(_spaces(marked[0]).alias("at"), F.array().cast(_FOUND).alias("found"))

    def add(done: Column, piece: Column) -> Column:
        start = done["at"] - 1
        end = start + _spaces(F.substring_index(piece, "\x02", 1)) + 1
        place = F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), rule["level"].alias("level"),
            rule["rule"].alias("rule"), rule["label"].alias("label"),
        )
        return F.struct((done["at"] + _spaces(piece)).alias("at"), F.concat(done["found"], F.array(place)).alias("found"))

    return F.aggregate(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), first, add, lambda done: done["found"])


def _unsuppressed(found: Column) -> Column:
    """Detections that no interval of the same or a higher priority contains."""
    widest = F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("wide"), x["level"].alias("level"), x["rule"].alias("rule"), x["label"].alias("label"))
    )
    ordered = F.sort_array(widest)
    # reach[p]: the furthest end so far of detections whose priority is p or higher.
    first = F.struct(F.array_repeat(F.lit(-1), len(SCORES)).alias("reach"), F.array().cast(_FOUND).alias("kept"))

    def add(done: Column, x: Column) -> Column:
        end = -x["wide"]
        reach = F.transform(done["reach"], lambda e, p: F.when(p >= x["level"], F.greatest(e, end)).otherwise(e))
        own = F.struct(x["start"].alias("start"), end.alias("end"), x["level"].alias("level"), x["rule"].alias("rule"), x["label"].alias("label"))
        inside = F.get(done["reach"], x["level"]) >= end
        return F.struct(reach.alias("reach"), F.when(inside, done["kept"]).otherwise(F.concat(done["kept"], F.array(own))).alias("kept"))

    return F.aggregate(ordered, first, add, lambda done: done["kept"])


def _scanned(text: Column) -> Column:
    """n_base, first_word, last_word, base labels and detections of one text of words."""
    rules = F.from_json(F.lit(json.dumps(signature_rules())), _RULE)
    keywords = F.array(*(F.lit(k) for k in sorted({r["keyword"] for r in signature_rules()})))
    stated = f"(?<= )(?:{'|'.join(PHRASES)})(?= )"
    base = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items())))
    some = F.size(base) > 0
    present = F.filter(keywords, lambda k: F.contains(text, F.concat(F.lit(" "), k)))
    chosen = _let(present, lambda some: F.filter(rules, lambda r: F.array_contains(some, r["keyword"])))
    found = F.flatten(F.transform(chosen, lambda r: _places(text, r)))
    return F.struct(
        F.regexp_count(text, F.lit(stated)).cast("bigint").alias("n_base"),
        F.when(some, _spaces(F.split(text, stated, 2)[0]) - 1).cast("bigint").alias("first_word"),
        F.when(some, _spaces(F.regexp_replace(text, f"(?s)^(.*){stated}.*$", "$1")) - 1).cast("bigint").alias("last_word"),
        F.array_sort(base).alias("base"),
        _unsuppressed(found).alias("detections"),
    )


def scan_licenses(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels) and detections (kept intervals of words)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for letters in GATES:
        gate = gate | F.contains(low, F.lit(letters))
    # A look at the letter first, so that most words are left after one test.
    starts = "".join(sorted({words[0] for words in WORD_GATES}))
    some_words = "|".join(words.replace(" ", f"[{SEPARATORS}]+") for words in WORD_GATES)
    gate = gate | low.rlike(f"(?:^|[{SEPARATORS}])(?=[{starts}])(?:{some_words})")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[{SEPARATORS}]+", " ")), F.lit(" "))
    scanned = F.when(gate, _let(words, _scanned))
    rows = documents.select(
        F.col(id_column).alias("doc_id"), F.regexp_count(text, F.lit(f"[^{RAW_SEPARATORS}]+")).cast("bigint").alias("n_words"), scanned.alias("found")
    )
    return rows.select(
        "doc_id", "n_words", F.coalesce("found.n_base", F.lit(0).cast("bigint")).alias("n_base"), "found.first_word", "found.last_word",
        F.coalesce("found.base", F.array().cast("array<string>")).alias("base"),
        F.coalesce("found.detections", F.array().cast(_FOUND)).alias("detections"),
    )


def labelled(documents: DataFrame) -> DataFrame:
    found = scan_licenses(documents)
    labels = F.array_union("base", F.transform("detections", lambda x: x["label"]))
    scores = F.transform("detections", lambda x: F.get(F.array(*map(F.lit, SCORES)), x["level"]))
    score = F.greatest(F.coalesce(F.array_max(scores), F.lit(0.0)), F.when(F.size("base") > 0, SCORES[-1]).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(labels))).alias("labels"), score.alias("score"),
    )


QUERIES = {"op3_license_scan": Query(lambda spark, sf: labelled(table(spark, sf, "documents")))}
