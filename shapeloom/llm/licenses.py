"""License detection with ordered signature rules, in DataFrame functions only.

A rule is a regex with a label, a keyword and a priority. A text is normalised to its words, one space apart; the keywords
that it has decide which rules run on it, and most texts have none. Of overlapping detections one that lies inside a
detection of the same or a higher priority is suppressed. The base labels, which have places of their own, always stay.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that are no part of a word, once A-Z are lower case; and before that.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are always reported, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families: label, the regex of the name in normalised words, keywords one of which the name has, and the versions it comes in.
FAMILIES = (
    ("gpl", "(?:gnu )?(?:gpl|general public licen[sc]e)", "gpl|general public", "1|2|3|2 0|3 0"),
    ("lgpl", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e|library general public licen[sc]e)", "lgpl|lesser general|library general", "2|2 1|3|3 0"),
    ("agpl", "(?:gnu )?(?:agpl|affero general public licen[sc]e)", "agpl|affero", "1|3|3 0"),
    ("gfdl", "(?:gnu )?(?:gfdl|free documentation licen[sc]e)", "gfdl|free documentation", "1 1|1 2|1 3"),
    ("apache", "apache(?: software)? licen[sc]e", "apache", "1 0|1 1|2|2 0"),
    ("mpl", "(?:mpl|mozilla public licen[sc]e)", "mpl|mozilla", "1 0|1 1|2 0"),
    ("epl", "(?:epl|eclipse public licen[sc]e)", "epl|eclipse", "1 0|2 0"),
    ("eupl", "(?:eupl|european union public licen[sc]e)", "eupl|european union", "1 1|1 2"),
    ("cddl", "(?:cddl|common development and distribution licen[sc]e)", "cddl|common development", "1 0|1 1"),
    ("cpl", "(?:ibm )?common public licen[sc]e", "common public", "1 0"),
    ("artistic", "(?:perl )?artistic licen[sc]e", "artistic", "1 0|2 0"),
    ("bsl", "boost software licen[sc]e", "boost", "1 0"),
    ("osl", "open software licen[sc]e", "open software", "1 0|2 0|2 1|3 0"),
    ("afl", "academic free licen[sc]e", "academic free", "1 1|1 2|2 0|2 1|3 0"),
    ("ofl", "(?:sil )?open font licen[sc]e", "open font", "1 0|1 1"),
    ("odbl", "open database licen[sc]e", "open database", "1 0"),
    ("psf", "(?:python software foundation|psf) licen[sc]e", "python|psf", "2|2 0"),
    ("php", "php licen[sc]e", "php", "3 0|3 01"),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft", ""),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft", ""),
    ("mit", "(?:mit|expat|x11) licen[sc]e", "mit licen|expat|x11", ""),
    ("isc", "isc licen[sc]e", "isc licen", ""),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", ""),
    ("bsd", "(?:(?:new|modified|simplified|revised|original) )?bsd(?: style)? licen[sc]e", "bsd", ""),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd)", "bsd", ""),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd)", "bsd", ""),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd)", "bsd", ""),
    ("unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", ""),
    ("cc0", "(?:cc0|creative commons zero)", "cc0|creative commons", "1 0"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s?)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s?)", "cc by|cc attribution|creative commons", "1 0|2 0|2 5|3 0|4 0"),
    ("public-domain", "(?:in|into) the public domain", "public domain", ""),
    ("proprietary", "all rights reserved", "all rights reserved", ""),
)
#: SPDX identifiers without their versions: label, the identifier in normalised words, its versions.
SPDX = (
    *[(n, n, v) for n, v in (("gpl", "1 0|2 0|3 0"), ("lgpl", "2 0|2 1|3 0"), ("agpl", "1 0|3 0"), ("gfdl", "1 1|1 2|1 3"), ("apache", "1 0|1 1|2 0"), ("mpl", "1 0|1 1|2 0"))],
    *[(n, n, v) for n, v in (("epl", "1 0|2 0"), ("eupl", "1 0|1 1|1 2"), ("cddl", "1 0|1 1"), ("cpl", "1 0"), ("artistic", "1 0|2 0"), ("bsl", "1 0"), ("osl", "1 0|2 0|2 1|3 0"))],
    *[(n, n, v) for n, v in (("afl", "1 1|1 2|2 0|2 1|3 0"), ("ofl", "1 0|1 1"), ("odbl", "1 0"), ("psf", "2 0"), ("php", "3 0|3 01"), ("cc0", "1 0"))],
    *[(n, n.replace("-", " "), "1 0|2 0|2 5|3 0|4 0") for n in ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")],
    *[(n, n.replace("-", " "), "") for n in ("mit", "mit-0", "isc", "zlib", "x11", "0bsd", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "unlicense", "wtfpl", "ms-pl", "ms-rl")],
)
#: Names that mean a license only after "licensed under" and the like: label, regex, keywords.
SHORT = (
    ("mit", "(?:mit|expat)", " mit | expat "),
    ("x11", "x11", " x11 "),
    ("isc", "isc", " isc "),
    ("zlib", "zlib", " zlib "),
    ("bsd", "bsd", " bsd "),
    ("apache", "apache", " apache "),
    ("apache-2.0", "apache (?:v ?|version )?2(?: 0)?", " apache "),
    ("artistic-2.0", "artistic (?:v ?|version )?2(?: 0)?", " artistic "),
    ("ofl-1.1", "(?:sil )?ofl(?: (?:v ?|version )?1 1)?", " ofl "),
    ("bsl-1.0", "(?:boost|bsl)(?: (?:v ?|version )?1 0)?", " boost | bsl "),
    ("odbl-1.0", "odbl(?: (?:v ?|version )?1 0)?", " odbl "),
    ("php", "php", " php "),
    ("psf", "psf", " psf "),
    ("ms-pl", "ms pl", " ms pl "),
    ("ms-rl", "ms rl", " ms rl "),
)
_UNDER = "(?:licen[sc]ed|(?:re)?distributed|released|available|provided) under (?:the )?(?:terms of )?(?:the )?"
#: Sentences of the licenses themselves: label, regex, a part of every match that is keyword and gate.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted free of charge"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms(?: of [^ ]+)? with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions", "must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|the|other|their)(?: [^ ]+){0,3}? ?contributors may be used to endorse or promote products", "be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ments?", "advertising materials mentioning features"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy", "except in compliance with the license"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants to you"),
    ("gpl", "(?:this program|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "distributed in the hope that it will be useful"),
    ("gpl", "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change (?:it|the works) by contrast the gnu general public license is intended", "designed to take away your freedom"),
    ("lgpl", "this library is free software you can redistribute it and or modify", "free software you can redistribute it"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty", "distributed in the hope that it will be useful"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty in no event"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "associated a work with this deed"),
)
#: Signs whose absence ends the work on a text: every rule's match has one of them.
GATES = ("licen", "spdx", "public domain", "all rights reserved", "cc by", "cc attribution", "cc0", "creative commons", "wtfpl", "bsd", "gpl", "gfdl", "mpl", "epl", "eupl", "cddl") + (
    "distributed under", "released under", "available under", "provided under", *sorted({part for _, _, part in BODIES})
)
#: A plain search for the rarest word of each gate comes first: it is far cheaper than the gates' own regex.
GATE_WORDS = sorted({max(g.split(), key=len) for g in GATES})
#: Templates of a family's rules: a keyword besides the family's own, regex around the name N, priority.
TEMPLATES = (
    ("spdx", "spdx licen[sc]e identifier N", 4),
    ("under", "licen[sc]ed under (?:the )?(?:terms of )?(?:the )?N", 3),
    ("under", "(?:re)?distributed under (?:the )?(?:terms of )?(?:the )?N", 3),
    ("under", "released under (?:the )?(?:terms of )?(?:the )?N", 3),
    ("", "(?:the )?N", 1),
)
#: And of its versions' rules, with a V for the version.
VERSIONED = (("", "N (?:v|version )?V(?: or (?:any )?later)?", 2), ("under", "under (?:the )?(?:terms of )?(?:the )?N (?:v|version )?V(?: or (?:any )?later)?", 4))
LEVELS = 4


def rules() -> list[dict]:
    """Label, keywords (one must be there, and `also`), regex and priority of every rule, in order.

    Each family with each template, then each of its versions; SPDX identifiers, as the first to fourth of an expression and
    weaker by place, so that none hides another; short names; sentences of the licenses.
    """
    made = []

    def add(label: str, keywords: str, also: str, regex: str, priority: int) -> None:
        made.append({"label": label, "keywords": keywords.split("|"), "also": also, "regex": f"(?<= )(?:{regex})(?= )", "priority": priority})

    for label, name, own, versions in FAMILIES:
        for keyword, around, priority in TEMPLATES:
            add(label, own, keyword, around.replace("N", name), priority)
        for v in filter(None, versions.split("|")):
            for keyword, around, priority in VERSIONED:
                add(f"{label}-{v.replace(' ', '.')}", own, keyword, around.replace("N", name).replace("V", v), priority)
    operand = "(?:(?!(?:or|and) (?!later ))[^ ]+ ){1,8}(?:or|and) (?!later )"
    for label, name, versions in SPDX:
        for v in versions.split("|"):
            own = f"{name} {v}".strip()
            for place in range(LEVELS):
                regex = f"spdx licen[sc]e identifier {operand * place}{own}(?: only| or later)?"
                add(f"{label}-{v.replace(' ', '.')}" if v else label, f" {own} ", "spdx licen", regex, LEVELS - place)
    for label, regex, keywords in SHORT:
        add(label, keywords, " under ", _UNDER + regex, 3)
    for label, regex, part in BODIES:
        add(label, part, "", regex, 3)
    return made


_RULE = "array<struct<label:string,keywords:array<string>,also:string,regex:string,priority:int>>"
_FOUND = "array<struct<s:int,e:int>>"


def _places(text: Column, regex: Column) -> Column:
    """(s, e) in characters of all matches of regex in text. A match's borders are looked at, not taken, so neighbours count."""
    gaps, found = F.split(text, regex), F.regexp_extract_all(text, regex, F.lit(0))
    # Before the i-th match lie the first i + 1 gaps and the first i matches.
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))
    return F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["m"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["m"]).alias("e")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _word_before(text: Column, at: Column) -> Column:
    """Index of the word that begins at a character place of text, which begins with a space."""
    head = F.substring(text, F.lit(1), at)
    return (F.length(head) - F.length(F.translate(head, " ", "")) - 1).cast("long")


def _surviving(found: Column) -> Column:
    """Detections in order, without those inside an earlier one of the same or a higher priority.

    Sorted by start, then the longest and strongest first; `reach` has for each priority the farthest end of the detections
    with it or a higher one so far.
    """
    kind = "array<struct<label:string,priority:int>>"
    start = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("reach"), F.array().cast(kind).alias("out"))
    return F.aggregate(
        found,
        start,
        lambda a, x: F.struct(
            F.transform(a["reach"], lambda r, i: F.when(i < x["priority"], F.greatest(r, x["e"])).otherwise(r)).alias("reach"),
            F.when(F.get(a["reach"], x["priority"] - 1) >= x["e"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(x["label"], x["priority"])))).alias("out"),
        ),
        lambda a: a["out"],
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text).

    Null text is empty; labels of a text without any are the empty string, and its score is 0. The score is the highest
    priority found, of LEVELS, a base phrase counting as 3. Rows that repeat each get a row; extra columns are ignored.
    """
    made = rules()
    keywords = sorted({k for r in made for k in r["keywords"]})
    table = F.from_json(F.lit(json.dumps(made)), _RULE)
    gate = "(?i)" + "|".join(g.replace(" ", _GAP_ANY_CASE) for g in GATES)
    text, lower = F.col("text"), F.lower("text")
    hint = functools.reduce(lambda a, b: a | b, [lower.contains(w) for w in GATE_WORDS])
    df = batches.documents(docs).select("doc_id", F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), F.when(hint & text.rlike(gate), text).alias("text"))
    # From here on the text of most rows is null, and so is what comes of it.
    df = df.select("doc_id", "n_words", F.concat(F.lit(" "), F.regexp_replace(F.translate(text, _UPPER, _LOWER), _GAP, " "), F.lit(" ")).alias("text"))
    df = df.withColumn("text", F.regexp_replace("text", "  +", " "))
    places = [_places(text, F.lit(f"(?<= ){phrase}(?= )")) for phrase, _ in BASE]
    df = df.select("*", *[F.when(text.contains(f" {phrase} "), p).alias(f"b{i}") for i, ((phrase, _), p) in enumerate(zip(BASE, places, strict=True))])
    df = df.withColumn("base", F.concat(*[F.coalesce(F.col(f"b{i}"), F.array().cast(_FOUND)) for i in range(len(BASE))]))
    df = df.withColumn("base_labels", F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))))
    df = df.withColumn("present", F.filter(F.array(*map(F.lit, keywords)), lambda k: text.contains(k)))
    chosen = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], F.col("present")) & text.contains(r["also"]))
    found = F.flatten(F.transform(chosen, lambda r: F.transform(_places(text, r["regex"]), lambda p: F.struct(p["s"], (-p["e"]).alias("back"), (-r["priority"]).alias("rank"), r["label"], p["e"], r["priority"]))))
    df = df.withColumn("found", F.when(text.isNotNull() & (F.size("present") > 0), F.array_sort(found)))
    df = df.withColumn("kept", _surviving(F.col("found")))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce(F.transform("kept", lambda x: x["label"]), F.array().cast("array<string>")))))
    best = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda x: x["priority"])), F.lit(0)), F.when(F.size("base") > 0, 3).otherwise(0))
    return df.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        _word_before(text, F.array_min(F.transform("base", lambda p: p["s"]))).alias("first_word"),
        _word_before(text, F.array_max(F.transform("base", lambda p: p["s"]))).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (best / LEVELS).alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
