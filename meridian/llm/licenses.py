"""License detection by ordered signature rules, as DataFrame expressions only.

A text is reduced to its words. Every rule has a keyword: only texts that contain one of a few stems
are looked at further, and there only the rules whose keyword occurs run their regular expression.
Each match is an interval of words with its rule's priority. An interval inside another of higher
priority (or of the same, and longer) is suppressed; base phrases always stay. What survives gives
the labels and a confidence.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Contract phrases, found wherever their words stand consecutively.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_V = r"(?:v(?:ersion)? ?)?"
_LATER = r"(?: or (?:\(?at your option\)? )?any later version| or later| plus)?"

#: (label, identifier words, name, keyword): hand-written signatures on lower-case words with single blanks.
SIGNATURES = [
    ("gpl-1.0", r"gpl 1(?: 0)?(?: only| or later)?", rf"gnu general public license {_V}1(?: 0)?{_LATER}", "gnu general public"),
    ("gpl-2.0", r"gpl v?2(?: 0)?(?: only| or later)?", rf"gnu general public license {_V}2(?: 0)?{_LATER}", "gnu general public"),
    ("gpl-3.0", r"gpl v?3(?: 0)?(?: only| or later)?", rf"gnu general public license {_V}3(?: 0)?{_LATER}", "gnu general public"),
    ("lgpl-2.0", r"lgpl v?2(?: 0)?(?: only| or later)?", rf"gnu library general public license(?: {_V}2(?: 0)?)?{_LATER}", "gnu library"),
    ("lgpl-2.1", r"lgpl v?2 1(?: only| or later)?", rf"gnu lesser general public license {_V}2 1{_LATER}", "gnu lesser"),
    ("lgpl-3.0", r"lgpl v?3(?: 0)?(?: only| or later)?", rf"gnu lesser general public license {_V}3(?: 0)?{_LATER}", "gnu lesser"),
    ("agpl-3.0", r"agpl v?3(?: 0)?(?: only| or later)?", rf"(?:gnu )?affero general public license(?: {_V}3(?: 0)?)?{_LATER}", "affero general"),
    ("gfdl-1.3", r"gfdl(?: 1 [1-3])?", rf"gnu free documentation license(?: {_V}1 [1-3])?{_LATER}", "gnu free documentation"),
    ("apache-1.1", r"apache 1 1", rf"apache(?: software)? license {_V}1 1", "apache"),
    ("apache-2.0", r"apache 2(?: 0)?", rf"apache(?: software)? license {_V}2(?: 0)?", "apache"),
    ("mit", r"mit", r"(?:the )?mit license(?: mit)?", "mit license"),
    ("mit-0", r"mit 0", r"mit no attribution(?: license)?", "mit no attribution"),
    ("x11", r"x11", r"x11 license", "x11 license"),
    ("expat", r"expat", r"expat license", "expat license"),
    ("bsd-2-clause", r"bsd 2 clause", r"(?:(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause (?:simplified )?license)", "bsd"),
    ("bsd-3-clause", r"bsd 3 clause", r"(?:(?:the )?(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause (?:new |revised )*license)", "bsd"),
    ("bsd-4-clause", r"bsd 4 clause", r"(?:(?:the )?(?:original|4 clause|four clause) bsd license|bsd 4 clause (?:original )?license)", "bsd"),
    ("0bsd", r"0bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", "zero clause"),
    ("bsd", r"bsd", r"bsd(?: style)? license", "bsd"),
    ("isc", r"isc", r"isc license", "isc license"),
    ("zlib", r"zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng(?: 2 0)?", r"libpng license(?: version 2)?", "libpng"),
    ("boost-1.0", r"bsl 1 0", rf"boost software license(?: {_V}1 0)?", "boost software"),
    ("busl-1.1", r"busl 1 1", rf"business source license(?: {_V}1 1)?", "business source"),
    ("mpl-1.1", r"mpl 1 1", rf"mozilla public license {_V}1 1", "mozilla public"),
    ("mpl-2.0", r"mpl 2(?: 0)?", rf"mozilla public license {_V}2(?: 0)?", "mozilla public"),
    ("epl-1.0", r"epl 1 0", rf"eclipse public license {_V}1 0", "eclipse public"),
    ("epl-2.0", r"epl 2 0", rf"eclipse public license {_V}2 0", "eclipse public"),
    ("edl-1.0", r"edl 1 0", rf"eclipse distribution license(?: {_V}1 0)?", "eclipse distribution"),
    ("cddl-1.0", r"cddl 1 0", rf"common development and distribution license(?: {_V}1 0)?", "common development"),
    ("cddl-1.1", r"cddl 1 1", rf"common development and distribution license {_V}1 1", "common development"),
    ("cpl-1.0", r"cpl 1 0", rf"common public license(?: {_V}1 0)?", "common public license"),
    ("ipl-1.0", r"ipl 1 0", rf"ibm public license(?: {_V}1 0)?", "ibm public"),
    ("apsl-2.0", r"apsl 2 0", rf"apple public source license(?: {_V}2 0)?", "apple public"),
    ("ms-pl", r"ms pl", r"microsoft public license", "microsoft public"),
    ("ms-rl", r"ms rl", r"microsoft reciprocal license", "microsoft reciprocal"),
    ("artistic-1.0", r"artistic 1 0", rf"artistic license {_V}1(?: 0)?", "artistic license"),
    ("artistic-2.0", r"artistic 2 0", rf"artistic license {_V}2(?: 0)?", "artistic license"),
    ("afl-3.0", r"afl 3 0", rf"academic free license(?: {_V}3 0)?", "academic free"),
    ("osl-3.0", r"osl 3 0", rf"open software license(?: {_V}3 0)?", "open software license"),
    ("eupl-1.1", r"eupl 1 1", rf"european union public licen[cs]e {_V}1 1", "european union public"),
    ("eupl-1.2", r"eupl 1 2", rf"european union public licen[cs]e(?: {_V}1 2)?", "european union public"),
    ("cecill-2.1", r"cecill(?: [bc])?(?: 2 1)?", r"cecill(?: [bc])? (?:free software )?license(?: agreement)?", "cecill"),
    ("wtfpl", r"wtfpl", r"do what the fuck you want to public license", "what the fuck"),
    ("unlicense", r"unlicense", r"(?:the )?unlicense(?: license)?", "unlicense"),
    ("public-domain", r"licenseref public domain", r"(?:dedicated to|released into|placed in(?:to)?|in) the public domain", "public domain"),
    ("cc0-1.0", r"cc0(?: 1 0)?", r"(?:cc0 1 0 universal|cc0 public domain dedication)(?: v?1 0)?(?: universal)?", "cc0"),
    ("cc-by-1.0", r"cc by 1 0", r"creative commons attribution 1 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-2.0", r"cc by 2 0", r"creative commons attribution 2 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-3.0", r"cc by 3 0", r"creative commons attribution 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-4.0", r"cc by 4 0", r"creative commons attribution 4 0(?: international)?(?: (?:public )?license)?", "creative commons"),
    ("cc-by-sa-2.0", r"cc by sa 2 0", r"creative commons attribution share ?alike 2 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-sa-3.0", r"cc by sa 3 0", r"creative commons attribution share ?alike 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-sa-4.0", r"cc by sa 4 0", r"creative commons attribution share ?alike 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-2.0", r"cc by nc 2 0", r"creative commons attribution non ?commercial 2 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-nc-3.0", r"cc by nc 3 0", r"creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-nc-4.0", r"cc by nc 4 0", r"creative commons attribution non ?commercial 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nd-3.0", r"cc by nd 3 0", r"creative commons attribution no ?deriv(?:ative)?s 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-nd-4.0", r"cc by nd 4 0", r"creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-sa-3.0", r"cc by nc sa 3 0", r"creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-nc-sa-4.0", r"cc by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-nd-3.0", r"cc by nc nd 3 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-nc-nd-4.0", r"cc by nc nd 4 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?", "creative commons"),
    ("odbl-1.0", r"odbl 1 0", rf"open (?:data commons open )?database license(?: {_V}1 0)?", "database license"),
    ("odc-by-1.0", r"odc by 1 0", rf"open data commons attribution license(?: {_V}1 0)?", "open data commons"),
    ("pddl-1.0", r"pddl 1 0", r"public domain dedication and license", "public domain dedication"),
    ("ogl-uk-3.0", r"ogl uk 3 0", rf"open government licen[cs]e(?: {_V}[1-3](?: 0)?)?", "open government"),
    ("ofl-1.1", r"ofl 1 1", rf"(?:sil )?open font license(?: {_V}1 1)?", "open font"),
    ("python-2.0", r"(?:python|psf) 2 0", r"(?:python software foundation|psf) license(?: agreement)?(?: version 2)?", "license"),
    ("php-3.01", r"php 3 01", rf"php license(?: {_V}3 01?)?", "php license"),
    ("ruby", r"ruby", r"ruby license", "ruby license"),
    ("openssl", r"openssl", r"openssl license", "openssl license"),
    ("postgresql", r"postgresql", r"postgresql license", "postgresql license"),
    ("ncsa", r"ncsa", r"university of illinois ncsa open source license", "university of illinois"),
    ("vim", r"vim", r"vim license", "vim license"),
    ("w3c", r"w3c", r"w3c software (?:notice and )?license", "w3c software"),
    ("curl", r"curl", r"curl license", "curl license"),
    ("json", r"json", r"json license", "json license"),
    ("upl-1.0", r"upl 1 0", r"universal permissive license(?: v(?:ersion)? ?1 0)?", "universal permissive"),
    ("sspl-1.0", r"sspl(?: 1 0)?", r"server side public license(?: v(?:ersion)? ?1)?", "server side public"),
    ("elastic-2.0", r"elastic 2 0", r"elastic license(?: v(?:ersion)? ?2(?: 0)?)?", "elastic license"),
    ("openrail-m", r"(?:bigscience )?openrail m", r"(?:creativeml )?open ?rail m? ?license", "rail"),
    ("all-rights-reserved", r"licenseref proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"licenseref commercial", r"proprietary and confidential|proprietary license", "proprietary"),
    ("gpl", r"gpl", r"(?:gnu )?general public license", "general public"),
    ("lgpl", r"lgpl", r"(?:gnu )?lesser general public license", "lesser general"),
    ("apache", r"apache", r"apache(?: software)? license", "apache"),
    ("cc", r"cc", r"creative commons(?: attribution)?(?: public)? license", "creative commons"),
]

#: Further names of the labels above (label, name, keyword): a rule's keyword stands in everything that its pattern matches.
OTHER_NAMES = [
    ("cc0-1.0", r"creative commons zero(?: v?1 0)?(?: universal)?", "creative commons zero"),
    ("json", r"shall be used for good not evil", "good not evil"),
    ("openrail-m", r"responsible ai license", "responsible ai"),
    ("gpl", r"gnu gpl", "gnu gpl"),
]

#: Sentences of the license texts themselves (label, words, keyword).
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", "permission is hereby granted"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "except in compliance"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "this library is free software"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "verbatim or modified copies"),
    ("cc0-1.0", r"to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights", "associated cc0"),
    ("epl-2.0", r"the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "open font"),
]

_GRANT = r"(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|governed|covered|shared) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
_GRANT_UNDER = _GRANT.replace("(?:under|by)", "under")
_SHORT = {"mit", "x11", "expat", "isc", "zlib", "bsd", "ruby", "vim", "curl", "json", "php", "cc", "apache", "w3c", "gpl", "lgpl", "openssl", "postgresql", "ncsa", "python-2.0"}


class Rule(NamedTuple):
    label: str
    keyword: str
    also: str  # a second keyword, or empty
    pattern: str
    priority: int
    weight: float
    base: bool


def rules() -> list[Rule]:
    """From each signature: the identifier tag, the grant by name, the grant by identifier, the name, the identifier (unless an ordinary word); for further names the two by name; the sentences of license texts."""
    out = [Rule(label, f" {phrase} ", "", phrase, 1, 0.9, True) for phrase, label in BASE.items()]
    for label, ident, name, keyword in SIGNATURES:
        stem = ident.split("(")[0].split("?")[0].strip()
        stem = f" {stem.split(' ')[0]}" if "v" in stem else f" {stem}"
        out.append(Rule(label, "spdx license identifier", "", f"spdx license identifier (?:{ident})", 5, 0.99, False))
        out.append(Rule(label, keyword, "", f"{_GRANT}(?:{name})", 4, 0.97, False))
        out.append(Rule(label, " under ", stem, f"{_GRANT_UNDER}(?:{ident})(?: (?:international|unported|generic|universal))?(?: licen[sc]e)?", 3, 0.95, False))
        out.append(Rule(label, keyword, "", f"(?:{name})", 2, 0.9, False))
        if label not in _SHORT and ident[0] != "(":
            out.append(Rule(label, stem, "", f"(?:{ident})", 1, 0.6, False))
    for label, name, keyword in OTHER_NAMES:
        out.append(Rule(label, keyword, "", f"{_GRANT}(?:{name})", 4, 0.97, False))
        out.append(Rule(label, keyword, "", f"(?:{name})", 2, 0.9, False))
    return out + [Rule(label, keyword, "", words, 5, 0.98, False) for label, words, keyword in TEXTS]


def stems(every: list[Rule]) -> list[str]:
    """The keywords that contain no other: a text without any of them has no match."""
    keywords = {r.keyword for r in every}
    return sorted(k for k in keywords if not any(o != k and o in k for o in keywords))


def words_line(text: Column) -> Column:
    """The text's words, A-Z lower-cased, each between single blanks: ``' a b '``; a single blank where there is none."""
    flat = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), flat, F.lit(" ")), "^ +| +$", " ")


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(line: Column, rule: Column) -> Column:
    """Matches of one rule as intervals of words, from the pieces between matches."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(line, pattern, F.lit(0))
    between = F.split(line, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("seen"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + _blanks(pair["b"]) - 1
        last = first + _blanks(pair["m"])
        return F.struct((last + 1).alias("at"), F.concat(state["seen"], F.array(F.struct(first.cast("long").alias("first"), last.cast("long").alias("last")))).alias("seen"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    intervals = F.aggregate(pairs, start, step)["seen"]
    return F.transform(
        intervals,
        lambda i: F.struct(i["first"].alias("first"), (-i["last"]).alias("minus_last"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base")),
    )


_HIT = "array<struct<first:bigint,minus_last:bigint,minus_priority:int,label:string,weight:double,base:boolean>>"


def _survivors(hits: Column) -> Column:
    """Intervals not inside an earlier one of at least their priority. Sorted: by start, longest first, highest priority first."""
    state = F.struct(F.array(*[F.lit(-1).cast("long")] * 6).alias("reach"), F.array().cast(_HIT).alias("kept"))

    def step(s: Column, h: Column) -> Column:
        inside = F.exists(F.slice(s["reach"], -h["minus_priority"] + 1, 6), lambda r: r >= -h["minus_last"])
        reach = F.transform(s["reach"], lambda r, i: F.when((i == -h["minus_priority"]) & ~h["base"], F.greatest(r, -h["minus_last"])).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(inside & ~h["base"], s["kept"]).otherwise(F.concat(s["kept"], F.array(h))).alias("kept"))

    return F.aggregate(F.array_sort(hits), state, step)["kept"]


def _joined(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, hits (all matches), kept (after suppression).

    Null texts count as empty; a text without words has none. Repeated rows are each answered. An
    empty table gives an empty result; other columns are not read.
    """
    every = rules() if rule_list is None else rule_list
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.also).alias("also"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base")) for r in every])
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_line(docs[text_col]).alias("line"))
    line = F.col("line")
    gate = F.lit(False)
    for stem in stems(every):
        gate = gate | F.contains(line, F.lit(stem))
    # each keyword is looked for once, however many rules share it
    wanted = F.array(*[F.lit(k) for k in sorted({x for r in every for x in (r.keyword, r.also)})])
    present = F.filter(wanted, lambda k: F.contains(line, k))
    chosen = F.filter(table, lambda r: F.array_contains(F.col("present"), r["keyword"]) & F.array_contains(F.col("present"), r["also"]))
    hits = F.flatten(F.transform(chosen, lambda r: _places(line, r)))
    lines = lines.withColumn("present", F.when(gate, present))
    found = lines.select("doc_id", (_blanks(line) - 1).cast("long").alias("n_words"), F.when(F.col("present").isNotNull(), hits).otherwise(F.array().cast(_HIT)).alias("hits"))
    return found.select("doc_id", "n_words", "hits", F.when(F.size("hits") > 0, _survivors(F.col("hits"))).otherwise(F.col("hits")).alias("kept"))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see :func:`detect`.

    No base phrase: first_word and last_word are null. No label: an empty string and score 0.
    """
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["first"])
    doubt = F.aggregate("kept", F.lit(1.0), lambda p, h: p * (1 - h["weight"]))
    return detect(docs, id_col, text_col).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.col("kept")).alias("labels"), (1 - doubt).alias("score"),
    )
