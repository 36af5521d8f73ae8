"""License scans (operator 1): sentence-rule recognition.

A text is cut into paragraphs, and these into sentences; each is normalised, and known ones become identifiers. The lines of
a paragraph are read as ends of sentences and as wrapped; the reading that knows more sentences counts, the first if both
know as many. The sequence of a text's identifiers is then matched against licence rules in their order: a rule takes every
place where its sequence stands in what earlier rules have left. Everything happens inside the row; sentences and rules are
short fixed tables.

Defined results: a null or empty text has no sentence and no licence; every row is scanned by itself, so repeated rows
and equal or null ids need no care; other columns are not read, so their names do not matter; an empty table gives an empty
result. A very long text is scanned whole, within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and the identifiers they stand for.
SENTENCES = {
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind": "as_is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "licensed under the apache license version 2.0": "apache2_ref",
    "licensed under the apache license version 2.0 the license": "apache2_ref",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_no_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "licensed under cc by nc 4.0": "cc_by_nc_ref",
    "licensed under cc by 4.0": "cc_by_ref",
    "licensed under cc by sa 4.0": "cc_by_sa_ref",
    "all rights reserved": "all_rights",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "licensed under the bsd 2 clause license": "bsd2_ref",
    "licensed under the bsd 3 clause license": "bsd3_ref",
    "use of this source code is governed by a bsd style license that can be found in the license file": "bsd_style_ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_bsd_grant",
    "licensed under the isc license": "isc_ref",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "this notice may not be removed or altered from any source distribution": "zlib_notice",
    "this is free and unencumbered software released into the public domain": "unlicense_ref",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2_copy",
    "distributed under the boost software license version 1.0": "bsl_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0": "epl2_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0": "epl1_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions": "ofl_grant",
    "this font software is licensed under the sil open font license version 1.1": "ofl_ref",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu_verbatim",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0_deed",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0_waiver",
    "all rights reserved worldwide": "all_rights",
    "spdx license identifier mit": "mit_ref",
    "spdx license identifier apache 2.0": "apache2_ref",
}
#: Names and identifiers of licences of the same making, whose usual notices make more sentences by rule.
GNU = {"general": ("gpl", (1, 2, 3)), "lesser general": ("lgpl", (2.1, 3)), "affero general": ("agpl", (3,))}
CREATIVE_COMMONS = {
    "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives",
}
for _name, (_id, _versions) in GNU.items():
    for _v in _versions:
        _terms = f"it under the terms of the gnu {_name} public license as published by the free software foundation"
        _free = f"this {'library' if _v == 2.1 else 'program'} is free software you can redistribute it and or modify {_terms}"
        SENTENCES[f"{_free} either version {_v} of the license or at your option any later version"] = f"{_id}{_v}_later"
        SENTENCES[f"{_free} version {_v}"] = f"{_id}{_v}_ref"
        SENTENCES[f"licensed under the gnu {_name} public license version {_v}"] = f"{_id}{_v}_ref"
        SENTENCES[f"licensed under the gnu {_name} public license v{_v}"] = f"{_id}{_v}_ref"
        SENTENCES[f"this work is licensed under the gnu {_name} public license version {_v}"] = f"{_id}{_v}_ref"
        SENTENCES[f"spdx license identifier {_id} {float(_v)} or later"] = f"{_id}{_v}_later"
        SENTENCES[f"spdx license identifier {_id} {float(_v)} only"] = f"{_id}{_v}_ref"
    SENTENCES[f"see the gnu {_name} public license for more details"] = "gpl_see"
for _short, _long in CREATIVE_COMMONS.items():
    for _v in ("3.0", "4.0"):
        _id = f"cc_{_short.replace(' ', '_')}{'_ref' if _v == '4.0' else '_3_ref'}"
        SENTENCES[f"licensed under cc {_short} {_v}"] = _id
        SENTENCES[f"this work is licensed under a creative commons {_long} {_v} international license"] = _id
        SENTENCES[f"this work is licensed under cc {_short} {_v}"] = _id
for _name, _id in {
    "mit": "mit", "bsd 3 clause": "bsd3", "bsd 2 clause": "bsd2", "isc": "isc", "mpl 2.0": "mpl2", "bsl 1.0": "bsl", "epl 2.0": "epl2",
    "unlicense": "unlicense", "zlib": "zlib", "cc0 1.0": "cc0",
}.items():
    SENTENCES[f"spdx license identifier {_name}"] = f"{_id}_ref"
    SENTENCES[f"this project is licensed under the {_name} license"] = f"{_id}_ref"

#: Licence rules in the order in which they are tried, longer sequences before their parts.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_copy", "apache2_as_is"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply"]),
    *(
        (f"{i.upper()}-{float(v)}-or-later", [f"{i}{v}_later", *more])
        for i, versions in GNU.values()
        for v in versions
        for more in (["gpl_no_warranty", "gpl_see"], ["gpl_no_warranty"], [])
    ),
    *(
        (f"{i.upper()}-{float(v)}-only", [f"{i}{v}_ref", *more])
        for i, versions in GNU.values()
        for v in versions
        for more in (["gpl_no_warranty", "gpl_see"], [])
    ),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["zero_bsd_grant", "isc_as_is"]),
    ("0BSD", ["zero_bsd_grant"]),
    ("Zlib", ["zlib_as_is", "zlib_grant", "zlib_notice"]),
    ("Zlib", ["zlib_grant"]),
    ("Unlicense", ["unlicense_ref", "unlicense_grant"]),
    ("MPL-2.0", ["mpl2_ref", "mpl2_copy"]),
    ("OFL-1.1", ["ofl_ref", "ofl_grant"]),
    ("OFL-1.1", ["ofl_grant"]),
    ("MIT", ["mit_grant"]),
    ("Apache-2.0", ["apache2_comply", "apache2_copy"]),
    ("BSD-3-Clause", ["bsd_style_ref"]),
    *((f"CC-{k.upper().replace(' ', '-')}-4.0", [f"cc_{k.replace(' ', '_')}_ref"]) for k in CREATIVE_COMMONS),
    *((f"CC-{k.upper().replace(' ', '-')}-3.0", [f"cc_{k.replace(' ', '_')}_3_ref"]) for k in CREATIVE_COMMONS),
    *(
        (name, [f"{i}_ref"])
        for name, i in {
            "MIT": "mit", "Apache-2.0": "apache2", "BSD-3-Clause": "bsd3", "BSD-2-Clause": "bsd2", "ISC": "isc", "MPL-2.0": "mpl2",
            "BSL-1.0": "bsl", "EPL-2.0": "epl2", "EPL-1.0": "epl1", "Unlicense": "unlicense", "Zlib": "zlib", "OFL-1.1": "ofl",
            "CC0-1.0": "cc0",
        }.items()
    ),
    ("CC0-1.0", ["cc0_deed"]),
    ("CC0-1.0", ["cc0_waiver"]),
    ("LicenseRef-all-rights-reserved", ["all_rights"]),
]
#: Paragraphs end at empty lines. Sentences end at white space after a full stop or mark, at a line feed after a colon, and,
#: where lines are not wrapped, at each line feed.
PARAGRAPH_END = r"\r?\n[ \t]*\r?\n"
LINE_SENTENCE_END = r"[\r\n]+|(?<=[.!?])[ \t]+"
WRAPPED_SENTENCE_END = r"(?<=[.!?])[ \t\r\n]+|(?<=:)\r?\n"
#: Every sentence of the table above holds one of these; paragraphs without are not cut where that table is used.
MARKS = r"(?i)licen[sc]|software|permi|copyright|rights|redistribut|warrant|notice|public|\bmpl\b"


def normalised(sentence: Column) -> Column:
    """Lower case; runs of anything but a-z, 0-9 and the point become one space; no point or space at the ends."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.regexp_replace(plain, r"^[ .]+|[ .]+$", "")


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """For each row doc_id, sentence_ids (of known sentences, in their order), licences (found, without repeats, in
    alphabetical order) and unmatched_ids (those that no rule took); arrays of strings."""
    known = F.create_map(*(F.lit(x) for kv in (sentences or SENTENCES).items() for x in kv))
    rules = RULES if rules is None else rules

    def read(paragraph: Column, end: str) -> Column:
        of = F.transform(F.split(paragraph, end, -1), lambda x: F.element_at(known, normalised(x)))
        return F.filter(of, lambda x: x.isNotNull())

    def best(x: Column) -> Column:
        return F.when(F.size(x["wrapped"]) > F.size(x["lines"]), x["wrapped"]).otherwise(x["lines"])

    paragraphs = F.split(F.coalesce("text", F.lit("")), PARAGRAPH_END, -1)
    if sentences is None:
        paragraphs = F.filter(paragraphs, lambda p: p.rlike(MARKS))
    both = F.transform(
        paragraphs, lambda p: F.struct(read(p, LINE_SENTENCE_END).alias("lines"), read(p, WRAPPED_SENTENCE_END).alias("wrapped"))
    )
    out = docs.select("doc_id", both.alias("both")).select("doc_id", F.flatten(F.transform("both", best)).alias("sentence_ids"))
    # `;a;;b;` holds the sequence a, b where the text `;a;;b;` stands; a rule that took it leaves `||`, which parts
    # what stood before it from what stood after.
    left = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    out = out.withColumn("left0", left)
    found = []
    for i, (licence, sequence) in enumerate(rules):
        pattern = F.lit("".join(f";{s};" for s in sequence))
        out = out.withColumn(f"found{i}", F.when(F.contains(f"left{i}", pattern), F.lit(licence))).withColumn(
            f"left{i + 1}", F.replace(F.col(f"left{i}"), pattern, F.lit("||"))
        )
        found.append(F.col(f"found{i}"))
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    unmatched = F.filter(F.split(f"left{len(rules)}", "[;|]+", -1), lambda x: x != "")
    return out.select("doc_id", "sentence_ids", licences.alias("licences"), unmatched.alias("unmatched_ids"))
