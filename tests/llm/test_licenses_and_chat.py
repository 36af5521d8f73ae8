import re

from sedge.llm import chat, licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_scan(spark):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore",
        2: MIT,
        3: "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
        4: "See the GNU General Public License for more details.",
        5: None,
        6: "",
        7: "A licence of no kind. " * 2000,
        8: "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[1], "x")], "doc_id bigint, text string, lines string")
    got = {r.doc_id: (r.licences, r.unmatched_ids) for r in licenses.scan(df).collect()}
    assert got == {
        1: (["MIT"], []), 2: (["MIT"], []), 3: (["Apache-2.0"], []), 4: ([], ["gpl_see"]), 5: ([], []), 6: ([], []), 7: ([], []),
        8: (["CC-BY-NC-4.0", "MIT"], []), None: (["MIT"], []),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def scanned(spark, texts, *tables):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.licences for r in licenses.scan(df, *tables).orderBy("doc_id").collect()]


def test_both_readings_in_one_text(spark):
    gpl = "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 2 of the\nLicense, or (at your option) any later version."
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General").replace("version 2 ", "version 2.1 ")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    got = scanned(spark, [f"{MIT}\nLicensed under CC BY-NC-ND 4.0.\nmore", f"x\n\n{gpl}\n\nLicensed under CC BY 3.0", lgpl, mpl, "SPDX-License-Identifier: AGPL-3.0-or-later"])
    assert got == [["CC-BY-NC-ND-4.0", "MIT"], ["CC-BY-3.0", "GPL-2.0-or-later"], ["LGPL-2.1-or-later"], ["MPL-2.0"], ["AGPL-3.0-or-later"]]


def test_sentences_of_any_words(spark):
    assert scanned(spark, ["Free to use, by all.", "free"], {"free to use by all": "f"}, [("F", ["f"])]) == [["F"], []]


def test_tables_agree():
    """Every identifier that a rule asks for is one of a sentence, sentences are in normal form, and hold a mark."""
    ids = set(licenses.SENTENCES.values())
    assert {x for _, sequence in licenses.RULES for x in sequence} <= ids
    for x in licenses.SENTENCES:
        assert re.sub(r"[^a-z0-9.]+", " ", x.lower()).strip(" .") == x and re.search(licenses.MARKS, x), x
    assert len({name for name, _ in licenses.RULES}) > 30


def test_rules_are_tried_in_order(spark):
    df = spark.createDataFrame([(1, "license a\nlicense b\nlicense a")], "doc_id bigint, text string")
    known = {"license a": "a", "license b": "b"}
    (r,) = licenses.scan(df, known, [("AB", ["a", "b"]), ("A", ["a"])]).collect()
    assert (r.licences, r.sentence_ids, r.unmatched_ids) == (["A", "AB"], ["a", "b", "a"], [])
    (r,) = licenses.scan(df, known, [("A", ["a"]), ("AB", ["a", "b"])]).collect()
    assert (r.licences, r.unmatched_ids) == (["A"], ["b"])


def test_pairs(spark):
    rows = [
        (1, True, 0, "user", "q"), (1, True, 1, "assistant", "good"), (1, True, 2, "user", "more"),
        (1, False, 0, "user", "q"), (1, False, 1, "assistant", "bad"),
        (2, True, 0, "user", "q"), (2, False, 0, "user", "q"),
        (3, True, 0, None, None), (3, False, 0, None, None), (3, False, 1, "assistant", ""),
        (4, False, 5, "assistant", "b"), (4, False, 5, "assistant", "a"), (4, False, 5, "assistant", "a"),
        (None, True, 0, "user", "lost"), (5, None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "pair_id bigint, chosen boolean, turn bigint, role string, text string, n_common int")
    got = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    a = got[1]
    assert a.prompt == "<|user|>\nq<|end|>\n" and a.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n"
    assert [s.learn for s in a.chosen_segments] == [True, False] and "".join(s.text for s in a.rejected_segments) == a.rejected
    assert (got[2].n_common, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].prompt == "<|unknown|>\n<|end|>\n" and got[3].rejected == "<|assistant|>\n<|end|>\n"
    assert (got[4].n_chosen, got[4].prompt) == (0, "") and got[4].rejected.count("a<|end|>") == 2
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_neighbours_of_large_ids(spark):
    df = spark.createDataFrame([(2**53 + 3, 0, "user", "q"), (-1, 0, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.pair_id, r.chosen) for r in chat.pair_neighbours(df).collect()] == [(4503599627370497, False), (-1, False)]


def test_a_very_long_conversation(spark):
    turns = [(1, c, i, "user" if i % 2 == 0 else "assistant", f"{i} {c and i > 2990}") for c in (True, False) for i in range(3000)]
    df = spark.createDataFrame(turns, "pair_id bigint, chosen boolean, turn bigint, role string, text string")
    (r,) = chat.format_preferences(df).collect()
    assert (r.n_chosen, r.n_common, len(r.chosen_segments)) == (3000, 2991, 9)
