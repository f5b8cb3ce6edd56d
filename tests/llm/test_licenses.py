import random

import pytest

import __spark_entry__ as registry
from payrisk.llm import licenses as lc

SCHEMA = "doc_id bigint, text string, families string, doc string"


@pytest.fixture(scope="module")
def model(spark, folder):
    return lc.train(lc.corpus_lines(spark.read.parquet(f"{folder}/documents.parquet")))


def test_notices_are_told_apart(model):
    for family, texts in lc.TEMPLATES.items():
        for text in texts:
            for variant in (text, text.upper(), f"  * {text}", text.replace(",", "")):
                judged = model.judge(variant.encode())
                assert judged and judged[0] == family, variant


def test_other_sentences_are_unknown(model):
    held_out = ["The license of the shop was granted last year.", "Version 2.0 of the game is out.", "Permission to land was given.", "He has all rights to be angry.", "the of and to a in is", ""]
    for text in [*lc.OTHERS, *held_out]:
        assert model.judge(text.encode()) is None, text


def test_held_out_lines_of_the_corpus_are_unknown(model, spark):
    lines = lc.corpus_lines(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 800)
    assert sum(model.judge(line) is not None for line in lines) == 0


def test_words_in_wrong_order_are_not_confirmed(model):
    draw = random.Random(1)
    for text in ("Released under the MIT License.", "Licensed under CC BY-NC 4.0."):
        words = text.split()
        mixed = [" ".join(draw.sample(words, len(words))) for _ in range(20)]
        assert sum(model.judge(m.encode()) is not None for m in mixed if m != text) <= 6


def test_hard_rows(spark, model):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"first\n{notice}\nlast\nReleased under the MIT License.", "f", "d"), (2, None, None, None), (3, "", None, None),
            (4, "x " * 100_000 + "\n" + notice, None, None), (4, notice, None, None), (4, notice, None, None), (None, f"é\r\n{notice}", None, None)]
    out = lc.scan(spark.createDataFrame(rows, SCHEMA), model)
    found = out.select("doc.doc_id", "doc.text", "families", "n_notices", "score", "spans").collect()
    assert len(found) == len(rows)
    for r in found:
        raw = (r["text"] or "").encode()
        said = [raw[a:b].decode().strip() for a, b in zip(r["spans"][::2], r["spans"][1::2])]
        assert len(said) == r["n_notices"] and (r["score"] > 0) == bool(said)
        assert set(said) <= {notice, "Released under the MIT License."}
    assert {r["doc_id"]: r["families"] for r in found} == {1: ["apache", "mit"], 2: [], 3: [], 4: ["apache"], None: ["apache"]}
    assert lc.scan(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert lc.corpus_lines(spark.createDataFrame([], SCHEMA)) == []


def test_training_without_corpus_lines():
    assert lc.train([]).judge(b"Released under the MIT License.")[0] == "mit"


def test_reserved_rights_of_any_year(model):
    for text in ("All rights reserved.", "Copyright 2024. All rights reserved.", "Copyright 1998. All rights reserved.", "(c) 2019-2024 Acme Ltd. All rights reserved."):
        judged = model.judge(text.encode())
        assert judged and judged[0] == "proprietary", text
    for text in ("All rights of way are reserved for walkers.", "The table was reserved for all of us.", "In 2024 all was well."):
        assert model.judge(text.encode()) is None, text


def test_query_finds_all_five_planted_lines(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: set(r["families"]) for r in registry.queries()["op9_license_scans"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    said = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    want = {d: {f for s, f in said.items() if s in (t or "")} for d, t in texts.items()}
    assert {f for fs in want.values() for f in fs} == set(said.values())
    assert found == want


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "mit": "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files (the \"Software\"),",
}


def test_notices_wrapped_over_lines_are_found(model):
    for family, notice in WRAPPED.items():
        assert all(model.judge(line.encode()) is None for line in notice.split("\n")), family
        for mark, around in (("", "é some words\nof a text"), (" * ", "x"), ("# ", "a line of the text and more of it\n" * 30)):
            text = (around + "\n" + "\n".join(mark + line for line in notice.split("\n")) + "\n" + around).encode()
            families, n, score, spans = lc._scanned(text, model)
            assert families == [family] and n == len(spans) // 2 > 0 and score > 0, (family, mark, families, n)
            for said in (text[a:b].decode() for a, b in zip(spans[::2], spans[1::2])):
                assert "\n" in said and "some words" not in said and "a line of" not in said


def test_blank_lines_end_a_paragraph(model):
    lines = WRAPPED["bsd"].split("\n")
    assert lc._scanned("\n \n".join(lines).encode(), model)[0] == []


def test_a_notice_inside_a_long_line_is_found(model):
    text = ("of wood and stone the house was built " * 200 + "Released under the MIT License. " + "the river is wide " * 200).encode()
    families, n, _, spans = lc._scanned(text, model)
    assert (families, n) == (["mit"], 1) and b"MIT License" in text[spans[0] : spans[1]]


def test_windows_are_exactly_bounded(model):
    """A paragraph that the bound rules out has no window with enough of a template."""
    draw = random.Random(5)
    for _ in range(300):
        _, template = draw.choice(model.sought)
        near = sorted(template.words) + ["of", "x", "y"]
        words = [w if isinstance(w, bytes) else w.encode() for w in draw.choices(near, k=30)]
        if not template.possible(set(words), set(zip(words, words[1:]))):
            assert len(template.grams & lc.grams(words)) < template.need
        for a, b in template.windows(words):
            assert len(template.grams & lc.grams(words[a:b])) >= template.need and b - a <= template.size


# Lines that share phrases with a family, or name it shortly.
NAMED = {
    "SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: MPL-2.0": "mpl", "SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "Licensed under the Eclipse Public License 2.0": "epl", "License: MIT": "mit", "Licensed under the GPLv2.": "gpl",
    "Licensed under the GNU Affero General Public License.": "agpl", "// SPDX-License-Identifier: ISC": "isc", "Released under the ISC License.": "isc",
    "Distributed under the Boost Software License, Version 1.0.": "boost", "This is free and unencumbered software released into the public domain.": "unlicense",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa", "Licensed under CC BY-SA 3.0.": "cc-by-sa", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "We are not licensed under the MIT License.": None, "This was never released under the GPL.": None, "It is no longer available under the MIT License.": None,
    "SPDX-License-Identifier: Zlib": None, "SPDX-License-Identifier: EUPL-1.2": None, "Licensed under the Artistic License 2.0": None,
    "Licensed under the Sleepycat Public License 2.0": None, "or (at your option) any later version of the License": None,
}


def test_names_decide_not_shared_phrases(model):
    for text, family in NAMED.items():
        judged = model.judge(text.encode())
        assert (judged and judged[0]) == family, (text, judged)


def test_families_that_training_never_saw_get_no_other_name():
    for family in ("epl", "agpl", "lgpl", "gpl", "cc-by-sa", "cc-by", "isc", "mpl", "boost"):
        model = lc.train([], texts={f: t for f, t in lc.TEMPLATES.items() if f != family})
        for text in lc.TEMPLATES[family]:
            assert model.judge(text.encode()) is None, (family, text, model.judge(text.encode()))


def test_windows_against_all_windows(model):
    """Every word that begins a window with enough of a template lies in reach of a window found."""
    draw = random.Random(7)
    for _ in range(150):
        _, template = draw.choice([s for s in model.sought if len(s[1].grams) >= 12])
        text = next(t for texts in lc.TEMPLATES.values() for t in texts if lc.grams(lc.words_of(t.encode())) == template.grams)
        notice = lc.words_of(text.encode())
        words = draw.choices([b"of", b"x", b"the", *notice], k=20) + [w for w in notice if draw.random() > 0.05] + draw.choices([b"y", *notice], k=20)
        found = list(template.windows(words))
        for a in range(len(words)):
            b = min(a + template.size, len(words))
            if len(template.grams & lc.grams(words[a:b])) >= template.need:
                assert any(c < b and a < d for c, d in found), (text, a)


def test_lines_for_training_come_from_anywhere(spark):
    rows = [(k, f"first of {k}\nsecond line of {k}\n\n{'long ' * 300}{k}\na license of {k}", None, None) for k in range(40)]
    lines = lc.corpus_lines(spark.createDataFrame(rows, SCHEMA))
    assert {f"second line of {k}".encode() for k in range(40)} <= set(lines) and all(len(x) <= lc.LINE_CHARS for x in lines)
    assert len(lines) == 120 and not any(b"license" in x for x in lines)
    assert len(lc.corpus_lines(spark.createDataFrame(rows, SCHEMA), 10)) <= 10
