"""Cases that an operator must judge on the whole text: blank lines, wrapped notices, far terms, unspaced scripts."""

import collections
import random
import textwrap

import pytest

pytest.importorskip("scholion.llm")

from scholion.llm import language_id, licenses, pii, quality_rules
from scholion.llm.queries import vocabulary


def test_blank_lines_do_not_count(spark):
    """Blank and space-only lines between paragraphs are no lines, so they repeat nothing."""
    paragraphs = [" ".join(f"word{k}x{j}" for j in range(12)) for k in range(6)]
    texts = ["\n\n".join(paragraphs), "\n \t\n".join(paragraphs), "\n\n".join([paragraphs[0], *paragraphs]), "\n\n \n", "a b\n\n\n \nfoo"]
    df = spark.createDataFrame([(k, t, f"host{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    report = quality_rules.host_quality(df).documents.collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dup_lines, r.fails_duplicate_lines) for r in report) == [(0, 6, 0, False), (1, 6, 0, False), (2, 7, 1, False), (3, 0, 0, False), (4, 2, 0, False)]


def test_repeats_of_long_texts(spark):
    """Windows of texts of many words: a few repeated far apart, most of them, and none."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(1500)}" for _ in range(400_000)], [f"w{rng.randrange(40)}" for _ in range(50_000)], [f"u{k}" for k in range(20_000)]]
    df = spark.createDataFrame([(k, " ".join(w), "host") for k, w in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_metrics(df).collect()}
    for k, w in enumerate(texts):
        windows = list(zip(w, w[1:], w[2:]))  # noqa: B905
        seen = collections.Counter(windows)
        assert got[k] == len({p + j for p, x in enumerate(windows) if seen[x] > 1 for j in range(3)})


NOTICES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def test_wrapped_notices(spark):
    """Notices wrapped over lines, also behind comment marks, and lines that name two licences."""
    texts, want = ["Some prose of the day.\n\nAnd more of it.", "x\nLicensed under the MIT License and the Apache License, Version 2.0.", "Released under the MIT License. Licensed under the Apache License, Version 2.0."], ["", "Apache-2.0,MIT", "Apache-2.0,MIT"]
    for family, notice in NOTICES.items():
        for width in (40, 72, 100):
            for mark in ("", "# ", " * "):
                texts.append("Copyright 2020 A. Writer\n\n" + textwrap.fill(notice, width, initial_indent=mark, subsequent_indent=mark) + "\n\nfurther text")
                want.append(family)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.fit_licenses(docs.where("doc_id = 0"))).collect()}
    assert [got[k].licenses for k in range(len(texts))] == want
    for k in range(3, len(texts)):
        (span,) = got[k].spans.split(",")
        _, a, b = span.split(":")
        assert got[k].n_notices == 1 and texts[k][: int(a)].endswith("\n") and texts[k][int(b)] == "\n"
    assert got[1].spans == f"Apache-2.0:2:{len(texts[1])},MIT:2:{len(texts[1])}"


def test_far_terms_disclose(spark):
    """A term counts anywhere in the documents with an entity, and all its occurrences are marked."""
    words = ["sun", "moon", "tree", "river", "stone", "cloud", "grass", "wind"]
    filler = " ".join(words * 5)
    data = [(k, f"{filler} zorblatt {filler} jo@ex.org {filler} Zorblatt, {filler}") for k in range(5)] + [(k, filler) for k in range(5, 200)] + [(200, "zorblatt alone")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    clean = {r.doc_id: r.text for r in pii.sanitised_documents(df, everywhere=True).collect()}
    assert not any("zorblatt" in t.lower() or "jo@ex.org" in t for t in clean.values())
    assert clean[200] == " alone" and all(clean[k] == filler for k in range(5, 200))
    assert clean[0] == f"{filler}  {filler} [EMAIL] {filler} , {filler}"
    own = {r.doc_id: r.text for r in pii.sanitised_documents(df).collect()}
    assert own[200] == "zorblatt alone" and own[0] == clean[0]


def test_languages_without_spaces(spark):
    """Runs of more than 64 characters are learned from, also where no character has a piece of its own."""
    rng = random.Random(12)
    letters = {"km": [chr(0x1780 + k) for k in range(30)], "lo": [chr(0xE81 + k) for k in (0, 1, 3, 6, 7, 9, 12, 19, 20, 21, 22, 24, 25, 26)], "my": [chr(0x1000 + k) for k in range(30)]}
    data = [(k, "".join(rng.choice(letters[lang]) for _ in range(150)), lang) for k in range(150) for lang in [sorted(letters)[k % 3]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df, vocabulary("piece_bpe_32k.model"))
    got = language_id.predict_language(df, model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)
    one = language_id.fit_pieces(model.pieces, {"km": {"".join(letters["km"]) * 2: 5}})
    khmer = one.chance(tuple(one.bytes[b] for b in letters["km"][0].encode()))[0]
    assert khmer > one.chance(tuple(one.bytes[b] for b in letters["my"][0].encode()))[0] * 5
