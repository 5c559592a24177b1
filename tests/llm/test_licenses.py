"""License notices as they are published: wrapped, behind comment marks, and across empty lines."""

import pytest

from plenum.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
APACHE = """you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
NOTICES = {"mit": MIT, "bsd": BSD, "apache-2": APACHE}
AROUND = "\n\n".join("line of other words\nand one more " * 9 for _ in range(12))


@pytest.mark.parametrize("label", NOTICES)
def test_wrapped_notices(spark, label):
    text = NOTICES[label]
    texts = [text, text.replace("\n", "\r\n"), "/*\n * " + text.replace("\n", "\n * ") + "\n */", "# " + text.replace("\n", "\n# "), text.replace(" ", "\n"), text.replace("\n", "\n\n"), AROUND + "\n\n" + text + "\n\n" + AROUND, AROUND + "\n" + text]
    found = licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in found} == dict.fromkeys(range(len(texts)), label)
    assert all(r.score >= licenses.THRESHOLD and r.base_labels == "" for r in found)


def test_wrapping_changes_nothing(spark):
    lines = [*(t for _, t in licenses.TEMPLATES), "an other line of the work", "the licence of this library is not known"]
    rows = [(i, x) for i, t in enumerate(lines) for x in (t, t.replace(" ", "\n"), t.replace(" ", "\n\n"))]
    found = licenses.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(len(r.seen) == 1 for r in found.selectExpr("doc_id", "struct(labels, score) AS x").groupBy("doc_id").agg({"x": "collect_set"}).toDF("doc_id", "seen").collect())


def test_words_far_apart_are_no_notice(spark):
    words = licenses.TEMPLATES[3][1].split()
    text = "\n\n".join(w + " " + "filler words of others " * 20 for w in words)
    (row,) = licenses.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.labels == "" and row.score == 0


def test_variants_of_a_license(spark):
    texts = {
        "agpl": "This program is licensed under the GNU Affero General Public License",
        "gpl": "This program is licensed under the GNU General Public License",
        "lgpl": "It is licensed under the GNU Lesser\nGeneral Public License.",
        "cc-by": "This work is licensed under a Creative Commons Attribution license",
        "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial license",
        "agpl,gpl": "Licensed under the GNU General Public License.\n\nThe server is licensed under the GNU Affero General Public License.",
        "": "the general public license of the gnu",
    }
    found = licenses.digest(spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, doc_id string")).collect()
    assert {r.doc_id: r.labels for r in found} == {k: k for k in texts}


def words(text: str) -> list[str]:
    import re

    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def test_against_plain_python(spark):
    """Base places by comparison at each word; templates by the share of their words in each paragraph and window."""
    import math
    import random

    rng = random.Random(8)
    pieces = [t for _, t in licenses.TEMPLATES] + [p for p, _ in licenses.PHRASES] + ["Under the MIT-License", "apache  LICENSE, version 2.0", "cc-by-nc 4", "İ Ķ under the mit license", "other words stand here", "\n", "\n\n", "\n \n", "license", "the work"]
    texts = ["".join(rng.choice(pieces) + rng.choice((" ", "\n", ". ")) for _ in range(rng.randrange(0, 9))) for _ in range(120)] + ["", "mit"]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")).collect()}
    assert found[-1].n_words == 0 and found[-1].places == found[-1].found == []
    longest = max(len(words(t)) for _, t in licenses.TEMPLATES)
    sets = [(label, set(words(t))) for label, t in licenses.TEMPLATES]
    for i, text in enumerate(texts):
        w = words(text)
        places = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert (found[i].n_words, sorted(map(tuple, found[i].places))) == (len(w), places)
        lines, blocks = [words(line) for line in text.split("\n")], [[]]
        for line in lines:
            blocks[-1].extend(line) if line else blocks.append([])
        blocks = [b for b in blocks if b]
        if len(blocks) > 1:
            blocks += [w[k : k + 3 * longest] for k in range(0, len(w), longest)]
        want = set()
        for b in map(set, blocks):
            score = [len(b & s) / len(s) if len(b & s) >= math.ceil(0.9 * len(s) - 1e-9) else 0 for _, s in sets]
            for k, (label, s) in enumerate(sets):
                rivals = [(score[j], len(o)) for j, (other, o) in enumerate(sets) if other != label and len(s & o) >= 0.9 * min(len(s), len(o))]
                if score[k] and all((score[k], len(s)) >= r for r in rivals):
                    want.add((label, score[k]))
        assert {tuple(x) for x in found[i].found} == want


def test_twice_the_text_takes_twice_the_time(spark):
    """Paragraphs, many first words of a phrase, and phrases that do stand there."""
    import time

    took = []
    for n in (32_000, 64_000, 128_000):
        text = " ".join(("under the mit license" if i % 500 == 0 else f"under w{i % 977}") + ("\n\n" if i % 40 == 0 else "") for i in range(n // 2))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        (row,) = licenses.digest(docs).collect()
        took.append(time.perf_counter() - began)
        assert row.n_base == -(-(n // 2) // 500) and row.labels == "mit"
    assert took[2] < 3 * max(took[1], 1)


def test_full_texts_over_several_paragraphs(spark):
    """Every text of the templates with a holder and a year, wrapped and between other paragraphs, is found by its label and by no other."""
    import textwrap

    from plenum.llm.license_texts import TEXTS

    rows = []
    for i, (label, text) in enumerate(TEXTS):
        wrapped = "\n\n".join(textwrap.fill(p, 60) for p in text.split("\n\n"))
        rows += [(2 * i, label, f"Copyright 2020 A Holder\n\n{wrapped}"), (2 * i + 1, label, f"{AROUND}\n\n{wrapped}\n\n{AROUND}")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()}
    for i, label, _ in rows:
        assert {x.label for x in found[i].found} == {label} and max(x.score for x in found[i].found) == 1, (label, found[i].found)


def test_the_plan_does_not_grow_with_pairs(spark):
    """Blocks look up templates by their words: as many expressions for many templates as for few, but for literals."""
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    size = lambda n: licenses.scan(docs, templates=[("l", f"first{i} second{i} third{i}") for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().count("array_intersect")
    assert size(3) == size(60)
