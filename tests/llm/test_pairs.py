"""Pair operators against brute force: near-duplicates, embeddings, containment; odd rows and clashing columns."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.containment import contained, windows, without
from newsloom.llm.lattice import cells, embedding_duplicates, nearest
from newsloom.llm.licenses import NOTICES, license_scan, notices
from newsloom.llm.near_duplicates import SYMBOLS, errors, near_duplicates, radius

random = np.random.default_rng(11)
WORDS = [f"w{k}" for k in range(3_000)]


def text(n):
    return random.choice(WORDS, n).tolist()


def edited(words, n):
    words = list(words)
    for at in random.integers(0, len(words), n):
        words[at] = "new" + str(random.integers(1 << 40))
    return words


def components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(t, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def documents():
    rows, base = [], [text(120) for _ in range(12)]
    for b in base:
        rows += [" ".join(edited(b, random.integers(0, 6))) for _ in range(12)]
    chain = text(100)
    for _ in range(10):  # each like its neighbour, the ends unlike
        rows.append(" ".join(chain))
        chain = edited(chain, 2)
    passage = " ".join(text(60))
    rows += [passage + " " + " ".join(text(60)) for _ in range(15)]
    rows += ["same text Twice here"] * 20 + ["SAME text twice\there"] + ["", None, " \n ", "one", "One", "two words", "x " * 5_000, "long " + " ".join(text(4_000))]
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "tile"), [(3, 85, 512), (5, 80, 512), (3, 85, 4)])
def test_near_duplicates_are_those_of_all_pairs(spark, documents, monkeypatch, size, percent, tile):
    monkeypatch.setattr("newsloom.llm.near_duplicates.TILE", tile)
    sets = {i: shingles(t, size) for i, t in documents}
    full = [i for i, s in sets.items() if s]
    links = [(a, b) for a in full for b in full if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = components(sets, links)
    docs = spark.createDataFrame([(t, i, 1, "r", i) for i, t in documents], "text string, doc_id long, n_shingles int, rep string, id long").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, size, percent).collect()}
    assert found == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (3, None)], "doc_id long, text string")
    found = [tuple(r) for r in near_duplicates(docs).orderBy("doc_id", "n_shingles").collect()]
    assert found == [(None, 1, None, True), (3, 0, 3, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.75, 0.8, 0.85, 0.95])
def test_pigeonhole_covers_the_radius(similarity):
    r = radius(similarity)
    assert sum(e + 1 for e in errors(r)) == r + 1 and r < SYMBOLS


def test_lattice_points_are_nearest():
    points = random.standard_normal((300, 8)) * 3
    found = nearest(points)
    assert (np.isclose(found % 1, 0).all(1) | np.isclose(found % 1, 0.5).all(1)).all() and (found.sum(1) % 2 == 0).all()
    assert (((points - found) ** 2).sum(1) <= 1 + 1e-9).all()  # covering radius 1


def test_visited_cells_differ():
    units = random.standard_normal((50, 20))
    for table in range(2):
        visited = cells(units / np.linalg.norm(units, axis=1, keepdims=True), table)
        assert all(len(set(v)) == visited.shape[1] for v in visited.tolist())


@pytest.mark.parametrize("tile", [1_000, 20])
def test_embedding_links_are_those_of_all_pairs(spark, tile):
    rows = []
    for size, noise in ((60, 0.15), (40, 0.25), (30, 0.02)):
        centre = random.standard_normal(32)
        rows += [(centre / np.linalg.norm(centre) + random.standard_normal(32) * noise / np.sqrt(32)).tolist() for _ in range(size)]
    rows += [random.standard_normal(32).tolist() for _ in range(200)]
    rows += [rows[0]] * 7 + [[2 * x for x in rows[1]]]
    bad = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    short = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0]]
    rows += bad + short
    usable = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in enumerate(rows) if usable(v)}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label, count = components(range(len(rows)), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    vectors = spark.createDataFrame([(i, v, 1, "c") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int, cell string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(vectors.repartition(4), tile=tile).collect()}
    assert found == {i: (count[i], label[i], label[i] == i) for i in range(len(rows))}


def test_embeddings_of_odd_tables(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = [tuple(r) for r in embedding_duplicates(vectors).orderBy("vec_id").collect()]
    assert found == [(None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert embedding_duplicates(vectors.limit(0)).count() == 0


def alnum(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def runs(t):
    w = alnum(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def test_items_inside_documents(spark):
    items = [" ".join(text(n)) for n in (5, 6, 8, 9, 12, 20, 40, 90, 200)] + ["two words", "", None, "Repeated words repeated words repeated words repeated words."]
    docs = [" ".join(text(3_000)) for _ in range(30)]
    for i, item in enumerate(items):
        if item:
            docs += [item, item.upper() + "!", " ".join(text(2_000)) + " " + item + " " + " ".join(text(1_500)), item.replace(" ", "-\n")]
            docs.append(" ".join(text(500) + item.split()[: max(1, len(item.split()) // 2)] + text(500)))
            docs.append(" ".join(edited(item.split(), 1)) + " tail " + str(i))
    docs += ["", None, items[6] + " " + items[7]] + [items[8]] * 10
    known = {j: set(runs(t)) for j, t in enumerate(items) if runs(t)}
    expected = {(i, j): (len(set(runs(d)) & s), len(s)) for i, d in enumerate(docs) for j, s in known.items() if 100 * len(set(runs(d)) & s) >= 80 * len(s)}
    left = spark.createDataFrame([(i, d, "x", 0) for i, d in enumerate(docs)] + [(None, items[7], "x", 0)], "doc_id long, text string, item string, id int")
    right = spark.createDataFrame(list(enumerate(items)) + [(3, items[3]), (None, items[7])], "item_id long, text string")
    found = {(r["id"], r["item"]): (r["n_shared"], r["n_shingles"]) for r in contained(left.repartition(3), right).collect()}
    assert found == expected
    hit = spark.createDataFrame([(i,) for i, _ in expected], "doc_id long")
    assert without(left, hit).count() == len(docs) + 1 - len({i for i, _ in expected})
    assert contained(left.limit(0), right).count() == 0 and contained(left, right.limit(0)).count() == 0


def test_licenses_in_windows(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    docs = [
        " ".join(text(700)) + " Released under the MIT License. " + " ".join(text(900)), "Licensed under CC BY-NC 4.0.", grant, " ".join(text(333)) + "\n* " + grant.replace(" ", "\n* ") + " " + " ".join(text(50)),
        "released under the", "", None, "Released under the MIT License. " * 40,
    ]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {(r["doc_id"], r["license"]) for r in license_scan(rows, notices(spark)).collect()}
    assert found == {(0, "MIT"), (1, "CC-BY-NC-4.0"), (2, "MIT"), (3, "MIT"), (7, "MIT")}


def gnu(name, version, mark=","):
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."


def licenses_of(spark, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {i: set() for i in range(len(docs))}
    for r in license_scan(rows, notices(spark)).collect():
        found[r["doc_id"]].add(r["license"])
    return list(found.values())


def test_licenses_are_not_taken_for_their_siblings(spark):
    sentence = "This work is licensed under the GNU {}General Public License, version {}."
    expected = {
        sentence.format("", "2"): {"GPL-2.0"}, sentence.format("", "3"): {"GPL-3.0"}, sentence.format("Lesser ", "3"): {"LGPL-3.0"}, gnu("", "3"): {"GPL-3.0"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"MPL-2.0"},
    }
    assert licenses_of(spark, list(expected)) == list(expected.values())
    siblings = licenses_of(spark, [gnu("", "2", ";"), gnu("Lesser ", "3"), gnu("Affero ", "3"), sentence.format("Lesser ", "2.1"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."])
    assert not any({"GPL-3.0"} & s for s in siblings[:4]) and "GPL-2.0" not in siblings[1] | siblings[2] and "LGPL-3.0" not in siblings[3] and "MPL-2.0" not in siblings[4]


def test_headers_and_bodies_of_further_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    name, end = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software. ", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
    expected = {
        gnu("Affero ", "3"): {"AGPL-3.0"}, gnu("Lesser ", "3"): {"LGPL-3.0"}, gnu("Lesser ", "2.1", ";"): {"LGPL-2.1"}, gnu("", "2", ";"): {"GPL-2.0"},
        bsd + end: {"LicenseRef-BSD", "BSD-2-Clause"}, bsd + name + end: {"LicenseRef-BSD", "BSD-3-Clause"},
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n" + " ".join(text(300)): {"GPL-3.0"}, "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999": {"LGPL-2.1"},
        "Eclipse Public License - v 2.0": {"EPL-2.0"}, "This is free and unencumbered software released into the public domain.": {"Unlicense"},
        "Creative Commons Legal Code CC0 1.0 Universal": {"CC0-1.0"}, "Licensed under CC BY-ND 4.0.": {"CC-BY-ND-4.0"}, "Licensed under CC BY-NC-SA 3.0.": {"CC-BY-NC-SA-3.0"},
        "This work is licensed under a Creative Commons Attribution-NonCommercial 2.5 Generic License.": {"CC-BY-NC-2.5"},
    }
    assert licenses_of(spark, list(expected)) == list(expected.values())


def test_no_notice_holds_that_of_another_license():
    five = lambda t: {tuple(w[i : i + 5]) for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for i in range(len(w) - 4)}
    for a, s in NOTICES:
        assert five(s), s
        assert not [b for b, t in NOTICES if a != b and 100 * len(five(s) & five(t)) >= 80 * len(five(s))], s


def test_windows_overlap(spark):
    rows = spark.createDataFrame([(1, list(range(n))) for n in (1, 8, 9, 16, 17, 40)], "id int, shingles array<long>")
    parts = rows.select(F.size("shingles").alias("id"), F.explode(windows(F.col("shingles"), 8)).alias("shingles")).collect()
    for n in (1, 8, 9, 16, 17, 40):
        own = [r["shingles"] for r in parts if r["id"] == n]
        assert all(any(set(range(s, min(s + 8, n))) <= set(p) for p in own) for s in range(max(1, n - 7)))
