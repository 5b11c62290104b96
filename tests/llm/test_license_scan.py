import random

from brickwise.llm.license_scan import TEMPLATES, license_scan, license_sql
from tests.llm.sql import same_as_sql

TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "under the mit\nlicense under, the mit--license! x under the mit",
    "licensed cc-by-NC 4.0 under",
    "Apache License, Version 2.0\nLicensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License v3\nother",
    "the license the license under",
    "ÀÉ under thé mit license İ \x7f\x00a`b",
    "words and " * 40000 + "released under mit license",
    "gnu license of the public is version 3 general work this",
]


def test_against_sql(spark):
    rows = [(i, t, "l") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "l"), (3, "plain", "l"), (None, TEXTS[5], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    got = license_scan(docs)
    assert [r.asDict()["labels"] for r in got.where("doc_id = 7").collect()] == ["gpl-3"]
    same_as_sql(got, license_sql(), documents=docs)
    shared = sorted((r.n_words, r.labels, r.score) for r in got.where("doc_id = 3").collect())
    assert shared == [(1, "", 0.0), (5, "mit", 1.0), (5, "mit", 1.0)]


def test_other_thresholds(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for threshold in (0.3, 0.5, 1.0):
        same_as_sql(license_scan(docs, threshold=threshold), license_sql(threshold=threshold), documents=docs)


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wrapped_templates(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\n\r\nare met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
    far = "released under\n" + "x y z w v\n" * 5 + "the mit license"
    docs = spark.createDataFrame([(1, mit), (2, bsd), (3, mpl), (4, far), (5, "released under"), (5, "the mit")], "doc_id long, text string")
    got = sorted((r.doc_id, r.labels, r.score) for r in license_scan(docs).collect())
    same_as_sql(license_scan(docs), license_sql(), documents=docs)
    assert got == [(1, "mit-text", 1.0), (2, "bsd-3-clause", 1.0), (3, "mpl-2", 1.0), (4, "", 0.0), (5, "", 0.0), (5, "", 0.0)]


def test_whole_texts_over_many_lines(spark):
    rnd = random.Random(1)
    rows = []
    for k, (name, text) in enumerate(TEMPLATES.items()):
        words = text.split()
        for share in (0.0, 0.1, 0.5):
            some = [w for w in words if rnd.random() >= share]
            lines = [" ".join(some[i : i + 9]).capitalize() + "," for i in range(0, len(some), 9)]
            rows.append((k, "Copyright someone\n\n" + "\n * \n// ".join(lines) + "\nint main;"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan(docs)
    same_as_sql(got, license_sql(), documents=docs)
    labels = {}
    for r in got.collect():
        labels.setdefault(r.doc_id, []).append(set(r.labels.split(",")))
    assert all(any(name.split("/")[0] in s for s in labels[k]) for k, name in enumerate(TEMPLATES))


def scan(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.labels, round(r.score, 3)) for r in license_scan(rows).orderBy("doc_id").collect()]


def test_licences_that_differ_in_one_word(spark):
    kinds = {"gpl-3": "This work is licensed under the GNU General Public License version 3.", "agpl-3": "Licensed under the GNU Affero General Public License, version 3", "lgpl-3": "licensed under the GNU Lesser General Public License version 3"}
    both = kinds["lgpl-3"] + " " + "word " * 30 + kinds["agpl-3"]
    assert scan(spark, *kinds.values(), both) == [("gpl-3", 1.0), ("agpl-3", 1.0), ("lgpl-3", 1.0), ("agpl-3,lgpl-3", 1.0)]


def test_scattered_words_are_no_licence(spark):
    far = (" word" * 700).join(["license", "the", "under", "released", "mit"])
    near = "word " * 900 + "released under MIT license" + " word" * 900
    assert scan(spark, far, near, "wrapped\nreleased\nunder the\n\nMIT\nlicence") == [("", 0.0), ("mit", 0.8), ("mit", 0.8)]


def test_only_latin_capitals_are_lowered(spark):
    assert scan(spark, "this wor\u212a is licensed under the gnu general public license version 3") == [("gpl-3", round(11 / 12, 3))]
    rows = spark.createDataFrame([(1, "wor\u212a THIS is licensed under the \u0130 gnu general public license")], "doc_id long, text string")
    same_as_sql(license_scan(rows), license_sql(), documents=rows)
