"""The licence scan against a plain Python version of its rules."""

import re
import time

from tessera.llm import _common, licenses
from tessera.llm.license_rules import RULES

GATES = {g[0][0] for _, _, g, _ in RULES}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        at = [i for i in range(len(words) - len(phrase) + 1) if tuple(words[i : i + len(phrase)]) == phrase]
        places += at
        labels |= {label} if at else set()
    said = " ".join(words)
    found = set()
    for label, priority, _, regex in RULES:
        if any(g in said for g in GATES):
            for m in re.finditer(f"(?<![^ ])(?:{regex})(?![^ ])", said):
                a = said[: m.start()].count(" ")
                found.add((a, a + m.group().count(" ") + 1, label, priority))

    def silenced(x):
        for y in found:
            if y[0] <= x[0] and y[1] >= x[1]:
                if y[1] - y[0] > x[1] - x[0] or (y[:2] == x[:2] and (y[3] > x[3] or (y[3] == x[3] and y[2] < x[2]))):
                    return True
        return False

    stand = []
    for x in sorted((x for x in found if not silenced(x)), key=lambda x: x[0]):
        if stand and stand[-1][1] > x[0]:
            if x[3] > stand[-1][3]:
                stand[-1] = x
        else:
            stand.append(x)
    best = max([x[3] for x in stand] + [50 if places else 0])
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[2] for x in stand})), "score": best / 100.0,
    }


TEXTS = [
    None, "", "no words here? !!", "Licensed under CC BY-NC 4.0.", "CC-BY, cc by; General Public License. All Rights Reserved. all rights reserved",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. Copyright (c) 2019 2020 x", "Creative Commons Attribution 4.0 International License",
    "éall rights reserved", "ALL RIGHTS RESERVEDé all\trights\nreserved", "Kc by İ", "cc " * 3000 + "by", "by cc by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "tous droits réservés", "SPDX-License-Identifier: MIT",
    "Licensed under the MIT License version 2 GPL v3 or later all rights reserved copyright 2020 licence. " * 40, "gnu general public license version 3 or later version public license public domain",
]


def test_texts(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "y"), (None, "gpl", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "gpl"
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == brute(text), text
    assert licenses.report(df.limit(0)).count() == 0


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = licenses.report(df).collect()
    assert len(got) == len(texts) and any(r["labels"] for r in got)
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == brute(texts[r["doc_id"]])


def test_every_rule_holds_its_gate():
    assert len(RULES) > 200
    for label, _, gates, regex in RULES:
        re.compile(regex)
        assert all(any(w in regex for w in g) for g in gates), (label, gates)


def strings(regex):
    """What the regex matches: every alternative, each repetition at its least and, up to 2, its most."""
    from re import _constants as C
    from re import _parser

    def of(nodes):
        out = [""]
        for op, arg in nodes:
            if op is C.LITERAL:
                more = [chr(arg)]
            elif op in (C.ANY, C.NOT_LITERAL):
                more = ["x"]
            elif op is C.IN:
                more = ["x" if arg[0][0] is C.NEGATE else chr(arg[0][1] if arg[0][0] is C.LITERAL else arg[0][1][0])]
            elif op is C.BRANCH:
                more = [x for branch in arg[1] for x in of(branch)]
            elif op is C.SUBPATTERN:
                more = of(arg[3])
            else:
                assert op in (C.MAX_REPEAT, C.MIN_REPEAT), op
                low, high, inner = arg
                more = [x for n in sorted({low, max(low, min(high, 2))}) for x in ([""] if n == 0 else [x * n for x in of(inner)])]
            out = [a + b for a in out for b in more]
        return out

    return list(dict.fromkeys(of(_parser.parse(regex))))


def test_gates_let_all_matches_through():
    for label, _, gates, regex in RULES:
        for said in strings(regex):
            assert re.fullmatch(regex, said), (label, said)
            words = set(said.split(" "))
            assert all(words & set(g) for g in gates), (label, said)


def test_matches_without_the_first_gate_word(spark):
    texts = {1: "A copyrighted work", 2: "See the licence for details", 3: "SSPL1 applies", 4: "see licence", 5: "sspl 1", 6: "copyright x", 7: "For private use only", 8: "for academic use only"}
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("copyright", 0.2), 2: ("see-license", 0.25), 3: ("sspl-1.0", 0.82), 4: ("see-license", 0.25), 5: ("sspl-1.0", 0.82), 6: ("copyright", 0.2), 7: ("personal-use", 0.55), 8: ("research-only", 0.56)}


def test_long_texts_of_licence_lines(spark):
    line = "Licensed under the MIT License. Copyright (c) 2019 x. All rights reserved. GNU General Public License v3 or later.\n"
    df = spark.createDataFrame([(1, line * 9_000), (2, line)], "doc_id long, text string").coalesce(1)
    begun = time.time()
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    assert time.time() - begun < 120
    assert got[1]["n_base"] == 2 * 9_000 and got[1]["labels"] == got[2]["labels"]
    assert licenses.scan(df).selectExpr("size(detections) as n").orderBy("n").collect()[1][0] >= 9_000


def test_crossing_detections(spark, monkeypatch):
    rows = [(0, 4, "a", 10), (2, 6, "b", 20), (5, 9, "c", 20), (9, 12, "d", 1), (10, 11, "e", 99), (9, 12, "f", 2), (20, 22, "g", 5), (20, 22, "a", 5)]
    df = spark.createDataFrame([(rows,), ([],), (rows[:1] * 1,)], f"f {licenses.DETECTIONS}")
    for chunk in (1, 3, 128):
        monkeypatch.setattr(_common, "CHUNK", chunk)
        got = [[d["label"] for d in r[0]] for r in df.select(licenses._standing(df.f)).collect()]
        assert got == [["b", "f", "a"], [], ["a"]]
