import re

from stratavec.llm.license_scan import TEMPLATES, scan_licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def expected(text):
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, more = 0.0, set(labels)
    for template, (label, least) in TEMPLATES.items():
        t, width = set(template.split()), int(len(template.split()) / least + 1e-9)
        for i in range(len(words)):
            share = len(t & set(words[i:i + width])) / len(t)
            if share >= least - 1e-12:
                more.add(label)
                best = max(best, share)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if labels else best)


def check(df, rows):
    got = scan_licenses(df).collect()
    assert len(got) == len(rows)
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *expected(t)) for i, t in rows], key=key)


def test_against_brute_force(documents):
    rows = list(enumerate([
        "Released under the MIT License.", "CC BY-NC 4.0 cc by nc\ncc by\nnc", "Licensed under the Apache License, Version 2.0. under the mit license under the mit license",
        "This work is licensed under the GNU General Public License, version 3.", "This is licensed\nunder the GNU General Public\nLicense, version 3",
        "the MİT License", "under the mit licensed", "ünder the mit license", "Licensed under the GNU General Public License version 2 and version 3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "cc by nc" * 3, "cc by nc " * 500,
    ]))
    check(documents(rows), rows)


def test_random_lines(documents):
    import random

    rng = random.Random(3)
    vocabulary = sorted({w for t in TEMPLATES for w in t.split()})
    rows = []
    for i in range(200):
        words = list(rng.choice(list(TEMPLATES)).split())
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary + ["x", "\n"])
        rows.append((i, " ".join(words)))
    check(documents(rows), rows)


def test_notices_as_they_stand_in_files(documents):
    """Wrapped, commented and reflowed notices are found; the same words out of reach are not."""
    import random

    rng = random.Random(5)
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    bsd = " * Redistribution and use in source and binary forms, with or\r\n * without modification, are permitted provided that\r\n"
    rows = [
        ("This is licensed\nunder the GNU General Public\nLicense, version 3", "gpl-3"), ("a\n\nb\n" * 50 + gpl.format(3) + "c\n" * 50, "gpl-3"),
        (gpl.format(2).replace("\n", "\r\n"), "gpl-2"), ("Copyright 2020\n\n" + mit, "mit"), (mit.replace("\n", " "), "mit"), (bsd, "bsd"),
        ("word " * 30_000 + "Subject to\nthe terms of the Mozilla\n\nPublic License", "mpl-2"),
        ("general 3 public under words version filler the licensed apples gnu foo license bar", ""), ("under the GNU General Public License\n" + "other\n" * 20 + "version 3", ""),
        ("the license of the software and the person", ""), ("", ""), (None, ""),
    ]
    for template in TEMPLATES:
        words = template.split()
        rng.shuffle(words)
        rows.append(("\n".join(f"{w} filler{i} more{i}" for i, w in enumerate(words)), ""))  # scrambled and scattered
    rows += [("\n* ".join(template.title().split()), label) for template, (label, _) in TEMPLATES.items()]  # a word a line
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(documents([(i, t) for i, (t, _) in enumerate(rows)])).collect()}
    assert got == {i: label for i, (_, label) in enumerate(rows)}


def test_odd_rows(documents, odd):
    from conftest_rows import ODD

    check(odd, ODD)
    check(documents([]), [])
