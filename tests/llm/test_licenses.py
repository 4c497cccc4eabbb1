from emberlog.llm import licenses, queries


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def brute(text, threshold=licenses.THRESHOLD):
    import re

    text = text or ""
    units = [("line", x) for x in text.split("\n")]
    if "\n" in text:
        units += [("par", x) for x in [*re.split(r"\n[ \t\r\n*#/;%-]*\n|\*/", text), text]]
    found, lines = [], 0
    for kind, u in units:
        mine = set(licenses.template_bigrams(u))
        hits = [(d, n) for n, t in licenses.TEMPLATES if (d := dice(mine, set(licenses.template_bigrams(t)))) >= threshold]
        if hits:
            d = max(hits)[0]
            found.append((d, max(n for x, n in hits if x == d)))
            lines += kind == "line"
    best = min(((-d, n) for d, n in found), default=None)
    return (best[1] if best else None, round(-best[0], 9) if best else None, sorted({n for _, n in found}), lines)


def result(df):
    return {r.doc_id: (r.license_id, r.dice and round(r.dice, 9), r.licenses, r.n_matches) for r in df.collect()}


def test_driver_table(spark, sf_dir, texts):
    assert result(licenses.scan_licenses(queries.table(spark, sf_dir, 'documents'))) == {i: brute(t) for i, t in texts.items()}


def test_awkward_rows(make):
    mit = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 400)["MIT"]
    gpl = dict((n, t) for n, t in licenses.TEMPLATES if len(t) > 200)["GPL-3.0"]
    wrapped = mit.replace(", including", ",\nincluding").replace("subject to", "subject\nto")
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, "released under the mit license"), (5, "x\nReleased under the MIT License.\ny\nLicensed under CC BY-NC 4.0."),
        (6, "Licensed under the Apache License, Version 2.0!!"), (7, "word " * 50_000 + "\nLicensed under CC BY 4.0"), (8, wrapped), (9, "intro\n\n" + wrapped + "\n\nmore"),
        (13, "This is free and unencumbered software released into the public domain. " * 400),
        (14, "/*\n * Copyright 2020 Someone\n *\n * " + gpl.replace("redistribute it", "redistribute\n * it").replace("either version", "either\n * version") + "\n */\nint main(void) {\n  return 0;\n}\n" * 30),
        (10, "licensed under the"), (11, "the licence is under discussion"), (None, "Released under CC0 1.0 Universal."),
    ]
    got = result(licenses.scan_licenses(make(rows)))
    assert got == {i: brute(t) for i, t in rows}
    assert got[5][2] == ["CC-BY-NC-4.0", "MIT"] and got[8][0] == "MIT" and got[9][0] == "MIT" and got[10][0] is None
    assert got[13][0] == "Unlicense" and got[14][0] == "GPL-3.0"
    twice = licenses.scan_licenses(make([rows[3], rows[3]]))
    assert twice.count() == 2 and licenses.scan_licenses(make([])).count() == 0


def test_size_bounds_lose_nothing():
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n, 0.8)
        for m in range(1, 120):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert lo <= m <= hi


def test_markers_lose_nothing():
    grams = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    chosen = set(licenses.markers(grams, 0.8))
    for g in grams:
        left = [x for x in g if chosen.isdisjoint(x.split(" "))]
        assert 2 * len(left) < 0.8 * (len(left) + len(g))


def test_native_plan(make):
    plan = licenses.scan_licenses(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
