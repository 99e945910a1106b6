import random
import re

from tessellar.llm import licenses as L


def brute(text, templates=L.TEMPLATES, threshold=0.8):
    low = (text or "").translate(str.maketrans(L.ascii_uppercase, L.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, l) for p, l in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {l for _, l in at}
    found = {}
    for block in re.split(L.BLOCK_END, low):
        own = set(L.words_of(block))
        for l, t in templates:
            ws = set(L.words_of(t))
            if len(own & ws) >= threshold * len(ws) and told(l, own, ws):
                found[l] = max(found.get(l, 0), len(own & ws) / len(ws))
    score = 1.0 if at else max(found.values(), default=0.0)
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), round(score, 9))


def told(label, own, ws):
    must, bars = L.NAMES.get(label, ((), ()))
    return own.issuperset(ws.intersection(must)) and own.isdisjoint(bars)


def rows_of(df):
    return sorted(((r[0] if r[0] is not None else -1), tuple(r[1:7]) + (round(r[7], 9),)) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = L.words_of(" ".join(t for _, t in L.TEMPLATES))
    texts = [None, "", " ,. ", "MIT License", "mit license mit license MIT-License", "x apache license; apache\nlicense CC BY cc by", "permit license", "Kelvin K mitİ license é mit license"]
    texts += [t for _, t in L.TEMPLATES] + ["word " * 60000 + "mit license. Released beneath the MIT license"]
    for _ in range(150):
        kept = [w for w in L.words_of(rng.choice(L.TEMPLATES)[1]) if rng.random() < 0.85] + rng.sample(pool, 3)
        rng.shuffle(kept)
        texts.append(rng.choice([" ", ", "]).join(kept) + rng.choice([". next one", "\n\nother", ""]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other text"), (3, texts[3]), (None, "mit license")]
    got = rows_of(L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted((i if i is not None else -1, brute(t)) for i, t in rows)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def paragraphs(text):
    """Sentences of the runs of lines that are not blank, without BLOCK_END."""
    runs = [[]]
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            runs[-1].append(line)
        else:
            runs.append([])
    out = []
    for run in runs:
        out.append("")
        for word in " ".join(run).split():
            out[-1] += " " + word
            if word[-1] in ".!?;":
                out.append("")
    return out


def test_wrapped_notices(spark):
    notices = {"mit": MIT, "bsd": BSD, "isc": ISC}
    texts = []
    for t in notices.values():
        texts += [t, "Copyright (c) Someone\n\n" + t + "\n\nmore", t.replace("\n", "\r\n"), t.replace("\n", "\r"), "# " + t.replace("\n", "\n# "), "/*\n * " + t.replace("\n", "\n * ") + "\n */", t.replace("\n", "\n\n"), t.replace("\n", "\r\n \t\r\n")]
    rows = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        found = {}
        for block in paragraphs(text):
            for label, t in L.TEMPLATES:
                ws = set(L.words_of(t))
                share = len(ws & set(L.words_of(block))) / len(ws)
                if share >= 0.8 and told(label, set(L.words_of(block)), ws):
                    found[label] = max(found.get(label, 0), share)
        assert (text, rows[i]["labels"], round(rows[i]["score"], 9)) == (text, ",".join(sorted(found)), round(max(found.values(), default=0.0), 9))
        if i % 8 < 6:
            assert list(notices)[i // 8] in found


def test_relatives(spark):
    """Notices of related licences and versions are told apart."""
    line = "This work is licensed under the GNU {}General Public License, version {}."
    want = {line.format("", 3): "gpl,gpl-3.0", line.format("", 2): "gpl", line.format("Lesser ", 3): "lgpl", line.format("Affero ", 3): "agpl"}
    want |= {"Licensed under the Apache License, Version 2.0.": "apache,apache-2.0", "Licensed under the Apache License, Version 1.1.": "apache"}
    want |= {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under CC BY 4.0.": "cc-by", "Released under the MIT License.": "mit", "A gnu in general, licensed to the public": ""}
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {list(want)[r["doc_id"]]: r["labels"] for r in got} == want


def test_whole_table(spark):
    """On sf0.1 every label belongs to the one notice that the text has."""
    right = {"GNU General Public License, version 3": "gpl,gpl-3.0", "CC BY-NC 4.0": "cc-by,cc-by-nc", "MIT License": "mit", "Apache License, Version 2.0": "apache,apache-2.0"}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    for r in L.op3_licenses(spark, "/root/testdata/sf0.1").collect():
        want = sorted({x for p, l in right.items() if p in texts[r["doc_id"]] for x in l.split(",")})
        assert r["labels"] == ",".join(want)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(L.op3_licenses(spark, "/root/testdata/sf0.001")) == sorted((r["doc_id"], brute(r["text"])) for r in docs.collect())
    assert L.scan_licenses(docs.limit(0)).count() == 0
    assert L.scan_licenses(docs, templates=[(None, "x"), ("y", None), ("z", "--")]).count() == docs.count()
