"""Each operator against brute force or an exact round trip on small tables with awkward rows."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, dac, decontam, ego, fm, langmix, licenses, omh, pack, quality
from tidemark.llm.common import Scratch
from tidemark.llm.graph import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def edited(text, k, rng=RNG):
    w = text.split(" ")
    for i in rng.choice(len(w), k, replace=False):
        w[i] = "changed" + str(int(rng.integers(1e6)))
    return " ".join(w)


@functools.cache
def awkward():
    """Null and empty texts, short ones, copies, repeated rows, a long one, odd white space and characters."""
    base = [prose(120) for _ in range(12)]
    passage = prose(50)
    rows = list(enumerate(base))
    rows += [(100 + i, edited(base[i % 3], 1 + i % 9)) for i in range(40)]
    rows += [
        (200, base[0]), (201, base[0]), (202, base[1] + "  "), (203, None), (204, ""), (205, " \n\t "), (206, "one"),
        (207, "one two three four"), (208, "one two three four"),
    ]
    rows += [(300 + i, prose(30) + "\n" + passage + "\n" + prose(30)) for i in range(8)]
    rows += [
        (400, " ".join([prose(7)] * 20)), (401, prose(9000)), (402, "é ß 　日本 語 x " + prose(40)), (0, base[0]), (None, prose(60)),
        (None, None),
    ]
    return rows


EXTRA = ", 1 AS d, 2 AS th, 'x' AS key, 0 AS kept, 5 AS n_words, 'y' AS held_out, 7 AS shard, array(1) AS runs, 'z' AS part"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), "doc_id long, text string").repartition(5).selectExpr(
        "*", *[c.strip() for c in EXTRA[2:].split(", ")],
    )


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_order_minhash_finds_the_brute_force_classes(spark, docs, empty):
    got = Counter((r.doc_id, r.class_id, r.kept) for r in omh.near_duplicates(spark, docs).collect())
    rows = awkward()
    hs = [omh.labelled(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0], rows[i][1], rows[j][1]):
                continue
            if rows[i][1] == rows[j][1] or omh.similarity(hs[i], hs[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, least[find(i)] if d is not None else None, d is None or d == least[find(i)]) for i, (d, _) in enumerate(rows))
    assert got == want
    assert omh.near_duplicates(spark, empty).collect() == []


@pytest.mark.parametrize("block", [512, 100])
def test_order_minhash_links_every_pair_in_a_large_family(spark, block, monkeypatch):
    """A template with 1,000 texts of about 0.7 to each other, 100 pairs of which reach 0.8."""
    monkeypatch.setattr(omh, "BLOCK", block, raising=False)
    rng = np.random.default_rng(21)
    own = lambda n: [f"w{int(x)}" for x in rng.integers(0, 1 << 40, n)]
    template = prose(154, rng).split(" ")
    texts = [" ".join(template + own(31)) for _ in range(900)]
    texts += [" ".join(t.split(" ")[:-20] + own(20)) for t in texts[:100]]
    sets = [set(omh.labelled(t).tolist()) for t in texts]
    close = {(i, j) for i in range(1000) for j in range(i) if len(sets[i] & sets[j]) * 1.8 >= (len(sets[i]) + len(sets[j])) * 0.8 - 1e-6}
    assert close == {(900 + i, i) for i in range(100)}
    assert all(omh.similarity(omh.labelled(texts[i]), omh.labelled(texts[j])) >= 0.8 for i, j in close)
    got = {
        r.doc_id: r.class_id for r in omh.near_duplicates(
            spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4),
        ).collect()
    }
    assert got == {i: i - 900 if i >= 900 else i for i in range(1000)}


def test_overlaps_are_exact():
    rng = np.random.default_rng(22)
    hs = [np.unique(rng.integers(0, m, 60).astype(np.uint64)) for m in (80, 400, 3000) for _ in range(20)]
    got = omh.overlaps(hs)
    assert all(got[i, j] == len(np.intersect1d(hs[i], hs[j])) for j in range(60) for i in range(j))


def test_alignment_is_sensitive_to_order():
    t = prose(200).split(" ")
    h = omh.labelled(" ".join(t))
    assert omh.similarity(h, omh.labelled(" ".join(t))) == 1.0
    assert omh.similarity(h, omh.labelled(" ".join(t[100:] + t[:100]))) == 0.0
    assert omh.similarity(h, omh.labelled(edited(" ".join(t), 2))) >= 0.8


@pytest.mark.parametrize("hot", [1, 1000])
def test_fm_removal_equals_window_counts(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(fm, "HOT", hot)
    monkeypatch.setattr(fm, "SHARD_WORDS", 300)
    found = fm.passages(spark, docs)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.d) for r in found.collect())
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in awkward()]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = Counter()
    for (d, _), w in zip(awkward(), texts, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), 1)] += 1
    assert got == want
    assert fm.passages(spark, empty).collect() == []


def test_fm_hot_windows_need_both_halves_of_their_key(spark, docs, monkeypatch):
    want = Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in fm.passages(spark, docs).collect())
    monkeypatch.setattr(fm, "HOT", 1)
    monkeypatch.setattr(fm, "LOW_BITS", 3)
    assert Counter((r.doc_id, r.n_removed, r.kept_sha256) for r in fm.passages(spark, docs).collect()) == want


def test_fm_index_counts():
    pieces = [RNG.integers(0, 5, n) for n in (40, 1, 30, 25)]
    index = fm.FMIndex(pieces, 5)
    for _ in range(200):
        n = int(RNG.integers(1, 6))
        p = RNG.integers(0, 5, n)
        lo, hi = np.array([0]), np.array([sum(map(len, pieces)) + len(pieces)])
        for s in p[::-1]:
            lo, hi = index.step(np.array([s]), lo, hi)
        assert hi[0] - lo[0] == sum(q[i : i + n].tolist() == p.tolist() for q in pieces for i in range(len(q) - n + 1))


def test_language_mixture(spark):
    rng = np.random.default_rng(5)
    sets = {"aa": "abcde", "bb": "fghij", "cc": "klmnö"}
    make = lambda k, n: " ".join("".join(rng.choice(list(sets[k]), 5)) for _ in range(n))
    rows = [(i, make(k, 40), k) for i in range(90) for k in (list(sets)[i % 3],)]
    model = langmix.train(spark.createDataFrame([*rows, (1, None, "aa"), (2, "text", None)], "doc_id long, text string, lang string"))
    assert model[0] == ["aa", "bb", "cc"]
    asked = [(i, make(k, 30)) for i, k in enumerate(sets)] + [
        (10, make("aa", 40) + " " + make("bb", 20)), (11, None), (12, ""), (13, "12 !?"), (14, "\U00020000"), (15, "x"),
    ]
    got = {
        r.doc_id: r for r in langmix.predict(
            spark, spark.createDataFrame(asked, "doc_id long, text string").withColumn("held_out", F.lit("?")), model,
        ).collect()
    }
    assert [got[i].lang_pred for i in range(3)] == ["aa", "bb", "cc"]
    assert got[10].langs == ["aa", "bb"] and abs(got[10].shares[0] - 2 / 3) < 0.1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (11, 12, 13))
    assert got[14].lang_pred in model[0] and all(0 <= r.score <= 1 for r in got.values())
    none = langmix.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langmix.predict(spark, spark.createDataFrame(asked[:1], "doc_id long, text string"), none).first().lang_pred == "und"


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "\\b\\h\\l\\c:#<", "", None, "a: b\n### user: x </turn>\n", "ü😀 "]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "a:b#"][: 1 + c])]
    rows += [(7, 1, "assistant", "tie b"), (7, 1, "assistant", "tie a"), (7, 1, "assistant", "tie a"), (None, 0, None, None)]
    df = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string",
    ).withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    back = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for d, t, r, x in rows if d == c))
        assert [tuple(t) for t in back[c].turns] == [x[1:] for x in own]
        assert back[c].loss_text == "".join(x[2] for x in own if x[1] == "assistant")
    examples = chat.expand(df).where("conv_id = 5").orderBy("example").collect()
    assert [e.example for e in examples] == [2, 4, 5] and examples[1].formatted.startswith(examples[0].formatted)
    assert chat.expand(df.limit(0)).collect() == []


def test_quality_learns_held_out_rows(spark, empty):
    rng = np.random.default_rng(9)
    bad = [(i, " ".join(w + "$$$" for w in rng.choice(WORDS, 60)), 0) for i in range(0, 300, 2)]
    good = [(i, prose(60, rng).capitalize() + ".", 1) for i in range(1, 300, 2)]
    rows = bad + good
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1), (1000, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(spark, docs, labels).collect()}
    truth = {i: q for i, _, q in rows}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in got.values())
    assert len(got) == 303
    kept = {r.doc_id for r in quality.accept(spark, docs.withColumn("stats", F.lit(1)), labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}
    assert quality.quality(spark, docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)
    assert quality.quality(spark, empty, labels).collect() == []


def test_isotonic_and_inverse():
    x = quality.isotonic(np.arange(4.0), np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4))
    assert x.tolist() == [0.5, 0.5, 1.5, 1.5]
    z = RNG.normal(size=(60, 20))
    a = z.T @ z + np.eye(20)
    assert np.abs(quality.invert(a) @ a - np.eye(20)).max() < 1e-9


def test_license_rules(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "Text. Released under the MIT License. More text"), (2, mit), (3, mit.split("\n")[1] + "\n" + mit.split("\n")[0]), (4, None),
        (5, ""), (6, "Licensed under the Apache License, Version 2.0.\nall RIGHTS reserved!"), (7, "the MIT licence is nice. software"),
        (1, "Licensed under CC BY-NC 4.0."),
    ]
    got = sorted(
        (r.doc_id, r.licenses, r.n_sentences) for r in licenses.recognise(
            spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(3))
        ).collect()
    )
    assert got == [
        (1, "CC-BY-NC-4.0", 1), (1, "MIT", 1), (2, "MIT", 2), (3, "", 2), (4, "", 0), (5, "", 0), (6, "Apache-2.0,Proprietary", 2),
        (7, "", 0),
    ]
    assert licenses.recognise(empty).collect() == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License"); you may
# not use this file except in compliance with the License. You may obtain
# a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL = """/* This %s is free software%s you can redistribute it and/or modify
 * it under the terms of the GNU %s Public License as published by
 * the Free Software Foundation%s either version %s of the License, or
 * (at your option) any later version.
 *
 * This %s is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details. */
"""


def test_true_licence_texts_are_found_when_wrapped(spark):
    texts = {
        "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD_NAME % "copyright holder", "Apache-2.0": APACHE,
        "GPL-2.0": GPL % ("program", ";", "General", ";", "2", "program"), "GPL-3.0": GPL % ("program", ":", "General", ",", "3", "program"),
        "LGPL-2.1": GPL % ("library", ";", "Lesser General", ";", "2.1", "library"), "AGPL-3.0": GPL % ("program", ":", "Affero General", ",", "3", "program"),
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    rows = [
        *texts.items(), ("MIT", "Text.\nReleased under the\nMIT License.\nMore"),
        ("MIT", "no full stop\nReleased under the MIT License\nmore"), ("BSD-3-Clause", BSD + BSD_NAME % "University of X, Y"),
        ("", MIT.split("\n\n")[0]), ("BSD-2-Clause,BSD-3-Clause", BSD + BSD_NAME % "X" + "\n" + BSD),
    ]
    rows += [(want, text.replace("\n", "\r\n")) for want, text in texts.items()]
    got = licenses.recognise(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {i: want for i, (want, _) in enumerate(rows)}


@pytest.mark.parametrize("text", ["All rights  reserved.", "all rights\u00a0reserved", "ALL RIGHTS-RESERVED", "All\trights\treserved!"])
def test_odd_spacing_keeps_a_licence(spark, text):
    assert licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().licenses == "Proprietary"


def test_creative_commons_notices(spark):
    notice = "This work is licensed under a Creative Commons Attribution{} 4.0\nInternational License. To view a copy of this license, visit the site."
    docs = spark.createDataFrame([(i, "Some words before.\n" + notice.format(k)) for i, k in enumerate(("", "-ShareAlike", "-NonCommercial"))], "doc_id long, text string")
    assert [r.licenses for r in licenses.recognise(docs).orderBy("doc_id").collect()] == ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]


def test_every_known_sentence_has_a_trigger_and_is_normal():
    for s in licenses.SENTENCES:
        assert re.sub("[^a-z0-9]+", " ", s).strip() == s
        assert re.search(licenses.TRIGGERS, s)


@pytest.mark.parametrize("block", [512, 20])
def test_epsilon_grid_equals_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "LEAF", 8)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(25, 16))
    rows = [(i, (base[i % 25] + rng.normal(size=16) * (0.02 + 0.01 * (i % 20))).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(9)] + [
        (310, rows[0][1], None), (311, None, 0), (312, [0.0] * 16, 0), (313, [float("nan")] * 16, 0), (314, [1.0] * 4, 0),
        (315, [1.0] * 4, 0), (316, [None] * 16, 0), (317, [], 0), (318, [float("inf")] + [0.0] * 15, 0),
    ]
    rows += [
        (319, [1e300 * x for x in rows[0][1]], 0), (320, [1e-300 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("mult", F.lit(1)).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego.near_vectors(spark, df).collect()}
    ok = {i: np.array(v) / max(map(abs, v)) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    label = {i: x for i, _, x in rows}
    links = {
        i: {
            j for j in ok if j != i and i in ok and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.98
        } for i in label
    }
    for i in label:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen) if i is not None else None, i is None or i == min(seen))
    assert sum(map(len, links.values())) > 400
    assert ego.near_vectors(spark, df.limit(0)).collect() == []


def test_epsilon_grid_skips_distant_blocks(spark):
    """Interval pairs are those whose boxes come near, found without comparing all blocks."""
    box = lambda x: [float(x)] + [0.0] * (ego.DIMS - 1)
    rows = [(i, "x" if i < 600 else "y", 3, box(i), box(i + 0.5)) for i in range(1000)]
    meta = spark.createDataFrame(rows, "id long, label string, n int, lo array<double>, hi array<double>")
    got = {tuple(r) for r in ego.near_blocks(meta, 0.6, Scratch(spark, "t")).collect()}
    assert got == {(i, i + 1) for i in range(999) if i != 599}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (50, 45), (60, 60), (45, 50)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40}


@pytest.mark.parametrize("block", [500_000, 40])
def test_decontamination_equals_scan(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 400)
    rows = awkward()
    items = [(i, " ".join((rows[i][1] or "").split(" ")[20 : 20 + n]).upper() if i % 2 else " ".join((rows[i][1] or "").split(" ")[20 : 20 + n])) for i, n in ((0, 10), (1, 25), (2, 4), (3, 9), (5, 60), (52, 5))] + [(70, None), (71, "..."), (72, prose(15)), (3, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    found = decontam.matches(spark, docs, bench)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = Counter()
    for d, t in rows:
        w, hit, own = cut(t), set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    own |= who
        want[(d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want
    assert found.where("size(near) < size(items)").count() == 0
    assert decontam.matches(spark, empty, bench).collect() == []
    assert decontam.matches(spark, docs, bench.limit(0)).where("contaminated").count() == 0


def encoded(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize(
    "text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\nz", "one <|endoftext|><|endoftext|>", "half <|endoftext >"],
)
def test_added_tokens_are_encoded_as_the_library_does(text):
    from tidemark.llm.tokens import Coder, tokenizer_json

    coder = Coder(tokenizer_json(VOCABULARY))
    assert np.frombuffer(coder.encode(text), coder.dtype).tolist() == encoded(text, 0)[:-1].tolist()


def test_packing_covers_every_id_once(spark, docs, empty):
    got = pack.pack(spark, docs, VOCABULARY).collect()
    rows = awkward()
    per = {}
    for r in got:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = [s for s, p in per.items() if sum(n for _, n in p) == 1024]
    assert len(full) >= len(per) - 1
    for p in per.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
    stream, whole = sorted(got, key=lambda r: (r.sequence_id, r.offset)), []
    for r in stream:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32 and len(ids) == 4 * r.length
        if r.start == 0:
            whole.append([r.doc_id, b"", r.doc_tokens])
        assert whole[-1][0] == r.doc_id and whole[-1][2] == r.doc_tokens and len(whole[-1][1]) == 4 * r.start
        whole[-1][1] += ids
    assert Counter((d, ids) for d, ids, _ in whole) == Counter((d, encoded(t, 0).tobytes()) for d, t in rows)
    assert all(len(ids) == 4 * n for _, ids, n in whole)
    assert pack.pack(spark, empty, VOCABULARY).collect() == []


def test_cutting_needs_no_vocabulary_and_frees_what_a_worker_remembers(monkeypatch):
    from tidemark.llm import common
    from tidemark.llm.tokens import Coder, id_type, tokenizer_json

    spec = tokenizer_json(VOCABULARY)
    coder = Coder(spec)
    assert coder.dtype == np.dtype(id_type(spec)) and coder.tokenizer.get_vocab_size() <= 1 << 16
    monkeypatch.setattr(pack, "coder", None)
    common.worker_cache("coder of an earlier step", list)
    ids = np.arange(2500, dtype="<u2").tobytes()
    batch = pa.RecordBatch.from_pydict({"doc_id": [7], "doc_tokens": [2500], "ids": [ids], "at": [1000]})
    got = list(common.lean(functools.partial(pack.cut, width=id_type(spec), length=1024), forget=True)(iter([batch])))
    assert [(r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got[0].to_pylist()] == [
        (0, 24, 0, 1000), (24, 1024, 1, 0), (1048, 1024, 2, 0), (2072, 428, 3, 0),
    ]
    assert b"".join(r["ids"] for r in got[0].to_pylist()) == ids
    made = []
    common.worker_cache("coder of an earlier step", lambda: made.append(1))
    common.worker_forget()
    assert made == [1]


def test_scratch_reads_few_rows_at_once_where_the_session_has_no_choice(spark):
    from tidemark.llm import common

    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        common.Scratch(spark, "rows").clear()
        assert spark.conf.get(name) == str(common.READ_ROWS)
        spark.conf.set(name, "3000")
        common.Scratch(spark, "rows").clear()
        assert spark.conf.get(name) == "3000"
    finally:
        spark.conf.set(name, before)


def test_neighbours_on_the_curve_are_packed_together(spark):
    rng = np.random.default_rng(41)
    topics = [[WORDS[i] for i in rng.choice(len(WORDS), 12, replace=False)] for _ in range(8)]
    docs = [(i, " ".join(rng.choice(topics[i % 8], 150))) for i in range(320)]
    got = pack.pack(spark, spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY).collect()
    order = [r.doc_id % 8 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) > 160  # 40 in any order without regard to content


def test_hilbert_is_a_continuous_bijection():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = pack.hilbert(grid, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_files_round_trip(spark, docs, empty):
    path, manifest = dac.tokenize_to_files(spark, docs, VOCABULARY)
    got = sorted(dac.read_documents(spark, path, manifest).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in awkward()), key=lambda d: -1 if d is None else d)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(encoded(t, 2)), zlib.crc32(encoded(t, 2).tobytes())) for d, t in awkward())
    assert dac.read_documents(spark, *dac.tokenize_to_files(spark, empty, VOCABULARY)).collect() == []


@pytest.mark.parametrize("top", [200, 65_000, 3_000_000])
def test_dac_reads_any_place(top):
    ids = RNG.integers(0, top, 5000).astype(np.uint32)
    f = dac.DacFile(dac.file_bytes([1], [len(ids)], ids))
    assert (f.at(np.arange(5000)) == ids).all()
    some = RNG.integers(0, 5000, 7)
    assert (f.at(some) == ids[some]).all() and (f.document(0) == ids).all()


def test_wavelet_tree_ranks_are_exact():
    rng = np.random.default_rng(31)
    for sigma, n in ((1, 20), (2, 300), (300, 70_000)):
        _, sequence, counts = np.unique(rng.zipf(1.2, n) % sigma, return_inverse=True, return_counts=True)
        tree = fm.WaveletTree(sequence, counts)
        symbol, place = rng.integers(0, len(counts), 200), rng.integers(0, n + 1, 200)
        assert tree.rank(symbol, place)[0].tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]
        if len(counts) > 2:  # no code is shorter on the whole than the entropy, nor a bit longer
            share, mean = counts / n, (tree.length * counts).sum() / n
            assert -(share * np.log2(share)).sum() <= mean < -(share * np.log2(share)).sum() + 1


def test_fm_with_many_equal_rows(spark):
    """Equal rows are places of their own, at a cost in proportion to their number."""
    text, other = prose(200), prose(100)
    rows = [(7, text)] * 3000 + [(8, other), (None, None)]
    got = Counter(
        (r.doc_id, r.n_words, r.n_removed) for r in fm.passages(
            spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6),
        ).collect()
    )
    assert got == {(7, 200, 200): 3000, (8, 100, 0): 1, (None, 0, 0): 1}
