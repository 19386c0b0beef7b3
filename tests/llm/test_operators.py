"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidweave.llm import chat, divergence, encoding, jaccard, licenses, mixture, packing, quotient, rffquality, sharding, tokenfiles
from bidweave.llm import words as W
from bidweave.llm.common import bin_ranks, components, sorted_positions

from .conftest import corpus, sentence, words


def fetch(df):
    return [tuple(r) for r in df.collect()]


def order(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


# ---- helpers -----------------------------------------------------------------------------------

def test_words_of_bytes_equal_words_of_text(rows_):
    texts = [r[1] for r in rows_]
    data, offsets = W.utf8(pa.array(texts))
    starts, ends, hashes = W.words(data, offsets)
    bounds = W.row_bounds(starts, offsets)
    seen = {}
    for i, text in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])]
        assert got == words(text)
        for w, h in zip(got, hashes[bounds[i]:bounds[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ranks_and_positions(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 5, i % 7, i) for i in range(500)], "k int, v int, id int")
    for bins in (1, 16):
        got = fetch(bin_ranks(df, ["k"], ["v", "id"], "place", bins).select("k", "place"))
        for k, n in Counter(r[0] for r in got).items():
            assert sorted(p for key, p in got if key == k) == list(range(n))
    got = sorted(fetch(sorted_positions(df, [F.col("v"), F.col("id")], "place").select("place", "v", "id")))
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 90), (90, 95), (7, 7), (60, 50), (50, 60)]
    got = dict(fetch(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 100: 90, 90: 90, 95: 90, 60: 50, 50: 50}
    assert fetch(components(spark.createDataFrame([], "a long, b long"))) == []


# ---- 1 sharding ----------------------------------------------------------------------------------

def test_sharding(docs, rows_, empty):
    got = fetch(sharding.shard_documents(docs, 4))
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_), key=order)
    assert sorted((g[:3] for g in got), key=order) == want and {g[3] for g in got} == {"rows"} and {g[6] for g in got} == {None}
    sizes = Counter(g[4] for g in got)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(g[5] for g in got if g[4] == shard) == list(range(sizes[shard]))
    assert sharding.shard_documents(empty, 4).count() == 0


def test_sharding_keeps_copies_together_and_splits_a_hot_group(spark):
    rows = [(i, "hot" if i < 400 else f"t{(i - 400) // 2}" if i < 500 else f"u{i}") for i in range(1200)]
    got = fetch(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).select("doc_id", "shard"))
    assert set(Counter(s for _, s in got).values()) == {75}
    by = dict(got)
    assert len({by[i] for i in range(400)}) <= 8  # 400 rows need 6 shards of 75
    assert sum(by[i] == by[i + 1] for i in range(400, 500, 2)) >= 48


@pytest.mark.parametrize("size,groups", [(5, 800), (2, 2000), (5, 160), (2, 400)])
def test_sharding_joins_groups_where_no_document_is_unlinked(spark, size, groups):
    rows = [(i, f"t{i // size}") for i in range(size * groups)]
    got = dict(fetch(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 16).select("doc_id", "shard")))
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    cut = sum(len({got[g * size + k] for k in range(size)}) > 1 for g in range(groups))
    assert cut < 0.02 * groups


def test_propagation_lowers_the_cut_of_links_that_overlap(spark):
    """Communities of documents that share several links: the cut is held against an independent greedy propagation, which
    moves a document to the shard of most of its neighbours as long as there is room."""
    import random
    rng = random.Random(12)
    nodes, shards = 640, 8
    links = [(n, f"{n // 20}-{rng.randrange(4)}") for n in range(nodes) for _ in range(2)] + [(rng.randrange(nodes), f"x{i % 40}") for i in range(80)]
    links = sorted(set(links))
    start = {n: n % shards for n in range(nodes)}
    frame = spark.createDataFrame([(n, s, "kept") for n, s in start.items()], "node long, shard int, extra string")
    got = {r.node: r.shard for r in sharding.propagate(frame, spark.createDataFrame(links, "node long, link string"), shards).collect()}
    assert Counter(got.values()) == Counter(start.values())

    def cut(where):
        held = {}
        for n, link in links:
            held.setdefault(link, Counter())[where[n]] += 1
        return sum(sum(c.values()) - max(c.values()) for c in held.values())
    greedy, counts, of = dict(start), Counter(start.values()), {}
    for n, link in links:
        of.setdefault(link, []).append(n)
    mine = {}
    for n, link in links:
        mine.setdefault(n, []).append(link)
    for _ in range(8):
        for n in range(nodes):
            votes = Counter(greedy[m] for link in mine.get(n, []) for m in of[link] if m != n)
            for s, _ in votes.most_common():
                if s == greedy[n] or counts[s] < nodes // shards + 8:  # more room than a quota gives
                    counts[greedy[n]] -= 1
                    counts[s] += 1
                    greedy[n] = s
                    break
    assert cut(got) < 0.75 * cut(start) and cut(got) <= 1.5 * cut(greedy)


# ---- 2 divergence ------------------------------------------------------------------------------

def brute_repeats(text, size=5):
    w = words(text)
    seen = Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return len({i + k for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for k in range(size)})


def test_divergence(docs, rows_, empty):
    got = {}
    for r in divergence.divergence_rules(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(len(v) for v in got.values()) == len(rows_)
    for doc_id, text, *_ in rows_:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), brute_repeats(text))
        found = [r for r in got[doc_id] if tuple(r[1:6]) == want]
        assert found, (doc_id, want, got[doc_id])
        assert found[0]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (found[0]["base_failed"] and found[0]["kept"])
    assert divergence.divergence_rules(empty).count() == 0


def test_distance_and_verdict(spark, rows):
    p, q = [3.0, 0.0, 1.0], [1.0, 2.0, 1.0]
    a, b = np.array(p) / 4, np.array(q) / 4
    part = lambda x, m: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
    want = np.sqrt((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    got = rows([(p, q, [0.0, 0.0, 0.0])], "p array<double>, q array<double>, z array<double>",
               divergence.distance(F.col("p"), F.col("q")), divergence.distance(F.col("p"), F.col("p")), divergence.distance(F.col("p"), F.col("z")))
    assert got[0][0] == pytest.approx(want) and got[0][1] == pytest.approx(0, abs=1e-7) and got[0][2] == 0
    import random
    rng = random.Random(1)
    clean = [(i, sentence(rng, 150).translate(str.maketrans("0123456789", "abcdefghij")), "en") for i in range(40)]
    junk = [(100, " ".join(w.upper() + "!!" for w in clean[0][1].split()), "en"), (101, " ".join(w + "$$$" for w in clean[1][1].split()), "en")]
    kept = {r["doc_id"] for r in divergence.divergence_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert kept == {r[0] for r in clean}


def test_every_language_has_its_own_reference(spark):
    """20 languages of Latin letters, then a rarer one of Han, an empty and a null lang: clean texts stay, junk goes."""
    import random
    rng = random.Random(2)
    letters = str.maketrans("0123456789", "abcdefghij")
    latin = lambda n: sentence(rng, n).translate(letters)
    han = lambda n: " ".join(rng.choice(["的", "了", "在", "是", *[chr(0x4E00 + 7 * i) * 2 for i in range(400)]]) for _ in range(n))
    rows = [(1000 * k + i, latin(150), f"l{k:02}") for k in range(20) for i in range(40)]
    rare = [(50_000 + 1000 * k + i, han(150), lang) for k, lang in enumerate(["zh", "", None]) for i in range(30)]
    junk = [(80_000, " ".join("!?" + w for w in latin(150).split()), "zh"), (80_001, latin(150), ""), (80_002, latin(150), None)]
    docs = spark.createDataFrame(rows + rare + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in divergence.divergence_rules(docs).filter("kept").collect()}
    assert kept == {r[0] for r in rows + rare}
    lists = {r["lang"]: r["listed"] for r in divergence.word_lists(docs).collect()}
    assert set(lists) == {r[2] for r in rows + rare} and all(len(set(x)) == len(x) <= 10 for x in lists.values())


def test_short_texts_without_common_words(spark):
    """Ten words are 15% of the language: lacking them all gives a distance below 0.40."""
    import random
    rng = random.Random(4)
    common = "the of and to a in is that for it".split()
    rare = ["".join(rng.choice("bcdfglmnprstu") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    text = lambda n: " ".join(rng.sample([rng.choice(common) for _ in range(round(0.15 * n))] + [rng.choice(rare) for _ in range(n - round(0.15 * n))], n))
    clean = [(i, text(300), "en") for i in range(60)]
    short = [(100 + i, text(90), "en") for i in range(20)]
    salad = [(200 + i, " ".join(rng.choice(rare) for _ in range(n)), "en") for i, n in enumerate((25, 40, 60, 80, 99))]
    docs = spark.createDataFrame(clean + short + salad, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in divergence.divergence_rules(docs).filter("kept").collect()}
    assert kept.isdisjoint(r[0] for r in salad) and {r[0] for r in clean} <= kept and sum(r[0] in kept for r in short) >= 18


def test_a_language_of_few_documents_is_held_against_all(spark):
    """Junk with a lang of its own would be its own reference; the limit for own references is a number of documents."""
    import random
    rng = random.Random(7)
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, sentence(rng, 150).translate(letters), "en") for i in range(60)] + [(100 + i, sentence(rng, 150).translate(letters), "xx") for i in range(3)]
    junk = [(200, " ".join("".join(rng.choice("#$%&*|") for _ in range(5)) for _ in range(120)), "zz"), (201, " ".join(f"q{i}zx".translate(letters) for i in range(60)), "yy")]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in divergence.divergence_rules(docs).filter("kept").collect()}
    assert kept == {r[0] for r in rows}
    own = {r["lang"]: (r["own"], r["listed"]) for r in divergence.word_lists(docs).collect()}
    assert own["en"][0] and not own["xx"][0] and own["xx"][1] == own["zz"][1] and len(own["zz"][1]) == 10


# ---- 3 quality -----------------------------------------------------------------------------------

def test_quality(spark, docs, rows_, empty):
    import random
    rng = random.Random(5)
    good = [(i, sentence(rng, rng.randrange(30, 300)), "en", "a", 0) for i in range(300)]
    bad = [(1000 + i, " ".join(["spam!!"] * 50 + [sentence(rng, 10).upper()]), "en", "a", 0) for i in range(100)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    got = fetch(rffquality.quality_scores(frame, labels))
    held = [(d, p) for d, h, s, p in got if h]
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h, _, _ in got) and len(held) > 50
    assert np.mean([p == (d < 1000) for d, p in held]) > 0.97
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in got)
    assert got and {d for d, _, _, p in got if p} == {r[0] for r in rffquality.keep_good(frame, labels).select("doc_id").collect()}
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(fetch(rffquality.quality_scores(frame, flipped))) == sorted(got)
    # odd rows: all are scored
    assert rffquality.quality_scores(docs, labels).filter("score between 0 and 1").count() == len(rows_)
    assert {r[2] for r in fetch(rffquality.quality_scores(docs, labels.limit(0)))} == {0.5}
    assert rffquality.keep_good(docs, labels).columns == docs.columns
    assert rffquality.quality_scores(empty, labels).count() == 0


def test_isotonic_fit():
    centre, level = rffquality.rising_fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]), np.array([2.0, 2, 2, 3]))
    assert centre.tolist() == [1, 2.5, 4] and level.tolist() == [0, 0.75, 1]


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = pa.array([r[1] for r in corpus(n=10)])
    whole = rffquality.features(texts)
    monkeypatch.setattr(W, "SEGMENT", 1 << 12)
    assert np.allclose(rffquality.features(texts), whole)


# ---- 4 licences ----------------------------------------------------------------------------------

def test_licenses(spark, docs, rows_, empty):
    mit = licenses.TEMPLATES["MIT"][2]
    wrapped = "\n".join([mit[:90], mit[90:200], mit[200:]])
    cases = [(1, "text\nReleased under the MIT License.\nmore"), (2, "licensed under  CC BY-NC 4.0"), (3, f"before\n\n{wrapped}\n\nafter it"),
             (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0."),
             (5, "We spoke about the MIT license under a tree."), (6, None), (7, "")]
    got = {r[0]: r[1:] for r in fetch(licenses.license_scan(spark.createDataFrame(cases, "doc_id long, text string")))}
    assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "MIT", 4: "Apache-2.0,GPL-3.0", 5: "", 6: "", 7: ""}
    assert got[1][2] == 1.0 and got[5][1:] == (None, None)
    assert licenses.license_scan(docs).count() == len(rows_) and licenses.license_scan(empty).count() == 0


def test_license_notices_that_share_their_line(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    cases = [(1, "Copyright 2024 Example Authors. Released under the MIT License."),
             (2, "Copyright 2024 Example Authors. Released under the MIT License. See the file for details."),
             (3, f"{prose(300)} licensed under cc by-nc 4.0 {prose(300)}"),
             (4, f"{prose(3000)} {apache} {prose(3000)}"),
             (5, f"{prose(50)} released under the mit license {prose(40)} this work is licensed under the gnu general public license version 3 {prose(9)}"),
             (6, f"Released under the MIT License.\n{prose(20)} licensed under cc by 4 0 {prose(20)}"),
             (7, f"{prose(30)} licensed under cc by-sa 3.0 {prose(30)}"), (8, f"{prose(40)} the mit license {prose(40)}"),
             (9, f"{prose(30)} x licensed under cc by-nc 4.0\nReleased under the MIT License."),
             (10, f"Released under the MIT License.\nAll of this work's licensed under a Creative Commons Attribution 4.0 International License. {prose(9)}")]
    got = {r[0]: r[1:] for r in fetch(licenses.license_scan(spark.createDataFrame(cases, "doc_id long, text string")))}
    assert {k: v[0] for k, v in got.items()} == {1: "MIT", 2: "MIT", 3: "CC-BY-NC-4.0", 4: "Apache-2.0", 5: "GPL-3.0,MIT", 6: "CC-BY-4.0,MIT", 7: "", 8: "",
                                               9: "CC-BY-NC-4.0,MIT", 10: "CC-BY-4.0,MIT"}
    assert got[1][2] == got[2][2] == got[3][2] == 1.0 and got[4][2] == 1.0


def test_license_versions_and_relatives(spark):
    gnu = ("This {} is free software; you can redistribute it and/or modify\n it under the terms of the GNU {} as published by\n the Free Software "
           "Foundation; either version {} of the License, or\n (at your option) any later version.\n")
    bsd = ("Copyright (c) 2024, Example Authors\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, "
           "are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, "
           "this\n  list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice,\n"
           "  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n\n")
    third = ("* Neither the name of Example Authors nor the names of its\n  contributors may be used to endorse or promote products derived from\n"
             "  this software without specific prior written permission.\n\n")
    end = licenses._AS_IS.replace("ANY", "ANY\n")
    cases = [(1, gnu.format("program", "General Public License", "2"), "GPL-2.0"), (2, gnu.format("program", "General Public License", "3"), "GPL-3.0"),
             (3, gnu.format("library", "Lesser General Public License", "2.1"), "LGPL-2.1"),
             (4, gnu.format("program", "Affero General Public License", "3"), "AGPL-3.0"),
             (5, gnu.format("library", "Library General Public License", "2"), "LGPL-2.0"),
             (6, gnu.format("program", "Lesser General Public License", "3"), "LGPL-3.0"),
             (7, bsd + end, "BSD-2-Clause"), (8, bsd + third + end, "BSD-3-Clause"),
             (9, "int x;\n\n" + gnu.format("program", "General Public License", "2").replace("\n", "\n * ") + "\n\nint y;", "GPL-2.0")]
    known = [(name, text) for name, texts in licenses.all_templates().items() for text in texts]
    cases += [(100 + 2 * i + k, t, name) for i, (name, text) in enumerate(known) for k, t in enumerate((text, "x y " * 50 + " ".join(text.split()) + " y x" * 50))]
    got = {r[0]: r[1] for r in fetch(licenses.license_scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")))}
    assert got == {c[0]: c[2] for c in cases}
    assert {"AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0"} <= {name for name, text in known if len(text) > 3000}


# ---- 5 mixture -----------------------------------------------------------------------------------

def test_fill_with_documents_longer_than_the_exact_program():
    rng = np.random.default_rng(7)
    got = mixture.fill(np.array([60000, 51000, 49000]), np.array([1, 1, 1]), 100000)
    assert got.tolist() == [0, 1, 1]
    for _ in range(40):  # no common divisor; every subset is tried
        lengths = np.unique(rng.integers(20_000, 90_000, 8))
        sums = np.array([sum(int(x) for k, x in enumerate(lengths) if m >> k & 1) for m in range(1 << len(lengths))])
        budget = int(rng.integers(100_000, lengths.sum()))
        taken = mixture.fill(lengths, np.ones(len(lengths), np.int64), budget)
        assert (taken >= 0).all() and (taken <= 1).all()
        assert abs(int((taken * lengths).sum()) - budget) <= np.abs(sums - budget).min() + len(lengths) * (budget / mixture.KNAPSACK + 1)


def test_fill_is_as_near_as_possible():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = mixture.fill(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        base = np.array([c * budget // max(1, (lengths * counts).sum()) for c in counts])
        reach = {0}
        for n, c in zip(lengths, counts - base):
            reach = {r + k * int(n) for r in reach for k in range(c + 1)}
        rest = budget - int((base * lengths).sum())
        below = rest - max(r for r in reach if r <= rest)
        left = budget - int((taken * lengths).sum())
        assert left == below or below > -left > 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def test_mixture(docs, rows_, empty):
    got = fetch(mixture.mix_report(docs))
    assert sorted((g[:2] for g in got), key=order) == sorted(((r[0], len(words(r[1]))) for r in rows_), key=order)
    sizes = Counter()
    for r in rows_:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    assert sorted({(g[2], round(g[3], 6)) for g in got}) == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
    assert all(g[4] in (0, g[1], 2 * g[1]) for g in got)
    mixed = fetch(mixture.mix(docs).select("source", "text"))
    taken = Counter()
    for source, text in mixed:
        taken[source] += len(words(text))
    for s, t in want.items():
        half = max(len(words(r[1])) for r in rows_ if r[3] == s) / 2  # one document is most of its source
        assert abs(taken[s] - t) <= max(1, half), (s, taken[s], t)
    assert sum(taken.values()) == sum(g[4] for g in got)
    assert sorted(got, key=order) == sorted(fetch(mixture.mix_report(docs.repartition(3))), key=order)
    assert mixture.mix(docs).columns == docs.columns
    assert mixture.mix_report(empty).count() == 0 and mixture.mix(empty).count() == 0


# ---- 6 chat --------------------------------------------------------------------------------------

def test_chat(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|end|> there"), (1, 2, "Bob", "Hello\nAnn"), (1, 3, "Ann", None), (1, 3, "", "who"),
             (1, None, "Cy <b>", "late"), (2, 0, "system", "alone"), (None, 0, "Ann", "null one"), (3, 0, "Ann", "x"), (3, 0, "Ann", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("at", F.lit(2))
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, "Ann"), (1, "Bob"), (1, "Cy_b_"), (None, "Ann"), (3, "Ann")}
    for (conv, speaker), r in got.items():
        said = [r["text"][m["start"]:m["end"]] for m in r["mask"]]
        if (conv, speaker) == (1, "Ann"):
            assert said == ["Hi < |end|> there<|end|>", "<|end|>"]
            assert r["text"] == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |end|> there<|end|>\n<|user name=Bob|>\nHello\nAnn<|end|>\n"
                                 "<|user name=unknown|>\nwho<|end|>\n<|assistant|>\n<|end|>\n<|user name=Cy_b_|>\nlate<|end|>\n")
        if conv == 3:
            assert r["n_turns"] == 2 and said == ["x<|end|>", "x<|end|>"]
    # roles that look alike are participants of their own, also beside a turn without a role
    alike = spark.createDataFrame([(5, 1, "user 1", "a"), (5, 2, "user_1", "b"), (5, 3, "unknown", "c"), (5, 4, None, "d"), (5, 5, "user|1", "e" * 300_000)],
                                  "conv_id long, turn long, role string, text string")
    got = {r["speaker"]: r for r in chat.rotate(alike).collect()}
    said = {s: [r["text"][m["start"]:m["end"]][:2] for m in r["mask"]] for s, r in got.items()}
    assert said == {"user_1": ["a<"], "user_1 #2": ["b<"], "user_1 #3": ["ee"], "unknown #2": ["c<"]}
    assert all(r["text"].count("name=unknown|>") == 1 for r in got.values()) and "name=user_1 #3|>\neee" in got["user_1"]["text"]
    # a conversation in parts
    long = spark.createDataFrame([(9, i, "ab"[i % 2], f"t{i}") for i in range(25)], "conv_id long, turn long, role string, text string")
    whole = {r["speaker"]: r["text"] for r in chat.rotate(long).collect()}
    parts = sorted((r["speaker"], r["part"], r["first_turn"], r["text"]) for r in chat.rotate(long, part_turns=10).collect())
    assert [p[2] for p in parts] == [0, 10, 20] * 2 and all("".join(p[3] for p in parts if p[0] == s) == whole[s] for s in "ab")
    assert chat.rotate(long.limit(0)).count() == 0


# ---- 7 packing, 10 token files ----------------------------------------------------------------

def brute_ids(text, tokenizer):
    from tokenizers import Tokenizer
    brute_ids.tok = getattr(brute_ids, "tok", None) or Tokenizer.from_file(tokenizer)
    return np.array(brute_ids.tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


ODD = ["", "  ", "a<|endoftext|>b c", "<|endoftext|>. <|STARTOFTEXT|>", "İstanbul ΣΑΣ don't It's 'S a's.'s ... ...a. é .́x x.́", "한글 ㅎㅏㄴ 12ab 1,2 ½ Ⅷ",
       "a\x1cb \x85 c　d", "ﬁ ß ẞ ŉ ǰ", "foo'. BAR,, baz.) A\x00b", "日本語テキスト。です", "x'll x'LL 'd", None]


def test_encoder_equals_tokenizer(rows_, tokenizer):
    texts = ODD + [r[1] for r in rows_]
    for room in (0, 50, 10**6):
        got = list(encoding.Encoder(tokenizer, cache_words=room).rows(pa.array(texts)))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [brute_ids(t, tokenizer).tolist() for t in texts]


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 400):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], np.zeros(n, int)
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), None)
            if k is None:
                k = len(free)
                free.append(100)
            want[i] = k
            free[k] -= lengths[i]
        assert bins.tolist() == want.tolist()


def test_packing(docs, rows_, empty, tokenizer):
    got = fetch(packing.pack(docs, tokenizer, size=64, group_pieces=100))
    lost = Counter()
    for doc_id, text, *_ in rows_:
        ids = brute_ids(text, tokenizer)
        for start in range(0, len(ids), 64):
            part = ids[start:start + 64]
            lost[(doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter(g[:5] for g in got) == lost
    used = {}
    for g in got:
        used.setdefault(g[5], []).append((g[6], g[2]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(g[2] for g in got) / (64 * len(used)) > 0.98
    assert packing.pack(empty, tokenizer).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 5000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        slots = tokenfiles.PerfectHash.build(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
    ids, nulls, occ = np.array([5, 5, 0, 9]), np.array([False, False, True, False]), np.array([0, 1, 0, 0])
    for width in (2, 4):
        index = tokenfiles.Index(tokenfiles.pack_index(ids, nulls, occ, np.array([0, 3, 4, 8]), np.array([3, 1, 4, 2]), width))
        assert index.width == width
        places, counts, found = index.find(ids, nulls, occ)
        assert places.tolist() == [0, 3, 4, 8] and counts.tolist() == [3, 1, 4, 2] and found.all()
        assert not index.find(np.array([6, 0, 5]), np.array([False, False, False]), np.array([0, 0, 2]))[2].any()


def test_token_files(docs, rows_, empty, tokenizer):
    got = sorted(fetch(tokenfiles.token_files(docs, tokenizer, shards=6)), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows_), key=lambda x: (x is None, x or 0))
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    want = Counter((r[0], len(brute_ids(r[1], tokenizer)), zlib.crc32(brute_ids(r[1], tokenizer).tobytes())) for r in rows_)
    assert Counter((g[0], g[2], g[3]) for g in got) == want
    assert tokenfiles.token_files(empty, tokenizer).count() == 0


# ---- 8 similar documents -----------------------------------------------------------------------

def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(lower))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    group = [group[j] if g == group[i] else g for g in group]
    return sets, group


@pytest.mark.parametrize("size,percent,bits,cell", [(4, 85, 16, 1024), (5, 80, 6, 4)])
def test_similar_documents(docs, rows_, empty, size, percent, bits, cell):
    """Small counters and cells: results do not depend on them."""
    sets, group = brute_components(rows_, size, percent)
    smallest = {}
    for r, g, s in zip(rows_, group, sets):
        if s:
            smallest[g] = min((x for x in (smallest.get(g), r[0]) if x is not None), default=None)
    want = Counter((r[0], len(s), smallest[g] if s else r[0]) for r, g, s in zip(rows_, group, sets))
    assert Counter(fetch(jaccard.similar_documents(docs, size, percent, bits, cell))) == want
    stay = fetch(jaccard.drop_similar(docs, size, percent, bits, cell).select("doc_id", "text"))
    left = Counter(g for g, s in zip(group, sets) if s)
    assert len(stay) == len(left) + sum(not s for s in sets)
    assert {r[0] for r in stay} >= {i for i in smallest.values() if i is not None}
    assert jaccard.similar_documents(empty, size, percent, bits).count() == 0
    assert jaccard.drop_similar(docs, size, percent, bits).columns == docs.columns


def test_similar_families_over_many_cells(spark):
    """A chain of near copies and a family whose members mostly do not link, over cells of 8."""
    import random
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(40):  # every copy has its own changes: few pairs link
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(120)] = f"r{rng.randrange(10**9)}"
        rows.append((k, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for k in range(20):
        chain[k * 4] = f"z{k}"
        rows.append((100 + k, " ".join(chain)))
    sets, group = brute_components(rows, 4, 85)
    smallest = {}
    for r, g in zip(rows, group):
        smallest[g] = min(smallest.get(g, r[0]), r[0])
    got = fetch(jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 10, 8))
    assert sorted(got) == sorted((r[0], len(s), smallest[g]) for r, s, g in zip(rows, sets, group))


def test_bitmap_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)]))
        if not len(y):
            continue
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        size = min(len(a), len(b))
        differing = int(np.bitwise_count(jaccard.fold_bitmap(a, size) ^ jaccard.fold_bitmap(b, size)).sum())
        both = len(np.intersect1d(x, y))
        assert differing <= len(x) + len(y) - 2 * both
        if 100 * both >= 85 * (len(x) + len(y) - both):
            assert jaccard.may_link(len(x), len(y), differing, 85)


# ---- 9 exact duplicates ------------------------------------------------------------------------

def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(6)
    values = (rng.integers(0, 40, 500).astype(np.uint64) << np.uint64(54)) | rng.integers(0, 5, 500).astype(np.uint64)
    parts = []
    for part in np.array_split(values, 4):
        found, counts = np.unique(part, return_counts=True)
        parts.append(quotient.QuotientFilter.from_bytes(quotient.QuotientFilter.of(54, 0, 64, found, counts).to_bytes()))
    merged = parts[0].merge(*parts[1:])
    found, counts = np.unique(values, return_counts=True)
    assert merged.fingerprints().tolist() == found.tolist() and merged.counts.tolist() == counts.tolist()


def test_repeated_values(spark):
    values = [(i % 700 - 300,) for i in range(1000)] + [(-2**63,), (2**63 - 1,), (2**63 - 1,)]
    got = dict(fetch(quotient.repeated(spark.createDataFrame(values, "v long").repartition(4), "v", 1000, 64, 100)))
    assert got == {v: n for (v,), n in Counter(values).items() if n > 1}


def test_exact_duplicates(docs, rows_, empty):
    import re
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows_]
    size, keep = Counter(clean), {}
    for r, t in zip(rows_, clean):
        keep[t] = min((x for x in (keep.get(t), r[0]) if x is not None), default=None)
    got = quotient.exact_duplicates(docs).collect()
    want = Counter((r[0], keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows_, clean))
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    kept = [g for g in got if g["kept"]]
    assert len(kept) == len(size) and all(g["doc_id"] == g["keep_id"] for g in kept)
    stay = quotient.drop_copies(docs)
    assert stay.columns == docs.columns and Counter(r["doc_id"] for r in stay.collect()) == Counter(g["doc_id"] for g in kept)
    assert quotient.exact_duplicates(empty).count() == 0 and quotient.drop_copies(empty).count() == 0
