"""Passage removal (operator 11) against a brute-force version, on texts with shared passages, copies and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from bidweave.llm import suffixdedup as S


def brute(rows, width):
    """(doc_id, n_bytes, removed ranges, kept) of every row, from a table of all strings of `width` bytes."""
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    least = {}
    for doc, text in texts:
        for i in range(len(text) - width + 1):
            part = text[i:i + width]
            least[part] = min(least.get(part, np.inf), np.inf if doc is None else doc)
    out = []
    for doc, text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - width + 1):
            if least[text[i:i + width]] < (np.inf if doc is None else doc):
                gone[i:i + width] = b"\1" * width
        edges = [i for i in range(len(text) + 1) if (gone[i] if i < len(text) else 0) != (gone[i - 1] if i else 0)]
        out.append((doc, len(text), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(text, gone) if not g)))
    return out


def shared_texts(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.choice([8, 20, 60]))) for _ in range(6)]
    line = "a line that many of the texts hold, word for word, among others."
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(5), rng.choice([*passages, line, line]))
        rows.append((rng.choice([i, i, i, None]), rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(300, rows[5][1])] * 3 + [(300, "x" * 130), (301, "x" * 200), (302, "x" * 49), (303, "x" * 50)]
    rows += [(400, None), (401, ""), (None, None), (None, "y" * 60), (None, "y" * 70), (402, "z" * 80), (402, "z" * 90), (-5, rows[7][1] + "x")]
    rows += [(500, " ".join(word() for _ in range(30_000)) + line), (90, line)]
    rng.shuffle(rows)
    return rows


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("width,block,hot", [(50, 1 << 14, S.HOT), (50, 1 << 22, S.HOT), (50, 1 << 13, 8), (20, 1 << 14, 4), (9, 1 << 14, 1 << 15)])
def test_against_all_strings(spark, width, block, hot):
    rows = shared_texts(width + block)
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, row int, block string, kept int").repartition(4)
    assert found(S.drop_repeats(frame, width, block, hot)) == sorted(brute(rows, width), key=repr)


def test_empty_table(spark, empty):
    assert found(S.drop_repeats(empty)) == []
    assert found(S.drop_repeats(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string"))) == [(1, 0, [], b""), (2, 5, [], b"short")]


def test_pointers_follow_the_order_of_suffixes():
    rng = np.random.default_rng(5)
    for width in (8, 9, 20, 50):
        data = rng.integers(0, 2, 3000).astype(np.uint8)
        data[500:900] = 7
        data[1000:1300] = data[2000:2300]
        pointers = S.refine(data, width)[:len(data) - width + 1]
        strings = [data[i:i + width].tobytes() for i in range(len(pointers))]
        order = np.argsort(pointers, kind="stable")
        assert [strings[i] for i in order] == sorted(strings)
        assert all((strings[a] == strings[b]) == (pointers[a] == pointers[b]) for a, b in zip(order, order[1:]))


def test_runs_cover_every_window_once(monkeypatch):
    monkeypatch.setattr(S, "STEP", 64)
    texts = ["", "ab" * 100, "x" * 49, None, "hello world " * 30, "y" * 50, ""]
    data, offsets = S.W.utf8(pa.array(texts))
    starts, sizes, keys, rows = S.runs_of(data, offsets, 50)
    got = sorted((int(r), int(s - offsets[r]) + k) for s, n, r in zip(starts, sizes, rows) for k in range(n))
    assert got == [(r, i) for r, t in enumerate(texts) for i in range(len((t or "").encode()) - 49)]
    same = {}
    for s, n, key in zip(starts, sizes, keys):
        for i in range(s, s + n):
            assert same.setdefault(hashlib.sha1(data[i:i + 50].tobytes()).digest(), key) == key
