"""Repeated strings, phrases and lines against brute force, with odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from planewise.llm import lines, phrases, substrings
from planewise.llm.registry import op10_line_dedup, op1_suffix_array_dedup, op3_repeated_phrases

SCHEMA = "doc_id long, text string, lang string, start int, h long, row string"


def frame(spark, rows):
    """With further columns, some named like those the operators use inside."""
    return spark.createDataFrame([(i, t, None, 1, 2, "x") for i, t in rows], SCHEMA)


def cut_strings(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    often = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if often[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, f in zip(b, gone, strict=True) if not f)
        yield i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), sha256(kept).hexdigest()


def cut_phrases(rows, width):
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first: dict = {}
    for i, w in texts:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        yield i, len(w), sum(gone), sha256(b" ".join(x for x, f in zip(w, gone, strict=True) if not f)).hexdigest()


def cut_lines(rows, width=3):
    windows = []
    for i, t in rows:
        parts = (t or "").split("\n") if t is not None else []
        windows += [((i is not None, i or 0, k), tuple(parts[k : k + width])) for k in range(len(parts) - width + 1)]
    first: dict = {}
    for place, key in sorted(windows):
        first.setdefault(key, place)
    for i, t in rows:
        parts = t.split("\n") if t is not None else []
        gone = {k + o for k in range(len(parts) - width + 1) for o in range(width) if i is not None and first[tuple(parts[k : k + width])] != (True, i, k)}
        yield i, None if t is None else "\n".join(x for k, x in enumerate(parts) if k not in gone), len(parts), len(gone)


def random_rows(vocabulary, glue, seed):
    rng = random.Random(seed)
    base = [glue.join(rng.choice(vocabulary) for _ in range(90)) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, glue.join(["x"] * 200)), (4, "a"), (5, base[0]), (5, base[0]), (5, base[1]), (None, base[2]), (6, base[2]), (7, base[3] + glue + base[3])]
    for k in range(40):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(12))]
        part = base[rng.randrange(5)].split(glue) if glue else list(base[rng.randrange(5)])
        at = rng.randrange(len(part))
        rows.append((10 + k, glue.join([*own, *part[at : at + rng.randrange(90)], *own])))
    return rows


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("length", "crowded"), [(9, 4096), (30, 2)])
def test_strings(spark, monkeypatch, length, crowded):
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (crowded,))
    monkeypatch.setattr(substrings, "UNIT", 300)
    rows = random_rows(list("abcé"), "", 1)
    same(substrings.dedup_substrings(frame(spark, rows), length=length), cut_strings(rows, length))


def test_strings_with_ids_that_repeat(spark):
    """Thousands of rows without an id, rows of one id with different texts, and texts whose checksums agree."""
    rng = random.Random(8)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    rows = [(None, rng.choice(shared)[rng.randrange(20) :] + str(k)) for k in range(5000)]
    rows += [(7, shared[k % 40] + "x" * k) for k in range(50)] + [(None, shared[0]), (None, shared[0]), (None, None), (8, "short")]
    same(substrings.dedup_substrings(frame(spark, rows), length=30), cut_strings(rows, 30))


def test_refinement_compares_bytes():
    """Windows that agree in their ids but not in their bytes are told apart."""
    import numpy as np

    data = np.frombuffer(b"abcdefghijklabcdefghijklabcdefghijkX", np.uint8)
    at = np.array([0, 12, 24])
    assert substrings.same_bytes(data, at, np.zeros(3, np.int64), 12).tolist() == [True, True, False]
    live, bucket = substrings.refine(substrings._buckets(data, 8), at, 12, 8)
    assert sorted(live.tolist()) == [0, 1] and len(set(bucket.tolist())) == 1


def test_strings_in_pieces(monkeypatch):
    """A text hashed in overlapping pieces has the same windows."""
    import pyarrow as pa

    text = "".join(random.Random(2).choice("ab") for _ in range(3000))
    whole = list(substrings.find_blocks(pa.array([text]), 40, 10))
    monkeypatch.setattr(substrings, "PIECE", 500)
    monkeypatch.setattr(substrings, "CHUNK", 100)
    pieces = list(substrings.find_blocks(pa.array([text]), 40, 10))
    assert sum(int(f[4].sum()) for f in whole) == sum(int(f[4].sum()) for f in pieces) == 2961
    assert len(pieces) > 1


@pytest.mark.parametrize(("width", "gram", "shard"), [(13, 4, 6 << 20), (5, 2, 1500)])
def test_phrases(spark, width, gram, shard):
    rows = random_rows(["the", "a", "of", "é", "ßß", "x."], " ", 3) + [(90, "a\tb\x0bc  d\r\n" * 8), (91, "a b c d " * 8)]
    same(phrases.dedup_phrases(frame(spark, rows), width=width, gram=gram, shard=shard), cut_phrases(rows, width))


def test_phrases_whose_hashes_agree_stay(spark, monkeypatch):
    """All words have one hash, so every window seems to recur; the automata find only what does."""
    rng = random.Random(5)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(own)]

    class Weak(phrases.Shard):
        def __init__(self, table, width, gram):
            super().__init__(table, width, gram)
            self.blocks.windows = self.blocks.windows * 0
            self.blocks.anchor = self.blocks.anchor * 0
            self.blocks.content = self.blocks.content * 0

    monkeypatch.setattr(phrases, "Shard", Weak)
    assert [r.n_removed for r in phrases.dedup_phrases(frame(spark, rows), width=5, gram=2).collect()] == [0] * 6
    monkeypatch.undo()
    again = frame(spark, [*rows, (9, own[2])])
    assert {r.doc_id: r.n_removed for r in phrases.dedup_phrases(again).collect()}[9] == 30
    monkeypatch.setattr(phrases, "automata", lambda passages: iter(()))
    assert {r.doc_id: r.n_removed for r in phrases.dedup_phrases(again).collect()}[9] == 0


def test_lines(spark):
    rows = random_rows(["one", "two", ""], "\n", 4) + [(80, "a\nb\nc\na\nb\nc\na\nb\nc"), (81, "z\nz\nz\nz\nz"), (82, "a\nb")]
    rows += [(83, "a\nb\nc\nq"), (83, "r\ns\nt\nu\nv"), (83, "w")]
    same(lines.dedup_lines(frame(spark, rows)), cut_lines(rows))


def test_lines_that_crowd(spark):
    """Windows with more than two places are dealt to many tasks; rows without an id spread by their text."""
    rows = random_rows(["one", "two", ""], "\n", 6) + [(100 + k, "a\nb\nc\nd\n" * 3) for k in range(30)]
    frame_ = frame(spark, rows)
    same(lines.dedup_lines(frame_), cut_lines(rows))
    plan = lines.cut_lines(frame_, heavy=2)
    got = {r.id: (r.kept, r.n_lines, r.n_removed) for r in plan.select("row.doc_id", "kept", "n_lines", "n_removed").withColumnRenamed("doc_id", "id").collect()}
    want = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(frame_).collect()}
    assert got == want
    odd = frame(spark, [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (1, "a\nb\nc"), (2, "x\na\nb\nc")])
    assert sorted(((r.doc_id, r.text) for r in lines.dedup_lines(odd).collect()), key=str) == sorted([(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (1, ""), (2, "x")], key=str)


@pytest.mark.parametrize("cut", [substrings.dedup_substrings, phrases.dedup_phrases, lines.dedup_lines])
def test_empty(spark, cut):
    assert cut(frame(spark, [])).collect() == []


def test_registered(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(op1_suffix_array_dedup(spark, sf_dir), cut_strings(rows, 200))
    same(op3_repeated_phrases(spark, sf_dir), cut_phrases(rows, 13))
    same(op10_line_dedup(spark, sf_dir), cut_lines(rows))


def test_long_passages(spark, monkeypatch):
    """A copy of a text with more different words than there are characters to code them, and passages cut to pieces at every length."""
    words = [f"w{i}" for i in range(1_200_000)]
    rows = [(1, " ".join(words)), (2, "before " + " ".join(words) + " after")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in phrases.dedup_phrases(frame(spark, rows)).collect()}
    assert got == {1: (1_200_000, 0), 2: (1_200_002, 1_200_000)}
    for most in range(13, 40):
        first, at, length = phrases.pieces(np.array([7, 8]), np.array([3, 0]), np.array([61, 13]), 13, most)
        windows = [(f, a + k) for f, a, n in zip(first, at, length, strict=True) for k in range(n - 12)]
        assert sorted(windows) == [(7, 3 + k) for k in range(49)] + [(8, 0)] and max(length) <= most
