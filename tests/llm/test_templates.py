"""Decontamination against brute force over all offsets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from planewise.llm import templates


def split(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", templates.tokens(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def slot(w):
    return w.startswith("⟨")


def share(doc, item):
    """Whether an alignment of the two, at any offset, has words enough or the whole item, and slots that agree."""
    width = min(len(item), 8)
    for offset in range(-len(item), len(doc)):
        at = []
        for k in range(len(item) - width + 1):
            own, theirs = doc[max(0, offset + k) : offset + k + width] if offset + k >= 0 else [], item[k : k + width]
            bare = [[w[:3] if slot(w) else w for w in x] for x in (own, theirs)]
            if bare[0] == bare[1] and (own == theirs or not all(map(slot, theirs))):
                at.append(k)
        places = {k + j for k in at for j in range(width)}
        pairs = {(doc[offset + p], item[p]) for p in places if slot(item[p])}
        enough = sum(not slot(item[p]) for p in places) >= 5 or len(at) == len(item) - width + 1
        if at and enough and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
            return True
    return False


def test_all_offsets(spark):
    """Quotes of 7 to 20 words at all places, short items, and items dense with numbers."""
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))

    items = [prose(30), prose(8), prose(10), prose(5), "what is half of ninety two", "3 kg of rice at 4 dollars and 5 kg of beans at 6 dollars and 7 kg of peas"]
    items += ["add 3 kg to 4 kg", "", "...", "12 13 14 15 16 17 18 19 20"]
    docs = []
    for n in range(7, 21):
        start = rng.randrange(30 - n)
        docs += [f"{prose(k)} {' '.join(items[0].split()[start:start + n])} {prose(5)}" for k in range(1, 7)]
    docs += [f"{prose(k)} {item} {prose(9)}" for item in items[1:] for k in range(1, 7)]
    words = items[0].split()
    docs += [f"{prose(k)} {' '.join([*words[:9], 'changed', *words[10:19]])} {prose(3)}" for k in range(1, 7)]
    docs += [f"{prose(k)} 8 kg of rice at 9 dollars and 2 kg of beans {prose(4)}" for k in range(1, 7)]
    docs += [f"{prose(k)} 8 kg of rice at 9 dollars and {prose(4)}" for k in range(1, 7)]
    docs += [f"{prose(2)} add 7 kg to 9 kg {prose(2)}", f"{prose(2)} add 7 kg to 7 kg {prose(2)}", "1 2 3 4 5 6 7 8 9 10 11", "", "...", prose(40)]
    x, y = split(spark, docs), split(spark, items)
    want = {d: sorted(i for i, b in enumerate(y) if b != [""] and share(a, b)) for d, a in enumerate(x)}
    tables = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r["items"] for r in templates.decontaminate(*tables).collect()}
    assert got == want
    assert all(got[d] == [0] for d in range(6, 84)) and not any(got[d] for d in range(6))
    assert sum(map(bool, got.values())) > 120


def test_texts_are_aligned_one_by_one(spark):
    """Rows without an id, or that repeat one, do not spoil each other's slots; an item may follow a small letter."""
    item = "Bob sold 3 apples for her"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "now Bob sold 7 apples for her today"), (None, "now Bob sold 9 apples for her today"), (2, "Bob sold 3 apples for her")]
    got = templates.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [r.contaminated for r in got] == [True] * 3
