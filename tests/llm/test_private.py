"""Surrogates that meet entities of the corpus."""

from __future__ import annotations

import itertools

from planewise.llm import private

NAMES = [f"Dr {a}{b}" for a, b in itertools.product("BCDFGHJKLMNPQRSTVWXYZ", "aeiou")]
ADDRESSES = [".".join(x) for x in itertools.product("0123456789", repeat=4)]


def replaced(spark, texts, key="k", **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in private.replace_private(rows, key, **options).orderBy("doc_id").collect()]


def test_fixed_points_and_chains(spark):
    """An entity that maps to itself, and one that maps to another, settle; different entities stay different."""
    names = spark.createDataFrame([(x,) for x in ADDRESSES], "m string")
    for key in ("k0", "k1", "k2", "k3", "k4"):
        once = {r.m: r.s for r in names.selectExpr("m", f"{private._surrogate(key)} as s").collect()}
        fixed = [m for m, s in once.items() if m == s]
        if fixed:
            break
    chain = next([m, once[m]] for m in once if once[m] != m and once[once[m]] not in (m, once[m]))
    texts = [fixed[0], *chain]
    got = replaced(spark, texts, key=key)
    assert len(set(got)) == 3 and not set(got) & set(texts)
    assert all(len(s) == 7 for s in got)


def test_full_format(spark):
    """The corpus holds all values of a format."""
    mails = [f"{a}@x.com" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"a@{a}.com" for a in "abcdefghijklmnopqrstuvwyz"]
    got = replaced(spark, NAMES + mails, max_rounds=1)
    assert len(set(got)) == len(got) and not set(got) & set(NAMES + mails)
    assert all(s.startswith("Dr ") for s in got[:105]) and all(s.endswith(".com") for s in got[105:])


def test_people_stay_the_same_and_covered(spark):
    """Full names, introduced names and names behind a mailbox; later mentions by one word follow them, text by text."""
    texts = [
        "Then John Smith came. Later Smith left, and John said so; the Smithsonian stayed.",
        "my name is Priya Raman and Raman is my surname.",
        "Write to wei.zhang@mail.example.com: Wei Zhang will answer. Zhang is in.",
        "A smith is no Smith here.",
        "Dr Smith, or John Smith.",
        "Regards,\nYusuf Demir",
    ]
    got = replaced(spark, texts)
    hidden = [("John", "Smith "), ("Priya", "Raman"), ("Wei", "Zhang", "wei", "zhang"), (), ("Smith", "John"), ("Yusuf", "Demir")]
    assert all(w not in g for g, words in zip(got, hidden, strict=True) for w in words)
    first, last = got[0].split()[1:3]
    assert got[0] == f"Then {first} {last.strip('.')} came. Later {last} left, and {first} said so; the Smithsonian stayed."
    assert got[3] == texts[3]
    assert got[4] == f"Dr {last}, or {first} {last}."
    other = got[1].split()
    assert other[3:5] == [other[3], other[6]] and other[3] != other[6]
    people = [got[0].split()[1:3], got[1].split()[3:5], got[5].split()[1:3]]
    assert len({tuple(p) for p in people}) == 3


def test_a_key_is_asked_for(spark):
    import pytest

    with pytest.raises(TypeError):
        private.replace_private(spark.createDataFrame([], "doc_id long, text string"))


def test_no_two_names_become_one(spark):
    """All names of a pattern and all listed given names: the cipher's words stay clear of the lists."""
    words = ["".join(x) for x in itertools.product("BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "aeiou")]
    words += [n for names in private.GIVEN for n in names]
    table = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string").repartition(4)
    for key in ("k", "another"):
        got = {r.w: r.s for r in table.selectExpr("w", f"{private._word(key)} as s").collect()}
        assert len(set(got.values())) == len(got)
        assert all((got[w] in names) == (w in names) for w in got for names in private.GIVEN)
    some = [f"Dr {w}" for w in words[-80:]] + [f"Dr {w}" for w in words[:300]]
    both = replaced(spark, some)
    assert len(set(both)) == len(set(some)) and not set(both) & set(some)


def test_a_person_keeps_one_name(spark):
    """A surname whose surrogate is another person's of the corpus: all its mentions move on together."""
    (s,) = [r.s for r in spark.createDataFrame([("Smith",)], "w string").selectExpr(f"{private._word('k')} as s").collect()]
    texts = ["Dr Smith came. Later Smith left.", f"Dr {s} is here.", "Prof Smith and Dr Jane Smith."]
    got = replaced(spark, texts)
    new = got[0].split()[1]
    assert got[0] == f"Dr {new} came. Later {new} left." and new not in ("Smith", s)
    assert s not in got[1] and got[1].startswith("Dr ") and new not in got[1]
    assert got[2].split()[1] == new and got[2].split()[-1] == f"{new}."


def test_very_long_text_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "no data here " * 200_000 + "Dr Smith", 1, "x"), (2, None, 1, "x"), (None, "", 1, "x"), (None, "a@b.com", 1, "x"), (None, "a@b.com", 1, "x")], "doc_id long, text string, found int, m string")
    got = private.replace_private(rows, "k").collect()
    assert sorted(r.n_entities for r in got) == [0, 0, 1, 1, 1]
    assert len({r.text for r in got if r.text and "@" in r.text}) == 1
