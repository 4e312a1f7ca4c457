"""Fingerprints, pieces, languages, templates and surrogates."""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import xxhash

from planewise.llm import language, pieces, private, simhash, templates
from planewise.llm.registry import op4_sentencepiece, op5_language_id, op7_simhash_near_dedup

ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "x" * 5000), (5, "x" * 5000), (None, "two words"), (6, "Zażółć gęślą 日本語 😀\r\n\t<s> ▁▁ 1234")]
SCHEMA = "doc_id long, text string, lang string, fp long, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 2) for i, t in rows], SCHEMA)


def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest id reachable over links of two bits or fewer."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf_dir):
    fps = {i: plain_fingerprint(t) for i, t, _ in documents(spark, sf_dir)}
    groups = plain_groups(fps)
    got = op7_simhash_near_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", groups[i]) for i in fps}
    odd = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(frame(spark, ODD)).collect()}
    assert odd == {(i, f"{plain_fingerprint(t):016x}") for i, t in ODD}
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_crowded_links_lose_nothing(spark):
    """A crowd around one fingerprint, whose members share one-wildcard keys."""
    import random

    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    want = plain_groups({s: s & (1 << 64) - 1 for s in signed})
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    for heavy in (3, 500_000):
        found = {r.node: r.root for r in simhash.components(edges, heavy=heavy).collect()}
        assert all(found.get(s, s) == want[s] for s in signed)


def test_pieces(spark, sf_dir):
    library = pieces.merger(pieces.default_model()).library
    rows = [(i, t) for i, t, _ in documents(spark, sf_dir)][:60] + ODD + [(9, "aAb" * 400), (10, " " * 70 + "a  b")]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", num_threads=1)
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.round_trip(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)
    assert op4_sentencepiece(spark, sf_dir).count() == 200
    assert pieces.round_trip(frame(spark, [])).collect() == []


def test_language(spark, sf_dir):
    truth = {i: lang for i, _, lang in documents(spark, sf_dir)}
    got = {r.doc_id: r for r in op5_language_id(spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tested = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in tested) >= 0.95 * len(tested) > 0
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r.lang_pred for r in language.language_id(frame(spark, ODD)).collect()}
    assert set(odd.values()) == {"und"}
    assert language.language_id(frame(spark, [])).collect() == []


def plain_phrases(text, known):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        count, at = count + 1, end
    return count


def test_cross_parsing(monkeypatch):
    """Phrases are longest matches with the sample, one after another, in texts of any length, side by side or alone."""
    import random

    rng = random.Random(4)
    samples = tuple((lang, "".join(rng.choice(abc) for _ in range(900))) for lang, abc in (("xx", "abcd  "), ("yy", "cdef "), ("zz", "अआकि ")))
    texts = ["cadabra zz the words", "", "1", "q", "किका ab"] + ["".join(rng.choice("abcdefq -कि") for _ in range(rng.randrange(1500))) for _ in range(40)]
    known = ["".join(map(chr, language.letters(s))) for _, s in samples]
    for few in (0, 60, 10**9):
        monkeypatch.setattr(language, "FEW", few or 1)
        parser = language.Parser(samples)
        x = [language.letters(t) for t in texts]
        want = [[plain_phrases("".join(map(chr, y)), k) for k in known] for y in x]
        assert parser.phrases(x).tolist() == want


def test_many_languages_and_letters(spark):
    """Fifty labels, one with three thousand letters; long texts of one label; every sampled text is whole."""
    import random

    rng = random.Random(7)
    words = {}
    for k in range(49):
        abc = rng.sample("abcdefghijklmnopqrstuvwxyz", 12)
        words[f"l{k}"] = ["".join(rng.choice(abc) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    words["han"] = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(2)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(sorted(words) * 16)]
    rows += [(5000 + i, "".join(rng.choices(["ab ", "ba "], k=70_000 + i)), "long") for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learn(table)
    by_lang = {lang: {t for _, t, other in rows if other == lang} for lang in [*words, "long"]}
    assert set(samples) == set(by_lang)
    assert all(set(s.split("\n")) <= by_lang[lang] for lang, s in samples.items())
    got = language.language_id(table).where("held_out").join(table, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100


def test_contamination(spark):
    item = "If Anna buys 3 apples at 2 dollars each and then sells 3 apples to her brother in Paris, how much money is left over."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    other = item.replace("3", "7").replace("2", "9").replace("Anna", "Bob").replace("Paris", "London")
    uneven = "then came 7 red apples at 9 dollars each and then sells 8 apples to her brother in Rome"
    rows = [(1, "Well. " + item), (2, "x y " + other + " z"), (3, "clean text that has nothing to do with any of it at all"), (4, None), (5, ""), (6, item), (6, item), (None, item)]
    got = sorted(((r.doc_id, r.contaminated) for r in templates.decontaminate(frame(spark, rows), bench).collect()), key=str)
    assert got == sorted([(1, True), (2, True), (3, False), (4, False), (5, False), (6, True), (6, True), (None, True)], key=str)
    twice = spark.createDataFrame([(1, "we sold 3 apples for her and sold 3 apples for him and sold 3 apples for us all")], "item_id long, text string")
    mixed = frame(spark, [(1, "we sold 5 apples for her and sold 6 apples for him and sold 7 apples for us all"), (2, "we sold 5 apples for her and sold 5 apples for him and sold 5 apples for us all")])
    assert {r.doc_id: r.contaminated for r in templates.decontaminate(mixed, twice).collect()} == {1: False, 2: True}
    assert uneven and templates.decontaminate(frame(spark, rows[:1]), bench.limit(0)).first().contaminated is False
    assert templates.decontaminate(frame(spark, []), bench).collect() == []


def test_surrogates(spark, sf_dir):
    texts = [
        "Mail jo.98@mail5.example.com, IP 213.174.22.103 and +1 (017) 555-7713 4929348385146306.",
        'again jo.98@mail5.example.com; 4929-3483-8514-6306 token = "5d190bd7c06284de91015a36974748794293dd8a" here',
        "Frau Sabine Müller met Peter Smith; Наталья Иванова 123-45-6789",
        None,
        "",
        "nothing here 12 of 1.2.3 at all",
    ]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    got = {r.doc_id: r for r in private.replace_private(frame(spark, rows), "k").collect()}
    assert got[3].text is None and got[4].text == "" and got[5].text == texts[5]
    assert got[None].text == got[0].text and got[0].n_entities == 4
    mail = re.compile(r"\S+@\S+\.com")
    assert mail.search(got[0].text)[0] == mail.search(got[1].text)[0] != mail.search(texts[0])[0]
    assert got[0].text.split()[-1][0] == "4" and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} 4\d{15}\.$", got[0].text)
    assert re.search(r"4\d{3}-\d{4}-\d{4}-\d{4}", got[1].text) and re.search(r'"[0-9a-f]{40}"', got[1].text)
    female, male, cyrillic, _ = private.GIVEN
    name = re.match(r"Frau (\S+) (\S+) met (\S+) (\S+); (\S+) (\S+) ", got[2].text)
    assert name[1] in female and name[1] != "Sabine" and name[3] in male and name[5] in cyrillic and name[5] != "Наталья"
    assert private.replace_private(frame(spark, rows[:1]), key="another").first().text != got[0].text
    assert private.replace_private(frame(spark, []), "k").collect() == []


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def test_surrogates_stay_distinct(spark):
    """Nearly all values of a small domain: surrogates are distinct, none is a value of the corpus, checks hold."""
    ips = [f"10.{a}.7.1" for a in range(60)]
    cards = [f"4{k:014d}" for k in range(30)]
    cards = [next(c + str(d) for d in range(10) if luhn(c + str(d)) == 0) for c in cards]
    rows = [(k, x) for k, x in enumerate(ips + cards)]
    got = [r.text for r in private.replace_private(frame(spark, rows), "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(rows) and not set(got) & set(ips + cards)
    assert all(luhn(c) == 0 for c in got[60:])
    assert all(re.fullmatch(r"\d{2}\.\d{1,2}\.\d\.\d", x) and all(int(o) < 256 for o in x.split(".")) for x in got[:60])
