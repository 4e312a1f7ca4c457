"""Repeated-phrase dedup: confirmed recurring passages, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm import grams
from planewise.llm.common import split_join, stored, tasks
from planewise.llm.repeats import keyed, merged, opened, packed

WORDS = 13
#: Words of the q-grams by which windows are sampled.
GRAM = 4
#: Bytes of text dealt to a shard, and words of passages that one automaton is compiled for.
SHARD, UNIT = 6 << 20, 400_000
#: Words of an automaton's passages are coded as the characters from here on; all other words as this one.
OTHER = 0x10000
#: Words of a passage at most; longer ones are cut to pieces that share all windows across a cut.
PIECE = 100_000
NEVER = np.iinfo(np.int64).max


class Blocks:
    """All blocks of a shard's texts: neighbouring windows that picked the same anchor."""

    def __init__(self, texts: list[bytes], width: int, gram: int) -> None:
        hashes, self.offsets = grams.word_hashes(texts)
        n = np.diff(self.offsets)
        long = n >= width
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.text = empty
        self.windows = self.anchor = self.content = np.zeros(0, np.uint64)
        if long.any():
            ids = grams.doubled(hashes, gram)
            self.windows = grams.doubled(hashes, width)
            anchors = grams.anchored(ids, width - gram + 1)
            self.first, self.last = grams.block_edges(anchors, self.offsets[:-1][long], self.offsets[1:][long] - width + 1)
            self.text = np.searchsorted(self.offsets, self.first, "right") - 1
            self.anchor = ids[anchors[self.first]]
            # first and last window cover the block, as all its windows share the anchor
            self.content = grams.mix(self.windows[self.first], self.windows[self.last])

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of these blocks, and the block of each."""
        counts = (self.last - self.first + 1)[which]
        block = np.repeat(which, counts)
        within = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.first[block] + within, block


class Shard:
    """The texts of a shard that have an id, in the order of their ids, with their blocks.

    A place in a document counts its words; rows that repeat an id go on counting where the one before them ended.
    """

    def __init__(self, table: pa.Table, width: int, gram: int) -> None:
        table = table.filter(table.column("id").is_valid()).sort_by([("id", "ascending"), ("tag", "ascending")])
        self.ids = table.column("id").to_numpy()
        self.blocks = Blocks([opened(z) for z in table.column("z").to_pylist()], width, gram)
        starts = self.blocks.offsets[:-1]
        new = np.concatenate([[True], self.ids[1:] != self.ids[:-1]]) if len(self.ids) else np.zeros(0, bool)
        self.base = starts[new][np.cumsum(new) - 1] if len(starts) else starts

    def first_of(self, keys: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, smallest document and first place in it, whether there are two documents; and the sorting."""
        ids, at = self.ids[text], place - self.base[text]
        order = np.lexsort((at, ids, keys))
        keys, ids, at = keys[order], ids[order], at[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        last = np.concatenate([begin[1:], [len(keys)]]).astype(np.int64) - 1 if len(begin) else begin
        return keys[begin], ids[begin], at[begin], ids[begin] != ids[last], order


def dedup_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, gram: int = GRAM, shard: int = SHARD, with_kept: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document with a smaller id.

    Words are what stands between ASCII white space, unchanged; windows are judged on the input, not on what is
    left.  Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space)
    and, if asked for, the ``kept`` words as text.

    Documents are dealt once, by id, to shards of bounded size.  Each shard reports the anchors that its windows
    picked, once each, with the first place; anchors met in two documents recur.  Where all blocks of an
    anchor look the same, the whole block does; else its windows are counted over all shards.  Every shard then asks for the
    passages that its documents seem to share with an earlier document, a run of windows each, and gets
    their words, cut out of that document.  They are compiled to Aho-Corasick automata, through which the
    shard streams all its documents.  Only what an automaton finds, word by word, in a document later than the
    passage's own is removed, so hashes that agree by chance remove nothing.

    A null text has no words.  A row without an id is kept whole and counts as no earlier document.  Rows that
    repeat an id are the same document to this rule and keep a row each.  An empty table gives an empty
    result; further columns are not read.
    """
    if not 1 <= gram <= width:
        raise ValueError(f"gram must lie between 1 and {width}, not {gram}")
    rows = keyed(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-size // shard))
    texts = packed(rows).select(_shard_of("key", n).alias("p"), "id", "tag", "z")
    texts = texts.repartition(tasks(docs.sparkSession), "p").persist(StorageLevel.MEMORY_AND_DISK)
    anchors = stored(_recurring(_anchors(texts, width, gram), "h"))
    windows = _recurring(_windows(texts, anchors.where("mixed"), width, gram), "w")
    later = "many or low > first"
    confirmed = anchors.where("not mixed").where(later).selectExpr("p", "h as key", "first", "at", "false as single")
    confirmed = confirmed.unionByName(windows.where(later).selectExpr("p", "w as key", "first", "at", "true as single"))
    wanted = stored(_wanted(texts, confirmed, width, gram))
    once = wanted.groupBy("first", "at", "n").agg(F.count("*").alias("shards")).withColumn("p", _shard_of("first", n))
    passages = split_join(wanted, _passages(texts, once), ["first", "at", "n"], "shards").select("p", "first", "passage")
    out = stored(_located(texts, passages, with_kept))
    texts.unpersist()
    return out


def _shard_of(key: str, n: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Of shard summaries, those whose key occurs in two documents, with the first document and place.

    A key has one row from each shard at most, however often it occurs, so a window over a key holds a few bytes for
    each shard.  Where rows have a content ``b``, ``mixed`` says whether there are several.
    """
    over = f"over (partition by {key})"
    one = f"min(b) {over} <=> max(b) {over} and count(b) {over} = count(*) {over}" if "b" in rows.columns else "true"
    # without the shards' own marks, no two of them agree on a document, as ids are dealt by their hash
    rows = rows.selectExpr("p", key, "low", "many", f"min(struct(low, place)) {over} as least", f"count(*) {over} > 1 or many as again", f"not ({one}) as mixed")
    return rows.where("again").selectExpr("p", key, "low", "many", "least.low as first", "least.place as at", "mixed")


def _anchors(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """For each shard and anchor: smallest document and place, whether there are ``many``, and the blocks' content if all agree."""

    def summary(table: pa.Table) -> pa.Table:
        own = Shard(table, width, gram)
        x = own.blocks
        keys, low, place, many, order = own.first_of(x.anchor, x.text, x.first)
        content = x.content[order]
        at = np.searchsorted(x.anchor[order], keys)
        same = np.minimum.reduceat(content, at) == np.maximum.reduceat(content, at) if len(at) else np.zeros(0, bool)
        p = pa.array(np.full(len(keys), table.column("p")[0].as_py(), np.int32))
        b = pa.array(content[at].view(np.int64), pa.int64(), mask=~same)
        return pa.table([p, pa.array(keys.view(np.int64)), pa.array(low, pa.int64()), pa.array(place, pa.int64()), pa.array(many, pa.bool_()), b], ["p", "h", "low", "place", "many", "b"])

    return texts.groupBy("p").applyInArrow(summary, "p int, h long, low long, place long, many boolean, b long")


def _windows(texts: DataFrame, mixed: DataFrame, width: int, gram: int) -> DataFrame:
    """For each shard, the windows of the blocks with these anchors: smallest document and place, and whether there are ``many``."""

    def summary(table: pa.Table, known: pa.Table) -> pa.Table:
        w, low, place, many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        if table.num_rows and known.num_rows:
            own = Shard(table, width, gram)
            x = own.blocks
            hit = np.flatnonzero(np.isin(x.anchor, known.column("h").to_numpy().view(np.uint64)))
            at, block = x.spread(hit)
            w, low, place, many, _ = own.first_of(x.windows[at], x.text[block], at)
        p = pa.array(np.full(len(w), known.column("p")[0].as_py() if known.num_rows else 0, np.int32))
        return pa.table([p, pa.array(w.view(np.int64)), pa.array(low, pa.int64()), pa.array(place, pa.int64()), pa.array(many, pa.bool_())], ["p", "w", "low", "place", "many"])

    return texts.groupBy("p").cogroup(mixed.select("p", "h").groupBy("p")).applyInArrow(summary, "p int, w long, low long, place long, many boolean")


def _lookup(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ``known`` ones, and whether it does."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def pieces(first: np.ndarray, at: np.ndarray, length: np.ndarray, width: int, most: int | None = None) -> np.ndarray:
    """Passages as columns of document, place and words, those of over ``most`` words as pieces that overlap by ``width`` - 1."""
    most = max(width, PIECE if most is None else most)
    step = most - width + 1
    parts = np.maximum(1, -(-(length - width + 1) // step))
    later = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    first, at, length = (np.repeat(x, parts) for x in (first, at, length))
    return np.stack([first, at + later, np.minimum(length - later, most)])


def _wanted(texts: DataFrame, confirmed: DataFrame, width: int, gram: int) -> DataFrame:
    """For each shard, the passages that it asks for: document ``first``, place ``at`` and ``n`` words, once each."""

    def runs(table: pa.Table, known: pa.Table) -> pa.Table:
        out = np.zeros((3, 0), np.int64)
        if table.num_rows and known.num_rows:
            own = Shard(table, width, gram)
            x = own.blocks
            place, block = x.spread(np.arange(len(x.first)))
            order = np.argsort(place)
            place, block = place[order], block[order]
            first, at = np.full(len(place), NEVER), np.zeros(len(place), np.int64)
            single = known.column("single").to_numpy()
            for flag, keys, within in ((True, x.windows[place], np.zeros(len(place), np.int64)), (False, x.anchor[block], place - x.first[block])):
                some = known.filter(pa.array(single == flag))
                table_keys = some.column("key").to_numpy().view(np.uint64)
                by_key = np.argsort(table_keys)
                spot, found = _lookup(keys, table_keys[by_key])
                if found.any():
                    spot = by_key[spot[found]]
                    first[found] = some.column("first").to_numpy()[spot]
                    at[found] = some.column("at").to_numpy()[spot] + within[found]
            text = x.text[block]
            hit = np.flatnonzero(first < own.ids[text])
            if len(hit):
                # a run goes on while text, document and place do
                f, a, t, q = first[hit], at[hit], text[hit], place[hit]
                new = np.concatenate([[True], (f[1:] != f[:-1]) | (a[1:] != a[:-1] + 1) | (t[1:] != t[:-1]) | (q[1:] != q[:-1] + 1)])
                begin = np.flatnonzero(new)
                length = np.diff(np.concatenate([begin, [len(hit)]])) + width - 1
                out = np.unique(pieces(f[begin], a[begin], length, width), axis=1)
        p = pa.array(np.full(out.shape[1], known.column("p")[0].as_py() if known.num_rows else 0, np.int32))
        return pa.table([p, *map(pa.array, out)], ["p", "first", "at", "n"])

    return texts.groupBy("p").cogroup(confirmed.groupBy("p")).applyInArrow(runs, "p int, first long, at long, n long")


def _passages(texts: DataFrame, once: DataFrame) -> DataFrame:
    """The words of the wanted passages, cut out of the documents that have them first."""

    def cut(table: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asked.num_rows:
            asked = asked.sort_by("first")
            table = table.filter(table.column("id").is_valid()).sort_by([("id", "ascending"), ("tag", "ascending")])
            ids, zs = table.column("id").to_numpy(), table.column("z")
            held, words = None, []
            for f, at, n in zip(*(asked.column(c).to_pylist() for c in ("first", "at", "n")), strict=True):
                if f != held:
                    held = f
                    words = [w for k in range(*np.searchsorted(ids, [f, f + 1])) for w in opened(zs[k].as_py()).split()]
                found.append(b" ".join(words[at : at + n]))
        columns = [asked.column(c) for c in ("first", "at", "n", "shards")]
        return pa.table([*columns, pa.array(found, pa.binary())], ["first", "at", "n", "shards", "passage"])

    return texts.groupBy("p").cogroup(once.groupBy("p")).applyInArrow(cut, "first long, at long, n long, shards long, passage binary")


def automata(passages: dict[bytes, int], unit: int = UNIT) -> Iterator[tuple[dict[bytes, str], ahocorasick.Automaton]]:
    """Automata of the passages, of ``unit`` words at most, with the characters that stand for their words.

    A passage of more than ``unit`` words is an automaton of its own; there are characters for over a million different words.
    An entry's value is the number of its words and the document that the passage is from.
    """
    code: dict[bytes, str] = {}
    found, size = ahocorasick.Automaton(), 0
    for passage, first in passages.items():
        words = passage.split(b" ")
        if size and size + len(words) > unit:
            found.make_automaton()
            yield code, found
            code, found, size = {}, ahocorasick.Automaton(), 0
        text = "".join([code.setdefault(w, chr(OTHER + 1 + len(code))) for w in words])
        found.add_word(text, (len(words), first))
        size += len(words)
    if size:
        found.make_automaton()
        yield code, found


def _located(texts: DataFrame, passages: DataFrame, with_kept: bool) -> DataFrame:
    """The result: each shard's automata, compiled from the passages that it got, over all its documents."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_kept

    def shard(table: pa.Table, got: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        for first, passage in zip(got.column("first").to_pylist(), got.column("passage").to_pylist(), strict=True):
            known[passage] = min(first, known.get(passage, first))
        ids, zs = (table.column(c).to_pylist() for c in ("id", "z"))
        spans: list[set[tuple[int, int]]] = [set() for _ in ids]
        for code, automaton in automata(known):
            other = chr(OTHER)
            for own, z, at in zip(ids, zs, spans, strict=True):
                if own is None:
                    continue
                text = "".join([code.get(w, other) for w in opened(z).split()])
                for end, (n, first) in automaton.iter(text):
                    if first < own:
                        at.add((end + 1 - n, end + 1))
        out: list[list] = [[] for _ in range(5)]
        for own, z, at in zip(ids, zs, spans, strict=True):
            body = opened(z).split()
            ranges = np.array(sorted(at), np.int64).reshape(-1, 2)
            starts, ends = merged(ranges[:, 0], ranges[:, 1])
            kept = b" ".join(b" ".join(body[a:b]) for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(body)], strict=True) if b > a)
            row = (own, len(body), int((ends - starts).sum()), sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_kept else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: len(names)], names)

    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept
    return texts.groupBy("p").cogroup(passages.groupBy("p")).applyInArrow(shard, kind)
