"""How far the sources of a language differ in their words: counts in byte tries, merged by prefix range."""

from __future__ import annotations

import gc
import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import stored, tasks

#: Documents of a language that a kept term is in at least; terms listed for each group.
MIN_DOCS, TOP = 30, 50
#: Shares are counted in billionths, with so many occurrences added to each term.
UNIT, ADDED = 1_000_000_000, 5
#: Texts that are held as Python objects at a time; bytes counted before the counts go into the tries; bytes split at a time.
SLICE, POUR, CHUNK = 256, 16 << 20, 1 << 20
#: Leaves of the tries that a task holds at most, and of a batch that it sends.
LEAVES, BATCH = 400_000, 20_000
#: Counters of a part of the merged trie, entries of a table of shares, and sums of pairs that a task holds at a time.
PART, TABLE, SUMS = 1 << 20, 1 << 20, 1 << 22

#: Every byte of a term as it is counted, all others as a blank: letters in lower case, and what is not ASCII.
TERM_BYTES = bytes(b | 32 if 65 <= (b & 223) <= 90 else b if b >= 128 else 32 for b in range(256))


class Node:
    """A place of a trie: the ``edges`` that leave it, by first byte, and what is counted of the term that ends here."""

    __slots__ = ("counts", "docs", "edges")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.counts: dict[str, int] | None = None
        self.docs = 0


class Trie:
    """A radix trie of byte strings with a counter for each source at its leaves; an edge carries a run of bytes."""

    def __init__(self) -> None:
        self.root, self.leaves = Node(), 0

    def leaf(self, term: bytes) -> Node:
        """The node of a term, which is made where it is not there yet."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node.edges is None:
                node.edges = {}
            found = node.edges.get(term[at])
            if found is None:
                child = Node()
                node.edges[term[at]] = (term[at:], child)
                node, at = child, end
                continue
            label, child = found
            if term.startswith(label, at):
                node, at = child, at + len(label)
            else:
                k = 1
                while at + k < end and label[k] == term[at + k]:
                    k += 1
                fork = Node()
                fork.edges = {label[k]: (label[k:], child)}
                node.edges[term[at]] = (label[:k], fork)
                node, at = fork, at + k
        return node

    def merge(self, term: bytes, counts: dict[str, int], docs: int) -> None:
        """Add a leaf of another trie, or of counts that were kept beside this one."""
        node = self.leaf(term)
        node.docs += docs
        if node.counts is None:
            node.counts = counts
            self.leaves += 1
        else:
            for source, n in counts.items():
                node.counts[source] = node.counts.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """The terms in the order of their bytes, which is that of their characters in UTF-8."""
        open_nodes = [(b"", self.root)]
        while open_nodes:
            term, node = open_nodes.pop()
            if node.counts is not None:
                yield term, node
            for first in sorted(node.edges or (), reverse=True):
                label, child = node.edges[first]
                open_nodes.append((term + label, child))


_LEAF = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _sent(tries: dict[str, Trie]) -> Iterator[pa.RecordBatch]:
    """The leaves of some tries, in order."""
    for lang in sorted(tries):
        for few in batched(tries[lang].walk(), BATCH):
            rows = ((lang, term.decode(), node.docs, list(node.counts), list(node.counts.values())) for term, node in few)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LEAF.types, strict=True)], schema=_LEAF)


def words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    plain = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class _Counts:
    """What a task has counted since the last time it was poured into the tries."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.terms: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.size = 0

    def add(self, text: str, lang: str, source: str) -> None:
        own, seen = self.terms.setdefault((lang, source), Counter()), set()
        docs = self.docs.setdefault(lang, Counter())
        for few in words(text):
            own.update(few)
            new = set(few) - seen if seen else set(few)
            docs.update(new)
            seen |= new
        self.size += len(text) + 1

    def pour(self, tries: dict[str, Trie]) -> None:
        by_term: dict[str, dict[bytes, dict[str, int]]] = {}
        for (lang, source), own in self.terms.items():
            leaves = by_term.setdefault(lang, {})
            leaves.setdefault(b"", {})[source] = 0  # the group occurs, whatever terms it has
            for term, n in own.items():
                leaf = leaves.get(term)
                if leaf is None:
                    leaves[term] = {source: n}
                else:
                    leaf[source] = n
        for lang, leaves in by_term.items():
            trie, docs = tries.setdefault(lang, Trie()), self.docs[lang]
            for term, counts in leaves.items():
                trie.merge(term, counts, docs.get(term, 0))
        self.clear()


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of a task's tries of all its texts; a group's own leaf is that of the empty term."""
    tries: dict[str, Trie] = {}
    held = _Counts()
    gc.disable()  # millions of counters, none of them in a cycle, would be gone through again and again
    try:
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                for row in zip(*(c.to_pylist() for c in part.slice(at, SLICE).columns), strict=True):
                    held.add(*row)
                    if held.size >= POUR:
                        held.pour(tries)
                        if sum(t.leaves for t in tries.values()) > LEAVES:
                            yield from _sent(tries)
                            tries = {}
        held.pour(tries)
        yield from _sent(tries)
    finally:
        gc.enable()


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All entries of a list column, and how many each row has."""
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(min_docs: int, part_size: int = PART):
    """A function that merges the leaves of one prefix range, which come in order, and keeps those in ``min_docs`` documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = TaskContext.get().partitionId() << 24, 0
        held: pa.Table | None = None
        for part in parts:
            rows = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
            starts = _starts(rows)
            held = rows.slice(starts[-1])  # more leaves of the last term may follow
            if len(starts) > 1:
                done = merge_leaves(rows.slice(0, starts[-1]), min_docs)
                filled += pc.sum(pc.list_value_length(done.column("counts"))).as_py() or 0
                yield from _numbered(done, number)
                if filled >= part_size:
                    number, filled = number + 1, 0
            elif held.num_rows > BATCH:  # one term of very many leaves
                held = merge_leaves(held, 0)
        if held is not None:
            yield from _numbered(merge_leaves(held, min_docs), number)

    return run


def _starts(rows: pa.Table) -> np.ndarray:
    """Where the leaves of another term begin."""
    lang, term = rows.column("lang").combine_chunks(), rows.column("term").combine_chunks()
    n = len(term)
    new = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
    return np.flatnonzero(np.concatenate([[True], new.to_numpy(zero_copy_only=False)]))


def merge_leaves(rows: pa.Table, min_docs: int) -> pa.Table:
    """One leaf for each term of rows in order: documents and the counters of each source added up."""
    rows = rows.combine_chunks()
    starts = _starts(rows)
    docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    sources, each = _flat(rows.column("sources").combine_chunks())
    counts = rows.column("counts").combine_chunks().flatten().to_numpy()
    named = sources.dictionary_encode()
    width = max(1, len(named.dictionary))
    keys, place = np.unique(np.repeat(run, each) * width + named.indices.to_numpy(), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, counts)
    kept = docs >= min_docs
    kept |= pc.equal(rows.column("term").combine_chunks().take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
    inside = kept[keys // width]
    sizes = np.bincount(keys // width, minlength=len(starts))[kept]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    at = pa.array(starts[kept])
    columns = [
        *(rows.column(c).combine_chunks().take(at) for c in ("lang", "term")),
        pa.array(docs[kept]),
        pa.ListArray.from_arrays(offsets, named.dictionary.take(pa.array(keys[inside] % width))),
        pa.ListArray.from_arrays(offsets, pa.array(sums[inside])),
    ]
    return pa.table(columns, names=_LEAF.names).cast(_LEAF)


def _numbered(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    for part in rows.to_batches(BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number, np.int64)), *part.columns], ["number", *_LEAF.names])


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * counts / totals)`` in whole numbers: three digits at a time, so that nothing exceeds 64 bits.

    It holds for totals below 9 * 10**15, words of about 50 petabytes of text.
    """
    quotient, rest = np.zeros_like(counts), counts
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digits
    return quotient + 1


def compare(terms: list[str], spread: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str], group_n: np.ndarray, lang_n: int, v: int, top: int = TOP) -> Iterator[tuple[str, str, str, int]]:
    """Sums for all pairs of sources over some terms, and each source's ``top`` terms of these: kind, source, item, value.

    ``spread`` has a term's place, a source's place and a count for each counter; terms are in UTF-8 order.  Sources are paired
    in stripes, so that the sums held stay few, and a table of shares is made for some terms at a time.
    """
    where, who, count = spread
    size = len(names)
    step = max(1, TABLE // max(1, size))
    totals = group_n + ADDED * v
    edges = np.searchsorted(where, np.arange(0, len(terms) + step, step))

    def tables() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k, at in enumerate(range(0, len(terms), step)):
            own = slice(edges[k], edges[k + 1])
            c = np.zeros((min(step, len(terms) - at), size), np.int64)
            c[where[own] - at, who[own]] = count[own]
            yield at, c, shares(c + ADDED, totals[None, :])

    best: list[list[tuple[int, int]]] = [[] for _ in names]
    for at, c, p in tables():
        ahead = p - shares(c.sum(axis=1) + ADDED, np.int64(lang_n + ADDED * v))[:, None]
        for s in range(size):
            i = np.flatnonzero((c[:, s] > 0) & (ahead[:, s] > 0))
            i = i[np.argsort(-ahead[i, s], kind="stable")[:top]]
            best[s] = heapq.nsmallest(top, best[s] + list(zip((-ahead[i, s]).tolist(), (i + at).tolist(), strict=True)))
    for s, found in enumerate(best):
        yield from (("term", names[s], terms[i], -f) for f, i in found)
    stripe = max(1, SUMS // max(1, size))
    for low in range(0, size, stripe):
        sums = np.zeros((min(stripe, size - low), size), np.int64)
        for _, _, p in tables():
            for s in range(len(sums)):
                sums[s, low + s + 1 :] += np.abs(p[:, low + s + 1 :] - p[:, low + s, None]).sum(axis=0)
        for s in range(len(sums)):
            yield from (("pair", names[low + s], names[t], int(sums[s, t])) for t in range(low + s + 1, size))


_FOUND = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compared(own: pa.Table, groups: pa.Table) -> pa.Table:
    """``compare`` for a part of one language's merged trie."""
    if not own.num_rows:
        return _FOUND.empty_table()
    groups = groups.sort_by("source")
    names, lang, v = groups.column("source").to_pylist(), own.column("lang")[0].as_py(), groups.column("v")[0].as_py()
    own = own.filter(pc.not_equal(own.column("term"), "")).sort_by("term").combine_chunks()
    sources, each = _flat(own.column("sources").combine_chunks()) if own.num_rows else (pa.array([], pa.string()), np.zeros(0, np.int64))
    counts = own.column("counts").combine_chunks().flatten().to_numpy() if own.num_rows else np.zeros(0, np.int64)
    who = pc.index_in(sources, value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    spread = (np.repeat(np.arange(own.num_rows), each), who, counts)
    found = compare(own.column("term").to_pylist(), spread, names, groups.column("n").to_numpy(), groups.column("lang_n")[0].as_py(), v)
    out = [pa.array(c, t) for c, t in zip(list(zip(*((lang, *f) for f in found), strict=True)) or [()] * 5, _FOUND.types, strict=True)]
    return pa.table(out, schema=_FOUND)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, part_size: int = PART) -> DataFrame:
    """Columns ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` for each source of each language.

    Terms are runs of letters A-Z and of characters beyond ASCII, with A-Z in lower case; a language keeps those in
    ``min_docs`` of its documents.  A group's, or a language's, share of a kept term is 1 + floor(10**9 (count + 5) / (N + 5 V)),
    N being its occurrences of all V kept terms.  In part ``pair`` an item is another source of the language and the value the sum over
    all kept terms of the differences between the two shares; in part ``term`` it is a term that the group has and in which its
    share exceeds the language's, with the excess, up to rank ``top``.  Ranks go by value, then by the item's bytes.

    Each task counts its texts in radix tries, a counter for each source at a leaf, and sends the leaves in byte order.
    They are merged by ranges of their prefixes, each in one pass in that order, and kept terms are cut into parts
    of at most about ``part_size`` counters.  A part yields sums for the pairs of its language's sources, which are added up, and the
    best of its terms for each source; a source's own totals come to it by an equality join.

    Null texts, languages and sources are empty.  A group without terms counts with N = 0; with V = 0 all pairs are 0 and
    no term is listed.  Every row is a document, repeated or not.  An empty table gives an empty result; other columns are not read.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    leaf = "lang string, term string, docs long, sources array<string>, counts array<long>"
    leaves = stored(docs.select(text, lang, source).mapInArrow(_counted, leaf))
    ranges = leaves.repartitionByRange(tasks(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    kept = stored(ranges.mapInArrow(_merged(min_docs, part_size), f"number long, {leaf}"))
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    whole = each.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    terms = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"))
    totals = each.join(whole.join(terms, "lang"), "lang")
    asked = kept.select("lang", "number").distinct().join(totals, "lang").withColumnsRenamed({"lang": "own_lang", "number": "own_number"})
    found = kept.groupBy("lang", "number").cogroup(asked.groupBy("own_lang", "own_number")).applyInArrow(_compared, "lang string, part string, source string, item string, value long")
    both = F.explode(F.expr("if(part = 'pair', array(struct(source as s, item as i), struct(item as s, source as i)), array(struct(source as s, item as i)))"))
    sums = found.select("lang", "part", "value", both.alias("b")).groupBy("lang", F.col("b.s").alias("source"), "part", F.col("b.i").alias("item")).agg(F.sum("value").alias("value"))
    ranked = sums.withColumn("rank", F.expr("row_number() over (partition by lang, source, part order by value desc, item)"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


#: The same over ``documents`` in SQL.
ORACLE = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
k as (select lang, t from (select lang, unnest(list_distinct(ts)) as t from d) group by all having count(*) >= {MIN_DOCS}),
c as (select lang, source, t, count(*) as n from (select lang, source, unnest(ts) as t from d) semi join k using (lang, t) group by all),
g as (select d.lang, d.source, any_value(coalesce(x.n, 0)) as total from (select distinct lang, source from d) d
  left join (select lang, source, sum(n) as n from c group by all) x using (lang, source) group by all),
l as (select lang, sum(total) as total, any_value((select count(*) from k where k.lang = g.lang)) as v from g group by lang),
w as (select lang, t, 1 + ({UNIT}::hugeint * (sum(n) + {ADDED})) // (any_value(l.total) + {ADDED} * any_value(l.v)) as q from c join l using (lang) group by all),
p as (select g.lang, g.source, k.t, coalesce(c.n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + {ADDED})) // (g.total + {ADDED} * l.v) as p
  from g join l using (lang) join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.t = k.t),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select p.lang, p.source, 'term', p.t, p.p - w.q from p join w using (lang, t) where p.n > 0 and p.p > w.q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from f)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {TOP}
"""
