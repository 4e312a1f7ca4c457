"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the labelled sample: whole texts of a language, and characters of all of them together.
ROWS_PER_LANG, CHARS_PER_LANG = 80, 60_000
#: Texts that are parsed side by side, and how many states must advance together to be worth a step in numpy.
SIDE, FEW = 2000, 60
GAP = 0

UNDETERMINED = "und"


def held_out(id_col: str | Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Sample text of every language: at most ``ROWS_PER_LANG`` distinct texts with ``CHARS_PER_LANG`` characters together.

    Texts are taken whole, in the order of a hash of the text, those over a quarter of the bound last and by length;
    a language of which no text fits has its shortest one.  Rows that are held out, or lack id, text or label, are not
    used.  Copies count once, and the sample is the same in any run.

    Hashes below a share that follows from the number of a language's texts are looked at only, so a few hundred
    texts of each language are shuffled.  The sample goes to the driver; it grows with the languages alone.
    """
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"))
    rows = rows.withColumn("h", F.xxhash64("body"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).collect()  # a row for each language
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, 6 * ROWS_PER_LANG / max(1, r.texts)))))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    texts = near.groupBy("lang", "h").agg(F.min("body").alias("body")).withColumn("n", F.char_length("body"))
    order = f"partition by lang order by greatest(n, {CHARS_PER_LANG // 4}), h"
    taken = texts.selectExpr("lang", "body", "h", f"row_number() over ({order}) as r", f"sum(n) over ({order} rows unbounded preceding) as upto")
    taken = taken.where((F.col("r") == 1) | ((F.col("r") <= ROWS_PER_LANG) & (F.col("upto") <= CHARS_PER_LANG)))
    out: dict[str, list[str]] = {}
    for r in sorted(taken.select("lang", "r", "body").collect()):
        out.setdefault(r.lang, []).append(r.body)
    return {lang: "\n".join(parts) for lang, parts in out.items()}


@cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, what stands for it: the lower-case letter, a combining mark itself, else GAP; and which are letters."""
    table, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in (*range(0x32400), *range(0xE0100, 0xE01F0)):  # no letters or marks are assigned elsewhere
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
            letter[c] = True
        elif unicodedata.category(x)[0] == "M":
            table[c] = c
    return table, letter


def letters(text: str) -> np.ndarray:
    """Lower-case letters, with their marks, as code points; each stretch of anything else becomes one GAP; one at either end."""
    table, letter = _folded()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[raw].any():
        return np.zeros(0, np.uint32)
    x = table[raw]
    keep = x != GAP
    keep[1:] |= x[:-1] != GAP
    x = x[keep]
    return np.pad(x, (int(x[0] != GAP), int(x[-1] != GAP)), constant_values=GAP)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``symbols``; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(move)
        move.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if size[q] != size[p] + 1:
                twin = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return move


Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def automaton_table(symbols: np.ndarray, width: int) -> Table:
    """A sample's automaton as arrays: the states that the start leads to by each of ``width`` letters, and ``_packed``."""
    move = suffix_automaton(symbols.tolist())
    begin = np.zeros(width, np.int32)
    for c, q in move[0].items():
        begin[c] = q
    return begin, *_packed(move, width)


def coded(samples: Iterable[tuple[str, str]]) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """The samples that have letters as numbers of their letters, the number of each code point, and how many there are."""
    texts = {lang: letters(text) for lang, text in samples}
    known = np.unique(np.concatenate([np.zeros(1, np.uint32), *texts.values()]))
    # 0 is the gap, the last one any letter that no sample has
    code = np.full(0x110000, len(known), np.int32)
    code[known] = np.arange(len(known), dtype=np.int32)
    return {lang: code[texts[lang]] for lang in sorted(texts) if len(texts[lang])}, code, len(known) + 1


class Parser:
    """Counts, for many texts at once, the phrases that each language needs.

    A phrase is the longest match, from where the last one ended, with any substring of the language's sample;
    a letter that no sample has is a phrase of its own.  The automata of all languages lie in one sparse table: state s
    has a transition by letter c if ``owner`` is s at place ``base[s] + c``, and ``to`` is then the next state, so
    neither the number of letters nor that of languages multiplies the states.  Texts advance side by side, a letter
    at a time; when few are left, they go on one by one.
    """

    def __init__(self, samples: Iterable[tuple[str, str]], tables: Mapping[str, Table] | None = None) -> None:
        texts, self.code, width = coded(samples)
        self.langs = list(texts)
        self.begin = np.zeros((width, len(texts)), np.int32)
        self.weights = np.array([math.log2(len(x) + 1) for x in texts.values()])
        # state 0 follows a letter that the sample lacks: all else begins a phrase; a table's first places are free
        bases, owners, nexts = [np.zeros(1, np.int32)], [np.full(width, -1, np.int32)], [np.zeros(width, np.int32)]
        states, places = 1, width
        for k, (lang, x) in enumerate(texts.items()):
            begin, base, owner, to = tables[lang] if tables else automaton_table(x, width)
            self.begin[:, k] = np.where(begin > 0, begin + states, 0)
            bases.append(base + places)
            owners.append(np.where(owner >= 0, owner + states, -1))
            nexts.append(to + states)
            states, places = states + len(base), places + len(owner)
        self.base, self.owner, self.to = (np.concatenate(x).astype(np.int32) for x in (bases, owners, nexts))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows of texts, columns of languages: the number of phrases."""
        n = len(self.langs)
        order = np.argsort([-len(x) for x in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        found = np.zeros((len(texts), n), np.int64)
        if not n or not len(texts) or not lengths[0]:
            return found
        flat = self.code[np.concatenate([texts[i] for i in order])]
        at = np.cumsum(lengths) - lengths
        active = int((lengths > 0).sum())
        state = self.begin[flat[at[:active]]]
        found[:active] = 1
        step = 1
        while True:
            while active and lengths[active - 1] <= step:
                active -= 1
            if active * n < FEW:
                break
            symbol = flat[at[:active] + step]
            now = state[:active]
            place = self.base.take(now) + symbol[:, None]
            hit = self.owner.take(place) == now
            found[:active] += ~hit
            state[:active] = np.where(hit, self.to.take(place), self.begin.take(symbol, axis=0))
            step += 1
        for i in range(active):
            rest = flat[at[i] + step : at[i] + lengths[i]].tolist()
            for k in range(n):
                found[i, k] += self._alone(rest, int(state[i, k]), k)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _alone(self, symbols: list[int], state: int, k: int) -> int:
        """New phrases of one text, from here on, for the k-th language."""
        base, owner, to = memoryview(self.base), memoryview(self.owner), memoryview(self.to)
        begin = self.begin[:, k].tolist()
        count = 0
        for c in symbols:
            place = base[state] + c
            if owner[place] == state:
                state = to[place]
            else:
                state = begin[c]
                count += 1
        return count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: one less the winner's normalised phrases over the runner-up's."""
        found = [letters(t or "") for t in texts]
        needed = self.phrases(found) * self.weights
        langs, scores = [], []
        for x, row in zip(found, needed, strict=True):
            if not self.langs or not len(x):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(row.argmin())
            others = np.delete(row, best)
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / others.min()) if len(others) else 1.0)
        return langs, scores


def _packed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transitions in one row: each state's letters are laid where all of their places are free."""
    base = [0] * len(moves)
    owner, to = [-1] * (2 * width), [0] * (2 * width)
    low, high = width, width  # nothing is free below the one, nothing is taken from the other on
    for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        ways = moves[s]
        if not ways:
            break
        while low < high and owner[low] >= 0:
            low += 1
        first, last = min(ways), max(ways)
        spot = low
        for _ in range(64):
            if spot >= high or owner[spot] < 0 and (first == last or all(owner[spot - first + c] < 0 for c in ways)):
                break
            spot += 1
        else:
            spot = high
        start = base[s] = spot - first
        high = max(high, start + last + 1)
        if high + width > len(owner):
            more = len(owner)
            owner += [-1] * more
            to += [0] * more
        for c, q in ways.items():
            owner[start + c] = s
            to[start + c] = q
    return np.array(base, np.int32), np.array(owner[: high + width], np.int32), np.array(to[: high + width], np.int32)


def parser(spark: SparkSession, samples: Mapping[str, str]) -> Parser:
    """The automata of all languages, each built once, by a task of its own: some 3 MB a language come back to the driver."""
    texts, _, width = coded(samples.items())
    if not texts:
        return Parser(samples.items())

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, symbols in zip(*(c.to_pylist() for c in part.columns), strict=True):
                table = automaton_table(np.frombuffer(symbols, np.int32), width)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *(pa.array([x.astype(np.int32).tobytes()]) for x in table)], ["lang", "begin", "base", "owner", "to"])

    rows = spark.createDataFrame([(lang, x.tobytes()) for lang, x in texts.items()], "lang string, symbols binary").repartition(len(texts), "lang")
    built = rows.mapInArrow(build, "lang string, begin binary, base binary, owner binary, to binary").collect()
    return Parser(samples.items(), {r["lang"]: tuple(np.frombuffer(r[c], np.int32) for c in ("begin", "base", "owner", "to")) for r in built})


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the input's columns, unchanged), ``lang_pred`` and ``score`` of every row.

    The winner is the language whose sample parses the whole text into the fewest phrases, each weighed by the
    logarithm of the sample's length (Ziv and Merhav's cross-parsing estimate); ties go to the name that sorts first.
    Only the text is used.  A text that is null or has no letters is ``und`` with score 0, as is every
    text if no sample has letters; if there is one language, it has all other texts with score 1.  Rows are
    independent: repeated rows get the same answer and an empty table an empty result.
    """
    schema = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(parser(docs.sparkSession, samples))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for part in parts:
            for at in range(0, part.num_rows, SIDE):
                few = part.slice(at, SIDE)
                langs, scores = p.predict(few.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kind = T.StructType([T.StructField("row", schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(row, F.col(text_col).cast("string").alias("body")).mapInArrow(batches, kind)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and predict all rows: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    A row without an id is neither learned from nor held out.
    """
    samples = learn(docs, id_col, text_col, lang_col)
    out = identify(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), samples)
    return out.select(F.col("row.id").alias("doc_id"), held_out("row.id").alias("held_out"), "lang_pred", "score")
