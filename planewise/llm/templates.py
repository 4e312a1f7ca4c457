"""Benchmark decontamination by template windows, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import checkpoint

#: Tokens of a window, and the ordinary words that an alignment of windows needs.
WINDOW, WORDS = 8, 5
#: Tokens of a seed and the step between a document's seeds; every window holds one as long as SEED + STEP <= WINDOW + 1.
SEED, STEP = 6, 3
#: Windows of a benchmark, and hashes of texts that meet it, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_TEXTS = 200_000, 1_000_000

# Units that follow a number.
UNITS = "km kg g mg t lb lbs oz m cm mm nm mi ft in yd l ml h hr hrs min s sec ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles gram grams liter liters litre litres dollar dollars euro euros cent cents percent degrees watts volts kw kwh mw hz khz mhz ghz mb gb tb km/h mph"
_NUMBER = r"(?<![\p{L}\p{N}])[+-]?\p{Sc}?[0-9]+(?:[.,:][0-9]+)*%?"
_UNIT = rf"(⟨n⟩\S+ +)((?i:{'|'.join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))}))(?![\p{{L}}\p{{N}}])"
_NAME = r"(?<=[\p{Ll}\p{Nd},;%] {1,2})\p{Lu}[\p{L}'’\-]*+"


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; numbers, units and names are marked ⟨n⟩, ⟨u⟩ and ⟨a⟩ before their value.

    A name is a capitalised word within a sentence: after a small letter, number, comma or semicolon.
    """
    slotted = F.regexp_replace(F.regexp_replace(text, _NUMBER, " ⟨n⟩$0 "), _UNIT, "$1⟨u⟩$2")
    x = F.when(text.rlike("[0-9]"), slotted).otherwise(text)
    x = F.regexp_replace(x, _NAME, "⟨a⟩$0")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}⟨⟩.,:%]++|[.,:]++(?![\p{L}\p{N}%])", " ")
    return F.split(F.trim(F.lower(x)), " +")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _is_slot(w: Column) -> Column:
    return w.startswith("⟨")


def _template(x: Column) -> Column:
    return F.transform(x, lambda w: F.when(_is_slot(w), F.substring(w, 1, 3)).otherwise(w))


def _places(x: Column, width: Column, step: int) -> Column:
    return F.when(F.size(x) >= width, F.sequence(F.lit(0), F.size(x) - width, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _own_width(x: Column) -> Column:
    """``WINDOW``, or the number of tokens where it is less."""
    return F.least(F.size(x), F.lit(WINDOW))


def seeds(rows: DataFrame, spans: Callable[[Column], list[tuple[Column, int]]], skip: int = 0) -> DataFrame:
    """For rows of ``text`` and ``body``: the template hash ``h`` of every span, given as widths and steps."""

    def spread(t: Column, w: Column, step: int) -> Column:
        return F.transform(_places(t, w, step), lambda i: F.xxhash64(F.slice(t, i + 1, w)))

    def cut(x: Column) -> Column:
        def hashes(t: Column) -> Column:
            return F.concat(*(spread(t, w, step) for w, step in spans(t)))

        return _let(_template(x), hashes)

    # one expression, so that no part of it is computed again for a filter
    return rows.select("text", F.explode(_let(F.slice(tokens(F.col("body")), 1 + skip, 1 << 30), cut)).alias("h"))


def windows(rows: DataFrame, widths: Callable[[Column], list[Column]], skip: int = 0) -> DataFrame:
    """For rows of ``key``, ``text`` and ``body``: every window of the given widths, after ``skip`` tokens.

    A window has its place ``at``, hashes ``h``, ``h2`` of its template, ``slots``, the places of its ordinary words
    (``plain``), and the windows of that width in the text (``total``).  One without ordinary words is
    hashed with its values: it would fit any numbers else.
    """

    def window(x: Column, t: Column, i: Column, w: Column) -> Column:
        slots = F.filter(F.slice(x, i + 1, w), _is_slot)
        plain = F.filter(F.sequence(i, i + w - 1), lambda k: ~_is_slot(x[k]))
        bare = F.when(F.size(slots) == w, F.slice(x, i + 1, w)).otherwise(F.slice(t, i + 1, w))
        return _let(bare, lambda b: F.struct(i.alias("at"), w.alias("width"), F.xxhash64(b).alias("h"), F.hash(b).alias("h2"), slots.alias("slots"), plain.alias("plain"), (F.size(x) - w + 1).alias("total")))

    def spread(x: Column, t: Column, w: Column) -> Column:
        return F.transform(_places(x, w, 1), lambda i: window(x, t, i, w))

    def cut(x: Column) -> Column:
        return _let(_template(x), lambda t: F.concat(*(spread(x, t, w) for w in widths(x))))

    each = _let(F.slice(tokens(F.col("body")), 1 + skip, 1 << 30), cut)
    return rows.select("key", "text", F.explode(each).alias("w")).select("key", "text", "w.*")


def _rows(table: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return table.select(F.col(key).alias("key"), F.xxhash64(body).alias("text"), body.alias("body")).where("body is not null")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ids that share text with a benchmark item: ``id``, ``n_windows`` and the ``items``, in order.

    Texts are reduced to templates.  Windows of ``WINDOW`` tokens, at every token of a document and of an item,
    are joined by their hash, so any run of WINDOW equal tokens is met.  An item with fewer tokens is one window of its own
    length.  The windows that pair a text with an item at one offset are an alignment.  It counts if its windows hold
    ``WORDS`` ordinary words together, or are all of the item's, and if its slots agree one-to-one: the same number, unit or
    name always stands for the same other one.  Re-parameterised questions agree; texts that merely share phrases
    around other values do not.

    Hashes of ``SEED`` tokens at every ``STEP``-th token of a document find the texts that can hold a window (each window of
    WINDOW tokens holds such a seed whole); only their windows are cut.

    Texts that are null or have no token match nothing, and documents without an id are matched like
    others under the null id.  Rows that repeat an id are one document.
    """
    rows = _rows(docs, id_col, text_col)
    bench = _rows(benchmark, item_col, item_text).where("key is not null").where(F.col("body").rlike(r"[\p{L}\p{N}]"))
    # within a sentence the first word of an item may be marked as a name
    inner = bench.withColumn("body", F.concat(F.lit("a "), F.ltrim("body")))
    items = windows(bench, lambda x: [_own_width(x)]).unionByName(windows(inner, lambda x: [_own_width(x)], skip=1))
    items = checkpoint(items.select(F.col("key").alias("item"), F.col("text").alias("item_text"), F.col("at").alias("place"), "width", "h", "h2", F.col("slots").alias("theirs"), "plain", "total").distinct())
    short = sorted(r.width for r in items.where(F.col("width") < WINDOW).select("width").distinct().collect())

    def item_spans(x: Column) -> list[tuple[Column, int]]:
        return [(F.when(F.size(x) < WINDOW, F.size(x)).otherwise(F.lit(SEED)), 1)]

    sought = seeds(bench, item_spans).unionByName(seeds(inner, item_spans, skip=1)).select("h").distinct()
    found = seeds(rows, lambda x: [(F.lit(SEED), STEP), *((F.lit(n), 1) for n in short)])
    texts = checkpoint(found.join(_small(sought, BROADCAST_WINDOWS), "h", "left_semi").select("text").distinct())
    own = windows(rows.join(_small(texts, BROADCAST_TEXTS), "text", "left_semi"), lambda x: [F.lit(WINDOW), *map(F.lit, short)])
    own = own.select(F.col("key").alias("id"), "text", "at", "h", "h2", "slots")
    met = own.join(_small(items, BROADCAST_WINDOWS), ["h", "h2"]).withColumn("offset", F.col("at") - F.col("place"))
    # the windows of an alignment are at most an item's
    each = F.collect_set(F.struct("at", F.arrays_zip("slots", "theirs").alias("pairs"), "plain"))
    runs = met.groupBy("id", "text", "item", "item_text", "offset").agg(each.alias("w"), F.min("total").alias("total"))
    runs = runs.selectExpr("id", "item", "total", "size(array_distinct(w.at)) as n", "size(array_distinct(flatten(w.plain))) as words", "array_distinct(flatten(w.pairs)) as pairs")
    fits = "size(pairs) = size(array_distinct(pairs.slots)) and size(pairs) = size(array_distinct(pairs.theirs))"
    hits = runs.where(f"(words >= {WORDS} or n >= total) and {fits}").groupBy("id", "item").agg(F.sum("n").alias("n"))
    return hits.groupBy("id").agg(F.sum("n").alias("n_windows"), F.sort_array(F.collect_list("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, whether it is ``contaminated``, ``n_windows`` shared and the benchmark ``items``.

    An empty benchmark contaminates nothing; an empty table gives an empty result; further columns are not read.
    """
    hits = contamination(docs, benchmark, id_col, text_col)
    ids = docs.select(F.col(id_col).alias("doc_id"))
    out = ids.join(hits, ids["doc_id"].eqNullSafe(hits["id"]), "left")
    none = F.array().cast(hits.schema["items"].dataType)
    return out.select("doc_id", F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", none).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that share nothing with the benchmark; rows without an id stay."""
    hits = contamination(docs, benchmark, id_col, text_col).select("id")
    return docs.join(hits, docs[id_col] == hits["id"], "left_anti")
