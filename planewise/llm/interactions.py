"""How document filters overlap in every order: a Walsh-Hadamard audit, in DataFrame functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import stored

#: The filters in the order of their bits: too short, too repetitive, too many capitals, markup, repeated text.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Words of a document at least; percentages of distinct words at least and of capitals at most.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5


def own_failures(body: Column) -> Column:
    """The bits of the filters A to D that a text fails, which it decides by itself."""
    words = F.array_remove(F.split(F.translate(body, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    count, distinct = F.size(words), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long")
    fails = (
        count < MIN_WORDS,
        100 * distinct < MIN_DISTINCT * count.cast("long"),
        100 * capitals > MAX_CAPITALS * F.length(body).cast("long"),
        body.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, the five bits ``mask`` of the filters that fail, and whether the document is ``good`` and ``toxic``.

    Texts are read once; what is shuffled of them is a digest of 256 bits.  E fails where the same text has a smaller
    id: the smallest id of a digest is a grouped minimum, combined before the shuffle, and meets the rows on id and digest
    together, so that copies, however many, are spread by their ids.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), own_failures(body).alias("own"), F.unhex(F.sha2(body, 256)).alias("digest")))
    named = rows.where("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    judged = judged.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    repeat = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    known = named.join(first, ["id", "digest"], "left").join(judged, "id", "left")
    known = known.select("part", (F.col("own") + repeat).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    lost = F.lit(False)
    return known.unionByName(rows.where("id is null").select("part", F.col("own").alias("mask"), lost.alias("good"), lost.alias("toxic")))


def parity_sums(masks: DataFrame) -> DataFrame:
    """For each part, ``CELLS`` signed sums over all its documents, the ``good`` ones and the ``toxic`` ones.

    Sum k adds 1 for a document that fails an even number of the filters in k, and takes 1 off for an odd one.
    """
    signs = [f"(1L - 2 * (bit_count(mask & {k}) % 2))" for k in range(CELLS)]
    sums = [F.expr(f"array({', '.join(f'sum(if({wanted}, {s}, 0L))' for s in signs)})").alias(name) for name, wanted in (("every", "true"), ("good", "good"), ("toxic", "toxic"))]
    return masks.groupBy("part").agg(*sums)


def _each(column: str, value: str) -> Column:
    """``value`` for every set ``m`` of filters, ``c`` being the array ``column``, which is computed once."""
    return F.expr(f"transform(array({column}), c -> transform(sequence(0, {CELLS - 1}), m -> {value}))[0]")


def _total(value: str) -> str:
    """Sum of ``value`` over every set ``k`` of filters."""
    return f"aggregate(sequence(0, {CELLS - 1}), 0L, (sum, k) -> sum + {value})"


def inverted(sums: DataFrame) -> DataFrame:
    """Documents by the exact set of filters they fail, by the same signs: the transform is its own inverse but for ``CELLS``."""
    return sums.select("part", *(_each(c, f"{_total('(1 - 2 * (bit_count(m & k) % 2)) * c[k]')} div {CELLS}").alias(c) for c in ("every", "good", "toxic")))


def audit(masks: DataFrame) -> DataFrame:
    """What every filter does at every place of every order, from ``failure_masks``.

    A part's 32 cells give the documents that pass all of a set of filters; each order and step is then read off by its
    set of earlier filters.  A document that fails c filters is removed first by each of them in 120 / c of the orders.
    """
    cells = inverted(parity_sums(masks))
    passing = (_each(c, _total("if(m & k = 0, c[k], 0L)")).alias(f"{c}_pass") for c in ("every", "good", "toxic"))
    shares = _each("every", _total(f"if(bit_count(m) = 1 and m & k <> 0, c[k] * ({len(ORDERS)} div bit_count(k)), 0L)")).alias("shapley")
    known = cells.select("part", "every", *passing, shares)
    each = known.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(ORDERS)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, ascii(substring(filter_order, step, 1)) - {ord(FILTERS[0])})"
    before = f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (set, f) -> set | shiftleft(1, ascii(f) - {ord(FILTERS[0])}))"
    each = each.withColumn("bit", F.expr(bit)).withColumn("before", F.expr(before)).withColumn("after", F.expr("before | bit"))
    return each.selectExpr(
        "part",
        "filter_order",
        "step",
        "every_pass[after] as kept",
        "every_pass[before] - every_pass[after] as removed",
        "every_pass[0] - every_pass[bit] - every_pass[before] + every_pass[after] as redundant",
        "every[bit] as unique_fails",
        "good_pass[before] - good_pass[after] as good_lost",
        "toxic_pass[before] - toxic_pass[after] as toxic_lost",
        "shapley[bit] as shapley",
    )


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part (a value of ``part_col``), order of the five filters and step in it.

    Filters fail a text of fewer than 50 words, of under 65 percent distinct words, of over 5 percent capitals A-Z among its
    code points, with any of ``#$%&*|``, or identical to that of a smaller id anywhere in the table.  ``kept`` documents
    are left after the step, ``removed`` go in it, ``redundant`` fail its filter but went before, ``unique_fails`` fail
    its filter only; ``good_lost`` and ``toxic_lost`` are the removed ones with quality 1 and toxic 1; ``shapley`` sums
    ``removed`` of the step's filter over all 120 orders.

    A null text is empty, a null part is the empty string.  A row without an id repeats no other, is repeated by none and has
    no label.  Rows that repeat an id are documents of their own, none of them earlier than the other, with the id's labels; of
    labels that repeat an id, one of 1 is enough.  An empty table gives no part; further columns of the input are not read.
    """
    return audit(failure_masks(docs, labels, id_col, text_col, part_col))


#: The same over ``documents`` and ``labels`` in SQL, by counting the documents of each part and set of failures.
ORACLE = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents),
w as (select *, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by body) as first from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body),
   regexp_matches(body, '[#$%&*|]'), coalesce(first < w.doc_id, false)] as fails from w left join l on w.doc_id = l.doc_id),
c as (select part, fails, len(list_filter(fails, lambda x: x)) as n_fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by all),
f as (select * from (values (1), (2), (3), (4), (5)) f(i)),
o as (select [a.i, b.i, c.i, d.i, e.i] as ord from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select ord, unnest([1, 2, 3, 4, 5]) as step from o),
j as (select c.*, ord, step, fails[ord[step]] as hit, coalesce(list_bool_or([fails[x] for x in ord[1:step - 1]]), false) as gone from c, s)
select part, array_to_string([chr(64 + x) for x in ord], '') as filter_order, step::int as step,
  coalesce(sum(n) filter (where not gone and not hit), 0)::bigint as kept, coalesce(sum(n) filter (where hit and not gone), 0)::bigint as removed,
  coalesce(sum(n) filter (where hit and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where hit and n_fails = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where hit and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where hit and not gone), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // greatest(n_fails, 1))) filter (where hit), 0)::bigint as shapley
from j group by part, ord, step
"""
