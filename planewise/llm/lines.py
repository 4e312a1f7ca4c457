"""Line dedup by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import HEAVY, split_join


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """``id``, hash ``t`` of the text, start ``at`` and a 128-bit hash ``h1``, ``h2`` of every window of ``width`` lines."""
    lines = rows.where("body is not null").select("id", "t", F.split("body", "\n", -1).alias("lines"))
    # two hashes of different seeds for each line, so that equal windows are equal beyond doubt
    hashed = lines.select("id", "t", F.expr("transform(lines, x -> xxhash64(x))").alias("a"), F.expr("transform(lines, x -> xxhash64(7, x))").alias("b"))
    ha, hb = (", ".join(f"{c}[i + {k}]" for k in range(width)) for c in "ab")
    each = F.expr(f"transform(sequence(0, size(a) - {width}), i -> struct(xxhash64({ha}) as h1, xxhash64({hb}) as h2))")
    return hashed.where(F.size("a") >= width).select("id", "t", F.posexplode(each).alias("at", "w")).select("id", "t", "at", "w.h1", "w.h2")


def _keep(width: int) -> Column:
    """The lines outside the windows that begin at ``starts``: what lies between one window's end and the next start."""
    return F.expr(
        f"flatten(zip_with(concat(array(0), transform(starts, x -> x + {width})), "
        "concat(starts, array(size(lines))), (a, b) -> slice(lines, a + 1, greatest(b - a, 0))))"
    )


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, heavy: int = HEAVY) -> DataFrame:
    """Remove every line covered by a window of ``width`` lines that has occurred before.

    Lines end at ``\\n``.  Two windows are the same if their lines are: they are compared by 128 bits of hash.  The
    first occurrence, by id and then by line, stays; the lines of all later ones go, of those too that overlap
    it in its own document.  Windows are judged on the input, not on what is left.  Returns a struct ``row``
    of the input's columns, unchanged, with ``kept`` (the text that is left), ``n_lines`` and ``n_removed``.

    A null text gives null and no lines; a text of fewer than ``width`` lines has no window and stays.  Rows
    that repeat an id are the same document to this rule, so a window is first in both or in neither, but each
    loses lines of its own windows only.  A row without an id counts as earliest and is never cut.  An empty
    table gives an empty result.

    The places of a window that occurs more than ``heavy`` times are dealt to many tasks.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.col("row")[text_col].cast("string").alias("body")).withColumn("t", F.xxhash64("body"))
    windows = _windows(rows, width)
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("first"))
    later = split_join(windows.where("id is not null"), first.where("n > 1"), ["h1", "h2"], "n", heavy=heavy)
    later = later.where("not (id <=> first.id and at = first.at)")
    # each text has its own starts, where rows repeat an id too; the hash also spreads rows without an id
    starts = later.groupBy(F.col("id").alias("cut"), F.col("t").alias("own")).agg(F.sort_array(F.collect_set("at")).alias("starts"))
    lines = rows.join(starts, (rows["id"] == starts["cut"]) & (rows["t"] == starts["own"]), "left").withColumn("lines", F.split("body", "\n", -1))
    lines = lines.withColumn("left", F.when(F.col("starts").isNull(), F.col("lines")).otherwise(_keep(width)))
    return lines.select(
        "row",
        F.when(F.col("starts").isNull(), F.col("body")).otherwise(F.array_join("left", "\n")).alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id``, ``text`` (what ``cut_lines`` keeps), ``n_lines`` and ``n_removed`` of every row."""
    out = cut_lines(docs.select(id_col, text_col), id_col, text_col, width)
    return out.select(F.col("row")[id_col].alias("doc_id"), F.col("kept").alias("text"), "n_lines", "n_removed")


#: The same over ``documents`` in SQL.
ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, ls, unnest(range(0, len(ls) - 2)) as p from l where len(ls) >= 3),
k as (select doc_id, p, concat_ws(chr(10), ls[p + 1], ls[p + 2], ls[p + 3]) as win from w),
f as (select doc_id, p, row_number() over (partition by win order by doc_id, p) as r from k),
c as (select distinct doc_id, p + o.o as p from f, (values (0), (1), (2)) o(o) where r > 1),
e as (select doc_id, ls, unnest(range(0, len(ls))) as p from l),
j as (select e.doc_id, e.p, e.ls[e.p + 1] as line, c.p as gone from e left join c on e.doc_id = c.doc_id and e.p = c.p)
select l.doc_id, case when l.text is null then null else coalesce(g.kept, '') end as text,
  coalesce(len(l.ls), 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed
from l left join (select doc_id, string_agg(line, chr(10) order by p) filter (where gone is null) as kept, count(gone) as n
  from j group by doc_id) g on l.doc_id = g.doc_id
"""
