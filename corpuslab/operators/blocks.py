"""Text blocks of pages: what their spans say, how large, where, and which boxes belong together.

Spans are rows (page, block, line, span, kind, text, size, x0, y0, x1, y1) with y
growing downwards.  Boxes of a page are merged by sweeps: sorted by where they
begin, a box starts a new stripe if it begins beyond the furthest end so far, by
more than a gap.  Sweeps from top to bottom and from left to right take turns
within the stripes of the one before, until none is cut any more.  Boxes that
overlap are never parted; what is left in one stripe is one block.

Null texts are empty, null sizes the least; boxes with a null edge are left out;
boxes that are given upside down are turned; repeated rows change no block but
count.  A sweep sorts the boxes of a page in one task, which holds none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import kept

#: The least size that a block's text is taken to have.
LEAST_SIZE = 9.0
TEXT_KIND = 0
_EDGES = ["x0", "y0", "x1", "y1"]


def text_only(spans: DataFrame, kind: str = "kind") -> DataFrame:
    """The spans of text blocks; pictures and others go."""
    return spans.where(F.col(kind) == TEXT_KIND)


def box(edges: list[str] = _EDGES) -> list[Column]:
    """Aggregates of the smallest box around all rows."""
    x0, y0, x1, y1 = edges
    return [F.min(F.least(x0, x1)).alias("x0"), F.min(F.least(y0, y1)).alias("y0"), F.max(F.greatest(x0, x1)).alias("x1"), F.max(F.greatest(y0, y1)).alias("y1")]


def summed(spans: DataFrame, keys: list[str], order: list[str], text: str = "text", size: str = "size") -> DataFrame:
    """(keys, text, size, spans, x0, y0, x1, y1): of each block the texts of its spans in order, the largest size and the box around."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    joined = T.strip(F.array_join(F.transform(parts, lambda x: x["_t"]), " "))
    largest = F.max(F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(LEAST_SIZE)), F.lit(LEAST_SIZE)))
    return spans.groupBy(*keys).agg(joined.alias("text"), largest.alias("size"), F.count("*").alias("spans"), *box())


def _swept(boxes: DataFrame, keys: list[str], begin: str, end: str, gap: float) -> DataFrame:
    """`boxes` with their stripe within the one they are in."""
    within = Window.partitionBy(*keys, "stripe")
    order = within.orderBy(begin, end, *_EDGES)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = boxes.withColumn("_new", F.when(F.col(begin) > reach + gap, 1).otherwise(0))
    cut = new.withColumn("_cut", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.withColumn("stripe", F.concat("stripe", F.lit("."), F.col("_cut").cast("string"))).drop("_new", "_cut")


def merged(boxes: DataFrame, keys: list[str], gap: float = 0.0, most_sweeps: int = 64) -> DataFrame:
    """(keys, block, boxes, x0, y0, x1, y1): the blocks of each page, numbered from its top and then from the left."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in _EDGES)
    whole = boxes.where(x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull())
    own = whole.select(*keys, F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"), F.lit("").alias("stripe"))
    before = None
    for _ in range(most_sweeps):
        own = _swept(_swept(own, keys, "y0", "y1", gap), keys, "x0", "x1", gap)
        # names of stripes are made short again, so that they do not grow with the sweeps
        own = kept(own.withColumn("stripe", F.md5("stripe")), "stripes")
        stripes = own.select(*keys, "stripe").distinct().count()
        if stripes == before:
            break
        before = stripes
    found = own.groupBy(*keys, "stripe").agg(F.count("*").alias("boxes"), *box())
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "y1", "x1")) - 1
    return found.select(*keys, number.alias("block"), "boxes", *_EDGES)
