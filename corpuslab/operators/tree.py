"""The folders of a project as a tree: totals rolled up to every folder, entries in the order they are drawn in.

An entry's key is its path with a mark on each part, so that sorting keys walks the
tree from the top, folders before files; a large project is drawn by a sort.  The
totals of folders and the last entry of each are aggregates, which a folder that
holds most of the files takes part in by tasks before they meet.

Rows are files; two rows of one path are one file with both their bytes and lines.
Null and empty paths are left out; null bytes and lines are 0.  A path can be a
file and a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a tree is drawn, and what stands for folders that are too deep.
_BRANCH, _LAST, _BAR, _BLANK, _MORE = "├── ", "└── ", "│   ", "    ", "... (省略)"


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))


def _key(parts: Column, folder: Column) -> Column:
    """Sorts as the tree is drawn: parts are folders but for the last one of a file; the separator sorts before any other character."""
    marked = F.transform(parts, lambda x, i: F.concat(F.when(folder | (i < F.size(parts) - 1), "0").otherwise("1"), x))
    return F.array_join(marked, "\u0001")


def entries(files: DataFrame, path: str = "path", size: str = "length", lines: str | None = None) -> DataFrame:
    """(path, parent, name, depth, folder, files, folders, bytes, lines, key): all files, and all folders with what is below them."""
    count = F.coalesce(F.col(lines).cast("long"), F.lit(0)) if lines else F.lit(0)
    own = files.select(_parts(F.col(path)).alias("parts"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("bytes"), count.cast("long").alias("lines")).where(F.size("parts") > 0)
    once = own.groupBy("parts").agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda n: F.slice("parts", F.lit(1), n))
    held = once.where(F.size("parts") > 1).select(F.explode(above).alias("parts"), "bytes", "lines")
    folders = held.groupBy("parts").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
    below = folders.where(F.size("parts") > 1).select(F.explode(above).alias("parts")).groupBy("parts").agg(F.count("*").alias("folders"))
    folders = folders.join(below, "parts", "left").na.fill(0, ["folders"])
    zero = F.lit(0).cast("long")
    both = folders.withColumn("folder", F.lit(True)).unionByName(once.select("parts", F.lit(1).cast("long").alias("files"), "bytes", "lines", zero.alias("folders"), F.lit(False).alias("folder")))
    name = F.element_at("parts", -1)
    joined = lambda x: F.array_join(x, "/")
    return both.select(
        joined(F.col("parts")).alias("path"), joined(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("parent"), name.alias("name"), F.size("parts").alias("depth"),
        "folder", "files", "folders", "bytes", "lines", _key(F.col("parts"), F.col("folder")).alias("key"),
    )


def totals(found: DataFrame) -> DataFrame:
    """(files, folders, bytes, lines) of the whole project; `found` as entries gives it."""
    is_file = ~F.col("folder")
    of = lambda c: F.coalesce(F.sum(F.when(is_file, F.col(c))), F.lit(0)).alias(c)
    return found.agg(F.count_if(is_file).alias("files"), F.count_if(F.col("folder")).alias("folders"), of("bytes"), of("lines"))


def draw(found: DataFrame, most_depth: int = 5) -> DataFrame:
    """(key, line): the tree down to a depth, to be sorted by key; a line stands for what is below the deepest folders."""
    shown = found.where(F.col("depth") <= most_depth)
    last = shown.groupBy("parent").agg(F.max("key").alias("last"))
    marked = shown.join(last, "parent").select("path", "folder", "key", "depth", "name", "bytes", (F.col("key") == F.col("last")).alias("last"))
    # of each entry the folders above it, and whether each is the last of its own
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = marked.where("depth > 1").select("key", F.explode(above).alias("path")).join(marked.where("folder").select("path", F.col("depth").alias("at"), F.col("last").alias("ends")), "path")
    bars = up.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ends"))), lambda x: F.when(x["ends"], _BLANK).otherwise(_BAR)), "").alias("bars"))
    drawn = marked.join(bars, "key", "left").withColumn("bars", F.coalesce("bars", F.lit("")))
    label = F.when(F.col("folder"), F.concat("name", F.lit("/"))).otherwise(F.concat("name", F.lit(" ("), F.format_number("bytes", 0), F.lit("B)")))
    lines = drawn.select("key", F.concat("bars", F.when(F.col("last"), _LAST).otherwise(_BRANCH), label).alias("line"))
    deep = drawn.where(F.col("folder") & (F.col("depth") == most_depth))
    more = deep.select(F.concat("key", F.lit("\u0001")).alias("key"), F.concat("bars", F.when(F.col("last"), _BLANK).otherwise(_BAR), F.lit(_MORE)).alias("line"))
    return lines.unionByName(more)
