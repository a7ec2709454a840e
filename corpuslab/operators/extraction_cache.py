"""Extraction that is done once for each content, whatever documents have it and however often it runs.

A result is kept under the SHA-256 of its text and the name of the rules that made
it.  A run extracts only contents that have none under its rules, in batches that
are committed one by one, so a run that dies has lost one batch; new rules extract
anew, and going back to old rules finds what these had made.  `collect` drops what no
input has any more.

Null text is the empty text.  Rows are independent: repeated rows, ties and null
ids pass through, an empty input gives an empty result.  Input columns whose names
the results have are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.tables import kept
from corpuslab.sources.versions import VersionedTable

_OWN = ["content", "rules", "run"]


@dataclass
class Run:
    """Rows of the inputs with what was extracted of their text and the name of the run that did; how many contents this run extracted."""

    rows: DataFrame
    extracted: int


class ExtractionCache:
    """`extract` makes of (content, text) a table of content and results, one row for each content."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], rules: str):
        self.table = VersionedTable(spark, path, ["content", "rules"])
        self.extract, self.rules = extract, rules

    @staticmethod
    def _content(text: str):
        return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)

    def _known(self) -> DataFrame | None:
        return self.table.read().where(F.col("rules") == self.rules) if self.table.versions() else None

    def run(self, inputs: DataFrame, name: str, text: str = "text", batches: int = 4) -> Run:
        """Extracts what is new among `inputs`, as the run `name`."""
        named = inputs.withColumn("content", self._content(text))
        known = self._known()
        new = named.select("content", F.coalesce(F.col(text), F.lit("")).alias("text"))
        if known is not None:
            new = new.join(known.select("content"), "content", "left_anti")
        # copies of a text meet before the shuffle; contents are spread evenly, being hashes
        once = new.groupBy("content").agg(F.first("text").alias("text"))
        todo = kept(once.withColumn("batch", F.pmod(F.xxhash64("content"), F.lit(batches))), "todo")
        done = 0
        for k in range(batches):
            part = todo.where(F.col("batch") == k).select("content", "text")
            found = kept(self.extract(part).withColumns({"rules": F.lit(self.rules), "run": F.lit(name)}), "extracted")
            if n := found.count():
                self.table.commit(found)
                done += n
        return Run(self.results(named, text), done)

    def results(self, inputs: DataFrame, text: str = "text") -> DataFrame:
        """`inputs` with the results of their contents; those without any are left out."""
        known = self._known()
        named = inputs.withColumn("content", self._content(text))
        if known is None:
            raise ValueError("nothing was extracted under these rules")
        clash = (set(inputs.columns) & set(known.columns)) - {"content"}
        if clash:
            raise ValueError(f"inputs have columns of the results: {sorted(clash)}")
        return named.join(known.drop("rules"), "content")

    def collect(self, inputs: DataFrame, text: str = "text", all_rules: bool = False) -> int:
        """Drops results that no row of `inputs` needs, of these rules or of all; how many."""
        have = self.table.read().select("content", "rules")
        live = inputs.select(self._content(text).alias("content")).distinct()
        stale = have if all_rules else have.where(F.col("rules") == self.rules)
        if all_rules:
            live = live.withColumn("rules", F.lit(self.rules))
        stale = kept(stale.join(live, live.columns, "left_anti"), "stale")
        n = stale.count()
        if n:
            self.table.commit(self.table.read().limit(0), deleted=stale)
        return n
