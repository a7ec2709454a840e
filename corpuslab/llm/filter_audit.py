"""What quality filters take from each other, in every order they can be applied in.

Each document gets a mask of the filters that it fails.  Four are read from the
text itself; the fifth, being a copy of a document with a smaller id, is decided
in radix tries.  A task keeps the smallest id of the texts it has met, so that of
a group of copies it sends on one, whatever their number.  What is sent on is
parted by prefixes: of 8 bytes, and where documents that begin alike are more than
a task should hold, of 64, 512 and so on, up to whole texts.  Whole texts that are
still too many are thinned out in salted tries first.  Each prefix is a range of
texts; its full texts go into one compressed trie, whose terminals hold the rows
and the smallest id, and a walk over the terminals gives the flags.

Masks are then counted by part and label, and the counts of 32 masks give all rows
for all 120 orders.

Null text is empty; empty texts are copies of each other.  Null ids are copies of
nothing, and nothing is a copy of them.  Rows that share id and text count each
and are not copies of one another.  A null part is the empty string.  Of several
labels of one id the largest counts; null labels are 0.  An empty table gives an
empty result; further columns are ignored.  Texts of any length are read whole.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written

FILTERS = "ABCDE"
COPY = 16
#: Least and most bytes of texts with one prefix that a task takes, most prefixes that are split (a bound for what is broadcast), and texts a task remembers.
LEAST_LOAD, LOAD, MOST_SPLIT, REMEMBERED = 1 << 20, 32 << 20, 100_000, 200_000
HEADS = [8 << 3 * k for k in range(9)]
_SPECIAL = np.zeros(256, np.int64)
_SPECIAL[list(b"#$%&*|")] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(values))[offsets])


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits 1, 2, 4 and 8 for filters A to D."""
    words = W.words(texts)
    data, offsets = W._buffers(texts)
    n = words.counts
    different = np.array([len(np.unique(words.hashes[a:b])) for a, b in itertools.pairwise(words.first.tolist())], np.int64)
    upper, points = _sums((data >= 65) & (data <= 90), offsets), _sums((data & 0xC0) != 0x80, offsets)
    failed = [n < 50, 100 * different < 65 * n, 100 * upper > 5 * points, _sums(_SPECIAL[data], offsets) > 0]
    return sum(f.astype(np.int64) << k for k, f in enumerate(failed))


class TextTrie:
    """Compressed trie over bytes; a terminal holds its rows, each beginning with an id, and the smallest id."""

    def __init__(self):
        #: Node: label, children by first byte, rows (none where no text ends), smallest id.
        self.root = [b"", {}, None, None]

    def insert(self, text: bytes, row: tuple) -> None:
        node, at = self.root, 0
        while True:
            label = node[0]
            if not text.startswith(label, at):
                same = _common(text, at, label)
                below = [label[same:], node[1], node[2], node[3]]
                node[:] = [label[:same], {label[same]: below}, None, None]
                label = node[0]
            at += len(label)
            if at == len(text):
                break
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None, None]
            node = child
        if node[2] is None:
            node[2], node[3] = [], row[0]
        node[2].append(row)
        node[3] = min(node[3], row[0])

    def terminals(self) -> Iterator[tuple[bytes, list[tuple], object]]:
        """(text, rows, smallest id) in the order of texts."""
        todo = [(self.root, b"")]
        while todo:
            node, before = todo.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2], node[3]
            todo += [(node[1][k], text) for k in sorted(node[1], reverse=True)]


def _common(text: bytes, at: int, label: bytes) -> int:
    """Length of the longest prefix of `label` that `text` has at `at`, which is not all of it."""
    lo, hi = 0, len(label) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if text.startswith(label[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


_ROWS = "doc_id {kind}, part string, failed int, n long, text binary, size long, heads array<long>"


def _batch(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Of (doc_id, part, failed, n, text or nothing)."""
    ids, parts, failed, n, texts = zip(*rows, strict=True)
    columns = [pa.array(ids, kind), pa.array(parts, pa.string()), pa.array(failed, pa.int32()), pa.array(n, pa.int64()), pa.array(texts, pa.binary())]
    columns += [pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([None if t is None else _heads(t) for t in texts], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "failed", "n", "text", "size", "heads"])


def _heads(text: bytes) -> list[int]:
    """Hashes of the prefixes of each length, the last one of the whole text."""
    found = [xxhash.xxh3_64_intdigest(text[:x], seed=x) for x in HEADS if x < len(text)] + [xxhash.xxh3_64_intdigest(text)]
    return [x - (1 << 63) for x in found]


def _first_rows(docs: DataFrame, remembered: int) -> DataFrame:
    """Rows with the filters they fail; those of which the task has met no copy with a smaller id also with their text, to be looked at further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, object] = {}
        for batch in batches:
            failed = np.concatenate([text_masks(part.column(1)) for part in W.parts([batch])] or [np.zeros(0, np.int64)]).tolist()
            ids, texts, parts = (batch.column(k).to_pylist() for k in range(3))
            some: dict[tuple, int] = {}
            for k in sorted((k for k, x in enumerate(ids) if x is not None), key=ids.__getitem__):
                text = (texts[k] or "").encode()
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if ids[k] > least.setdefault(digest, ids[k]):
                    key = (ids[k], parts[k], failed[k] | COPY, None)
                else:
                    least[digest] = ids[k]
                    key = (ids[k], parts[k], failed[k], text)
                some[key] = some.get(key, 0) + 1
            for k, x in enumerate(ids):
                if x is None:
                    key = (None, parts[k], failed[k], None)
                    some[key] = some.get(key, 0) + 1
            if some:
                yield _batch(batch.schema.field(0).type, [(i, p, f, n, t) for (i, p, f, t), n in some.items()])
            if len(least) > remembered:
                least = {}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, _ROWS.format(kind=kind))


def _leaves(rows: DataFrame, load: int) -> tuple[DataFrame, DataFrame]:
    """`rows` with their leaf, the shortest prefix whose texts have at most `load` bytes, or half a partition if that is less, or else the whole text; and (leaf, salts) of the whole texts with more."""
    weighed = rows.select("heads", "size")
    total = weighed.agg(F.sum("size")).head()[0] or 0
    half = total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # tables of at most MOST_SPLIT hashes are broadcast: no more prefixes can have over `most` bytes
    most = max(min(load, max(half, LEAST_LOAD)), total // MOST_SPLIT)
    leaf, still, whole, names = F.lit(None).cast("long"), F.lit(True), F.element_at("heads", -1), []
    heavy = lambda key: weighed.where(still).groupBy(key.alias("leaf")).agg(F.sum("size").alias("size")).where(F.col("size") > most)
    for k in range(len(HEADS) + 1):
        own, name = F.coalesce(F.get("heads", F.lit(k)), whole), f"_heavy{k}"
        names.append(name)
        split = F.broadcast(written(heavy(own).select(F.col("leaf").alias(name)), "heavy"))
        weighed, rows = (x.join(split, own == F.col(name), "left") for x in (weighed, rows))
        leaf = F.coalesce(leaf, F.when(F.col(name).isNull(), own))
        still = still & F.col(name).isNotNull()
        if not weighed.where(still & (own != whole)).head(1):
            break
    over = written(heavy(whole).select("leaf", F.ceil(F.col("size") / most).alias("salts")), "over")
    return rows.withColumn("leaf", F.coalesce(leaf, whole)).drop(*names), over


def _through_tries(rows: DataFrame, last: bool) -> DataFrame:
    """Rows of each leaf through one trie: copies are flagged and, if these are the last tries, all rows settled; else rows of the smallest id keep their text."""

    def settled(trie: TextTrie) -> Iterator[tuple]:
        for text, held, least in trie.terminals():
            some: dict[tuple, int] = {}
            for i, part, failed, n in held:
                key = (i, part, failed | COPY) if i > least else (i, part, failed)
                some[key] = some.get(key, 0) + n
            for (i, part, failed), n in some.items():
                yield i, part, failed, n, text if not last and i == least else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now, kind = TextTrie(), None, None

        def flush() -> Iterator[pa.RecordBatch]:
            found = settled(trie)
            while some := list(itertools.islice(found, 1024)):
                yield _batch(kind, some)

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, part, failed, n, text, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if leaf != now:
                    yield from flush()
                    trie, now = TextTrie(), leaf
                trie.insert(text, (i, part, failed, n))
        if kind is not None:
            yield from flush()
        W.trim()

    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = ["leaf"] if last else ["leaf", "salt"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    leaf = F.col("leaf") if last else F.xxhash64(*keys)
    return dealt.select("doc_id", "part", "failed", "n", "text", leaf.alias("leaf")).mapInArrow(run, _ROWS.format(kind=kind))


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source", load: int = LOAD, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, part, failed, n): how many rows of an id and a part fail which filters, as bits in the order of FILTERS."""
    bound(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    names, open_rows, out = ["doc_id", "part", "failed", "n"], "text is not null", []
    rows = written(_first_rows(own, remembered), "rows")
    while True:
        out.append(rows.where("text is null").select(*names))
        rows = rows.where(open_rows)
        leaved, over = _leaves(rows, load)
        if not over.head(1):
            break
        copies = leaved.join(F.broadcast(over), "leaf").withColumn("salt", F.pmod(F.xxhash64("doc_id", "part", "failed"), F.col("salts")))
        thin = written(_through_tries(copies, last=False), "thin")
        if 2 * thin.where(open_rows).count() > copies.count():
            break  # rows of one id in many parts: none is a copy of another
        rows = written(leaved.join(F.broadcast(over), "leaf", "left_anti").select(thin.columns).unionByName(thin), "rows")
    out.append(_through_tries(leaved, last=True).select(*names))
    return functools.reduce(DataFrame.unionByName, out).groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))


ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]


def _effects() -> list[tuple]:
    """What a document with each mask adds to each step of each order."""
    out = []
    for order, mask in itertools.product(ORDERS, range(1 << len(FILTERS))):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = bool(mask & bit), bool(mask & before)
            before |= bit
            share = len(ORDERS) // mask.bit_count() if fails else 0
            out.append((mask, order, step, int(not mask & before), int(fails and not gone), int(fails and gone), int(mask == bit), share))
    return out


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of `docs` with `labels` (doc_id, quality, toxic)."""
    failed = failures(docs, **options)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    judged = failed.join(known, "doc_id", "left")
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    masks = written(judged.groupBy("part", "failed").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("bad")), "masks")
    # 19,200 rows whatever the input
    effects = docs.sparkSession.createDataFrame(_effects(), "failed int, filter_order string, step int, keeps int, takes int, late int, alone int, share int")
    total = lambda weight, of="n": F.sum(F.col(weight) * F.col(of))
    return (
        masks.join(F.broadcast(effects), "failed")
        .groupBy("part", "filter_order", "step")
        .agg(
            total("keeps").alias("kept"),
            total("takes").alias("removed"),
            total("late").alias("redundant"),
            total("alone").alias("unique_fails"),
            total("takes", "good").alias("good_lost"),
            total("takes", "bad").alias("toxic_lost"),
            total("share").alias("shapley"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH read AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f FROM read),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
each AS (
  SELECT part, filter_order, step, n, good, bad, f[ord(filter_order[step]) - 64] AS fails,
         len(list_filter(range(1, step), lambda i: f[ord(filter_order[i]) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS k
  FROM masks, steps)
SELECT part, filter_order, CAST(step AS INT) AS step,
       CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND k = 1), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(k, 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM each GROUP BY part, filter_order, step"""
