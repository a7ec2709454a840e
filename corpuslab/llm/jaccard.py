"""Exact Jaccard self-join of documents on word shingles, by pivots in metric regions.

Distance is 1 - Jaccard similarity, a metric; documents within `1 - threshold`
link.  Distances between unrelated texts are all close to 1, so pivots taken from
the documents alone would put every text into every window.  The outermost
pivots are therefore the smallest sets there are, single shingles, ordered from
rare to frequent: a document lies in the regions of its first
|s| - ceil(threshold |s|) + 1 shingles, which is the triangle inequality for such
pivots (two sets that link differ in too little to share none of these).
Regions with the same members are one region.

Sizes of sets that link differ by a bounded factor, so a region falls apart where
no member has a size in between.  Counts of shingles by bucket (more buckets for larger sets) bound the
intersection of two sets from above; members that this bound keeps apart are parted
too, by pairs in regions of up to `small` members and in one task each above.
What is left of overlapping regions is merged, so that each set is sent once.  A
merged region beyond `most` shingles is parted in Spark around `pivots` of its
own sets: each set falls to the Voronoi cell of the nearest pivot (or to the rest,
beyond `_RADIUS` of all), and goes as a guest into the windows that the triangle
inequality leaves in earlier cells: |d(x, q) - d(x, p)| within twice the threshold.
In a cell only the shingles in which a set differs from the pivot are sent and counted,
so thousands of near copies fit a task.  Cells that do not recur as regions of their own.  A region that fits a task is joined there in
the same way: all members are measured against a pivot, those within the threshold
fall to its cell and are linked, the others look for a further pivot; sets that are
no pivots are only measured against each other where a window is left, and not
either where the sum of their distances to the pivot already proves the link.
Sets that all are similarly far from each other cannot be parted by pivots; there
every two blocks meet, in which only pairs across count.
Every pair that might link is so measured once or decided by a bound; the
components and the numbers of links are exact.

Each step works on distinct sets: exact copies are one member.  A text with fewer
words than a shingle is one shingle; texts without words (null or empty) link
with nothing; null ids have a null component; rows that share an id link like
others; an empty table gives an empty result; further columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm import filters
from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written
from corpuslab.llm.graph import components

SHINGLE, PERCENT, SMALL, MOST, BUCKETS, PIVOTS = 5, 80, 4, 1 << 19, 256, 16
#: Bytes of counts by bucket that one task compares.
COUNTED = 8 << 20
#: How far from its pivot a set is at most, what share of its parent a cell has that is parted once more, and how often regions are parted at most.
_RADIUS, _SHRINKS, _DEEPEST = 0.6, 0.9, 8
_LONE = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text, in lower case A-Z."""
    words = W.words(texts, lower=True)
    grams = W.grams(words.hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = _LONE * np.uint64(b - a)
            for w in words.hashes[a:b]:
                h = W.mix(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return int(s.sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(W.mix(s ^ np.uint64(len(s))))).to_bytes(8, "big")


def _first_pivots(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The shingles, from rare to frequent, in whose regions a set lies."""
    n = len(s)
    count = n - -(-percent * n // 100) + 1 if n else 0
    return s[np.lexsort((s, levels[filters.bucket(s)]))[:count]]


def shingle_counts(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How often shingles of each bucket are found, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << filters.SKETCH_BITS, np.int64)
        for batch in W.parts(batches):
            sets = shingle_sets(batch.column(0), size)
            if sets:
                total += np.bincount(filters.bucket(np.concatenate(sets)), minlength=len(total))
        yield filters.sketch_rows(total)

    return filters.gather_sketch(docs.select("text").mapInArrow(count, "part int, n binary"))


def shared_pivots(docs: DataFrame, levels, size: int, percent: int) -> DataFrame:
    """(pivot): shingles in whose regions at least two different sets lie."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            sets = [s for s in shingle_sets(batch.column(0), size) if len(s)]
            pivots = [_first_pivots(s, levels.value, percent) for s in sets]
            names = [int.from_bytes(_name(s)[8:], "big", signed=True) for s in sets]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pivots).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), [len(p) for p in pivots]))], ["pivot", "name"])

    rows = docs.select("text").mapInArrow(place, "pivot long, name long")
    return rows.groupBy("pivot").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("pivot")


def members(docs: DataFrame, levels, shared, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, name, pivots, counts): the last two are null where no region is shared, or where the task has given them for that set before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in W.parts(batches):
            sizes, names, pivots, counts = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                sizes.append(len(s))
                names.append(_name(s) if len(s) else None)
                own = _first_pivots(s, levels.value, percent)
                own = own[filters.may_hold(shared.value, own)]
                new = len(own) > 0 and names[-1] not in given
                if new:
                    if len(given) > 100_000:
                        given.clear()
                    given.add(names[-1])
                pivots.append(own.view(np.int64) if new else None)
                counts.append(bucket_counts(s).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(pivots, pa.list_(pa.int64())), pa.array(counts, pa.binary())],
                ["doc_id", "n_shingles", "name", "pivots", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_shingles long, name binary, pivots array<long>, counts binary")


def _name_hash(names: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(n[8:], "big") for n in names], np.uint64)


def shingles_of(docs: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """(name, shingles) for sets among `names`, and by chance a few others; a set once for each task that has it."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_name_hash(batch.column(0).to_pylist()).view(np.int64))], ["h"])

    wanted = docs.sparkSession.sparkContext.broadcast(filters.bloom(names.select("name").mapInArrow(hashes, "h long")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in W.parts(batches):
            sets = [s for s in shingle_sets(batch.column(0), size) if len(s)]
            named = [_name(s) for s in sets]
            asked = filters.may_hold(wanted.value, _name_hash(named)) if named else []
            out = {n: s.view(np.int64) for n, s, k in zip(named, sets, asked, strict=True) if k and n not in given}
            if len(given) > 100_000:
                given.clear()
            given.update(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.list_(pa.int64()))], ["name", "shingles"])

    return docs.select("text").mapInArrow(find, "name binary, shingles array<long>")


def bucket_counts(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall to each bucket, 255 for any number from there on; larger sets have more buckets, at most two shingles to one on average."""
    buckets = max(BUCKETS, 1 << (len(s).bit_length() - 1))
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8)


def folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of counts for fewer buckets."""
    if counts.shape[1] == buckets:
        return counts
    parts = counts.reshape(len(counts), -1, buckets)
    total = np.minimum(parts.sum(1, dtype=np.int64), 255).astype(np.uint8)
    total[(parts == 255).any(1)] = 255
    return total


def most_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of the intersections of sets, from their counts by bucket; a full bucket may hold any number."""
    least = np.minimum(x, y)
    out = least.sum(-1, dtype=np.int64)
    full = (x == 255) | (y == 255)
    if full.any():
        out += (full & ((x == 255) & (y == 255))).sum(-1) << 40
        odd = full & ~((x == 255) & (y == 255))
        out += np.where(odd, np.where(x == 255, y, x).astype(np.int64) - least, 0).sum(-1)
    return out


def may_link(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose counts by bucket allow an intersection that is large enough."""
    both = pairs.join(counts.select(F.col("name").alias("a"), F.col("counts").alias("ca")), "a").join(counts.select(F.col("name").alias("b"), F.col("counts").alias("cb")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ca, cb = ([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("ca", "cb"))
            sizes, of = np.unique([(len(x), len(y)) for x, y in zip(ca, cb, strict=True)], axis=0, return_inverse=True)
            most = np.zeros(len(na), np.int64)
            for k in range(len(sizes)):
                at, few = np.flatnonzero(of.ravel() == k), int(sizes[k].min())
                most[at] = most_common(folded(np.stack([ca[i] for i in at]), few), folded(np.stack([cb[i] for i in at]), few))
            most = np.minimum(most, np.minimum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(most * 100 >= (na + nb - most) * percent))

    return both.select("a", "na", "b", "nb", "ca", "cb").mapInArrow(keep, "a binary, b binary")


def _parted(large: DataFrame, counts: DataFrame, percent: int, counted: int = COUNTED) -> DataFrame:
    """(a, b): links that keep together what the bound does not part, for larger regions; one with too many counts for a task stays whole."""

    def part(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        names, n = table["name"].to_pylist(), table["n"].to_numpy()
        rows = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["counts"]]
        widths = np.array([len(x) for x in rows])  # larger sets have as many buckets at least
        cell = np.arange(len(n))
        for width in np.unique(widths).tolist():
            first, end = (int(np.searchsorted(widths, width, side)) for side in ("left", "right"))
            last = int(np.searchsorted(n, n[end - 1] * 100 / percent, "right"))
            x = np.concatenate([folded(rows[k][None], width) for k in range(first, last)])
            for k in range(first, end):
                stop = int(np.searchsorted(n, n[k] * 100 / percent, "right"))
                most = np.minimum(most_common(x[k - first], x[k - first + 1 : stop - first]), n[k])
                near = k + 1 + np.flatnonzero(most * 100 >= (n[k] + n[k + 1 : stop] - most) * percent)
                joined = np.unique(np.append(cell[near], cell[k]))
                if len(joined) > 1:
                    cell[np.isin(cell, joined)] = joined[0]
        other = np.flatnonzero(cell != np.arange(len(n)))
        return pa.table({"a": pa.array([names[cell[k]] for k in other], pa.binary()), "b": pa.array([names[k] for k in other], pa.binary())})

    with_counts = large.join(counts.select("name", "counts"), "name").select("region", "name", "n", "counts")
    sizes = large.join(counts.select("name", F.octet_length("counts").alias("c")), "name").groupBy("region").agg(F.sum("c").alias("c"))
    fits = written(sizes.select("region", (F.col("c") <= counted).alias("fits")), "fits")
    parted = with_counts.join(fits.where("fits"), "region", "left_semi").groupBy("region").applyInArrow(part, "a binary, b binary")
    whole = large.join(fits.where("not fits"), "region", "left_semi")
    first = whole.groupBy("region").agg(F.min("name").alias("a"))
    return parted.unionByName(whole.join(first, "region").select("a", F.col("name").alias("b")).where("a <> b"))


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int")


def _islands(regions: DataFrame, percent: int) -> DataFrame:
    """(region, name, n, size): regions cut where no member has a size in between, without those of one member, and one of those that have the same members."""
    regions = regions.withColumn("class", _size_class(F.col("n"), percent))
    classes = regions.groupBy("region", "class").agg(F.count("*").alias("k"))
    order = Window.partitionBy("region").orderBy("class")
    parted = F.coalesce((F.col("class") - F.lag("class").over(order) > 1).cast("int"), F.lit(0))
    classes = classes.withColumn("cut", parted).withColumn("island", F.sum("cut").over(order)).select("region", "class", "island")
    cut = regions.join(classes, ["region", "class"]).select(F.concat_ws(":", "region", "island").alias("region"), "name", "n")
    cut = written(cut, "islands")
    h = F.xxhash64("name")
    shape = cut.groupBy("region").agg(F.count("*").alias("size"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).where("size > 1")
    kept = shape.groupBy("size", "s", "x").agg(F.min("region").alias("region")).select("region", "size")
    return cut.join(kept, "region")


def _pairs_of_small(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs within regions of bounded size."""
    grouped = regions.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("n", "name"))).alias("m"))
    each = grouped.select("m", F.posexplode("m").alias("at", "x"))
    # sorted by size, so partners are the members that follow and are not too large
    near = F.filter(F.slice("m", F.col("at") + 2, F.size("m")), lambda y: y["n"] * percent <= F.col("x.n") * 100)
    return each.select("x", F.explode(near).alias("y")).select(F.col("x.name").alias("a"), F.col("x.n").alias("na"), F.col("y.name").alias("b"), F.col("y.n").alias("nb")).distinct()


class Region:
    """The sets of one region in a task, joined around pivots.

    A set is given by its elements, or, where all of a region are near one base
    set, by those in which it differs from the base: with `lacking` elements of the base's
    `base` missing, two sets share base - lacking - lacking' elements and the differences
    they have in common.
    """

    def __init__(self, elements: list[np.ndarray], percent: int, sizes: np.ndarray | None = None, lacking: np.ndarray | None = None, base: int = 0):
        lengths = np.array([len(x) for x in elements], np.int64)
        self.sizes = lengths if sizes is None else sizes
        self.lacking, self.base = np.zeros(len(lengths), np.int64) if lacking is None else lacking, base
        self.percent, self.threshold = percent, 1 - percent / 100
        self.reach = self.threshold + 1e-9
        ids = np.unique(np.concatenate(elements), return_inverse=True)[1].astype(np.int32)
        holders = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        order = np.argsort(ids, kind="stable")
        self.holders = holders[order]
        self.edges = np.append(0, np.cumsum(np.bincount(ids)))
        self.ids = np.split(ids, np.cumsum(lengths)[:-1])

    def common(self, k: int) -> np.ndarray:
        """Sizes of the intersections of set k with all sets."""
        rest = self.base - self.lacking[k] - self.lacking
        if not len(self.ids[k]):
            return rest
        return rest + np.bincount(np.concatenate([self.holders[self.edges[i] : self.edges[i + 1]] for i in self.ids[k]]), minlength=len(self.sizes))

    def linked(self, k: int, common: np.ndarray) -> np.ndarray:
        return common * 100 >= (self.sizes[k] + self.sizes - common) * self.percent

    def links(self, own: np.ndarray, across: bool, mask: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that connect what is connected, and the number of links of each set.

        Pairs whose masks share a bit count elsewhere, and if `across`, so do pairs with the same `own`.
        """
        n, out = len(self.sizes), []
        number, label = np.zeros(n, np.int64), np.arange(n)

        def here(k: int, near: np.ndarray) -> np.ndarray:
            counts = (near != k) & (mask[near] & mask[k] == 0)
            return counts & (own[near] != own[k]) if across else counts

        def measured(k: int, common: np.ndarray) -> np.ndarray:
            near = np.flatnonzero(self.linked(k, common))
            number[k] = np.count_nonzero(here(k, near))
            labels, first = np.unique(label[near], return_index=True)
            for old, y in zip(labels.tolist(), near[first].tolist(), strict=True):
                if old != label[k]:
                    label[label == old] = label[k]
                    out.append((k, y))
            return near

        cell, is_pivot = np.full(n, -1), np.zeros(n, bool)
        around: list[tuple[np.ndarray, np.ndarray]] = []  # of each pivot the sets within twice the threshold, and their distances
        for k in np.argsort(-self.sizes, kind="stable").tolist():
            if cell[k] >= 0:
                continue
            common = self.common(k)
            near = measured(k, common)
            number[near[here(k, near)]] += 1  # pivots do not link with each other
            cell[near[cell[near] < 0]] = len(around)
            is_pivot[k] = True
            some = np.flatnonzero(common)
            distance = 1 - common[some] / (self.sizes[k] + self.sizes[some] - common[some])
            close = distance <= 2 * self.reach
            around.append((some[close], distance[close]))
        for p, (close, distance) in enumerate(around):
            free = ~is_pivot[close]
            close, distance = close[free], distance[free]
            order = np.argsort(distance, kind="stable")
            close, distance = close[order], distance[order]
            for x in np.flatnonzero(cell[close] == p).tolist():
                # a pair within the threshold differs by no more in its distances to the pivot; all links to pivots are known
                low, high = np.searchsorted(distance, distance[x] - self.reach), np.searchsorted(distance, distance[x] + self.reach, "right")
                if high - low <= 1:
                    continue
                if distance[high - 1] + distance[x] <= self.threshold - 1e-9:  # and by so little in their sum that all link
                    number[close[x]] += np.count_nonzero(here(close[x], close[low:high]))
                else:
                    measured(close[x], self.common(close[x]))
        return out, number


def _cells(sets: DataFrame, weights: DataFrame, depth: int, percent: int, most: int, pivots: int) -> DataFrame:
    """(region, parent_w, name, n, mask, base, lacking, elements): the members of large regions in the cells of pivots chosen among them.

    `sets` has (region, name, n, mask, shingles).  Of the sets chosen for pivots those
    count that lie beyond `_RADIUS` of the ones before.  A member within `_RADIUS` of
    a pivot falls to the nearest one's cell, the others to a last cell of their own.
    It goes into an earlier cell as well, marked as a guest, where the triangle
    inequality leaves a window: a set that links with it may be nearest to that pivot.
    A pair is so together in one cell where it is not two guests, and in one only.
    In a cell a set is what differs from the pivot, the base of its cell; in the last one it is itself.
    """
    threshold = 1 - percent / 100
    keyed = sets.join(weights, "region")
    slot = F.pmod(F.xxhash64("name", F.lit(depth)), F.lit(pivots)).cast("int")
    chosen = sets.groupBy("region", slot.alias("pivot")).agg(F.min(F.struct(F.xxhash64("name", F.lit(-depth - 1)).alias("h"), "name")).alias("x"))
    chosen = written(chosen.select("region", "pivot", F.col("x.name").alias("name")), "pivots")
    chunks = F.ceil(F.col("w") / most).cast("int")
    salted = keyed.select("region", "w", F.pmod(F.xxhash64("name", F.lit(7)), chunks).cast("int").alias("salt"), F.lit(None).cast("int").alias("pivot"), "name", "n", "mask", "shingles")
    sent = keyed.join(chosen, ["region", "name"]).select("region", "w", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("salt"), "pivot", "name", "n", "mask", "shingles")

    def measured(centre: np.ndarray, shingles: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(centre, shingles), len(centre) - 1)
        common = np.bincount(owner[centre[place] == shingles], minlength=len(n))
        return 1 - common / (n + len(centre) - common)

    def assign(table: pa.Table) -> pa.Table:
        is_pivot = np.asarray(table["pivot"].is_valid())
        centres: list[np.ndarray] = []
        for x in table.filter(pa.array(is_pivot)).sort_by("pivot")["shingles"]:
            s = np.asarray(x.values).view(np.uint64)
            if all(measured(c, s, np.zeros(len(s), np.int64), np.array([len(s)]))[0] > _RADIUS for c in centres):
                centres.append(s)
        table = table.filter(pa.array(~is_pivot))
        n, last = table["n"].to_numpy(), len(centres)
        sets = [np.asarray(x.values).view(np.uint64) for x in table["shingles"]]
        shingles, owner = np.concatenate(sets or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(n)), n)
        distance = np.array([measured(c, shingles, owner, n) for c in centres])
        nearest = distance.argmin(0)
        least = distance[nearest, np.arange(len(n))]
        home = np.where(least <= _RADIUS, nearest, last)
        at, cell, guest = [np.arange(len(n))], [home], [np.zeros(len(n), bool)]
        for k in range(last):
            near = (k < home) & (distance[k] <= _RADIUS + threshold + 1e-9) & ((home == last) | (distance[k] - least <= 2 * threshold + 1e-9))
            at.append(np.flatnonzero(near))
            cell.append(np.full(len(at[-1]), k))
            guest.append(np.ones(len(at[-1]), bool))
        at, cell, guest = np.concatenate(at), np.concatenate(cell), np.concatenate(guest)
        of = table.take(pa.array(at))
        bases = np.array([*map(len, centres), 0])[cell]
        elements = [np.setxor1d(sets[k], centres[c], assume_unique=True) if c < last else sets[k] for k, c in zip(at.tolist(), cell.tolist(), strict=True)]
        lacking = np.where(cell < last, (np.array([len(x) for x in elements], np.int64) + bases - n[at]) // 2, 0)
        region = pa.array([f"{r}/{c}" for r, c in zip(of["region"].to_pylist(), cell.tolist(), strict=True)], pa.string())
        columns = {"region": region, "parent_w": of["w"], "name": of["name"], "n": of["n"], "mask": pa.array(of["mask"].to_numpy() | (guest.astype(np.int64) << depth))}
        return pa.table(columns | {"base": pa.array(bases.astype(np.int64)), "lacking": pa.array(lacking), "elements": pa.array([x.view(np.int64) for x in elements], pa.list_(pa.int64()))})

    return salted.unionByName(sent).groupBy("region", "salt").applyInArrow(assign, "region string, parent_w long, name binary, n long, mask long, base long, lacking long, elements array<long>")


def _recursed(shingles: DataFrame, large: DataFrame, percent: int, most: int, pivots: int) -> DataFrame:
    """(region, w, name, n, mask, base, lacking, elements): large regions parted into cells until each fits a task or pivots do not part it any more; w is the number of elements."""
    settled, depth = None, 0
    while True:
        weights = large.groupBy("region").agg(F.sum("n").alias("w"))
        cells = written(_cells(large.join(shingles, "name"), weights, depth, percent, most, pivots), "cells")
        guest = F.col("mask").bitwiseAND(F.lit(1 << depth))
        sizes = cells.groupBy("region").agg(
            F.sum(F.size("elements")).alias("w"), F.sum("n").alias("whole"), F.min("parent_w").alias("parent_w"), F.count("*").alias("k"), F.min(guest).alias("guests")
        )
        depth += 1
        # no pair counts in a cell of one member or of guests alone
        sizes = sizes.where("k > 1 and guests = 0")
        ends = (F.col("w") <= most) | (F.col("whole") > F.col("parent_w") * _SHRINKS) | F.lit(depth == _DEEPEST)
        sizes = written(sizes.select("region", "w", ends.alias("ends")), "sizes")
        done = cells.drop("parent_w").join(sizes.where("ends").drop("ends"), "region")
        settled = done if settled is None else settled.unionByName(done)
        if not sizes.where("not ends").head(1):
            return settled
        large = cells.join(sizes.where("not ends"), "region", "left_semi").select("region", "name", "n", "mask")


def _joined_regions(docs: DataFrame, merged: DataFrame, size: int, percent: int, most: int, pivots: int) -> DataFrame:
    """(a, b, n) for merged regions (region, name, n): links, and for each set and region (set, null, number of its links that count there)."""
    weights = written(merged.groupBy("region").agg(F.sum("n").alias("w")), "weights")
    members = merged.join(weights, "region").select(F.hex("region").alias("region"), "w", "name", "n", F.lit(0).cast("long").alias("mask"))
    shingles = shingles_of(docs, merged, size)
    parted = None
    if weights.where(F.col("w") > most).head(1):
        shingles = written(shingles.groupBy("name").agg(F.first("shingles").alias("shingles")), "shingles")
        parted = _recursed(shingles, members.where(F.col("w") > most).drop("w"), percent, most, pivots)
        members = members.where(F.col("w") <= most)
    none = F.lit(0).cast("long")
    sent = shingles.join(members, "name").select("region", "w", "name", "n", "mask", none.alias("base"), none.alias("lacking"), F.col("shingles").alias("elements"))
    sent = sent if parted is None else sent.unionByName(parted)
    # what pivots did not part: sets at similar distances from each other, of which every two blocks meet
    k = F.when(F.col("w") <= most, 1).otherwise(F.ceil(F.col("w") / most) * 2).cast("int")
    own = F.pmod(F.xxhash64("name"), k).cast("int")  # pairs of the same number count in the block of that number alone
    blocks = F.when(k == 1, F.array(F.lit("0"))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.concat_ws("-", F.least(own, j), F.greatest(own, j))))
    sent = sent.select("region", F.explode(blocks).alias("block"), own.alias("own"), "name", "n", "mask", "base", "lacking", "elements")

    def links(table: pa.Table) -> pa.Table:
        rows = {n: k for k, n in enumerate(table["name"].to_pylist())}  # a set may have come from several tasks
        table = table.take(pa.array(sorted(rows.values())))
        names, own, mask = table["name"].to_pylist(), table["own"].to_numpy(), table["mask"].to_numpy()
        elements = [np.asarray(x.values).view(np.uint64) for x in table["elements"]]
        across = len(set(table["block"][0].as_py().split("-"))) > 1
        region = Region(elements, percent, table["n"].to_numpy(), table["lacking"].to_numpy(), table["base"][0].as_py())
        found, number = region.links(own, across, mask)
        del region, elements
        W.trim()
        ordered = [sorted((names[a], names[b])) for a, b in found]
        some = np.flatnonzero(number).tolist()
        a = [x for x, _ in ordered] + [names[k] for k in some]
        b = [y for _, y in ordered] + [None] * len(some)
        n = [None] * len(ordered) + number[some].tolist()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})

    return sent.groupBy("region", "block").applyInArrow(links, "a binary, b binary, n long")


def set_links(docs: DataFrame, sets: DataFrame, size: int, percent: int, small: int, most: int, pivots: int) -> DataFrame:
    """(a, b, n): links between different sets that connect all sets that are connected, and rows (set, null, number of links) to be summed; `sets` has (name, n, pivots, counts)."""
    regions = written(_islands(sets.select(F.explode("pivots").alias("region"), "name", "n"), percent), "regions")
    counts = sets.select("name", "counts")
    near = may_link(_pairs_of_small(regions.where(F.col("size") <= small), percent), counts, percent)
    near = written(near.unionByName(_parted(regions.where(F.col("size") > small), counts, percent)), "near")
    merged = components(near).select(F.col("node").alias("name"), F.col("component").alias("region"))
    merged = written(merged.join(sets.select("name", "n"), "name"), "merged")
    return written(_joined_regions(docs, merged, size, percent, most, pivots), "links")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, small: int = SMALL, most: int = MOST, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links_measured): n_links_measured is the number of different other sets that a document's set links with.
    Exact copies are one set: all of them together count once for others, not at all for each other, and each has the number of its set."""
    bound(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    levels = context.broadcast(filters.frequency_levels(shingle_counts(own, size)))
    shared = context.broadcast(filters.bloom(written(shared_pivots(own, levels, size, percent), "shared")))
    found = written(members(own, levels, shared, size, percent), "members")
    sets = found.where("pivots is not null").groupBy("name").agg(F.first("n_shingles").alias("n"), F.first("pivots").alias("pivots"), F.first("counts").alias("counts"))
    links = set_links(own, written(sets, "sets"), size, percent, small, most, pivots)
    cell = components(links.where("b is not null")).withColumnRenamed("node", "name")
    degree = links.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n_links_measured"))
    linked = cell.join(degree, "name", "left")
    by_name = found.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least")).join(linked, "name", "left")
    by_name = written(by_name.select("name", F.coalesce("component", "name").alias("component"), "least", F.coalesce("n_links_measured", F.lit(0)).alias("n_links_measured")), "classes")
    least = by_name.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = by_name.join(least, "component").select("name", "component_id", "n_links_measured")
    out = found.select("doc_id", "n_shingles", "name").join(classes, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links_measured", F.lit(0)).cast("long").alias("n_links_measured"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of each component the one with the smallest id stays, and of several texts with that id one.

    Rows without id or words (null and empty texts) all stay, repeated rows of an id
    with words are one; further columns, whatever their names, pass through; an
    empty table stays empty.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    # rows that share an id are told apart by their text
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("doc_id", "text").alias("row")))
    keyed = given.withColumn("_key", key)
    first = join(keyed, doc_id="_key").where("component_id = doc_id").select(F.col("doc_id").alias("_key"), (F.col("n_shingles") > 0).alias("_words")).distinct()
    kept = keyed.join(first, "_key")
    if _repeats(docs):
        kept = kept.where("not _words").unionByName(kept.where("_words").dropDuplicates(["_key"]))
    return kept.select("_row.*").unionByName(docs.where("doc_id is null"))


def _repeats(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").head(1))
