import random

from corpuslab.operators import blocks


def plain(boxes, gap):
    """Sweeps over lists until nothing is cut."""
    groups = [[(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in boxes]]
    while True:
        after = groups
        for lo, hi in ((1, 3), (0, 2)):
            parted = []
            for g in after:
                reach, stripes = None, []
                for b in sorted(g, key=lambda b: (b[lo], b[hi])):
                    if reach is None or b[lo] > reach + gap:
                        stripes.append([])
                    stripes[-1].append(b)
                    reach = max(reach, b[hi]) if reach is not None else b[hi]
                parted += stripes
            after = parted
        if len(after) == len(groups):
            break
        groups = after
    return sorted((len(g), min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in groups)


def test_sweeps(spark):
    rng = random.Random(6)
    pages = {p: [(x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(-3, 14), y + rng.randint(0, 5)) for _ in range(rng.choice([1, 5, 25]))] for p in range(12)}
    pages[None] = [(0, 0, 1, 1), (0, 0, 1, 1)]
    rows = [(p, *map(float, b), "x") for p, own in pages.items() for b in own] + [(3, None, 1.0, 2.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, stripe string").repartition(4)
    for gap in (0.0, 2.0):
        got = {}
        for r in blocks.merged(df, ["page"], gap).collect():
            got.setdefault(r.page, []).append((r.boxes, r.x0, r.y0, r.x1, r.y1))
        assert {p: sorted(v) for p, v in got.items()} == {p: plain(own, gap) for p, own in pages.items()}
    ordered = blocks.merged(df, ["page"]).where("page = 2").orderBy("block").collect()
    assert [r.block for r in ordered] == list(range(len(ordered))) and [(r.y0, r.x0) for r in ordered] == sorted((r.y0, r.x0) for r in ordered)
    assert blocks.merged(df.where("false"), ["page"]).count() == 0


def test_texts_and_sizes(spark):
    rows = [(1, 0, 0, 1, "b", 8.0, 5.0, 5.0, 9.0, 6.0), (1, 0, 0, 0, " a", None, 1.0, 5.0, 4.0, 7.0), (1, 0, 1, 0, None, 12.5, 0.0, 8.0, 3.0, 9.0), (1, 1, 0, 0, "x", 3.0, 0.0, 0.0, 1.0, 1.0), (1, 2, 0, 0, "pic", 99.0, 0.0, 0.0, 1.0, 1.0)]
    kinds = [0, 0, 0, 0, 1]
    df = spark.createDataFrame([(*r, k) for r, k in zip(rows, kinds, strict=True)], "page int, b int, line int, span int, text string, size double, x0 double, y0 double, x1 double, y1 double, kind int")
    got = [tuple(r) for r in blocks.summed(blocks.text_only(df), ["page", "b"], ["line", "span"]).orderBy("b").collect()]
    assert got == [(1, 0, "a b", 12.5, 3, 0.0, 5.0, 9.0, 9.0), (1, 1, "x", 9.0, 1, 0.0, 0.0, 1.0, 1.0)]
