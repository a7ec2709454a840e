"""Trees against a walk over nested dictionaries."""

import random

from corpuslab.operators import tree


def walk(files, most):
    root = {}
    for path, size in files:
        parts = [p for p in (path or "").replace("\\", "/").split("/") if p not in ("", ".")]
        here = root
        for p in parts[:-1]:
            here = here.setdefault((0, p), {})
        if parts:
            here[1, parts[-1]] = here.get((1, parts[-1]), 0) + (size or 0)
    out = []

    def draw(here, prefix, depth):
        if depth >= most:
            out.append(prefix + "... (省略)")
            return
        for k, (kind, name) in enumerate(order := sorted(here)):
            last = k == len(order) - 1
            below = here[kind, name]
            out.append(prefix + ("└── " if last else "├── ") + (f"{name}/" if kind == 0 else f"{name} ({below:,}B)"))
            if kind == 0:
                draw(below, prefix + ("    " if last else "│   "), depth + 1)

    draw(root, "", 0)
    return out


def test_drawn_as_walked(spark):
    rng = random.Random(2)
    files = [("/".join(rng.choice(["a", "b", "a b", "a-b", "Ä", "z.py"]) for _ in range(rng.randint(1, 8))), rng.randint(0, 5_000_000)) for _ in range(120)]
    files += [("a", 5), ("a/b", None), ("a//b", 3), ("./x\\y", 1), ("", 1), (None, 1)]
    df = spark.createDataFrame(files, "path string, length long").repartition(4)
    found = tree.entries(df)
    for most in (1, 3, 5, 20):
        assert [r.line for r in tree.draw(found, most).orderBy("key").collect()] == walk(files, most)


def test_totals(spark):
    rows = [("src/a.py", 10, 1), ("src/lib/b.py", 20, 2), ("src/lib/deep/c.py", 30, 3), ("doc/x.md", 40, None), ("top.txt", 50, 5)]
    found = tree.entries(spark.createDataFrame(rows, "path string, length long, n int"), lines="n")
    got = {r.path: (r.folder, r.files, r.folders, r.bytes, r.lines, r.parent, r.depth) for r in found.collect()}
    assert got["src"] == (True, 3, 2, 60, 6, "", 1) and got["src/lib"] == (True, 2, 1, 50, 5, "src", 2) and got["doc"] == (True, 1, 0, 40, 0, "", 1)
    assert got["top.txt"] == (False, 1, 0, 50, 5, "", 1) and len(got) == 9
    assert tuple(tree.totals(found).head()) == (5, 4, 150, 11)
    empty = tree.entries(spark.createDataFrame([], "path string, length long"))
    assert tuple(tree.totals(empty).head()) == (0, 0, 0, 0) and tree.draw(empty).count() == 0
