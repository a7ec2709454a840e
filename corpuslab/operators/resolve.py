"""Which file the function lies in that a call names, by what the calling file imports.

An import names a module; what file that is follows from the languages' own rules,
as equality with a few candidate paths: next to the importing file and in every
folder above it, the nearest first.  Names that are imported one by one may be
passed on by the files that import them; names of included files and of star
imports are seen through further includes.  Both are followed until nothing new
is found, whatever the length of the chain and whether it runs in circles.

A call then means, in this order: a function of its own file, an imported name, a
function of a file that is included, one of an imported module, and, where no
import tells, the only function of that name in all files.  Calls of other
names stay without a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.tables import kept

# What a module's name becomes as a path, by language.
_PYTHON = ("%s.py", "%s/__init__.py")
_SCRIPT = ("%s", "%s.js", "%s.ts", "%s.jsx", "%s.tsx", "%s/index.js", "%s/index.ts")
_HEADERS = ("%s", "include/%s", "inc/%s", "src/%s")


def _folder(path: Column) -> Column:
    """The folders of a path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _joined(folders: Column, rest: Column) -> Column:
    """One path, without . and .. where these can be taken out."""
    step = lambda out, x: F.when((x == "") | (x == "."), out).when((x == "..") & (F.size(out) > 0), F.slice(out, 1, F.size(out) - 1)).otherwise(F.array_append(out, x))
    return F.array_join(F.aggregate(F.concat(folders, F.split(rest, "/")), F.array().cast("array<string>"), step), "/")


def _above(folders: Column) -> Column:
    """The folders, and those above them up to the root."""
    return F.transform(F.sequence(F.size(folders), F.lit(0), F.lit(-1)), lambda n: F.slice(folders, F.lit(1), n))


def _candidates() -> Column:
    """Paths that an import may mean, the likeliest first."""
    folders, module, level = _folder(F.col("path")), F.coalesce("module", F.lit("")), F.coalesce("level", F.lit(0))
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    places = lambda roots, tails, name: F.flatten(F.transform(roots, lambda root: F.array(*[_joined(root, F.format_string(t, name)) for t in tails])))
    up = F.array(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - level + 1, F.lit(0))))
    package = F.when(module == "", F.lit("__init__")).otherwise(dotted)
    python = places(F.when(level > 0, up).otherwise(_above(folders)), _PYTHON, package)
    script = F.when(F.startswith(module, F.lit(".")), places(F.array(folders), _SCRIPT, module)).otherwise(F.array().cast("array<string>"))
    body = F.regexp_replace(module, r"\.(h|hpp|hh)$", ".c")
    headers = F.concat(places(_above(folders), _HEADERS, module), places(_above(folders), _HEADERS, body))
    return F.when(F.col("lang") == "py", python).when(F.col("lang") == "js", script).when(F.col("lang") == "c", headers).otherwise(F.array().cast("array<string>"))


def module_files(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, module, level, target): the files that imports mean; an include means the header and the file of its functions."""
    asked = found.where("kind = 'import'").select("path", "lang", "module", "level").distinct()
    each = asked.select("*", F.posexplode(_candidates()).alias("rank", "target"))
    known = each.join(paths.select(F.col("path").alias("target")).distinct(), "target")
    kind = F.when(F.col("lang") == "c", F.regexp_extract("target", r"\.([^./]*)$", 1)).otherwise("")
    first = F.row_number().over(Window.partitionBy("path", "lang", "module", "level", "_kind").orderBy("rank"))
    return known.withColumn("_kind", kind).withColumn("_n", first).where("_n = 1").select("path", "module", "level", "target")


def _closure(edges: DataFrame) -> DataFrame:
    """(path, target): the files seen from each over any number of edges."""
    edges = edges.select("path", "target").where("path <> target").distinct()
    seen = front = kept(edges, "seen")
    while front.head(1):
        after = front.select("path", F.col("target").alias("via")).join(edges.select(F.col("path").alias("via"), "target"), "via").select("path", "target").where("path <> target").distinct()
        front = kept(after.join(seen, ["path", "target"], "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def exports(found: DataFrame, links: DataFrame) -> DataFrame:
    """(path, name, def_path, def_name): the functions that a file has or has imported by name, also from files that have imported them."""
    own = found.where("kind = 'function'").select("path", "name").distinct()
    seen = front = kept(own.select("path", "name", F.col("path").alias("def_path"), F.col("name").alias("def_name")), "exports")
    named = found.where("kind = 'import' and how = 'from_import' and name <> '*'").join(links, [found["path"] == links["path"], found["module"] == links["module"], found["level"].eqNullSafe(links["level"])])
    named = kept(named.select(found["path"], F.coalesce(F.nullif("alias", F.lit("")), found["name"]).alias("local"), links["target"], found["name"].alias("of")).distinct(), "named")
    while front.head(1):
        given = front.select(F.col("path").alias("target"), F.col("name").alias("of"), "def_path", "def_name")
        after = named.join(given, ["target", "of"]).select("path", F.col("local").alias("name"), "def_path", "def_name").distinct()
        front = kept(after.join(seen, after.columns, "left_anti"), "exports")
        seen = seen.unionByName(front)
    return seen


def resolve_calls(found: DataFrame) -> DataFrame:
    """(path, caller, callee, line, callee_path, callee_name, how): how is local, name, include, module, only or, without a path, null."""
    paths = found.select("path").distinct()
    links = kept(module_files(found, paths), "links")
    known = kept(exports(found, links), "known")
    calls = kept(found.where("kind = 'function'").select("path", F.col("name").alias("caller"), "line", F.explode("calls").alias("callee")), "calls")
    asked = calls.select("path", "callee").distinct()
    imports = found.where("kind = 'import'").select("path", "module", "level", "how", "name")
    to = imports.join(links, [imports["path"] == links["path"], imports["module"] == links["module"], imports["level"].eqNullSafe(links["level"])])
    to = kept(to.select(imports["path"], links["target"], ((F.col("how") == "include") | (F.col("name") == "*")).alias("through")).distinct(), "to")
    own = known.where("path = def_path and name = def_name")
    defined = own.select(F.col("path").alias("target"), F.col("name").alias("callee")).distinct()
    ranked = lambda df, rank, path, name: df.select("path", "callee", F.lit(rank).alias("rank"), path.alias("callee_path"), name.alias("callee_name"))
    here = asked.join(known.withColumnRenamed("name", "callee"), ["path", "callee"])
    rank = F.when((F.col("def_path") == F.col("path")) & (F.col("def_name") == F.col("callee")), 0).otherwise(1)
    options = here.select("path", "callee", rank.alias("rank"), F.col("def_path").alias("callee_path"), F.col("def_name").alias("callee_name"))
    given = known.select(F.col("path").alias("target"), F.col("name").alias("callee"), "def_path", "def_name")
    modules = to.where("not through").select("path", "target").distinct()
    options = options.unionByName(ranked(asked.join(modules, "path").join(given, ["target", "callee"]), 3, F.col("def_path"), F.col("def_name")))
    seen = _closure(to.where("through"))
    options = options.unionByName(ranked(asked.join(seen, "path").join(given, ["target", "callee"]), 2, F.col("def_path"), F.col("def_name")))
    only = defined.groupBy("callee").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1")
    options = options.unionByName(ranked(asked.join(only, "callee"), 4, F.col("target"), F.col("callee")))
    best = options.groupBy("path", "callee").agg(F.min(F.struct("rank", "callee_path", "callee_name")).alias("b"))
    how = F.when(F.col("b.rank") == 0, "local").when(F.col("b.rank") == 1, "name").when(F.col("b.rank") == 2, "include").when(F.col("b.rank") == 3, "module").when(F.col("b.rank") == 4, "only")
    return calls.join(best, ["path", "callee"], "left").select("path", "caller", "callee", "line", "b.callee_path", "b.callee_name", how.alias("how"))
