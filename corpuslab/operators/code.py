"""Source-code analysis as relations: functions, calls, imports, variables, types and issues of files.

Files are rows (path, lang, source).  Small helpers read one file at a time, Python
with its own grammar, languages with braces token by token, in one pass over the
files; both give one relation of symbols, and every analysis is a join,
aggregate or window over it.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions import text as T
from corpuslab.functions.tables import kept
from corpuslab.operators import braces

SYMBOLS = (
    "path string, lang string, kind string, name string, line long, lines long, cyclomatic long, max_nesting long, "
    "calls array<string>, module string, alias string, how string, members array<string>, bases array<string>, severity string, message string, level long, head long"
)

_KINDS = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SYMBOLS.split(", ")])
#: Symbols that a task gives out at once, about.
ROWS = 20_000

LANGUAGES = ("py", "c", "js", "other")

# The nodes that add a path through a function, that nest, and that are blocks of which kind.
_PATHS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)
_NESTS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try)
_BLOCKS = {ast.If: "branch", ast.Try: "branch", ast.For: "loop", ast.AsyncFor: "loop", ast.While: "loop", ast.Match: "switch", ast.Return: "exit", ast.Raise: "exit"}


class _PythonFile(ast.NodeVisitor):
    """Collects symbols in one walk; what is inside a function counts for all functions around it."""

    def __init__(self):
        self.rows: list[dict] = []
        self.functions: list[dict] = []
        self.types: list[dict] = []

    def add(self, kind: str, name: str, node: ast.AST, **more) -> dict:
        self.rows.append({"kind": kind, "name": name, "line": node.lineno, **more})
        return self.rows[-1]

    def visit(self, node: ast.AST) -> None:
        block = _BLOCKS.get(type(node))
        for f in self.functions:
            f["cyclomatic"] += isinstance(node, _PATHS) + (len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0)
            f["depth"] += isinstance(node, _NESTS)
            f["max_nesting"] = max(f["max_nesting"], f["depth"])
            if block:
                f["block"] += 1
                self.add("block", f["name"], node, how=block, max_nesting=f["block"])
        super().visit(node)
        for f in self.functions:
            f["depth"] -= isinstance(node, _NESTS)
            f["block"] -= bool(block)

    def function(self, node) -> None:
        row = self.add("function", node.name, node, lines=node.end_lineno - node.lineno + 1, cyclomatic=1, max_nesting=0, calls=set(), depth=0, block=0, **_head(node))
        for t in self.types:
            t["members"].append(node.name)
        self.functions.append(row)
        self.generic_visit(node)
        self.functions.pop()
        row["calls"] = sorted(row["calls"])

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [x for x in map(_last_name, node.bases) if x]
        self.types.append(self.add("type", node.name, node, how="class", members=[], bases=bases, **_head(node)))
        self.generic_visit(node)
        self.types.pop()

    def visit_Call(self, node: ast.Call) -> None:
        if name := _last_name(node.func):
            self.add("call", name, node)
            for f in self.functions:
                f["calls"].add(name)
                if isinstance(node.func, ast.Name) and name == f["name"]:
                    self.add("issue", "recursion", node, severity="medium", message=f"{name} calls itself")
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self.add("import", x.name.split(".")[0], node, module=x.name, alias=x.asname, how="import")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self.add("import", x.name, node, module=node.module or "", alias=x.asname, how="from_import", level=node.level)

    def assignment(self, node) -> None:
        for target in getattr(node, "targets", None) or [node.target]:
            if isinstance(target, ast.Name):
                self.add("variable", target.id, node, how="module")
        self.generic_visit(node)

    visit_Assign = visit_AnnAssign = assignment

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.type is None:
            self.add("issue", "bare_except", node, severity="low", message="bare except")
        self.generic_visit(node)


def _head(node: ast.AST) -> dict:
    """How many lines the head of a definition has, and its docstring."""
    return {"head": max(1, node.body[0].lineno - node.lineno), "message": ast.get_docstring(node)}


def _todos(source: str) -> Iterator[dict]:
    """Comments that leave something to do, as the lines they stand in."""
    lines = source.split("\n")
    try:
        for token in tokenize.generate_tokens(io.StringIO(source).readline):
            if token.type == tokenize.COMMENT and braces.TODO.search(token.string):
                yield {"kind": "issue", "name": "todo_comment", "line": token.start[0], "severity": "low", "message": lines[token.start[0] - 1].strip()}
    except (tokenize.TokenError, SyntaxError):
        return


def _last_name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else getattr(node, "attr", None)


def _python(source: str) -> Iterator[dict]:
    """Symbols of one Python file; where it does not parse, an issue that says so, and what its comments leave to do."""
    yield from _todos(source)
    try:
        file = _PythonFile()
        file.visit(ast.parse(source))
    except (SyntaxError, ValueError, RecursionError) as error:
        yield {"kind": "issue", "name": "syntax_error", "line": getattr(error, "lineno", None) or 1, "severity": "high", "message": str(getattr(error, "msg", None) or error)}
        return
    yield from ({k: v for k, v in row.items() if k not in ("depth", "block")} for row in file.rows)


def symbols(files: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """All symbols of all files of some languages, in the columns of SYMBOLS; a file of an unknown language is read as "other"."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _python(source or "") if lang == "py" else braces.symbols(source or "", lang)
                rows += [{"path": path, "lang": lang, **x} for x in found]
                if len(rows) > ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    return files.select("path", lang.alias("lang"), "source").where(F.col("lang").isin(*languages)).mapInArrow(read, SYMBOLS)


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("kind") == kind)


def metrics(files: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, files, code_lines, functions); blank lines and lines that begin with # do not count."""
    code = F.filter(T.lines(F.col("source")), lambda x: (T.strip(x) != "") & ~F.startswith(T.strip(x), F.lit("#")))
    sizes = files.groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.size(code)).alias("code_lines"))
    functions = _of(found, "function").groupBy("lang").agg(F.count("*").alias("functions"))
    return sizes.join(functions, "lang", "left").fillna(0, ["functions"])


def call_edges(found: DataFrame) -> DataFrame:
    """(path, caller, callee)."""
    return _of(found, "function").select("path", F.col("name").alias("caller"), F.explode("calls").alias("callee"))


def called_by(found: DataFrame) -> DataFrame:
    """(callee, callers, n_sites)."""
    return call_edges(found).groupBy("callee").agg(F.countDistinct("path", "caller").alias("callers"), F.count("*").alias("n_sites"))


def dependencies(found: DataFrame) -> DataFrame:
    return _of(found, "import").select("path", "module", "how")


def complexity(found: DataFrame, most: int | None = None) -> DataFrame:
    """(name, path, line, cyclomatic, max_nesting, lines), or the `most` functions with the most paths, in order."""
    rows = _of(found, "function").select("name", "path", "line", "cyclomatic", "max_nesting", "lines")
    return rows if most is None else rows.orderBy(F.desc("cyclomatic"), "path", "line").limit(most)


def unused_functions(found: DataFrame) -> DataFrame:
    """Functions that nothing calls and whose names do not begin with _."""
    names = _of(found, "call").select("name").distinct()
    return _of(found, "function").where(~F.startswith("name", F.lit("_"))).join(names, "name", "left_anti").select("path", "name")


def unused_imports(found: DataFrame) -> DataFrame:
    """Imports whose alias, else name, else module no call of the file bears."""
    used = _of(found, "call").select("path", F.col("name").alias("shown")).distinct()
    shown = F.coalesce(F.nullif("alias", F.lit("")), F.nullif("name", F.lit("")), F.col("module"))
    return _of(found, "import").withColumn("shown", shown).where("shown <> ''").join(used, ["path", "shown"], "left_anti").select("path", "module", F.col("shown").alias("name"))


def symbol_table(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind").isin("function", "variable")).select("name", "kind", F.coalesce("how", F.lit("module")).alias("scope"), "path", "line")


def types(found: DataFrame) -> DataFrame:
    return _of(found, "type").select("path", "name", F.col("how").alias("kind"), "line", "members", "bases")


def issues(found: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return _of(found, "issue").select("path", "severity", F.col("name").alias("type"), "message", "line", rank.alias("rank"))


def data_flow(found: DataFrame) -> DataFrame:
    """(path, name, defined, assigned): the first line that sets a variable and how often it is set again."""
    return _of(found, "variable").groupBy("path", "name").agg(F.min("line").alias("defined"), (F.count("*") - 1).alias("assigned"))


def control_flow(found: DataFrame) -> DataFrame:
    """(path, function, line, type, depth): the blocks of functions, flattened."""
    return _of(found, "block").select("path", F.col("name").alias("function"), "line", F.col("how").alias("type"), F.col("max_nesting").alias("depth"))


def skeleton(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, line, signature): the lines that import, and that define macros, functions and types."""
    marks = found.where(F.col("kind").isin("function", "type", "import", "macro")).select("path", "line").distinct()
    all_lines = files.select("path", T.lines(F.col("source")).alias("all"))
    return marks.join(all_lines, "path").select("path", "line", T.strip(F.get("all", (F.col("line") - 1).cast("int"))).alias("signature"))


def skeleton_text(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, line, text): every definition as its head and docstring, with three dots for its body; imports and macros as they are."""
    marks = found.where(F.col("kind").isin("function", "type", "import", "macro")).groupBy("path", "line").agg(F.min(F.struct("kind", "lang", F.coalesce("head", F.lit(1)).alias("head"), "message")).alias("m"))
    joined = marks.join(files.select("path", T.lines(F.col("source")).alias("all")), "path")
    own = F.array_join(F.slice("all", F.col("line").cast("int"), F.col("m.head").cast("int")), "\n")
    inner = F.concat(F.regexp_extract(own, r"^(\s*)", 1), F.lit("    "))
    quoted = F.concat(inner, F.lit('"""'), F.col("m.message"), F.lit('"""\n'))
    body = F.col("m.kind").isin("function", "type")
    # the head without a body that begins on its line
    python = F.concat(F.when(F.col("m.head") == 1, F.regexp_replace(own, r"^(.*?:)\s*(?:pass|return\b.*|\.\.\.)$", "$1")).otherwise(own), F.lit("\n"), F.coalesce(quoted, F.lit("")), inner, F.lit("..."))
    braced = F.concat(F.regexp_replace(own, r"\s*\{.*$", ""), F.lit(" { ... }"))
    text = F.when(~body, own).when(F.col("m.lang") == "py", python).otherwise(braced)
    return joined.select("path", "line", text.alias("text"))


def read_symbol(files: DataFrame, found: DataFrame, name: str, most: int = 100) -> DataFrame:
    """(path, line, text): the source of each function of a name; an expression without end counts `most` lines."""
    marks = _of(found, "function").where(F.col("name") == name).select("path", "line", "lines")
    all_lines = files.select("path", T.lines(F.col("source")).alias("all"))
    size = F.when(F.col("lines") > 0, F.col("lines")).otherwise(most).cast("int")
    return marks.join(all_lines, "path").select("path", "line", F.array_join(F.slice("all", F.col("line").cast("int"), size), "\n").alias("text"))


def mermaid(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, line) of a graph: an arrow for every dependency, and with `files` a node for each file without any."""
    arrow = F.concat(T.mermaid_id(F.col("path")), F.lit(" -->|"), F.col("how"), F.lit("| "), T.mermaid_id(F.col("module")))
    edges = dependencies(found)
    lines = edges.select("path", arrow.alias("line")).distinct()
    if files is None:
        return lines
    alone = files.select("path").join(edges.select("path").distinct(), "path", "left_anti")
    return lines.unionByName(alone.select("path", T.mermaid_id(F.col("path")).alias("line")))


def dependency_json(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, dependencies): the dependencies of each file as a JSON list in the order of its lines."""
    each = _of(found, "import").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "module", "how"))).alias("d"))
    listed = F.to_json(F.transform(F.coalesce("d", F.expr("cast(array() as array<struct<line:bigint,module:string,how:string>>)")), lambda x: F.struct(x["module"].alias("module"), x["how"].alias("how"))))
    return files.select("path").join(each, "path", "left").select("path", listed.alias("dependencies"))


def reachable(edges: DataFrame, source: str, target: str, start: DataFrame, hops: int) -> DataFrame:
    """(node, hops) reached from `start` within a number of hops; cycles are walked once.

    Each hop is a table, so that the plan stays the same size, and it ends where
    nothing new is reached.
    """
    edges = edges.select(F.col(source).alias("node"), F.col(target).alias("to")).distinct()
    seen = kept(start.toDF("node").distinct().withColumn("hops", F.lit(0)), "reached")
    front = seen
    for k in range(1, hops + 1):
        after = front.join(edges, "node").select(F.col("to").alias("node")).distinct()
        front = kept(after.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)), "reached")
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def call_graph(found: DataFrame) -> DataFrame:
    """(path, caller, callee, line, callee_path): edges between functions; callee_path is where a function of that name is, null if nowhere."""
    names = _of(found, "function").groupBy("name").agg(F.min("path").alias("callee_path")).withColumnRenamed("name", "callee")
    edges = _of(found, "function").select("path", F.col("name").alias("caller"), "line", F.explode("calls").alias("callee"))
    return edges.join(names, "callee", "left").select("path", "caller", "callee", "line", "callee_path")


def everything(files: DataFrame, found: DataFrame) -> DataFrame:
    """(analysis, path, detail): all analyses in one relation, their rows as JSON; path is null where an analysis has none."""
    parts = {
        "metrics": metrics(files, found), "call_graph": call_graph(found), "dependency_graph": dependencies(found), "complexity": complexity(found),
        "dead_functions": unused_functions(found), "dead_imports": unused_imports(found), "symbol_table": symbol_table(found), "type_info": types(found),
        "issues": issues(found), "data_flow": data_flow(found), "control_flow": control_flow(found), "skeleton": skeleton(files, found),
    }
    out = None
    for name, rows in parts.items():
        path = F.col("path") if "path" in rows.columns else F.lit(None).cast("string")
        rows = rows.select(F.lit(name).alias("analysis"), path.alias("path"), F.to_json(F.struct(*rows.columns)).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out
