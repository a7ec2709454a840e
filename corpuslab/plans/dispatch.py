"""Operations by name: what a caller of the workbench asks for, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import batching, blocks, code, conversation, corpus, coverage, markdown_blocks, notes, prompt, resolve, tree
from corpuslab.plans.access import Permission
from corpuslab.sources import readers
from corpuslab.streaming import reframe

#: name -> (function, permission it needs, what it does)
OPERATIONS: dict[str, tuple[Callable[..., DataFrame], Permission, str]] = {
    "list": (corpus.listing, Permission.READ, "documents and their first lines"),
    "search": (lambda docs, query, k=10: corpus.search(corpus.listing(docs), query, k=k), Permission.READ, "best documents for the words of a query"),
    "read": (corpus.read, Permission.READ, "one document"),
    "grep": (lambda docs, pattern, context=3, page=1: corpus.page_of(corpus.grep(docs, pattern, context), page), Permission.READ, "matches with context, a page of documents at a time"),
    "stats": (corpus.scope_stats, Permission.READ, "documents, lines and bytes by scope"),
    "coverage": (coverage.share, Permission.READ, "pages covered and their share"),
    "uncovered": (coverage.gaps, Permission.READ, "page ranges that are not covered"),
    "symbols": (code.symbols, Permission.READ, "symbols of source files"),
    "call_graph": (code.call_edges, Permission.READ, "callers and callees"),
    "called_by": (code.called_by, Permission.READ, "callers by callee"),
    "dependency_graph": (code.dependencies, Permission.READ, "imports of files"),
    "dependency_map": (code.mermaid, Permission.READ, "imports as the lines of a graph"),
    "complexity": (code.complexity, Permission.READ, "paths and depth of functions"),
    "dead_code": (code.unused_functions, Permission.READ, "functions that nothing calls"),
    "unused_imports": (code.unused_imports, Permission.READ, "imports that no call uses"),
    "symbol_table": (code.symbol_table, Permission.READ, "functions and variables"),
    "type_info": (code.types, Permission.READ, "types and their members"),
    "issues": (code.issues, Permission.READ, "findings with their severity"),
    "data_flow": (code.data_flow, Permission.READ, "definitions and assignments"),
    "control_flow": (code.control_flow, Permission.READ, "branches, loops and exits of functions"),
    "skeleton": (code.skeleton, Permission.READ, "lines that define functions and types"),
    "read_symbol": (code.read_symbol, Permission.READ, "source of the functions of a name"),
    "call_edges": (code.call_graph, Permission.READ, "calls with the files of the functions they name"),
    "dependency_json": (code.dependency_json, Permission.READ, "imports of files as JSON"),
    "everything": (code.everything, Permission.READ, "all analyses in one relation"),
    "metrics": (code.metrics, Permission.READ, "files, lines and functions by language"),
    "usage": (conversation.usage, Permission.READ, "tokens of conversations"),
    "compact": (conversation.compact, Permission.READ, "conversations brought under the limit"),
    "rebuild": (conversation.rebuild, Permission.READ, "conversations begun anew from a summary"),
    "documents": (readers.read_documents, Permission.READ, "files of a folder as Markdown"),
    "project": (readers.project, Permission.READ, "source files of a folder"),
    "coverage_files": (readers.read_coverage, Permission.READ, "page ranges of coverage files"),
    "tasks": (notes.progress, Permission.READ, "tasks done and in all"),
    "batches": (batching.greedy_batches, Permission.READ, "rows in batches within a budget"),
    "recall": (notes.recall, Permission.READ, "notes"),
    "skeleton_text": (code.skeleton_text, Permission.READ, "heads and docstrings of definitions"),
    "resolve_calls": (resolve.resolve_calls, Permission.READ, "calls with the functions that their imports mean"),
    "tree": (tree.entries, Permission.READ, "files and folders with totals"),
    "draw_tree": (tree.draw, Permission.READ, "files and folders as the lines of a tree"),
    "markdown": (markdown_blocks.classify, Permission.READ, "kinds of the lines of Markdown"),
    "open_contents": (coverage.open_contents, Permission.READ, "headings of pages that are not covered"),
    "prompts": (prompt.assemble, Permission.READ, "prompts under a budget"),
    "messages": (prompt.normalise, Permission.READ, "messages of several dialects made alike"),
    "responses": (prompt.parse_response, Permission.READ, "texts and calls of replies"),
    "blocks": (blocks.merged, Permission.READ, "boxes of pages that belong together"),
    "stream_lines": (reframe.lines, Permission.READ, "lines of streams that were cut anywhere"),
    "chunks": (reframe.transcode, Permission.READ, "lines of streams as chunks of chat completions"),
    "remember": (notes.remember, Permission.WRITE, "a note set"),
    "upsert": (corpus.upsert, Permission.WRITE, "rows replaced by key"),
    "delete": (corpus.delete, Permission.WRITE, "rows removed by key"),
}


def execute(name: str, *args: object, most: Permission = Permission.WRITE, **options: object) -> DataFrame:
    """Runs an operation; KeyError if there is none of that name, PermissionError if it needs more than `most`."""
    function, needs, _ = OPERATIONS[name]
    if needs > most:
        raise PermissionError(f"{name} needs {needs.name}")
    return function(*args, **options)


def describe(spark) -> DataFrame:
    """(name, permission, summary) of all operations."""
    rows = [(n, p.name, s) for n, (_, p, s) in OPERATIONS.items()]
    return spark.createDataFrame(rows, "name string, permission string, summary string").orderBy(F.col("name"))
