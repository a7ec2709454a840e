"""Symbols of one file of a language with braces, read token by token with a stack of what each brace opened.

A helper for tasks: one pass over the tokens of a file, in time linear in its
length.  Comments and strings are tokens of their own, so what stands in them is
neither a call nor a brace; text that is no program gives few symbols or none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from corpuslab.operators.declarators import declared

_TOKEN = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|[^`\\])*+`?)"
    r"|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>&&|\|\||=>|:=|::|->|==|[^\w\s])",
    re.DOTALL,
)
_DIRECTIVE, _SPACE = re.compile(r"(?P<directive>#(?:\\\n|[^\n])*)"), re.compile(r"\s*+")

#: Text of a template up to a substitution or its end, and a regular expression as it stands in a program.
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*+", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*")

# The reserved words of each language (names that are neither functions, calls nor variables).
RESERVED = {
    "c": frozenset(
        "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof "
        "static struct switch typedef union unsigned void volatile while".split()
    ),
    "js": frozenset(
        "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return "
        "super switch this throw try typeof var void while with yield".split()
    ),
    "other": frozenset(
        "break case catch class const continue def default defer do else enum extends final finally fn for func function go if impl import in interface let loop match mod "
        "mut namespace new package private protected pub public return select static struct switch throw throws trait try type use using var void while".split()
    ),
}
# What adds a path through a function, what opens a block of which kind, and risky functions.
_BRANCHES = frozenset("if while for switch case catch && ||".split())
_BLOCKS = {"if": "branch", "else": "branch", "try": "branch", "catch": "branch", "for": "loop", "while": "loop", "do": "loop", "switch": "switch", "return": "exit", "throw": "exit"}
_TYPES = {"c": frozenset("struct union enum class".split()), "js": frozenset("class interface".split()), "other": frozenset("class struct enum interface trait".split())}
_DECLARING = {"c": frozenset(), "js": frozenset(("function",)), "other": frozenset("func fn def function".split())}
_RISKY = frozenset("gets strcpy strcat sprintf scanf".split())
_FORMATTED = {"printf": 0, "fprintf": 1, "sprintf": 1, "snprintf": 2, "syslog": 1}
_ENDING = frozenset("break return goto continue throw".split())
TODO = re.compile(r"\b(?:TODO|FIXME|HACK|XXX)\b", re.IGNORECASE)
_INCLUDE = re.compile(r"#\s*include\s+[<\"]([^>\"]+)")
_REQUIRED = re.compile(r"\(\s*['\"]([^'\"]+)")
_CONDITION = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")
_DEFINE = re.compile(r"#\s*define\s+(\w+)")


class _Scope:
    """What a brace opened: a function, a type, a block or something else."""

    def __init__(self, kind: str, row: dict | None = None):
        self.kind, self.row, self.calls, self.case, self.last, self.depth = kind, row, set(), None, "", 0
        self.head: list[tuple[str, str, int]] = []  # what stood before the brace
        self.closed = False


class File:
    def __init__(self, source: str, lang: str):
        self.source, self.lang, self.reserved, self.lines, self.place = source, lang, RESERVED[lang], source.split("\n"), 0
        self.scopes: list[_Scope] = []
        self.own: list[_Scope] = []  # the functions among them
        self.head: list[tuple[str, str, int]] = []  # tokens of the statement so far: (kind, text, line)
        self.parens = 0
        self.rows: list[dict] = []
        self.templates: list[int] = []  # braces open in each substitution around
        self.body: _Scope | None = None  # the type whose body has just ended
        self.old_style: list[tuple[str, str, int]] = []  # a head whose parameters are declared behind it
        self.groups: list[list] = []  # conditional groups of the preprocessor: the state before each, and behind its first branch

    def _tokens(self) -> Iterator[tuple[str, str, int]]:
        """(kind, text, place); a slash and a backtick mean what the tokens before them let them mean."""
        source, scripted, before = self.source, self.lang == "js", ("", "")
        at = _SPACE.match(source, 0).end()
        while at < len(source):
            sign = source[at]
            if scripted and (sign == "`" or (sign == "}" and self.templates and not self.templates[-1])):
                if sign == "}":
                    self.templates.pop()
                    yield "sign", ")", at
                at, before = yield from self._template(at + 1)
            elif scripted and sign == "/" and self._may_begin(before) and (m := _REGEX.match(source, at)):
                yield "string", "//", at
                at, before = m.end(), ("string", "")
            else:
                m = (sign == "#" and not source[source.rfind("\n", 0, at) + 1 : at].strip() and _DIRECTIVE.match(source, at)) or _TOKEN.match(source, at)
                if m:
                    kind, text = m.lastgroup, m[0]
                    if self.templates and text in ("{", "}"):
                        self.templates[-1] += 1 if text == "{" else -1
                    yield kind, text, at
                    before = before if kind == "comment" else (kind, text)
                at = m.end() if m else at + 1
            at = _SPACE.match(source, at).end()

    def _template(self, at: int) -> Iterator[tuple[str, str, int]]:
        """The text of a template from a place on; returns what comes behind it, and that it was."""
        stop = _TEMPLATE.match(self.source, at).end()
        yield "string", f"`{self.source[at:stop]}`", at
        if self.source.startswith("${", stop):
            self.templates.append(0)
            yield "sign", "(", stop
            return stop + 2, ("sign", "(")
        return stop + 1, ("string", "")

    def _may_begin(self, before: tuple[str, str]) -> bool:
        """Whether an expression may begin behind a token."""
        kind, text = before
        return kind in ("", "directive") or (kind == "name" and text in self.reserved and text not in ("this", "super")) or (kind == "sign" and text not in (")", "]", "}"))

    def symbols(self) -> Iterator[dict]:
        line, at = 1, 0
        for kind, text, start in self._tokens():
            line += self.source.count("\n", at, start)
            at = self.place = start
            if kind == "comment":
                self._todo(text, line)
            elif kind == "directive":
                self._directive(text, line)
            elif text == "{":
                self._open(line)
            elif text == "}":
                self._end_statement(line)
                self._close(line)
            elif text == ";" and not self.parens:
                self._end_statement(line)
            else:
                self._token(kind, text, line)
        self._end_statement(line)
        while self.scopes:
            self._close(line)
        yield from self.rows

    def _add(self, kind: str, name: str, line: int, **more) -> dict:
        self.rows.append({"kind": kind, "name": name, "line": line, **more})
        return self.rows[-1]

    def _todo(self, text: str, line: int) -> None:
        for k, part in enumerate(text.split("\n")):
            if TODO.search(part):
                self._add("issue", "todo_comment", line + k, severity="low", message=self.lines[line + k - 1].strip())

    def _branch(self, word: str) -> None:
        """Braces count in the first branch of a group; the others begin where it began, and behind the group goes on what the first one left."""
        state = lambda: (list(self.scopes), list(self.own), list(self.head), self.parens)
        if word.startswith("if"):
            self.groups.append([state(), None])
        elif self.groups and word.startswith(("el", "endif")):
            begun, first = self.groups[-1]
            if first is None:
                self.groups[-1][1] = first = state()
            if word == "endif":
                self.groups.pop()
            scopes, own, head, self.parens = first if word == "endif" else begun
            self.scopes, self.own, self.head = list(scopes), list(own), list(head)

    def _directive(self, text: str, line: int) -> None:
        if self.lang == "c" and (m := _CONDITION.match(text)):
            self._branch(m[1])
        if self.lang == "c" and (m := _INCLUDE.search(text)):
            self._add("import", re.sub(r"\.h$", "", m[1].split("/")[-1]), line, module=m[1], how="include")
        elif self.lang == "c" and (m := _DEFINE.search(text)):
            self._add("macro", m[1], line)
        elif self.lang == "other":
            self._todo(text, line)

    def _token(self, kind: str, text: str, line: int) -> None:
        if text in _BRANCHES:
            for f in self.own:
                f.row["cyclomatic"] += 1
        if text == "(":
            self._call(line)
            self.parens += 1
        elif text == ")":
            self.parens = max(0, self.parens - 1)
        if kind == "name" and text in ("return", "throw") and self.own:
            self._block(text, line)
        if self.lang == "c" and text in ("case", "default") and self.scopes:
            self._label(line)
        if kind == "string" and self.head and self.head[-1][1] in ("import", "from") and self.lang != "c":
            self._import(text, line)
        elif kind == "string" and self.lang == "other" and any(t == "import" for _, t, _ in self.head[:1]):
            self._import(text, line)
        if text == "," and not self.parens and self.scopes and self.scopes[-1].kind == "object":
            self._end_statement(line)
            return
        self.head.append((kind, text, line))
        if self.lang != "c" and len(self.head) > 1 and self.head[-2][2] < line and not self.parens:
            self._line_ends()

    def _line_ends(self) -> None:
        """A statement may end with its line where semicolons are optional: what began on the line before is one, unless it goes on."""
        *before, last = self.head
        if before[-1][0] in ("name", "number", "string") or before[-1][1] in ")]":
            if last[0] in ("name", "string") or last[1] in "@":
                self.head = before
                self._end_statement(before[-1][2])
                self.head = [last]

    def _call(self, line: int) -> None:
        if not self.head or self.head[-1][0] != "name":
            return
        name = self.head[-1][1]
        if name in self.reserved or len(name) < 2:
            return
        before = self.head[-2][1] if len(self.head) > 1 else ""
        if before in _DECLARING[self.lang] or (before == "*" and len(self.head) > 2 and self.head[-3][1] == "function"):
            return
        if not self.own and self.lang == "c":
            return  # a declaration, or the head of a definition
        if name == "require" and self.lang == "js":
            if rest := _REQUIRED.match(self.source, self.place):
                self._add("import", re.sub(r"\.(?:js|ts)$", "", rest[1].split("/")[-1]), line, module=rest[1], how="require")
        self.head[-1] = ("call", name, line)
        for f in self.own:
            f.calls.add((name, line))

    def _import(self, text: str, line: int) -> None:
        module = text.strip("'\"`")
        if module:
            self._add("import", re.sub(r"\.(?:js|ts)$", "", module.split("/")[-1]), line, module=module, how="import")

    def _defined(self) -> int | None:
        """Which token names the function that the statement so far is the head of."""
        words = [t for _, t, _ in self.head]
        literal = bool(self.scopes) and self.scopes[-1].kind == "object"
        if self.lang == "c":
            if self.own:
                return None
            found = declared(self.head, self.reserved)
            if found:
                return found[0].at if found[0].function else None
        if literal and ":" in words[:2] and ("=>" in words or "function" in words):
            return 0 if self.head[0][0] in ("name", "call") else None
        if _DECLARING[self.lang] & set(words):
            k = next(i for i, t in enumerate(words) if t in _DECLARING[self.lang]) + 1
            if self.lang == "other" and k < len(words) and words[k] == "(":  # a receiver stands first
                k = words.index(")", k) + 1 if ")" in words[k:] else k
            while k < len(words) and words[k] == "*":
                k += 1
            if k < len(words) and self.head[k][0] in ("name", "call"):
                return k
        if self.lang == "js" and ("=>" in words or "function" in words) and "=" in words:
            k = words.index("=") - 1
            return k if k >= 0 and self.head[k][0] == "name" else None
        if "=" in words or "(" not in words or (self.lang == "js" and not (self.scopes and self.scopes[-1].kind in ("type", "object"))) or (literal and ":" in words[: words.index("(")]):
            return None
        k = words.index("(") - 1
        if k < 0 or self.head[k][0] not in ("name", "call") or words[k] in self.reserved:
            return None
        if self.lang != "js" and (self.own or k == 0):
            return None  # within another function, or no type before the name
        return k

    def _open(self, line: int) -> None:
        self.head, self.old_style, self.body = [*self.old_style, *self.head], [], None
        words = [t for _, t, _ in self.head]
        for f in self.own:
            f.row["max_nesting"] = max(f.row["max_nesting"], len(self.scopes) + 1 - f.depth)
        types = [i for i, t in enumerate(words) if t in _TYPES[self.lang]]
        k = None if (self.parens and not {"=>", "function"} & set(words)) or words[:1] == ["else"] else self._defined()
        if k is None:
            self._top_calls(self.head)
        self._formats(self.head)
        if k is not None:
            name, begin = words[k], self.head[0][2]
            for f in self.own:  # its own name is no call of those around it
                f.calls.discard((name, self.head[k][2]))
            row = self._add("function", name, begin, lines=1, cyclomatic=1, max_nesting=1)
            row["returns"] = "void" not in words[:k] or "*" in words[:k]
            scope = _Scope("function", row)
            scope.depth = len(self.scopes)
        elif types and "=" not in words and "(" not in words:
            k = types[0] + 1
            row = {"kind": "type", "name": "", "line": self.head[0][2], "how": words[types[0]] if self.lang == "c" else "class", "bases": [], "members": []}
            if k < len(words) and self.head[k][0] == "name":
                row["name"] = words[k]
                row["bases"] = [t for x, t, _ in self.head[k + 1 :] if x == "name" and t not in self.reserved] if "extends" in words or ":" in words else []
                self.rows.append(row)
            scope = _Scope("type", row)
        else:
            block = next((t for t in words if t in _BLOCKS), None)
            if block:
                self._block(block, self.head[0][2])
            value = self.lang == "js" and not block and words and words[-1] in ("=", "(", ",", ":", "[", "?", "return", "default")
            scope = _Scope("switch" if block == "switch" else "object" if value or words[-1:] == ["return"] and self.lang == "js" else "block" if block else "other")
            if "=" in words and self.lang != "other":
                self._variable(self.head, words)
        if self.scopes and self.scopes[-1].kind == "type" and scope.kind == "function" and self.scopes[-1].row:
            self.scopes[-1].row["members"].append(scope.row["name"])
        scope.head = self.head
        self.scopes.append(scope)
        if scope.kind == "function":
            self.own.append(scope)
        self.head, self.parens = [], 0

    def _block(self, word: str, line: int) -> None:
        if self.own:
            depth = sum(s.kind in ("block", "switch") for s in self.scopes[self.own[-1].depth :]) + 1
            self._add("block", self.own[-1].row["name"], line, how=_BLOCKS[word], max_nesting=depth)

    def _label(self, line: int) -> None:
        scope = next((s for s in reversed(self.scopes) if s.kind == "switch"), None)
        if scope is self.scopes[-1] and not self.parens and not self.head:
            self._falls(scope)
            scope.case, scope.last = line, ""

    def _falls(self, scope: _Scope) -> None:
        if scope.case and scope.last and scope.last not in _ENDING:
            name = self.own[-1].row["name"] if self.own else ""
            self._add("issue", "switch_fallthrough", scope.case, severity="medium", message=f"{name} falls through")

    def _end_statement(self, line: int) -> None:
        head, self.head, self.parens = self.head, [], 0
        body, self.body = self.body, None
        if not head:
            return
        words = [t for _, t, _ in head]
        if self.lang == "c" and self._declaration(head, words, body, line):
            return
        if self.scopes:
            plain = words[words.index(":") + 1 :] if words[0] in ("case", "default") and ":" in words else words
            if plain:
                self.scopes[-1].last = plain[0]
        if self.lang == "js" and "=>" in words and words[0] in ("export", "const", "let", "var") and "=" in words:
            k = words.index("=") - 1
            inner = sorted({t for x, t, _ in head if x == "call"})
            self._add("function", words[k], head[0][2], lines=line - head[0][2] + 1, cyclomatic=1 + sum(t in _BRANCHES for t in words), max_nesting=0, calls=inner)
            self.rows += [{"kind": "call", "name": t, "line": n} for x, t, n in head if x == "call"]
            return
        self._top_calls(head)
        self._formats(head)
        self._variable(head, words)
        if self.lang == "other" and words[0] in ("use", "import", "from", "using") and len(head) > 1 and head[1][0] == "name":
            module = "".join(t for x, t, _ in head[1:] if x == "name" or t in (".", "::", "/", ":"))
            self._add("import", re.split(r"[.:/]", module)[-1], head[0][2], module=module, how="import")

    def _declaration(self, head: list[tuple[str, str, int]], words: list[str], body: _Scope | None, line: int) -> bool:
        """Members, typedefs, names behind the body of a type, and heads of functions whose parameters are declared behind them; whether it was one of these."""
        if body is not None and body.kind == "type":
            before = [t for _, t, _ in body.head]
            names = declared(head, self.reserved, " ".join(x for x in (body.row["how"], body.row["name"]) if x))
            if self.scopes and self.scopes[-1].kind == "type":
                self.scopes[-1].row["members"] += [f"{x.name}: {x.type}" for x in names]
            elif "typedef" in before:
                if names and not body.row["name"]:
                    body.row["name"] = names[0].name
                    self.rows.append(body.row)
            elif not any(s.kind != "other" for s in self.scopes):
                for x in names:
                    self._add("variable", x.name, head[0][2], how="global")
            return True
        if words[0] == "typedef":
            for x in declared(head, self.reserved):
                self._add("type", x.name, head[0][2], how="typedef", bases=[x.type], members=[])
            return True
        if self.scopes and self.scopes[-1].kind == "type" and self.scopes[-1].row["how"] == "enum":
            depth, item = 0, []
            for _, t, _ in [*head, ("sign", ",", line)]:
                depth += (t in "([") - (t in ")]")
                if t == "," and not depth:
                    if item:
                        self.scopes[-1].row["members"].append(item[0] + (": " + "".join(item[2:]) if item[1:2] == ["="] else ""))
                    item = []
                else:
                    item.append(t)
            return True
        if self.scopes and self.scopes[-1].kind == "type":
            names = declared(head, self.reserved)
            self.scopes[-1].row["members"] += [f"{x.name}: {x.type}" for x in names if not x.function]
            return bool(names)
        if self.old_style:
            if "(" not in words and "=" not in words and declared(head, self.reserved):
                self.old_style += head
                return True
            self.old_style = []
        if not self.scopes and "=" not in words:
            names = declared(head, self.reserved)
            if len(names) == 1 and names[0].function and names[0].after < len(head) and declared(head[names[0].after :], self.reserved):
                self.old_style = head
                return True
        return False

    def _top_calls(self, head: list[tuple[str, str, int]]) -> None:
        """Calls outside functions; those inside are given when their function ends."""
        if not self.own:
            self.rows += [{"kind": "call", "name": t, "line": n} for x, t, n in head if x == "call"]
            if self.lang == "js":
                self.rows += [{"kind": "issue", "name": "eval_usage", "line": n, "severity": "high", "message": t} for x, t, n in head if x == "call" and t == "eval"]

    def _formats(self, head: list[tuple[str, str, int]]) -> None:
        """Calls of the printf family whose format is not a string."""
        if self.lang != "c":
            return
        for k, (kind, name, line) in enumerate(head):
            if kind != "call":
                continue
            if name in _RISKY:
                self._add("issue", "dangerous_function", line, severity="high", message=name)
            if name in _FORMATTED:
                argument, depth = 0, 0
                for x, t, _ in head[k + 1 :]:
                    if t == "," and depth == 1:
                        argument += 1
                    elif depth == 1 and argument == _FORMATTED[name]:
                        if x != "string":
                            self._add("issue", "format_string", line, severity="high", message=name)
                        break
                    depth += (t == "(") - (t == ")")
                    if depth == 0:
                        break

    def _variable(self, head: list[tuple[str, str, int]], words: list[str]) -> None:
        if self.lang == "c":
            if not any(s.kind != "other" for s in self.scopes) and words[0] not in ("return", "using"):
                names = [x.name for x in declared(head, self.reserved) if not x.function]
                if not names and "=" in words[2:] and "(" not in words[: words.index("=")]:
                    names = [words[words.index("=") - 1]]  # what is set has a name, even if it is a reserved word
                for x in names:
                    self._add("variable", x, head[0][2], how="global")
            return
        for i, t in enumerate(words[:-1]):
            if t in ("const", "let", "var") and head[i + 1][0] == "name" and not {"=>", "function"} & set(words[i + 2 :]):
                self._add("variable", words[i + 1], head[i][2], how="global")
        if self.lang == "other" and ":=" in words and head[0][0] == "name":
            self._add("variable", words[0], head[0][2], how="global")

    def _close(self, line: int) -> None:
        if not self.scopes:
            return
        scope = self.scopes.pop()
        if scope.kind == "type":
            self.body = scope
        if scope.closed:
            if scope.kind == "function":
                self.own = [s for s in self.own if s is not scope]
            return
        scope.closed = True
        if scope.kind == "switch":
            self._falls(scope)
        if self.scopes:
            self.scopes[-1].last = "}"
        if scope.kind != "function":
            return
        self.own.pop()
        row, name = scope.row, scope.row["name"]
        row["lines"] = line - row["line"] + 1
        row["calls"] = sorted({c for c, _ in scope.calls})
        if not self.own:
            self.rows += [{"kind": "call", "name": c, "line": n} for c, n in sorted(scope.calls)]
        own = [n for c, n in scope.calls if c == name]
        if own:
            self._add("issue", "recursion", min(own), severity="medium", message=f"{name} calls itself")
        if self.lang == "js":
            for c, n in sorted(scope.calls):
                if c == "eval" and not self.own:
                    self._add("issue", "eval_usage", n, severity="high", message=c)
        if row.pop("returns") and self.lang == "c" and scope.last and scope.last != "return":
            self._add("issue", "missing_return", line, severity="medium", message=f"{name} may end without a value")


def symbols(source: str, lang: str) -> Iterator[dict]:
    """Symbols of one file; of functions with one name the first counts."""
    seen: set[str] = set()
    for row in File(source, lang).symbols():
        row.pop("returns", None)
        if row["kind"] == "function":
            if row["name"] in seen:
                continue
            seen.add(row["name"])
        yield row
