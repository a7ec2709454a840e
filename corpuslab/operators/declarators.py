"""What a C declaration declares: names, whether each is a function, and their types.

A declarator is read from its name outwards, so `int (*get(void))(int)` declares the
function get and `int (*fp)(int)` the variable fp.  Tokens are (kind, text, line).
"""

from __future__ import annotations

from typing import NamedTuple

# Words that stand before a declarator, and those that say what a type is.
_QUALIFIERS = frozenset("auto const extern inline register restrict static typedef volatile _Noreturn _Atomic _Thread_local __inline __extension__ constexpr".split())
_TYPES = frozenset("char double float int long short signed unsigned void bool _Bool _Complex".split())
_TAGGED = frozenset("struct union enum class".split())
_STORAGE = _QUALIFIERS - {"const", "volatile", "restrict"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}


class Declared(NamedTuple):
    name: str
    at: int  # which token is the name
    function: bool
    type: str
    after: int  # the token behind the declarator


def _balanced(tokens: list[tuple[str, str, int]], at: int) -> int:
    """The place behind the bracket that closes the one at `at`."""
    opened, shut, depth = tokens[at][1], _CLOSING[tokens[at][1]], 0
    for k in range(at, len(tokens)):
        depth += (tokens[k][1] == opened) - (tokens[k][1] == shut)
        if not depth:
            return k + 1
    return len(tokens)


def _text(tokens: list[tuple[str, str, int]], at: int) -> str:
    return tokens[at][1] if at < len(tokens) else ""


def _declarator(tokens: list[tuple[str, str, int]], at: int, reserved: frozenset[str], depth: int = 0) -> tuple[int, bool, int, int] | None:
    """(place of the name, whether a function, pointers before it, the place behind) or nothing."""
    stars = 0
    while _text(tokens, at) in ("*", "&", "^", "const", "volatile", "restrict"):
        stars += tokens[at][1] == "*"
        at += 1
    if _text(tokens, at) == "(" and depth < 50:
        inner = _declarator(tokens, at + 1, reserved, depth + 1)
        if inner is None or _text(tokens, inner[3]) != ")":
            return None
        name, function, within, at = inner
        stars, at = stars + within, at + 1
    elif at < len(tokens) and tokens[at][0] in ("name", "call") and tokens[at][1] not in reserved:
        name, at = at, at + 1
        function = _text(tokens, at) == "("
    else:
        return None
    while _text(tokens, at) in ("(", "["):
        at = _balanced(tokens, at)
    return name, function, stars, at


def declared(tokens: list[tuple[str, str, int]], reserved: frozenset[str], known: str = "") -> list[Declared]:
    """All that a declaration declares; `known` is the type where it was read before (a body in braces)."""
    at, words, typed = 0, [], bool(known)
    while at < len(tokens):
        kind, text, _ = tokens[at]
        if text in ("__attribute__", "__declspec", "_Alignas", "alignas") and _text(tokens, at + 1) == "(":
            at = _balanced(tokens, at + 1)
        elif text in _TAGGED:
            words, typed, at = [*words, text], True, at + 1
            if at < len(tokens) and tokens[at][0] == "name":
                words, at = [*words, tokens[at][1]], at + 1
        elif text in _QUALIFIERS or text in _TYPES:
            words, typed, at = [*words, text], typed or text in _TYPES, at + 1
        elif kind == "name" and text not in reserved and not typed and (at + 1 < len(tokens)) and (tokens[at + 1][0] == "name" or tokens[at + 1][1] == "*" or _text(tokens, at + 1) + _text(tokens, at + 2) == "(*"):
            words, typed, at = [*words, text], True, at + 1
        else:
            break
    base = known or " ".join(w for w in words if w not in _STORAGE)
    out: list[Declared] = []
    while typed and at < len(tokens):
        found = _declarator(tokens, at, reserved)
        if found is None:
            break
        name, function, stars, at = found
        out.append(Declared(tokens[name][1], name, function, base + (" " + "*" * stars if stars else ""), at))
        while at < len(tokens) and tokens[at][1] != ",":  # bits, or a value
            at = _balanced(tokens, at) if tokens[at][1] in _CLOSING else at + 1
        at += 1
    return out
