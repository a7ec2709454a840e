"""Shapes of C and JavaScript that need more than a look at names and brackets."""

from corpuslab.operators import braces
from corpuslab.operators.declarators import declared

C = """typedef struct { int x; unsigned long *p; char name[20]; } point_t;
typedef unsigned int u32;
typedef int (*cb_t)(int, char *);
struct node { struct node *next; int a, b : 3; void (*call)(int); struct { int q; } in; };
enum color { RED, GREEN = 2, BLUE = (1 << 3) };
union u { float f; int i; } shared, *other;
int (*get(void))(int) { return helper; }
int old(a, b) int a; char *b; { return use(a); }
static int a, b = 2, *c = &a, d[3] = {1, 2};
const char *names[] = { "x", "y" };
int proto(int);
int (*fp)(int) = 0;
unsigned flags __attribute__((unused));
#ifdef A
int first(int x) {
#else
int first(long x) {
#endif
  if (x) { go(x); }
  return 1;
}
int second(void) { return third(); }
#if X
void p(void) { q1(); }
#elif Y
void p(void) { q2(); }
#endif
u32 last(point_t *p) { struct tmp { int z; } t; return p->x; }
"""

JS = """const re = /["'/]/g, n = a / b / c;
function after(x) { return x.replace(/[`${]/, "y") && call1(`t ${inner(x) + `nest ${deep(1)}`} }`); }
const o = { meth(a) { return one(a); }, arrow: (x) => { two(x); }, fn: function () { three(); }, plain: 1, get g() { return four(); } };
export default { run() { five(); }, async load() { await six(); } };
call({ cb() { seven(); } });
class A extends B { step(a) { return a / 2; } }
if (x) { y = 4 / 2; }
const t = `a${ {k: f9(1)}.k }b`; last();
return /x}/.exec(z);
"""


def of(source, lang, kind, *fields):
    return [tuple(r.get(f) for f in fields) for r in braces.symbols(source, lang) if r["kind"] == kind]


def test_c_types():
    assert of(C, "c", "type", "name", "how", "line", "members", "bases") == [
        ("point_t", "struct", 1, ["x: int", "p: unsigned long *", "name: char"], []),
        ("u32", "typedef", 2, [], ["unsigned int"]),
        ("cb_t", "typedef", 3, [], ["int *"]),
        ("node", "struct", 4, ["next: struct node *", "a: int", "b: int", "call: void *", "in: struct"], []),
        ("color", "enum", 5, ["RED", "GREEN: 2", "BLUE: (1<<3)"], []),
        ("u", "union", 6, ["f: float", "i: int"], []),
        ("tmp", "struct", 28, ["z: int"], []),
    ]


def test_c_functions_and_variables():
    assert of(C, "c", "function", "name", "line", "lines", "calls") == [
        ("get", 7, 1, []), ("old", 8, 1, ["use"]), ("first", 15, 7, ["go"]), ("second", 22, 1, ["third"]), ("p", 24, 1, ["q1"]), ("last", 28, 1, []),
    ]
    assert [n for n, _ in of(C, "c", "variable", "name", "line")] == ["shared", "other", "a", "b", "c", "d", "names", "fp", "flags"]


def test_branches_that_only_close_and_endings_that_are_missing():
    source = "int f(void) {\n#if A\n  g1();\n}\n#else\n  g2();\n}\n#endif\nint h(void) { k(); }\n#endif\n#else\nint l(void) { }\n#if B\nint m(void) {"
    assert of(source, "c", "function", "name", "line", "lines") == [("f", 1, 4), ("h", 9, 1), ("l", 12, 1), ("m", 14, 1)]
    assert of("#if A\n{{{{\n#else\n}}}}\n#endif\nint z(void) { }", "c", "function", "name") == [("z",)]


def test_declarations():
    tokens = lambda text: [(k, t, 1) for k, t, _ in braces.File(text, "c")._tokens()]
    read = lambda text: [(d.name, d.function, d.type) for d in declared(tokens(text), braces.RESERVED["c"])]
    assert read("static const unsigned long long x") == [("x", False, "const unsigned long long")]
    assert read("char *(*(**foo[][8])(void))[5]") == [("foo", False, "char ****")]
    assert read("size_t n, f(int), *p") == [("n", False, "size_t"), ("f", True, "size_t"), ("p", False, "size_t *")]
    assert read("x = 1") == [] and read("f(a)") == [] and read("") == [] and read("int (") == [] and read("(" * 3000) == []
    assert read("void (*signal(int s, void (*f)(int)))(int)") == [("signal", True, "void *")]


def test_js_functions_and_calls():
    assert of(JS, "js", "function", "name", "line", "calls") == [
        ("after", 2, ["call1", "deep", "inner", "replace"]), ("meth", 3, ["one"]), ("arrow", 3, ["two"]), ("fn", 3, ["three"]), ("g", 3, ["four"]),
        ("run", 4, ["five"]), ("load", 4, ["six"]), ("cb", 5, ["seven"]), ("step", 6, []),
    ]
    assert of(JS, "js", "call", "name")[-3:] == [("f9",), ("last",), ("exec",)]
    assert [n for (n,) in of(JS, "js", "variable", "name")] == ["re", "o", "t"]


def test_js_slashes_and_open_templates():
    calls = lambda text: [n for (n,) in of(text, "js", "call", "name")]
    assert calls("a = b / cc(1) / dd(2);") == ["cc", "dd"]
    assert calls("a = (b) / cc('/') / dd(2);") == ["cc", "dd"]
    assert calls("x = [/a(b)/, /[/]c(d)/g]; ee(1)") == ["ee"]
    assert calls("return /'/.test(ff(1)) // gg(1)\n/* hh(1) */") == ["test", "ff"]
    assert calls("s = `${aa(1)} ${bb({k: `${cc(2)}`})} \\`dd(1)`; ee(3)") == ["aa", "bb", "cc", "ee"]
    assert calls("s = `never closed ${aa(1)") == ["aa"] and calls("`") == [] and calls("}`x(1)") == []
    for text in ("`${" * 20_000, "/" * 50_000, "`" * 50_001, "{`${" * 9_000):
        list(braces.symbols(text, "js"))
