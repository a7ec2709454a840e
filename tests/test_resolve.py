"""Calls find the function that their file means, not the first of its name."""

import pytest

from corpuslab.operators import code, resolve

FILES = {
    "app/main.py": "from lib.tools import step as go\nfrom . import near\nfrom .near import *\nimport lib.other\nfrom lib import public\n\ndef run(x):\n    go(x); step(x); own(x); starred(x); lib.other.deep(x); public(x); nowhere(x); unique(x)\n\ndef own(x):\n    pass\n",
    "app/near.py": "from ..lib.tools import step\n\ndef starred(x):\n    pass\n\ndef own(x):\n    pass\n",
    "lib/__init__.py": "from .inner import public\nfrom .loop_a import turn\n",
    "lib/inner/__init__.py": "from .real import hidden as public\n",
    "lib/inner/real.py": "def hidden(x):\n    pass\n",
    "lib/tools.py": "def step(x):\n    pass\n",
    "lib/other.py": "def step(x):\n    pass\n\ndef deep(x):\n    pass\n",
    "lib/loop_a.py": "from .loop_b import turn\nfrom lib import public\n\ndef a(x):\n    turn(x); public(x)\n",
    "lib/loop_b.py": "from .loop_a import turn\n",
    "zzz/rare.py": "def unique(x):\n    pass\n",
    "src/main.c": '#include "sensor.h"\n#include <stdio.h>\nstatic int init(void) { return 0; }\nint main(void) { init(); read_all(); log_it(1); printf("x"); return 0; }\n',
    "src/sensor.c": '#include "sensor.h"\n#include "log.h"\nint init(void) { return 1; }\nint read_all(void) { log_it(2); return init(); }\n',
    "include/sensor.h": '#include "log.h"\nint read_all(void);\n',
    "include/log.h": "void log_it(int x);\n",
    "src/log.c": '#include "log.h"\nvoid log_it(int x) { }\n',
    "old/log.c": "void log_it(int x) { }\n",
    "web/a.js": "import { fmt } from './util/fmt'\nconst b = require('../web/b.js');\nexport function start(x) { fmt(x); help(x); ask(x); }\n",
    "web/util/fmt.ts": "export function fmt(x) { return x }\n",
    "web/b.js": "function help(x) { return x }\n",
    "other/b.js": "function help(x) { return x }\nfunction fmt(x) { return x }\nfunction ask(x) { return x }\n",
    "x/ask.js": "function ask(x) { return x }\n",
}
LANGS = {"py": "py", "c": "c", "h": "c", "js": "js", "ts": "js"}

WANTED = {
    ("app/main.py", "run"): {
        "go": ("lib/tools.py", "step", "name"), "step": ("lib/tools.py", "step", "include"), "own": ("app/main.py", "own", "local"), "starred": ("app/near.py", "starred", "include"),
        "deep": ("lib/other.py", "deep", "module"), "public": ("lib/inner/real.py", "hidden", "name"), "nowhere": (None, None, None), "unique": ("zzz/rare.py", "unique", "only"),
    },
    ("lib/loop_a.py", "a"): {"turn": (None, None, None), "public": ("lib/inner/real.py", "hidden", "name")},
    ("src/main.c", "main"): {"init": ("src/main.c", "init", "local"), "read_all": ("src/sensor.c", "read_all", "include"), "log_it": ("src/log.c", "log_it", "include"), "printf": (None, None, None)},
    ("src/sensor.c", "read_all"): {"init": ("src/sensor.c", "init", "local"), "log_it": ("src/log.c", "log_it", "include")},
    ("web/a.js", "start"): {"fmt": ("web/util/fmt.ts", "fmt", "module"), "help": ("web/b.js", "help", "module"), "ask": (None, None, None)},
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(p, LANGS[p.rsplit(".", 1)[1]], s) for p, s in FILES.items()]
    return code.symbols(spark.createDataFrame(rows, "path string, lang string, source string"))


def test_calls_by_imports(spark, found):
    got = {}
    for r in resolve.resolve_calls(found).collect():
        got.setdefault((r.path, r.caller), {})[r.callee] = (r.callee_path, r.callee_name, r.how)
    assert got == WANTED


def test_files_of_modules(found):
    links = {(r.path, r.module, r.level): r.target for r in resolve.module_files(found, found.select("path").distinct()).where("not path like '%.c'").collect()}
    assert links["app/near.py", "lib.tools", 2] == "lib/tools.py" and links["lib/__init__.py", "inner", 1] == "lib/inner/__init__.py"
    assert links["app/main.py", "lib.other", None] == "lib/other.py" and links["web/a.js", "../web/b.js", None] == "web/b.js"
    assert ("include/sensor.h", "log.h", None) in links and ("app/main.py", "nothing", 0) not in links


def test_no_files(found):
    assert resolve.resolve_calls(found.where("false")).count() == 0
