from structura.operators.flow import variable_flow
from structura.sources import flow as W

HEAD = "from typing import Annotated\nfrom rules import flow\n\n"
L, C, S = ('x: Annotated[int, flow("load")] = f()', 'x: Annotated[int, flow("check")] = g(x)', 'x: Annotated[int, flow("save")] = h(x)')
FUNCTIONS = {
    "good": [L, C, S],
    "branch": [L, "if a:", "    " + C, "else:", "    " + C, S],
    "skips": [L, "if a:", "    " + C, S],
    "returns": [L, "if a:", "    return 1", C, S],
    "raises": [L, "if a:", "    raise ValueError", C, S],
    "endless": [L, C, "while True:", "    if a:", "        " + S, "        break"],
    "loop": [L, "for k in a:", "    " + C, S],
    "matched": [L, "match a:", "    case 1:", "        " + C, "    case _:", "        " + C, S],
    "unmatched": [L, "match a:", "    case 1:", "        " + C, S],
    "handled": [L, "try:", "    " + C, "except ValueError:", "    pass", S],
    "swapped": [C, L, S],
}


def test_graph():
    rows = dict(W.function_graphs("def f(a):\n    while a:\n        if a > 1:\n            continue\n        break\n    else:\n        g()\n    return a\n"))["f"]
    nxt = {r["node"]: r["next"] for r in rows}
    kind = {r["node"]: r["kind"] for r in rows}
    loop = next(n for n, k in kind.items() if k == "While")
    assert kind[0] == "entry" and nxt[0] == [loop] and nxt[next(n for n, k in kind.items() if k == "Continue")] == [loop]
    ret = next(n for n, k in kind.items() if k == "Return")
    assert nxt[ret] == [W.END] and nxt[next(n for n, k in kind.items() if k == "Break")] == [ret]


def test_variable_flow(spark):
    text = HEAD + "\n".join(f"def {name}(a):\n" + "\n".join("    " + x for x in body) + "\n" for name, body in FUNCTIONS.items())
    files = spark.createDataFrame([("p", "target", "m.py", text), ("p", "target", "b.py", "def (")], "project string, role string, path string, text string")
    found = variable_flow(W.graphs(files), ["load", "check", "save"]).collect()
    got = {}
    for r in found:
        got.setdefault(r.qualname, set()).add(r.reason)
    assert got == {"skips": {"out_of_order"}, "returns": {"stage_missing"}, "loop": {"out_of_order"}, "unmatched": {"out_of_order"}, "handled": {"out_of_order"}, "swapped": {"out_of_order"}}
