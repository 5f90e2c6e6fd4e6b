"""Control-flow graphs of functions, with the stages that statements are marked as.

A node is a statement (or an entry, or a function's exit by return, by its end or by an exception that nothing in it
catches). An edge goes to every statement that may run next; any statement in a `try` may go on in its handlers.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from structura.sources import python_source as P

CFG = "project string, role string, module string, qualname string, node int, lineno int, stage string, variable string, kind string, next array<int>"
ENTRY, END, RAISED = 0, -1, -2


def _always(test: ast.expr) -> bool:
    return isinstance(test, ast.Constant) and bool(test.value)


def _never(test: ast.expr) -> bool:
    return isinstance(test, ast.Constant) and not test.value


def _takes_all(case: ast.match_case) -> bool:
    """Whether a pattern can't fail: a name or `_`, alone, in parentheses or among alternatives, and no guard."""

    def open_(p: ast.pattern) -> bool:
        if isinstance(p, ast.MatchAs):
            return p.pattern is None or open_(p.pattern)
        return isinstance(p, ast.MatchOr) and any(map(open_, p.patterns))

    return case.guard is None and open_(case.pattern)


class Graph:
    """Nodes are numbered in the order of the text; node 0 is the entry."""

    def __init__(self, body: Sequence[ast.stmt]):
        self.statements: list[ast.stmt | None] = [None]
        self.next: dict[int, set[int]] = {ENTRY: set()}
        self.loops: list[tuple[int, set[int]]] = []
        self.catchers: list[list[int]] = []
        self._join(self._block(body, {ENTRY}), END)

    def _node(self, s: ast.stmt, before: set[int]) -> int:
        n = len(self.statements)
        self.statements.append(s)
        self.next[n] = set()
        self._join(before, n)
        if self.catchers:  # it may fail when it is done, or before: then what it would have been isn't met
            for b in {n, *before}:
                self.next[b] |= set(self.catchers[-1])
        return n

    def _join(self, before: set[int], n: int) -> None:
        for b in before:
            self.next[b].add(n)

    def _block(self, body: Sequence[ast.stmt], before: set[int]) -> set[int]:
        """Put statements after some nodes; the nodes from which what follows is reached."""
        for s in body:
            if not before:  # nothing runs here
                return before
            before = self._statement(s, before)
        return before

    def _statement(self, s: ast.stmt, before: set[int]) -> set[int]:
        if isinstance(s, ast.Try | ast.TryStar):
            return self._try(s, before)
        n = self._node(s, before)
        if isinstance(s, ast.Return):
            self.next[n].add(END)
            return set()
        if isinstance(s, ast.Raise):
            if not self.catchers:
                self.next[n].add(RAISED)
            return set()
        if isinstance(s, ast.Break):
            if self.loops:
                self.loops[-1][1].add(n)
            return set()
        if isinstance(s, ast.Continue):
            if self.loops:
                self.next[n].add(self.loops[-1][0])
            return set()
        if isinstance(s, ast.If):
            yes = set() if _never(s.test) else self._block(s.body, {n})
            no = set() if _always(s.test) else self._block(s.orelse, {n}) if s.orelse else {n}
            return yes | no
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            left: set[int] = set()
            self.loops.append((n, left))
            endless = isinstance(s, ast.While) and _always(s.test)
            if not (isinstance(s, ast.While) and _never(s.test)):
                self._join(self._block(s.body, {n}), n)
            self.loops.pop()
            after = set() if endless else {n}
            return (self._block(s.orelse, after) if s.orelse and after else after) | left
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self._block(s.body, {n})
        if isinstance(s, ast.Match):
            out: set[int] = set()
            for case in s.cases:
                out |= self._block(case.body, {n})
                if _takes_all(case):
                    return out
            return out | {n}
        return {n}

    def _try(self, s: ast.Try, before: set[int]) -> set[int]:
        n = self._node(s, before)
        handlers = [self._node(ast.copy_location(ast.Pass(), h), set()) for h in s.handlers]
        if handlers:
            self.catchers.append(handlers)
        after = self._block(s.body, {n})
        if handlers:
            self.catchers.pop()
        after = self._block(s.orelse, after) if s.orelse else after
        for node, h in zip(handlers, s.handlers):
            after |= self._block(h.body, {node})
        if s.finalbody and (after or not handlers):
            return self._block(s.finalbody, after or {n})
        return after

    def rows(self, stage_of) -> Iterator[dict]:
        for n, s in enumerate(self.statements):
            stage, variable = stage_of(s) if s is not None else (None, None)
            yield {"node": n, "lineno": getattr(s, "lineno", 0), "stage": stage, "variable": variable, "kind": "entry" if s is None else type(s).__name__, "next": sorted(self.next[n])}


def _stage(s: ast.stmt) -> tuple[str | None, str | None]:
    """The stage and variable of a statement marked `x: Annotated[T, flow("stage")]`."""
    from structura.sources.markers import _marker, _metadata

    if isinstance(s, ast.AnnAssign):
        for m in _metadata(s.annotation):
            if _marker(m) == "flow":
                given = {k.arg: k.value.value for k in m.keywords if isinstance(k.value, ast.Constant)}
                stage = given.get("stage") or (m.args[0].value if m.args and isinstance(m.args[0], ast.Constant) else None)
                return stage, given.get("variable") or (s.target.id if isinstance(s.target, ast.Name) else None)
    return None, None


def function_graphs(text: str) -> list[tuple[str, list[dict]]]:
    """(qualified name, rows of its graph) of every function in a file."""
    out: list[tuple[str, list[dict]]] = []

    def visit(node: ast.AST, scope: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = (*scope, child.name)
                out.append((".".join(inner), list(Graph(child.body).rows(_stage))))
            elif isinstance(child, ast.ClassDef):
                inner = (*scope, child.name)
            visit(child, inner)

    visit(ast.parse(text), ())
    return out


def graphs(files: DataFrame) -> DataFrame:
    """Control-flow graphs (columns CFG, a row a node) of all functions of files (project, role, path, text)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for project, role, path, text in zip(pdf["project"], pdf["role"], pdf["path"], pdf["text"]):
                try:
                    found = function_graphs(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [{"project": project, "role": role, "module": P.module_of_path(path), "qualname": q} | r for q, own in found for r in own]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CFG.split(", ")])

    return files.select("project", "role", "path", "text").mapInPandas(run, CFG)
