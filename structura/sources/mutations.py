"""Mutants of a project: one small structural fault each, made on the syntax tree and written back as text.

An operator yields (line, what, edit) for every place of a file where it applies; edit changes a fresh tree of that file in
place. Mutants are numbered in the order of operators, files and places, so identifiers are the same on every run.
"""

from __future__ import annotations

import ast
import copy
import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from structura.sources import python_source as P

MUTANT = "project string, mutant string, operator string, path string, lineno int, what string, text string"

# A library and calls with effects that mutants bring in.
LIBRARY, IO_CALL, BUILTIN_CALL = "sqlite3", "print('mutant')", "input()"

Place = tuple[int, str, Callable[[ast.Module], None]]


@dataclass
class Project:
    """What operators may look up beyond the file that they change."""

    trees: dict[str, ast.Module]
    modules: dict[str, str] = field(default_factory=dict)
    #: Class names by module, private names of each, and base classes that are abstract.
    private: dict[str, list[str]] = field(default_factory=dict)
    classes: dict[str, list[str]] = field(default_factory=dict)
    abstract: set[str] = field(default_factory=set)

    def __post_init__(self):
        for path, tree in self.trees.items():
            module = self.modules[path] = P.module_of_path(path)
            own = [n for n in tree.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
            self.classes[module] = [n.name for n in own if isinstance(n, ast.ClassDef)]
            names = [n.name for n in own] + [t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
            self.private[module] = [n for n in names if n.startswith("_") and not n.startswith("__")]
            self.abstract |= {n.name for n in own if isinstance(n, ast.ClassDef) and any(_is_abstract(m) for m in n.body)}

    def imported(self, tree: ast.Module) -> set[str]:
        out: set[str] = set()
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                out |= {a.name for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                out |= {n.module or ""} | {f"{n.module}.{a.name}" if n.module else a.name for a in n.names}
        return out


def _is_abstract(node: ast.AST) -> bool:
    return isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and any(ast.unparse(d).rpartition(".")[2] == "abstractmethod" for d in node.decorator_list)


def _functions(tree: ast.Module) -> list[ast.FunctionDef]:
    return [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not _is_abstract(n)]


def _classes(tree: ast.Module) -> list[ast.ClassDef]:
    return [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]


def _methods(c: ast.ClassDef) -> list[ast.FunctionDef]:
    return [m for m in c.body if isinstance(m, ast.FunctionDef) and m.args.args and not any(ast.unparse(d) in ("staticmethod", "classmethod") for d in m.decorator_list)]


def _find(tree: ast.Module, like: ast.AST) -> ast.AST:
    """The node of a fresh tree at the place of one in the tree that was searched."""
    return next(n for n in ast.walk(tree) if type(n) is type(like) and getattr(n, "lineno", None) == like.lineno and n.col_offset == like.col_offset and n.end_col_offset == like.end_col_offset)


def _statements(code: str) -> list[ast.stmt]:
    return ast.parse(code).body


def _top(tree: ast.Module, code: str) -> None:
    """Put statements after the docstring and imports from __future__."""
    k = 0
    while k < len(tree.body) and ((isinstance(tree.body[k], ast.Expr) and isinstance(getattr(tree.body[k], "value", None), ast.Constant)) or (isinstance(tree.body[k], ast.ImportFrom) and tree.body[k].module == "__future__")):
        k += 1
    tree.body[k:k] = _statements(code)


def _first(f: ast.AST, code: str) -> None:
    """Put statements at the beginning of a function, after its docstring."""
    k = 1 if isinstance(f.body[0], ast.Expr) and isinstance(f.body[0].value, ast.Constant) and isinstance(f.body[0].value.value, str) else 0
    f.body[k:k] = _statements(code)


def _into(f: ast.FunctionDef, code: str) -> Callable[[ast.Module], None]:
    return lambda tree: _first(_find(tree, f), code)


def _in_place(node: ast.expr, code: str) -> Callable[[ast.Module], None]:
    """Put an expression in the place of another one."""
    new = ast.parse(code, mode="eval").body

    class Swap(ast.NodeTransformer):
        def __init__(self, at):
            self.at = at

        def generic_visit(self, n):
            return ast.copy_location(new, n) if n is self.at else super().generic_visit(n)

        def visit(self, n):
            return ast.copy_location(new, n) if n is self.at else super().visit(n)

    return lambda tree: Swap(_find(tree, node)).visit(tree)


# ---- operators: (project, path, tree) -> places


def add_import(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Import a module of the project that the file doesn't use yet."""
    have, own = pr.imported(tree), pr.modules[path]
    for module in sorted(set(pr.modules.values()) - {own, ""}):
        if module not in have:
            yield 1, module, lambda t, m=module: _top(t, f"import {m}")


def lazy_import(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """The same inside a function, where it only shows when that runs."""
    have, own = pr.imported(tree), pr.modules[path]
    others = [m for m in sorted(set(pr.modules.values()) - {own, ""}) if m not in have]
    for f in _functions(tree)[:1]:
        for module in others:
            yield f.lineno, module, _into(f, f"import {module}")


def add_library(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    if LIBRARY not in pr.imported(tree):
        yield 1, LIBRARY, lambda t: _top(t, f"import {LIBRARY}")


def dynamic_import(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Import by a text, which no import statement shows."""
    own = pr.modules[path]
    for f in _functions(tree)[:1]:
        for module in sorted(set(pr.modules.values()) - {own, ""})[:1]:
            yield f.lineno, module, _into(f, f"__import__('importlib').import_module({module!r})")


def use_private_name(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Use a private name of another module."""
    for f in _functions(tree)[:1]:
        for module, names in sorted(pr.private.items()):
            for name in names[:1]:
                if module and module != pr.modules[path]:
                    yield f.lineno, f"{module}.{name}", _into(f, f"from {module} import {name}")


def _injected(c: ast.ClassDef) -> Iterator[tuple[ast.FunctionDef, ast.Assign, str]]:
    """Assignments `self.x = x` of constructor parameters."""
    for m in _methods(c):
        if m.name == "__init__":
            names = {a.arg for a in [*m.args.args[1:], *m.args.kwonlyargs]}
            for s in m.body:
                if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Attribute) and isinstance(s.value, ast.Name) and s.value.id in names:
                    yield m, s, s.value.id


def _named_class(pr: Project, annotation: ast.expr | None, name: str) -> str | None:
    """The project's class that an annotation, or else a parameter's name, stands for."""
    text = ast.unparse(annotation).strip("'\"").rpartition(".")[2] if annotation is not None else "".join(p.title() for p in name.split("_"))
    return text if any(text in own for own in pr.classes.values()) else None


def rebuild_injected(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Build an injected object again from its own type instead of keeping it."""
    for c in _classes(tree):
        for _, s, name in _injected(c):
            yield s.lineno, f"{c.name}.{name}", _in_place(s.value, f"type({name})()")


def hardcode_collaborator(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Name the class of an injected object and build that."""
    for c in _classes(tree):
        for m, s, name in _injected(c):
            annotation = next((a.annotation for a in [*m.args.args, *m.args.kwonlyargs] if a.arg == name), None)
            made = _named_class(pr, annotation, name)
            home = next((mod for mod, own in pr.classes.items() if made in own), None) if made else None
            if made:

                def edit(t, s=s, made=made, home=home):
                    _in_place(s.value, f"{made}()")(t)
                    if home and home != pr.modules[path]:
                        _top(t, f"from {home} import {made}")

                yield s.lineno, f"{c.name}.{name} = {made}()", edit


def _calls(f: ast.AST) -> Iterator[tuple[ast.stmt, ast.Call]]:
    for s in ast.walk(f):
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
            yield s, s.value


def drop_call(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Leave a call statement out."""

    def edit(t, s):
        at = _find(t, s)
        for n in ast.walk(t):
            for block in ("body", "orelse", "finalbody"):
                body = getattr(n, block, None)
                if isinstance(body, list) and at in body:
                    body[body.index(at)] = ast.copy_location(ast.Pass(), at)

    for f in _functions(tree):
        for s, call in _calls(f):
            if not ast.unparse(call.func).startswith("super("):
                yield s.lineno, ast.unparse(call.func), lambda t, s=s: edit(t, s)


def _role_calls(tree: ast.Module) -> Iterator[ast.Call]:
    """Calls of methods of what an object holds: `self.x.m(...)`."""
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Attribute) and isinstance(n.func.value.value, ast.Name) and n.func.value.value.id == "self":
            yield n


def stub_role_call(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """A constant instead of what a collaborator returns."""
    for n in _role_calls(tree):
        yield n.lineno, ast.unparse(n.func), _in_place(n, "None")


def break_port(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Rename a method that overrides an abstract one, so that its class no longer offers it."""
    for c in _classes(tree):
        if any(ast.unparse(b).rpartition(".")[2] in pr.abstract for b in c.bases):
            for m in _methods(c):
                if not m.name.startswith("_"):
                    yield m.lineno, f"{c.name}.{m.name}", lambda t, m=m: setattr(_find(t, m), "name", f"{m.name}_renamed")


def drop_base(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Leave a base class of the project out."""
    known = {c for own in pr.classes.values() for c in own}
    for c in _classes(tree):
        for k, b in enumerate(c.bases):
            if ast.unparse(b).rpartition(".")[2] in known:
                yield c.lineno, f"{c.name}({ast.unparse(b)})", lambda t, c=c, k=k: _find(t, c).bases.pop(k)


def concretize_base(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Make an abstract class concrete: its methods lose their marks and get bodies."""

    def edit(t, c):
        own = _find(t, c)
        own.bases = [b for b in own.bases if ast.unparse(b).rpartition(".")[2] != "ABC"]
        own.keywords = [k for k in own.keywords if k.arg != "metaclass"]
        for m in own.body:
            if _is_abstract(m):
                m.decorator_list = [d for d in m.decorator_list if ast.unparse(d).rpartition(".")[2] != "abstractmethod"]
                m.body = _statements("return None")

    for c in _classes(tree):
        if any(_is_abstract(m) for m in c.body):
            yield c.lineno, c.name, lambda t, c=c: edit(t, c)


def _held(c: ast.ClassDef, containers: bool) -> list[str]:
    """Attributes that a class gives itself: containers, or any."""
    out = []
    for m in _methods(c):
        for n in ast.walk(m):
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None
            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == m.args.args[0].arg:
                value = n.value
                empty = isinstance(value, (ast.List, ast.Dict, ast.Set)) or (isinstance(value, ast.Call) and ast.unparse(value.func) in ("list", "dict", "set"))
                if empty or not containers:
                    out.append(target.attr)
    return sorted(set(out))


def _clients(pr: Project, tree: ast.Module) -> Iterator[tuple[ast.FunctionDef, str, ast.ClassDef]]:
    """Functions with a parameter that stands for a class of the project, outside that class."""
    owners = {c.name: c for t in pr.trees.values() for c in _classes(t)}
    inside = {id(m): c.name for c in _classes(tree) for m in c.body}
    for f in _functions(tree):
        for a in [*f.args.args, *f.args.kwonlyargs]:
            name = _named_class(pr, a.annotation, a.arg) if a.arg not in ("self", "cls") else None
            if name in owners and inside.get(id(f)) != name:
                yield f, a.arg, owners[name]


def foreign_write(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """Assign an attribute of another class's object."""
    for f, arg, c in _clients(pr, tree):
        for name in _held(c, False)[:1]:
            yield f.lineno, f"{c.name}.{name}", _into(f, f"{arg}.{name} = None")


def _mutate(pr: Project, tree: ast.Module, private: bool) -> Iterator[Place]:
    for f, arg, c in _clients(pr, tree):
        for name in [n for n in _held(c, True) if n.startswith("_") == private][:1]:
            yield f.lineno, f"{c.name}.{name}", _into(f, f"{arg}.{name}.clear()")


def mutate_private_container(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    yield from _mutate(pr, tree, True)


def mutate_public_container(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    yield from _mutate(pr, tree, False)


def read_private_attribute(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    for f, arg, c in _clients(pr, tree):
        for name in [n for n in _held(c, False) if n.startswith("_")][:1]:
            yield f.lineno, f"{c.name}.{name}", _into(f, f"_ = {arg}.{name}")


def add_io_call(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    for f in _functions(tree):
        yield f.lineno, f.name, _into(f, IO_CALL)


def add_builtin_call(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    for f in _functions(tree):
        yield f.lineno, f.name, _into(f, BUILTIN_CALL)


def add_io_via_helper(pr: Project, path: str, tree: ast.Module) -> Iterator[Place]:
    """The same through a new function of the module."""

    def edit(t, f):
        _first(_find(t, f), "_mutant_helper()")
        t.body += _statements(f"def _mutant_helper():\n    {IO_CALL}")

    for f in _functions(tree):
        yield f.lineno, f.name, lambda t, f=f: edit(t, f)


#: In this order mutants are numbered.
OPERATORS: dict[str, Callable[[Project, str, ast.Module], Iterator[Place]]] = {
    f.__name__: f
    for f in (
        add_import, lazy_import, add_library, dynamic_import, use_private_name, rebuild_injected, hardcode_collaborator, drop_call, stub_role_call, break_port, drop_base, concretize_base, foreign_write,
        mutate_private_container, mutate_public_container, read_private_attribute, add_io_call, add_builtin_call, add_io_via_helper,
    )
}


def register(name: str, operator: Callable[[Project, str, ast.Module], Iterator[Place]]) -> None:
    OPERATORS[name] = operator


def mutants(files: dict[str, str], operators: Sequence[str] | None = None) -> Iterator[dict]:
    """(mutant, operator, path, lineno, what, text) of a project's files by path; files that don't parse aren't changed.

    A mutant whose text is that of the file, or no Python, is left out.
    """
    trees = {}
    for path, text in sorted(files.items()):
        try:
            trees[path] = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            continue
    project = Project(trees)
    for name in operators if operators is not None else OPERATORS:
        n = 0
        for path, tree in trees.items():
            before = ast.unparse(tree)
            for line, what, edit in OPERATORS[name](project, path, tree):
                own = copy.deepcopy(tree)
                edit(own)
                text = ast.unparse(ast.fix_missing_locations(own))
                if text == before:
                    continue
                n += 1
                digest = hashlib.sha1(f"{path}|{text}".encode()).hexdigest()[:8]
                yield {"mutant": f"{name}-{n:03d}-{digest}", "operator": name, "path": path, "lineno": line, "what": what, "text": text + "\n"}


def skipped(files: DataFrame) -> DataFrame:
    """(project, path, error) of files that mutation leaves out, because they don't parse."""
    return P.syntax_errors(P.extract(files)).select("project", "path", "error")


def generate(files: DataFrame, operators: Sequence[str] | None = None) -> DataFrame:
    """All mutants (columns MUTANT) of files (project, path, text); operators look at a whole project, so one task has each."""
    wanted = list(operators) if operators is not None else None

    def run(key, pdf):
        import pandas as pd

        rows = [{"project": key[0]} | m for m in mutants(dict(zip(pdf["path"], pdf["text"])), wanted)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MUTANT.split(", ")])

    return files.select("project", "path", "text").groupBy("project").applyInPandas(run, MUTANT)


def as_targets(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, role, path, text): each mutant as a project of its own, its other files as they are."""
    from pyspark.sql import functions as F

    whole = found.select("project", "mutant", F.col("path").alias("_path"), F.col("text").alias("_text")).join(files.select("project", "path", "text"), "project")
    return whole.select(F.concat_ws("/", "project", "mutant").alias("project"), F.lit("target").alias("role"), "path", F.when(F.col("path") == F.col("_path"), F.col("_text")).otherwise(F.col("text")).alias("text"))
