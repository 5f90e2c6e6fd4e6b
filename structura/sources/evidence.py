"""Static evidence: what a file's syntax shows of calls, instances, dynamic imports, classes and functions, a row each."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structura.sources import python_source as P

EVIDENCE = "project string, role string, path string, module string, kind string, lineno int, scope string, name string, payload string, evidence_id string"
KINDS = ("import", "call", "dynamic_import", "instantiation", "class", "function")
# Calls that import by a text.
DYNAMIC = ("__import__", "import_module", "importlib.import_module", "importlib.__import__", "runpy.run_module", "exec", "eval")


def canonical(payload: object) -> object:
    """A payload with sorted keys, and lists in the order of their items' texts."""
    if isinstance(payload, dict):
        return {str(k): canonical(payload[k]) for k in sorted(payload, key=str)}
    if isinstance(payload, (list, tuple, set)):
        return sorted((canonical(x) for x in payload), key=lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False))
    return payload


def canonical_text(payload: object) -> str:
    return json.dumps(canonical(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def evidence_id(kind: str, module: str, lineno: int, payload: object) -> str:
    return hashlib.sha256(f"{kind}|{module}|{lineno}|{canonical_text(payload)}".encode()).hexdigest()[:16]


def evidence(text: str, path: str) -> list[dict]:
    f = P._File(text, path, ())
    classes = {n.name for n in ast.walk(f.tree) if isinstance(n, ast.ClassDef)}
    out: list[dict] = []

    def add(kind: str, node: ast.AST, scope: list[str], name: str, payload: dict) -> None:
        out.append({"kind": kind, "lineno": node.lineno, "scope": ".".join(scope), "name": name, "payload": canonical_text(payload), "evidence_id": evidence_id(kind, f.module, node.lineno, payload | {"name": name})})

    def visit(node: ast.AST, scope: list[str]) -> None:
        inner = scope
        if isinstance(node, ast.ClassDef):
            inner = [*scope, node.name]
            methods = [m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            add("class", node, scope, ".".join(inner), {"bases": [f._resolved(ast.unparse(b)) for b in node.bases], "methods": methods, "decorators": [f._resolved(ast.unparse(d)) for d in node.decorator_list]})
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = [*scope, node.name]
            own = [n for n in ast.walk(node) if n is not node]
            add("function", node, scope, ".".join(inner), {"parameters": len(P._File._params(node.args)), "is_async": isinstance(node, ast.AsyncFunctionDef), "returns": sum(isinstance(n, ast.Return) for n in own), "yields": any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in own), "calls": sum(isinstance(n, ast.Call) for n in own)})
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("import", node, scope, a.name, {"alias": a.asname})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                add("import", node, scope, f"{'.' * node.level}{node.module or ''}", {"alias": a.asname, "member": a.name})
        elif isinstance(node, ast.Call):
            name = f._resolved(ast.unparse(node.func)) if isinstance(node.func, (ast.Name, ast.Attribute)) else type(node.func).__name__
            shape = {"arguments": len(node.args), "keywords": [k.arg for k in node.keywords if k.arg]}
            if name in DYNAMIC or name.rpartition(".")[2] == "import_module":
                first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) else None
                add("dynamic_import", node, scope, name, {"target": first})
            elif name.rpartition(".")[2] in classes or (name.rpartition(".")[2][:1].isupper() and name in f.aliases.values()):
                add("instantiation", node, scope, name, shape)
            else:
                add("call", node, scope, name, shape)
        for child in ast.iter_child_nodes(node):
            visit(child, inner)

    visit(f.tree, [])
    return out


def collect(files: DataFrame) -> DataFrame:
    """Evidence (columns EVIDENCE) of files (project, role, path, text); a file that doesn't parse has none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for project, role, path, text in zip(pdf["project"], pdf["role"], pdf["path"], pdf["text"]):
                try:
                    rows += [{"project": project, "role": role, "path": path, "module": P.module_of_path(path)} | r for r in evidence(text or "", path)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    return files.select("project", "role", "path", "text").mapInPandas(run, EVIDENCE)


def statistics(found: DataFrame) -> DataFrame:
    """(project, kind, n): one pass, combined before the shuffle."""
    return found.groupBy("project", "kind").agg(F.count("*").alias("n"))


def in_scope(entities: DataFrame, view: str = "all") -> DataFrame:
    """Entities that a validation looks at: all of them, or `public` (no private name anywhere in the qualified name), `top_level`, `classes`."""
    if view == "all":
        return entities
    if view == "public":
        return entities.where(~F.exists(F.split("qualname", r"\."), lambda p: F.startswith(p, F.lit("_")) & ~F.rlike(p, F.lit("^__.*__$"))))
    if view == "top_level":
        return entities.where(~F.contains("qualname", F.lit(".")) | (F.col("kind") == "module"))
    if view == "classes":
        return entities.where("kind in ('class', 'method')")
    raise ValueError(f"unknown view {view!r}")
