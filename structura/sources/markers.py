"""Rule markers in reference files: read from the source text, never executed, and compiled to rules.

A marker is a call in the metadata of `Annotated`: `__archtest__: Annotated[None, marker(...), ...]` in the body of a
module, class or function, or the annotation of a parameter or a return. Its arguments are literals or names; names are
resolved through the file's imports. What can't be read becomes an issue of the declaration, and its rule fails.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from structura.plans.rules import Rule
from structura.sources import python_source as P

# Each marker with its parameters. The first may be positional; a star stands for any number of positional
# values.
VARIABLE = P.MARKERS_IN
OBSERVING = "cases init timeout_s"
MARKERS: dict[str, str] = {
    "required_entity_signature": "mode allow_extra_params allow_param_rename return_annotation",
    "required_method": "signature_mode enforce_method_kind allow_missing declared_only name_match aliases pattern",
    "require_method_set": "name_match names pattern declared_only method_kind min_count max_count",
    "require_member_set": "member_kinds name_match names pattern declared_only method_kind storage allow_property descriptor_kinds include_dynamic_attributes interpret_dataclass_fields constructor_kind include_dataclass_constructor min_count max_count",
    "required_constructor": "signature_mode constructor_kind allow_inherited allow_missing",
    "required_factory": "signature_mode satisfy_with allow_inherited name_match aliases pattern allow_missing return_annotation_mode detection_mode",
    "required_attribute": "name annotation storage allow_property require_writable declared_only allow_missing descriptor_kinds include_dynamic_attributes interpret_dataclass_fields",
    "does_not_have": "name member_kind storage declared_only name_match aliases pattern signature_mode include_descriptors include_dynamic_attributes",
    "forbid_imports": "*forbidden scope package mode ignore_type_checking allow ignore_globs",
    "enforce_layers": f"*layers closed ignore_type_checking entry {OBSERVING}",
    "forbid_cycles": f"ignore_type_checking entry {OBSERVING}",
    "architecture_entry": f"entry policy allow forbid ignore_external require_all ignore_type_checking {OBSERVING}",
    "module_interface": f"*names entry ignore_type_checking {OBSERVING}",
    "implements_protocol": "protocol signature_mode enforce_method_kind return_annotation",
    "subclass_of": "base",
    "exact_type": "base",
    "not_subclass_of": "base",
    "inherits_directly_from": "base",
    "is_enum": "",
    "forbid_runtime_calls": f"*modules allow transitive through cover_module {OBSERVING}",
    "require_runtime_calls": f"*modules {OBSERVING}",
    "forbid_runtime_instantiation": f"*modules allow transitive through {OBSERVING}",
    "enforce_reference_calls": f"require_all allow_new_modules {OBSERVING}",
    "require_runtime_members": f"*names types {OBSERVING}",
    "forbid_runtime_members": f"*names {OBSERVING}",
    "is_runtime_concrete_class": OBSERVING,
    "is_runtime_abstract_class": OBSERVING,
    "implements_runtime_protocol": f"protocol {OBSERVING}",
    "is_runtime_singleton": f"access {OBSERVING}",
    "enforce_runtime_observer": f"subscribe notify notify_args unsubscribe subscribe_args {OBSERVING}",
    "require_runtime_delegation": f"spy member {OBSERVING}",
    "forbid_foreign_writes": OBSERVING,
    "forbid_private_access": "allow",
    "forbid_runtime_imports": f"*forbidden allow {OBSERVING}",
    "is_abstract_class": "",
    "is_abstract_method": "",
    "is_concrete_class": "",
    "is_final_class": "",
    "is_final_method": "",
    "is_non_final_class": "",
    "is_non_abstract_method": "",
    "is_non_final_method": "",
    "flow": "stage variable",
    "enforce_flow": f"stages variable {OBSERVING}",
}
SEVERITIES = ("error", "warning", "info")
#: Parameters that nothing here honours, with the values that ask for nothing: any other value is an issue, never dropped in silence.
UNSUPPORTED: dict[str, dict[str, tuple]] = {
    "does_not_have": {"signature_mode": ("any",)},
    "require_member_set": {"descriptor_kinds": (None, []), "include_dynamic_attributes": (False,), "interpret_dataclass_fields": (False,), "constructor_kind": (None, "auto")},
    "required_factory": {"detection_mode": (None, "auto", "annotation")},
    "architecture_entry": {"ignore_external": (True,)},
    "forbid_runtime_calls": {"cover_module": (False, None)},
}

DECLARATION = "project string, role string, path string, module string, qualname string, kind string, marker string, params string, severity string, message string, lineno int, ordinal int, container string, issues string"


def _value(node: ast.AST, f: P._File) -> object:
    """A literal, or the resolved dotted name of a name; containers may mix both."""
    if isinstance(node, (ast.Name, ast.Attribute)):
        name = f._resolved(ast.unparse(node))
        return name if name.partition(".")[0] != name or name in f.aliases.values() else f"{f.module}.{name}" if f.module else name
    if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
        return [_value(x, f) for x in node.elts]
    if isinstance(node, ast.Dict):
        return {str(_value(k, f)): _value(v, f) for k, v in zip(node.keys, node.values) if k is not None}
    return ast.literal_eval(node)


def _arguments(call: ast.Call, marker: str, f: P._File) -> tuple[dict, list[str]]:
    known = MARKERS[marker].split()
    star = known[0][1:] if known and known[0].startswith("*") else None
    places = [k for k in known if not k.startswith("*")]
    params: dict[str, object] = {}
    issues: list[str] = []

    def read(name: str, node: ast.AST) -> None:
        try:
            params[name] = _value(node, f)
        except (ValueError, TypeError, SyntaxError):
            issues.append(f"{name} is no literal or name: {ast.unparse(node)}")

    if star:
        read(star, ast.List(elts=list(call.args), ctx=ast.Load()))
    else:
        for k, node in enumerate(call.args):
            if k < min(1, len(places)):
                read(places[k], node)
            else:
                issues.append(f"unexpected positional argument {ast.unparse(node)}")
    for kw in call.keywords:
        if kw.arg in {*places, "severity", "message"}:
            read(kw.arg, kw.value)
        else:
            issues.append(f"unknown parameter {kw.arg!r}")
    if params.get("severity", "error") not in SEVERITIES:
        issues.append(f"severity must be one of {SEVERITIES}")
    return params, issues


def _metadata(annotation: ast.AST | None) -> list[ast.AST]:
    """What an annotation has beside its type, if it is `Annotated[type, ...]`."""
    if isinstance(annotation, ast.Subscript) and ast.unparse(annotation.value).rpartition(".")[2] == "Annotated" and isinstance(annotation.slice, ast.Tuple):
        return annotation.slice.elts[1:]
    return []


def _marker(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        name = ast.unparse(node.func).rpartition(".")[2]
        return name if name in MARKERS else None
    return None


def declarations(text: str, path: str, packages: Sequence[str] = ()) -> list[dict]:
    """The markers of a file, in order; of two of one kind on one entity, the body's goes before a signature's."""
    f = P._File(text, path, packages)
    out: list[dict] = []

    def add(owner: tuple[str, str], nodes: list[ast.AST], container: str, more: Sequence[str] = ()) -> None:
        for node in nodes:
            marker = _marker(node)
            if marker is None:
                if container == "body":
                    out.append({"qualname": owner[0], "kind": owner[1], "marker": "", "params": {}, "lineno": node.lineno, "container": container, "issues": [f"no marker: {ast.unparse(node)}"]})
                continue
            params, issues = _arguments(node, marker, f)
            out.append({"qualname": owner[0], "kind": owner[1], "marker": marker, "params": params, "lineno": node.lineno, "container": container, "issues": [*more, *issues]})

    def visit(body: Sequence[ast.stmt], owner: tuple[str, str], scope: list[str]) -> None:
        for s in body:
            if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.target.id == VARIABLE:
                add(owner, _metadata(s.annotation), "body", ["the variable has a value"] if s.value is not None else [])
            elif isinstance(s, ast.ClassDef):
                visit(s.body, (".".join([*scope, s.name]), "class"), [*scope, s.name])
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = (".".join([*scope, s.name]), "method" if owner[1] == "class" else "function")
                a = s.args
                for annotation in [*(x.annotation for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)), s.returns]:
                    add(own, _metadata(annotation), "signature")
                visit(s.body, own, [*scope, s.name])
            else:
                if isinstance(s, ast.AnnAssign):
                    add(owner, [m for m in _metadata(s.annotation) if _marker(m) == "flow"], "statement")
                for block in ("body", "orelse", "finalbody"):
                    visit(getattr(s, block, []), owner, scope)
                for handler in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
                    visit(handler.body, owner, scope)

    visit(f.tree.body, (f.module, "module"), [])
    bodies = {(d["qualname"], d["marker"]) for d in out if d["container"] == "body"}
    kept = [d for d in out if d["container"] != "signature" or (d["qualname"], d["marker"]) not in bodies]
    return [d | {"module": f.module, "ordinal": k} for k, d in enumerate(kept)]


def read_markers(files: DataFrame, packages: Sequence[str] = ()) -> DataFrame:
    """Declarations (columns DECLARATION) of files (project, role, path, text); a file that doesn't parse has none."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for project, role, path, text in zip(pdf["project"], pdf["role"], pdf["path"], pdf["text"]):
                try:
                    found = declarations(text or "", path, [*packages, project])
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for d in found:
                    params = dict(d["params"])
                    severity, message = params.pop("severity", "error"), params.pop("message", None)
                    rows.append((project, role, path, d["module"], d["qualname"], d["kind"], d["marker"], json.dumps(params, sort_keys=True), severity, message, d["lineno"], d["ordinal"], d["container"], "; ".join(d["issues"])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECLARATION.split(", ")])

    return files.select("project", "role", "path", "text").mapInPandas(run, DECLARATION)


# ---- compiling

_NOMINAL = {"subclass_of": ("transitive", False), "not_subclass_of": ("transitive", True), "exact_type": ("exact", False), "inherits_directly_from": ("direct", False)}
_MODIFIERS = {
    "is_abstract_class": ("abstract_class", {"negated": False}), "is_concrete_class": ("abstract_class", {"negated": True}), "is_abstract_method": ("decorated", {"decorators": "abstract", "negated": False}),
    "is_non_abstract_method": ("decorated", {"decorators": "abstract", "negated": True}), "is_final_class": ("decorated", {"decorators": "final", "negated": False}), "is_final_method": ("decorated", {"decorators": "final", "negated": False}),
    "is_non_final_class": ("decorated", {"decorators": "final", "negated": True}), "is_non_final_method": ("decorated", {"decorators": "final", "negated": True}),
}
#: Observing markers and the kind of events that decide them.
RUNTIME = {
    "forbid_runtime_calls": "runtime_calls", "require_runtime_calls": "runtime_calls", "forbid_runtime_instantiation": "runtime_instances", "enforce_reference_calls": "runtime_reference_calls", "require_runtime_members": "runtime_members",
    "forbid_runtime_members": "runtime_members", "is_runtime_concrete_class": "runtime_class_kind", "is_runtime_abstract_class": "runtime_class_kind", "implements_runtime_protocol": "runtime_protocol", "is_runtime_singleton": "runtime_pattern",
    "enforce_runtime_observer": "runtime_pattern", "require_runtime_delegation": "runtime_pattern", "forbid_foreign_writes": "runtime_writes", "forbid_runtime_imports": "runtime_imports",
}
#: Markers whose rules are also observed where they have cases.
ALSO_OBSERVED = {"enforce_layers": "runtime_layers", "forbid_cycles": "runtime_cycles", "architecture_entry": "architecture_runtime", "module_interface": "runtime_module_interface", "enforce_flow": "runtime_flow"}


def _names(p: dict, own: str) -> dict:
    """names and pattern of a selection by name_match."""
    mode = p.get("name_match", "exact")
    if mode == "regex":
        return {"names": [], "pattern": p.get("pattern") or ""}
    if mode == "names":
        return {"names": list(p.get("names") or []), "pattern": ""}
    if mode == "any":
        return {"names": [], "pattern": ""}
    return {"names": [own, *(p.get("aliases") or [])] if mode == "alias" else [own], "pattern": ""}


def _edge_pairs(raw: Sequence[str] | None) -> list[list[str]]:
    return [[x.strip() for x in text.split("->")] for text in raw or []]


def compile_marker(d: dict, source_id: str, base_ids: dict[str, str]) -> list[Rule]:
    """The rules of one declaration (marker, params, qualname, severity) on the reference's entity source_id.

    base_ids gives entities by dotted name, for markers that name another class. Observing markers compile to rules of their
    kind of events, which are skipped where no events are given.
    """
    marker, p, own = d["marker"], d["params"], d["qualname"].rpartition(".")[2]
    name = f"{marker}@{d['module']}.{d['qualname']}" if d["module"] and d["qualname"] != d["module"] else f"{marker}@{d['qualname']}"

    def rule(kind: str, params: dict, suffix: str = "", severity: str = "") -> Rule:
        return Rule(name + suffix, kind, source_id, severity or d["severity"], params)

    def some(*keys: str, **renamed: str) -> dict:
        return {k: p[k] for k in keys if k in p} | {to: p[k] for k, to in renamed.items() if k in p}

    dropped = [f"{k} is not supported" for k, harmless in UNSUPPORTED.get(marker, {}).items() if k in p and p[k] not in harmless]
    if d["issues"] or dropped:
        d = d | {"issues": "; ".join([*filter(None, [d["issues"]]), *dropped])}
        return [rule("compiler_invalid_param", {"issues": d["issues"].split("; ")})]
    out: list[Rule] = []
    if marker == "required_entity_signature":
        out.append(rule("api_signature", some("mode", "allow_extra_params", "allow_param_rename")))
        if p.get("return_annotation", "warning") != "off":
            out.append(rule("return_annotation", {}, "#return", p.get("return_annotation", "warning")))
    elif marker == "required_method":
        out.append(rule("required_method", some("enforce_method_kind", "allow_missing", "declared_only", signature_mode="mode") | _names(p, own)))
    elif marker == "require_method_set":
        out.append(rule("method_set", some("declared_only", "method_kind", "min_count", "max_count") | _names({"name_match": "any"} | p, own)))
    elif marker == "require_member_set":
        out.append(rule("member_set", some("member_kinds", "declared_only", "method_kind", "storage", "allow_property", "min_count", "max_count") | _names({"name_match": "any"} | p, own)))
    elif marker == "required_constructor":
        out.append(rule("required_constructor", some("constructor_kind", "allow_inherited", "allow_missing", signature_mode="mode")))
    elif marker == "required_factory":
        out.append(rule("required_factory", some("satisfy_with", "allow_inherited", "allow_missing", signature_mode="mode") | _names({"name_match": "any"} | p, own)))
    elif marker == "required_attribute":
        out.append(rule("attribute_contract", some("name", "annotation", "storage", "require_writable", "declared_only", "allow_property", "allow_missing", "descriptor_kinds", "include_dynamic_attributes", "interpret_dataclass_fields")))
    elif marker == "does_not_have":
        chosen = {"names": list(p.get("aliases") or []), "pattern": ""} if p.get("name_match") == "alias" else _names(p, str(p.get("name", own)))
        out.append(rule("member_absence", some("declared_only", "member_kind", "storage", "include_dynamic_attributes") | ({"descriptor_kinds": list(P.DESCRIPTORS[1:])} if p.get("include_descriptors") else {}) | chosen))
    elif marker == "forbid_imports":
        out.append(rule("import_policy", {k: v for k, v in some("forbidden", "mode", "ignore_type_checking", "allow", "ignore_globs", "scope", "package").items() if v is not None}))
    elif marker == "enforce_layers":
        out.append(rule("module_layers", {k: v for k, v in some("layers", "closed", "ignore_type_checking").items() if v is not None}))
    elif marker == "forbid_cycles":
        out.append(rule("module_cycles", some("ignore_type_checking")))
    elif marker == "architecture_entry":
        out.append(rule("architecture_static", some("policy", "require_all", "ignore_type_checking") | {"allow": _edge_pairs(p.get("allow")), "forbid": _edge_pairs(p.get("forbid"))}))
    elif marker == "module_interface":
        out.append(rule("module_interface", some("names", "ignore_type_checking")))
    elif marker == "implements_protocol":
        out.append(rule("protocol_conformance", {"protocol": str(p.get("protocol", ""))} | some("enforce_method_kind", signature_mode="mode")))
    elif marker in _NOMINAL:
        relation, negated = _NOMINAL[marker]
        out.append(rule("nominal_type", {"base": base_ids.get(str(p.get("base", "")), str(p.get("base", ""))), "relation": relation, "negated": negated}))
    elif marker == "is_enum":
        out.append(rule("enum_type", {}))
    elif marker in _MODIFIERS:
        kind, params = _MODIFIERS[marker]
        out.append(rule(kind, params))
    elif marker == "forbid_private_access":
        out.append(rule("private_access", {"allow": list(p.get("allow") or [])}))
    elif marker in RUNTIME:
        out.append(rule(RUNTIME[marker], {"marker": marker} | p))
    elif marker == "enforce_flow" and not p.get("cases"):
        out.append(rule("variable_flow", some("stages", "variable")))
    if marker in ALSO_OBSERVED and p.get("cases"):
        out.append(rule(ALSO_OBSERVED[marker], {"marker": marker} | ({"module": d["module"]} if marker == "module_interface" else {}) | p, "#observed"))
    return out


def rules_of(declared: DataFrame, reference: DataFrame) -> list[Rule]:
    """All rules of a reference's declarations. Both come to the driver: they are one reference, whatever the submissions."""
    ids: dict[tuple[str, str, str], str] = {}
    by_name: dict[str, str] = {}
    for e in reference.select("module", "qualname", "kind", "canonical_id").collect():
        ids[(e.module, e.qualname, e.kind)] = e.canonical_id
        by_name[f"{e.module}.{e.qualname}" if e.module else e.qualname] = e.canonical_id
    out: list[Rule] = []
    seen: dict[str, int] = {}
    for r in declared.orderBy("path", "ordinal").collect():
        d = r.asDict() | {"params": json.loads(r.params), "issues": r.issues}
        for rule in compile_marker(d, ids.get((r.module, r.qualname, r.kind), ""), by_name):
            n = seen[rule.rule_id] = seen.get(rule.rule_id, 0) + 1
            out.append(rule if n == 1 else Rule(f"{rule.rule_id}~{n}", rule.rule_type, rule.source_id, rule.severity, rule.params))
    return out
