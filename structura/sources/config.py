"""Files that say what to run: a run's configuration (INI), targets, catalogues of principles and tasks (TOML).

They are small and read on the driver; anything unknown or of the wrong type is an error, never a default.
"""

from __future__ import annotations

import configparser
import fnmatch
import os
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structura.operators.matching import Config as MatchConfig

POLICIES = ("any_fail", "all_fail", "threshold")


class ConfigError(ValueError):
    """What is wrong with a file, and where."""


@dataclass(frozen=True)
class RunConfig:
    reference: str = ""
    targets: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    pattern: str = "*.py"
    include_nested_functions: bool = False
    fail_on_unmatched: bool = False
    warnings_as_fail: bool = False
    policy: str = "any_fail"
    threshold: int = 1
    report: str = ""
    events: str = ""
    matching: MatchConfig = field(default_factory=MatchConfig)


def _typed(section: configparser.SectionProxy, key: str, default: object, where: str) -> object:
    try:
        if isinstance(default, bool):
            return section.getboolean(key)
        if isinstance(default, int):
            return section.getint(key)
        if isinstance(default, float):
            return section.getfloat(key)
    except ValueError as e:
        raise ConfigError(f"{where}: {key} must be a {type(default).__name__}") from e
    if isinstance(default, tuple):
        return tuple(x.strip() for x in section[key].replace("\n", ",").split(",") if x.strip())
    return section[key]


def load_config(path: str) -> RunConfig:
    """The sections [run] and [matching] of an INI file."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        try:
            parser.read_file(f)
        except configparser.Error as e:
            raise ConfigError(f"{path}: {e}") from e

    def values(name: str, kind: type) -> dict:
        if name not in parser:
            return {}
        known = {x.name: getattr(kind(), x.name) for x in fields(kind)}
        unknown = sorted(set(parser[name]) - set(known))
        if unknown:
            raise ConfigError(f"{path} [{name}]: unknown {', '.join(unknown)}")
        return {k: _typed(parser[name], k, known[k], f"{path} [{name}]") for k in parser[name]}

    unknown = sorted(set(parser.sections()) - {"run", "matching"})
    if unknown:
        raise ConfigError(f"{path}: unknown sections {', '.join(unknown)}")
    config = RunConfig(**values("run", RunConfig), matching=MatchConfig(**values("matching", MatchConfig)))
    if config.policy not in POLICIES:
        raise ConfigError(f"{path} [run]: policy must be one of {POLICIES}")
    return config


def resolve_targets(patterns: Sequence[str], exclude: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(target, folder) of folders that are named, or lie under a named folder with `/*`, less those whose names an exclude pattern matches."""
    out: dict[str, str] = {}
    for p in patterns:
        folders = sorted(e.path for e in os.scandir(p[:-2]) if e.is_dir()) if p.endswith("/*") else [p]
        for folder in folders:
            name = os.path.basename(folder.rstrip("/"))
            if any(fnmatch.fnmatchcase(name, x) for x in exclude) or name.startswith("."):
                continue
            if not os.path.isdir(folder):
                raise ConfigError(f"no folder {folder}")
            if out.get(name, folder) != folder:
                raise ConfigError(f"two targets are named {name!r}")
            out[name] = folder
    return sorted(out.items())


def module_files(files: DataFrame, modules: DataFrame, prefer_stubs: bool = False) -> DataFrame:
    """(module, path): the file of each dotted name (modules: module): name.py or name/__init__.py, or their stubs, by preference.

    files: path. Derived names are joined by equality, so many names cost one join.
    """
    stem = F.regexp_replace("path", r"\.pyi?$", "")
    named = files.where(F.rlike("path", F.lit(r"\.pyi?$"))).select("path", F.translate(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".").alias("module"), F.endswith("path", F.lit(".pyi")).alias("stub"), F.rlike("path", F.lit(r"(^|/)__init__\.")).alias("package"))
    best = Window.partitionBy("module").orderBy(F.desc("stub") if prefer_stubs else F.col("stub"), F.desc("package"), "path")
    return modules.select("module").distinct().join(named, "module").withColumn("n", F.row_number().over(best)).where("n = 1").select("module", "path")


# ---- catalogues and tasks


@dataclass(frozen=True)
class Check:
    marker: str
    role: str
    params: dict = field(default_factory=dict)
    target_role: str = ""
    target_kind: str = "module"


@dataclass(frozen=True)
class Error:
    id: str
    detected_by: str = ""
    signature: dict = field(default_factory=dict)
    operator: str = ""
    what: str = ""
    gap: str = ""


@dataclass(frozen=True)
class Principle:
    id: str
    name: str
    summary: str
    roles: dict[str, str]
    checks: tuple[Check, ...]
    errors: tuple[Error, ...]


def _only(data: dict, known: Sequence[str], where: str) -> dict:
    unknown = sorted(set(data) - set(known))
    if unknown:
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    return data


def parse_principle(data: dict, where: str) -> Principle:
    """One entry of a catalogue. Roles that checks name must be there; errors need a check or a gap, and signatures of one marker differ."""
    for key in ("id", "name", "roles"):
        if not data.get(key):
            raise ConfigError(f"{where}: {key} is missing")
    roles = dict(data["roles"])
    checks = []
    for k, c in enumerate(data.get("checks", [])):
        own = {x: c[x] for x in ("marker", "role", "target_role", "target_kind") if x in c}
        checks.append(Check(**own, params={x: v for x, v in c.items() if x not in own}))
        for role in (checks[-1].role, checks[-1].target_role):
            if role and role not in roles:
                raise ConfigError(f"{where}: check {k + 1} names the unknown role {role!r}")
    errors = []
    for e in data.get("errors", []):
        own = {x: e[x] for x in ("id", "detected_by", "signature", "operator", "what", "gap") if x in e}
        if bool(own.get("detected_by")) == bool(own.get("gap")):
            raise ConfigError(f"{where}: error {own.get('id')!r} needs either detected_by or gap")
        if any(o.detected_by and (o.detected_by, o.signature) == (own.get("detected_by"), own.get("signature", {})) for o in errors):
            raise ConfigError(f"{where}: two errors of {own['detected_by']} have one signature")
        errors.append(Error(**own))
    return Principle(data["id"], data["name"], data.get("summary", "").strip(), roles, tuple(checks), tuple(errors))


def load_catalogue(folder: str) -> dict[str, Principle]:
    """The entries of a folder, each in a file that is named after it."""
    out = {}
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        if e.name.endswith(".toml"):
            with open(e.path, "rb") as f:
                try:
                    p = parse_principle(tomllib.load(f), e.path)
                except tomllib.TOMLDecodeError as x:
                    raise ConfigError(f"{e.path}: {x}") from x
            if f"{p.id}.toml" != e.name:
                raise ConfigError(f"{e.path}: the file of {p.id!r} must be named after it")
            out[p.id] = p
    return out


@dataclass(frozen=True)
class Task:
    principle: str
    roles: dict[str, tuple[str, ...]]
    cases: dict[str, list[dict]] = field(default_factory=dict)


def parse_task(data: dict, where: str) -> Task:
    _only(data, ("principle", "roles", "cases"), where)
    if not isinstance(data.get("principle"), str) or not data.get("roles"):
        raise ConfigError(f"{where}: principle and roles are needed")
    for name, cases in data.get("cases", {}).items():
        for k, case in enumerate(cases):
            _only(case, ("args", "kwargs", "stdin", "init"), f"{where}: case {k + 1} of {name}")
    return Task(data["principle"], {r: tuple([v] if isinstance(v, str) else v) for r, v in data["roles"].items()}, dict(data.get("cases", {})))


def load_task(folder: str) -> Task:
    path = os.path.join(folder, "task.toml")
    with open(path, "rb") as f:
        try:
            return parse_task(tomllib.load(f), path)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{path}: {e}") from e


def target_files(spark: SparkSession, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """(target, folder) as a table."""
    return spark.createDataFrame(list(targets), "target string, folder string")
