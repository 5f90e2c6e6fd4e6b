"""Recorded events as a source of a run: a folder with a table for each kind of events, Parquet or JSON lines.

    log/cases.parquet   log/calls.json   log/writes/project=a/part-0.parquet   ...

A kind's table is a file or a folder named after it, with or without an ending; where it has neither, its files' endings
tell. Tables may be partitioned by project. The code of submissions is never executed: what a run asks of events comes from
these tables alone, and any recorder that writes them will do (write_log writes what structura.sources.observe saw).

Columns are checked before anything runs: a missing or wrongly typed one is an EventLogError; further ones are left out.
Rows that can't be used (broken JSON, a null where a name is needed) are rejected one by one and become ERROR results of
their project. Everything else stays partitioned, and projects that a run doesn't ask about are left out at the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each kind of events with its columns; those after the bar may be missing and are null then.
KINDS: dict[str, str] = {
    "cases": "project string, case string, status string",
    "calls": "project string, case string, caller string, callee string | function string, caller_function string, via array<string>, branches boolean, seq int",
    "instances": "project string, case string, creator string, module string, class string | kin boolean",
    "imports": "project string, importer string, imported string | case string",
    "writes": "project string, case string, module string, function string, class string, attribute string, change string",
    "spies": "project string, case string, spy string, member string",
    "notices": "project string, case string, phase string",
    "objects": "project string, case string, constructible boolean | class string, abstract_methods array<string>, same boolean",
    "members": "project string, case string, name string, type string | callable boolean, binds boolean",
    "stages": "project string, case string, stage string, seq int",
}
#: Columns in which a null makes a row unusable; the others of the first part may be null.
KEYS = ("project", "case", "status", "caller", "callee", "creator", "class", "importer", "imported", "attribute", "spy", "phase", "constructible", "name", "stage", "seq")
#: What these columns may hold.
VALUES = {"phase": ("subscribed", "unsubscribed")}
ENDINGS = {".parquet": "parquet", ".json": "json", ".jsonl": "json"}
_BROKEN = "_broken"


class EventLogError(ValueError):
    """What is wrong with a log, kind by kind."""


@dataclass(frozen=True)
class EventLog:
    """tables: by kind; rejected: (project, kind, reason, record) of rows that can't be used."""

    tables: dict[str, DataFrame]
    rejected: DataFrame


def columns(kind: str) -> tuple[T.StructType, list[str]]:
    """All columns of a kind, and the names of those that must be there."""
    must, _, may = KINDS[kind].partition(" | ")
    schema = lambda ddl: T.StructType.fromDDL(ddl) if ddl else T.StructType()
    return T.StructType([*schema(must).fields, *schema(may).fields]), schema(must).names


def listed(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """Kind -> (path, format) of the tables in a folder, wherever Spark can read it."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise EventLogError(f"no event log at {folder}")
    out: dict[str, tuple[str, str]] = {}
    problems = []
    for status in fs.listStatus(root):
        name, path = status.getPath().getName(), status.getPath().toString()
        if name.startswith(("_", ".")):
            continue
        kind = name.split(".")[0]
        ending = ENDINGS.get(name[len(kind) :])
        if kind not in KINDS or (name != kind and ending is None):
            problems.append(f"{name} is no kind of events")
            continue
        if ending is None:
            files = fs.listFiles(status.getPath(), True)
            while ending is None and files.hasNext():
                ending = next((f for e, f in ENDINGS.items() if files.next().getPath().getName().endswith(e)), None)
        if ending is None:
            problems.append(f"{name} has neither Parquet nor JSON files")
        elif kind in out:
            problems.append(f"{kind} is there twice")
        else:
            out[kind] = (path, ending)
    if "cases" not in out and not problems:
        problems.append("cases are missing: without them nothing says what ran")
    if problems:
        raise EventLogError("; ".join(sorted(problems)))
    return out


def _read(spark: SparkSession, kind: str, path: str, form: str) -> DataFrame:
    """A kind's rows with all its columns, missing optional ones null, and what is broken; wrong columns are an EventLogError."""
    schema, must = columns(kind)
    if form == "json":
        wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
        return spark.read.schema(wide).option("columnNameOfCorruptRecord", _BROKEN).json(path)
    rows = spark.read.parquet(path)
    have = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [f"{kind} lacks {c}" for c in must if c not in have]
    wrong += [f"{kind}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if f.name in have and not _fits(have[f.name], f.dataType)]
    if wrong:
        raise EventLogError("; ".join(wrong))
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(None).cast("string").alias(_BROKEN))


def _fits(have: T.DataType, want: T.DataType) -> bool:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(have, T.NullType) or isinstance(want, whole) and isinstance(have, whole):
        return True
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _fits(have.elementType, want.elementType)
    if isinstance(want, T.StringType):  # a partition column of numbers names projects as well
        return isinstance(have, (T.StringType, *whole))
    return type(have) is type(want)


def _fault(kind: str) -> Column:
    """Why a row can't be used; null if it can."""
    schema, must = columns(kind)
    out = F.when(F.col(_BROKEN).isNotNull(), F.lit("broken_record"))
    for c in [c for c in must if c in KEYS]:
        out = out.when(F.col(c).isNull(), F.lit(f"no_{c}"))
        if c in VALUES:
            out = out.when(~F.col(c).isin(*VALUES[c]), F.lit(f"unknown_{c}"))
    return out


def read_log(spark: SparkSession, folder: str, projects: Sequence[str] | None = None) -> EventLog:
    """The tables of a log, of all projects or only of these. Tables that aren't there are empty."""
    found = listed(spark, folder)
    tables, bad = {}, []
    for kind in KINDS:
        schema, _ = columns(kind)
        if kind not in found:
            tables[kind] = spark.createDataFrame([], schema)
            continue
        rows = _read(spark, kind, *found[kind])
        if projects is not None:  # a row that names no project is still to be rejected
            rows = rows.where(F.col("project").isNull() | F.col("project").isin(list(projects)))
        fault = _fault(kind)
        tables[kind] = rows.where(fault.isNull()).select(*schema.names)
        record = F.coalesce(_BROKEN, F.to_json(F.struct(*schema.names)))
        bad.append(rows.where(fault.isNotNull()).select(F.coalesce("project", F.lit("")).alias("project"), F.lit(kind).alias("kind"), fault.alias("reason"), record.alias("record")))
    return EventLog(tables, reduce(DataFrame.unionByName, bad))


def rule_events(log: EventLog, reference: str = "reference") -> dict[str, DataFrame]:
    """A log's tables as observing rules take them: submissions' rows, and the reference's own as reference_calls, reference_stages and reference_cases.

    Where no stages are recorded they are the calls in order: what was called, by module and by module and function.
    """
    tables = dict(log.tables)
    stages = F.explode(F.array_compact(F.array("callee", F.when(F.col("function").isNotNull(), F.concat_ws(".", "callee", "function")))))
    called = tables["calls"].where("seq is not null").select("project", "case", stages.alias("stage"), "seq")
    recorded = tables["stages"].select("project").distinct().withColumn("_own", F.lit(True))
    tables["stages"] = tables["stages"].unionByName(called.join(recorded, "project", "left_anti"))
    own = {k: t.where(F.col("project") != reference) for k, t in tables.items()}
    model = {f"reference_{k}": tables[k].where(F.col("project") == reference).drop("project") for k in ("calls", "stages", "cases")}
    return own | model


def write_log(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables by kind, rows of a project side by side, so that a run over few projects skips the rest."""
    for kind, rows in tables.items():
        schema, must = columns(kind)
        lacking = [c for c in must if c not in rows.columns]
        if lacking:
            raise EventLogError(f"{kind} lacks {', '.join(lacking)}")
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in rows.columns])
        own.repartitionByRange("project").sortWithinPartitions("project").write.mode("append").parquet(f"{folder}/{kind}.parquet")
