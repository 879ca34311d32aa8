"""Readers of files, with declared columns, and the writer of table snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolespark.functions.text import normalize_company, normalize_excluded, title_norm
from rolespark.operators.review import add_history
from rolespark.schemas import COMPANY, LCA_COLUMNS
from rolespark.sources.versions import Version, commit, current


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}; found {df.columns}")


def _lca_format(path: str, fmt: str | None) -> str:
    name = path.lower()
    found = fmt or next((f for f in ("parquet", "csv") if name.endswith((f".{f}", f".{f}.gz"))), None)
    if found is None:
        raise ValueError(f"neither .csv nor .parquet, and no format given: {path}")
    return found


def _disclosure_files(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files below the paths, which may have wildcards. Only names are read."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for path in [paths] if isinstance(paths, str) else paths:
        place = hadoop.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for top in files.globStatus(place) or []:
            each = files.listFiles(top.getPath(), True)
            while each.hasNext():
                file = each.next().getPath()
                below = file.toUri().getPath()[len(top.getPath().toUri().getPath()) :].split("/")
                if not any(part.startswith(("_", ".")) for part in below):
                    found.append(file.toString())
    if not found:
        raise ValueError(f"no files: {paths}")
    return sorted(found)


def read_lca(spark: SparkSession, paths: list[str] | str, fmt: str | None = None, readers: int = 16) -> DataFrame:
    """Disclosure files: the ten columns, the date parsed (null where it is none), and source_file.

    Each file has a schema of its own: its header or footer is read (no rows), files that lack a column are an error that
    names them, and files of equal columns are read together, each column by its name, so their order and further columns
    do not matter. fmt: csv or parquet; without it each file's ending tells."""
    files = _disclosure_files(spark, paths)

    def head(file: str) -> tuple[str, StructType]:
        kind = _lca_format(file, fmt)
        return kind, spark.read.format(kind).options(**({"header": True} if kind == "csv" else {})).load(file).schema

    with ThreadPoolExecutor(readers) as pool:
        heads = list(pool.map(head, files))
    missing = {f: absent for f, (_, schema) in zip(files, heads, strict=True) if (absent := [c for c in LCA_COLUMNS if c not in schema.names])}
    if missing:
        raise ValueError("missing columns: " + "; ".join(f"{f}: {absent}" for f, absent in missing.items()))
    groups: dict[tuple[str, str], tuple[StructType, list[str]]] = {}
    for file, (kind, schema) in zip(files, heads, strict=True):
        groups.setdefault((kind, schema.json()), (schema, []))[1].append(file)
    types = {"TOTAL_WORKER_POSITIONS": "int", "WAGE_RATE_OF_PAY_FROM": "double", "DECISION_DATE": "timestamp"}
    whole = None
    for (kind, _), (schema, members) in groups.items():
        raw = spark.read.schema(schema).format(kind).options(**({"header": True, "enforceSchema": False} if kind == "csv" else {})).load(members)
        picked = [F.col(c).cast("string").try_cast(types[c]).alias(c) if c in types else F.col(c).cast("string").alias(c) for c in LCA_COLUMNS]
        part = raw.select(*picked, F.col("_metadata.file_name").alias("source_file"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def read_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    raw = spark.read.schema(COMPANY).format(fmt).options(**({"header": True} if fmt == "csv" else {"multiLine": True})).load(path)
    return raw.withColumns({"source": F.coalesce("source", F.lit("manual")), "cap_exempt": F.coalesce("cap_exempt", F.lit(False))})


def aliases_frame(spark: SparkSession, aliases: Mapping[str, str | list[str]]) -> DataFrame:
    """alias_norm, target_norm, pos; a single name is a list of one."""
    rows = [(k, [v] if isinstance(v, str) else list(v)) for k, v in aliases.items()]
    raw = spark.createDataFrame(rows, "alias string, targets array<string>")
    each = raw.select("alias", F.posexplode("targets").alias("pos", "target"))
    return each.select(normalize_company(F.col("alias")).alias("alias_norm"), normalize_company(F.col("target")).alias("target_norm"), "pos")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of alias and targets (an array, or one name)."""
    raw = spark.read.schema("alias string, targets string").json(path)
    listed = F.coalesce(F.try_parse_json("targets").cast("string"), F.col("targets"))
    many = F.from_json(listed, "array<string>")
    each = raw.select("alias", F.posexplode(F.when(F.col("targets").startswith("["), many).otherwise(F.array("targets"))).alias("pos", "target"))
    return each.select(normalize_company(F.col("alias")).alias("alias_norm"), normalize_company(F.col("target")).alias("target_norm"), "pos")


def excluded_names(lines: DataFrame) -> DataFrame:
    """name: distinct normalized lines (column value) without blanks and # lines."""
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"(?U)^\s+|\s+$", "")
    return lines.select(text.alias("t")).filter("t <> '' and not startswith(t, '#')").select(normalize_excluded(F.col("t")).alias("name")).filter("name <> ''").distinct()


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    """Names from a text file; a file that is not there is an empty list."""
    from pyspark.errors import AnalysisException

    try:
        return excluded_names(spark.read.text(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string")


def import_tracker(applications: DataFrame, history: DataFrame) -> DataFrame:
    """history and the applications (Company Name, Job Title, perhaps Date of Application) that it lacks."""
    require(applications, ("Company Name", "Job Title"))
    dated = "Date of Application" in applications.columns
    when = F.col("`Date of Application`").cast("string").try_cast("date") if dated else F.lit(None).cast("date")
    fresh = applications.filter("`Company Name` is not null and `Job Title` is not null").select(
        normalize_company(F.col("`Company Name`")).alias("company_norm"), title_norm(F.col("`Job Title`")).alias("title_norm"), when.alias("applied_at"), F.lit("tracker").alias("source")
    )
    return add_history(history, fresh)


def read_tracker(spark: SparkSession, path: str, history: DataFrame) -> DataFrame:
    return import_tracker(spark.read.option("header", True).csv(path), history)


def write_snapshot(df: DataFrame, root: str, table: str = "snapshot") -> Version:
    """df as the next version of the one table under root. A version that somebody reads is never written over, and of two
    writers that began at one version the second gets a Conflict."""
    spark = df.sparkSession
    base = current(spark, root)
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return commit(spark, root, base, {table: {"0": [folder]}})


def read_snapshot(spark: SparkSession, root: str, table: str = "snapshot") -> DataFrame:
    return spark.read.parquet(*[f"{root}/{p}" for p in current(spark, root).pieces(table)])


def write_employers(employers: DataFrame, root: str) -> Version:
    return write_snapshot(employers, root)
