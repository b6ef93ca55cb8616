"""Finding bars on a file system, and writing small results: CSV, JSON, JSON lines, Markdown and, where openpyxl is there, XLSX.

All paths are Hadoop paths, so that any store of the session works. Reports are of at most `most` rows: that limit is theirs.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def discover(spark: SparkSession, folder: str, symbol: str, timeframe: str) -> str | None:
    """The file of a symbol and timeframe: by its exact names first, then the newest whose name holds both, in letters of either case."""
    for name in (f"{symbol}_{timeframe}.parquet", f"{symbol}_intraday_{timeframe}.parquet", f"{symbol}_swing_{timeframe}.parquet"):
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    fs, target = _fs(spark, folder)
    found = [s for s in fs.listStatus(target)] if fs.exists(target) else []
    fit = [s for s in found if s.getPath().getName().endswith(".parquet") and symbol.lower() in s.getPath().getName().lower() and timeframe.lower() in s.getPath().getName().lower()]
    return max(fit, key=lambda s: s.getModificationTime()).getPath().toString() if fit else None


def existence(spark: SparkSession, folder: str, symbol: str, timeframes: list[str]) -> dict[str, list[str]]:
    """Which timeframes were found and which are missing."""
    there = {t: discover(spark, folder, symbol, t) for t in timeframes}
    return {"found": [t for t, p in there.items() if p], "missing": [t for t, p in there.items() if not p]}


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside the path and then renamed, so that readers never see a part."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path}: not renamed")


def create(spark: SparkSession, path: str, data: bytes) -> None:
    """A new file; FileExistsError where there is one, even one that another process has just begun."""
    fs, target = _fs(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it isn't there."""
    fs, target = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.sparkContext.binaryFiles(path).first()[1])


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A Parquet table (zstd) that takes the place of the one before only when it is whole: written beside it, then renamed.

    Readers see the old table or the new one; if the new one can't be put in place, the old one is put back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fs, target = _fs(spark, path)
    (_, part), (_, old) = _fs(spark, f"{path}.part-{mark}"), _fs(spark, f"{path}.old-{mark}")
    writer = df.write.option("compression", "zstd")
    try:
        (writer.partitionBy(*by) if by else writer).parquet(f"{path}.part-{mark}")
        there = fs.exists(target)
        if there and not fs.rename(target, old):
            raise OSError(f"{path}: the table before can't be moved")
        if not fs.rename(part, target):
            if there:
                fs.rename(old, target)
            raise OSError(f"{path}: not renamed")
        if there:
            fs.delete(old, True)
    finally:
        if fs.exists(part):
            fs.delete(part, True)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files; of one file for summaries, which then go through one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, path: str, value: Mapping, pretty: bool = True) -> None:
    write_bytes(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, default=str, indent=2 if pretty else None, separators=None if pretty else (",", ":")).encode())


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object, with or without a byte-order mark."""
    value = json.loads(read_bytes(spark, path).decode("utf-8-sig"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def append_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines that grows with each call."""
    df.write.mode("append").json(path)


def markdown(tables: Mapping[str, DataFrame], most: int = 30) -> str:
    """A report with a heading and the first rows of each table."""
    out = []
    for name, df in tables.items():
        rows = df.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def xlsx(tables: Mapping[str, DataFrame], most: int = 10_000) -> bytes:
    """A workbook with a sheet a table; needs openpyxl. A table of more than `most` rows is refused, not cut."""
    import pandas as pd

    data = io.BytesIO()
    with pd.ExcelWriter(data, engine="openpyxl") as book:
        for name, df in tables.items():
            rows = df.limit(most + 1).toPandas()
            if len(rows) > most:
                raise ValueError(f"{name}: more than {most} rows don't fit a sheet")
            rows.to_excel(book, sheet_name=name[:31], index=False)
    return data.getvalue()
