"""Reading and writing tables as CSV and Excel files, in any file system that Spark knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import xlsx


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A CSV or xlsx file by its extension, every column a string, so that codes keep their zeros. A folder is one of xlsx files."""
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if low.endswith(".xlsx") or "." not in low.rstrip("/").rsplit("/", 1)[-1]:
        return read_xlsx(spark, path, sheet)
    raise ValueError(f"neither .csv nor .xlsx: {path}")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first by default) of workbooks that have the same columns, which the first row of the first file names.

    A file is read by one task, and its rows are given on in portions.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"name": [h or f"_c{i}" for i, h in enumerate(next(xlsx.read_rows(content, sheet), []))]})

    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no workbook in {path}")
    names = [r["name"] for r in files.where(F.col("path") == first).mapInPandas(head, "name string").collect()]

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f"c{i}" for i in range(len(names))]
        for frame in frames:
            for content in frame["content"]:
                rows = xlsx.read_rows(content, sheet)
                next(rows, None)
                held: list[list[str | None]] = []
                for row in rows:
                    held.append((row + [None] * len(names))[: len(names)])
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=columns, dtype=object)
                        held = []
                yield pd.DataFrame(held, columns=columns, dtype=object)

    table = files.mapInPandas(body, ", ".join(f"c{i} string" for i in range(len(names))))
    return table.toDF(*names)


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that any sink takes the table."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part for each partition, each with a header."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Matches", most_rows: int = xlsx.MOST_ROWS) -> None:
    """Workbooks of one sheet in a folder: one for each partition with rows, or more where it has more than a sheet can hold.

    An empty table is one workbook with the header alone. Workbooks are made by the tasks and pass through the driver one
    at a time to the file system of `path`; those that stood there are replaced once all new ones are written.
    """
    table = flat(df)
    names = table.columns
    plain = table.toDF(*(f"c{i}" for i in range(len(names))))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def book(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({"content": [xlsx.write_book([(sheet, names, rows)])]})

        for frame in frames:
            held += (tuple(None if v is None or v is pd.NaT or v != v else v for v in row) for row in frame.astype(object).itertuples(index=False))
            while len(held) >= most_rows - 1:
                yield book(held[: most_rows - 1])
                held = held[most_rows - 1 :]
        if held:
            yield book(held)

    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = at(path).getFileSystem(conf)
    fresh = f"_new-{uuid.uuid4().hex}"

    def put(name: str, content: bytes) -> None:
        stream = fs.create(at(path, fresh, name), True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    n = 0
    for row in plain.mapInPandas(make, "content binary").toLocalIterator():
        put(f"part-{n:05d}.xlsx", row["content"])
        n += 1
    if not n:
        put("part-00000.xlsx", xlsx.write_book([(sheet, names, [])]))
        n = 1
    for old in fs.listStatus(at(path)):
        if old.isFile() and old.getPath().getName().endswith(".xlsx"):
            fs.delete(old.getPath(), False)
    for i in range(n):
        fs.rename(at(path, fresh, f"part-{i:05d}.xlsx"), at(path, f"part-{i:05d}.xlsx"))
    fs.delete(at(path, fresh), True)
