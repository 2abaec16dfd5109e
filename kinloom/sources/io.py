"""Readers and writers: tables from Python objects and files, match and cluster results to files."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def to_frame(spark: SparkSession, data: Any, id_col: str = "id") -> DataFrame:
    """A DataFrame from a DataFrame, a pandas or polars frame, an Arrow table or a list of dicts.

    Missing keys and missing values are nulls; a missing id column becomes the row number as text. Anything else is a
    TypeError.
    """
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_arrow") and not hasattr(data, "iloc"):
        data = data.to_arrow()
    elif hasattr(data, "iloc"):
        data = _arrow(data)
    if isinstance(data, pa.Table):
        return spark.createDataFrame(_plain(data, id_col))
    if isinstance(data, Sequence) and not isinstance(data, (str, bytes)) and all(isinstance(r, dict) for r in data):
        rows = list(data)
    else:
        raise TypeError(f"cannot read records from {type(data).__name__}")
    names = list(dict.fromkeys(k for r in rows for k in r)) or [id_col]
    if rows and id_col not in names:
        names = [id_col, *names]
        rows = [{id_col: str(i), **r} for i, r in enumerate(rows)]
    values = {n: [r.get(n) for r in rows] for n in names}
    kinds = {n: _kind(v) for n, v in values.items()}
    data_rows = [tuple(_as(kinds[n], values[n][i]) for n in names) for i in range(len(rows))]
    return spark.createDataFrame(data_rows, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _arrow(frame: Any) -> pa.Table:
    """A pandas frame column by column; a column of mixed objects becomes text."""
    columns = {}
    for name in frame.columns:
        try:
            columns[str(name)] = pa.Array.from_pandas(frame[name])
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            columns[str(name)] = pa.array([None if v is None or v != v else str(v) for v in frame[name]], pa.string())
    return pa.table(columns)


def _plain(table: pa.Table, id_col: str) -> pa.Table:
    """Whole numbers as long, fractions as double, everything else but nested values as text; a missing id is the row number."""
    columns = {}
    for name, c in zip(table.column_names, table.columns):
        t = c.type
        if pa.types.is_integer(t):
            c = c.cast(pa.int64())
        elif pa.types.is_floating(t):
            c = c.cast(pa.float64())
        elif pa.types.is_null(t) or pa.types.is_dictionary(t) or pa.types.is_string_view(t) or pa.types.is_large_string(t):
            c = c.cast(pa.string())
        elif not (pa.types.is_string(t) or pa.types.is_nested(t)):
            c = pa.chunked_array([pa.array([None if v is None else str(v) for v in c.to_pylist()], pa.string())])
        columns[name] = c
    if id_col not in columns:
        columns = {id_col: pa.array([str(i) for i in range(table.num_rows)], pa.string()), **columns}
    return pa.table(columns)


def _kind(values: list) -> str:
    seen = {type(v) for v in values if v is not None}
    if seen and seen <= {int}:
        return "long"
    if seen and seen <= {int, float}:
        return "double"
    return "string"


def _as(kind: str, v: Any) -> Any:
    return None if v is None else float(v) if kind == "double" else v if kind == "long" else str(v)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, all columns text."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without surrounding blanks; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def _flat(matches: DataFrame, with_class: bool) -> DataFrame:
    cols = ["left_id", "right_id", "score", F.array_join(F.transform("scores", lambda s: s.cast("string")), ";").alias("scores")]
    return matches.select(*cols, *(["match_class"] if with_class else []))


def write_matches_csv(matches: DataFrame, path: str, with_class: bool = False) -> None:
    """left_id, right_id, score and the scores joined by semicolons; a folder of part files."""
    _flat(matches, with_class).write.mode("overwrite").option("header", True).csv(path)


def write_matches_json(matches: DataFrame, path: str) -> None:
    """One JSON object per line; a folder of part files."""
    matches.write.mode("overwrite").json(path)


def write_clusters_csv(clusters: DataFrame, path: str) -> None:
    clusters.select("cluster_id", "record_id").write.mode("overwrite").option("header", True).csv(path)


def write_clusters_json(clusters: DataFrame, path: str) -> None:
    clusters.select("cluster_id", "record_id").write.mode("overwrite").json(path)


def write_single_json(df: DataFrame, path: str) -> None:
    """One local file with a JSON array; rows stream through the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.toLocalIterator()):
            f.write(("," if i else "") + "\n  " + json.dumps(r.asDict(recursive=True), ensure_ascii=False))
        f.write("\n]\n")


def write_single_csv(df: DataFrame, path: str) -> None:
    """One local CSV file with a header."""
    import csv

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
