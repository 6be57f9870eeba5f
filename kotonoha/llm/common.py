"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at a time.
SLICE = 128

#: The white space that separates words, as a character class and as its characters.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row belongs to the test fold; rows without an id do not."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 5 == 0, F.lit(False))


_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Gives the executors this package's source, once per application."""
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_rows(df: DataFrame, make: Callable[[], Callable], inputs: list[str], keep: list[str],
             fields: list[T.StructField]) -> DataFrame:
    """The columns ``keep`` and what a function makes of the columns ``inputs``, row by row.

    ``make`` runs once per task and returns a function from the inputs' values
    (string inputs are valid UTF-8 or None) to a tuple with a value per field.
    Rows pass in Arrow batches, so a task holds one batch and no more.
    """
    ship(df.sparkSession.sparkContext)
    types = {f.name: f.dataType for f in df.schema.fields}
    narrow = df.select(*[quoted(c) for c in keep], *[
        (F.make_valid_utf8(quoted(c)) if isinstance(types[c], T.StringType) else quoted(c)).alias(f"_in{i}")
        for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(c, types[c]) for c in keep] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                given = [part.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
                made = list(zip(*[fn(*row) for row in zip(*given)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                    + [pa.array(v, type=arrow.field(len(keep) + i).type) for i, v in enumerate(made)], schema=arrow)

    return narrow.mapInArrow(run, schema)
