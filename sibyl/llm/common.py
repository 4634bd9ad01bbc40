"""What the operators share: the shared working folder, written intermediate tables, words and folds."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space. `bytes.split()` cuts UTF-8 text at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, the characters that end a word.
SPACE = " \t\n\x0b\x0c\r"

#: Rows of a table that may be broadcast, some tens of bytes each.
MOST_SENT = 100_000

_own_folder: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where it is set.

    Unset on a local master (tests): a temporary folder of this process. Unset on a cluster: a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="work-")
        else:
            _own_folder[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return _own_folder[app]


def spread(spark: SparkSession) -> int:
    """Tasks over which small tables whose rows are costly are dealt: twice the cores."""
    return max(16, 2 * spark.sparkContext.defaultParallelism)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def few(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked for a broadcast where it has at most `most` rows; else as it is, for a join by shuffle. For a row per source, and the like.

    It is written first, so that counting does not make it twice.
    """
    out = written(df, "few")
    return F.broadcast(out) if out.count() <= most else out


def drop_written(df: DataFrame) -> None:
    """Removes the files behind a table from written() that no later step reads."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Written tables that are removed together, once what they lead to is written."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(written(df, name))
        return self._tables[-1]

    def drop(self) -> None:
        for df in self._tables:
            drop_written(df)
        self._tables.clear()


def local_path(uri: str) -> str:
    """The mounted path of a shared file, for memory mapping."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return parsed.path
    raise ValueError(f"memory mapping needs a shared folder that is mounted as a path, not {uri}")


def put_file(path: str, data) -> None:
    """Writes a shared file whole: a repeated task replaces it by the same bytes, readers never see a part."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n)).cast("int")


def unit(*cols: Column) -> Column:
    """A number in (0, 1) fixed by the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def n_words(text: Column) -> Column:
    """Words of a text, without Python: places where a word begins. Null: 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.when(F.trim(spaced) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(spaced), " +"))).cast("long")


def map_columns(df: DataFrame, keep: Sequence[str], inputs: Sequence[Column], made: Sequence[tuple[str, str]], fn: Callable[..., Sequence], rows: int = 256) -> DataFrame:
    """keep's columns untouched, and the columns that fn makes of the inputs, in one pass without a shuffle.

    fn gets a list of values for each input, a few rows at a time, which bounds memory, and returns a list or array for
    each of made, given as (name, type).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    types = {f.name: f.dataType for f in df.schema.fields}
    schema = StructType()
    for i, c in enumerate(keep):
        schema.add(f"k{i}", types[c])
    arrow = []
    for name, kind in made:
        parsed = _parse_datatype_string(kind)
        schema.add(name, parsed)
        arrow.append(to_arrow_type(parsed))
    chosen = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    n_keep, n_in, names = len(keep), len(inputs), [f"k{i}" for i in range(len(keep))] + [m[0] for m in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                got = fn(*[part.column(n_keep + i).to_pylist() for i in range(n_in)])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_keep)] + [pa.array(g, t) for g, t in zip(got, arrow, strict=True)], names)

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(m[0]) for m in made])
