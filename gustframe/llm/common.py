"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of one Arrow batch: whole texts travel in it, so it is smaller than Spark's default.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch (documents are long) and make sure that a checkpoint folder is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where it is unset in a local session
    (tests) a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gustframe-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(folds: int, fold: int, doc_id: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) mod ``folds`` is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def first_by_hash(ids: DataFrame, n: int, salt: str) -> DataFrame:
    """The ``n`` doc_ids that come first in the order of a salted hash: a bounded sample drawn from ids alone."""
    return stored(ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id").limit(n), "sample-ids")


def texts_of(docs: DataFrame, ids: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` of the rows in a bounded sample of ids, which is broadcast: no text is shuffled."""
    return docs.select("doc_id", "text", *more).join(F.broadcast(ids), "doc_id", "left_semi")


def utf8(col):
    """The bytes of a text column; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def widened(df: DataFrame, keep: tuple[str, ...], more: str) -> StructType:
    """The columns ``keep`` of ``df`` as they are, and ``more`` (DDL) behind them."""
    return StructType([StructField(c, df.schema[c].dataType) for c in keep] + StructType.fromDDL(more).fields)


def packed(df: DataFrame, *beside: str) -> DataFrame:
    """``beside`` columns and ``__row``, the whole row: no name of a column can meet one that an operator adds."""
    return df.select(*beside, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def byte_slices(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold ``limit`` bytes at most (one row at least)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df_schema)


def batches_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in columns.items()],
        schema=pa.schema([schema.field(k) for k in columns]))


#: Letters of any script, as Spark's regular expressions know them.
LETTER = r"\p{L}"
