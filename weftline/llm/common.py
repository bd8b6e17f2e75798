"""Helpers that several operators share: table access, checkpoints, folds, and byte-level word splitting."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, a laptop)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(parts)


def held_out(column: str, parts: int, remainder: int) -> Column:
    """True where the id's fold is the held-out one. A row without id is never learnt from, so it counts as held out."""
    return F.coalesce(fold(column, parts) == F.lit(remainder), F.lit(True))


#: Lower-cased bytes to word bytes: ASCII letters, digits and all bytes of multi-byte characters stay, the rest is a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8 bytes, without ASCII punctuation. NULL counts as empty."""
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


#: Most bytes of an Arrow batch between Spark and Python, so that what a task holds doesn't grow with the texts' length.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of Arrow batches to ``BATCH_BYTES``, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sql(f"SET {name}").first()["value"].rstrip("bB")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def add_columns(
    df: DataFrame,
    source: str,
    fields: dict[str, str],
    start: Callable[[], Callable[[list], list]],
    keep: list[str] | None = None,
    rows: int = 512,
) -> DataFrame:
    """``df`` with columns computed in Python from the column ``source``, in one pass of Arrow batches and no shuffle.

    ``fields`` has names and types of the new columns; columns of ``df`` with such names are replaced. ``start`` runs once
    a task and returns a function from a list of values to a list of columns. ``keep`` names the columns of ``df`` to
    return (all if None), so that long texts needn't travel back. ``source`` goes to Python once, whether kept or not.
    """
    bounded_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in fields]
    sent = keep if source in keep else [*keep, source]
    narrow = df.select(*[F.col(f"`{c}`") for c in sent])
    at = sent.index(source)
    types = [narrow.schema[c] for c in keep]
    schema = StructType([*types, *[StructField(k, _parse_datatype_string(v)) for k, v in fields.items()]])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in slices(batches, rows):
            made = work(b.column(at).to_pylist())
            arrays = [pa.array(x, out.field(n).type) for x, n in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *arrays], names=[*keep, *fields])

    return narrow.mapInArrow(run, schema)


def where_text(df: DataFrame, start: Callable[[], Callable[[list], list[bool]]], text: str = "text", rows: int = 512) -> DataFrame:
    """The rows of ``df`` whose texts are picked in Python, all columns as they are: one pass, no shuffle and no join.

    ``start`` runs once a task and returns a function from a list of texts to a list of booleans.
    """
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in slices(batches, rows):
            yield b.filter(pa.array(work(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Most rows of a table of keys that is broadcast: 60 MB at some 120 bytes a row.
MOST_KEYS = 500_000


def sized_broadcast(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if it has at most ``MOST_KEYS`` rows; otherwise as it is, so that a join shuffles."""
    return F.broadcast(keys) if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS else keys


def keyed_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", share: int = 500) -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row a key, so that no task gets a frequent key's rows.

    By broadcast if ``keyed`` has few rows. Otherwise keys with over one in ``share`` of all rows, at most ``share`` of them, are
    joined by broadcast, and the others by a shuffle. Both tables are read several times.
    """
    small = sized_broadcast(keyed)
    if small is not keyed:
        return rows.join(small, key, how)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(checkpointed(counts.where(F.col("__n") > total // share).select(key)))
    often = rows.join(hot, key, "left_semi").join(F.broadcast(keyed.join(hot, key, "left_semi")), key, how)
    return often.unionByName(rows.join(hot, key, "left_anti").join(keyed, key, how))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` texts of each class 0 and 1 with their labels, for fitting a model on the driver.

    The rows with the smallest hashes of the ids are taken from ``labels (doc_id, <label>)`` alone, and only their ids, so
    bounded in number, go to the documents: no text is shuffled to find them. An id labelled twice has the larger label;
    of a repeated document one text is used; texts over ``max_chars`` and NULL ones are left out.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    at = F.xxhash64("doc_id")
    ids = [(r["doc_id"], c) for c in (0, 1) for r in known.where(F.col("y") == c).orderBy(at, "doc_id").limit(max_rows).collect()]
    few = spark.createDataFrame(ids, "doc_id long, y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy(at, "doc_id").collect()
    return [(r["text"], r["y"]) for r in found]
