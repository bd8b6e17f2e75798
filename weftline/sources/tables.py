"""Readers, writers and entry checks of sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(n, value)``: the lines of text files with their numbers from 1, files and splits in order of name and place.

    Two passes: the lines of each split are counted, and a line's number is the sum of the splits before its own and its place
    there. No task gets more than a split, and the driver one row a split.
    """
    at = F.monotonically_increasing_id()  # in order within a task, whose splits are read one after the other
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    lines = spark.read.text(path).select("value", *split, at.alias("__at"))
    before, offsets = 0, []
    for r in lines.groupBy("__file", "__start").agg(F.min("__at").alias("first"), F.count("*").alias("n")).orderBy("__file", "__start").toLocalIterator():
        offsets.append((r["__file"], r["__start"], before - r["first"] + 1))
        before += r["n"]
    known = spark.createDataFrame(offsets, "__file string, __start long, __by long")
    return lines.join(F.broadcast(known), ["__file", "__start"]).select((F.col("__at") + F.col("__by")).alias("n"), "value")


def read_10x(spark: SparkSession, folder: str, sample_id: str) -> tuple[DataFrame, DataFrame]:
    """``counts`` and ``spots`` of a 10x folder: ``filtered_feature_bc_matrix/`` (matrix.mtx, features.tsv, barcodes.tsv, each
    perhaps gzipped, or in several files) and ``spatial/tissue_positions_list.csv``. Only spots in tissue with a barcode of the
    matrix are kept. ``ValueError`` if the matrix has other numbers of genes, barcodes or cells than its size line says.
    """
    inner = f"{folder}/filtered_feature_bc_matrix"

    def names(name: str, number: str, field: int) -> DataFrame:
        lines = numbered_lines(spark, f"{inner}/{name}*")
        return lines.select(F.col("n").cast("int").alias(number), F.split("value", "\t")[field].alias(f"{number}_name"))

    genes, spots_of = names("features.tsv", "g", 1), names("barcodes.tsv", "s", 0)
    body = numbered_lines(spark, f"{inner}/matrix.mtx*").where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.orderBy("n").limit(1).collect()
    if not size:
        raise ValueError("the matrix has no size line")
    told = [int(x) for x in size[0]["value"].split()]
    fields = F.split(F.trim("value"), r"\s+")
    cells = body.where(F.col("n") > size[0]["n"]).select(fields[0].cast("int").alias("g"), fields[1].cast("int").alias("s"), fields[2].cast("long").alias("cnt"))
    many, g, s = cells.agg(F.count("*"), F.max("g"), F.max("s")).first()
    if told != [genes.count(), spots_of.count(), many] or (g or 0) > told[0] or (s or 0) > told[1]:
        raise ValueError(f"the size line says {told}, read were {genes.count()} genes, {spots_of.count()} barcodes and {many} cells")
    counts = cells.where("cnt > 0").join(genes, "g").join(spots_of, "s").select(F.lit(sample_id).alias("sample_id"), F.col("s_name").alias("spot_id"), F.col("g_name").alias("gene"), "cnt")
    schema = "spot_id string, in_tissue int, array_row int, array_col int, pxl_row double, pxl_col double"
    places = spark.read.csv(f"{folder}/spatial/tissue_positions_list.csv", schema=schema).where("in_tissue = 1")
    spots = places.join(spots_of.select(F.col("s_name").alias("spot_id")), "spot_id", "left_semi")
    return counts, spots.select(F.lit(sample_id).alias("sample_id"), "spot_id", F.col("array_row").cast("double").alias("row"), F.col("array_col").cast("double").alias("col"), "pxl_row", "pxl_col")


def write_10x(counts: DataFrame, spots: DataFrame, folder: str) -> None:
    """One sample as a 10x folder that ``read_10x`` reads: text files in parts, genes and barcodes in order of their names."""
    inner = f"{folder}/filtered_feature_bc_matrix"
    tables = {}
    for column, name in (("gene", "features.tsv"), ("spot_id", "barcodes.tsv")):
        order = Window.orderBy(column)  # an index of genes or barcodes
        tables[column] = counts.select(column).distinct().withColumn("i", F.row_number().over(order))
        line = F.concat_ws("\t", column, column, F.lit("Gene Expression")) if column == "gene" else F.col(column)
        tables[column].repartition(1).sortWithinPartitions("i").select(line).write.text(f"{inner}/{name}")
    cells = counts.join(tables["gene"].withColumnRenamed("i", "g"), "gene").join(tables["spot_id"].withColumnRenamed("i", "s"), "spot_id")
    size = f"{tables['gene'].count()} {tables['spot_id'].count()} {counts.count()}"
    counts.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate integer general\n{size}",)], "value string").write.text(f"{inner}/matrix.mtx-0")
    cells.select(F.concat_ws(" ", "g", "s", "cnt")).write.text(f"{inner}/matrix.mtx-1")
    spots.select("spot_id", F.lit(1), F.col("row").cast("int"), F.col("col").cast("int"), F.lit(0.0), F.lit(0.0)).write.csv(f"{folder}/spatial/tissue_positions_list.csv")


def assemble(counts: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The counts that have a spot, and the keys of those that have none."""
    keys = spots.select("sample_id", "spot_id")
    return counts.join(keys, ["sample_id", "spot_id"], "left_semi"), counts.select("sample_id", "spot_id").distinct().join(keys, ["sample_id", "spot_id"], "left_anti")


def check_inputs(counts: DataFrame, spots: DataFrame, edges: DataFrame | None = None, k: list[int] | None = None, on_mismatch: str = "error") -> DataFrame:
    """Raises ``ValueError`` for tables that no fit can use; returns the counts, cut to common genes with ``on_mismatch='intersect'``."""
    for df, need in ((counts, ("sample_id", "spot_id", "gene", "cnt")), (spots, ("sample_id", "spot_id", "row", "col"))):
        if missing := [c for c in need if c not in df.columns]:
            raise ValueError(f"columns missing: {', '.join(missing)}")
    if k is not None and (not k or any(int(x) != x or x < 1 for x in k)):
        raise ValueError("cluster counts must be whole numbers from 1")
    if on_mismatch not in ("error", "intersect"):
        raise ValueError("on_mismatch is 'error' or 'intersect'")
    if edges is not None and not edges.join(spots, ["sample_id", "spot_id"], "left_anti").isEmpty():
        raise ValueError("the graph has spots that the samples don't have")
    samples = counts.select("sample_id").distinct().count()
    genes = counts.select("sample_id", "gene").distinct().groupBy("gene").count()
    if on_mismatch == "error" and not genes.where(F.col("count") < samples).isEmpty():
        raise ValueError("samples have different genes")
    return counts.join(genes.where(F.col("count") == samples), "gene", "left_semi") if on_mismatch == "intersect" else counts


def save(df: DataFrame, path: str) -> None:
    """Parquet, one folder a sample."""
    (df.write.partitionBy("sample_id") if "sample_id" in df.columns else df.write).mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """What ``save`` wrote; ``sample_id`` stays text."""
    df = spark.read.parquet(path)
    return df.withColumn("sample_id", F.col("sample_id").cast("string")) if "sample_id" in df.columns else df
