"""Queries over the given tables by name, with their DuckDB SQL where SQL can express them.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correct, display, genes, graph, markers, metrics, potts, qc
from ..sources import tables
from ..sources.adapters import COUNTS_SQL, SPOTS_SQL, counts, spots
from ..sources.checkpoints import checkpointed, shared_folder, stored
from . import iterative

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OWN_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL: the CTEs counts, spots and those below come first."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            OWN_SQL[name] = sql
            ORACLES[name] = f"WITH {', '.join(v for k, v in CTES.items() if _needs(k, sql))} {sql}" if any(_needs(k, sql) for k in CTES) else sql
        return f

    return add


#: Tables that oracles share, in order of their needs.
CTES = {
    "counts": COUNTS_SQL,
    "spots": SPOTS_SQL,
    "kept_spots": "kept_spots AS (SELECT sample_id, spot_id FROM counts GROUP BY ALL HAVING count(*) FILTER (cnt > 0) > 20)",
    "spot_ok": "spot_ok AS (SELECT counts.* FROM counts JOIN kept_spots USING (sample_id, spot_id))",
    "kept": "kept AS (SELECT * FROM spot_ok SEMI JOIN (SELECT sample_id, gene FROM spot_ok GROUP BY ALL HAVING count(*) FILTER (cnt > 0) > 20) g USING (sample_id, gene))",
    "expr": "expr AS (SELECT *, ln(1 + 1e4 * cnt / sum(cnt) OVER (PARTITION BY sample_id, spot_id)) AS value FROM kept)",
    "visium": 'visium AS (SELECT a.sample_id, a.spot_id, b.spot_id nbr_id FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND ((b.row = a.row AND abs(b.col - a.col) = 2) OR (abs(b.row - a.row) = 1 AND abs(b.col - a.col) = 1)))',
    "labelled": "labelled AS (SELECT sample_id, spot_id, covar, dense_rank() OVER (ORDER BY label) AS y FROM spots)",
    "same": "same AS (SELECT s.sample_id, s.spot_id, k, count(n.y) FILTER (n.y = k) AS same, count(n.y) AS degree FROM spots s CROSS JOIN range(1, 6) r(k) LEFT JOIN visium e ON s.sample_id = e.sample_id AND s.spot_id = e.spot_id LEFT JOIN labelled n ON n.sample_id = e.sample_id AND n.spot_id = e.nbr_id GROUP BY ALL)",
    "energy": "energy AS (SELECT *, ln(sum(exp(-0.75 * (degree - same))) OVER (PARTITION BY sample_id, spot_id)) + 0.75 * (degree - same) AS energy FROM same)",
    "total": "total AS (SELECT e.*, energy + abs(k - 1 - covar % 5) * 0.5 AS t FROM energy e JOIN spots USING (sample_id, spot_id))",
    "resp": "resp AS (SELECT *, ln(sum(exp(-t)) OVER (PARTITION BY sample_id, spot_id)) AS loglik, exp(-t) / sum(exp(-t)) OVER (PARTITION BY sample_id, spot_id) AS resp FROM total)",
    "ranked": "ranked AS (SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY sum(cnt) DESC, gene) AS rank FROM kept GROUP BY sample_id, gene)",
    "scaled": "scaled AS (SELECT sample_id, spot_id, gene, value, CASE WHEN sd > 0 THEN least((value - mean) / sd, 10) ELSE 0 END AS scaled FROM expr JOIN (SELECT gene, sum(value) / n AS mean, sqrt(greatest((sum(value * value) - n * (sum(value) / n) ** 2) / (n - 1), 0)) AS sd FROM expr, (SELECT count(*) n FROM (SELECT DISTINCT sample_id, spot_id FROM expr)) GROUP BY gene, n) USING (gene))",
    "corrected": """corrected AS (WITH e AS (SELECT sample_id, spot_id, gene, ln(1 + 1e4 * cnt / sum(cnt) OVER (PARTITION BY sample_id, spot_id)) AS value FROM spot_ok),
  d AS (SELECT sample_id, spot_id, gene, coalesce(value, 0) AS value, x / 100 AS h FROM kept_spots CROSS JOIN (SELECT DISTINCT gene FROM counts) LEFT JOIN e USING (sample_id, spot_id, gene) JOIN spots USING (sample_id, spot_id))
  SELECT sample_id, spot_id, gene, value - b * h AS value FROM d JOIN (SELECT gene, regr_slope(value, h) AS b FROM d GROUP BY gene) USING (gene))""",
    "dots": "dots AS (SELECT label AS cluster, gene, coalesce(sum(e.ev), 0) / n AS mean, coalesce(sum(e.k), 0) / n AS pct FROM (SELECT DISTINCT gene FROM expr) CROSS JOIN (SELECT label, count(*) n FROM spots GROUP BY label) LEFT JOIN (SELECT label, gene, exp(value) - 1 AS ev, CAST(value > 0 AS INT) AS k FROM expr JOIN spots USING (sample_id, spot_id)) e USING (label, gene) GROUP BY label, gene, n)",
}


def _needs(cte: str, sql: str, seen: frozenset[str] = frozenset()) -> bool:
    """Whether the SQL names the table, or a table that does."""
    import re

    return any(re.search(rf"\b{c}\b", sql) and (c == cte or (c not in seen and _needs(cte, CTES[c].split(" AS ", 1)[1], seen | {c}))) for c in CTES)


def r6(c: Column | str) -> Column:
    """Six places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def kept(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    """The counts after both filters, written once where a query reads them several times."""
    found = qc.gene_filter(qc.spot_filter(stored(counts(spark, sf)), 20), 20)
    return stored(found) if once else found


def expr(spark: SparkSession, sf: str) -> DataFrame:
    """The kept counts, log-normalised."""
    return qc.log_normalize(kept(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Spots with the label's number as ``y``."""
    return display.scatter_codes(spots(spark, sf).drop("x", "y"), "label").withColumnRenamed("code", "y")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Spots with their label as the cluster."""
    return spots(spark, sf).select("sample_id", "spot_id", F.col("label").alias("cluster"))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Genes of each sample ranked by their total."""
    from pyspark.sql import Window

    totals = kept(spark, sf).groupBy("sample_id", "gene").agg(F.sum("cnt").alias("t"))
    return totals.select("sample_id", "gene", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("t"), "gene")).alias("rank"))


@query("read_10x", "SELECT counts.sample_id, spot_id, gene, cnt, \"row\", col FROM counts JOIN spots USING (sample_id, spot_id) WHERE counts.sample_id = '2'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A sample written as a 10x folder and read again."""
    folder = f"{shared_folder(spark)}/sample-{uuid.uuid4().hex}"
    tables.write_10x(checkpointed(counts(spark, sf).where("sample_id = '2'").drop("sample_id")), spots(spark, sf).where("sample_id = '2'"), folder)
    cells, places = tables.read_10x(spark, folder, "2")
    return cells.join(places.drop("pxl_row", "pxl_col"), ["sample_id", "spot_id"])


@query("assemble", 'SELECT counts.* FROM counts SEMI JOIN (SELECT sample_id, spot_id FROM spots WHERE "row" % 2 = 0) s USING (sample_id, spot_id)')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.assemble(counts(spark, sf), spots(spark, sf).where("row % 2 = 0"))[0]


@query("spots_missing", 'SELECT DISTINCT sample_id, spot_id FROM counts ANTI JOIN (SELECT sample_id, spot_id FROM spots WHERE "row" % 2 = 0) s USING (sample_id, spot_id)')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.assemble(counts(spark, sf), spots(spark, sf).where("row % 2 = 0"))[1]


@query("check_inputs", "SELECT kept.* FROM kept SEMI JOIN (SELECT gene FROM kept GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM kept)) g USING (gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.check_inputs(kept(spark, sf), spots(spark, sf), k=[4, 5], on_mismatch="intersect").select("sample_id", "spot_id", "gene", "cnt")


@query("save_load", "SELECT * FROM counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    tables.save(counts(spark, sf), path)
    return tables.load(spark, path).select("sample_id", "spot_id", "gene", "cnt")


@query("keep_raw", "SELECT * FROM counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    listed = counts(spark, sf).select("gene").distinct().withColumn("pos", F.hash("gene"))
    return genes.preprocess(counts(spark, sf), spots(spark, sf), genes=listed, keep_raw=True)[1]


@query("translate_genes", "SELECT sample_id, spot_id, CASE WHEN gene LIKE '%#3' THEN 'symbol ' || lower(gene) ELSE gene END AS gene, cnt FROM counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = counts(spark, sf)
    mapping = c.select("gene").distinct().where("gene LIKE '%#3'").withColumn("symbol", F.concat(F.lit("symbol "), F.lower("gene")))
    return qc.translate_genes(c, mapping).select("sample_id", "spot_id", "gene", "cnt")


@query("spot_filter", "SELECT * FROM spot_ok")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.spot_filter(counts(spark, sf), 20)


@query("gene_filter", "SELECT * FROM kept")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, once=False)


@query("inclusive_filter", "SELECT * FROM (SELECT counts.* FROM counts SEMI JOIN (SELECT sample_id, spot_id FROM counts GROUP BY ALL HAVING count(*) FILTER (cnt > 0) >= 10) k USING (sample_id, spot_id)) c SEMI JOIN (SELECT sample_id, gene FROM counts SEMI JOIN (SELECT sample_id, spot_id FROM counts GROUP BY ALL HAVING count(*) FILTER (cnt > 0) >= 10) k USING (sample_id, spot_id) GROUP BY ALL HAVING count(*) FILTER (cnt > 0) >= 10) g USING (sample_id, gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.inclusive_filter(counts(spark, sf))


@query("log_normalize", "SELECT sample_id, spot_id, gene, cnt, round(value, 6) AS value FROM expr")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return expr(spark, sf).select("sample_id", "spot_id", "gene", "cnt", r6("value").alias("value"))


@query("gene_means", "SELECT sample_id, gene, round(sum(value) / n, 6) AS mean FROM expr JOIN (SELECT sample_id, count(DISTINCT spot_id) n FROM expr GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, gene, n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.gene_means(expr(spark, sf)).select("sample_id", "gene", r6("mean").alias("mean"))


@query("sparse_sums_means", "SELECT sample_id, gene, CAST(sum(cnt) AS BIGINT) AS total, round(sum(cnt) / n, 6) AS mean FROM counts JOIN (SELECT sample_id, count(DISTINCT spot_id) n FROM counts GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, gene, n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.sparse_sums(counts(spark, sf)).select("sample_id", "gene", "total", r6("mean").alias("mean"))


@query("sparse_spot_sums", "SELECT sample_id, spot_id, CAST(sum(cnt) AS BIGINT) AS total, round(sum(cnt) / n, 6) AS mean FROM counts JOIN (SELECT sample_id, count(DISTINCT gene) n FROM counts GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, spot_id, n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.sparse_sums(counts(spark, sf), "spot_id").select("sample_id", "spot_id", "total", r6("mean").alias("mean"))


@query("firstup", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", qc.firstup(F.col("p_name")).alias("name"))


@query("make_unique", "SELECT p_partkey, CASE WHEN n = 0 THEN b ELSE b || '.' || CAST(n AS VARCHAR) END AS unique_name FROM (SELECT p_partkey, upper(p_brand) AS b, row_number() OVER (PARTITION BY upper(p_brand) ORDER BY p_partkey) - 1 AS n FROM part)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.make_unique(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "unique_name")


@query("subset_genes", "SELECT counts.*, gene_idx FROM counts JOIN (SELECT gene, row_number() OVER (ORDER BY gene DESC) AS gene_idx FROM (SELECT DISTINCT gene FROM counts WHERE gene LIKE 'Brand#1%')) USING (gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = counts(spark, sf)
    listed = c.where("gene LIKE 'Brand#1%'").select("gene").distinct().withColumn("gene_idx", F.row_number().over(Window.orderBy(F.desc("gene"))))
    return qc.subset_genes(c, listed).select("sample_id", "spot_id", "gene", "cnt", "gene_idx")


@query("disambiguate_ids", "SELECT sample_id, spot_id, CASE WHEN (SELECT max(c) FROM (SELECT count(*) c FROM (SELECT sample_id, CAST(\"row\" AS BIGINT) AS r, CAST(col AS BIGINT) AS q FROM spots) GROUP BY r, q)) > 1 THEN short || CAST(dense_rank() OVER (ORDER BY sample_id) AS VARCHAR) ELSE short END AS new_id FROM (SELECT *, CAST(CAST(\"row\" AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(col AS BIGINT) AS VARCHAR) AS short FROM spots)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    short = F.concat_ws("x", F.col("row").cast("long").cast("string"), F.col("col").cast("long").cast("string"))
    s = spots(spark, sf).select("sample_id", F.col("spot_id").alias("old_id"), short.alias("spot_id"))
    return qc.disambiguate_ids(s).select("sample_id", F.col("old_id").alias("spot_id"), "new_id")


@query("rotate", f"SELECT sample_id, spot_id, round(col * {math.cos(0.5)!r} - \"row\" * {math.sin(0.5)!r}, 6) AS col, round(col * {math.sin(0.5)!r} + \"row\" * {math.cos(0.5)!r}, 6) AS \"row\" FROM spots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.rotate(spots(spark, sf), 0.5).select("sample_id", "spot_id", r6("col").alias("col"), r6("row").alias("row"))


@query("add_embedding", "SELECT sample_id, spot_id, 'position' AS name, round(\"row\", 6) AS v1, round(col, 6) AS v2 FROM spots UNION ALL SELECT sample_id, spot_id, 'irregular', round(x, 6), round(y, 6) FROM spots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = spots(spark, sf)
    first = s.select("sample_id", "spot_id", F.lit("position").alias("name"), F.array("row", "col").alias("vec"))
    both = qc.add_embedding(first, s.select("sample_id", "spot_id", F.array("x", "y").alias("vec")), "irregular")
    return both.select("sample_id", "spot_id", "name", r6(F.col("vec")[0]).alias("v1"), r6(F.col("vec")[1]).alias("v2"))


@query("design_matrix", "SELECT sample_id, spot_id, 1.0::DOUBLE AS intercept, (label = 'BUILDING')::DOUBLE AS label_BUILDING, (label = 'FURNITURE')::DOUBLE AS label_FURNITURE, (label = 'HOUSEHOLD')::DOUBLE AS label_HOUSEHOLD, (label = 'MACHINERY')::DOUBLE AS label_MACHINERY, covar::DOUBLE AS covar FROM spots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return qc.design_matrix(spots(spark, sf), ["label", "covar"])


@query("align_spots", "SELECT counts.* FROM counts SEMI JOIN kept_spots USING (sample_id, spot_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = counts(spark, sf)
    return qc.align_spots(c, qc.spot_filter(c, 20))


@query("lattice_visium", "SELECT * FROM visium")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lattice(spots(spark, sf), "Visium")


@query("lattice_st", 'SELECT a.sample_id, a.spot_id, b.spot_id AS nbr_id FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND ((a."row" = b."row" AND abs(floor(a.col / 2) - floor(b.col / 2)) = 1) OR (abs(a."row" - b."row") = 1 AND floor(a.col / 2) = floor(b.col / 2)))')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.lattice(spots(spark, sf).withColumn("col", F.floor(F.col("col") / 2).cast("double")), "ST")


@query("radius_graph", "SELECT a.sample_id, a.spot_id, b.spot_id AS nbr_id FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 8")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.radius_graph(spots(spark, sf), 8.0)


#: The order statistics that the middle spots' degrees follow from, and the halving over them.
RADIUS_SQL = """SELECT sample_id, count(*) AS n_spots, count(d) AS n_identified, CAST(coalesce(sum(d), 0) AS BIGINT) AS n_edges FROM spots LEFT JOIN (
  WITH RECURSIVE pair AS (SELECT a.sample_id, a.spot_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id),
  near AS (SELECT d, row_number() OVER (PARTITION BY sample_id, spot_id ORDER BY d) AS k FROM pair QUALIFY k <= 13),
  t AS (SELECT list(coalesce(s[n - (n - 1) // 2], 'inf'::DOUBLE)) AS lo, list(coalesce(s[n - n // 2], 'inf'::DOUBLE)) AS hi FROM (SELECT k, list_sort(list(d)) AS s FROM near GROUP BY k), (SELECT count(*) AS n FROM spots)),
  r AS (SELECT 1 AS i, 1.0::DOUBLE AS radius, 1.0::DOUBLE AS least, 50.0::DOUBLE AS most
    UNION ALL SELECT i + 1, (least + most) / 2, least, most FROM (SELECT i, CASE WHEN m < 4 THEN radius ELSE least END AS least, CASE WHEN m < 4 THEN most ELSE radius END AS most, m FROM (
      SELECT r.*, (len(list_filter(lo, lambda v: v < radius)) + len(list_filter(hi, lambda v: v < radius))) / 2.0 AS m FROM r, t)) WHERE NOT (m BETWEEN 4 AND 6) AND i < 40)
  SELECT sample_id, spot_id, count(*) AS d FROM pair WHERE d < (SELECT max_by(radius, i) FROM r) GROUP BY ALL) USING (sample_id, spot_id) GROUP BY sample_id"""


@query("auto_radius", RADIUS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = spots(spark, sf)
    return graph.degree_summary(s, graph.radius_graph(s, graph.auto_radius(s)))


@query("knn_graph", "SELECT sample_id, spot_id, nbr_id FROM (SELECT a.sample_id, a.spot_id, b.spot_id AS nbr_id, row_number() OVER (PARTITION BY a.sample_id, a.spot_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.spot_id) AS r FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id) WHERE r <= 6")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.knn_graph(spots(spark, sf), 6, "x", "y")


@query("degree_summary", "SELECT sample_id, count(*) AS n_spots, count(d) AS n_identified, CAST(coalesce(sum(d), 0) AS BIGINT) AS n_edges FROM spots LEFT JOIN (SELECT sample_id, spot_id, count(*) d FROM visium GROUP BY ALL) USING (sample_id, spot_id) GROUP BY sample_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = spots(spark, sf)
    return graph.degree_summary(s, graph.lattice(s))


@query("neighbor_mean", "SELECT s.sample_id, s.spot_id, round(coalesce(avg(n.x), 0), 6) AS x, round(coalesce(avg(n.y), 0), 6) AS y FROM spots s LEFT JOIN visium e ON s.sample_id = e.sample_id AND s.spot_id = e.spot_id LEFT JOIN spots n ON n.sample_id = e.sample_id AND n.spot_id = e.nbr_id GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = spots(spark, sf)
    return graph.neighbor_mean(s, graph.lattice(s), ["x", "y"]).select("sample_id", "spot_id", r6("x").alias("x"), r6("y").alias("y"))


@query("same_label_counts", "SELECT sample_id, spot_id, k, same, degree FROM same")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = labelled(spark, sf)
    n = graph.same_label_counts(s, graph.lattice(s), 5)
    return n.select("sample_id", "spot_id", F.posexplode("same").alias("k", "same"), "degree").withColumn("k", (F.col("k") + 1).cast("long"))


@query("potts_energy", "SELECT sample_id, spot_id, k, round(energy, 6) AS energy FROM energy")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = labelled(spark, sf)
    e = potts.energies(s, graph.lattice(s), 5, 1.5)
    return e.select("sample_id", "spot_id", F.posexplode("energy").alias("k", "e")).select("sample_id", "spot_id", (F.col("k") + 1).cast("long").alias("k"), r6("e").alias("energy"))


def _unary(s: DataFrame) -> DataFrame:
    """A made-up cost of each label: half its distance to the covariate modulo 5."""
    return s.withColumn("u", F.array(*[F.abs(F.lit(k) - F.col("covar") % 5) * 0.5 for k in range(5)]))


@query("icm_label_sweep", "SELECT sample_id, spot_id, CAST(min_by(k, (round(t, 9), k)) AS INTEGER) AS y, round(min(t), 6) AS energy FROM total GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    s = _unary(labelled(spark, sf))
    return potts.label_sweep(s, graph.lattice(s), 5, 1.5).select("sample_id", "spot_id", "y", r6("energy").alias("energy"))


def _resp(spark: SparkSession, sf: str) -> DataFrame:
    s = _unary(labelled(spark, sf))
    e = potts.energies(s, graph.lattice(s), 5, 1.5).join(s.select("sample_id", "spot_id", "u"), ["sample_id", "spot_id"])
    return potts.responsibilities(e.withColumn("t", F.zip_with("energy", "u", lambda a, b: a + b)))


@query("responsibilities", "SELECT sample_id, spot_id, k, round(resp, 6) AS resp, round(loglik, 6) AS loglik FROM resp")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _resp(spark, sf).select("sample_id", "spot_id", F.posexplode("resp").alias("k", "r"), "loglik").select("sample_id", "spot_id", (F.col("k") + 1).cast("long").alias("k"), r6("r").alias("resp"), r6("loglik").alias("loglik"))


@query("beta_grid", "SELECT sample_id, max_by(beta, (o, -beta)) AS beta, round(max(o), 6) AS objective FROM (SELECT sample_id, beta, -sum(resp * (lse + beta / 2 * (degree - same))) AS o FROM (SELECT r.*, beta, ln(sum(exp(-beta / 2 * (degree - same))) OVER (PARTITION BY sample_id, spot_id, beta)) AS lse FROM resp r CROSS JOIN (SELECT CAST(unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS DOUBLE) AS beta)) GROUP BY sample_id, beta) GROUP BY sample_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return potts.beta_grid(_resp(spark, sf), [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]).select("sample_id", "beta", r6("objective").alias("objective"))


@query("svg_projection_p", """SELECT sample_id, gene, round(n * (bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab) / syy, 6) AS stat,
  round(exp(-(n * (bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab) / syy) / (2 * (1 - sy * sy / n / syy))), 6) AS p FROM
  (SELECT kept.sample_id, gene, sum(cnt * fa) AS a, sum(cnt * fb) AS b, sum(cnt)::DOUBLE AS sy, sum(cnt * cnt)::DOUBLE AS syy FROM kept JOIN (SELECT sample_id, spot_id, col - avg(col) OVER (PARTITION BY sample_id) AS fa, "row" - avg("row") OVER (PARTITION BY sample_id) AS fb FROM spots SEMI JOIN kept_spots USING (sample_id, spot_id)) f USING (sample_id, spot_id) GROUP BY ALL)
  JOIN (SELECT sample_id, count(*) AS n, sum(fa * fa) AS aa, sum(fa * fb) AS ab, sum(fb * fb) AS bb FROM (SELECT sample_id, col - avg(col) OVER (PARTITION BY sample_id) AS fa, "row" - avg("row") OVER (PARTITION BY sample_id) AS fb FROM spots SEMI JOIN kept_spots USING (sample_id, spot_id)) GROUP BY ALL) USING (sample_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = stored(counts(spark, sf))
    spot_ok = stored(qc.spot_filter(c, 20))
    s = spots(spark, sf).join(spot_ok.select("sample_id", "spot_id").distinct(), ["sample_id", "spot_id"], "left_semi")
    k = qc.gene_filter(spot_ok, 20)
    return genes.projection_p(*genes.projection_sums(k, genes.kernel_features(s), 1)).select("sample_id", "gene", r6("stat").alias("stat"), r6("p").alias("p"))


def _erfc_sql(x: str) -> str:
    """The complementary error function: its series below 2, a continued fraction above."""
    series = f"list_sum(list_transform(range(0, 60), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * pow({x}, 2 * i + 1) / (gamma(i + 1) * (2 * i + 1))))"
    fraction = f"list_reduce(list_concat([{x}], CAST(range(150, 0, -1) AS DOUBLE[])), lambda acc, k: {x} + k / 2 / acc)"
    return f"CASE WHEN {x} < 2 THEN 1 - 2 / sqrt(pi()) * {series} ELSE exp(-{x} * {x}) / sqrt(pi()) / {fraction} END"


def _svg_sql(places: str = "spots") -> str:
    """The combined test of all eleven pairs of features by SQL over every spot, with its adjusted ranks."""
    pairs = [("a", "b")]
    for i in range(1, 6):
        pairs += [(f"exp(-a * a / (2 * qa[{i}] * qa[{i}]))", f"exp(-b * b / (2 * qb[{i}] * qb[{i}]))"), (f"cos(2 * pi() * a / qa[{i}])", f"cos(2 * pi() * b / qb[{i}])")]
    flat = [x for p in pairs for x in p]
    n, each = len(flat), range(len(pairs))
    det = [f"(aa{k} * bb{k} - ab{k} * ab{k})" for k in each]
    two = [f"{det[k]} > 1e-9 * aa{k} * bb{k}" for k in each]
    full = [f"(bb{k} * s{2 * k} * s{2 * k} - 2 * ab{k} * s{2 * k} * s{2 * k + 1} + aa{k} * s{2 * k + 1} * s{2 * k + 1}) / {det[k]}" for k in each]
    single = [f"CASE WHEN aa{k} >= bb{k} THEN s{2 * k} * s{2 * k} / aa{k} ELSE s{2 * k + 1} * s{2 * k + 1} / bb{k} END" for k in each]
    rank = [f"CASE WHEN {two[k]} THEN 2 WHEN greatest(aa{k}, bb{k}) > 1e-18 * n THEN 1 ELSE 0 END" for k in each]
    stat = [f"CASE r{k} WHEN 2 THEN {full[k]} WHEN 1 THEN {single[k]} END * n / syy / l" for k in each]
    p = [f"CASE r{k} WHEN 2 THEN exp(-x{k} / 2) WHEN 1 THEN {_erfc_sql(f'sqrt(x{k} / 2)')} END" for k in each]
    most = "CASE WHEN used > 1 THEN 1 - 1.0::DOUBLE / used ELSE 1 END"
    terms = [f"CASE WHEN r{k} > 0 AND l > 0 THEN CASE WHEN p{k} < 1e-15 THEN 1 / (greatest(p{k}, 1e-300) * pi()) ELSE tan((0.5 - least(p{k}, {most})) * pi()) END ELSE 0 END" for k in each]
    return f"""SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY p_adj, p, gene) AS rank, round(p_adj, 6) AS p_adj FROM (WITH
  s0 AS (SELECT sample_id, spot_id, col - avg(col) OVER (PARTITION BY sample_id) AS a, "row" - avg("row") OVER (PARTITION BY sample_id) AS b FROM {places} SEMI JOIN kept USING (sample_id, spot_id)),
  q AS (SELECT sample_id, quantile_cont(abs(a), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qa0, quantile_cont(abs(b), [0.2, 0.4, 0.6, 0.8, 1.0]) AS qb0 FROM s0 GROUP BY sample_id),
  q1 AS (SELECT sample_id, list_transform(qa0, lambda x: greatest(x, 1e-12)) AS qa, list_transform(qb0, lambda x: greatest(x, 1e-12)) AS qb FROM q),
  f0 AS (SELECT sample_id, spot_id, {", ".join(f"{x} AS f{i}" for i, x in enumerate(flat))} FROM s0 JOIN q1 USING (sample_id)),
  f AS (SELECT sample_id, spot_id, {", ".join(f"f{i} - avg(f{i}) OVER (PARTITION BY sample_id) AS f{i}" for i in range(n))} FROM f0),
  g AS (SELECT kept.sample_id, gene, {", ".join(f"sum(cnt * f{i}) AS s{i}" for i in range(n))}, sum(cnt)::DOUBLE AS sy, sum(cnt * cnt)::DOUBLE AS syy FROM kept JOIN f USING (sample_id, spot_id) GROUP BY ALL),
  m AS (SELECT sample_id, count(*) AS n, {", ".join(f"sum(f{2 * k} * f{2 * k}) AS aa{k}, sum(f{2 * k} * f{2 * k + 1}) AS ab{k}, sum(f{2 * k + 1} * f{2 * k + 1}) AS bb{k}" for k in each)} FROM f GROUP BY sample_id),
  j0 AS (SELECT g.*, m.* EXCLUDE (sample_id), 1 - sy * sy / n / syy AS l, {", ".join(f"{x} AS r{k}" for k, x in enumerate(rank))} FROM g JOIN m USING (sample_id)),
  j1 AS (SELECT *, {", ".join(f"{x} AS x{k}" for k, x in enumerate(stat))}, {" + ".join(f"CAST(r{k} > 0 AS INT)" for k in each)} AS used FROM j0),
  j AS (SELECT *, {", ".join(f"{x} AS p{k}" for k, x in enumerate(p))} FROM j1),
  t AS (SELECT sample_id, gene, used, ({" + ".join(terms)}) / greatest(used, 1) AS t FROM j),
  p AS (SELECT sample_id, gene, CASE WHEN used = 0 THEN 1 WHEN t > 1e15 THEN 1 / (t * pi()) ELSE 0.5 - atan(t) / pi() END AS p FROM t),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p, gene) AS i, count(*) OVER (PARTITION BY sample_id) AS g FROM p),
  h AS (SELECT *, sum(1.0::DOUBLE / i) OVER (PARTITION BY sample_id) AS h FROM r)
  SELECT sample_id, gene, p, least(1.0, min(p * g * h / i) OVER (PARTITION BY sample_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM h)"""


@query("svg_rank", _svg_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = kept(spark, sf)
    found = genes.svg_rank(k, spots(spark, sf).join(k.select("sample_id", "spot_id").distinct(), ["sample_id", "spot_id"], "left_semi"))
    return found.withColumn("p_adj", r6("p_adj"))


#: The same spots in one row of places a sample.
LINE = "(SELECT sample_id, spot_id, 0.0::DOUBLE AS \"row\", CAST(CAST(spot_id AS BIGINT) // 5 AS DOUBLE) AS col FROM spots)"


@query("svg_rank_line", _svg_sql(LINE))
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = kept(spark, sf)
    line = spots(spark, sf).select("sample_id", "spot_id", F.lit(0.0).alias("row"), F.floor(F.col("spot_id").cast("long") / 5).cast("double").alias("col"))
    return genes.svg_rank(k, line.join(k.select("sample_id", "spot_id").distinct(), ["sample_id", "spot_id"], "left_semi")).withColumn("p_adj", r6("p_adj"))


@query("hvg_moments", "SELECT sample_id, gene, round(sum(cnt) / n, 6) AS mean, round((sum(cnt * cnt) - n * (sum(cnt) / n) ** 2) / (n - 1), 6) AS var, count(*) AS nnz FROM kept JOIN (SELECT sample_id, count(DISTINCT spot_id) n FROM kept GROUP BY sample_id) USING (sample_id) GROUP BY sample_id, gene, n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = kept(spark, sf)
    n = k.select("sample_id", "spot_id").distinct().groupBy("sample_id").agg(F.count("*").alias("n"))
    return genes.moments(k, n).select("sample_id", "gene", r6("mean").alias("mean"), r6("var").alias("var"), "nnz")


@query("hvg_rank")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.hvg_rank(kept(spark, sf))


@query("gene_rank", "SELECT sample_id, gene, rank FROM ranked WHERE rank <= 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.top_genes(ranked(spark, sf), 50)


@query("common_genes", "SELECT gene, gene_idx FROM (SELECT gene, row_number() OVER (ORDER BY votes <= cut, CASE WHEN votes > cut THEN 0 ELSE -votes END, CASE WHEN votes > cut THEN 0 ELSE median END, k, r) AS gene_idx FROM (SELECT *, coalesce((SELECT votes FROM (SELECT gene, count(*) AS votes FROM ranked SEMI JOIN (SELECT gene FROM ranked WHERE rank <= 60) f USING (gene) SEMI JOIN (SELECT gene FROM (SELECT sample_id, gene FROM kept GROUP BY ALL HAVING sum(cnt) > 0) GROUP BY gene HAVING count(*) = 5) c USING (gene) GROUP BY gene ORDER BY votes DESC) OFFSET 59 LIMIT 1), 0) AS cut FROM (SELECT gene, min((CAST(sample_id AS INT), rank))[1] AS k, min((CAST(sample_id AS INT), rank))[2] AS r FROM ranked WHERE rank <= 60 GROUP BY gene) SEMI JOIN (SELECT gene FROM (SELECT sample_id, gene FROM kept GROUP BY ALL HAVING sum(cnt) > 0) GROUP BY gene HAVING count(*) = 5) c USING (gene) JOIN (SELECT gene, count(*) AS votes, median(rank) AS median FROM ranked GROUP BY gene) USING (gene))) WHERE gene_idx <= 60")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.common_genes(ranked(spark, sf), kept(spark, sf), 60)


@query("user_gene_list", "SELECT gene, row_number() OVER (ORDER BY pos) AS gene_idx FROM (SELECT gene, row_number() OVER (ORDER BY gene DESC) AS pos FROM (SELECT DISTINCT gene FROM counts)) SEMI JOIN (SELECT gene FROM kept GROUP BY gene HAVING count(DISTINCT sample_id) = 5) k USING (gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    listed = counts(spark, sf).select("gene").distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.desc("gene"))))
    return genes.user_gene_list(kept(spark, sf), listed)


@query("dropped_genes", "SELECT DISTINCT gene FROM counts ANTI JOIN (SELECT gene FROM kept GROUP BY gene HAVING count(DISTINCT sample_id) = 5) k USING (gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    listed = counts(spark, sf).select("gene").distinct().withColumn("pos", F.lit(1))
    return genes.dropped_genes(kept(spark, sf), listed)


@query("list_size", "SELECT CAST(least(150, min(c)) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM ranked GROUP BY sample_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.lit(genes.list_size(ranked(spark, sf), 150)).cast("long").alias("n"))


@query("preprocess")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return genes.preprocess(counts(spark, sf), spots(spark, sf), gene_number=120)[0]


_LISTED = "listed AS (SELECT gene, row_number() OVER (ORDER BY pos) AS gene_idx FROM (SELECT gene, row_number() OVER (ORDER BY gene DESC) AS pos FROM (SELECT DISTINCT gene FROM counts WHERE gene LIKE 'Brand#1%')) SEMI JOIN (SELECT gene FROM kept GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM kept)) k USING (gene))"


@query("preprocess_user_list", f"""SELECT sample_id, spot_id, gene, gene_idx, cnt, round(ln(1 + 1e4 * cnt / sum(cnt) OVER (PARTITION BY sample_id, spot_id)), 6) AS value FROM (WITH {_LISTED},
  own AS (SELECT kept.*, gene_idx FROM kept JOIN listed USING (gene)),
  spots15 AS (SELECT * FROM own SEMI JOIN (SELECT sample_id, spot_id FROM own GROUP BY ALL HAVING count(*) FILTER (cnt > 0) > 5) USING (sample_id, spot_id))
  SELECT * FROM spots15 SEMI JOIN (SELECT sample_id, gene FROM spots15 GROUP BY ALL HAVING count(*) FILTER (cnt > 0) > 5) USING (sample_id, gene))""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    listed = counts(spark, sf).where("gene LIKE 'Brand#1%'").select("gene").distinct().withColumn("pos", F.row_number().over(Window.orderBy(F.desc("gene"))))
    done = genes.preprocess(counts(spark, sf), spots(spark, sf), genes=listed, post=(5, 5))[0]
    return done.select("sample_id", "spot_id", "gene", "gene_idx", "cnt", r6("value").alias("value"))


@query("build_graph_number", OWN_SQL["knn_graph"].replace("(a.x - b.x) ** 2 + (a.y - b.y) ** 2", '(a.col - b.col) ** 2 + (a."row" - b."row") ** 2').replace("r <= 6", "r <= 4"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_graph(spots(spark, sf), "fixed_number", number=4)


@query("build_graph_radius", OWN_SQL["radius_graph"].replace("(a.x - b.x) ** 2 + (a.y - b.y) ** 2", '(a.col - b.col) ** 2 + (a."row" - b."row") ** 2').replace("< 8", "< 3"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_graph(spots(spark, sf), "fixed_distance", "other", 3.0)


ARI = "SELECT {by} CASE WHEN (ai + bj) / 2 = ai * bj / t THEN 1.0 ELSE round((nij - ai * bj / t) / ((ai + bj) / 2 - ai * bj / t), 6) END AS ari FROM (SELECT {by} sum(n * (n - 1) / 2) AS nij, sum(n) * (sum(n) - 1) / 2 AS t FROM c GROUP BY ALL) {j1} (SELECT {by} sum(n * (n - 1) / 2) AS ai FROM (SELECT {by} label, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL) {j2} (SELECT {by} sum(n * (n - 1) / 2) AS bj FROM (SELECT {by} covar, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL) {j3}"


@query("ari", "SELECT * FROM (WITH c AS (SELECT label, covar, count(*)::DOUBLE AS n FROM spots GROUP BY ALL) " + ARI.format(by="", j1="CROSS JOIN", j2="CROSS JOIN", j3="") + ")")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.adjusted_rand(spots(spark, sf), "label", "covar").select(r6("ari").alias("ari"))


@query("ari_by_sample", "SELECT * FROM (WITH c AS (SELECT sample_id, label, covar, count(*)::DOUBLE AS n FROM spots GROUP BY ALL) " + ARI.format(by="sample_id,", j1="JOIN", j2="USING (sample_id) JOIN", j3="USING (sample_id)") + ")")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.adjusted_rand(spots(spark, sf), "label", "covar", ["sample_id"]).select("sample_id", r6("ari").alias("ari"))


@query("cluster_batch_cube", "SELECT label AS cluster, sample_id AS batch, count(*) AS n FROM spots GROUP BY CUBE (label, sample_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cluster_batch_cube(spots(spark, sf).select(F.col("label").alias("cluster"), F.col("sample_id").alias("batch")))


@query("dataset_rollup", "SELECT sample_id, count(DISTINCT (sample_id, spot_id)) AS n_spots, count(DISTINCT gene) AS n_genes, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY ROLLUP (sample_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.dataset_rollup(counts(spark, sf))


@query("top_markers", "SELECT cluster, gene, pct, rank FROM (SELECT cluster, gene, round(pct, 6) AS pct, rank() OVER (PARTITION BY cluster ORDER BY round(pct, 6) DESC) AS rank FROM dots) WHERE rank <= 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = display.dot_summary(expr(spark, sf), clusters(spark, sf)).select("cluster", "gene", r6("pct").alias("pct"))
    return markers.top_n(d, "cluster", "pct", 10)


#: Rows in the order of a hash that both engines have.
BY_HASH = "md5(concat_ws('|', '1', sample_id, spot_id)), sample_id, spot_id"


@query("downsample", f"SELECT sample_id, spot_id, cluster FROM (SELECT sample_id, spot_id, label AS cluster, row_number() OVER (PARTITION BY label ORDER BY {BY_HASH}) AS r FROM spots) WHERE r <= 40")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return markers.downsample(clusters(spark, sf), "cluster", 40)


def by_place(spots: DataFrame) -> DataFrame:
    """Spots with their place as the barcode, which repeats over samples."""
    return spots.withColumn("spot_id", F.concat_ws("x", F.col("row").cast("long").cast("string"), F.col("col").cast("long").cast("string")))


BY_PLACE = "(SELECT * EXCLUDE (spot_id), CAST(CAST(\"row\" AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(col AS BIGINT) AS VARCHAR) AS spot_id FROM spots)"


@query("sample_rate", f"SELECT sample_id, spot_id FROM (SELECT *, row_number() OVER (ORDER BY {BY_HASH}) AS r, count(*) OVER () AS n FROM {BY_PLACE}) WHERE r <= floor(0.3 * n)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return markers.sample_rate(by_place(spots(spark, sf)), 0.3).select("sample_id", "spot_id")


@query("scale_genes", "SELECT sample_id, spot_id, gene, round(scaled, 6) AS scaled FROM scaled")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.scale_genes(expr(spark, sf)).select("sample_id", "spot_id", "gene", r6("scaled").alias("scaled"))


@query("feature_quantile", "SELECT gene, round(quantile_cont(scaled, 0.5), 6) AS midpoint FROM scaled GROUP BY gene")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.feature_quantile(expr(spark, sf)).select("gene", r6("midpoint").alias("midpoint"))


@query("dot_summary", "SELECT cluster, gene, round(mean, 6) AS mean, round(pct, 6) AS pct, round(CASE WHEN sd > 0 THEN least(greatest((v - m) / sd, 0), 1) ELSE 0 END, 6) AS scaled FROM (SELECT *, avg(v) OVER (PARTITION BY gene) AS m, stddev_samp(v) OVER (PARTITION BY gene) AS sd FROM (SELECT *, ln(1 + mean) AS v FROM dots))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.dot_summary(expr(spark, sf), clusters(spark, sf)).select("cluster", "gene", r6("mean").alias("mean"), r6("pct").alias("pct"), r6("scaled").alias("scaled"))


@query("heatmap_rows", f"SELECT label AS cluster, sample_id, spot_id, gene, round(scaled, 6) AS scaled FROM scaled JOIN (SELECT sample_id, spot_id, label FROM spots QUALIFY row_number() OVER (PARTITION BY label ORDER BY {BY_HASH}) <= 40) USING (sample_id, spot_id) SEMI JOIN (SELECT gene FROM ranked WHERE rank <= 10) g USING (gene)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ranked(spark, sf).where("rank <= 10").select("gene").distinct()
    return display.heatmap_rows(expr(spark, sf), clusters(spark, sf), chosen, 40).withColumn("scaled", r6("scaled"))


@query("rgb_display", "SELECT sample_id, spot_id, '#' || " + " || ".join(f"printf('%02X', CAST(floor((CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0 END) * 255 + 0.5) AS BIGINT))" for c in ("x", "y", "col")) + " AS rgb FROM spots WINDOW w AS (PARTITION BY sample_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.rgb_display(spots(spark, sf), ("x", "y", "col")).select("sample_id", "spot_id", "rgb")


@query("scatter_codes", "SELECT sample_id, spot_id, \"row\", col, label, dense_rank() OVER (ORDER BY label) AS code FROM spots")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.scatter_codes(spots(spark, sf), "label").select("sample_id", "spot_id", "row", "col", "label", "code")


@query("box_summary", "SELECT name, round(mn, 6) AS min, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(mx, 6) AS max, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM (SELECT *, min(v) OVER w AS mn, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.5) OVER w AS q2, quantile_cont(v, 0.75) OVER w AS q3, max(v) OVER w AS mx FROM (SELECT 'x' AS name, x AS v FROM spots UNION ALL SELECT 'y', y FROM spots UNION ALL SELECT 'covar', covar FROM spots) WINDOW w AS (PARTITION BY name)) GROUP BY name, mn, q1, q2, q3, mx")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return display.box_summary(spots(spark, sf), ["x", "y", "covar"]).select("name", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max", "low", "high")])


MARKER_SQL = """SELECT cluster, gene, round(round(p1 / n1, 3), 6) AS pct1, round(round((pos - p1) / (n - n1), 3), 6) AS pct2, round(log2(e1 / n1 + 1) - log2((e - e1) / (n - n1) + 1), 6) AS avg_log2fc,
  round((u - sign(u) * 0.5) / sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))), 6) AS z FROM (
  SELECT *, r - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0 AS u FROM (
    SELECT cluster, gene, sum(mid) AS r, count(*)::DOUBLE AS n1, count(*) FILTER (value > 0)::DOUBLE AS p1, sum(exp(value) - 1) AS e1,
      any_value(n)::DOUBLE AS n, any_value(pos)::DOUBLE AS pos, any_value(e) AS e FROM (
      SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS mid,
        count(*) OVER (PARTITION BY gene) AS n, count(*) FILTER (value > 0) OVER (PARTITION BY gene) AS pos, sum(exp(value) - 1) OVER (PARTITION BY gene) AS e
      FROM (SELECT label AS cluster, gene, coalesce(value, 0) AS value FROM spots CROSS JOIN (SELECT DISTINCT gene FROM expr) LEFT JOIN expr USING (sample_id, spot_id, gene)))
    GROUP BY cluster, gene))
  JOIN (SELECT gene, sum(t ** 3 - t)::DOUBLE AS ties FROM (SELECT gene, value, count(*)::DOUBLE AS t FROM (SELECT gene, coalesce(value, 0) AS value FROM spots CROSS JOIN (SELECT DISTINCT gene FROM expr) LEFT JOIN expr USING (sample_id, spot_id, gene)) GROUP BY ALL) GROUP BY gene) USING (gene)"""


@query("marker_stats", MARKER_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return markers.rank_sums(expr(spark, sf), clusters(spark, sf)).select("cluster", "gene", r6("pct1").alias("pct1"), r6("pct2").alias("pct2"), r6("avg_log2fc").alias("avg_log2fc"), r6("z").alias("z"))


def _markers_sql() -> str:
    """The same statistics with two-sided normal p-values."""
    z = "(u - sign(u) * 0.5) / sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - ties / (n * (n - 1.0))))"
    inner = MARKER_SQL.replace(f"round({z}, 6) AS z", f"{z} AS z").replace("round(log2(e1 / n1 + 1) - log2((e - e1) / (n - n1) + 1), 6) AS avg_log2fc", "log2(e1 / n1 + 1) - log2((e - e1) / (n - n1) + 1) AS avg_log2fc")
    x = "(abs(z) / sqrt(2))"
    p = _erfc_sql(x)
    return f"SELECT cluster, gene, pct1, pct2, round(avg_log2fc, 6) AS avg_log2fc, round(z, 6) AS z, round(p, 6) AS p, round(least(1, p * (SELECT count(DISTINCT gene) FROM expr)), 6) AS p_adj FROM (SELECT *, {p} AS p FROM ({inner})) WHERE greatest(pct1, pct2) >= 0.05 AND avg_log2fc >= 0 AND p < 0.5"


@query("markers", _markers_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    d = markers.markers(expr(spark, sf), clusters(spark, sf), min_pct=0.05, min_log2fc=0.0, max_p=0.5)
    return d.select("cluster", "gene", "pct1", "pct2", *[r6(c).alias(c) for c in ("avg_log2fc", "z", "p", "p_adj")])


@query("markers_corrected", MARKER_SQL.replace("spots CROSS JOIN (SELECT DISTINCT gene FROM expr) LEFT JOIN expr USING (sample_id, spot_id, gene)", "spots JOIN corrected USING (sample_id, spot_id)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    done, listed, own = iterative.corrected(spark, sf, "label")
    values = correct.long_values(done, listed, ["label"]).withColumnRenamed("label", "cluster")
    return markers.rank_sums(values, own.withColumnRenamed("label", "cluster"), values=own.count() * listed.count()).select("cluster", "gene", *[r6(c).alias(c) for c in ("pct1", "pct2", "avg_log2fc", "z")])


for _name, (_run, _sql) in iterative.QUERIES.items():
    query(_name, _sql)(_run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocess, graph, a short fit, and the sizes of its clusters in each sample."""
    return iterative.flagship(spark, sf_dir)
