"""Quality rules by isolation forests over rule statistics.

1. One pass of Arrow batches counts the rule statistics of every whole text: words, their characters, symbols, repeated lines,
   words in repeated windows of three, lines, words without a letter. What follows reads these numbers only.
2. Isolation forests are grown over all documents, one for each family of rules: an isolation tree cuts a random statistic at
   a random place until points are alone, and points that few cuts isolate are unusual. All documents together weigh as much
   as ``points`` points in each tree, as many documents of one kind would hide each other in a large one. All trees grow a
   level at a time: a pass finds the least and largest statistics and the number of the documents in each open node, in tasks
   and then by a grouped aggregate, and the driver makes the cuts; it gets a row a node and statistic. A document's score is
   2^-(mean path / expected path), from 0 to 1.
3. Thresholds come from all labelled rows: each family's is the lowest score above which at most ``good_loss`` of the rows
   labelled good lie (an exact order statistic), and it is used only if the rows labelled bad lie above it more often. A
   document is anomalous if a family's score is above the family's threshold.
4. Scoring is one pass over the numbers, without a shuffle; the forests have a fixed size.

Basic rules come first: a document of fewer than ``least_words`` words, or with over ``most_repeated`` percent of its words in
repeated windows, fails whatever its score.

Edge cases: NULL and empty texts have zeros and fail the basic rules; without labelled rows of both classes no threshold is set
and only basic rules apply; equal rows get equal scores, and a document at a threshold is kept; repeated rows are judged each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import order_statistics
from .common import add_columns, checkpointed, keyed_join, read


@dataclass(frozen=True)
class Settings:
    """``points`` is what all documents weigh in a tree together."""

    least_words: int = 50
    most_repeated: int = 50
    trees: int = 128
    points: int = 64
    good_loss: float = 0.004
    seed: int = 7


#: The statistics of a text, all whole numbers.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain"]
#: Families of rules, by the names of the shares in ``shares``.
FAMILIES = {"symbols": ["symbols"], "repeats": ["dup_lines", "repeats"], "shape": ["line_words", "plain"]}
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
#: ASCII characters that are neither letters nor white space, and the later bytes of others.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in SPACES)
LATER_BYTES = bytes(range(0x80, 0xC0))


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of a bounded number; a cut is at a space or a line's end."""
    start = 0
    while start < len(data):
        ends = [e for e in (data.find(b" ", start + block), data.find(b"\n", start + block)) if e >= 0]
        end = min(ends, default=len(data))
        yield data[start:end].split()
        start = end


def repeated_words(data: bytes) -> tuple[int, int]:
    """Words, and those in windows of three that the text has twice or more."""
    numbers: dict[bytes, int] = {}
    parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in word_blocks(data)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n, size = len(ids), len(numbers)
    if n < 4:
        return n, 0
    pair = ids[:-1] * size + ids[1:]
    if size**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return n, int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text. Words are runs of anything but ASCII white space; a plain word has no letter."""
    data = text.encode("utf-8", "replace") if text else b""
    if not data or data.isspace():
        return (0,) * len(COUNTS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    characters = len(data.translate(None, SPACES + LATER_BYTES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    with_letter = sum(map(len, word_blocks(data.translate(None, NO_LETTERS))))
    words, repeats = repeated_words(data)
    return words, characters, symbols, len(lines) - len(set(lines)), repeats, len(lines), words - with_letter


def shares(counts: np.ndarray) -> dict[str, np.ndarray]:
    """What the forests look at, from rows of ``COUNTS``."""
    n = {k: counts[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    words, lines = np.maximum(n["n_words"], 1), np.maximum(n["n_lines"], 1)
    return {
        "symbols": np.log1p(100 * n["n_symbols"] / words),
        "dup_lines": n["n_dup_lines"] / lines,
        "repeats": n["n_repeat_words"] / words,
        "line_words": np.log1p(n["n_words"] / lines),
        "plain": n["n_plain"] / words,
    }


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points; between whole numbers up to 3, where the formula starts, in proportion."""
    n = np.asarray(n, np.float64)
    many = np.maximum(n, 3)
    formula = lambda m: 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m
    return np.where(n < 3, np.interp(n, [1, 2, 3], [0, 1, formula(3.0)]), formula(many))


@dataclass(frozen=True)
class Tree:
    """Nodes by number: statistic (-1 at a leaf), place of the cut, children, and at a leaf the path's length."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for _ in range(64):
        column = tree.column[at]
        inner = column >= 0
        if not inner.any():
            break
        under = x[rows, column] < tree.cut[at]
        at = np.where(inner, np.where(under, tree.left[at], tree.right[at]), at)
    return at


def path_lengths(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The path's length of each row of ``x``."""
    return tree.path[leaves(tree, x)]


#: Of nodes: the least and the largest value of each statistic (by nodes), and the number of rows.
Ranges = tuple[np.ndarray, np.ndarray, np.ndarray]


def ranges(tree: Tree, x: np.ndarray, times: np.ndarray) -> Ranges:
    """The ranges of a tree's nodes over rows of ``x`` that occur ``times``; nodes without rows have none (infinite ends)."""
    at = leaves(tree, x)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[: len(ordered)]
    low, high = np.full((len(tree.column), x.shape[1]), np.inf), np.full((len(tree.column), x.shape[1]), -np.inf)
    if len(first):
        rows = x[order]
        low[ordered[first]], high[ordered[first]] = np.minimum.reduceat(rows, first), np.maximum.reduceat(rows, first)
    return low, high, np.bincount(at, times, len(tree.column)).astype(np.int64)


class Growing:
    """A tree that grows from the ranges of its open nodes; all rows together weigh as much as ``points``.

    A node is cut unless it weighs no more than a point, its rows are equal, or it is as deep as a balanced tree of the points.
    """

    def __init__(self, rng: np.random.Generator, points: int):
        self.rng, self.points = rng, points
        self.limit = int(np.ceil(np.log2(max(points, 2))))
        self.nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        self.depth, self.open, self.rows = [0], [0], 0

    @property
    def tree(self) -> Tree:
        return Tree(*(np.array(c) for c in zip(*self.nodes, strict=True)))

    def cut(self, k: int, found: Ranges) -> list[int]:
        """Cuts a node, unless it stays a leaf. Returns its children."""
        low, high, n = (a[k] for a in found)
        self.rows, depth = self.rows or int(n), self.depth[k]
        weight = float(n) * min(self.points, self.rows) / max(self.rows, 1)
        self.nodes[k][4] = depth + float(expected_path(weight))
        usable = np.flatnonzero(high > low)
        if depth >= self.limit or weight <= 1 or not len(usable):
            return []
        column = int(self.rng.choice(usable))
        place = max(float(self.rng.uniform(low[column], high[column])), float(np.nextafter(low[column], np.inf)))
        children = [len(self.nodes), len(self.nodes) + 1]
        self.nodes[k][:4] = column, place, *children
        self.nodes += [[-1, 0.0, c, c, 0.0] for c in children]
        self.depth += [depth + 1] * 2
        return children

    def advance(self, found: Ranges) -> None:
        """Goes on by a level: all open nodes, whose ranges are given, are cut."""
        self.open = [c for k in self.open for c in self.cut(k, found)]


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """An isolation tree of few points, a branch after the other."""
    growing, ones, stack = Growing(rng, len(x)), np.ones(len(x)), [0]
    while stack:
        stack += reversed(growing.cut(stack.pop(), ranges(growing.tree, x, ones)))
    return growing.tree


@dataclass(frozen=True)
class Forest:
    names: list[str]
    trees: list[Tree]
    points: int

    def scores(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Anomaly scores of rows, 0 to 1."""
        matrix = np.stack([x[k] for k in self.names], 1)
        total = np.zeros(len(matrix))
        for t in self.trees:
            total += path_lengths(t, matrix)
        return 2.0 ** -(total / max(len(self.trees), 1) / max(float(expected_path(self.points)), 1e-9))


@dataclass(frozen=True)
class Model:
    """Forests and thresholds by family; a family without a threshold judges nothing."""

    forests: dict[str, Forest] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def anomalous(self, counts: np.ndarray) -> np.ndarray:
        x, out = shares(counts), np.zeros(len(counts), bool)
        for name, most in self.thresholds.items():
            out |= self.forests[name].scores(x) > most
        return out


def count_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``COUNTS``."""

    def start() -> Callable[[list], list]:
        return lambda texts: [list(c) for c in zip(*map(statistics, texts), strict=True)] if texts else [[] for _ in COUNTS]

    return add_columns(docs, text, dict.fromkeys(COUNTS, "long"), start, keep)


def base_failed(s: Settings) -> F.Column:
    """Whether the basic rules fail a row of ``COUNTS``."""
    return (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.most_repeated * F.col("n_words"))


def grow_forests(counted: DataFrame, s: Settings = Settings()) -> dict[str, Forest]:
    """Forests of all families over all rows of ``counted (COUNTS)``, a pass a level."""
    spark, names = counted.sparkSession, [f for f in FAMILIES for _ in range(s.trees)]
    growing = [Growing(np.random.default_rng([s.seed, k]), s.points) for k in range(len(names))]
    while any(g.open for g in growing):
        shared = spark.sparkContext.broadcast([(k, names[k], g.tree, np.array(g.open)) for k, g in enumerate(growing) if g.open])

        def measure(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found: dict[int, Ranges] = {}
            for b in batches:
                x = shares(np.stack([b.column(i).to_numpy() for i in range(len(COUNTS))], 1))
                own = {f: np.unique(np.stack([x[c] for c in columns], 1), axis=0, return_counts=True) for f, columns in FAMILIES.items()}
                for k, family, tree, _ in shared.value:
                    low, high, n = ranges(tree, *own[family])
                    if k in found:
                        low, high, n = np.minimum(low, found[k][0]), np.maximum(high, found[k][1]), n + found[k][2]
                    found[k] = low, high, n
            for k, _, _, open_ in shared.value:
                if k in found:
                    low, high, n = (a[open_] for a in found[k])
                    node, column = (a.ravel() for a in np.indices(low.shape))
                    some = n[node] > 0
                    columns = [np.full(some.sum(), k), open_[node[some]], column[some], low.ravel()[some], high.ravel()[some], n[node[some]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tree", "node", "column", "low", "high", "n"])

        rows = counted.select(*COUNTS).mapInArrow(measure, "tree long, node long, column long, low double, high double, n long")
        got = rows.groupBy("tree", "node", "column").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
        tree, node, column, low, high, n = (got.column(c).to_numpy() for c in got.column_names)
        for k, g in enumerate(growing):
            if g.open:
                at, shape = tree == k, (len(g.nodes), len(FAMILIES[names[k]]))
                own = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(len(g.nodes), np.int64)
                own[0][node[at], column[at]], own[1][node[at], column[at]], own[2][node[at]] = low[at], high[at], n[at]
                g.advance(own)
        shared.unpersist()
    return {f: Forest(c, [g.tree for g, own in zip(growing, names, strict=True) if own == f], min(s.points, growing[0].rows)) for f, c in FAMILIES.items()}


def family_scores(rows: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """``(y, family, score)`` of the rows ``(y, COUNTS)``, each once a family."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def start() -> Callable[[list], list]:
        def work(x: list) -> list:
            own = shares(np.array(x, np.int64).reshape(-1, len(COUNTS)))
            return [f.scores(own).tolist() for f in shared.value.values()]

        return work

    scored = add_columns(rows.select("y", F.array(*COUNTS).alias("__counts")), "__counts", dict.fromkeys(forests, "double"), start, ["y"], rows=8192)
    pairs = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("score")) for f in forests])
    return scored.select("y", F.explode(pairs).alias("p")).select("y", "p.family", "p.score")


def fit(counted: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from all of ``counted (doc_id, COUNTS)`` and ``labels (doc_id, quality)``.

    An id labelled twice has the larger label. Rows that fail the basic rules teach nothing.
    """
    fine = counted.where(~base_failed(s))
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    labelled = checkpointed(keyed_join(fine, checkpointed(known), "doc_id").select("y", *COUNTS))
    if labelled.select("y").distinct().count() < 2:
        return Model()
    forests = grow_forests(fine, s)
    scores = checkpointed(family_scores(labelled, forests))
    rank = lambda n: F.array(n - 1 - F.floor(F.lit(s.good_loss) * n).cast("long"))
    most = {r["family"]: next(iter(r["found"].values())) for r in order_statistics(scores.where("y = 1"), ["family"], "score", rank).collect()}
    above = F.col("score") > F.coalesce(*[F.when(F.col("family") == f, F.lit(t)) for f, t in most.items()])
    bad = scores.where("y = 0").groupBy("family").agg(F.avg(above.cast("double")).alias("share")).collect()
    return Model(forests, {r["family"]: most[r["family"]] for r in bad if r["share"] > 5 * s.good_loss})


def judge(counted: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept``."""
    shared = counted.sparkSession.sparkContext.broadcast(model)
    rows = counted.select(*[c for c in counted.columns if c not in ("__odd", "base_failed", "kept")], F.array(*COUNTS).alias("__counts"))

    def start() -> Callable[[list], list]:
        return lambda x: [shared.value.anomalous(np.array(x, np.int64).reshape(-1, len(COUNTS))).tolist()]

    odd = add_columns(rows, "__counts", {"__odd": "boolean"}, start, [c for c in rows.columns if c != "__counts"], rows=8192)
    return odd.withColumn("base_failed", base_failed(s)).withColumn("kept", ~F.col("base_failed") & ~F.col("__odd")).drop("__odd")


def apply_rules(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, COUNTS, base_failed, kept)`` of every row of ``docs (doc_id, text)``."""
    counted = checkpointed(count_statistics(docs.select("doc_id", "text"), keep=["doc_id"]))
    return judge(counted, fit(counted, labels, s), s)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule statistics and verdict, thresholds from the labels of quality."""
    found = apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept")
