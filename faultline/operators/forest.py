"""A random forest over the presence of tokens, grown from counts: no row is ever as wide as the vocabulary."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.sources.tables import kept

DEPTH = 5


@dataclass
class Node:
    """The weights of both labels; a node that is split has a token and a child without it and one with it."""

    stats: tuple[float, float]
    word: int | None = None
    without: Node | None = None
    having: Node | None = None

    @property
    def label(self) -> int:
        return int(self.stats[1] > self.stats[0])

    @property
    def share(self) -> float:
        return self.stats[1] / sum(self.stats) if sum(self.stats) else 0.0

    def pruned(self) -> Node:
        """Without splits whose sides give the same label."""
        if self.word is None:
            return self
        a, b = self.without.pruned(), self.having.pruned()
        return Node(self.stats) if a.word is None and b.word is None and a.label == b.label else Node(self.stats, self.word, a, b)


def _impurity(stats: tuple[float, float]) -> float:
    total = sum(stats)
    return 1 - sum((x / total) ** 2 for x in stats) if total else 0.0


def _gain(parent: tuple[float, float], having: tuple[float, float]) -> float:
    without = tuple(p - h for p, h in zip(parent, having, strict=True))
    parts = sum(sum(x) * _impurity(x) for x in (without, having))
    return _impurity(parent) - parts / sum(parent)


def _walk(node: Node, has, leaf) -> Column:
    """The value of ``leaf`` where a row ends."""
    return leaf(node) if node.word is None else F.when(has(node.word), _walk(node.having, has, leaf)).otherwise(_walk(node.without, has, leaf))


def _bag(u: Column) -> Column:
    """How often a row is drawn, of a uniform number: Poisson with mean 1."""
    at, limits = 0.0, []
    for k in range(10):
        at += math.exp(-1) / math.factorial(k)
        limits.append(at)
    return sum(((u >= x).cast("long") for x in limits), F.lit(0).cast("long"))


class Forest(Transformer):
    """Adds ``probability`` and ``prediction`` from ``tokens``: the mean of the trees' shares of label 1."""

    def __init__(self, trees: list[Node], vocabulary: list[str]):
        super().__init__()
        self.trees, self.vocabulary = trees, vocabulary

    def _transform(self, dataset: DataFrame) -> DataFrame:
        has = lambda w: F.array_contains("tokens", self.vocabulary[w])
        shares = [_walk(t, has, lambda n: F.lit(n.share)) for t in self.trees]
        step = dataset.withColumn("_p", sum(shares[1:], shares[0]) / len(shares))
        return step.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), "_p")), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")


def grown_forest(rows: DataFrame, vocabulary: list[str], weights: tuple[float, float], label: str, trees: int, seed: int) -> Forest:
    """A forest of ``rows`` (label, counts as sparse vectors): per tree rows are drawn anew, per node as many tokens as the root of their number.

    Rows with the same tokens and label are one, with the times that each tree draws them;
    every level is one pass over these, which counts what its nodes' tokens tell apart.
    """
    spark, chance = rows.sparkSession, random.Random(seed)
    # A sparse vector reads "(size,[places],[values])".
    places = F.split(F.regexp_extract(F.col("counts").cast("string"), r"\[([^\]]*)\]", 1), ",")
    ids = F.transform(F.filter(places, lambda x: x != ""), lambda x: x.cast("int"))
    drawn = rows.select(ids.alias("ids"), F.col(label).cast("int").alias("y"), *[F.rand(seed + k).alias(f"u{k}") for k in range(trees)])
    bags = kept(drawn.groupBy("ids", "y").agg(*[F.sum(_bag(F.col(f"u{k}"))).alias(f"b{k}") for k in range(trees)]), "bags")
    sums = bags.groupBy("y").agg(*[F.sum(f"b{k}") for k in range(trees)]).collect()
    of = {r["y"]: r[1:] for r in sums}
    roots = [Node(tuple(weights[y] * of[y][k] if y in of else 0.0 for y in (0, 1))) for k in range(trees)]
    wide, level = min(len(vocabulary), math.ceil(math.sqrt(len(vocabulary)))), list(enumerate(roots))
    for _ in range(DEPTH):
        level = [(k, n) for k, n in level if _impurity(n.stats) > 0]
        asked = [(p, w) for p in range(len(level)) for w in chance.sample(range(len(vocabulary)), wide)]
        if not asked:
            break
        number = {id(n): p for p, (_, n) in enumerate(level)}
        has = lambda w: F.array_contains("ids", w)
        at = lambda k: _walk(roots[k], has, lambda n: F.lit(number.get(id(n), -1)))
        stood = bags.select("ids", "y", F.explode(F.array(*[F.struct(at(k).alias("node"), F.col(f"b{k}").alias("times")) for k in range(trees)])).alias("e")).where("e.node >= 0 AND e.times > 0")
        seen = stood.select("y", "e.node", "e.times", F.explode("ids").alias("word"))
        # At most trees x 2^DEPTH x the root of the vocabulary.
        counted = seen.join(F.broadcast(spark.createDataFrame(asked, "node int, word int")), ["node", "word"]).groupBy("node", "word").agg(*[F.sum(F.when(F.col("y") == y, F.col("times")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
        best: dict[int, tuple[float, int, tuple[float, float]]] = {}
        for r in counted.collect():
            having = (weights[0] * r["n0"], weights[1] * r["n1"])
            told = (_gain(level[r["node"]][1].stats, having), -r["word"], having)
            best[r["node"]] = max(best.get(r["node"], (0.0, 0, having)), told)
        below = []
        for p, (gain, word, having) in sorted(best.items()):
            k, node = level[p]
            if gain > 1e-12:
                node.word, node.having = -word, Node(having)
                node.without = Node(tuple(max(0.0, a - b) for a, b in zip(node.stats, having, strict=True)))
                below += [(k, node.without), (k, node.having)]
        level = below
    return Forest([r.pruned() for r in roots], vocabulary)
