"""Retrieval over stored rows: vectors, words, and both, as plans that end in a top-k without a full sort."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Ascending for all metrics but `ip`, whose scores fall."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    return {"l2": l2, "ip": dot}[metric](a, b)


def vector(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def knn(rows: DataFrame, column: str, query: Column, k: int, metric: str = "cosine", where: Column | None = None, tie: str = "id") -> DataFrame:
    """The k nearest rows with `distance`, rounded to 6 places; the filter comes first, ties go by `tie`."""
    rows = rows if where is None else rows.where(where)
    d = F.round(distance(F.col(column), query, metric), 6)
    return rows.withColumn("distance", d).orderBy(F.col("distance").desc() if metric == "ip" else F.col("distance").asc(), tie).limit(k)


def maxsim(query: Column, doc: Column) -> Column:
    """Of two multi-vectors: the sum over the query's vectors of the largest dot product with one of the document's."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def ivf_cells(rows: DataFrame, column: str, lists: int, seed: int = 1, sample: int = 20000):
    """A k-means of at most `sample` rows, for an inverted file: rows with their `cell`, and the model. Every row has one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    with_vectors = rows.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    few = with_vectors.orderBy(F.xxhash64(column)).limit(sample)
    model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="cell").fit(few)
    return model.transform(with_vectors).drop("_v"), model


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms_of(query: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", query.lower()) if w]


def match_any(text: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(words(text), F.lit(terms))


def match_all(text: Column, terms: list[str]) -> Column:
    return F.size(F.array_except(F.lit(terms), words(text))) == 0


def match_phrase(text: Column, phrase: str) -> Column:
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return F.contains(padded, F.lit(f" {' '.join(terms_of(phrase))} "))


def term_count(text: Column, terms: list[str]) -> Column:
    return F.size(F.filter(words(text), lambda w: w.isin(*terms))).cast("bigint")


def equals(term: str):
    return lambda w: w == F.lit(term)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of documents with any of the terms. Documents' lengths and terms' document counts come from one
    aggregation over all documents, which gives one row; nothing of a document is shuffled."""
    counted = docs.select(key, F.size(words(F.col(text))).alias("n"), *[F.size(F.filter(words(F.col(text)), equals(t))).alias(f"f{i}") for i, t in enumerate(terms)])
    s = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.lit(float(s.docs)) - (s[f"d{i}"] or 0) + 0.5) / ((s[f"d{i}"] or 0) + 0.5))
        f = F.col(f"f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.lit(float(s.mean or 1))))
    some = reduce(or_, [F.col(f"f{i}") > 0 for i in range(len(terms))])
    return counted.where(some).select(key, F.round(score, 6).alias("score"))


def rrf(rows: DataFrame, key: str, first: list[Column], second: list[Column], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings of all rows, each by columns that tell all rows apart: key, r1, r2, score.

    No ranking of all rows is made. The k-th best score is above 1 / (constant + k), and a row beyond `depth` of both
    rankings can't have more than 2 / (constant + depth + 1), so that the first `depth` of each, exactly, hold the result.
    Their ranks in the other ranking are counted: one pass over all rows says between which of them each row lies."""
    depth = constant + 2 * k - 1
    ordered = rows.select(key, F.struct(*first).alias("o1"), F.struct(*second).alias("o2"))
    found = ordered.orderBy("o1").limit(depth).union(ordered.orderBy("o2").limit(depth)).distinct().collect()  # 2 * depth at most
    if not found:
        return ordered.select(key, *(F.lit(0).cast("bigint").alias(r) for r in ("r1", "r2")), F.lit(0.0).alias("score")).limit(0)
    spark, kinds, places = rows.sparkSession, ordered.schema, {}
    for o in ("o1", "o2"):
        places[o] = sorted({tuple(r[o]) for r in found})
        listed = F.array(*(F.struct(*map(F.lit, x)) for x in places[o])).cast(T.ArrayType(kinds[o].dataType))
        ordered = ordered.withColumn(f"n{o}", F.size(F.filter(listed, lambda x: x < F.col(o))))  # noqa: B023
    lies = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.col(f"n{o}").alias("n")) for o in places)))
    counts = {(r.o, r.n): r.rows for r in ordered.select(lies.alias("x")).groupBy("x.o", "x.n").agg(F.count("*").alias("rows")).collect()}
    ranks = {o: dict(zip(x, accumulate(counts.get((o, n), 0) for n in range(len(x))))) for o, x in places.items()}
    ranked = [(r[key], ranks["o1"][tuple(r.o1)], ranks["o2"][tuple(r.o2)]) for r in found]
    both = spark.createDataFrame(ranked, T.StructType([kinds[key], T.StructField("r1", T.LongType()), T.StructField("r2", T.LongType())]))
    return both.withColumn("score", F.round(1 / (F.lit(constant) + F.col("r1")) + 1 / (F.lit(constant) + F.col("r2")), 9)).orderBy(F.desc("score"), key).limit(k)


def topk_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Spark keeps k rows of a group per task before it shuffles, as the rank is compared with a literal."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.lit(wanted))


def has_all(tags: Column, wanted: list[str]) -> Column:
    return reduce(and_, [F.array_contains(tags, w) for w in wanted])
