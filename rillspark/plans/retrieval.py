"""Queries that users run on stored rows: vectors, words, fusion, trends, graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.functions import model
from rillspark.operators import search as S
from rillspark.session import shared_dir
from rillspark.sinks import graph as G
from rillspark.sinks.indexes import TextIndex, VectorIndex
from rillspark.sinks.targets import vector_points

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def first_vector(rows: DataFrame) -> list[float]:
    return rows.where("vec_id = 0").select("embedding").first().embedding


DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
L2 = "sqrt(list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i]::DOUBLE - {1}[i]::DOUBLE) * ({0}[i]::DOUBLE - {1}[i]::DOUBLE))))"
COSINE = f"1 - {DOT.format('e.embedding', 'q.v')} / (sqrt({DOT.format('e.embedding', 'e.embedding')}) * sqrt({DOT.format('q.v', 'q.v')}))"
Q = "(SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q"


def nearest(spark, sf, metric: str, k: int = 20, where=None) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return S.knn(rows, "embedding", S.vector(first_vector(rows)), k, metric, where, "vec_id").select("vec_id", "label", "distance")


@query(f"SELECT vec_id, label, round({COSINE}, 6) AS distance FROM embeddings e, {Q} ORDER BY distance, vec_id LIMIT 20")
def knn_cosine(spark, sf):
    return nearest(spark, sf, "cosine")


@query(f"SELECT vec_id, label, round({L2.format('e.embedding', 'q.v')}, 6) AS distance FROM embeddings e, {Q} ORDER BY distance, vec_id LIMIT 20")
def knn_l2(spark, sf):
    return nearest(spark, sf, "l2")


@query(f"SELECT vec_id, label, round({DOT.format('e.embedding', 'q.v')}, 6) AS distance FROM embeddings e, {Q} ORDER BY distance DESC, vec_id LIMIT 20")
def knn_ip(spark, sf):
    return nearest(spark, sf, "ip")


@query(f"SELECT vec_id, label, round({COSINE}, 6) AS distance FROM embeddings e, {Q} WHERE label IN (1, 3, 5) ORDER BY distance, vec_id LIMIT 20")
def knn_filtered(spark, sf):
    return nearest(spark, sf, "cosine", where=F.col("label").isin(1, 3, 5))


@query(f"""WITH d AS (SELECT label, vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id < 3),
s AS (SELECT label, qid, max({DOT.format('d.embedding', 'q.v')}) AS m FROM d, q GROUP BY label, qid)
SELECT label, round(sum(m), 6) AS score FROM s GROUP BY label""")
def maxsim(spark, sf):
    """Labels as documents of many vectors, the first three vectors as the query's."""
    rows = table(spark, sf, "embeddings")
    wanted = [r.embedding for r in rows.where("vec_id < 3").orderBy("vec_id").collect()]
    best = [F.max(S.dot(F.col("embedding"), S.vector(v))) for v in wanted]
    return rows.groupBy("label").agg(F.round(sum(best[1:], best[0]), 6).alias("score"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT vec_id, {L2.format('e.embedding', 'q.v')} AS l, CASE WHEN list_has_any({WORDS}, ['idiot', 'licensed']) THEN 0 ELSE 1 END AS m FROM embeddings e JOIN documents ON vec_id = doc_id, {Q}),
r AS (SELECT vec_id, row_number() OVER (ORDER BY round(l, 6), vec_id) AS r1, row_number() OVER (ORDER BY m, vec_id) AS r2 FROM d)
SELECT vec_id, r1, r2, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 9) AS score FROM r ORDER BY score DESC, vec_id LIMIT 10""")
def hybrid_rrf(spark, sf):
    """Nearness of vectors and matching words, each a ranking of all rows, fused."""
    docs = table(spark, sf, "documents").select("doc_id", S.match_any(F.col("text"), ["idiot", "licensed"]).alias("hit"))
    vectors = table(spark, sf, "embeddings")
    q = S.vector(first_vector(vectors))
    near = F.round(S.distance(F.col("embedding"), q, "l2"), 6)
    rows = vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", near.alias("d"), F.when(F.col("hit"), 0).otherwise(1).alias("m"))
    path = f"{shared_dir(spark)}/rrf-{uuid.uuid4().hex}"  # both rankings and the counts read what was worked out once
    rows.write.parquet(path)
    return S.rrf(spark.read.schema(rows.schema).parquet(path), "vec_id", [F.col("d"), F.col("vec_id")], [F.col("m"), F.col("vec_id")], 10)


@query("SELECT doc_id, source, n_chars, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def topk_per_group(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return S.topk_per_group(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query(f"SELECT doc_id, len(list_filter({WORDS}, lambda x: x IN ('the', 'token'))) AS score, n_chars FROM documents WHERE list_has_any({WORDS}, ['the', 'token']) ORDER BY score DESC, n_chars DESC, doc_id LIMIT 50")
def fts_rank(spark, sf):
    docs = table(spark, sf, "documents")
    terms = ["the", "token"]
    hits = docs.where(S.match_any(F.col("text"), terms)).select("doc_id", S.term_count(F.col("text"), terms).alias("score"), "n_chars")
    return hits.orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(50)


@query(f"SELECT doc_id FROM documents WHERE list_has_any({WORDS}, ['clown', 'token', 'licensed'])")
def match_any(spark, sf):
    return table(spark, sf, "documents").where(S.match_any(F.col("text"), ["clown", "token", "licensed"])).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({WORDS}, ['the', 'of', 'token'])")
def match_all(spark, sf):
    return table(spark, sf, "documents").where(S.match_all(F.col("text"), ["the", "of", "token"])).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' all rights reserved ')")
def match_phrase(spark, sf):
    return table(spark, sf, "documents").where(S.match_phrase(F.col("text"), "All rights reserved")).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'the')) AS f0, len(list_filter(ws, lambda x: x = 'token')) AS f1 FROM w),
s AS (SELECT count(*)::DOUBLE AS d, avg(n) AS m, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END)::DOUBLE AS d0, sum(CASE WHEN f1 > 0 THEN 1 ELSE 0 END)::DOUBLE AS d1 FROM c)
SELECT doc_id, round(ln(1 + (d - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM c, s WHERE f0 > 0 OR f1 > 0""")
def fts_bm25(spark, sf):
    return S.bm25(table(spark, sf, "documents"), "doc_id", "text", ["the", "token"])


def topics(spark, sf) -> DataFrame:
    """Words of a conversation's turns as topics."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.explode(F.array_distinct(S.words(F.col("text")))).alias("topic"))


CTE = r"WITH t AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS topic FROM conversations)"


@query(f"{CTE} SELECT c.conv_id, c.turn, role, topic FROM t JOIN conversations c USING (conv_id, turn) WHERE topic ILIKE 'thatth%'")
def topic_search(spark, sf):
    hits = topics(spark, sf).where(F.col("topic").ilike("thatth%"))
    return hits.join(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]).select("conv_id", "turn", "role", "topic")


@query(f"{CTE} SELECT topic, CAST(sum(CASE WHEN turn = 0 THEN 5 ELSE 1 END) AS BIGINT) AS score, max(conv_id) AS latest FROM t GROUP BY topic ORDER BY score DESC, latest DESC, topic LIMIT 25")
def trending(spark, sf):
    scored = topics(spark, sf).groupBy("topic").agg(F.sum(F.when(F.col("turn") == 0, 5).otherwise(1)).cast("bigint").alias("score"), F.max("conv_id").alias("latest"))
    return scored.orderBy(F.desc("score"), F.desc("latest"), "topic").limit(25)


TAGS = "list_filter([CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '://') THEN 'link' END], lambda x: x IS NOT NULL)"


def tagged(spark, sf) -> DataFrame:
    c = F.col
    tags = F.array_compact(F.array(F.when(c("n_chars") > 2000, "long"), F.when(c("lang") == "en", "english"), F.when(c("text").contains("|"), "table"), F.when(c("text").contains("://"), "link")))
    return table(spark, sf, "documents").withColumn("tags", tags)


@query(f"SELECT doc_id, n_chars FROM documents WHERE list_has_any({TAGS}, ['table', 'link'])")
def tag_filter_any(spark, sf):
    return tagged(spark, sf).where(S.has_any(F.col("tags"), ["table", "link"])).select("doc_id", "n_chars")


@query(f"SELECT doc_id, n_chars FROM documents WHERE list_has_all({TAGS}, ['long', 'english'])")
def tag_filter_all(spark, sf):
    return tagged(spark, sf).where(S.has_all(F.col("tags"), ["long", "english"])).select("doc_id", "n_chars")


@query("SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'signup')")
def time_gate(spark, sf):
    e = table(spark, sf, "events")
    return e.where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'").where(F.col("event_type").isin("purchase", "signup")).select("event_id", "event_type", "value")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def stored_join(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


# stored indexes: built of other rows first, then brought to the given tables by updates and deletions


def stored_vectors(spark, sf, metric: str) -> VectorIndex:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    index = VectorIndex(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id", "embedding", metric, 32)
    moved = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    index.update(rows.withColumn("embedding", moved.cast("array<float>")).union(rows.where("label = 2").withColumn("vec_id", -1 - F.col("vec_id"))))
    index.update(rows.where("vec_id % 3 = 0"), rows.where("label = 2").select((-1 - F.col("vec_id")).alias("vec_id")))
    return index


def stored_nearest(spark, sf, metric: str, where=None) -> DataFrame:
    index = stored_vectors(spark, sf, metric)
    return index.knn(first_vector(table(spark, sf, "embeddings")), 20, where).select("vec_id", F.col("label").cast("int").alias("label"), "distance")


@query(QUERIES["knn_cosine"][1])
def stored_knn_cosine(spark, sf):
    return stored_nearest(spark, sf, "cosine")


@query(QUERIES["knn_l2"][1])
def stored_knn_l2(spark, sf):
    return stored_nearest(spark, sf, "l2")


@query(QUERIES["knn_ip"][1])
def stored_knn_ip(spark, sf):
    return stored_nearest(spark, sf, "ip")


@query(QUERIES["knn_filtered"][1])
def stored_knn_filtered(spark, sf):
    return stored_nearest(spark, sf, "cosine", F.col("label").isin(1, 3, 5))


def stored_texts(spark, sf) -> TextIndex:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = TextIndex(spark, f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}", "doc_id")
    other = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("token the all rights "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    index.update(docs.withColumn("text", other).union(docs.where("doc_id % 10 = 0").withColumn("doc_id", -1 - F.col("doc_id"))))
    index.update(docs.where("doc_id % 4 = 0"), docs.where("doc_id % 10 = 0").select((-1 - F.col("doc_id")).alias("doc_id")))
    return index


@query(QUERIES["fts_bm25"][1])
def stored_bm25(spark, sf):
    return stored_texts(spark, sf).bm25(["the", "token"])


@query(QUERIES["fts_bm25"][1] + " ORDER BY score DESC, doc_id LIMIT 30")
def stored_bm25_top(spark, sf):
    return stored_texts(spark, sf).bm25(["the", "token"], 30)


@query(QUERIES["match_phrase"][1])
def stored_phrase(spark, sf):
    return stored_texts(spark, sf).phrase("All rights reserved")


@query(QUERIES["match_all"][1])
def stored_match_all(spark, sf):
    return stored_texts(spark, sf).all_of(["the", "of", "token"])


# graphs

PLACED = G.Relationships("PLACED", G.NodeFromFields("Customer", (G.TargetFieldMapping("o_custkey", "id"),)), G.NodeFromFields("Order", (G.TargetFieldMapping("o_orderkey", "id"),)))


@query("""WITH own AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 0), e AS (SELECT DISTINCT o_custkey AS id FROM orders)
SELECT coalesce(own.id, e.id) AS id, name, own.id IS NOT NULL AS own FROM own FULL JOIN e USING (id)""")
def graph_nodes(spark, sf):
    own = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    ends = G.endpoints(table(spark, sf, "orders"), PLACED.source, F.col("o_orderkey"))
    return G.nodes(own, [ends], ["id"]).select("id", "name", F.col("_own").alias("own"))


@query("SELECT o_custkey AS source_id, o_orderkey AS target_id, o_totalprice FROM orders")
def graph_edges(spark, sf):
    return G.relationships(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), PLACED, [])


@query("""SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""")
def graph_orphans(spark, sf):
    """Endpoints of all orders, of which only urgent ones with status F are left as edges."""
    orders = table(spark, sf, "orders")
    own = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    every = G.nodes(own, [G.endpoints(orders, PLACED.source, F.col("o_orderkey"))], ["id"])
    return G.orphans(every, [(orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"), ["o_custkey"])], ["id"])


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1")
def graph_counts(spark, sf):
    """Relationships of each customer, counted by what changed: some orders belong to others first, and some go."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kept = G.EndpointCounts(spark, f"{shared_dir(spark)}/ends-{uuid.uuid4().hex}", ["o_orderkey"], [["o_custkey"]], ["id"])
    other = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    extra = orders.where("o_orderkey % 7 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    kept.update(orders.withColumn("o_custkey", other).union(extra))
    kept.update(orders.where("o_orderkey % 5 = 0"), extra.select("o_orderkey"))
    return kept.read()


# models and stores that SQL can't express


@query()
def embed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", model.embed_text(F.col("text"), "Hash", "hash", 64).alias("embedding"))


@query()
def vector_store(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    return vector_points(rows, "vec_id")


class FirstWords:
    """Stands for a language model: a title from the first words, and the number of words."""

    def __init__(self, model: str = ""):
        self.model = model

    def generate(self, prompt: str, schema: dict, image: bytes | None = None) -> str:
        import json

        words = prompt.split()
        return json.dumps({"title": " ".join(words[:5]), "n_words": len(words)})


@query()
def extract_struct(spark, sf):
    from dataclasses import make_dataclass

    info = make_dataclass("Info", [("title", str), ("n_words", int)])
    return table(spark, sf, "documents").select("doc_id", model.extract(info, FirstWords, F.col("text")).alias("info")).select("doc_id", "info.*")
