"""Queries of flow structure: sources, transformations, nested scopes, collectors, generated keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.flow import Flow, GeneratedField, TransformFlow
from rillspark.functions import languages, split, text
from rillspark.functions.udf import executor_class, function
from rillspark.sources.files import matches
from rillspark.session import spread
from rillspark.sources.tables import CustomSource, Table, parquet_table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def source(sf: str, name: str, *keys: str, **options) -> Table:
    return parquet_table(f"{sf}/{name}.parquet", list(keys), **options)


def collected(spark: SparkSession, define) -> DataFrame:
    flow = Flow("query")
    define(flow)
    return next(iter(flow.compile(spark).values()))


@query()
def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into chunks, one record per chunk: the flagship flow."""

    def define(flow: Flow):
        out = flow.add_collector()
        docs = Table(lambda s: spread(s.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), 4), ["doc_id"])
        with flow.add_source(docs).row() as doc:
            doc["chunks"] = doc["text"].transform(split.split_recursively, 1000, 300, 100)
            with doc["chunks"].row() as chunk:
                out.collect(doc_id=doc["doc_id"], location=chunk["location"], text=chunk["text"])

    rows = collected(spark, define)
    return rows.select("doc_id", F.col("location.start").alias("start"), F.col("location.end").alias("end"), "text")


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def import_keyed(spark, sf):
    return source(sf, "documents", "doc_id", included_columns=["text", "lang", "n_chars"]).read(spark)


@query("SELECT doc_id, upper(lang) || ':' || length(text) AS tag FROM documents")
def transform_expr(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(source(sf, "documents", "doc_id")).row() as doc:
            doc["tag"] = flow.transform(lambda lang, t: F.concat(F.upper(lang), F.lit(":"), F.length(t).cast("string")), doc["lang"], doc["text"])
            out.collect(doc_id=doc["doc_id"], tag=doc["tag"])

    return collected(spark, define)


@query("SELECT p_partkey, round(p_retailprice * p_size * 0.9, 2) AS total, p_brand || ' ' || p_name AS full_name FROM part")
def transform_multi_arg(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(source(sf, "part", "p_partkey")).row() as p:
            total = flow.transform(lambda price, n, rate: F.round(price * n * rate, 2), p["p_retailprice"], p["p_size"], 0.9)
            name = flow.transform(lambda a, b: F.concat_ws(" ", a, b), p["p_brand"], p["p_name"])
            out.collect(p_partkey=p["p_partkey"], total=total, full_name=name)

    return collected(spark, define)


def nested_orders(spark, sf) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    item = F.struct(F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "l_quantity", "l_extendedprice")
    nested = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.join(nested, orders.o_orderkey == nested.l_orderkey, "left").drop("l_orderkey")


@query("SELECT o_orderkey, o_orderpriority, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_extendedprice / l_quantity AS unit_price FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def for_each_nested(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(Table(lambda s: nested_orders(s, sf), ["o_orderkey"])).row() as o:
            with o["items"].row() as i:
                i["unit"] = flow.transform(lambda p, q: p / q, i["l_extendedprice"], i["l_quantity"])
                out.collect(o_orderkey=o["o_orderkey"], o_orderpriority=o["o_orderpriority"], line=i["line"], part=i["l_partkey"], unit_price=i["unit"])

    return collected(spark, define)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type || '/' || user_id AS who FROM events")
def struct_field(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(source(sf, "events", "event_id")).row() as e:
            e["parsed"] = flow.transform(lambda p, t, u: F.struct(F.get_json_object(p, "$.k").alias("k"), F.struct(F.concat(t, F.lit("/"), u.cast("string")).alias("name")).alias("who")), e["props"], e["event_type"], e["user_id"])
            out.collect(event_id=e["event_id"], k=e["parsed"]["k"], who=e["parsed"]["who"]["name"])

    return collected(spark, define)


@query("SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS line, o_custkey * 1000 + l_linenumber AS mixed FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def ancestor_ref(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(Table(lambda s: nested_orders(s, sf), ["o_orderkey"])).row() as o:
            with o["items"].row() as i:
                mixed = flow.transform(lambda c, n: c * 1000 + n, o["o_custkey"], i["line"])
                out.collect(o_orderkey=o["o_orderkey"], line=i["line"], mixed=mixed)

    return collected(spark, define)


@query("""SELECT 'doc' AS kind, doc_id AS id, text, lang, NULL::VARCHAR AS url FROM documents
UNION ALL SELECT 'bench', item_id, text, NULL, NULL FROM benchmark UNION ALL SELECT 'page', page_id, NULL, NULL, url FROM pages""")
def collect_multi_source(spark, sf):
    def define(flow):
        out = flow.add_collector()
        with flow.add_source(source(sf, "documents", "doc_id")).row() as d:
            out.collect(kind="doc", id=d["doc_id"], text=d["text"], lang=d["lang"])
        with flow.add_source(source(sf, "benchmark", "item_id")).row() as b:
            out.collect(kind="bench", id=b["item_id"], text=b["text"])
        with flow.add_source(source(sf, "pages", "page_id")).row() as p:
            out.collect(kind="page", id=p["page_id"], url=p["url"])

    return collected(spark, define)


@query("""WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM e),
h AS (SELECT doc_id, line, md5('source_0|{"doc_id":' || doc_id || '}|' || md5('{"doc_id":' || doc_id || ',"line_md5":"' || md5(line) || '"}') || '|' || nth) AS h FROM n)
SELECT doc_id, md5(line) AS line_md5, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM h""")
def stable_uuid(spark, sf):
    """Ids of lines by their values and of equal lines by their order."""

    def define(flow):
        out = flow.add_collector()
        with flow.add_source(source(sf, "documents", "doc_id")).row() as d:
            d["lines"] = d["text"].transform(lambda t: F.split(t, "\n"))
            with d["lines"].row() as line:
                out.collect(id=GeneratedField.UUID, doc_id=d["doc_id"], line_md5=line["value"].transform(F.md5))

    return collected(spark, define)


@query("SELECT doc_id, md5(lang || ':' || md5(text)) AS fp FROM documents")
def transform_flow(spark, sf):
    shared = TransformFlow(lambda lang, t: F.md5(F.concat(lang, F.lit(":"), F.md5(t))), ("string", "string"))
    return shared.on(spark.read.parquet(f"{sf}/documents.parquet"), "fp", "lang", "text").select("doc_id", "fp")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus = 'F'")
def scan_table_filter(spark, sf):
    return source(sf, "orders", "o_orderkey", included_columns=["o_totalprice", "o_orderdate"], ordinal_column="o_orderdate", filter="o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderstatus = 'F'").read(spark)


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS ordinal FROM orders")
def lazy_list(spark, sf):
    """Keys and ordinals without values: the scan reads two columns."""
    return source(sf, "orders", "o_orderkey", ordinal_column="o_orderdate").listing(spark).withColumnRenamed("_ordinal", "ordinal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def custom_source(spark, sf):
    table = lambda s: s.read.parquet(f"{sf}/customer.parquet")
    made = CustomSource(["c_custkey"], lambda s: table(s).select("c_custkey"), lambda s, keys: table(s).join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name", "c_acctbal"))
    return made.read(spark)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://.*\\.example\\.com/') AND NOT regexp_matches(url, '/fr/')")
def glob_filter(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return pages.where(matches(F.col("url"), ["http{,s}://*.example.com/*"], ["*/fr/*"]))


# text functions

LINES = "list_filter(list_transform({}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '')"


def chunks(spark, sf, *args, **kw) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.inline(split.split_by_separators(F.col("text"), *args, **kw))).select("doc_id", F.col("text"), (F.col("location.end") - F.col("location.start")).alias("width"))


@query(f"SELECT doc_id, t AS text, length(t) AS width FROM (SELECT doc_id, unnest({LINES.format("regexp_split_to_array(text, '[.!?]|' || chr(10))")}) AS t FROM documents)")
def split_by_separators(spark, sf):
    return chunks(spark, sf, [r"[.!?]", r"\n"])


@query(f"SELECT doc_id, t AS text, length(t) AS width FROM (SELECT doc_id, unnest({LINES.format("string_split(regexp_replace(text, '[.]', '.' || chr(1), 'g'), chr(1))")}) AS t FROM documents)")
def split_by_separators_keep_left(spark, sf):
    return chunks(spark, sf, [r"\."], "LEFT")


@query(f"SELECT doc_id, t AS text, length(t) AS width FROM (SELECT doc_id, unnest({LINES.format("string_split(regexp_replace(text, '[.]', chr(1) || '.', 'g'), chr(1))")}) AS t FROM documents)")
def split_by_separators_keep_right(spark, sf):
    return chunks(spark, sf, [r"\."], "RIGHT")


@query(f"SELECT doc_id, unnest({LINES.format("string_split(text, chr(10))")}) AS line FROM documents")
def split_texts(spark, sf):
    """The native form: no Python in the plan."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.explode(split.split_texts(F.col("text"), [r"\n"])).alias("line"))


@query()
def split_recursively(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), 4)
    return docs.select("doc_id", F.inline(split.split_recursively(F.col("text"), 500, 100, 50))).select("doc_id", "location", "text", "start", "end")


@query("""SELECT page_id, CASE lower(regexp_extract(url, '(\\.[^.]*)$', 1)) WHEN '.html' THEN 'html' WHEN '.php' THEN 'php' WHEN '.htm' THEN 'html' WHEN '.js' THEN 'javascript' WHEN '.json' THEN 'json' WHEN '.xml' THEN 'xml' WHEN '.md' THEN 'markdown' END AS language FROM pages""")
def detect_language(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", languages.language_of(F.col("url")).alias("language"))


@query("SELECT event_id, CAST(json_extract(props, '$.n') AS BIGINT) AS n, json_extract_string(props, '$.k') AS k FROM events")
def parse_json_field(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    parsed = e.select("event_id", text.parse_json(F.col("props")).alias("v"))
    return parsed.select("event_id", F.try_variant_get("v", "$.n", "bigint").alias("n"), F.try_variant_get("v", "$.k", "string").alias("k"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b', '[SSN REDACTED]', 'g'), '\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '[PHONE REDACTED]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL REDACTED]', 'g') AS text FROM documents""")
def scrub_pii(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.scrub_pii(F.col("text")).alias("text"))


def topics_sql() -> str:
    parts = [f"CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN '{t}' END" for t, words in text.TOPICS.items()]
    return f"SELECT doc_id, array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',') AS topics FROM documents"


@query(topics_sql())
def extract_topics(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_join(text.extract_topics(F.col("text")), ",").alias("topics"))


# user functions


@function()
def net_price(price: float, discount: float, tax: float | None) -> float:
    return price * (1 - discount) * (1 + (tax or 0.0))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net FROM lineitem")
def udf_scalar(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", net_price(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")).alias("net"))


@dataclass(frozen=True)
class PrefixSpec:
    prefix: str


@executor_class()
class AddPrefix:
    spec: PrefixSpec

    def prepare(self) -> None:
        self.ready = self.spec.prefix.upper()

    def __call__(self, value: str) -> str:
        return f"{self.ready}-{value}"


@query("SELECT c_custkey, 'CUST-' || c_name AS tagged FROM customer")
def udf_stateful(spark, sf):
    add = AddPrefix(PrefixSpec("cust"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", add(F.col("c_name")).alias("tagged"))


@function(batching=True, max_batch_size=64)
def name_lengths(names: list[str]) -> list[int]:
    return [len(n) for n in names]


@query("SELECT p_partkey, length(p_name) AS n FROM part")
def udf_batched(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name_lengths(F.col("p_name")).alias("n"))


@dataclass
class Word:
    word: str
    size: int


@function()
def words_of(text: str) -> list[Word]:
    return [Word(w, len(w)) for w in text.split(" ") if w]


@query("SELECT item_id, word, length(word) AS size FROM (SELECT item_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word FROM benchmark)")
def udtf_table(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.inline(words_of(F.col("text"))))


def turns(spark, sf) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def nested_table_filter(spark, sf):
    kept = turns(spark, sf).select("conv_id", F.filter("turns", lambda t: t["role"] == "user").alias("turns"))
    return kept.select("conv_id", F.inline("turns")).select("conv_id", "turn", "text")


@query("SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def nested_table_agg(spark, sf):
    total = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["text"]))
    return turns(spark, sf).select("conv_id", F.size("turns").cast("bigint").alias("n"), total.alias("chars"))
