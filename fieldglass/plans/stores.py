"""Store queries: records as text and JSON, replacement by source, upserts."""

import uuid

from pyspark.sql import functions as F

from fieldglass.operators import models
from fieldglass.plans.registry import register
from fieldglass.session import checkpoint_folder
from fieldglass.sources import readers, stores, versions


@register(
    "typed_load",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def typed_load(t):
    df = readers.load_typed(t.spark, f"{t.folder}/orders.parquet", "parquet")
    missing = readers.load_typed(t.spark, f"{t.folder}/none.parquet", "parquet", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice").unionByName(missing)


@register(
    "dated_files",
    """SELECT strftime(ts,'%Y%m%d') AS day, '/lake/' || min('data_' || strftime(ts,'%Y%m%d') || '_' || (user_id%7) || '.parquet') AS path
       FROM events WHERE strftime(ts,'%Y%m%d') BETWEEN '20240105' AND '20240120' GROUP BY 1""",
)
def dated_files(t):
    """A file listing named after the events' days and users, cut to a day range."""
    name = F.concat(F.lit("/lake/data_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), (F.col("user_id") % 7).cast("string"), F.lit(".parquet"))
    listing = t.events.select(name.alias("path")).distinct()
    return readers.dated_files(listing, "20240105", "20240120")


@register(
    "corpus_text",
    "SELECT 's_suppkey: '||s_suppkey||' | s_name: '||s_name||' | s_nationkey: '||s_nationkey AS text FROM supplier",
)
def corpus_text(t):
    return readers.with_text(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), "body").select("text")


@register(
    "corpus_rename",
    "SELECT conv_id, turn, text AS text FROM conversations",
)
def corpus_rename(t):
    return readers.with_text(t.conversations.select("conv_id", "turn", F.col("text").alias("body")), "body")


@register(
    "json_records",
    """SELECT '{"p_partkey":'||p_partkey||',"p_name":"'||p_name||'","p_size":'||CASE WHEN p_size%5=0 THEN 'null' ELSE p_size::VARCHAR END||'}' AS record FROM part""",
)
def json_records(t):
    return readers.json_records(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("p_size")))


def json_lines(t):
    """Events as JSON lines; every ninth is broken, every tenth blank."""
    k = F.col("event_id")
    body = F.to_json(F.struct(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.col("value").cast("string").alias("object"), F.lit("USER").alias("subject_label")))
    return t.events.select(k.alias("line"), F.when(k % 10 == 0, " ").when(k % 9 == 0, F.concat(body, F.lit("}{"))).when(k % 9 == 1, "[1, 2]").otherwise(body).alias("value"))


@register(
    "triple_lines",
    "SELECT event_id AS line, 'U'||user_id AS subject, event_type AS predicate, 'USER' AS subject_label FROM events WHERE event_id%10<>0 AND event_id%9>1",
)
def triple_lines(t):
    return readers.triple_lines(json_lines(t))[0].select("line", "subject", "predicate", "subject_label")


@register("triple_line_errors", "SELECT event_id AS line FROM events WHERE event_id%10<>0 AND event_id%9<=1")
def triple_line_errors(t):
    return readers.triple_lines(json_lines(t))[1].select("line")


@register(
    "required_fields",
    "SELECT item_id::VARCHAR AS query_id, length(text)::INTEGER AS n FROM benchmark",
)
def required_fields(t):
    lines = t.benchmark.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"), F.lit("a").alias("answer"), F.array(F.lit("c")).alias("contexts"))).alias("value"))
    parsed = lines.select(F.from_json("value", readers.ANSWER_SCHEMA).alias("j")).select("j.*")
    return readers.require_fields(parsed, readers.ANSWER_REQUIRED).select("query_id", F.length("question").alias("n"))


@register(
    "replace_by_source",
    """SELECT doc_id, source, text IS NULL AS emptied FROM (SELECT doc_id, source, text FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id%97=0)
       UNION ALL SELECT doc_id+1000000, source, NULL FROM documents WHERE doc_id%97=0)""",
)
def replace_by_source(t):
    d = t.documents.select("doc_id", "source", "text")
    incoming = d.filter(F.col("doc_id") % 97 == 0).select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit(None).cast("string").alias("text"))
    out = stores.replace_by_source(d, incoming, "source")
    return out.select("doc_id", "source", F.col("text").isNull().alias("emptied"))


@register(
    "versioned_store",
    """SELECT doc_id, source, text FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id%97=0)
       UNION ALL SELECT doc_id+1000000, source, upper(lang) FROM documents WHERE doc_id%97=0""",
)
def versioned_store(t):
    """Documents as a first version, new rows for some sources as a second that is sent twice, read back."""
    path = f"{checkpoint_folder(t.spark)}/versions-{uuid.uuid4().hex}"
    d = t.documents
    versions.write_version(d.select("doc_id", "source", "text"), path, "source", "first")
    incoming = d.filter(F.col("doc_id") % 97 == 0).select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.upper("lang").alias("text"))
    for _ in range(2):
        versions.write_version(incoming, path, "source", "second")
    return versions.read_live(t.spark, path, "source")


@register(
    "upsert_latest",
    """WITH c AS (SELECT o_custkey AS id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS balance FROM orders GROUP BY 1)
       SELECT coalesce(c.id, c_custkey) AS id, CASE WHEN c.id IS NULL THEN c_acctbal ELSE balance END AS balance FROM customer FULL JOIN c ON c.id=c_custkey""",
)
def upsert_latest(t):
    """Orders as writes to the customer's balance, in date and key order."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    new = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("balance"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return stores.upsert(old, new, ["id"], "v").select("id", "balance")


@register(
    "hash_embedding",
    r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM conversations),
    c AS (SELECT conv_id, turn, ('0x' || substr(sha1(word), 7, 2))::INTEGER % 32 AS cell, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
    s AS (SELECT conv_id, turn, sqrt(sum(n*n)) AS length FROM c GROUP BY ALL)
    SELECT conv_id, turn, cell, round(n/length, 6) AS value FROM c JOIN s USING (conv_id, turn)""",
)
def hash_embedding(t):
    """Messages embedded by the stand-in encoder: the cells of each vector that are not zero."""
    out = models.embed(t.conversations.select("conv_id", "turn", "text"), models.hash_encoder())
    cells = out.select("conv_id", "turn", F.posexplode("embedding").alias("cell", "value")).filter(F.col("value") != 0)
    return cells.withColumn("value", F.round("value", 6))


@register(
    "model_replies",
    """SELECT conv_id, turn, CASE WHEN length(text)%5=0 THEN 'failed' ELSE length(text)::VARCHAR END AS reply FROM conversations""",
)
def model_replies(t):
    def client(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise RuntimeError("no reply")
        return str(len(prompt))

    return models.ask(t.conversations, client, "text", default="failed").select("conv_id", "turn", "reply")


@register(
    "sub_questions",
    """SELECT conv_id, turn, CASE WHEN turn%4=0 THEN 2 WHEN turn%4=3 THEN 1 ELSE 1 END::INTEGER AS n, CASE WHEN turn%4=0 THEN 'a' WHEN turn%4=1 THEN text ELSE text END AS first FROM conversations""",
)
def sub_questions(t):
    reply = F.when(F.col("turn") % 4 == 0, 'Here: ["a", "b"] ok').when(F.col("turn") % 4 == 1, '["1","2","3","4","5"]').when(F.col("turn") % 4 == 2, "none")
    out = models.sub_questions(t.conversations.withColumn("reply", reply), query="text")
    return out.select("conv_id", "turn", F.size("sub_questions").alias("n"), F.get("sub_questions", F.lit(0)).alias("first"))


@register(
    "release_names",
    """SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 'Rel-18' ELSE 'Rel-1'||(o_orderkey%9) END AS release FROM orders""",
)
def release_names(t):
    path = F.when(F.col("o_orderkey") % 3 == 0, "/data/spec/x.md").otherwise(F.concat(F.lit("/data/Rel-1"), (F.col("o_orderkey") % 9).cast("string"), F.lit("/x.md")))
    return t.orders.select("o_orderkey", readers.release_of(path).alias("release"))
