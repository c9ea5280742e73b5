"""Retrieval, fusion and routing queries."""

from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions import vectors
from fieldglass.functions.text import word_tokens
from fieldglass.operators import predicates, retrieval, routing, text_index, vector_index
from fieldglass.plans.registry import register
from fieldglass.session import checkpoint_folder, cut_lineage, write_down

_UNIT = """WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 n AS (SELECT vec_id, label, list_transform(e, lambda x: x/sqrt(list_sum(list_transform(e, lambda y: y*y)))) AS e FROM u),
 px AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM n) GROUP BY 1,2),
 cm AS (SELECT label, list(x ORDER BY i) AS m FROM px GROUP BY 1),
 c AS (SELECT label, list_transform(m, lambda x: x/sqrt(list_sum(list_transform(m, lambda y: y*y)))) AS c FROM cm)
"""


def class_centroids(t):
    return retrieval.centroids(t.embeddings)


@register(
    "class_centroids",
    _UNIT + ", k AS (SELECT label, c, unnest(range(0,64)) AS pos FROM c) SELECT label, pos::INTEGER AS pos, round(c[pos+1],6) AS x FROM k",
)
def class_centroid_rows(t):
    return class_centroids(t).select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@register(
    "topk_cosine",
    _UNIT
    + """, s AS (SELECT c.label AS query_id, vec_id AS item_id, list_inner_product(e, c) AS score FROM n, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT query_id, item_id, round(score,6) AS score, rank::INTEGER AS rank FROM r WHERE rank<=10""",
)
def topk_cosine(t):
    queries = class_centroids(t).select(F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))
    return retrieval.vector_top_k(t.embeddings, queries, 10, "vec_id").withColumn("score", F.round("score", 6))


@register(
    "centroid_route",
    _UNIT
    + """, s AS (SELECT vec_id, c.label, list_inner_product(e, c) AS score FROM n, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)
    SELECT vec_id, CASE WHEN score>=0.65 THEN label END AS route, round(score,6) AS score FROM r WHERE k=1""",
)
def centroid_route(t):
    near = retrieval.nearest_centroid(t.embeddings, class_centroids(t))
    return near.select(
        "vec_id",
        F.when(F.col("best_score") >= fixed.CENTROID_THRESHOLD, F.col("best_label")).alias("route"),
        F.round("best_score", 6).alias("score"),
    )


def indexed_search(t):
    """Every twentieth vector searched in a stored index of all vectors; the index and its queries."""
    import uuid

    path = f"{checkpoint_folder(t.spark)}/vector-index-{uuid.uuid4().hex}"
    vector_index.build_index(t.embeddings, path, "vec_id")
    queries = t.embeddings.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return path, queries


@register("vector_index_topk")
def vector_index_topk(t):
    path, queries = indexed_search(t)
    return vector_index.search_index(t.spark, path, queries, 10).withColumn("score", F.round("score", 6))


@register("vector_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id%20=0")
def vector_index_recall(t):
    """The same search held against the exact one: whether 0.9 of all true neighbours are found."""
    path, queries = indexed_search(t)
    exact = retrieval.vector_top_k(t.embeddings, queries, 10, "vec_id")
    each = vector_index.recall_against(vector_index.search_index(t.spark, path, queries, 10), exact)
    return each.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


_FIELDS = ["meta_sparse", "contents_dense", "contents_sparse", "meta_dense"]
_FIELD_SQL = (
    _UNIT
    + ", f AS ("
    + " UNION ALL ".join(
        f"SELECT c.label AS query_id, vec_id AS item_id, '{f}' AS field, {w}::DOUBLE AS w, "
        f"list_cosine_similarity(e[{16*i+1}:{16*i+16}], c[{16*i+1}:{16*i+16}]) AS score FROM n, c"
        for i, (f, w) in enumerate(fixed.FIELD_WEIGHTS.items())
    )
    + "), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, item_id) AS rk FROM f),"
)


def field_hits(t, k):
    """Four rankings per class: each quarter of the vectors stands for one search field."""
    frames = []
    cents = cut_lineage(class_centroids(t))  # one row per class, read by four searches
    for i, field in enumerate(_FIELDS):
        part = lambda c: F.slice(F.col(c), 16 * i + 1, 16)
        items = t.embeddings.select(F.col("vec_id").alias("item_id"), part("embedding").alias("embedding"))
        queries = cents.select(F.col("label").alias("query_id"), part("centroid").alias("embedding"))
        frames.append(retrieval.vector_top_k(items, queries, 2 * k).withColumn("field", F.lit(field)).drop("rank"))
    return retrieval.union_all(frames)


@register(
    "weighted_rrf",
    _FIELD_SQL
    + """ fu AS (SELECT query_id, item_id, sum(w/(60+rk)) AS score FROM rk WHERE rk<=20 GROUP BY 1,2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, item_id) AS rank FROM fu)
    SELECT query_id, item_id, round(score,9) AS score FROM o WHERE rank<=10""",
)
def weighted_rrf(t):
    fused = retrieval.weighted_rank_fusion(field_hits(t, 10), 10, fixed.FIELD_WEIGHTS)
    return fused.select("query_id", "item_id", F.round("score", 9).alias("score"))


@register(
    "rrf_fusion",
    _FIELD_SQL
    + """ fu AS (SELECT query_id, item_id, sum(1.0::DOUBLE/(60+rk)) AS score FROM rk WHERE rk<=20 AND field IN ('meta_sparse','contents_dense') GROUP BY 1,2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, item_id) AS rank FROM fu)
    SELECT query_id, item_id, round(score,9) AS score FROM o WHERE rank<=10""",
)
def rrf_fusion(t):
    two = field_hits(t, 10).filter(F.col("field").isin("meta_sparse", "contents_dense"))
    return retrieval.weighted_rank_fusion(two, 10).select("query_id", "item_id", F.round("score", 9).alias("score"))


@register(
    "cross_collection",
    _UNIT
    + """, s AS (SELECT c.label AS query_id, vec_id AS item_id, vec_id%3 AS coll, list_inner_product(e, c) AS score FROM n, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, coll ORDER BY score DESC, item_id) AS k FROM s),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r WHERE k<=5)
    SELECT query_id, item_id, rank::INTEGER AS rank FROM o WHERE rank<=5""",
)
def cross_collection(t):
    """Three collections searched apart, their results merged by score."""
    queries = cut_lineage(class_centroids(t)).select(F.col("label").alias("query_id"), F.col("centroid").alias("embedding"))
    hits = [
        retrieval.vector_top_k(t.embeddings.filter(F.col("vec_id") % 3 == c), queries, 5, "vec_id").drop("rank")
        for c in range(3)
    ]
    return retrieval.cross_collection_top_k(hits, 5).select("query_id", "item_id", "rank")


_BM25 = r"""WITH tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x<>'') AS w FROM documents),
 qk AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x<>'')) AS term FROM benchmark),
 q AS (SELECT query_id, term, count(*) AS qtf FROM qk GROUP BY 1,2),
 st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk),
 tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM tk) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 s AS (SELECT query_id, doc_id AS item_id, sum(qtf*ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))) AS score
   FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, item_id) AS rank FROM s)
"""


@register("bm25_topk", _BM25 + "SELECT query_id, item_id, round(score,6)::DOUBLE AS score FROM r WHERE rank<=10")
def bm25_topk(t):
    hits = retrieval.bm25_top_k(t.documents, t.benchmark, 10, query_id="item_id", query_text="text")
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"))


@register("text_index_topk", _BM25 + "SELECT query_id, item_id, round(score,6)::DOUBLE AS score FROM r WHERE rank<=10")
def text_index_topk(t):
    """The same search in a stored inverted index of the documents."""
    import uuid

    path = f"{checkpoint_folder(t.spark)}/text-index-{uuid.uuid4().hex}"
    text_index.build_text_index(t.documents, path)
    hits = text_index.search_text_index(t.spark, path, t.benchmark, 10, "item_id", "text")
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"))


@register(
    "sparse_topk",
    _BM25
    + """, id AS (SELECT term, row_number() OVER (ORDER BY term) AS d FROM (SELECT DISTINCT term FROM q)),
    dot AS (SELECT query_id, doc_id AS item_id, sum(qtf*tf)::DOUBLE AS score FROM q JOIN tf USING (term) GROUP BY 1,2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM dot)
    SELECT query_id, item_id, score, k::INTEGER AS rank FROM rk WHERE k<=10""",
)
def sparse_topk(t):
    """Benchmark texts and documents as sparse vectors of term counts, a term's dimension being a hash of it."""
    def words(df, key, name):
        return df.select(F.col(key).alias(name), F.explode(word_tokens(F.coalesce("text", F.lit("")))).alias("w"))

    terms = write_down(words(t.benchmark, "item_id", "query_id").select("w").distinct())
    numbered = terms.withColumn("d", F.hash("w"))
    shared = write_down(numbered.groupBy("d").agg(F.min("w").alias("w")))  # a dimension stands for one term; others of its hash would be added up
    if shared.count() != numbered.count():
        raise ValueError("two terms of the queries share a dimension")

    def packed(df, key, name):
        """Words that no query has are left out before they are counted; a map holds the terms of one text."""
        counted = words(df, key, name).join(shared, "w").groupBy(name, "d").agg(F.count(F.lit(1)).cast("double").alias("n"))
        return counted.groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("sparse"))

    return retrieval.sparse_top_k(packed(t.documents, "doc_id", "item_id"), packed(t.benchmark, "item_id", "query_id"), 10)


@register(
    "hybrid_search",
    _UNIT
    + ", "
    + _BM25.replace("WITH ", "", 1)
    + """, ds AS (SELECT b.item_id AS query_id, vec_id AS item_id, list_inner_product(n.e, c.c) AS score FROM benchmark b JOIN c ON c.label=b.item_id%10, n),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, item_id) AS rk FROM ds),
    al AS (SELECT query_id, item_id, rk FROM dr WHERE rk<=10 UNION ALL SELECT query_id, item_id, rank FROM r WHERE rank<=10),
    fu AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE/(60+rk)),12) AS score FROM al GROUP BY 1,2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fu)
    SELECT query_id, item_id, round(score,9) AS score FROM o WHERE rank<=5""",
)
def hybrid_search(t):
    """Benchmark texts searched in the documents, their class centroids in the vectors; both id spaces are one."""
    cents = class_centroids(t).select((F.col("label").cast("long")).alias("k"), F.col("centroid").alias("embedding"))
    queries = t.benchmark.join(cents, F.col("item_id") % 10 == F.col("k")).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding"
    )
    out = retrieval.hybrid_search(t.embeddings, t.documents, queries, 5, "vec_id", "embedding", "doc_id", "text")
    return out.select("query_id", "item_id", F.round("score", 9).alias("score"))


@register(
    "rerank_order",
    """WITH r AS (SELECT user_id AS query_id, event_id AS item_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
       s AS (SELECT *, ((item_id*37)%101)::DOUBLE AS rr FROM r WHERE k<=20)
       SELECT query_id, item_id, score, rr AS rerank_score, (row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, item_id))::INTEGER AS rank FROM s""",
)
def rerank_order(t):
    """First-stage candidates per user reordered by a pair scorer; both scores are kept."""
    import pandas as pd

    from fieldglass.operators.ordered import top_per_group

    cand = top_per_group(
        t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("value").alias("score")),
        ["query_id"], [F.col("score").desc(), F.col("item_id")], 20,
    ).select("query_id", "item_id", "score", F.lit("q").alias("query"), F.col("item_id").cast("string").alias("text"))

    def scorer(query: pd.Series, text: pd.Series) -> pd.Series:
        return (text.astype("int64") * 37 % 101).astype("float64")

    return retrieval.rerank(cand, scorer).select("query_id", "item_id", "score", "rerank_score", "rank")


@register("score_cut", "SELECT event_id, value AS score FROM events WHERE value >= 10")
def score_cut(t):
    return predicates.score_cut(t.events.select("event_id", F.col("value").alias("score")), 10.0)


@register(
    "reattach_metadata",
    """WITH m AS (SELECT text, max_by(source, doc_id) AS source, max_by(lang, doc_id) AS lang FROM documents GROUP BY 1)
       SELECT d.doc_id, coalesce(m.source,'') AS source, coalesce(m.lang,'') AS lang FROM documents d LEFT JOIN
       (SELECT * FROM m) m ON d.text=m.text""",
)
def reattach_metadata(t):
    ranked = t.documents.select("doc_id", "text")
    return retrieval.attach_metadata(ranked, t.documents, ["source", "lang"], "doc_id").drop("text")


@register(
    "dedup_first",
    "SELECT min(doc_id) AS doc_id, lang FROM (SELECT *, first_value(lang) OVER (PARTITION BY text ORDER BY doc_id) AS l0 FROM documents) WHERE lang=l0 GROUP BY text, lang",
)
def dedup_first(t):
    return retrieval.dedup_text(t.documents.select("doc_id", "text", "lang"), ["doc_id"]).select("doc_id", "lang")


@register(
    "merge_results",
    """WITH a AS (SELECT user_id AS query_id, CASE WHEN event_id%3=0 THEN NULL ELSE (event_id%40)::VARCHAR END AS item_id, event_type AS text, value AS score, event_id AS pos FROM events),
       f AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(item_id, text) ORDER BY pos) AS k FROM a),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM f WHERE k=1)
       SELECT query_id, item_id, text, pos FROM r WHERE rank<=10""",
)
def merge_results(t):
    a = t.events.select(
        F.col("user_id").alias("query_id"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 40).cast("string")).alias("item_id"),
        F.col("event_type").alias("text"), F.col("value").alias("score"), F.col("event_id").alias("pos"),
    )
    return retrieval.merge_results(a, ["pos"], 5).select("query_id", "item_id", "text", "pos")


@register(
    "clean_vectors",
    """SELECT vec_id, (SELECT count(*) FROM (SELECT unnest(embedding) AS x) WHERE abs(x)>=0.01 AND x<0.2)::INTEGER AS kept,
       round((SELECT coalesce(sum(x::DOUBLE),0) FROM (SELECT unnest(embedding) AS x) WHERE abs(x)>=0.01 AND x<0.2),5) AS total FROM embeddings""",
)
def clean_vectors(t):
    """Entries turned into NaN and infinity, then removed by the vector cleaning."""
    dirty = F.transform(
        F.col("embedding"),
        lambda x: F.when(F.abs(x) < F.lit(0.01).cast("float"), F.lit(float("nan")).cast("float"))
        .when(x >= F.lit(0.2).cast("float"), F.lit(float("inf")).cast("float"))
        .otherwise(x),
    )
    clean = vectors.clean_dense(dirty)
    return t.embeddings.select("vec_id", clean.alias("c")).select(
        "vec_id", F.size("c").alias("kept"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 5).alias("total")
    )


def questions(t):
    """Orders worded as questions in twelve ways, with keys taken from the row."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    forms = [
        F.concat(F.lit("what is alm-"), c, F.lit("?")),
        F.concat(F.lit("explain Alarm "), c),
        F.concat(F.lit("list NRCellDU "), c),
        F.concat(F.lit("show G-"), F.lpad(c, 5, "0")),
        F.lit("trend of CELL.UE.MaxConnectedNbr please"),
        F.concat(F.lit("LTE와 NR의 차이점은 "), c),
        F.concat(F.lit("핸드오버 절차는 "), c),
        F.concat(F.lit("실패 원인은 "), c),
        F.concat(F.lit("타이머 기본값은 "), c),
        F.concat(F.lit("빔 관리는 무엇인가 "), c),
        F.concat(F.lit("see 3GPP TS 38.331 item "), c),
        F.concat(F.lit("set maxTxPower "), c),
        F.concat(F.lit("hello "), c),
    ]
    text = F.get(F.array(*forms), (k % len(forms)).cast("int"))
    return t.orders.select(k.alias("query_id"), F.col("o_custkey"), text.alias("query"))


_ROUTES = """WITH q AS (SELECT o_orderkey AS query_id, o_custkey::VARCHAR AS c, (o_orderkey%13)::INTEGER AS f FROM orders),
 r AS (SELECT query_id,
  CASE WHEN f<=4 OR f=8 OR f=11 THEN 'structured_lookup' WHEN f=5 THEN 'comparative' WHEN f=6 THEN 'procedural' WHEN f=7 THEN 'diagnostic'
       WHEN f IN (9,10) THEN 'definition_explain' END AS route,
  CASE WHEN f<=3 THEN 1.0 WHEN f=4 THEN 0.95 WHEN f BETWEEN 5 AND 8 THEN 0.85 WHEN f=9 THEN 0.8 WHEN f=10 THEN 0.7 WHEN f=11 THEN 0.9 END::DOUBLE AS confidence,
  CASE WHEN f<=1 THEN 'alarm_code' WHEN f=2 THEN 'mo_name' WHEN f=3 THEN 'mid_group_id' WHEN f=4 THEN 'counter_name' WHEN f=10 THEN 'spec_number' WHEN f=11 THEN 'param_name' END AS entity,
  CASE WHEN f<=1 THEN 'ALM-'||c WHEN f=2 THEN 'NRCellDU' WHEN f=3 THEN 'G-'||lpad(c,5,'0') WHEN f=4 THEN 'CELL.UE.MaxConnectedNbr' WHEN f=10 THEN '38.331' WHEN f=11 THEN 'maxTxPower' END AS value FROM q)
"""


@register("rule_routes", _ROUTES + "SELECT * FROM r")
def rule_routes(t):
    return questions(t).select("query_id", routing.rule_route(F.col("query")).alias("r")).select(
        "query_id", "r.route", "r.confidence", "r.entity", "r.value"
    )


@register(
    "layered_routes",
    _ROUTES
    + """SELECT query_id, CASE WHEN confidence>=0.9 THEN route ELSE 'default_rag' END AS route,
    CASE WHEN confidence>=0.9 THEN 'regex' ELSE 'fallback' END AS layer FROM r""",
)
def layered_routes(t):
    return routing.route_questions(questions(t)).select("query_id", "route", "layer")


@register(
    "route_coverage",
    _ROUTES
    + """SELECT sum(CASE WHEN confidence>=0.9 THEN 1 ELSE 0 END)::BIGINT AS matched, (count(*)-sum(CASE WHEN confidence>=0.9 THEN 1 ELSE 0 END))::BIGINT AS fallback FROM r""",
)
def route_coverage(t):
    from fieldglass.operators.evaluate import coverage

    return coverage(routing.route_questions(questions(t)))


@register(
    "layered_vector_routes",
    _UNIT
    + """, s AS (SELECT vec_id, c.label, list_inner_product(e, c) AS score FROM n, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM s)
    SELECT vec_id AS query_id, CASE WHEN vec_id%4=0 THEN 'structured_lookup' WHEN score>=0.5 THEN label::VARCHAR ELSE 'default_rag' END AS route,
    CASE WHEN vec_id%4=0 THEN 'regex' WHEN score>=0.5 THEN 'embedding' ELSE 'fallback' END AS layer FROM r WHERE k=1""",
)
def layered_vector_routes(t):
    """Every fourth vector belongs to a question the rules resolve; the rest go to the centroids."""
    asked = t.embeddings.select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.when(F.col("vec_id") % 4 == 0, "alarm 17 raised").otherwise("any news").alias("query"),
    )
    return routing.route_questions(asked, class_centroids(t), threshold=0.5).select("query_id", "route", "layer")


_DOC_TYPES = "CASE " + " ".join(
    f"WHEN route='{r}' THEN [{','.join(repr(d) for d in docs)}]" for r, docs in fixed.ROUTE_DOC_TYPES.items()
) + " ELSE ['feature_desc'] END"


@register(
    "route_doc_types",
    _ROUTES
    + f"""SELECT query_id, unnest(CASE WHEN entity='alarm_code' THEN ['alarm_ref'] WHEN entity IN ('param_name','mo_name') THEN ['parameter_ref']
    ELSE {_DOC_TYPES} END) AS doc_type FROM r""",
)
def route_doc_types(t):
    r = questions(t).select("query_id", routing.rule_route(F.col("query")).alias("r"))
    return r.select("query_id", F.explode(routing.doc_types(F.col("r.route"), F.col("r.entity"))).alias("doc_type"))


@register(
    "retrieval_filter",
    r"""SELECT doc_id FROM documents WHERE lang='en' AND source='src7' AND
       (list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'),'the') OR list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'),'were'))""",
)
def retrieval_filter(t):
    from fieldglass.functions.text import word_tokens

    docs = t.documents.select(
        "doc_id", F.col("lang").alias("product"), F.col("source").alias("release"), word_tokens(F.col("text")).alias("keywords")
    )
    return docs.filter(predicates.retrieval_filter("en", "src7", ["the", "were"])).select("doc_id")
