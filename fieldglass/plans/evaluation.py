"""Evaluation queries: orders as questions, their lines as ranked results."""

from pyspark.sql import functions as F

from fieldglass.operators import evaluate
from fieldglass.plans.registry import register

ROUTES = ["en", "fr", "de", "es", "other"]


def gold(t):
    """Per order the smallest supplier as gold document; odd orders also ask for a section."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    joined = lines.join(t.orders, lines.l_orderkey == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("query_id"),
        F.concat(F.lit("S"), F.col("s").cast("string"), F.lit(".md")).alias("source_doc"),
        F.when(F.col("l_orderkey") % 2 == 1, F.substring(F.col("p").cast("string"), 1, 1)).otherwise("").alias("section"),
        F.when(F.col("o_orderpriority").startswith("5"), None).otherwise(F.col("o_orderpriority")).alias("type"),
    )


def retrieved(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_doc"),
        F.col("l_partkey").cast("string").alias("section_num"),
    )


_GOLD = """WITH g AS (SELECT l_orderkey AS q, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1),
 r AS (SELECT g.q, CASE WHEN o_orderpriority LIKE '5%' THEN 'unknown' ELSE o_orderpriority END AS type,
   min(CASE WHEN l_suppkey=g.s AND (g.q%2=0 OR starts_with(l_partkey::VARCHAR, substr(g.p::VARCHAR,1,1))) THEN l_linenumber END) AS hr
   FROM g JOIN orders ON o_orderkey=g.q JOIN lineitem l ON l.l_orderkey=g.q GROUP BY ALL)
"""


@register("first_hit_rank", _GOLD + "SELECT q AS query_id, type, hr AS hit_rank FROM r")
def first_hit_rank(t):
    out = evaluate.hit_ranks(retrieved(t), gold(t))
    return out.select("query_id", F.coalesce("type", F.lit("unknown")).alias("type"), "hit_rank")


@register(
    "retrieval_metrics",
    _GOLD
    + """SELECT type, grouping(type)::BIGINT AS overall, count(*) AS n, round(avg(coalesce(1.0::DOUBLE/hr,0)),6) AS mrr,
    round(avg(CASE WHEN hr<=5 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_5, round(avg(CASE WHEN hr<=10 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_10,
    round(avg(CASE WHEN hr<=50 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_50 FROM r GROUP BY GROUPING SETS ((),(type))""",
)
def retrieval_metrics(t):
    m = evaluate.retrieval_metrics(evaluate.hit_ranks(retrieved(t), gold(t)))
    return m.select(
        "type", F.col("overall").cast("long").alias("overall"), "n",
        *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_5", "recall_at_10", "recall_at_50")],
    )


@register(
    "metrics_by_type",
    _GOLD
    + """SELECT type, count(*) AS n, round(avg(coalesce(1.0::DOUBLE/hr,0)),6) AS mrr,
    round(avg(CASE WHEN hr<=5 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_5,
    round(avg(CASE WHEN hr<=10 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_10 FROM r GROUP BY 1""",
)
def metrics_by_type(t):
    m = evaluate.by_type(evaluate.hit_ranks(retrieved(t), gold(t)))
    return m.select("type", "n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_5", "recall_at_10")])


@register(
    "precision_at_k",
    """SELECT l_orderkey AS query_id, round(sum(CASE WHEN l_linenumber<=3 AND l_returnflag='R' THEN 1 ELSE 0 END)/3.0::DOUBLE,6) AS precision
       FROM lineitem GROUP BY 1""",
)
def precision_at_k(t):
    li = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("item"), "l_returnflag",
    )
    p = evaluate.precision_at_k(li.drop("l_returnflag"), li.filter(F.col("l_returnflag") == "R"), 3)
    return p.withColumn("precision", F.round("precision", 6))


def per_query(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_orderpriority").alias("config"),
        (k % 2).cast("double").alias("recall_at_5"),
        F.when(k % 5 != 0, 1.0).otherwise(0.0).alias("recall_at_10"),
        F.when(k % 11 != 0, 1.0 / (1 + k % 7)).alias("mrr"),
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("latency_ms"),
        F.when((k % 3 == 0) & ~F.col("o_orderpriority").startswith("1"), (k % 10) / 10.0).alias("faithfulness"),
    )


@register(
    "suite_summary",
    """SELECT o_orderpriority AS config, round(avg((o_orderkey%2)::DOUBLE),6) AS recall_at_5,
       round(avg(CASE WHEN o_orderkey%5<>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS recall_at_10,
       round(avg(CASE WHEN o_orderkey%11<>0 THEN 1.0::DOUBLE/(1+o_orderkey%7) END),6) AS mrr,
       round(avg(CASE WHEN o_orderkey%3=0 AND o_orderpriority NOT LIKE '1%' THEN (o_orderkey%10)/10.0::DOUBLE END),6) AS faithfulness,
       round(median(CASE WHEN o_orderkey%13<>0 THEN o_totalprice END),4) AS p50_ms FROM orders GROUP BY 1""",
)
def suite_summary(t):
    s = evaluate.suite_summary(per_query(t))
    return s.select(
        "config", *[F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr", "faithfulness")],
        F.round("p50_ms", 4).alias("p50_ms"),
    )


@register(
    "latency_summary",
    """WITH v AS (SELECT o_orderpriority AS config, CASE WHEN o_orderkey%13<>0 THEN o_totalprice END AS x FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY x)-1 AS i, count(*) OVER (PARTITION BY config) AS n
             FROM v WHERE x IS NOT NULL)
       SELECT config, n, max(CASE WHEN i=n//2 THEN x END) AS p50_ms, max(CASE WHEN i=floor(n*0.95) THEN x END) AS p95_ms,
       round(avg(x),4) AS mean_ms FROM r GROUP BY 1,2""",
)
def latency_summary(t):
    return evaluate.latency_summary(per_query(t)).withColumn("mean_ms", F.round("mean_ms", 4))


def language_pairs(t):
    """Language of each document against a guess from frequent words of its whole text."""
    x = F.lower("text")
    guess = (
        F.when(x.contains(" the "), "en").when(x.contains(" les "), "fr").when(x.contains(" der "), "de")
        .when(x.contains(" los "), "es").otherwise("other")
    )
    return t.documents.select(F.col("doc_id"), F.col("lang").alias("expected"), guess.alias("predicted"))


_PAIRS = """WITH p AS (SELECT doc_id, lang AS expected, CASE WHEN lower(text) LIKE '% the %' THEN 'en' WHEN lower(text) LIKE '% les %' THEN 'fr'
  WHEN lower(text) LIKE '% der %' THEN 'de' WHEN lower(text) LIKE '% los %' THEN 'es' ELSE 'other' END AS predicted FROM documents)
"""


@register(
    "classification_metrics",
    _PAIRS
    + """, a AS (SELECT avg(CASE WHEN expected=predicted THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM p),
    m AS (SELECT r AS route, (count(*) FILTER (WHERE expected=r AND predicted=r)) AS tp,
      (count(*) FILTER (WHERE expected<>r AND predicted=r)) AS fp, (count(*) FILTER (WHERE expected=r AND predicted<>r)) AS fn
      FROM p, (SELECT unnest(['en','fr','de','es','other']) AS r) GROUP BY r),
    s AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS pr, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS re FROM m)
    SELECT route, tp, fp, fn, tp+fn AS support, round(pr,6) AS precision, round(re,6) AS recall,
    round(coalesce(2*pr*re/nullif(pr+re,0),0),6) AS f1, round(acc,6) AS accuracy FROM s, a""",
)
def classification_metrics(t):
    m = evaluate.classification_metrics(language_pairs(t), ROUTES)
    return m.select(
        "route", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    )


@register(
    "confusion_matrix",
    _PAIRS
    + "SELECT r AS actual, "
    + ", ".join(f"(count(*) FILTER (WHERE expected=r AND predicted='{r}')) AS \"{r}\"" for r in ROUTES)
    + " FROM p, (SELECT unnest(['en','fr','de','es','other']) AS r) GROUP BY r",
)
def confusion_matrix(t):
    return evaluate.confusion_matrix(language_pairs(t), ROUTES)


@register(
    "failure_distribution",
    _PAIRS + "SELECT expected, predicted, count(*) AS n FROM p WHERE expected<>predicted GROUP BY 1,2",
)
def failure_distribution(t):
    return evaluate.failure_distribution(language_pairs(t))


@register(
    "failure_samples",
    _PAIRS
    + """SELECT doc_id, expected, predicted, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY expected, predicted ORDER BY doc_id) AS rank
    FROM p WHERE expected<>predicted) WHERE rank<=5""",
)
def failure_samples(t):
    return evaluate.failure_samples(language_pairs(t), "doc_id")


def question_details(t):
    """Every message as a question with a derived route, type and hit rank."""
    n = F.length("text")
    k = F.col("conv_id") + F.col("turn")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.when(k % 9 == 0, F.upper("text")).otherwise(F.col("text")).alias("query"),
        F.when(n % 13 < 4, F.lit(None)).otherwise(n % 17 + 1).cast("long").alias("hit_rank"),
        pick(["diagnostic", "procedural", "definition_explain", "comparative", "default_rag"], k).alias("expected_route"),
        pick(["terminology", "signaling", "technology"], F.col("turn")).alias("type"),
        (k % 10 == 0).alias("needs_decomposition"),
    )


_DETAILS = r"""WITH d AS (SELECT conv_id || '-' || turn AS query_id, CASE WHEN (conv_id+turn)%9=0 THEN upper(text) ELSE text END AS query,
  CASE WHEN length(text)%13<4 THEN NULL ELSE length(text)%17+1 END AS hit_rank,
  ['diagnostic','procedural','definition_explain','comparative','default_rag'][(conv_id+turn)%5+1] AS route,
  ['terminology','signaling','technology'][turn%3+1] AS type, (conv_id+turn)%10=0 AS dec FROM conversations),
 w AS (SELECT *, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x<>'') AS tk FROM d),
 f AS (SELECT query_id, CASE WHEN dec THEN 'decomposition_needed' WHEN len(tk)<=5 THEN 'ambiguous_query'
   WHEN len(list_filter(tk, lambda x: length(x)>=2 AND upper(x)=x AND lower(x)<>x))>=2 THEN 'vocabulary_mismatch'
   WHEN route IN ('diagnostic','comparative') THEN 'multi_index_needed' WHEN route='procedural' THEN 'chunking_issue'
   WHEN type IN ('terminology','technology') THEN 'vocabulary_mismatch' ELSE 'chunking_issue' END AS reason
   FROM w WHERE hit_rank IS NULL OR hit_rank>10)
"""


@register(
    "failure_reasons",
    _DETAILS
    + """SELECT r AS reason, count(f.reason) AS n, round(count(f.reason)*100.0::DOUBLE/(SELECT count(*) FROM f),6) AS pct
    FROM (SELECT unnest(['decomposition_needed','vocabulary_mismatch','ambiguous_query','chunking_issue','multi_index_needed']) AS r)
    LEFT JOIN f ON f.reason=r GROUP BY r""",
)
def failure_reasons(t):
    return evaluate.failure_reasons(question_details(t)).withColumn("pct", F.round("pct", 6))


@register("failure_reason_rows", _DETAILS + "SELECT query_id, reason FROM f")
def failure_reason_rows(t):
    return evaluate.missed(question_details(t)).select("query_id", "reason")


@register(
    "failure_sample",
    _DETAILS
    + """, o AS (SELECT *, sha256('42::' || query_id) AS h FROM f), s AS (SELECT * FROM o ORDER BY h, query_id LIMIT 50),
    r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY h, query_id) AS rank FROM s)
    SELECT query_id, reason, rank::INTEGER AS rank FROM r WHERE rank <= 10""",
)
def failure_sample(t):
    return evaluate.failure_sample(question_details(t)).select("query_id", "reason", "rank")


@register("resume_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t):
    return evaluate.resume_pending(t.documents, t.labels, "doc_id").select("doc_id", "lang")


@register(
    "judge_rollup",
    r"""WITH v AS (SELECT conv_id || '-' || turn AS query_id, unnest(string_split(text, chr(10))) AS claim FROM conversations WHERE role='assistant'),
       p AS (SELECT query_id, avg(CASE WHEN length(claim)%3=0 THEN 1.0::DOUBLE ELSE 0 END) AS f FROM v WHERE trim(claim)<>'' GROUP BY 1)
       SELECT c.conv_id || '-' || c.turn AS query_id, round(coalesce(f,1.0),6)::DOUBLE AS faithfulness FROM conversations c
       LEFT JOIN p ON p.query_id = c.conv_id || '-' || c.turn WHERE role<>'system'""",
)
def judge_rollup(t):
    """Every line of an answer as a claim with a verdict; questions have no claims."""
    rows = t.conversations.withColumn("query_id", F.concat_ws("-", "conv_id", "turn"))
    claims = rows.filter(F.col("role") == "assistant").select("query_id", F.explode(F.split("text", "\n")).alias("claim"))
    verdicts = claims.filter(F.trim("claim") != "").select(
        "query_id", F.when(F.length("claim") % 3 == 0, " Yes, supported").otherwise("No").alias("verdict")
    )
    out = evaluate.faithfulness(rows.filter(F.col("role") != "system").select("query_id"), verdicts)
    return out.withColumn("faithfulness", F.round("faithfulness", 6))


@register(
    "answer_relevancy",
    """WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
       n AS (SELECT vec_id, list_transform(e, lambda x: x/sqrt(list_sum(list_transform(e, lambda y: y*y)))) AS e FROM u),
       g AS (SELECT a.vec_id AS q, b.vec_id-a.vec_id-1 AS pos, list_inner_product(a.e,b.e) AS s FROM n a JOIN n b ON b.vec_id BETWEEN a.vec_id+1 AND a.vec_id+5)
       SELECT n.vec_id AS query_id, round(coalesce((SELECT avg(s) FROM g WHERE q=n.vec_id AND pos<3),0),6)::DOUBLE AS answer_relevancy FROM n""",
)
def answer_relevancy(t):
    """Each vector as a question; the following five as questions generated from its answer."""
    from fieldglass.functions.vectors import l2_normalise

    unit = t.embeddings.select(F.col("vec_id").alias("query_id"), l2_normalise(F.col("embedding")).alias("embedding"))
    generated = unit.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((F.col("query_id") - 1 - i).alias("q"), i.alias("pos")))).alias("g"),
        "embedding",
    ).select(F.col("g.q").alias("query_id"), F.col("g.pos").alias("pos"), "embedding")
    out = evaluate.answer_relevancy(unit, generated)
    return out.select("query_id", F.round("answer_relevancy", 6).alias("answer_relevancy"))


@register(
    "judge_scores",
    """SELECT event_id, CASE WHEN event_id%4=3 THEN 0.0::DOUBLE ELSE (event_id%10)/10.0::DOUBLE END AS score FROM events""",
)
def judge_scores(t):
    """Judge replies in several wordings parsed back to scores."""
    from fieldglass.functions.text import first_score

    s = F.format_string("%.1f", (F.col("event_id") % 10) / 10.0)
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Score: "), s))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("  "), s, F.lit(" because")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("I say "), F.regexp_replace(s, "^0", "")))
        .otherwise("no number here")
    )
    return t.events.select("event_id", first_score(reply).alias("score"))
