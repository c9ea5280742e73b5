"""Drift, profile and flow queries."""

from pyspark.sql import functions as F

from fieldglass.functions import text as tx
from fieldglass.functions import vectors
from fieldglass.operators import drift, flows, profile
from fieldglass.operators.ordered import time_slice
from fieldglass.plans.registry import register

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def daily_mix(t):
    """Events per user, day and type as one wide row."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return t.events.groupBy("user_id", day.alias("day")).agg(
        *[F.sum((F.col("event_type") == e).cast("double")).alias(e) for e in EVENT_TYPES]
    )


_MIX_SQL = """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS d0, %s FROM events GROUP BY 1, 2),
s AS (SELECT user_id, d0, %s FROM (SELECT *, %s AS m FROM d)),
p AS (SELECT *, %s FROM s WINDOW w AS (PARTITION BY user_id ORDER BY d0))
""" % (
    ", ".join(f"sum(CASE WHEN event_type='{e}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {e}" for e in EVENT_TYPES),
    ", ".join(f"{e}/m AS {e}" for e in EVENT_TYPES),
    "+".join(EVENT_TYPES),
    ", ".join(f"lag({e}) OVER w AS q_{e}" for e in EVENT_TYPES),
)


def _js_sql():
    term = lambda a, b: f"CASE WHEN {a}>0 THEN {a}*ln({a}/(({a}+{b})/2)) ELSE 0 END"
    return "sqrt(greatest((" + "+".join(term(e, f"q_{e}") + "+" + term(f"q_{e}", e) for e in EVENT_TYPES) + ")/2,0))"


def _drift(t, method):
    out = drift.drift_scores(daily_mix(t), ["user_id"], "day", EVENT_TYPES, method, "sum", "week")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("score", 6).alias("score"))


_DRIFT_SELECT = (
    _MIX_SQL + "SELECT user_id, strftime(d0,'%Y-%m-%d') AS day, "
    "round(CASE WHEN q_click IS NULL THEN 0 ELSE {score} END, 6)::DOUBLE AS score FROM p"
)


@register("drift_js", _DRIFT_SELECT.replace("{score}", _js_sql()))
def drift_js(t):
    return _drift(t, "jensenshannon")


@register(
    "drift_w1",
    _DRIFT_SELECT.replace(
        "{score}",
        "list_sum(list_transform(list_zip(list_sort([%s]),list_sort([%s])), lambda x: abs(x[1]-x[2])))/5"
        % (",".join(EVENT_TYPES), ",".join(f"q_{e}" for e in EVENT_TYPES)),
    ),
)
def drift_w1(t):
    return _drift(t, "wasserstein")


@register(
    "drift_l2",
    _DRIFT_SELECT.replace("{score}", "sqrt(" + "+".join(f"({e}-q_{e})*({e}-q_{e})" for e in EVENT_TYPES) + ")"),
)
def drift_l2(t):
    return _drift(t, "euclidean")


@register(
    "drift_histogram_w1",
    _DRIFT_SELECT.replace(
        "{score}",
        "+".join(
            "abs(" + "+".join(f"({e}-q_{e})" for e in EVENT_TYPES[: i + 1]) + ")" for i in range(len(EVENT_TYPES) - 1)
        ),
    ),
)
def drift_histogram_w1(t):
    from fieldglass.operators.ordered import previous_row

    steps = daily_mix(t).select(
        "user_id", "day", vectors.row_distribution([F.col(e) for e in EVENT_TYPES]).alias("dist")
    )
    paired = previous_row(steps, ["user_id"], ["day"], ["dist"], time_slice("day", "week"))
    score = vectors.wasserstein_histogram(F.col("dist"), F.col("prev.dist"), len(EVENT_TYPES))
    return paired.select(
        "user_id",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"),
    )


@register(
    "time_row_aggregate",
    """SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H') AS hour, round(avg(value),6) AS mean_value,
       round(sum(value),4) AS sum_value, max(value) AS max_value, min(value) AS min_value
       FROM events WHERE user_id IS NOT NULL GROUP BY 1""",
)
def time_row_aggregate(t):
    e = t.events.select(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "value")
    out = drift.aggregate_time_rows(e, ["hour"], ["mean", "sum", "max", "min"], ["value"])
    return out.select(
        "hour", F.round("mean_value", 6).alias("mean_value"), F.round("sum_value", 4).alias("sum_value"),
        "max_value", "min_value",
    )


@register(
    "entity_filter",
    "SELECT event_id, event_type, value FROM events WHERE user_id = 7",
)
def entity_filter(t):
    from fieldglass.operators.predicates import entity_filter as only

    return only(t.events, "user_id", 7).select("event_id", "event_type", "value")


@register(
    "dataset_size",
    """SELECT count(*) AS row_count,
       CASE WHEN count(*) > 10000 THEN 'Large' WHEN count(*) > 1000 THEN 'Medium' ELSE 'Small' END AS size_category
       FROM documents""",
)
def dataset_size(t):
    return profile.dataset_size(t.documents)


@register(
    "text_lengths",
    """SELECT round(avg(length(text)),4) AS avg_length, max(length(text))::BIGINT AS max_length,
       min(length(text))::BIGINT AS min_length, round(stddev_samp(length(text)),4) AS length_std,
       round(stddev_samp(length(text))/avg(length(text)),6) AS variance_ratio FROM documents""",
)
def text_lengths(t):
    out = profile.text_lengths(t.documents)
    return out.select(
        F.round("avg_length", 4).alias("avg_length"), "max_length", "min_length",
        F.round("length_std", 4).alias("length_std"), F.round("variance_ratio", 6).alias("variance_ratio"),
    )


def _moments_sql(c):
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS std, "
        f"round(skewness({c}),5) AS skewness, round(kurtosis({c}),5) AS kurtosis, "
        f"(abs(skewness({c}))<0.5 AND abs(kurtosis({c}))<2) AS is_likely_normal, NULL::VARCHAR AS error FROM lineitem"
    )


@register("profile_moments", " UNION ALL ".join(_moments_sql(c) for c in LINE_COLUMNS))
def profile_moments(t):
    out = profile.distribution(t.lineitem, LINE_COLUMNS)
    return out.select(
        "column", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"), "is_likely_normal", "error",
    )


def _corr_source(t):
    return t.lineitem.select(
        *LINE_COLUMNS,
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_quantity") * 3 + 1).alias("q3"),
    )


_CORR = LINE_COLUMNS + ["net", "q3"]


@register(
    "corr_pairs",
    "WITH s AS (SELECT l_quantity,l_extendedprice,l_discount,l_tax,l_extendedprice*(1-l_discount) AS net,"
    "l_quantity*3+1 AS q3 FROM lineitem), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{_CORR[j]}' AS col1,'{_CORR[i]}' AS col2, corr({_CORR[i]},{_CORR[j]}) AS c FROM s"
        for i in range(6)
        for j in range(i + 1, 6)
    )
    + ") SELECT col1, col2, round(c,6) AS correlation FROM c WHERE abs(c) >= 0.8",
)
def corr_pairs(t):
    out = profile.strong_correlations(_corr_source(t), _CORR)
    return out.withColumn("correlation", F.round("correlation", 6))


@register(
    "outliers",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE abs((x-m)/s) > 3) AS outlier_count,
        round((count(*) FILTER (WHERE abs((x-m)/s) > 3))::DOUBLE/count(x),8) AS outlier_ratio
        FROM (SELECT {c} AS x, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS s FROM {tbl})"""
        for c, tbl in [("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_discount", "lineitem"), ("l_tax", "lineitem")]
    ),
)
def outliers(t):
    out = profile.outliers(t.lineitem, LINE_COLUMNS)
    return out.withColumn("outlier_ratio", F.round("outlier_ratio", 8))


@register(
    "event_outliers",
    """SELECT 'value' AS "column", count(*) FILTER (WHERE abs((value-m)/s) > 3) AS outlier_count,
       round((count(*) FILTER (WHERE abs((value-m)/s) > 3))::DOUBLE/count(value),8) AS outlier_ratio
       FROM (SELECT value, avg(value) OVER () AS m, stddev_samp(value) OVER () AS s FROM events)""",
)
def event_outliers(t):
    return profile.outliers(t.events, ["value"]).withColumn("outlier_ratio", F.round("outlier_ratio", 8))


@register(
    "recommend",
    """WITH d AS (SELECT text, length(text)::DOUBLE AS len, n_chars::DOUBLE AS n_chars FROM documents),
       st AS (SELECT avg(n_chars) m, stddev_samp(n_chars) s, skewness(n_chars) sk, kurtosis(n_chars) ku,
              count(*) n, stddev_samp(len)/avg(len) AS vr FROM d),
       o AS (SELECT (count(*) FILTER (WHERE abs((n_chars-m)/s)>3))::DOUBLE/count(*) AS r FROM d, st)
       SELECT 'strategy' AS kind, CASE WHEN n<1000 THEN 'transfer' WHEN n<=10000 THEN 'lora' ELSE 'full' END AS subject,
              n::DOUBLE AS value FROM st
       UNION ALL SELECT 'reason_skew','n_chars',round(sk,5) FROM st WHERE abs(sk)>1 AND NOT (abs(sk)<0.5 AND abs(ku)<2)
       UNION ALL SELECT 'reason_outliers','n_chars',round(r,5) FROM o WHERE r>0.05
       UNION ALL SELECT 'strategy','continual',1.0 FROM st WHERE abs(sk)>2
       UNION ALL SELECT 'strategy','curriculum',round(vr,5) FROM st WHERE vr>0.5""",
)
def recommend(t):
    out = profile.recommendation(t.documents, "text", ["n_chars"])
    return out.withColumn("value", F.round("value", 5))


@register(
    "curriculum_order",
    """SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS pos FROM documents""",
)
def curriculum_order(t):
    """Position of every document in shortest-first order."""
    return profile.curriculum_order(t.documents.select("doc_id", "text"), tie="doc_id", position="pos").select("doc_id", "pos")


def packet_lines(t):
    """Events printed as packet summary lines; every 11th line is noise the parser must drop."""
    e = t.events
    ip = lambda c: F.concat(F.lit("10.0."), F.floor(c / 256).cast("string"), F.lit("."), (c % 256).cast("string"))
    line = F.concat_ws(
        " ",
        F.col("event_id").cast("string"),
        F.date_format("ts", "HH:mm:ss.SSSSSS"),
        ip(F.col("user_id")),
        F.lit("10.9.0.1"),
        F.lit("TCP"),
        (F.length("props") + F.floor("value")).cast("string"),
        F.lit("data"),
    )
    return e.select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 11 == 3, F.lit("-- no packet --")).otherwise(line).alias("value")
    )


_PACKETS_SQL = """
WITH pk AS (SELECT event_id AS no, user_id, ts,
  extract('hour' FROM ts)*3600 + extract('minute' FROM ts)*60 + strftime(ts,'%S.%f')::DOUBLE AS time_s,
  (length(props) + floor(value))::BIGINT AS size,
  '10.0.' || (user_id//256) || '.' || (user_id%256) AS src, '10.9.0.1' AS dst
  FROM events WHERE event_id % 11 <> 3),
dl AS (SELECT *, lag(time_s) OVER (PARTITION BY src ORDER BY ts, no) AS p FROM pk),
dd AS (SELECT *, round((time_s - p + CASE WHEN time_s < p THEN 86400.0 ELSE 0.0 END)*1000000, 3)::DOUBLE AS delta_us FROM dl)
"""


@register("packet_lines", _PACKETS_SQL + "SELECT no, round(time_s,6) AS time_s, size, src, dst FROM pk")
def packet_line_scan(t):
    out = flows.parse_packet_lines(packet_lines(t).select("value"))
    return out.select("no", F.round("time_s", 6).alias("time_s"), "size", "src", "dst")


def _deltas(t):
    packets = flows.parse_packet_lines(packet_lines(t))
    return flows.interarrival(packets, ["src"], ["ts", "no"])


@register("interarrival", _PACKETS_SQL + "SELECT no, src, round(delta_us,0)::DOUBLE AS delta_us FROM dd")
def interarrival(t):
    return _deltas(t).select("no", "src", F.round("delta_us", 0).alias("delta_us"))


@register(
    "flow_stats",
    _PACKETS_SQL
    + """SELECT src, count(*) AS matched, count(delta_us) AS deltas, round(min(delta_us),0)::DOUBLE AS min_delta,
    round(max(delta_us),0)::DOUBLE AS max_delta, round(avg(delta_us),-1)::DOUBLE AS mean_delta, sum(size)::BIGINT AS total_bytes,
    min(size) AS min_bytes, max(size) AS max_bytes, round(avg(size),6) AS mean_bytes FROM dd GROUP BY src""",
)
def flow_stats(t):
    s = flows.flow_statistics(_deltas(t), ["src"])
    return s.select(
        "src", "matched", "deltas", F.round("min_delta", 0).alias("min_delta"), F.round("max_delta", 0).alias("max_delta"),
        F.round("mean_delta", -1).alias("mean_delta"), "total_bytes", "min_bytes", "max_bytes",
        F.round("mean_bytes", 6).alias("mean_bytes"),
    )


@register(
    "flow_filter",
    _PACKETS_SQL + "SELECT no, size FROM pk WHERE src = '10.0.0.5' AND dst = '10.9.0.1'",
)
def flow_filter(t):
    return flows.filter_flow(flows.parse_packet_lines(packet_lines(t)), "10.0.0.5", "10.9.0.1").select("no", "size")


@register(
    "packet_export",
    _PACKETS_SQL
    + """SELECT no::VARCHAR AS no, printf('%.6f', time_s) AS time_s, (delta_us IS NULL) AS first, size::VARCHAR AS size FROM dd""",
)
def packet_export(t):
    out = flows.packet_csv_columns(_deltas(t))
    return out.select("no", "time_s", (F.col("delta_us") == "").alias("first"), "size")


@register(
    "events_per_second",
    "SELECT strftime(date_trunc('second', ts),'%Y-%m-%d %H:%M:%S') AS second, count(*) AS events FROM events GROUP BY 1",
)
def events_per_second(t):
    from fieldglass.streaming.jobs import events_per_window

    out = events_per_window(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 second")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("second"), "events")


@register(
    "packet_counters",
    """SELECT user_id, count(*) AS captured, (count(*) + sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END))::BIGINT AS received,
       sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)::BIGINT AS dropped FROM events GROUP BY 1""",
)
def packet_counters(t):
    """Capture summaries printed per user and parsed back into counters."""
    per_user = t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("event_type") == "error").cast("int")).alias("d")
    )
    text = F.format_string(
        "%d packets captured\n%d packets received by filter\n%d packets dropped by kernel\n",
        F.col("c"), F.col("c") + F.col("d"), F.col("d"),
    )
    m = tx.packet_counters(F.col("summary"))
    return per_user.select("user_id", text.alias("summary")).select(
        "user_id", m["captured"].alias("captured"), m["received_by_filter"].alias("received"), tx.packets_dropped(m).alias("dropped")
    )


@register(
    "causal_model",
    """WITH u AS (SELECT l_orderkey, l_linenumber, l_discount AS d, l_quantity AS q, l_tax AS h, l_extendedprice/1000 AS m FROM lineitem),
       b AS (SELECT *, m*(q*(1+2*d))*(1-d) - (h+0.25*(q*(1+2*d))) AS margin, m*(q*(1+2*0.1))*(1-0.1) - (h+0.25*(q*(1+2*0.1))) AS margin_do FROM u)
       SELECT l_orderkey, l_linenumber, round(margin,10)::DOUBLE AS margin, round(margin_do-margin,10)::DOUBLE AS effect FROM b""",
)
def causal_model(t):
    """Margin of each order line, and what a discount of a tenth would change of it."""
    from fieldglass.operators import causal

    noise = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("u_Discount"), F.col("l_quantity").cast("double").alias("u_Demand"),
        F.col("l_tax").alias("u_Handling"), (F.col("l_extendedprice") / 1000).alias("u_Margin"))
    out = causal.counterfactual(noise, causal.order_model(), {"Discount": 0.1}, "Margin")
    return out.select("l_orderkey", "l_linenumber", F.round("base", 10).alias("margin"), F.round("effect", 10).alias("effect"))
