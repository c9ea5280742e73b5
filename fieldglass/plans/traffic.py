"""Traffic accounting queries over the conversations table."""

from pyspark.sql import functions as F

from fieldglass.operators import evaluate, traffic
from fieldglass.plans.registry import register


def calls(t):
    """One model call per message: tokens from its length, wire bytes with a fixed frame."""
    n = F.length("text")
    return t.conversations.select(
        F.col("conv_id").alias("run_id"),
        "turn",
        F.when(F.col("role") == "user", "stateless").otherwise("stateful").alias("mode"),
        F.floor(n / 4).cast("long").alias("prompt_tokens"),
        (F.floor(n / 4) + 7).cast("long").alias("total_tokens"),
        (n + 100).cast("long").alias("wire_sent"),
        F.lit(60).cast("long").alias("wire_recv"),
        n.cast("long").alias("req_payload_bytes"),
        F.lit(20).cast("long").alias("resp_payload_bytes"),
        F.when(F.col("turn") > 2, F.floor(n / 8)).otherwise(0).cast("long").alias("cached_tokens"),
        F.when(F.col("role") == "system", "no reply").otherwise("").alias("error"),
    )


_CALLS = """WITH c AS (SELECT conv_id AS run_id, turn, CASE WHEN role='user' THEN 'stateless' ELSE 'stateful' END AS mode,
  length(text)//4 AS prompt_tokens, length(text)//4+7 AS total_tokens, length(text)+160 AS wire, length(text)+20 AS payload,
  CASE WHEN turn>2 THEN length(text)//8 ELSE 0 END AS cached, CASE WHEN role='system' THEN 'no reply' ELSE '' END AS error FROM conversations)
"""


@register(
    "running_traffic",
    _CALLS
    + """SELECT run_id, turn, (sum(total_tokens) OVER w)::BIGINT AS cum_tokens, (sum(prompt_tokens) OVER w)::BIGINT AS cum_prompt_tokens,
    (sum(wire) OVER w)::BIGINT AS cum_wire_bytes, (sum(payload) OVER w)::BIGINT AS cum_payload_bytes FROM c
    WINDOW w AS (PARTITION BY run_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def running_traffic(t):
    return traffic.running_series(calls(t)).select(
        "run_id", "turn", "cum_tokens", "cum_prompt_tokens", "cum_wire_bytes", "cum_payload_bytes"
    )


@register("run_errors", _CALLS + "SELECT run_id, turn, error FROM c WHERE error <> ''")
def run_errors(t):
    return traffic.run_errors(calls(t))


@register(
    "run_totals",
    _CALLS
    + """SELECT run_id, mode, sum(total_tokens)::BIGINT AS tokens, sum(wire)::BIGINT AS wire_bytes, sum(payload)::BIGINT AS content_bytes,
    sum(cached)::BIGINT AS cached_tokens, sum(CASE WHEN cached>0 THEN 1 ELSE 0 END)::BIGINT AS caches_used,
    round(sum(total_tokens)*1e-7::DOUBLE,6) AS cost_usd FROM c GROUP BY 1,2""",
)
def run_totals(t):
    return traffic.run_totals(calls(t), ["run_id", "mode"])


@register(
    "compare_runs",
    _CALLS
    + """, s AS (SELECT run_id, coalesce(sum(wire) FILTER (WHERE mode='stateless'),0)::BIGINT AS stateless_wire,
    coalesce(sum(wire) FILTER (WHERE mode='stateful'),0)::BIGINT AS stateful_wire,
    coalesce(sum(payload) FILTER (WHERE mode='stateless'),0)::BIGINT AS stateless_content,
    coalesce(sum(payload) FILTER (WHERE mode='stateful'),0)::BIGINT AS stateful_content,
    coalesce(sum(cached) FILTER (WHERE mode='stateful'),0)::BIGINT AS cached_tokens FROM c GROUP BY 1)
    SELECT *, round(stateless_wire::DOUBLE/nullif(stateful_wire,0),2) AS wire_ratio,
    round(stateless_content::DOUBLE/nullif(stateful_content,0),2) AS content_ratio FROM s""",
)
def compare_runs(t):
    return traffic.compare_runs(calls(t), ["run_id"])


@register(
    "resend_cost",
    """WITH s AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS UNBOUNDED PRECEDING) AS c FROM conversations)
       SELECT conv_id, turn, greatest(1, c//4)::BIGINT AS stateless_tokens, greatest(1, n//4)::BIGINT AS stateful_tokens
       FROM s WHERE role='user'""",
)
def resend_cost(t):
    return traffic.resend_cost(t.conversations)


@register(
    "resend_cost_ack",
    """WITH s AS (SELECT conv_id, turn, role, length(text) AS n, sum(CASE WHEN role='assistant' THEN 5 ELSE length(text) END)
       OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS c FROM conversations)
       SELECT conv_id, turn, greatest(1, c//4)::BIGINT AS stateless_tokens, greatest(1, n//4)::BIGINT AS stateful_tokens
       FROM s WHERE role='user'""",
)
def resend_cost_ack(t):
    return traffic.resend_cost(t.conversations, ack_answers=True)


@register(
    "last_turns",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
       SELECT conv_id, string_agg((CASE WHEN role='user' THEN 'User: ' ELSE 'Assistant: ' END) || text, chr(10) ORDER BY turn) AS history
       FROM r WHERE b <= 10 GROUP BY 1""",
)
def last_turns(t):
    return traffic.last_turns(t.conversations)


@register(
    "run_documents",
    _CALLS
    + """SELECT run_id AS exec_id, 'caching' AS mode, false AS mock, sum(total_tokens)::BIGINT AS tokens,
    sum(wire)::BIGINT AS wire_bytes FROM c GROUP BY 1""",
)
def run_documents(t):
    """Runs written as nested JSON documents and listed again by projection."""
    from fieldglass.sources import stores

    return stores.list_runs(stores.run_documents(calls(t))).select(
        "exec_id", "mode", "mock", F.col("totals.tokens").alias("tokens"), F.col("totals.wire_bytes").alias("wire_bytes")
    )


@register(
    "delta_vs_baseline",
    _CALLS
    + """, m AS (SELECT CASE WHEN run_id%7=0 THEN 'baseline' ELSE 'preset' || (run_id%7) END AS preset,
    avg(total_tokens) AS tokens, avg(wire) AS wire FROM c GROUP BY 1)
    SELECT m.preset, round(m.tokens-b.tokens,6) AS d_tokens, round(m.wire-b.wire,6) AS d_wire FROM m,
    (SELECT * FROM m WHERE preset='baseline') b WHERE m.preset<>'baseline'""",
)
def delta_vs_baseline(t):
    preset = F.when(F.col("run_id") % 7 == 0, "baseline").otherwise(
        F.concat(F.lit("preset"), (F.col("run_id") % 7).cast("string"))
    )
    summary = calls(t).groupBy(preset.alias("preset")).agg(
        F.avg("total_tokens").alias("tokens"), F.avg(F.col("wire_sent") + F.col("wire_recv")).alias("wire")
    )
    out = evaluate.delta_vs_baseline(summary, "preset", ["tokens", "wire"])
    return out.select("preset", F.round("d_tokens", 6).alias("d_tokens"), F.round("d_wire", 6).alias("d_wire"))
