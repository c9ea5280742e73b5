"""Token and byte accounting of multi-turn model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.operators.ordered import number_slice, running_totals, top_per_group

TURNS_PER_SLICE = 1024


def estimate_tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / fixed.CHARS_PER_TOKEN)).cast("long")


def running_series(calls: DataFrame, run: str = "run_id", turn: str = "turn") -> DataFrame:
    """Cumulative tokens and bytes per run in turn order."""
    col = F.col
    return running_totals(
        calls,
        [run],
        [turn],
        {
            "cum_tokens": col("total_tokens"),
            "cum_prompt_tokens": col("prompt_tokens"),
            "cum_wire_bytes": col("wire_sent") + col("wire_recv"),
            "cum_payload_bytes": col("req_payload_bytes") + col("resp_payload_bytes"),
        },
        number_slice(turn, TURNS_PER_SLICE),
    )


def run_errors(calls: DataFrame, run: str = "run_id", turn: str = "turn") -> DataFrame:
    """Error texts of a run with their position, one row each."""
    return calls.filter(F.coalesce(F.col("error"), F.lit("")) != "").select(run, turn, "error")


def run_totals(calls: DataFrame, keys: list[str], price: float = fixed.PRICE_PER_TOKEN) -> DataFrame:
    """Final totals and cost; the last value of a running sum is the plain sum, so no ordering is needed."""
    totals = calls.groupBy(*keys).agg(
        F.sum("total_tokens").alias("tokens"),
        F.sum(F.col("wire_sent") + F.col("wire_recv")).alias("wire_bytes"),
        F.sum(F.col("req_payload_bytes") + F.col("resp_payload_bytes")).alias("content_bytes"),
        F.sum("cached_tokens").alias("cached_tokens"),
        F.sum((F.col("cached_tokens") > 0).cast("long")).alias("caches_used"),
    )
    return totals.withColumn("cost_usd", F.round(F.col("tokens") * F.lit(price), 6))


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 2)


def compare_runs(calls: DataFrame, keys: list[str], mode: str = "mode") -> DataFrame:
    """Stateless against stateful totals side by side, by conditional sums in one aggregate."""
    wire = F.col("wire_sent") + F.col("wire_recv")
    content = F.col("req_payload_bytes") + F.col("resp_payload_bytes")
    of = lambda m, v: F.coalesce(F.sum(F.when(F.col(mode) == m, v)), F.lit(0))
    sides = calls.groupBy(*keys).agg(
        of("stateless", wire).alias("stateless_wire"),
        of("stateful", wire).alias("stateful_wire"),
        of("stateless", content).alias("stateless_content"),
        of("stateful", content).alias("stateful_content"),
        of("stateful", F.coalesce(F.col("cached_tokens"), F.lit(0))).alias("cached_tokens"),
    )
    return sides.withColumn("wire_ratio", ratio(F.col("stateless_wire"), F.col("stateful_wire"))).withColumn(
        "content_ratio", ratio(F.col("stateless_content"), F.col("stateful_content"))
    )


def resend_cost(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", ack_answers: bool = False) -> DataFrame:
    """Prompt tokens of each question when the history is resent, and when only the question is sent.

    Stateless turn k carries the system text, every earlier question and answer
    and question k. With ``ack_answers`` each earlier answer counts as the fixed
    acknowledgement.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    carried = size
    if ack_answers:
        carried = F.when(F.col("role") == "assistant", F.lit(len(fixed.ACK_TEXT))).otherwise(size)
    upto = running_totals(messages, [conv], [turn], {"sent_chars": carried}, number_slice(turn, TURNS_PER_SLICE))
    return upto.filter(F.col("role") == "user").select(
        conv,
        turn,
        estimate_tokens(F.col("sent_chars")).alias("stateless_tokens"),
        estimate_tokens(size).alias("stateful_tokens"),
    )


def last_turns(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", turns: int = fixed.HISTORY_TURNS
) -> DataFrame:
    """The last ``turns`` question/answer pairs as one text per conversation.

    The rank filter keeps at most ``2 * turns`` rows per conversation in each
    task, so the collected list is bounded.
    """
    recent = top_per_group(messages, [conv], [F.col(turn).desc()], 2 * turns, "_back")
    line = F.concat(
        F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce(F.col("text"), F.lit(""))
    )
    return recent.groupBy(conv).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn), line.alias("l")))), lambda s: s.l), "\n"
        ).alias("history")
    )
