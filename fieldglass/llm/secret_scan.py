"""Secret scanning with an incremental ledger of content-addressed texts.

A text version is named by the SHA-256 of its content (its blob). The ledger says which rule
versions have seen which blob and what they found. A scan takes each blob once, however many
paths hold it, with only those rule versions that have not seen it; findings are joined back
to every path. A null text is an empty one. Repeated rows give repeated results; an empty table
gives an empty one and leaves the ledger as it is.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialise, tidy

FINDINGS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"


class SecretRule(NamedTuple):
    """Leftmost matches of ``pattern`` without overlap; those whose ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: a text without any of these strings, taken in lower case if the pattern takes either case, has no match
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed base rules: kinds, patterns and lengths.
BASE_RULES = (
    SecretRule("assign", 1, r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("=", ":")),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    SecretRule("hex", 1, r"(?<![0-9a-f])[0-9a-f]+", 0, 16),
)
#: Further public token formats.
MORE_RULES = (
    SecretRule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    SecretRule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, ("eyJ",)),
    SecretRule("prefixed_token", 1, r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1, ("gh", "xox", "sk_live_")),
)
RULES = BASE_RULES + MORE_RULES


def find_secrets(text: str, rules: dict[str, tuple], wanted) -> list[tuple[str, int, int]]:
    """Spans (rule, start, end) in code points of the wanted rules; ``rules`` holds compiled patterns by name."""
    out = []
    for name in wanted:
        pattern, group, least, hints = rules[name]
        if hints and not any(h in text for h in hints):
            continue
        out += [(name, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """New rows of the ledger: for each blob the rules that saw it now and what they found.

    ``versions`` has ``doc_id`` (the path) and ``text``. Blobs are reduced to one path each
    before their text moves; the text goes by path, so copies of one blob never meet in a task.
    """
    path = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    names = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    unseen = names.groupBy("blob").agg(F.min(path).alias("path"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        unseen = unseen.withColumn("rules", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))  # as many as there are rule versions
        missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = unseen.join(seen, "blob", "left").withColumn("rules", missing).where(F.size("rules") > 0)
    todo = materialise(unseen.select("blob", F.col("path.doc_id").alias("path"), "rules"), "unseen")
    table = {r.name: (r.pattern, r.group, r.least, r.hints) for r in rules}

    def scan(frames):
        import pandas as pd

        compiled = {name: (re.compile(p), *rest) for name, (p, *rest) in table.items()}
        for frame in frames:
            found = [find_secrets(text, compiled, wanted) for text, wanted in zip(frame["text"], frame["rules"], strict=True)]
            rows = [[{"rule": n, "start": a, "end": b} for n, a, b in spans] for spans in found]
            yield pd.DataFrame({"blob": frame["blob"], "rules": frame["rules"], "findings": pd.Series(rows, index=frame.index, dtype=object)})

    texts = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob_of(F.col("text")).alias("blob")).alias("v")
    same = F.col("v.doc_id").eqNullSafe(F.col("t.path")) & (F.col("v.blob") == F.col("t.blob"))
    scanned = texts.join(todo.alias("t"), same).select("v.text", "v.blob", "t.rules").mapInPandas(tidy(scan), LEDGER)
    return materialise(scanned.dropDuplicates(["blob"]), "ledger")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``blob`` and ``findings`` (by start, then rule) of every version, and the ledger as it is now."""
    new = scan_unseen(versions, ledger, rules)
    known = new if ledger is None else ledger.unionByName(new)
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    valid = F.filter("findings", lambda f: f["rule"].isin([r.name for r in rules]))
    keyed = F.transform(valid, lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("at"), f["end"].alias("end"), f["rule"].alias("rule")))
    found = known.withColumn("f", keyed).where(F.size("f") > 0).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias("f"))  # one row for each scan of a blob
    found = materialise(found, "found")
    names = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    joined = names.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("f", F.array().cast(found.schema["f"].dataType)).alias("findings"))
    return joined, known


def kind_of(finding: Column) -> Column:
    return F.split_part(finding["rule"], F.lit("@"), F.lit(1))


def joined_spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", kind_of(f), f["start"].cast("string"), f["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans."""
    found, _ = scan_versions(docs.select("doc_id", "text"))
    base = F.filter("findings", lambda f: kind_of(f).isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("findings", lambda f: kind_of(f) == kind)).cast("bigint")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that overlap become one mark."""
    found, _ = scan_versions(docs.select("doc_id", "text"))
    hit = found.where(F.size("findings") > 0).select("doc_id", "blob", "findings").distinct().alias("f")

    @F.pandas_udf("string")
    def cut(texts, findings):
        import pandas as pd

        out = []
        for text, spans in zip(texts, findings, strict=True):
            if spans is None:
                out.append(text)
                continue
            parts, last = [], 0
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if start >= last:
                    parts += [text[last:start], mark]
                last = max(last, end)
            out.append("".join([*parts, text[last:]]))
        return pd.Series(out, dtype=object)

    named = docs.withColumn("__blob", blob_of(F.col("text"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__blob") == F.col("f.blob"))
    joined = named.join(hit, same, "left")
    return joined.select(*[F.when(F.col("f.findings").isNull(), F.col("d.text")).otherwise(cut(F.col("d.text"), F.col("f.findings"))).alias("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns])
