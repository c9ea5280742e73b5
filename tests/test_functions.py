"""Column functions on small hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from fieldglass import fixed_values as fixed
from fieldglass.functions import text as tx
from fieldglass.functions import vectors


def one(spark, column, **values):
    """Value of a column expression over a one-row frame of strings."""
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_js_distance(spark):
    got = one(spark, vectors.js_distance(doubles(0.5, 0.5, 0), doubles(0.25, 0.25, 0.5)))
    assert got == pytest.approx(0.464501, abs=1e-6)
    assert one(spark, vectors.js_distance(doubles(1, 0), doubles(0, 1))) == pytest.approx(math.sqrt(math.log(2)))


def test_zero_mass_scores_zero(spark):
    for method in vectors.METHODS:
        assert one(spark, vectors.distribution_change(doubles(0, 0), doubles(1, 0), 2, method)) == 0.0
    with pytest.raises(ValueError):
        vectors.distribution_change(F.lit(1), F.lit(1), 1, "cosine")


def test_wasserstein_compares_sorted_values(spark):
    assert one(spark, vectors.wasserstein_values(doubles(0.7, 0.3), doubles(0.3, 0.7))) == 0.0
    assert one(spark, vectors.wasserstein_histogram(doubles(0.7, 0.3), doubles(0.3, 0.7), 2)) == pytest.approx(0.4)


def test_row_distribution(spark):
    got = one(spark, vectors.row_distribution([F.lit(1.0), F.lit(float("nan")), F.lit(None), F.lit(3)]))
    assert got == [0.25, 0.0, 0.0, 0.75]
    assert one(spark, vectors.row_distribution([F.lit(0.0), F.lit(0.0)])) == [0.0, 0.0]


def test_l2_normalise_keeps_zero(spark):
    assert one(spark, vectors.l2_normalise(doubles(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalise(doubles(0, 0))) == [0.0, 0.0]


def test_clean_vectors(spark):
    dirty = F.array(F.lit(1.0), F.lit(None), F.lit(float("nan")), F.lit(float("-inf")), F.lit(2.0))
    assert one(spark, vectors.clean_dense(dirty)) == [1.0, 2.0]
    sparse = F.map_from_arrays(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(0.5), F.lit(float("inf")), F.lit(None)))
    assert one(spark, vectors.clean_sparse(sparse)) == {1: 0.5}


def test_words_split_like_python(spark):
    text = " a b　c\x1cd e  f\n"
    assert one(spark, tx.words(F.col("t")), t=text) == text.split()


def test_section_header(spark):
    for raw, num, title in [
        ("4.1.1 Overview", "4.1.1", "Overview"),
        ("4 Scope ##", "4", "Scope"),
        ("Overview", "", "Overview"),
        ("4.1. Odd", "", "4.1. Odd"),
    ]:
        assert one(spark, tx.section_number(F.col("t")), t=raw) == num
        assert one(spark, tx.section_title(F.col("t")), t=raw) == title
    assert one(spark, tx.parent_sections(F.col("t")), t="4.1.1") == ["4", "4.1"]
    assert one(spark, tx.parent_sections(F.col("t")), t="4") == []
    assert one(spark, tx.parent_sections(F.col("t")), t="") == []


def test_clock(spark):
    assert one(spark, tx.clock_seconds(F.col("t")), t="01:02:03.5") == 3723.5
    assert one(spark, tx.clock_seconds(F.col("t")), t="12.25") == 12.25
    assert one(spark, tx.clock_seconds(F.col("t")), t="noon") is None


def test_codes(spark):
    for code, kind in [(" a0000001r", "RAN"), ("H123d", "NON_RAN"), ("A123D", "NON_RAN"), ("B123D", "UNKNOWN"), ("", "UNKNOWN")]:
        assert one(spark, tx.alarm_type(F.col("t")), t=code) == kind


def test_ranges(spark):
    for raw, low, high in [("0 ~ 1024", "0", "1024"), ("0-9", "0", "9"), ("-5", "", "5"), ("7", "7", ""), ("-1 ~ 3", "-1", "3")]:
        assert one(spark, tx.range_low(F.col("t")), t=raw) == low
        assert one(spark, tx.range_high(F.col("t")), t=raw) == high


def test_spec_number(spark):
    assert one(spark, tx.spec_number(F.col("t")), t="29502-i40") == "29.502"
    assert one(spark, tx.spec_number(F.col("t")), t="295021") == "29.502"
    assert one(spark, tx.spec_number(F.col("t"), True), t="295021") == ""
    assert one(spark, tx.spec_number(F.col("t")), t="spec") == ""


def test_overlap_windows(spark):
    for n in (0, 1, 5, 6, 9, 10, 14):
        words = [str(i) for i in range(n)]
        got = one(spark, tx.overlap_windows(F.array(*[F.lit(w) for w in words]).cast("array<string>"), 5, 1))
        want, start = [], 0
        while n > 5 and start < n:
            want.append(words[start : start + 5])
            if start + 5 >= n:
                break
            start += 4
        assert got == (want if n > 5 else [words])
    with pytest.raises(ValueError):
        tx.overlap_windows(F.array(), 5, 5)


def test_text_samples(spark):
    sections = "".join(f"\n# s{i} " + "x" * 60 for i in range(12))
    got = one(spark, tx.text_samples(F.col("t"), 20, 5), t="head" + sections)
    parts = [s for s in ("head" + sections).replace("\n#", "\x00#").split("\x00") if len(s.strip()) > 50]
    assert got == [parts[int(i * (len(parts) - 1) / 4)][:20] for i in range(5)]
    long = "".join(chr(97 + i % 26) for i in range(1000))
    got = one(spark, tx.text_samples(F.col("t"), 100, 5), t=long)
    want = [long[:100]] + [long[int(1000 * (i / 4)) - 50 : int(1000 * (i / 4)) + 50] for i in (1, 2, 3)] + [long[-100:]]
    assert got == want
    assert one(spark, tx.text_samples(F.col("t"), 100, 5), t="short") == ["short"]


def test_headers_and_hints(spark):
    assert one(spark, tx.parse_headers(F.col("t")), t='{"A": "1", "B": "x"}') == {"A": "1", "B": "x"}
    assert one(spark, tx.parse_headers(F.col("t")), t="A: 1\nnone\nB:http://x:80\nA: 2") == {"B": "http://x:80", "A": "2"}
    assert one(spark, tx.parse_headers(F.col("t")), t="  ") == {}
    hints = one(spark, tx.protocol_hints(F.create_map(F.lit("X-MCP"), F.lit("JSON-RPC text/event-stream"))))
    assert hints == sorted(fixed.PROTOCOL_HINTS[k] for k in ("mcp", "json-rpc", "text/event-stream"))


def test_packet_counters(spark):
    text = "12 packets captured\n14 packets received by filter\n2 packets dropped by kernel\n"
    got = one(spark, tx.packet_counters(F.col("t")), t=text)
    assert got == {"captured": 12, "received_by_filter": 14, "dropped_by_kernel": 2}
    assert one(spark, tx.packets_dropped(tx.packet_counters(F.col("t"))), t=text) == 2


def test_first_score(spark):
    for reply, score in [("0.8", 0.8), ("Score: .75", 0.75), ("1", 1.0), ("none", 0.0), ("rating 0", 0.0)]:
        assert one(spark, tx.first_score(F.col("t")), t=reply) == score


def test_markdown_table(spark):
    rows = F.array(
        F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1\n2")), F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    )
    got = one(spark, tx.markdown_table(rows, F.lit("[t]")))
    assert got == "[t]\n| a | b |\n| --- | --- |\n| 1<br>2 |  |\n| x | y |"


def test_json_object_text(spark):
    reply = 'Sure {"a": 1, // one\n "b": {"u": "http://x"}} done'
    got = one(spark, F.from_json(tx.json_object_text(F.col("t")), "a int, b map<string,string>"), t=reply)
    assert got["a"] == 1 and got["b"] == {"u": "http://x"}
    assert one(spark, tx.json_object_text(F.col("t")), t="nothing") is None


def test_slug(spark):
    assert one(spark, tx.slug(F.col("t")), t=" Fig. 3: Über--view ") == "fig_3_ber_view"


def test_stray_letter(spark):
    assert one(spark, tx.drop_stray_letter(F.col("t")), t="some text  X") == "some text"
    assert one(spark, tx.drop_stray_letter(F.col("t")), t="plan B2") == "plan B2"
