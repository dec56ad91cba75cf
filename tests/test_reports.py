"""Recommendation blocks, gauges, Markdown to HTML, and the run log."""

import random
import re

from pyspark.sql import functions as F

from insightspark.operators import reports, run_log


def test_recommendation_block(spark):
    item = "struct<rank:int,action:string,rationale:string,priority:string,timeframe:string>"
    df = spark.createDataFrame(
        [(0, [(2, "Act", "Why", "high", "short_term"), (1, "B", None, None, "now")]), (1, []), (2, None)], f"id int, r array<{item}>"
    )
    found = [r[0] for r in df.orderBy("id").select(reports.recommendation_block(F.col("r"))).collect()]
    assert found == ["2. **Act** [HIGH / short term]\n   Why\n1. **B** [ / now]\n   ", "None available.", "None available."]


def test_gauges(spark):
    df = spark.createDataFrame([(n, ["f"] * n) for n in range(9)] + [(9, None)], "n int, findings array<string>")
    signal = reports.market_signal(F.col("findings"))
    found = [tuple(r) for r in df.orderBy("n").select(signal, reports.gauge_band(signal), reports.terminal_gauge_band(signal)).collect()]
    assert [f[0] for f in found] == [0, 15, 30, 45, 60, 75, 90, 100, 100, 0]
    assert [f[1] for f in found] == ["dim", "alert", "alert", "brass", "brass", "green", "green", "green", "green", "dim"]
    assert {f[2] for f in found[:3]} == {"red"} and found[3][2] == "yellow"


def model_html(markdown):
    """The conversion as a rule per line and a fold over list items."""

    def marks(text):
        for pattern, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"\*(.+?)\*", "em"), (r"`(.+?)`", "code")):
            text = re.sub(pattern, rf"<{tag}>\1</{tag}>", text)
        return text

    out, listed = [], False
    for line in [raw.strip() for raw in markdown.split("\n")]:
        item = line[:2] in ("- ", "* ")
        if item != listed:
            out.append("<ul>" if item else "</ul>")
            listed = item
        heading = re.match(r"(#{1,3}) ", line)
        number = re.match(r"\d+\.\s+", line)
        if heading:
            level = len(heading[1])
            out.append(f"<h{level}>{marks(line[level + 1:])}</h{level}>")
        elif item:
            out.append(f"<li>{marks(line[2:])}</li>")
        elif number:
            out.append(f"<p class='numbered'>{marks(line[number.end():])}</p>")
        elif line in ("---", ""):
            out.append("<hr>" if line else "")
        else:
            out.append(f"<p>{marks(line)}</p>")
    return "\n".join(out + (["</ul>"] if listed else []))


LINES = ["# A", "## B **x**", "### C", "#### D", "- item", "* other *it*", "-none", "1. one", "12.  two", "3.three", "---", "", "  ", "text `c` & <b>", "**a** *b* **", "-", "٣. arabic", " - padded ", "line sep *x y*", "---- "]


def test_markdown(spark):
    chance = random.Random(9)
    texts = ["\n".join(chance.choice(LINES) for _ in range(chance.randint(1, 12))) for _ in range(500)] + ["", "- only"]
    df = spark.createDataFrame([(t,) for t in texts], "markdown string")
    for row in reports.markdown_to_html(df).collect():
        assert row.html == model_html(row.markdown), row.markdown


def test_state(spark, rows):
    updates = spark.createDataFrame(
        [(1, 1, "status", "a"), (1, 3, "status", "c"), (1, 2, "status", "b"), (1, 4, "errors", "e1"), (1, 5, "errors", "e2"), (2, 1, "summary", None)],
        "run_id int, seq bigint, field string, value string",
    ).repartition(4)
    assert rows(run_log.fold_state(updates)) == [(1, "status", 3, "c"), (2, "summary", 1, None)]
    assert rows(run_log.fold_errors(updates)) == [(1, 4, "e1"), (1, 5, "e2")]


def test_steps(spark, rows):
    events = spark.sql(
        """SELECT * FROM VALUES
        (1, 'research', 'node_start', 'running', timestamp_ntz'2024-01-01 00:00:00', 1L),
        (1, 'research', 'node_complete', 'research_complete', timestamp_ntz'2024-01-01 00:00:02.25', 2L),
        (1, 'report', 'node_start', 'running', timestamp_ntz'2024-01-01 00:00:03', 3L),
        (1, 'report', 'node_start', 'running', timestamp_ntz'2024-01-01 00:00:04', 4L)
        AS t(run_id, node, type, status, ts, seq)"""
    )
    assert rows(run_log.step_status(events)) == [(1, "report", "running", None), (1, "research", "research_complete", round(2.25, 1))]
