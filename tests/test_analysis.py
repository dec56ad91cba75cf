"""The fixed sequences end to end, on a small sales file and two documents."""

import json

from insightspark.operators import chart_data, revenue
from insightspark.plans import analysis
from insightspark.sources.text_documents import read_text_documents

SALES = """Transaction ID,Year,Region ,Build Category,Vehicle Platform,Order Date,Total Revenue
1,2022, south ,baja_prerunner,truck,01/15/2022,100.50
2,2022,west,rock,jeep,02/20/2022,50
2,2022,west,rock,jeep,02/20/2022,50
3,2023,south,baja_prerunner,truck,03/25/2023,201
4,2023,NA,rock,jeep,04/30/2023,
"""


def test_file_to_findings(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(SALES)
    table = analysis.open_table(spark, str(tmp_path / "sales.csv"))
    assert table.columns == ["transaction_id", "year", "region", "build_category", "vehicle_platform", "order_date", "total_revenue"]
    rows, suggested = analysis.upload_summary(table)
    assert rows == 4 and suggested[0].startswith("Which year showed") and len(suggested) == 5
    parts = analysis.findings(table)
    assert [tuple(r) for r in parts["growth_rates"].orderBy("group", "year").collect()] == [
        ("baja_prerunner", 2022, 100.5, None), ("baja_prerunner", 2023, 201.0, 100.0), ("rock", 2022, 50.0, None), ("rock", 2023, 0.0, -100.0),
    ]
    assert [tuple(r) for r in parts["date_range"].collect()] == [("order_date", "2022-01-15 00:00:00", "2023-04-30 00:00:00")]
    assert parts["top_vehicles"].first().key == "truck"
    sections = {}
    for section, row in analysis.finding_rows(parts).collect():
        sections.setdefault(section, []).append(json.loads(row))
    assert set(sections) == set(parts)
    assert {"key": "south", "revenue": 301.5} in sections["revenue_by_region"]


def test_documents_to_context(spark, tmp_path):
    def letters():
        return lambda texts: [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    (tmp_path / "zebra.txt").write_text("zebra zoo zigzag")
    (tmp_path / "kayak.md").write_text("kayak kick kiosk")
    corpus = analysis.embedded_corpus(read_text_documents(spark, str(tmp_path)), letters)
    runs = spark.createDataFrame([(1, "zoo zebras?", []), (2, "kick", None)], "run_id int, question string, findings array<string>")
    found = dict(map(tuple, analysis.run_contexts(runs, corpus, letters, k=1).collect()))
    block = "[Document 1]\nzebra zoo zigzag"
    assert found == {1: f"{block}\n\n---\n\n{block}", 2: "[Document 1]\nkayak kick kiosk"}


def test_revenue_findings_equal_the_single_operators(spark):
    rows = [
        ("rock", "south", "jeep", 2022, 10.25), ("baja_prerunner", None, "truck", 2022, 5.0), (None, "west", "truck", 2023, 7.5),
        ("rock", "west", None, None, 1.0), ("rock", "south", "jeep", 2024, None), ("baja_prerunner", "south", "van", 2023, float("nan")), (None, None, None, None, 3.0),
    ]
    df = spark.createDataFrame(rows, "build_category string, region string, vehicle_platform string, year int, total_revenue double")
    plain = {
        "revenue_by_build_category": lambda t: revenue.revenue_by_dimension(t, "build_category"), "revenue_by_region": lambda t: revenue.revenue_by_dimension(t, "region"),
        "revenue_by_year": lambda t: revenue.revenue_trend(t, "year"), "growth_rates": lambda t: revenue.growth_rates(t, "build_category"),
        "top_vehicles": lambda t: revenue.top_performers(t, "vehicle_platform"), "charts": chart_data.chart_data,
    }
    for table in (df, df.limit(0), df.drop("year"), df.drop("build_category", "region"), df.drop("total_revenue")):
        found = analysis.revenue_findings(table)
        assert set(found) == set(plain)
        for name, model in plain.items():
            ordered = list if name not in ("growth_rates", "charts") else lambda x: sorted(x, key=repr)
            assert ordered(map(tuple, found[name].collect())) == ordered(map(tuple, model(table).collect())), (name, table.columns)
