"""Column names with dots, backticks, spaces and quotes work everywhere."""

from colsight.operators import explore
from colsight.plans.analysis import analyse
from colsight.plans.report import report_text
from colsight.sources.inference import infer_types


def test_awkward_names(spark):
    rows = [(i, i / 2, float(i % 5), "u" if i % 3 else "v", f"{i}") for i in range(60)]
    names = ["the id", "a.b", "c`d", "k'ind", "text.1"]
    df = spark.createDataFrame(rows, "i int, a double, b double, c string, d string").toDF(*names)
    analysis = analyse(df, "odd", ["the id"])
    model = analysis.train("a.b", ["the id", "c`d"], key=["the id"])
    text = report_text(analysis.report(model))
    assert "| `a.b` |" in text and "`c`d`" in text and "- **R² held out**: 1.0" in text
    assert analysis.record().first()["row_count"] == 60 and analysis.preview.count() == 10
    assert model.points().count() == 12 and model.median_baseline().count() == 2
    assert explore.grouped_aggregate(df, ["k'ind"], "a.b").count() == 2
    assert explore.top_categories(df).where("name = 'text.1'").count() == 3
    assert explore.category_concentration(df, "k'ind").first()["category_count"] == 2
    assert explore.outlier_counts(df).count() == 3 and explore.duplicate_rows(df).first()["duplicate_rows"] == 0
    assert explore.histogram(df, bins=4).count() == 12
    assert [r["dtype"] for r in infer_types(df.select("`text.1`")).collect()] == ["bigint"]
