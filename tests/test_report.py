import json

import pandas as pd
import pytest

from colsight.errors import DatasetError
from colsight.operators.regression import fit_linear_regression
from colsight.plans.analysis import analyse
from colsight.plans.report import NO_PAIRS, report_text, write_records, write_report


@pytest.fixture(scope="module")
def table(spark):
    n = range(1, 41)
    pdf = pd.DataFrame({"id": n, "a|b": [float(i) for i in n], "y": [2.0 * i + (i % 3) for i in n], "kind": ["u", "v"] * 20})
    pdf.loc[3, "a|b"] = None
    return spark.createDataFrame(pdf)


def test_whole_report(table, tmp_path):
    analysis = analyse(table, "table.csv", ["id"])
    model = analysis.train("y", key=["id"])
    text = report_text(analysis.report(model))
    lines = text.split("\n")
    assert lines[0] == "# Table profile: table.csv" and "- **Rows**: 40" in lines
    assert "- **Missing cells**: 1" in lines
    assert "| `a\\|b` | `double` | 1 | 2.5% | 39 |" in lines
    assert any(line.startswith("| `id` | 20.5 | 11.6905 | 1.0 | 20.5 | 40.0 |") for line in lines)
    assert "## Linear Regression Results" in lines and "- **Rows fitted**: 32" in lines
    assert "| `id` | `a\\|b` | 1.0 |" in lines
    assert lines.index("### Weights") > lines.index("- **Predicted column**: `y`")
    order = [line for line in lines if line.startswith("##")]
    assert [o.split()[1] for o in order if o.startswith("## ")] == ["Size", "Columns", "Numeric", "Strongest", "Linear"]

    path = write_report(analysis.report(model), str(tmp_path), "table.csv")
    assert path == str(tmp_path / "table-report")
    (part,) = (tmp_path / "table-report").glob("part-*")
    assert part.read_text() == text + "\n"


def test_report_without_pairs_or_model(spark):
    text = report_text(analyse(spark.createDataFrame([("a", 1)], "s string, x int"), "t").report())
    assert NO_PAIRS in text and "Regression" not in text and "| One |" not in text


def test_record_sink(table, tmp_path):
    analysis = analyse(table, key=["id"])
    write_records(analysis.record(), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.json")
    record = json.loads(part.read_text())
    assert record["row_count"] == 40 and len(record["columns"]) == 4 and len(record["preview"]) == 10
    assert [s["name"] for s in record["statistics"]] == ["id", "a|b", "y"]
    assert record["pairs"][0]["rank"] == 1 and len(record["matrix"]) == 3


def test_limits(table):
    with pytest.raises(DatasetError, match="the limit"):
        analyse(table, max_rows=10)
    with pytest.raises(DatasetError, match="not numeric"):
        fit_linear_regression(table, "kind")
