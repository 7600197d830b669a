"""Reports of a few collected rows: Markdown summaries and the frontier as SVG."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame


def table(df: DataFrame, digits: int = 4) -> str:
    """df, which is small, as a Markdown table."""
    show = lambda x: f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = [df.columns, ["---"] * len(df.columns), *([show(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


NOTE = "Prices and capability profiles are assumptions, tokens are estimates, and qualities are off-policy estimates on proxy labels."


def _figures(values: dict) -> str:
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join(["| figure | value |", "| --- | --- |", *(f"| {k} | {show(v)} |" for k, v in values.items())])


def training_report(tolerance: float, feasible: bool, frontier: DataFrame, test: DataFrame, summary: dict) -> str:
    note = "" if feasible else " No tolerance kept the guardrails; the best one by quality, then savings, was taken."
    return f"""# Trained policy

Tolerance {tolerance:.3f}, chosen on the validation rows.{note}

## Validation frontier

{table(frontier.orderBy("tolerance"))}

## Test rows

{_figures(summary)}

{table(test.orderBy("policy"))}

{NOTE}
"""


def evaluation_report(comparison: DataFrame, scenarios: DataFrame, caps: DataFrame, tolerance: float) -> str:
    return f"""# Evaluation on held-out rows

All policies over the same test rows, which no fit has seen; the selected one has tolerance {tolerance:.3f}. Intervals are bootstrap ones, 95 %.

{table(comparison.orderBy("policy_type", "policy"))}

## Capability profiles, with the quality model refitted for each

{table(scenarios.orderBy("scenario"))}

## Weight caps

{table(caps.orderBy("weight_cap"))}

{NOTE}
"""


def review_report(counts: DataFrame, calibration: dict | None = None) -> str:
    known = f"\n\n## Judgments\n\n{_figures(calibration)}" if calibration else ""
    return f"# Manual review\n\n{table(counts)}{known}\n\nA sample for calibration, not an estimate for the population: unknown outcomes are all in it.\n"


def case_report(row: dict) -> str:
    """One decision, as console text."""
    return "\n".join(f"{k:>28}  {v}" for k, v in row.items())


def frontier_svg(points: DataFrame, width: int = 640, height: int = 400) -> str:
    """Savings across, quality change upwards; a mark for each policy."""
    rows = [(r["policy"], r["savings"], r["dr_delta"]) for r in points.select("policy", "savings", "dr_delta").collect()]
    xs, ys = [r[1] for r in rows] or [0.0], [r[2] for r in rows] or [0.0]
    span = lambda v: (min(v), max(max(v) - min(v), 1e-9))
    (x0, dx), (y0, dy) = span(xs), span(ys)
    place = lambda x, y: (60 + (x - x0) / dx * (width - 120), height - 50 - (y - y0) / dy * (height - 100))
    marks = []
    for name, x, y in rows:
        a, b = place(x, y)
        marks.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="4"/><text x="{a + 6:.1f}" y="{b - 6:.1f}" font-size="10">{escape(name)} ({x:.1%}, {y:+.3f})</text>')
    axes = f'<path d="M60 20V{height - 40}H{width - 20}" fill="none" stroke="#888"/><text x="{width / 2:.0f}" y="{height - 10}" font-size="12">savings</text><text x="8" y="14" font-size="12">quality change</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{axes}{"".join(marks)}</svg>'


def cell(source: str, text: str = "", svg: str = "", number: int | None = None) -> dict:
    """A notebook cell: Markdown, or code with the output it is shown with where it has a number."""
    lines = lambda x: x.splitlines(keepends=True)
    if number is None:
        return {"cell_type": "markdown", "metadata": {}, "source": lines(source)}
    shown = [{"output_type": "stream", "name": "stdout", "text": lines(text.rstrip("\n") + "\n")}] if text else []
    shown += [{"output_type": "display_data", "metadata": {}, "data": {"image/svg+xml": svg, "text/plain": ["<SVG chart>"]}}] if svg else []
    return {"cell_type": "code", "execution_count": number, "metadata": {}, "outputs": shown, "source": lines(source)}


def notebook(cells: list[dict]) -> str:
    """The cells as a notebook file."""
    about = {"kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"}, "language_info": {"name": "python"}}
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": about, "cells": cells}, indent=1) + "\n"


READ = "from pyspark.sql import SparkSession\nfrom lodestep.plans import reports\nfrom lodestep.sources import sinks\n\nspark = SparkSession.builder.getOrCreate()\n"


def frontier_notebook(frontier: DataFrame, test: DataFrame) -> str:
    """The validation frontier and the test rows' policies, with the code that shows them again."""
    return notebook([
        cell(f"# Frontier\n\n{NOTE}"),
        cell(READ + 'frontier = sinks.read_table(spark, "results/frontier")\nprint(reports.table(frontier.orderBy("tolerance")))', text=table(frontier.orderBy("tolerance")), number=1),
        cell('from IPython.display import SVG\n\nSVG(reports.frontier_svg(metrics))', text=table(test.orderBy("policy")), svg=frontier_svg(test), number=2),
    ])


def bars_svg(counts: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """A bar for each name, longest first as given."""
    most, height = max((v for _, v in counts), default=1) or 1, 60 + 26 * len(counts)
    bars = [f'<text x="10" y="{58 + 26 * k}" font-size="11">{escape(str(n))}</text><rect x="180" y="{46 + 26 * k}" width="{max(1, v / most * (width - 270)):.1f}" height="16"/><text x="{190 + v / most * (width - 270):.1f}" y="{58 + 26 * k}" font-size="11">{v:g}</text>' for k, (n, v) in enumerate(counts)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif"><text x="10" y="24" font-size="14">{escape(title)}</text>{"".join(bars)}</svg>'


def _bars(df: DataFrame, column: str, title: str) -> tuple[str, str]:
    """Code and chart of a column's counts, most frequent first; the columns that come here have a handful of values."""
    rows = [(r[column], r["count"]) for r in df.groupBy(column).count().orderBy("count", column, ascending=[False, True]).collect()]
    code = f'counts = rows.groupBy("{column}").count().orderBy("count", "{column}", ascending=[False, True])\nSVG(reports.bars_svg([tuple(r) for r in counts.collect()], "{title}"))'
    return code, bars_svg(rows, title)


def data_notebook(calibrated: DataFrame) -> str:
    """What the calibrated table holds: rows, usable labels, task categories, models, outcomes."""
    rows = calibrated.where("evaluation_outcome_usable = 1")
    n = calibrated.selectExpr("count(*) AS `rows`", "count_if(evaluation_outcome_usable = 1) AS usable").first()
    m = rows.selectExpr("count(DISTINCT x_task_category) AS categories", "count(DISTINCT logged_model) AS models", "count_if(y_tool_errors > 0) AS with_tool_errors", "count_if(y_user_correction > 0) AS with_corrections").first()
    cells = [cell(f"# Data and labels\n\nLabels are telemetry proxies and manual judgments. {NOTE}")]
    cells.append(cell(READ + 'from IPython.display import SVG\n\nrows = sinks.read_table(spark, "results/calibrated").where("evaluation_outcome_usable = 1")\nprint(rows.count())', text=_figures(n.asDict() | m.asDict()), number=1))
    for k, (column, title, says) in enumerate((("x_task_category", "Usable trajectories by task category", "Splits keep a template's rows together."), ("logged_model", "Usable trajectories by logged model", "The model that ran is an observed treatment; uneven shares make overlap the thing to watch."), ("evaluation_outcome_label", "Usable trajectories by outcome", "Where most outcomes are alike, an improvement cannot be shown, only a loss be ruled out."))):
        code, svg = _bars(rows, column, title)
        cells += [cell(f"## {title}\n\n{says}"), cell(code, svg=svg, number=k + 2)]
    return notebook(cells)


def model_notebook(decisions: DataFrame, summary: dict) -> str:
    """How the estimators and the chosen policy do on the held-out rows: errors by decile of prediction, routes, figures."""
    d = decisions.withColumn("decile", (decisions["predicted_complexity"] / 10).cast("int"))
    deciles = d.groupBy("decile").agg({"observed_complexity": "avg", "predicted_complexity": "avg", "*": "count"}).orderBy("decile")
    routes, routes_svg = _bars(decisions, "chosen_action", "Chosen actions")
    reasons, reasons_svg = _bars(decisions, "decision_reason", "Reasons of decisions")
    return notebook([
        cell(f"# Estimators and decisions on held-out rows\n\n{NOTE}"),
        cell(READ + 'from IPython.display import SVG\n\nrows = sinks.read_table(spark, "results/details")\nprint(sinks.get_text(spark, "results/summary.json"))', text=_figures(summary), number=1),
        cell("## Predicted and observed workload, by tens of the prediction"),
        cell('from pyspark.sql import functions as F\n\nprint(reports.table(rows.groupBy((F.col("predicted_complexity") / 10).cast("int").alias("decile")).agg(F.avg("observed_complexity"), F.count("*")).orderBy("decile")))', text=table(deciles), number=2),
        cell("## Decisions"),
        cell(routes, svg=routes_svg, number=3),
        cell(reasons, svg=reasons_svg, number=4),
    ])
