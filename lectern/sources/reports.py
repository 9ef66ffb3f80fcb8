"""Golden sets and evaluation reports: driver-side files around one-row frames."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GOLDEN = "id string, question string, user_tags array<string>, expected_answer string, expected_sources array<string>, must_include array<string>, must_not_include array<string>, expect_refusal boolean"
_LISTS = ("user_tags", "expected_sources", "must_include", "must_not_include")


def _read(path: str):
    body = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(body)
    except ValueError:
        import yaml

        return yaml.safe_load(body)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set from a list, or an object with the list `items`; a scalar stands for a list of one."""
    told = _read(path)
    items = told.get("items", []) if isinstance(told, dict) else told or []
    rows = []
    for x in items:
        lists = {k: [] if x.get(k) is None else [str(v) for v in x[k]] if isinstance(x[k], list) else [str(x[k])] for k in _LISTS}
        rows.append((str(x.get("id") or ""), str(x.get("question") or ""), lists["user_tags"], str(x.get("expected_answer") or ""), lists["expected_sources"], lists["must_include"], lists["must_not_include"], bool(x.get("expect_refusal", False))))
    return spark.createDataFrame(rows, GOLDEN)


def save_golden(golden: DataFrame, path: str) -> None:
    rows = [r.asDict() for r in golden.orderBy("id").collect()]
    Path(path).write_text(json.dumps({"version": 1, "items": rows}, ensure_ascii=False, indent=1), encoding="utf-8")


def write_report(summary: DataFrame, gate: DataFrame, folder: str, name: str) -> Path:
    """name.json and name.html of a one-row summary and its gate, and latest.* as copies; an existing name gets a number."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    free = next(n for k in range(10_000) if not (top / f"{(n := name if not k else f'{name}-{k}')}.json").exists())
    told = {"summary": summary.first().asDict(), "gate": [r.asDict() for r in gate.orderBy("metric").collect()]}
    told["passed"] = all(g["status"] != "regressed" for g in told["gate"])
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in told["summary"].items())
    page = f"<!doctype html><title>{html.escape(free)}</title><p>{'passed' if told['passed'] else 'regressed'}</p><table>{rows}</table>"
    for stem in (free, "latest"):
        (top / f"{stem}.json").write_text(json.dumps(told, indent=1), encoding="utf-8")
        (top / f"{stem}.html").write_text(page, encoding="utf-8")
    return top / f"{free}.json"


def promote(report: Path, baseline: Path) -> dict:
    """Takes a report's summary as the baseline of later gates."""
    told = json.loads(report.read_text(encoding="utf-8"))["summary"]
    baseline.write_text(json.dumps(told, indent=1), encoding="utf-8")
    return told
