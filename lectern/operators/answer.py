"""Grounded answers in batches, and the agent loop, around a model that the caller gives.

A generator is a function of (question, sources) to text, sources being numbered texts; the default picks the sentence that shares most tokens with
the question and cites it.  It runs in Arrow over one row for each question.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.shipping import map_arrow
from lectern.operators.policy import MOST_CALLS

DEFAULT_CITATIONS, RESULT_CHARS = 2, 6000
Generator = Callable[[str, list[str]], str]


def extractive(question: str, sources: list[str]) -> str:
    """The sentence of the sources that shares most words with the question, cited."""
    asked = set(re.findall(r"\w+", question.lower()))
    said = [(len(asked & set(re.findall(r"\w+", s.lower()))), -n, s) for n, body in enumerate(sources, 1) for s in re.split(r"(?<=[.!?])\s+", body) if s]
    shared, n, best = max(said, default=(0, 0, ""))
    return f"{best} [{-n}]" if shared else text.REFUSAL


def _generated(model: Generator, question: str, sources: list[str]) -> str:
    """The model's text; a reply of citations alone is asked for once more."""
    reply = model(question, sources)
    if reply and "[" in reply and re.fullmatch(r"[\s\[\]\d,;.\-]*", reply):
        reply = model(question, sources)
    return reply


def answered(asked: DataFrame, hits: DataFrame, refused: DataFrame, model: Generator = extractive, key: str = "doc_id") -> DataFrame:
    """query_id, answer, refused, citations (numbers) of asked (query_id, text).

    hits (query_id, key, rank, text) are the sources; a question that the gate refused (query_id, refused) has no model call.  An answer without markers cites the
    first sources; numbers of no source are dropped.
    """
    sources = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
    rows = asked.select("query_id", "text").join(refused.select("query_id", "refused"), "query_id").join(sources, "query_id", "left")
    rows = rows.select("query_id", F.col("text").alias("question"), "refused", F.coalesce(F.transform("s", lambda s: s["text"]), F.expr("cast(array() as array<string>)")).alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pylist()
            said = [text.REFUSAL if x["refused"] or not x["sources"] else _generated(model, x["question"], x["sources"]) for x in r]
            yield pa.RecordBatch.from_arrays([pa.array([x["query_id"] for x in r], pa.int64()), pa.array(said, pa.string()), pa.array([len(x["sources"]) for x in r], pa.int32())], ["query_id", "answer", "n"])

    found = map_arrow(rows, run, "query_id long, answer string, n int").withColumn("refused", text.is_refusal(F.col("answer")))
    cited = F.filter(text.citations(F.col("answer")), lambda c: (c >= 1) & (c <= F.col("n")))
    first = F.slice(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), 1, DEFAULT_CITATIONS)
    none = F.expr("cast(array() as array<int>)")
    return found.select("query_id", "answer", "refused", F.when(F.col("refused") | (F.col("n") == 0), none).when(F.size(cited) > 0, cited).otherwise(first).alias("citations"))


def agent(question: str, model: Callable[[list[dict]], dict], tools: dict[str, Callable[..., str]], decide: Callable[[str, dict], str], most_turns: int = MOST_CALLS) -> dict:
    """text, steps, refused of one agent run: model gives {"text"} or {"calls": [(tool, arguments)]}, decide gives allowed, approval or a reason to refuse."""
    talk, steps, refused, calls = [{"role": "user", "content": question}], [], [], 0
    for _ in range(most_turns):
        turn = model(talk)
        if not turn.get("calls"):
            return {"text": turn.get("text", ""), "steps": steps, "refused": refused}
        for name, given in turn["calls"]:
            calls += 1
            verdict = "call budget used up" if calls > MOST_CALLS else decide(name, given)
            if verdict == "allowed" and name in tools:
                try:
                    told = tools[name](**given)
                except Exception as e:  # noqa: BLE001
                    told = json.dumps({"error": str(e)})
            else:
                told = json.dumps({"waiting" if verdict == "approval" else "refused": verdict if name in tools else f"no tool {name}"})
                refused += [name] if verdict != "approval" else []
            steps.append((name, given, verdict))
            talk.append({"role": "tool", "name": name, "content": told[:RESULT_CHARS]})
    return {"text": text.REFUSAL, "steps": steps, "refused": refused}
