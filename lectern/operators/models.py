"""Calls of a model that the caller gives, in batches: replies that are checked and asked for once more, JSON answers, judges, drafts of golden items.

A model is a function of a prompt to a text.  One that fails gives a problem for its row and leaves the others alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import jsons
from lectern.functions.shipping import map_arrow
from lectern.operators import evals

Model = Callable[[str], str]
#: Gives what is wrong with a reply, or None.
Check = Callable[[str], str | None]
TRIES = 2
AGAIN = "\n\nYour last reply could not be used: {}\nReply again, in the form that was asked for."


def _asked(model: Model, check: Check, prompt: str) -> tuple[str | None, str | None, int]:
    said, problem = None, None
    for number in range(1, TRIES + 1):
        try:
            said = model(prompt if problem is None else prompt + AGAIN.format(problem))
            problem = check(said)
        except Exception as e:  # noqa: BLE001
            said, problem = None, str(e) or type(e).__name__
        if problem is None:
            return said, None, number
    return None, problem, TRIES


def replied(rows: DataFrame, prompt: str, model: Model, check: Check) -> DataFrame:
    """rows with reply (null if none could be used), problem (null if one could) and tries; a null prompt is empty."""
    names = [c for c in rows.columns if c not in ("reply", "problem", "tries")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_asked(model, check, p or "") for p in b.column(prompt).to_pylist()]
            told = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), *told], [*names, "reply", "problem", "tries"])

    added = [T.StructField("reply", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("tries", T.IntegerType())]
    return map_arrow(rows.select(*names), run, T.StructType([*rows.select(*names).schema.fields, *added]))


def fits(schema: dict) -> Check:
    """A check for replies that hold an object of a schema, with prose or a code fence around it."""

    def check(said: str) -> str | None:
        body = re.search(r"\{.*\}", said or "", re.S)
        try:
            wrong = jsons.problems(json.loads(body[0]), schema) if body else ["no JSON object"]
        except ValueError:
            wrong = ["not JSON"]
        return "; ".join(wrong) or None

    return check


def json_answers(rows: DataFrame, prompt: str, model: Model, schema: dict) -> DataFrame:
    """rows with reply (the object alone), problem and tries."""
    return replied(rows, prompt, model, fits(schema)).withColumn("reply", jsons.extracted(F.col("reply")))


SCORES = ("groundedness", "relevance", "correctness")


def judged(rows: DataFrame, item: str, prompt: str, judges: dict[str, Model]) -> DataFrame:
    """item, groundedness, relevance, correctness, reason, tokens, judges: the mean scores of the judges (in order of name) that gave a readable reply.

    A reply is an object with a score for each; scores come as numbers or texts and are brought to 0..1.  An item that no
    judge could judge has nulls and 0 judges.
    """
    schema = {"type": "object", "required": ["groundedness", "relevance"]}
    every = None
    for name in sorted(judges):
        one = json_answers(rows.select(item, prompt), prompt, judges[name], schema)
        scores = [evals.judge_score(F.get_json_object("reply", f"$.{s}")).alias(s) for s in SCORES]
        one = one.select(item, F.lit(name).alias("judge"), *scores, F.get_json_object("reply", "$.reason").alias("reason"), F.when(F.col("reply").isNotNull(), F.size(F.split("reply", " "))).alias("tokens"), F.col("reply").isNotNull().cast("int").alias("read"))
        every = one if every is None else every.union(one)
    counts = every.groupBy(item).agg(F.sum("read").alias("judges"))
    return evals.merged_judges(every, item, "judge", list(SCORES)).join(counts, item)


def drafted(chunks: DataFrame, model: Model, n: int = 200, seed: int = 7, key: str = "doc_id", column: str = "text") -> DataFrame:
    """id, question, expected_answer, expected_sources, problem: a draft of a golden item for each of n sampled chunks (key, text, quarantined)."""
    rows = evals.sampled(chunks, n, seed, key, column)
    rows = rows.withColumn("prompt", F.concat(F.lit('Write a question that this passage answers, and the answer, as {"question": ..., "answer": ...}.\n\n'), F.col(column)))
    text = {"type": "string"}
    found = json_answers(rows.select(key, "prompt"), "prompt", model, {"type": "object", "required": ["question", "answer"], "properties": {"question": text, "answer": text}})
    told = {"question": "$.question", "expected_answer": "$.answer"}
    return found.select(F.concat(F.lit("draft-"), F.col(key).cast("string")).alias("id"), *[F.get_json_object("reply", path).alias(n) for n, path in told.items()], F.array(F.col(key)).alias("expected_sources"), "problem")
