"""Enrichment: prompts, model calls in Arrow batches, and what becomes of the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a response that aren't answers.
NOISE = r"(?s)<think>.*?</think>|\[think\].*?\[/think\]|<context>.*?</context>|<rag-input>.*?</rag-input>"
ANSWER = r"(?s)<rt>(.*?)</rt>"


def tagged(name: str, parts: Column) -> Column:
    """One tag around the parts, with blanks between; nothing where there are none."""
    return F.when(F.size(parts) > 0, F.concat(F.lit(f"<{name}>"), F.array_join(parts, " "), F.lit(f"</{name}>"))).otherwise(F.lit(""))


def prompt(context: Column, references: Column, texts: Column) -> Column:
    """Context and references (arrays of "source=target"), then every text in a tag of its own line."""
    body = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("<rt>"), t, F.lit("</rt>"))), "\n")
    return F.concat(tagged("context", context), tagged("rag-input", references), body)


def answers(response: Column) -> Column:
    """The contents of all answer tags that are closed, in their order."""
    return F.regexp_extract_all(F.regexp_replace(response, NOISE, ""), F.lit(ANSWER), F.lit(1))


def model_name(name: Column) -> Column:
    """Without what follows @ or a colon, blanks, underscores and hyphens; in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"[@:].*$", ""), r"[ _\-]", ""))


def retry_delay(attempt: Column, base: float = 5.0, coefficient: float = 1.2) -> Column:
    return F.pow(F.lit(coefficient), attempt - 1) * base


Model = Callable[[list[str]], list[str]]


def enriched(batches: DataFrame, make_model: Callable[[], Model], retries: int = 1) -> DataFrame:
    """(batch, pos, text, answer, error) for batches (batch long, texts array<string>).

    The model answers each batch whole; where the number of answers differs from that of the texts, the batch is tried again up to
    ``retries`` times, then item by item. An item that still fails has a null answer and an error: nothing is invented. A model
    is made once for each task. Null or empty batches give no rows.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            rows = []
            for batch, texts in zip(part["batch"], part["texts"], strict=True):
                texts = [] if texts is None else list(texts)
                if not texts:
                    continue
                model = model or make_model()
                got, why = _ask(model, texts, retries)
                if got is None:
                    for pos, text in enumerate(texts):
                        one, why = _ask(model, [text], retries)
                        rows.append((batch, pos, text, one[0] if one else None, None if one else why))
                else:
                    rows += [(batch, pos, text, answer, None) for pos, (text, answer) in enumerate(zip(texts, got, strict=True))]
            yield pd.DataFrame(rows, columns=["batch", "pos", "text", "answer", "error"])

    return batches.select("batch", "texts").mapInPandas(run, "batch long, pos int, text string, answer string, error string")


def _ask(model: Model, texts: list[str], retries: int) -> tuple[list[str] | None, str]:
    why = ""
    for _ in range(retries + 1):
        try:
            got = model(texts)
        except Exception as e:  # a model's failure is data here: it goes to the error column
            why = f"{type(e).__name__}: {e}"
            continue
        if len(got) == len(texts):
            return list(got), ""
        why = f"{len(got)} answers for {len(texts)} texts"
    return None, why


def embedded(texts: DataFrame, text_col: str, make_model: Callable[[], Callable[[list[str]], list[list[float] | None]]]) -> DataFrame:
    """texts with vector: every distinct text is embedded once and its vector fanned out; what fails has a null vector."""
    key = F.sha2(F.col(text_col), 256)
    once = texts.where(F.col(text_col).isNotNull()).groupBy(key.alias("_key")).agg(F.first(text_col).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            model = model or make_model()
            try:
                vectors = model(list(part["text"]))
            except Exception:
                vectors = [None] * len(part)
            yield pd.DataFrame({"_key": part["_key"], "vector": vectors})

    vectors = once.mapInPandas(run, "_key string, vector array<float>")
    return texts.withColumn("_key", key).join(vectors, "_key", "left").drop("_key")


def refined(batches: DataFrame, make_models: list[Callable[[], Model]], retries: int = 1) -> DataFrame:
    """Answers passed through further models in turn; each round works on the last round's answers, its failures keep them."""
    out = enriched(batches, make_models[0], retries)
    for make in make_models[1:]:
        again = out.where("answer is not null").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "answer"))).alias("r"))
        better = enriched(again.select("batch", F.transform("r", lambda x: x["answer"]).alias("texts")), make, retries).select("batch", F.col("pos").alias("k"), F.col("answer").alias("better"))
        at = again.select("batch", F.posexplode("r").alias("k", "r")).select("batch", "k", F.col("r.pos").alias("pos"))
        out = out.join(at.join(better, ["batch", "k"]).drop("k"), ["batch", "pos"], "left").withColumn("answer", F.coalesce("better", "answer")).drop("better")
    return out
