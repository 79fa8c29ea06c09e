"""Training sets as JSON lines, and dictionaries as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chatml(source: Column, target: Column, system: str) -> Column:
    def message(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    return F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", source), message("assistant", target)).alias("messages")))


def alpaca(instruction: Column, source: Column, target: Column) -> Column:
    return F.to_json(F.struct(instruction.alias("instruction"), source.alias("input"), target.alias("output")))


def alpaca_batches(pairs: DataFrame, order: list[str], instruction: str, seed: int, most: int = 16, with_glossary: bool = True) -> DataFrame:
    """(batch, n, line): pairs (source, target, glossary array) in seeded random order, cut into batches of 1 to ``most`` of seeded random size.

    Partitions of a hash shuffle are batched on their own, so the rows of a batch never meet in one place but there; glossary entries
    of a batch are merged, each once, in order of first use.
    """
    place = F.xxhash64(*order, F.lit(seed))
    rows = pairs.select(place.alias("place"), *order, "source", "target", "glossary").repartition(place).sortWithinPartitions("place", *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list = []
        for part in parts:
            left += list(part[["place", "source", "target", "glossary"]].itertuples(index=False, name=None))
            done, left = _cut(left, most, seed, False)
            yield done
        yield _cut(left, most, seed, True)[0]

    def _cut(rows_: list, most: int, seed: int, all_: bool) -> tuple[pd.DataFrame, list]:
        out = []
        while rows_ and (all_ or len(rows_) >= most):
            n = 1 + int(np.random.default_rng([seed, rows_[0][0] & 0xFFFFFFFF]).integers(most))
            chosen, rows_ = rows_[:n], rows_[n:]
            terms = dict.fromkeys(x for r in chosen for x in (r[3] if r[3] is not None else ()))
            front = f"<rag-input>{' '.join(terms)}</rag-input>\n" if terms and with_glossary else ""
            out.append((chosen[0][0], len(chosen), front + "\n".join(f"<rt>{r[1]}</rt>" for r in chosen), "\n".join(f"<rt>{r[2]}</rt>" for r in chosen)))
        return pd.DataFrame(out, columns=["batch", "n", "input", "output"]), rows_

    made = rows.mapInPandas(run, "batch long, n int, input string, output string")
    return made.select("batch", "n", alpaca(F.lit(instruction), F.col("input"), F.col("output")).alias("line"))


def read_dictionary(contents: DataFrame) -> DataFrame:
    """(source, pos, target) of JSON dictionaries (content) of source to list of targets."""
    parsed = contents.select(F.explode(F.from_json("content", "map<string,array<string>>")).alias("source", "targets"))
    return parsed.select("source", F.posexplode("targets").alias("pos", "target"))


def dictionary_entries(dictionary: DataFrame) -> DataFrame:
    """One JSON object for each source, for ``write.text``: a dictionary of any size is written in parallel as JSON lines."""
    return dictionary.select(F.to_json(F.create_map("source", "targets")).alias("value"))
