"""Plug-in scorers of spans (X9, F3): a getter makes the input of each span, a predictor scores it, a setter
puts the prediction into columns.

A predictor is registered as a loader (``scorer``); a Python worker loads it once, whatever the number of its
tasks.  Rows come in outer batches; inside one the inputs are sorted by length and predicted in inner batches, so
that inputs of like size go together.  All other columns pass through as Arrow values.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.spans import token_bounds
from cohortflow.operators import ml
from cohortflow.operators.context import assign_predictions

#: FIXED VALUES: rows of an outer and of an inner batch.
OUTER, INNER = 50_000, 32


class Scorer(NamedTuple):
    name: str
    load: Callable[[], Callable[[list], list[tuple]]]
    fields: str


SCORERS: dict[str, Scorer] = {}
GETTERS: dict[str, Callable[[], Column]] = {"context": lambda: F.col("context"), "marked_context": ml.marked_text}
_LOADED: dict[str, Callable] = {}


def scorer(name: str, fields: str):
    """Register a loader; its predictor takes a list of inputs and gives a tuple of ``fields`` for each."""
    def keep(load):
        SCORERS[name] = Scorer(name, load, fields)
        return load
    return keep


def getter(name: str):
    """Register a function that makes the input column."""
    def keep(make):
        GETTERS[name] = make
        return make
    return keep


def _loaded(own: Scorer) -> Callable:
    if own.name not in _LOADED:
        _LOADED[own.name] = own.load()
    return _LOADED[own.name]


def in_batches(predict: Callable, inputs: list, inner: int) -> list[tuple]:
    """Predictions in the order of the inputs, asked for in batches of inputs of like length."""
    order = sorted(range(len(inputs)), key=lambda i: len(inputs[i] or ""))
    out: list = [None] * len(inputs)
    for at in range(0, len(order), inner):
        batch = order[at : at + inner]
        got = predict([inputs[i] for i in batch])
        if len(got) != len(batch):
            raise ValueError(f"{len(got)} predictions for {len(batch)} inputs")
        for i, g in zip(batch, got):
            out[i] = tuple(g)
    return out


def score(spans: DataFrame, name: str, get: str = "marked_context", setter: dict[str, str] | None = None,
          outer: int = OUTER, inner: int = INNER) -> DataFrame:
    """spans with the fields of the scorer ``name``: all of them, or the ``{field: column}`` setter."""
    own = SCORERS[name]
    fields = T.StructType.fromDDL(own.fields)
    data = spans.withColumn("_input", GETTERS[get]())
    kept = [f for f in data.schema.fields if f.name != "_input"]
    schema = T.StructType([*kept, T.StructField("prediction", fields)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]

        def scored(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            got = in_batches(_loaded(own), table.column("_input").to_pylist(), inner)
            columns = [pa.array(list(c), k) for c, k in zip(zip(*got), kinds)]
            prediction = pa.StructArray.from_arrays(columns, fields.fieldNames())
            for b in table.drop_columns(["_input"]).append_column("prediction", prediction).to_batches():
                yield pa.RecordBatch.from_arrays(b.columns, schema.fieldNames())

        waiting, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, outer):
                part = b.slice(at, outer)
                if rows + part.num_rows > outer:
                    yield from scored(waiting)
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield from scored(waiting)

    out = data.select(*[f.name for f in kept], "_input").mapInArrow(run, schema)
    return assign_predictions(out, "prediction", setter)


@scorer("word_balance", "logit double, n_words int")
def word_balance():
    """A fixed linear scorer of the number of word tokens and of the length: it stands for a model where SQL checks the rest."""
    def predict(inputs):
        out = []
        for text in inputs:
            n = sum(text[b].isalpha() for b in token_bounds(text)[0])
            out.append((0.5 * n - 0.0625 * len(text), n))
        return out
    return predict
