"""Labels from a teacher model that a worker loads once and asks twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.sampling import agreed
from . import teacher_letter

_held: dict[str, Any] = {}


def held(name: str, load: Callable[[], Any]) -> Any:
    """This worker's model of a name: loaded when a task first needs it, kept for the tasks after it. One model stays at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = load()
    return _held[name]


def ask_twice(samples: DataFrame, name: str, load: Callable[[], Any], ask: Callable[[Any, list], str | None], images: str = "images") -> DataFrame:
    """samples plus ``first`` and ``second``, the model's answers to a sample's images in order and reversed.

    ``load`` makes the model, ``ask`` puts images to it; both go to the workers, the model does not. An answer that fails is
    null, and so is one to no images. Materialise the result before branching, so that no call is repeated.
    """
    schema = StructType([*samples.schema.fields, *(StructField(n, StringType()) for n in ("first", "second"))])

    def answer(model: Any, own: list | None) -> str | None:
        try:
            return ask(model, own) if own else None
        except Exception:  # noqa: BLE001  any failure of the outside model counts
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from spanloom.sources import teacher

        for batch in batches:
            if not batch.num_rows:
                continue
            model = teacher.held(name, load)
            every = batch.column(batch.schema.get_field_index(images)).to_pylist()
            two = ([answer(model, own) for own in every], [answer(model, own[::-1] if own else None) for own in every])
            yield pa.record_batch([*batch.columns, *(pa.array(x, pa.string()) for x in two)], [*batch.schema.names, "first", "second"])

    return samples.mapInArrow(run, schema)


def taught(asked: DataFrame) -> DataFrame:
    """Of ask_twice()'s rows those with one class letter in both answers, as ``letter``."""
    both = asked.withColumns({"first": teacher_letter(asked["first"]), "second": teacher_letter(asked["second"])})
    return agreed(both, "first", "second", "letter").drop("first", "second")
