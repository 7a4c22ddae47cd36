"""Folds over a session's ordered labels, in which a changed label counts for the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (label before, as changed; label; label behind) of an inner label -> whether it takes the one before.
Alone = Callable[[int, int, int], bool]


def absorbed(left: int, here: int, right: int) -> bool:
    """A single label between others takes the one before: [0, 1, 2, 2] -> [0, 0, 2, 2]."""
    return here != left and here != right


def smoothed(left: int, here: int, right: int) -> bool:
    """A single label between two equal ones takes theirs: [0, 1, 0, 1, 0] -> [0, 0, 0, 0, 0]."""
    return here != left and left == right


def folded(labels: list[int | None], alone: Alone) -> list[int | None]:
    """One session's labels; a missing label changes nothing and is not changed."""
    out = list(labels)
    for i in range(1, len(out) - 1):
        if None not in (out[i - 1], out[i], out[i + 1]) and alone(out[i - 1], out[i], out[i + 1]):
            out[i] = out[i - 1]
    return out


def by_session(rows: DataFrame, key: str, label: str, alone: Alone) -> DataFrame:
    """``rows`` with ``label`` folded in the order of ``key``.

    Rows are dealt by session once and pass in order as a stream, of which one batch and
    the row before it are held, so a session may have any length.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, left, held = object(), None, None  # the session and label before; the last row, which waits for the next
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            sessions, labels = batch.column("session_id").to_pylist(), batch.column(label).to_pylist()
            new = labels[:-1]
            for i, here in enumerate(new):
                if sessions[i] == session and sessions[i + 1] == session and None not in (left, here, labels[i + 1]) and alone(left, here, labels[i + 1]):
                    new[i] = here = left
                session, left = sessions[i], here
            held = batch.slice(len(new))
            if new:
                yield _with(batch.slice(0, len(new)), new)
        if held is not None:
            yield _with(held, held.column(label).to_pylist())  # a session's last label stays

    def _with(batch: pa.RecordBatch, new: list) -> pa.RecordBatch:
        own = batch.schema.get_field_index(label)
        return pa.RecordBatch.from_arrays([pa.array(new, pa.int32()) if i == own else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    source = rows.withColumn(label, F.col(label).cast("int"))
    ordered = source.repartition("session_id").sortWithinPartitions("session_id", key)
    return ordered.mapInArrow(run, ordered.schema).select(*names)
