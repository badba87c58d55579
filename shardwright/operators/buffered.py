"""Buffered shuffle (S14, R2): a swap buffer of bounded size per reader.

A reader fills a buffer with its first ``buffer_rows`` rows. Every further
row takes the seat of a row drawn at random, which is passed on; at the end
the rows still seated follow in random order. A row so moves ahead by less
than the buffer, and memory is the buffer whatever the reader holds. There
is no exchange over all rows: readers are the tasks of the scan, or rows are
brought to the reader a column names.

Draws are hashes of (seed, reader, row number), so a retried task passes its
rows on in the same order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ROWS = 4000
SLICE = 2000  # rows that enter the buffer at a time


def seat(seed, reader: str, row: int, buffer_rows: int) -> int:
    """Seat that a row takes once the buffer is full."""
    return int(hashlib.md5(f"{seed}:{reader}:{row}".encode()).hexdigest()[:13], 16) % buffer_rows


def leave_key(seed, reader: str, place: int) -> str:
    """Order in which the last rows leave their seats."""
    return hashlib.md5(f"{seed}:{reader}:end:{place}".encode()).hexdigest()


class SwapBuffer:
    """The buffer of one reader; rows are slices of Arrow batches."""

    def __init__(self, reader: str, seed, buffer_rows: int):
        self.reader, self.seed, self.size = reader, seed, buffer_rows
        self.rows, self.seen = None, 0

    def push(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows passed on while ``batch`` enters."""
        pool = batch if self.rows is None else pa.concat_batches([self.rows, batch])
        seats = list(range(len(pool) - len(batch)))
        out = []
        for k in range(len(seats), len(pool)):
            if len(seats) < self.size:
                seats.append(k)
            else:
                s = seat(self.seed, self.reader, self.seen, self.size)
                out.append(seats[s])
                seats[s] = k
            self.seen += 1
        self.rows = pool.take(pa.array(seats, pa.int64()))
        return pool.take(pa.array(out, pa.int64()))

    def drain(self) -> pa.RecordBatch:
        order = sorted(range(len(self.rows)), key=lambda s: leave_key(self.seed, self.reader, s))
        return self.rows.take(pa.array(order, pa.int64()))


def buffered_shuffle(df: DataFrame, buffer_rows: int = DEFAULT_ROWS, seed=1234, reader: str | None = None,
                     order: tuple[str, ...] = (), out: str = "position") -> DataFrame:
    """``df`` with ``out``, each row's place in its reader's shuffled order;
    rows come in that order.

    Without ``reader`` every task is one, in the order it reads its rows,
    and nothing is exchanged. With it, the rows of a reader (a file, a
    worker's share) meet in one task in ``order`` and stream through it;
    a null reader is one of its own. An empty table stays empty.
    """
    if buffer_rows < 1:
        raise ValueError("the buffer needs a row at least")
    names = list(df.columns)
    cols = [*names, "__reader"]
    if reader is None:
        rows = df.withColumn("__reader", F.lit(""))
    else:
        # by a hash of its own: an exchange like one below it would be left out, and that one may be read out of order
        rows = df.withColumn("__reader", F.coalesce(F.col(reader).cast("string"), F.lit("")))
        rows = rows.withColumn("__null", F.col(reader).isNull()).repartition(F.xxhash64("__reader", "__null")) \
            .sortWithinPartitions("__null", "__reader", *order)
        cols = [*names, "__reader", "__null"]
    by_task = reader is None

    def run(batches):
        buffer, key, place = None, None, 0

        def told(part: pa.RecordBatch):
            nonlocal place
            n = len(part)
            done = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(np.arange(place, place + n))], names=[*names, out])
            place += n
            return done

        for whole in batches:
            at = 0
            ids = list(zip(*(whole.column(i).to_pylist() for i in range(len(names), len(cols)))))
            while at < len(whole):
                end = at + 1
                while end < len(whole) and end - at < SLICE and ids[end] == ids[at]:
                    end += 1
                if ids[at] != key:
                    if buffer is not None:
                        yield told(buffer.drain())
                    key, place = ids[at], 0
                    buffer = SwapBuffer(str(TaskContext.get().partitionId()) if by_task else key[0], seed, buffer_rows)
                passed = buffer.push(whole.slice(at, end - at))
                if len(passed):
                    yield told(passed)
                at = end
        if buffer is not None:
            yield told(buffer.drain())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, f"{schema}, `{out}` bigint")
