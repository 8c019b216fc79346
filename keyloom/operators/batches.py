"""Command batches and scripts: an ordered fold over each key's state, committed together.

Keys are folded in parallel, each in the order of its commands; a script sees its key's state and its
commands' results. Results come back with the position of their command. State and commands are sorted
by key and pass the tasks as streams of Arrow batches, so that a key costs no more than its rows.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and characters of a block of results, in memory or sent.
BLOCK_ROWS, BLOCK_CHARS = 16_384, 8_388_608


def _strings(state: str | None, name: str, argument: str | None) -> tuple[str | None, str | None]:
    """(new state, result) of a string command; errors leave the state."""
    name = name.upper()
    if name == "GET":
        return state, state
    if name == "SET":
        return argument, "OK"
    if name == "DEL":
        return None, "1" if state is not None else "0"
    if name == "EXISTS":
        return state, "1" if state is not None else "0"
    if name == "INCR":
        try:
            new = str(int(state or "0") + 1)
        except ValueError:
            return state, "ERR not an integer"
        return new, new
    if name == "GETDEL":
        return None, state
    return state, f"ERR unknown command {name}"


class _Waiting:
    """Positions and results of one key until its last value is known: the last block in memory, those before it in a file."""

    def __init__(self):
        self.block, self.chars, self.written, self.file = [], 0, 0, None

    def add(self, pos: int, result: str | None) -> None:
        self.block.append((pos, result))
        self.chars += len(result) if result else 0
        if len(self.block) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            pickle.dump(self.block, self.file, pickle.HIGHEST_PROTOCOL)
            self.block, self.chars, self.written = [], 0, self.written + 1

    def __iter__(self) -> Iterator[tuple[int, str | None]]:
        if self.file is not None:
            with self.file:
                self.file.seek(0)
                for _ in range(self.written):
                    yield from pickle.load(self.file)
        yield from self.block


def run_batch(state: DataFrame, commands: DataFrame, step: Callable[[str | None, str, str | None], tuple[str | None, str | None]] = _strings) -> DataFrame:
    """key, pos, result, value: commands (key, pos, name, argument) on state (key, value), in order of pos by key.

    value is the key's state after its last command, in every row of the key. step may be any function
    (state, name, argument) -> (state, result): that is what a script is here. In memory are a key's state and a
    block of its results, however many commands it has."""
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("result", pa.string()), ("value", pa.string())])
    first = state.select(F.col("key").cast("string").alias("key"), "value", F.lit(False).alias("_asked"))
    asked = commands.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("_asked"), "pos", "name", "argument")
    both = first.unionByName(asked, allowMissingColumns=True).select("key", "_asked", "pos", "name", "argument", "value")
    ordered = both.repartition("key").sortWithinPartitions("key", "_asked", "pos")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        for key, own in groupby(rows(batches), itemgetter(0)):
            value, stated, waiting = None, False, _Waiting()
            for _, is_command, pos, name, argument, v in own:
                if is_command:
                    value, result = step(value, name, argument)
                    waiting.add(int(pos), result)
                elif not stated:
                    value, stated = v, True
            each = len(key or "") + len(value or "")
            for pos, result in waiting:
                out.append((key, pos, result, value))
                chars += each + (len(result) if result else 0)
                if len(out) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(fold, "key string, pos long, result string, value string")
