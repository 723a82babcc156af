"""Logical records of raw lines, with one file walked by many tasks.

Where a record ends depends on where it began, so lines are read as an automaton: its state is whether a record is open and, if
so, how many lines and delimiters it has and whether any of it is more than space. Open records have an odd number of quotes,
so there are few states. A chunk of lines is a map from every state it may be entered in to the state it is left in; maps
compose, so each chunk's first state follows from the maps before it, and chunks are then walked apart. The text of the lines
takes no part in this; a line is one small number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_count
from ..scratch import settle

#: Lines of a chunk, and chunks whose maps are composed by one task.
CHUNK, FAN = 8192, 4096


def automaton(expected: int, max_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a record that is not blank ends) by kind of line and state; state 0 has no open record."""
    enough = max(expected - 1, 0)
    size = 1 + (max_lines - 1) * enough * 2
    to, ends = np.zeros((2 * (enough + 1) * 2, size), np.int32), np.zeros((2 * (enough + 1) * 2, size), bool)
    for state in range(size):
        n, delims, filled = (1 + (state - 1) // (2 * enough), (state - 1) // 2 % enough, (state - 1) % 2) if state else (0, 0, 0)
        for kind in range(len(to)):
            odd, more, text = kind // 2 // (enough + 1), kind // 2 % (enough + 1), kind % 2
            filled_now = filled | text
            if (state > 0) == bool(odd) or delims + more >= enough or n + 1 >= max_lines:
                ends[kind, state] = filled_now
            else:
                to[kind, state] = 1 + (n * enough + delims + more) * 2 + filled_now
    return to, ends


def line_kind(line: str, delimiter: str, expected: int) -> Column:
    """A line as the automaton sees it: odd number of quotes, delimiters as far as they count, more than space."""
    enough = max(expected - 1, 0)
    delims = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))
    text = (F.regexp_replace(line, r"(?U)\s", "") != "").cast("int")
    return (((quote_count(line) % 2) * (enough + 1) + F.least(delims, F.lit(enough))) * 2 + text).cast("int")


def chunk_map(kinds, numbers, to: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each state a chunk may be entered in: the state after it, the records that end in it, and the line where the record
    that is then open began (-1: before the chunk). Once all states have met, the rest is walked once."""
    state, count, begun = np.arange(to.shape[1]), np.zeros(to.shape[1], np.int64), np.full(to.shape[1], -1, np.int64)
    i = 0
    while i < len(kinds) and not (state == state[0]).all():
        begun[state == 0] = numbers[i]
        count += ends[kinds[i]][state]
        state = to[kinds[i]][state]
        i += 1
    if i < len(kinds):
        one, more, at = int(state[0]), 0, -1
        for kind, number in zip(kinds[i:], numbers[i:]):
            if one == 0:
                at = number
            more += ends[kind, one]
            one = to[kind, one]
        state = np.full_like(state, one)
        count += more
        if at >= 0:
            begun[:] = at
    return state, count, begun


def walk(kinds, numbers, state: int, records: int, begun: int, to: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """The first line and the number of each line's record, from the state the chunk is entered in."""
    starts, places = [], []
    for kind, number in zip(kinds, numbers):
        if state == 0:
            begun = number
        starts.append(begun)
        places.append(records + 1)
        records += int(ends[kind, state])
        state = to[kind, state]
    return starts, places


def _maps(expected: int, max_lines: int):
    def run(batches):
        to, ends = automaton(expected, max_lines)
        for batch in batches:
            found = [chunk_map(k, n, to, ends) for k, n in zip(batch.column("kinds").to_pylist(), batch.column("numbers").to_pylist())]
            lists = [pa.array([x[i].tolist() for x in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("chunk"), *lists], names=["source_file", "chunk", "state", "records", "begun"])

    return run


def _compose(frame: pd.DataFrame) -> pd.DataFrame:
    """The chunks of a frame as one map."""
    frame = frame.sort_values("chunk")
    state = np.arange(len(frame.state.iloc[0]))
    records, begun = np.zeros(len(state), np.int64), np.full(len(state), -1, np.int64)
    for s, r, b in zip(frame.state, frame.records, frame.begun):
        records = records + np.asarray(r)[state]
        later = np.asarray(b)[state]
        begun = np.where(later >= 0, later, begun)
        state = np.asarray(s)[state]
    return pd.DataFrame({"source_file": [frame.source_file.iloc[0]], "chunk": [frame.upper.iloc[0]], "state": [state.tolist()], "records": [records.tolist()], "begun": [begun.tolist()]})


def _enter(frame: pd.DataFrame) -> pd.DataFrame:
    """The state in which each chunk of a frame is entered, from that of the first."""
    frame = frame.sort_values("chunk")
    state, records, begun = (int(frame[x].iloc[0]) for x in ("state0", "records0", "begun0"))
    rows = []
    for chunk, s, r, b in zip(frame.chunk, frame.state, frame.records, frame.begun):
        rows.append((frame.source_file.iloc[0], chunk, state, records, begun))
        state, records, begun = int(s[state]), records + int(r[state]), int(b[state]) if b[state] >= 0 else begun
    return pd.DataFrame(rows, columns=["source_file", "chunk", "state0", "records0", "begun0"])


_ENTRY = "source_file string, chunk long, state0 long, records0 long, begun0 long"


def entries(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(source_file, chunk, state0, records0, begun0): how each chunk is entered. Maps of `fan` chunks are composed to one, and
    those again, until a file has no more than `fan`; no task gets more."""
    zero = F.lit(0).cast("long")
    if (maps.agg(F.max("chunk")).first()[0] or 0) < fan:
        return maps.withColumns({"state0": zero, "records0": zero, "begun0": F.lit(-1).cast("long")}).groupBy("source_file").applyInPandas(_enter, _ENTRY)
    parts = maps.withColumn("upper", F.floor(F.col("chunk") / fan))
    upper = settle(parts.groupBy("source_file", "upper").applyInPandas(_compose, "source_file string, chunk long, state array<long>, records array<long>, begun array<long>"))
    first = entries(upper, fan).withColumnRenamed("chunk", "upper")
    return parts.join(first, ["source_file", "upper"]).groupBy("source_file", "upper").applyInPandas(_enter, _ENTRY)


def _walks(expected: int, max_lines: int):
    def run(batches):
        to, ends = automaton(expected, max_lines)
        for batch in batches:
            for row in batch.to_pylist():
                starts, places = walk(row["kinds"], row["numbers"], row["state0"], row["records0"], row["begun0"], to, ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["source_file"]] * len(starts)), pa.array(row["numbers"]), pa.array(starts), pa.array(places)], names=["source_file", "line_no", "physical_line", "record_no"])

    return run


def line_records(lines: DataFrame, delimiter: str, expected: int, max_lines: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(source_file, line_no, physical_line, record_no): the record of every line, by its first line and its place among the file's records."""
    coded = lines.select("source_file", F.floor((F.col("line_no") - 1) / chunk).alias("chunk"), F.struct("line_no", line_kind("line", delimiter, expected).alias("kind")).alias("x"))
    rows = coded.groupBy("source_file", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    chunks = settle(rows.select("source_file", "chunk", F.col("x.line_no").alias("numbers"), F.col("x.kind").alias("kinds")), "chunks")
    maps = settle(chunks.mapInArrow(_maps(expected, max_lines), "source_file string, chunk long, state array<long>, records array<long>, begun array<long>"), "maps")
    entered = chunks.join(entries(maps, fan), ["source_file", "chunk"])
    return entered.mapInArrow(_walks(expected, max_lines), "source_file string, line_no long, physical_line long, record_no long")
