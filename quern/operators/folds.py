"""Folds over ordered rows of a key, split into blocks that run in different tasks.

A block holds the rows whose order value, divided by ``block``, is the same; each task streams its sorted
blocks, row by row, with one open state. What a block hands over is known before it has run, because a
fold also gives a block's *summary*: what the block does to any state that comes in. The summaries of a
key (a row a block, and only for keys of more than one block) are composed in order; each block then
starts from the state handed to it. So a key of any size spreads over all tasks, and nothing but the
open state is held.
"""

from __future__ import annotations

import math
import pickle
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16

State = tuple
Row = tuple  # the order value and then the fold's fields


class Fold:
    """first and step make states of rows; closed ones are emitted; summary() of a block is composed."""

    #: Schema of what is emitted, beside the key.
    out: str

    def first(self, row: Row) -> State:
        raise NotImplementedError

    def step(self, state: State, row: Row) -> tuple[State, State | None]:
        """The state after the row, and the state that the row closed, if it did."""
        raise NotImplementedError

    def emit(self, state: State) -> tuple:
        """The result row of a closed state."""
        raise NotImplementedError

    def summary(self, high: float | None):
        """An object with push(row) for every row of a block and apply(state or None) -> state.

        high: the most that the first field has in the blocks before.
        """
        raise NotImplementedError


# --- segments that merge ------------------------------------------------------------------------


class Merging(Fold):
    """A segment joins the open one or closes it. States are (idx, start, end, payload).

    Whether it joins may depend on the open segment's start and end and on the row, (idx, start, end, ...);
    the end is the last row's, so of a state that comes in only its start is unknown to a block.
    """

    def joins(self, start: float, end: float, row: Row) -> bool:
        raise NotImplementedError

    def cuts(self, end: float, row: Row) -> list[float]:
        """Starts at which joins(start, end, row) may change: the least of those beyond each."""
        return []

    def payload(self, row: Row):
        raise NotImplementedError

    def both(self, payload, row: Row):
        """The payload with the row's taken in."""
        raise NotImplementedError

    def through(self, rows, row: Row):
        """What rows that all join do to a payload, and one row more; rows is None at first."""
        raise NotImplementedError

    def extended(self, payload, rows):
        raise NotImplementedError

    def first(self, row: Row) -> State:
        return row[0], _number(row[1]), _number(row[2]), self.payload(row)

    def step(self, state: State, row: Row) -> tuple[State, State | None]:
        if self.joins(state[1], state[2], (row[0], _number(row[1]), _number(row[2]), *row[3:])):
            return (state[0], state[1], _number(row[2]), self.both(state[3], row)), None
        return self.first(row), state

    def summary(self, high):
        return Pieces(self, high)


def _number(x: float | None) -> float:
    """A missing bound compares with nothing."""
    return math.nan if x is None else x


def _given(x: float) -> float | None:
    return None if x is None or math.isnan(x) else x


def _rank(x: float) -> int:
    """Doubles as whole numbers in the same order."""
    n = struct.unpack("<q", struct.pack("<d", x))[0]
    return n if n >= 0 else -(n & (1 << 63) - 1)


def _unranked(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n if n >= 0 else -n - (1 << 63)))[0]


def least_start(end: float, length: float) -> float:
    """The least start for which end - start < length, as floating-point numbers have it."""
    near = 4 * math.ulp(max(abs(end), abs(length)))
    low, high = _rank(end - length - near), _rank(end - length + near)
    while high - low > 1:
        middle = (low + high) // 2
        if end - _unranked(middle) < length:
            high = middle
        else:
            low = middle
    return _unranked(high)


class Pieces:
    """What a block does to an open segment, by that segment's start, which is ``high`` at most.

    The starts are cut into intervals: for each, either the block closes the segment somewhere, and what
    is open after the block is known, or all rows join. Segments that were opened at the same row are
    one, so few intervals stay.
    """

    def __init__(self, fold: Merging, high: float | None):
        self.fold, self.n, self.head, self.fresh, self.end, self.rows = fold, 0, None, None, None, None
        self.top = math.inf if high is None or math.isnan(high) else math.nextafter(high, math.inf)
        #: least start, number of the row that opened what is open after the block, that state (None: all rows join)
        self.pieces: list[tuple[float, int, State | None]] = [(-math.inf, -1, None)]

    def push(self, row: Row) -> None:
        fold, self.n = self.fold, self.n + 1
        if self.head is None:
            self.head, self.fresh, self.end = row, fold.first(row), _number(row[2])
            return
        self.fresh = fold.step(self.fresh, row)[0]
        plain = (row[0], _number(row[1]), _number(row[2]), *row[3:])
        new: list[tuple[float, int, State | None]] = []
        cuts = None
        for k, (low, opened, state) in enumerate(self.pieces):
            if state is not None:
                after, closed = fold.step(state, row)
                found = [(low, opened if closed is None else self.n, after)]
            else:
                high = self.pieces[k + 1][0] if k + 1 < len(self.pieces) else self.top
                cuts = cuts if cuts is not None else fold.cuts(self.end, plain)
                inner = sorted({c for c in cuts if low < c < high})
                found = [(at, -1, None) if fold.joins(at, self.end, plain) else (at, self.n, fold.first(row)) for at in [low, *inner]]
            for one in found:
                if not new or new[-1][1] != one[1]:
                    new.append(one)
        self.pieces, self.end = new, _number(row[2])
        self.rows = fold.through(self.rows, row) if any(x is None for *_, x in new) else None

    def apply(self, state: State | None) -> State:
        if state is None:
            return self.fresh
        state, closed = self.fold.step(state, self.head)
        if closed is not None:
            return self.fresh
        # a start that compares with nothing does as one before all others
        after = self.pieces[0][2]
        for low, _, piece in self.pieces:
            if state[1] >= low:
                after = piece
        if after is not None:
            return after
        return (state[0], state[1], self.end, self.fold.extended(state[3], self.rows)) if self.n > 1 else state


class Cues(Merging):
    """Rows (idx, start, end, text): the four rules of merge_short_cues; the payload is the list of texts."""

    out = "idx int, start double, end double, text string"

    def __init__(self, least: float, most: float, max_gap: float):
        self.least, self.most, self.max_gap = least, most, max_gap

    def joins(self, start, end, row):
        own, after, gap = end - start, row[2] - row[1], row[1] - end
        if own < self.least:
            near = gap <= (self.max_gap * 2 if own < 1.0 else self.max_gap)
        elif after < self.least:
            near = gap <= self.max_gap
        elif own < 2.0 and after < 2.0:
            near = gap <= self.max_gap * 1.5
        else:
            near = gap < 0.5
        return near and row[2] - start <= self.most

    def cuts(self, end, row):
        out = [least_start(end, x) for x in (self.least, 1.0, 2.0) if math.isfinite(end)]
        if math.isfinite(row[2]):
            out.append(least_start(row[2], math.nextafter(self.most, math.inf)))
        return out

    def payload(self, row):
        return [row[3]]

    def both(self, payload, row):
        return [*payload, row[3]]

    def through(self, rows, row):
        rows = [] if rows is None else rows
        rows.append(row[3])
        return rows

    def extended(self, payload, rows):
        return [*payload, *rows]

    def emit(self, state):
        idx, start, end, texts = state
        return idx, _given(start), _given(end), texts[0] if len(texts) == 1 else " ".join(x for x in texts if x is not None)


def _halved(rows, x):
    """The map c -> (c + x) / 2 after the map rows, as (factor, rest)."""
    factor, rest = rows or (1.0, 0.0)
    return factor / 2, (rest + x) / 2


class Speech(Merging):
    """Rows (idx, start, end, confidence): gaps up to max_gap, or a segment shorter than ``least``."""

    out = "idx int, start double, end double, confidence double"

    def __init__(self, least: float, max_gap: float):
        self.least, self.max_gap = least, max_gap

    def joins(self, start, end, row):
        return row[1] - end <= self.max_gap or end - start < self.least

    def cuts(self, end, row):
        return [] if row[1] - end <= self.max_gap or not math.isfinite(end) else [least_start(end, self.least)]

    def payload(self, row):
        return _number(row[3])

    def both(self, payload, row):
        return (payload + _number(row[3])) / 2

    def through(self, rows, row):
        return _halved(rows, _number(row[3]))

    def extended(self, payload, rows):
        return payload * rows[0] + rows[1]

    def emit(self, state):
        return state[0], *map(_given, state[1:])


class Close(Merging):
    """Rows (idx, start, end, confidence, snr, padded): gaps up to max_gap, also after a missing bound."""

    out = "idx int, start double, end double, confidence double, snr double, padded boolean, n long"

    def __init__(self, max_gap: float):
        self.max_gap = max_gap

    def joins(self, start, end, row):
        return not row[1] - end > self.max_gap

    def payload(self, row):
        return _number(row[3]), row[4], row[5], 1

    def both(self, payload, row):
        c, snr, padded, n = payload
        return (c + _number(row[3])) / 2, _least(snr, row[4]), _all(padded, row[5]), n + 1

    def through(self, rows, row):
        c, snr, padded, n = rows or (None, None, None, 0)
        return _halved(c, _number(row[3])), _least(snr, row[4]), _all(padded, row[5]), n + 1

    def extended(self, payload, rows):
        c, snr, padded, n = payload
        (factor, rest), more_snr, more_padded, more = rows
        return c * factor + rest, _least(snr, more_snr), _all(padded, more_padded), n + more

    def emit(self, state):
        idx, start, end, (c, snr, padded, n) = state
        return idx, _given(start), _given(end), _given(c), snr, padded, n


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _all(a, b):
    return b if a is None else a if b is None else a and b


# --- series of losses ---------------------------------------------------------------------------


class Stopping(Fold):
    """Rows (epoch, loss): the state is (best, its epoch, epochs without a better one, where it stopped).

    A null loss is never better. A better loss makes what came before it irrelevant, and after ``patience`` others all is over, so a
    block's summary is its new lows among its first ``patience`` rows.
    """

    out = "best double, best_epoch int, stop_epoch int"

    def __init__(self, patience: int, least_delta: float, baseline: bool):
        if patience < 1:
            raise ValueError("patience must be positive")
        self.patience, self.least_delta, self.baseline = patience, least_delta, baseline

    def first(self, row):
        return self.step((None if self.baseline else math.inf, None, 0, None), row)[0]

    def better(self, best: float | None, loss: float | None) -> bool:
        return loss is not None and (best is None or loss < best - self.least_delta)

    def step(self, state, row):
        best, at, bad, stop = state
        if stop is not None:
            return state, None
        if self.better(best, row[1]):
            return (row[1], row[0], 0, None), None
        return (best, at, bad + 1, row[0] if bad + 1 >= self.patience else None), None

    def emit(self, state):
        return state[0], state[1], state[3]

    def summary(self, high) -> Lows:
        return Lows(self)


class Lows:
    def __init__(self, fold: Stopping):
        self.fold, self.fresh, self.n, self.epochs = fold, None, 0, []
        self.lows: list[tuple[int, float, State]] = []  # rows before it, loss, state after the block

    def push(self, row: Row) -> None:
        self.fresh = self.fold.first(row) if self.fresh is None else self.fold.step(self.fresh, row)[0]
        self.lows = [(n, loss, self.fold.step(s, row)[0]) for n, loss, s in self.lows]
        if self.n < self.fold.patience:
            self.epochs.append(row[0])
            if row[1] is not None and (not self.lows or row[1] < self.lows[-1][1]):
                self.lows.append((self.n, row[1], (row[1], row[0], 0, None)))
        self.n += 1

    def apply(self, state: State | None) -> State:
        if state is None:
            return self.fresh
        best, at, bad, stop = state
        if stop is not None:
            return state
        left = self.fold.patience - bad
        for n, loss, after in self.lows:
            if n < left and self.fold.better(best, loss):
                return after
        if self.n >= left:
            return best, at, self.fold.patience, self.epochs[left - 1]
        return best, at, bad + self.n, None


class Average(Fold):
    """Rows (epoch, loss): the exponential moving average, from the first loss on; a block is a linear map."""

    out = "ema double"

    def __init__(self, decay: float):
        self.decay = decay

    def first(self, row):
        return (_number(row[1]),)

    def step(self, state, row):
        return ((1 - self.decay) * _number(row[1]) + self.decay * state[0],), None

    def emit(self, state):
        return (_given(state[0]),)

    def summary(self, high) -> Line:
        return Line(self)


class Line:
    def __init__(self, fold: Average):
        self.fold, self.fresh, self.factor, self.rest = fold, None, 1.0, 0.0

    def push(self, row: Row) -> None:
        self.fresh = self.fold.first(row) if self.fresh is None else self.fold.step(self.fresh, row)[0]
        self.factor *= self.fold.decay
        self.rest = (1 - self.fold.decay) * _number(row[1]) + self.fold.decay * self.rest

    def apply(self, state: State | None) -> State:
        return self.fresh if state is None else (self.factor * state[0] + self.rest,)


# --- on Spark -----------------------------------------------------------------------------------


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], kind: T.StructType, size: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, own = to_arrow_schema(kind), []
    for r in rows:
        own.append(r)
        if len(own) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)
            own = []
    if own:
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*own, strict=True), schema, strict=True)], schema=schema)


def _streamed(df: DataFrame, f, kind: str | T.StructType) -> DataFrame:
    """df's rows, partition by partition, through f: tuples -> tuples."""
    schema = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    return df.mapInArrow(lambda batches: _batches(f(_tuples(batches)), schema), schema)


def folded(df: DataFrame, key: str, order: str, fields: list[str | Column], fold: Fold, block: int = BLOCK) -> DataFrame:
    """The key and what ``fold`` emits, for rows in the order of a column of whole numbers that count a key's rows.

    Gaps in the order only make blocks uneven. Rows equal in order are taken by their other fields, a null
    order comes first; a null key is a key; an empty table gives an empty result.
    """
    named = [F.col(x) if isinstance(x, str) else x for x in fields]
    names = [f"__f{i}" for i in range(len(named))]
    rows = df.select(
        F.col(key).alias("__key"), F.expr(f"`{order}` div {block}").alias("__block"), F.col(order).alias("__order"),
        *(c.alias(n) for c, n in zip(named, names, strict=True)),
    )
    key_kind = rows.schema["__key"].dataType

    # 1. keys of more than one block: what each block does to a state
    own = W.partitionBy("__k")
    blocks = rows.groupBy(F.col("__key").alias("__k"), F.col("__block").alias("__b")).agg(F.max("__f0").cast("double").alias("__most"))
    before = F.max("__most").over(own.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    several = blocks.withColumns({"__n": F.count("*").over(own), "__high": before}).filter("__n > 1")
    same = rows["__key"].eqNullSafe(several["__k"]) & rows["__block"].eqNullSafe(several["__b"])
    dealt = rows.join(several, same).select(*rows.columns, "__high").repartition("__key", "__block")

    def summaries(own: Iterator[tuple]) -> Iterator[tuple]:
        for (k, b), group in groupby(own, key=lambda r: r[:2]):
            one = None
            for r in group:
                one = one or fold.summary(r[-1])
                one.push(r[2:-1])
            yield k, b, pickle.dumps(one)

    summed = T.StructType([T.StructField("__key", key_kind), T.StructField("__block", T.LongType()), T.StructField("__with", T.BinaryType())])
    known = _streamed(dealt.sortWithinPartitions("__key", "__block", "__order", *names), summaries, summed)

    # 2. composed in order: the state that each block starts from, and whether another block follows
    def states(own: Iterator[tuple]) -> Iterator[tuple]:
        for k, group in groupby(own, key=lambda r: r[0]):
            state, waiting = None, None
            for _, b, data in group:
                if waiting is not None:
                    yield *waiting, True
                waiting = (k, b, None if state is None else pickle.dumps(state))
                state = pickle.loads(data).apply(state)
            yield *waiting, False

    handed = _streamed(
        known.repartition("__key").sortWithinPartitions("__key", "__block"), states, T.StructType([*summed.fields, T.StructField("__more", T.BooleanType())])
    )

    # 3. every block from its own state
    none = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in ("__order", *names)]
    both = rows.withColumns({"__row": F.lit(True), "__with": F.lit(None).cast("binary"), "__more": F.lit(False)}).unionByName(
        handed.select("__key", "__block", *none, F.lit(False).alias("__row"), "__with", "__more")
    )
    ready = both.repartition("__key", "__block").sortWithinPartitions("__key", "__block", "__row", "__order", *names)

    def run(own: Iterator[tuple]) -> Iterator[tuple]:
        for (k, _), group in groupby(own, key=lambda r: r[:2]):
            state, more = None, False
            for r in group:
                *row, is_row, data, follows = r[2:]
                if not is_row:
                    state, more = pickle.loads(data) if data is not None else None, follows
                elif state is None:
                    state = fold.first(tuple(row))
                else:
                    state, closed = fold.step(state, tuple(row))
                    if closed is not None:
                        yield k, *fold.emit(closed)
            if not more:
                yield k, *fold.emit(state)

    return _streamed(ready, run, T.StructType([T.StructField(key, key_kind), *T._parse_datatype_string(fold.out).fields]))
