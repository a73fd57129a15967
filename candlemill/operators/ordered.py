"""Run a recurrence along each key's order, chunk by chunk, in parallel within a key.

1. each chunk is summarised (one row: its first values and what the others do to any state);
2. per key the summaries, one row per chunk, are applied in order: the state every chunk starts with;
3. each chunk is replayed from its own starting state, row by row, exactly as one long pass would.

Where a key may have millions of chunks, step 2 has two levels: blocks of chunks are summarised in their
turn, and only the blocks of a key are applied one after the other.

Steps 1 and 3 see one chunk at a time (bounded, see ``chunks``); step 2 sees summaries only. A chunk is
one row of a stored table holding an array of its bars: rows move once, when that is written, and steps 1 and 3 read it
in place, step 1 the column of the values alone. Only the arrays of the value itself visit Python: the other
columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from candlemill.functions.recurrences import Laned, missing
from candlemill.operators.chunks import BROADCAST_CHUNKS, CHUNK, ROWS

BLOCK_NO = "_block"


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def _series(*columns: pa.ListArray) -> tuple[list[list], np.ndarray]:
    """The values of each chunk (pairs, for two columns), null as NaN; and where chunks start."""
    offsets = _offsets(columns[0])
    flat = [c.flatten().to_numpy(zero_copy_only=False).tolist() for c in columns]
    values = flat[0] if len(flat) == 1 else list(zip(*flat))
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])], offsets


def _present(lists: pa.ListArray) -> tuple[np.ndarray, list[int], list[int], np.ndarray, np.ndarray]:
    """The values that are not missing; where each chunk's begin and end; where chunks start among all; which are there."""
    offsets = _offsets(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    there = np.isfinite(flat)
    before = np.concatenate([[0], np.cumsum(there)])
    return flat[there], before[offsets[:-1]].tolist(), before[offsets[1:]].tolist(), offsets, there


def _absent(value) -> bool:
    return missing(value[0] if isinstance(value, tuple) else value)


def _over_arrays(function: Callable, inputs: int, result: T.DataType):
    """``function`` as an Arrow UDF of one, two or three array columns."""
    def one(a: pa.Array) -> pa.Array:
        return function(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return function(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return function(a, b, c)

    return F.arrow_udf({1: one, 2: two, 3: three}[inputs], result)


def scan(
    df: DataFrame,
    recurrence,
    values: Sequence[str],
    outputs: dict[str, T.DataType],
    chunks: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("group_id",),
    between: Callable | None = None,
    given: DataFrame | None = None,
    lags: dict[str, tuple[str, int]] | None = None,
    lags_over_chunks: bool = True,
    block: Column | None = None,
) -> DataFrame:
    """``df`` with one column per output of ``recurrence``, run over ``values`` in ``order``.

    ``chunks`` is ``df`` as ``packed`` or ``packed_by_rows`` store it; ``df`` itself gives the columns alone. ``between(state, last_was_null, earlier, later)`` may change
    the state from one chunk to the next. ``given`` holds end states known from before: keys, ``CHUNK``
    and ``_state``.

    ``lags`` adds ``name: (column, k)``, the column's value ``k`` rows earlier, which costs next to
    nothing here: it is in the same array, or among the few last rows of the chunks before (unless
    ``lags_over_chunks`` is false).

    ``block`` numbers blocks of consecutive chunks, for step 2 in two levels (without ``between``,
    ``given`` and ``lags``).
    """
    lags = lags or {}
    depth = max([k for _, k in lags.values()], default=0) if lags_over_chunks else 0
    keys, order, several = list(keys), list(order), len(values) > 1
    cell = T.DoubleType() if recurrence.state_type == "double" else T.StringType()
    numbers = T.ArrayType(cell)
    columns, group = df.columns, [*keys, CHUNK]

    # 1. one summary per chunk
    doubles = T.ArrayType(T.DoubleType())
    summary_type = (
        T.StructType().add("_head", doubles).add("_head_start", doubles).add("_rest", numbers)
        .add("_last_null", T.BooleanType()).add("_state", numbers)
    )
    lagged = list(dict.fromkeys(c for c, _ in lags.values()))
    tail_type = T.ArrayType(T.StructType([df.schema[c] for c in lagged]))

    laned = isinstance(recurrence, Laned) and not several

    def summarise(*lists: pa.ListArray) -> pa.Array:
        found = []
        if laned:
            values_, begins, ends, offsets, there = _present(lists[0])
            tails = [min(b + recurrence.head, e) for b, e in zip(begins, ends)]
            for b, tail, rest, end in zip(begins, tails, recurrence.rest_all(values_, tails, ends), offsets[1:]):
                found.append({"_head": values_[b:tail].tolist(), "_head_start": None, "_rest": rest,
                              "_last_null": not there[end - 1], "_state": None})
            return pa.array(found, type=to_arrow_type(summary_type))
        guess = getattr(recurrence, "guess", None)
        for series in _series(*lists)[0]:
            ends = guess(series) if guess else None
            if ends is not None:
                found.append({"_head": [], "_head_start": None, "_rest": ends, "_last_null": _absent(series[-1]), "_state": None})
                continue
            present = [v for v in series if not _absent(v)]
            head, tail = present[: recurrence.head], present[recurrence.head :]
            found.append({
                "_head": [v[0] for v in head] if several else head,
                "_head_start": [v[1] for v in head] if several else None,
                "_rest": recurrence.rest(tail, head[-1]) if tail else None,
                "_last_null": _absent(series[-1]),
                "_state": None,
            })
        return pa.array(found, type=to_arrow_type(summary_type))

    arrays = [F.col(f"{ROWS}.{v}") for v in values]
    summary = _over_arrays(summarise, len(values), summary_type)(*arrays).alias("_summary")
    tail = F.lit(None).cast(tail_type)
    if depth:
        ends_at = [F.slice(F.col(f"{ROWS}.{c}"), F.greatest(F.size(f"{ROWS}.{c}") - (depth - 1), F.lit(1)), F.lit(depth)).alias(c) for c in lagged]
        tail = F.arrays_zip(*ends_at).cast(tail_type)
    summaries = chunks.select(*group, summary, tail.alias("_tail")).select(
        *group, "_summary.*", "_tail"
    )
    if given is not None:
        known = given.withColumn("_last_null", F.lit(False))
        summaries = summaries.unionByName(known, allowMissingColumns=True)

    # 2. the state each chunk starts with
    def states_from(state, table: pa.Table, position: str, kept: list[str]) -> pa.Table:
        table = table.sort_by([(position, "ascending")])
        starts, last_null, previous, befores, before = [], False, None, [], []
        for at, head, head_start, rest, ends_null, known, last_rows in zip(
            *[table.column(c).to_pylist() for c in (position, *summary_type.names, "_tail")]
        ):
            befores.append(before)
            before = (before + (last_rows or []))[-depth:] if depth else before
            if between is not None and previous is not None:
                state = between(state, last_null, previous, at)
            starts.append(state)
            if known is not None:
                state = known
            else:
                _, state = recurrence.run(list(zip(head, head_start)) if several else head, state)
                if rest is not None:
                    state = recurrence.after(state, rest)
            last_null, previous = ends_null, at
        table = table.select(kept)
        table = table.append_column("_start", pa.array(starts, type=to_arrow_type(numbers)))
        return table.append_column("_before", pa.array(befores, type=to_arrow_type(tail_type)))

    def start_states(table: pa.Table) -> pa.Table:
        return states_from(recurrence.start(), table, CHUNK, group)

    def block_start_states(table: pa.Table) -> pa.Table:
        return states_from(recurrence.start(), table, BLOCK_NO, [*keys, BLOCK_NO])

    def start_states_in_block(table: pa.Table, opening: pa.Table) -> pa.Table:
        return states_from(opening.column("_start")[0].as_py(), table, CHUNK, group)

    def combine(table: pa.Table) -> pa.Table:
        """The summary of a block: the heads up to a full head, and the rest of everything after."""
        table = table.sort_by([(CHUNK, "ascending")])
        head, rest = [], None
        for values_, rest_ in zip(table.column("_head").to_pylist(), table.column("_rest").to_pylist()):
            taken = recurrence.head - len(head)
            head += values_[:taken]
            beyond = [recurrence.rest(values_[taken:])] if len(values_) > taken else []
            for more in beyond + ([rest_] if rest_ is not None else []):
                rest = more if rest is None else recurrence.then(rest, more)
        first = table.slice(0, 1)
        found = {"_head": head, "_head_start": None, "_rest": rest, "_last_null": False, "_state": None}
        whole = pa.array([found], type=to_arrow_type(summary_type)).flatten()
        return pa.table([*[first.column(c) for c in (*keys, BLOCK_NO)], *whole, first.column("_tail")],
                        names=[*keys, BLOCK_NO, *summary_type.names, "_tail"])

    ends = T.StructType().add("_start", numbers).add("_before", tail_type).fields
    key_fields = [df.schema[k] for k in keys]
    starts_type = T.StructType([*key_fields, chunks.schema[CHUNK], *ends])
    if block is None:
        starts = summaries.groupBy(*keys).applyInArrow(start_states, starts_type)
    else:
        at_block = T.StructField(BLOCK_NO, T.LongType())
        placed = summaries.withColumn(BLOCK_NO, block)
        blocks_type = T.StructType([*key_fields, at_block, *summary_type.fields,
                                    T.StructField("_tail", tail_type)])
        openings = (
            placed.groupBy(*keys, BLOCK_NO).applyInArrow(combine, blocks_type)
            .groupBy(*keys).applyInArrow(
                block_start_states, T.StructType([*key_fields, at_block, *ends]))
        )
        starts = (
            placed.groupBy(*keys, BLOCK_NO).cogroup(openings.groupBy(*keys, BLOCK_NO))
            .applyInArrow(start_states_in_block, starts_type)
        )

    # 3. each chunk from its state
    replay_type = T.StructType(
        [T.StructField(n, T.ArrayType(t)) for n, t in outputs.items()]
    )

    def replay(*lists: pa.Array) -> pa.Array:
        *lists, start = lists
        if laned:
            values_, begins, ends, offsets, there = _present(lists[0])
            flat = []
            for results in recurrence.run_all(values_, begins, ends, start.to_pylist()):
                column = np.full(len(there), np.nan)
                column[there] = results
                flat.append(pa.array(column, mask=np.isnan(column)))
        else:
            series, offsets = _series(*lists)
            flat = [[] for _ in outputs]
            for one, state in zip(series, start.to_pylist()):
                results = recurrence.outputs(one, state) if hasattr(recurrence, "outputs") else recurrence.run(one, state)[0]
                for column, result in zip(flat, results):
                    column.extend(result)
            flat = [pa.array(column, type=to_arrow_type(kind)) for column, kind in zip(flat, outputs.values())]
        where = pa.array(offsets, type=pa.int32())
        found = [pa.ListArray.from_arrays(where, column) for column in flat]
        return pa.StructArray.from_arrays(found, names=list(outputs))

    few = chunks.count() <= BROADCAST_CHUNKS  # in the files' footers; a start is less than a kilobyte
    known = starts.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_start", "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    opened = chunks.join(F.broadcast(known) if few else known, same)
    arrays = [F.col(f"{ROWS}.{v}") for v in values]
    found = _over_arrays(replay, len(values) + 1, replay_type)(*arrays, F.col("_start"))
    spread = opened.withColumn("_found", found).select(
        *keys, "_found", ROWS, "_before", F.posexplode(ROWS).alias("_at", "_row")
    )
    at = F.col("_at")

    def lag(column: str, k: int) -> Column:
        here = F.when(at >= k, F.col(ROWS)[F.greatest(at - k, F.lit(0))][column])
        return here.otherwise(F.try_element_at("_before", at - k)[column]) if depth else here

    return spread.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}") for c in columns],
        *[lag(c, k).alias(n) for n, (c, k) in lags.items()],
        *[F.col(f"_found.{n}")[at].alias(n) for n in outputs],
    )
