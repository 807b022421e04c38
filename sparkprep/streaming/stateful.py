"""Stateful stream operators: prefix reuse, context windows with eviction, buffered flushes, incremental decoding.

Each keeps its state by key in the state store, so keys spread over executors and survive the loss of one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.bpe import complete_length


def evict(length: int, more: int, capacity: int, keep: int) -> int:
    """Tokens to drop behind the pinned head so that ``more`` fit (see ``operators.context.eviction``)."""
    need, keep = length + more - capacity, min(keep, length)
    if need <= 0:
        return 0
    if keep + more > capacity:
        raise ValueError("pinned tokens and new ones exceed the window")
    return min(length - keep, need + capacity // 4)


def _in_order(frames: Iterator[pd.DataFrame], order: str, value: str) -> Iterator[tuple]:
    """(order, value) of a key's rows of a batch in order: two columns are held and sorted, not rows."""
    parts = [(f[order].to_numpy(), f[value].to_numpy()) for f in frames]
    places, values = (np.concatenate(x) for x in zip(*parts))
    at = np.argsort(places, kind="stable")
    return zip(places[at].tolist(), values[at])


def prefix_reuse(stream: DataFrame, key: str, order: str, ids: str) -> DataFrame:
    """(key, order, matched, reused): leading ids that each row shares with the row before of its key, over all batches.

    Rows of a batch are taken in ``order``; at least one token of a prompt is always passed again; null ids are no tokens.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = []
        for place, value in _in_order(frames, order, ids):
            own = [] if value is None else value.tolist() if hasattr(value, "tolist") else list(value)
            n = next((i for i, (a, b) in enumerate(zip(last, own)) if a != b), min(len(last), len(own)))
            rows.append((k[0], place, n, len(own) - 1 if own and n >= len(own) else n))
            last = own
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, order, "matched", "reused"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, matched bigint, reused bigint", f"last {kinds[ids]}", "append", GroupStateTimeout.NoTimeout)


def context_windows(stream: DataFrame, key: str, order: str, n: str, capacity: int, keep: int = 4) -> DataFrame:
    """(key, order, evicted, length): a window of ``capacity`` tokens per key that takes ``n`` tokens a row.

    When tokens do not fit, those behind the pinned head go, with a quarter of the window as cushion. A row of more tokens
    than fit behind the head counts as that many; null and negative numbers as none.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = int(state.get[0]) if state.exists else 0
        rows = []
        for place, value in _in_order(frames, order, n):
            more = 0 if pd.isna(value) else min(max(int(value), 0), capacity - min(keep, length))
            gone = evict(length, more, capacity, keep)
            length += more - gone
            rows.append((k[0], place, gone, length))
        state.update((length,))
        yield pd.DataFrame(rows, columns=[key, order, "evicted", "length"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, evicted bigint, length bigint", "length bigint", "append", GroupStateTimeout.NoTimeout)


def buffered(stream: DataFrame, key: str, text: str, n: str, most: int = 300, seconds: float = 30.0, clock: Callable[[], float] = time.time) -> DataFrame:
    """(key, content, n_tokens, reason): texts of a key joined until ``most`` tokens are held or ``seconds`` have passed.

    The time runs from the first text held; it is looked at with every batch and by a processing-time timeout.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, count, since = state.get if state.exists else ("", 0, 0.0)
        out = []
        if state.hasTimedOut:
            if count:
                out.append((k[0], held, count, "time"))
            state.remove()
        else:
            for frame in frames:
                for piece, size in zip(frame[text], frame[n]):
                    since = since if count else clock()
                    held, count = held + (piece or ""), count + (0 if pd.isna(size) else int(size))
                    if count >= most:
                        out.append((k[0], held, count, "count"))
                        held, count = "", 0
            if count and clock() - since >= seconds:
                out.append((k[0], held, count, "time"))
                held, count = "", 0
            state.update((held, count, since))
            if count:
                state.setTimeoutDuration(max(1, int(1000 * (seconds - (clock() - since)))))
        yield pd.DataFrame(out, columns=[key, "content", "n_tokens", "reason"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, content string, n_tokens bigint, reason string", "held string, count bigint, since double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decoded(stream: DataFrame, key: str, order: str, raw: str) -> DataFrame:
    """(key, order, text): bytes of a key as text; bytes of a torn last character wait for the next row."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = bytes(state.get[0]) if state.exists else b""
        rows = []
        for place, value in _in_order(frames, order, raw):
            held += bytes(value) if value is not None else b""
            cut = complete_length(held)
            rows.append((k[0], place, held[:cut].decode("utf-8", "replace")))
            held = held[cut:]
        state.update((held,))
        yield pd.DataFrame(rows, columns=[key, order, "text"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, text string", "held binary", "append", GroupStateTimeout.NoTimeout)
