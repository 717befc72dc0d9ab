"""Blocking pops and consumer groups over streams of commands, with state per key.

Commands of a queue are rows (key, at, kind, side, value, client, timeout_ms): kind push, or pop that waits.
Commands of a group are rows (key, at, kind, consumer, ms, seq, min_idle): kind add, read, ack or claim.
Time is the commands' own ``at`` in milliseconds, so a replay gives the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def blocking_pops(commands: DataFrame, wall_clock: bool = False) -> DataFrame:
    """(key, client, value, at): what each waiting pop gets, first come first served; NULL where it timed out.

    A pop times out when a later command of its key says so by its ``at``; with ``wall_clock``, whose ``at`` are
    milliseconds of the processing clock, also when that clock passes, without any further command.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items, waiting = json.loads(state.get[0]) if state.exists else ([], [])
        out = []

        def give_up(now: int) -> None:
            for w in [w for w in waiting if w[2] and now >= w[2]]:
                waiting.remove(w)
                out.append((key[0], w[0], None, w[2]))

        rows = [] if state.hasTimedOut else pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False)
        for c in rows:
            give_up(c.at)
            if c.kind == "push":
                items.insert(0, c.value) if c.side == "left" else items.append(c.value)
                while items and waiting:
                    client, side, _ = waiting.pop(0)
                    out.append((key[0], client, items.pop(0 if side == "left" else -1), int(c.at)))
            elif items:
                out.append((key[0], c.client, items.pop(0 if c.side == "left" else -1), int(c.at)))
            else:
                limit = int(c.timeout_ms) if c.timeout_ms == c.timeout_ms and c.timeout_ms is not None else 0
                waiting.append([c.client, c.side, int(c.at) + limit if limit else 0])
        if wall_clock:
            now = state.getCurrentProcessingTimeMs()
            give_up(now)
        state.update((json.dumps([items, waiting]),))
        if wall_clock and (due := [w[2] for w in waiting if w[2]]):
            state.setTimeoutDuration(max(1, min(due) - now))
        yield pd.DataFrame(out, columns=["key", "client", "value", "at"])

    timeout = "ProcessingTimeTimeout" if wall_clock else "NoTimeout"
    return commands.groupBy("key").applyInPandasWithState(step, "key string, client string, value string, at long", "held string", "append", timeout)


def consumer_group(commands: DataFrame) -> DataFrame:
    """(key, consumer, ms, seq, deliveries, event) of one group: delivered, acked and claimed entries.

    A read takes all entries that nobody was given; a claim takes pending ones that idled ``min_idle`` ms.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fresh, pending = json.loads(state.get[0]) if state.exists else ([], {})
        out = []
        for c in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples(index=False):
            if c.kind == "add":
                fresh.append([int(c.ms), int(c.seq)])
            elif c.kind == "read":
                for ms, seq in fresh:
                    pending[f"{ms}-{seq}"] = [c.consumer, int(c.at), 1]
                    out.append((key[0], c.consumer, ms, seq, 1, "delivered"))
                fresh = []
            elif c.kind == "ack":
                if held := pending.pop(f"{int(c.ms)}-{int(c.seq)}", None):
                    out.append((key[0], held[0], int(c.ms), int(c.seq), held[2], "acked"))
            elif c.kind == "claim":
                for name, (_, since, times) in sorted(pending.items(), key=lambda x: tuple(map(int, x[0].split("-")))):
                    if c.at - since >= c.min_idle:
                        ms, seq = map(int, name.split("-"))
                        pending[name] = [c.consumer, int(c.at), times + 1]
                        out.append((key[0], c.consumer, ms, seq, times + 1, "claimed"))
        state.update((json.dumps([fresh, pending]),))
        yield pd.DataFrame(out, columns=["key", "consumer", "ms", "seq", "deliveries", "event"])

    return commands.groupBy("key").applyInPandasWithState(step, "key string, consumer string, ms long, seq long, deliveries long, event string", "held string", "append", "NoTimeout")
