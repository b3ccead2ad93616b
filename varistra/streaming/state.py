"""Key state machines: a request goes from pending to processing to complete or failed, by conditional updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The states and what may follow what.
STATES = ("not_started", "pending", "processing", "complete", "failed")
MOVES = {"not_started": {"pending"}, "pending": {"processing"}, "processing": {"complete", "failed"}, "failed": {"pending"}, "complete": set()}


def step(state: str, asked: str) -> str:
    """The state after a request for another: only allowed moves count."""
    return asked if asked in MOVES.get(state, ()) else state


def final_states(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """T1 as a batch: (key, state, moves): each key's events folded in order."""
    folded = F.aggregate(
        F.col("es"),
        F.struct(F.lit("not_started").alias("s"), F.lit(0).alias("n")),
        lambda acc, e: F.when(allowed(acc["s"], e["state"]), F.struct(e["state"].alias("s"), (acc["n"] + 1).alias("n"))).otherwise(acc),
    )
    listed = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(state).alias("state")))).alias("es"))
    return listed.select(key, folded.alias("f")).select(key, F.col("f.s").alias("state"), F.col("f.n").alias("moves"))


def allowed(state, asked):
    out = F.lit(False)
    for a, bs in MOVES.items():
        if bs:
            out = out | ((state == a) & asked.isin(*sorted(bs)))
    return out


def stream_states(events: DataFrame, key: str, state: str):
    """T1 on a stream: the same machine with a state for each key; gives a key's new state whenever it moves."""

    def run(k, frames, held):
        import pandas as pd

        now, n = held.get if held.exists else ("not_started", 0)
        out = []
        for frame in frames:
            for asked in frame.sort_values(list(frame.columns))[state] if "ts" not in frame else frame.sort_values("ts")[state]:
                new = step(now, asked)
                if new != now:
                    now, n = new, n + 1
                    out.append((k[0], now, n))
        held.update((now, n))
        yield pd.DataFrame(out, columns=[key, "state", "moves"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, moves int", "state string, moves int", "append", "NoTimeout")


def timed_stream_states(events: DataFrame, key: str, state: str, ts: str, tie: str, stale_ms: int, late: str = "1 hour"):
    """T1 on a stream with a time-out: a key that is processing for more than stale_ms fails; gives (key, state, moves, at) at every move.

    Requests count in order of (ts, tie) whatever order they come in: they wait in the key's state until the watermark,
    ``late`` behind the newest, has passed them, and a timer wakes keys to which nothing comes. So the moves are those of
    the same events in one batch, up to the watermark; later requests than that are dropped by Spark. Times count in
    milliseconds, at is that of the request or of the failure. Rows with a null key are one key; those with a null time
    never pass the watermark and are left out, requests for null or unknown states change nothing."""
    import json

    def run(k, frames, held):
        import pandas as pd

        now, n, since, waiting = held.get if held.exists else ("not_started", 0, 0, "[]")
        waiting, out, limit = json.loads(waiting), [], held.getCurrentWatermarkMs() - 1
        for frame in frames:
            waiting += [[int(a) // 1000, int(a), int(b), c] for a, b, c in zip(*(frame[c].tolist() for c in ("at", "tie", "asked")))]

        def move(to, at):
            nonlocal now, n, since
            if to != now:
                now, n, since = to, n + 1, at
                out.append((k[0], now, n, at))

        def fail_stale(before):
            if now == "processing" and since + stale_ms < before:
                move("failed", since + stale_ms)

        for ms, _, _, asked in sorted((w for w in waiting if w[0] < limit), key=lambda w: w[1:3]):
            fail_stale(ms)
            move(step(now, asked), ms)
        fail_stale(limit)
        waiting = [w for w in waiting if w[0] >= limit]
        held.update((now, n, since, json.dumps(waiting)))
        wake = [w[0] for w in waiting] + [since + stale_ms] * (now == "processing")
        if wake:
            held.setTimeoutTimestamp(min(wake) + 1)  # fires once the watermark is past it
        if out:
            yield pd.DataFrame(dict(zip((key, "state", "moves", "at"), zip(*out))))

    kind = dict(events.dtypes)[key]
    asked = events.filter(F.col(ts).isNotNull()).withWatermark(ts, late)
    asked = asked.select(key, ts, F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(state).alias("asked"))
    return asked.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, moves int, at long", "state string, moves int, since long, waiting string", "append", "EventTimeTimeout")


def deduplicated(events: DataFrame, key: str, ts: str, within: str = "5 minutes") -> DataFrame:
    """A queue's messages, each dedup id once within the window."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def redelivered(attempts: DataFrame, key: str, ok: str, order: list[str], most: int = 3) -> DataFrame:
    """(key, tries, fate): a message is done at its first success, dead after ``most`` failures, else open."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    s = attempts.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy(key).agg(F.min(F.when(F.col(ok), F.col("nth"))).alias("won"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.coalesce("won", "n").cast("int").alias("tries"), F.when(F.col("won").isNotNull(), "done").when(F.col("n") >= most, "dead").otherwise("open").alias("fate"))
