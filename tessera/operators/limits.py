"""Rate limits over request logs, token-budget batches, checkpoint folders."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the instruction of a query that names none.
DEFAULT_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
MINUTE = 60_000_000


def micros(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing(events: DataFrame, *keys: str) -> DataFrame:
    """events with requests and tokens of the last minute, (now - 60 s, now].

    With keys, each key has its own log. A log is dealt to minutes, each minute with a copy of the
    one before it as context, and each is a window of its own: no task gets a whole log.
    """
    rows = events.withColumn("_us", micros("ts"))
    minute = F.floor(F.col("_us") / MINUTE)
    both = rows.withColumn("_m", F.explode(F.array(minute, minute + 1))).withColumn("_own", F.col("_m") == minute)
    w = Window.partitionBy("_m", *keys).orderBy("_us").rangeBetween(-(MINUTE - 1), 0)
    counted = both.withColumns({"requests": F.count(F.lit(1)).over(w), "tokens": F.sum("value").over(w)})
    return counted.where("_own").drop("_us", "_m", "_own")


def best_so_far(events: DataFrame, key: str, value: str = "value", least: float = -1.0) -> DataFrame:
    """events with is_best: whether `value` is over all of the key's earlier ones (by ts, event_id) and `least`.

    A key's log is dealt to hours: the greatest value of the hours before, a row an hour, and a window
    within the hour, so no task gets a whole log.
    """
    rows = events.withColumn("_hour", F.floor(micros("ts") / (60 * MINUTE)))
    tops = rows.groupBy(key, "_hour").agg(F.max(value).alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max(value).over(Window.partitionBy(key, "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_inside", inside).join(tops.select(key, "_hour", earlier.alias("_earlier")), [key, "_hour"])
    best = F.coalesce(F.greatest("_inside", "_earlier"), F.lit(least))
    return placed.withColumn("is_best", F.col(value) > best).drop("_hour", "_inside", "_earlier")


def daily(events: DataFrame, cap: int, offset: str = "+00:00", used: DataFrame | None = None) -> DataFrame:
    """events with their day and whether they are among its first `cap` (0: no limit).

    Days change at midnight of the clock that is `offset` from UTC. used (day, used) has what earlier
    runs took of a day's cap. A day is dealt to its minutes: ranks within a minute, plus the
    requests of the minutes before, so no task gets a whole day.
    """
    hours, minutes = (int(x) for x in offset.split(":"))
    shift = (abs(hours) * 60 + minutes) * MINUTE * (-1 if offset.startswith("-") else 1)
    rows = events.withColumn("day", F.floor((micros("ts") + shift) / 86_400_000_000)).withColumn("_minute", F.floor((micros("ts") + shift) / MINUTE))
    counts = rows.groupBy("day", "_minute").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("day", "_minute", F.coalesce(before, F.lit(0)).alias("_before"))  # 1,440 rows a day at most
    rank = F.row_number().over(Window.partitionBy("day", "_minute").orderBy("ts", "event_id"))
    placed = rows.withColumn("_rank", rank).join(starts, ["day", "_minute"])
    if used is not None:
        placed = placed.join(used, "day", "left").withColumn("_before", F.col("_before") + F.coalesce("used", F.lit(0))).drop("used")
    admitted = (F.col("_before") + F.col("_rank") <= cap) if cap else F.lit(True)
    return placed.withColumn("admitted", admitted).drop("_minute", "_rank", "_before")


def replay(events: DataFrame, rpm: int, tpm: float, key: str = "user_id") -> DataFrame:
    """(event_id, start_us, waited_us): when a limiter per key would let each request start.

    An admission moves all later ones, so a key's requests are replayed in order, with a queue of
    the last minute only.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "event_id"])
        recent: deque[tuple[int, float]] = deque()
        used, now, out = 0.0, 0, []
        for event, us, cost in zip(rows["event_id"], rows["us"], rows["value"].fillna(0.0), strict=True):
            now = max(now, us)
            while True:
                while recent and now - recent[0][0] >= MINUTE:
                    used -= recent.popleft()[1]
                if not recent or (len(recent) < rpm and used + cost <= tpm):
                    break
                now = recent[0][0] + MINUTE
            recent.append((now, cost))
            used += cost
            out.append((event, now, now - us))
        return pd.DataFrame(out, columns=["event_id", "start_us", "waited_us"])

    rows = events.select("event_id", F.col(key).alias("key"), micros("ts").alias("us"), "value")
    return rows.groupBy("key").applyInPandas(run, "event_id long, start_us long, waited_us long")


def micro_batches(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, grp, n_items): items (n, doc_id) of each key, a shard of bounded size, by rising n in greedy
    groups whose padded size, items times the longest, stays in the budget; an item over it is alone."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part.sort_values(["n", "doc_id"])["n"].to_numpy()
        out, size = [], 0
        for n in sizes:
            if size and (size + 1) * n > budget:
                out.append(size)
                size = 0
            size += 1
        if size:
            out.append(size)
        return pd.DataFrame({key: part[key].iloc[0], "grp": range(len(out)), "n_items": out})

    return rows.groupBy(key).applyInPandas(run, f"{key} long, grp long, n_items long")


def steps(paths: DataFrame, current: int) -> DataFrame:
    """(step, obsolete): the numeric top folders of file paths, and whether another step is current."""
    top = F.split("path", "/")[0]
    found = paths.where(F.contains("path", F.lit("/")) & top.rlike("^[0-9]+$")).select(top.cast("long").alias("step")).distinct()
    return found.withColumn("obsolete", F.col("step") != current)
