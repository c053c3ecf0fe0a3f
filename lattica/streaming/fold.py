"""Stateful intake of descending event ids: caps a user, early stop, attrition; as a batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattica.operators.select import top_per_group

OUT = "key string, event_id long, user_id long, state string"
STATE = "body string"


def accepted(events: DataFrame, key: str, user: str, order: str, per_user: int = 2, users: int = 20) -> DataFrame:
    """Events taken in descending order: repeated ids once, at most per_user of a (key, user), and none after the key's `users`-th user has come. Ranks are taken a (key, user) first, so a hot key is cut down before it is gathered."""
    once = events.dropDuplicates([key, order])
    capped = top_per_group(once, [key, user], [F.desc(order)], per_user)
    firsts = capped.groupBy(key, user).agg(F.max(order).alias("first"))
    last = top_per_group(firsts, [key], [F.desc("first")], users).groupBy(key).agg(F.min("first").alias("cut"), F.count("*").alias("came"))
    return capped.join(last, key).filter((F.col("came") < users) | (F.col(order) >= F.col("cut"))).drop("cut", "came")


def attrition(events: DataFrame, key: str, user: str, order: str, per_user: int = 2, users: int = 20) -> DataFrame:
    """key, state, events: what becomes of every event of accepted(): stopped (behind the `users`-th user's first event, not looked at), duplicate (an id seen before), capped, or accepted. Ranks go by (key, id) and (key, user); a key's own facts are one row."""
    once = events.groupBy(key, user, order).agg(F.count("*").alias("times"))
    firsts = once.groupBy(key, user).agg(F.max(order).alias("first"))
    cut = top_per_group(firsts, [key], [F.desc("first")], users).groupBy(key).agg(F.min("first").alias("cut"), F.count("*").alias("came"))
    rank = F.row_number().over(Window.partitionBy(key, user).orderBy(F.desc(order)))
    told = once.withColumn("rank", rank).join(cut, key)
    stopped = (F.col("came") >= users) & (F.col(order) < F.col("cut"))
    first = F.when(stopped, "stopped").when(F.col("rank") > per_user, "capped").otherwise("accepted")
    again = F.when(stopped, "stopped").otherwise("duplicate")
    each = F.explode(F.array(F.struct(first.alias("state"), F.lit(1).cast("long").alias("n")), F.struct(again.alias("state"), (F.col("times") - 1).alias("n"))))
    return told.select(key, each.alias("s")).groupBy(key, F.col("s.state").alias("state")).agg(F.sum("s.n").alias("events")).filter("events > 0")


def stop_reason(events: DataFrame, key: str, user: str, order: str, users: int = 20, budget: int | None = None) -> DataFrame:
    """key, users, pages' rows and why intake stopped."""
    g = events.groupBy(key).agg(F.count_distinct(user).alias("users"), F.count("*").alias("rows"))
    cut = F.col("rows") >= budget if budget else F.lit(False)
    return g.withColumn("reason", F.when(F.col("users") >= users, "TARGET_REACHED").when(cut, "SEARCH_BUDGET_TRUNCATED").otherwise("SOURCE_EXHAUSTED"))


def page_faults(pages: DataFrame, key: str, page: str, place: str, order: str) -> DataFrame:
    """Rows whose id does not fall from row to row within the pages of a key."""
    w = Window.partitionBy(key).orderBy(page, place)
    return pages.withColumn("before", F.lag(order).over(w)).filter(F.col("before") <= F.col(order)).select(key, page, place, order, "before")


def accept_stream(events: DataFrame, per_user: int = 2, users: int = 20) -> DataFrame:
    """The streaming form: events (key, event_id, user_id) with a state a key: ids below which all was seen, events a user, whether it has stopped. Every event comes out with accepted, duplicate, capped or stopped."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        body = json.loads(state.get[0]) if state.exists else {"low": None, "users": {}}
        for f in frames:
            out = []
            for i, u in f.sort_values("event_id", ascending=False)[["event_id", "user_id"]].itertuples(index=False):
                name = str(u)
                if body["low"] is not None and i >= body["low"]:
                    out.append((key[0], i, u, "duplicate"))
                    continue
                body["low"] = int(i)
                if len(body["users"]) >= users:
                    out.append((key[0], i, u, "stopped"))
                elif body["users"].get(name, 0) >= per_user:
                    out.append((key[0], i, u, "capped"))
                else:
                    body["users"][name] = body["users"].get(name, 0) + 1
                    out.append((key[0], i, u, "accepted"))
            yield pd.DataFrame(out, columns=["key", "event_id", "user_id", "state"])
        state.update((json.dumps(body),))

    return events.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a time window and key; in a stream late rows beyond the watermark fall out and state is bounded by it."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "events", "total")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """One event a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
