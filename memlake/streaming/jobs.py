"""Structured Streaming counterparts of the stateful operators.

Each function takes a streaming (or static) DataFrame and returns one; sinks and
triggers are the caller's. Late rows beyond the watermark are dropped, so streamed and
batch results agree on input that is in order within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import language as L
from memlake.operators import analytics as A
from memlake.operators import classify


def ingest(messages: DataFrame, text: str = "message") -> DataFrame:
    """Messages to typed records, noise left out."""
    return classify.classify(messages, text).where("noise is null and type is not null")


def dedup(df: DataFrame, ts: str, delay: str = "1 day", by: tuple[str, ...] = ("namespace", "type", "content")) -> DataFrame:
    """First row of each content hash within the watermark."""
    return df.withColumn("h", L.content_hash(*by)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["h"]).drop("h")


def tumbling_metrics(df: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, mean and largest value per window and group."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("window.start").alias("since"), by, "n", "mean", "most")


def sliding_rates(df: DataFrame, ts: str, by: str, size: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes", most: int = 20) -> DataFrame:
    w = df.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("since"), by, "n", (F.col("n") > most).alias("blocked"))


def sessions(df: DataFrame, ts: str, by: str, gap: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Access sessions: one counted access per gap (the throttle)."""
    w = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), by, "n")


def last_n(df: DataFrame, ts: str, by: str, key: str, text: str, n: int = 20, overlap: float = 0.4) -> DataFrame:
    """(by, new_key, old_key): of the last ``n`` rows of a group the newest whose words the new row opposes or updates.

    Marks, tokens and update words are columns computed in the JVM; the state of a group is
    its last ``n`` rows of these, so it is bounded by the number of groups. Groups should be
    many (namespace and type, not the type alone).
    """
    rows = df.select(F.col(by).alias("g"), F.col(ts).alias("at"), F.col(key).alias("k"), A.marks(text).alias("m"), L.space_tokens(text).alias("t"), A.is_update(text).alias("u"))

    def run(group: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held = [(k, set(m), set(t)) for k, m, t in zip(*state.get)] if state.exists else []
        new = pd.concat(list(batches)).sort_values(["at", "k"], kind="stable")
        out = []
        for k, m, t, u in new[["k", "m", "t", "u"]].itertuples(index=False):
            m, t = set(m), set(t)
            against = {("-" if x[0] == "+" else "+") + x[1:] for x in m}
            for k0, m0, t0 in reversed(held):
                if against & m0 or (u and t | t0 and len(t & t0) / len(t | t0) >= overlap):
                    out.append((group[0], k, k0))
                    break
            held = (held + [(k, m, t)])[-n:]
        state.update(([h[0] for h in held], [sorted(h[1]) for h in held], [sorted(h[2]) for h in held]))
        yield pd.DataFrame(out, columns=[by, "new_key", "old_key"])

    return rows.groupBy("g").applyInPandasWithState(run, f"{by} string, new_key string, old_key string", "ks array<string>, ms array<array<string>>, ts array<array<string>>", "append", GroupStateTimeout.NoTimeout)


def history(df: DataFrame, ts: str, by: str, key: str, n: int = 10) -> DataFrame:
    """(by, key, before): every row with the keys of up to ``n`` rows of its group before it, oldest first; state is these keys."""

    def run(group: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        held, out = list(state.get[0]) if state.exists else [], []
        for k in pd.concat(list(batches)).sort_values(["at", "k"], kind="stable")["k"]:
            out.append((group[0], k, list(held)))
            held = (held + [k])[-n:]
        state.update((held,))
        yield pd.DataFrame(out, columns=[by, key, "before"])

    rows = df.select(F.col(by).cast("string").alias("g"), F.col(ts).alias("at"), F.col(key).cast("string").alias("k"))
    return rows.groupBy("g").applyInPandasWithState(run, f"{by} string, {key} string, before array<string>", "ks array<string>", "append", GroupStateTimeout.NoTimeout)


def append_audit(df: DataFrame, path: str, checkpoint: str):
    """Writes audit rows as they come, partitioned by day; run it with an available-now trigger as a scheduled job."""
    return df.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
