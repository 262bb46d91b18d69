"""STM, CDC, UPS and HLT over streams. Each has a batch form with the same results on a replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_health(events: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Extension: runs and rows of each source by window of event time; later rows than late are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "source").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("source", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of a source that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "source").agg(F.count("*").alias("n")).select("source", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_wins(events: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """UPS-02, STM-03: the first row of each key, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(events: DataFrame, keys: list[str], version: str, target: Callable[[DataFrame, int], None], checkpoint: str):
    """UPS-01, UPS-04, UPS-05: the newest row of each key of every batch, given to target with the batch's number.

    target has to be idempotent by number; a batch may come twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        target(batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_x")).select(*keys, "_x.*"), number)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_status(runs: DataFrame) -> DataFrame:
    """HLT-05, STM-05: source, run_at, row_count, level of each run: FAIL for the third zero in a row, WARN for other zeros. State: zeros so far.

    Rows of a source in a batch are taken in order of run_at.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        zeros = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("run_at")
        levels = []
        for n in rows["row_count"]:
            zeros = zeros + 1 if n == 0 else 0
            levels.append("OK" if zeros == 0 else "FAIL" if zeros >= 3 else "WARN")
        state.update((zeros,))
        yield pd.DataFrame({"source": key[0], "run_at": rows["run_at"], "row_count": rows["row_count"], "level": levels})

    return runs.groupBy("source").applyInPandasWithState(step, "source string, run_at timestamp, row_count long, level string", "zeros int", "append", GroupStateTimeout.NoTimeout)


def change_stream(rows: DataFrame, jump: float = 12) -> DataFrame:
    """CDC-01, CDC-03, CDC-05: key, seq, change, old_score and n_amendments of each version (key, seq, score, content) against the one before."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old, content, amended = state.get if state.exists else (None, None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if content is None:
                change = "new"
            elif r.score - old >= jump:
                change = "upgraded"
            else:
                change = "content" if r.content != content else "same"
            amended += int(content not in (None, "") and r.content != content)
            out.append((key[0], r.seq, change, old, amended))
            old, content = float(r.score), r.content
        state.update((old, content, amended))
        yield pd.DataFrame(out, columns=["key", "seq", "change", "old_score", "n_amendments"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, change string, old_score double, n_amendments int", "old double, content string, amended int", "append", GroupStateTimeout.NoTimeout)


def admitted(times: list[float], recent: list[float], window: float, limit: int) -> tuple[list[bool], list[float]]:
    """Which requests pass a limit of so many within window seconds; rejected ones don't count against later ones."""
    out = []
    for t in times:
        recent = [x for x in recent if x > t - window]
        ok = len(recent) < limit
        out.append(ok)
        if ok:
            recent.append(t)
    return out, recent


def rate_limit(requests: DataFrame, seconds: float, limit: int, key: str = "client", at: str = "ts", id_col: str = "id") -> DataFrame:
    """STM-01, in batch: client, id, admitted. A client's requests are taken in order of time; null is a client too.

    Clients are sorted within partitions and read batch by batch, so a task holds the admitted times of one client and never all its requests.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), []
        for rows in frames:
            passed = []
            for client, t in zip(rows["client"].tolist(), rows["t"].tolist(), strict=True):
                client = None if pd.isna(client) else client
                if client != now:
                    now, recent = client, []
                ok, recent = admitted([t], recent, seconds, limit)
                passed += ok
            yield pd.DataFrame({"client": rows["client"], "id": rows["id"], "admitted": passed})

    own = requests.select(F.col(key).alias("client"), F.col(id_col).alias("id"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return own.repartition("client").sortWithinPartitions("client", "t", "id").mapInPandas(run, f"client {kind}, id long, admitted boolean")


def rate_limit_stream(requests: DataFrame, seconds: float, limit: int) -> DataFrame:
    """STM-01 over a stream of client, id, ts. State: the admitted times of the last window."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        ok, recent = admitted([x.timestamp() for x in rows["ts"]], recent, seconds, limit)
        state.update((recent,))
        yield pd.DataFrame({"client": key[0], "id": rows["id"], "admitted": ok})

    return requests.groupBy("client").applyInPandasWithState(step, "client string, id long, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
