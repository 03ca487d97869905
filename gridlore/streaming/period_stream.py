"""Periods over a stream: as ``timeline.periods`` finds them in a table, each as soon as it is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from gridlore.operators.rules import RULES, Thresholds, flag

PERIODS = "rule string, site_id string, start_time timestamp, end_time timestamp, readings long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateRows(StreamingQueryListener):
    """Counts the rows that came after the watermark had passed them, and were left out, by query."""

    def __init__(self):
        self.by_query: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.by_query.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.by_query[str(event.progress.id)] = self.by_query.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _Periods(StatefulProcessor):
    """By site and rule: readings that the watermark has not passed, and the period under way."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at timestamp, id long, holds boolean")
        self.open = handle.getValueState("open", "start_time timestamp, end_time timestamp, readings long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            self.waiting.appendList([(r.at.to_pydatetime(), int(r.id), bool(r.holds)) for r in pdf.itertuples()])
            low = int(pdf["at"].min().value // 1_000_000)
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [(pd.Timestamp(at), n, holds) for at, n, holds in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in rows if r[0].value // 1_000_000 <= now)
        left = [r for r in rows if r[0].value // 1_000_000 > now]
        period = self.open.get() if self.open.exists() else None
        period = [pd.Timestamp(period[0]), pd.Timestamp(period[1]), period[2]] if period is not None else None
        over = []
        for at, _, holds in ready:
            if period is not None and (not holds or self._ended(period, int(at.value // 1_000_000))):
                over.append(period)
                period = None
            if holds:
                period = [at, at, 1] if period is None else [period[0], at, period[2] + 1]
        if period is not None and self._ended(period, now):
            over.append(period)
            period = None
        if left:
            self.waiting.put([(r[0].to_pydatetime(), r[1], r[2]) for r in left])
            self.handle.registerTimer(int(min(left)[0].value // 1_000_000))
        else:
            self.waiting.clear()
        if period is not None:
            self.open.update((period[0].to_pydatetime(), period[1].to_pydatetime(), period[2]))
            self.handle.registerTimer(int(period[1].value // 1_000_000) + self.idle_ms)
        else:
            self.open.clear()
        if over:
            site, rule = key
            yield pd.DataFrame([(rule, site, *p) for p in over], columns=["rule", "site_id", "start_time", "end_time", "readings"])

    def _ended(self, period: list, now_ms: int) -> bool:
        return now_ms - int(period[1].value // 1_000_000) >= self.idle_ms

    def close(self) -> None:
        pass


def prepared_session(spark: SparkSession) -> SparkSession:
    """The session with the state store that this stream needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


def period_stream(readings: DataFrame, late: str = "2 hours", idle_ms: int = 86_400_000, rules: list[str] | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Contiguous periods of a site during which a rule holds, see ``PERIODS``, once they are over.

    A period is over when a reading of its site comes for which the rule does not hold, or when none has come for
    ``idle_ms`` of event time. Readings wait until the watermark, ``late`` behind the latest one, has passed them, so
    they may come in any order up to then; later ones are left out (``LateRows`` counts them). With no gap as long as
    ``idle_ms`` and nothing late the periods are those of ``timeline.periods``. State: the readings of ``late`` and one
    period, for each site and rule, which also deals a hot site by rule. Rows without a time are left out. The session
    must be a ``prepared_session``.
    """
    names = rules or list(RULES)
    holds = F.array(*(F.struct(F.lit(n).alias("rule"), flag(n, t).alias("holds")) for n in names))
    rows = readings.where(F.col("timestamp").isNotNull()).select(F.coalesce("site_id", F.lit("")).alias("site_id"), F.col("timestamp").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), F.explode(holds).alias("e"))
    rows = rows.select("site_id", "e.rule", "at", "id", "e.holds").withWatermark("at", late)
    return rows.groupBy("site_id", "rule").transformWithStateInPandas(_Periods(idle_ms), PERIODS, "Append", "EventTime")
