"""The life of opportunities as a stream: detections and dismissals in, changes of state out, with timers for what is seen no more."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400_000
#: kind: detected (run_id, score), reviewed, or dismissed (user_id, reason).
EVENTS = "at timestamp, page_id long, type string, kind string, run_id string, score double, user_id string, reason string"
CHANGES = "page_id long, type string, id string, status string, score double, run_id string, at timestamp, dismissed_by string, reason string, action string"
#: Of pages whose lives are held together, in columns: each page's id, then what Life.held() gives.
_STATE = "page_ids array<long>, ids array<string>, statuses array<string>, scores array<double>, run_ids array<string>, seen array<long>, barred array<long>"
#: Neighbouring page ids of one row of state: a call of Python costs far more than the events of one page, and a row stays small
#: however many pages there are.
PAGES_TOGETHER = 256
OPEN = ("DETECTED", "REVIEWED")


class Life:
    """One page and type: its newest opportunity, and until when a user's dismissal bars new ones."""

    def __init__(self, page_id: int, type_: str, held: tuple | None, period: int, snooze: int):
        self.key, self.period, self.snooze = (page_id, type_), period, snooze
        self.id, self.status, self.score, self.run_id, self.seen, self.barred = held or (None, None, None, None, -1, -1)
        self.changes: list[tuple] = []

    def held(self) -> tuple:
        return self.id, self.status, self.score, self.run_id, self.seen, self.barred

    def due(self) -> int | None:
        """The time after which it counts as seen no more, if nothing comes before."""
        return self.seen + self.period if self.status == "DETECTED" else None

    def until(self, now: int) -> None:
        """What happens before now by itself: a detected opportunity that the next run didn't see is cleared."""
        due = self.due()
        if due is not None and due < now:
            self.status = "DISMISSED"
            self._changed("cleared", due, reason="SIGNAL_CLEARED")

    def event(self, at: int, kind: str, run_id, score, user_id, reason) -> None:
        self.until(at)
        if kind == "detected":
            if self.status in OPEN:
                self.score, self.run_id, self.seen = score, run_id, at
                self._changed("updated", at)
            elif at > self.barred:
                self.id = hashlib.sha256(f"{self.key[0]}|{self.key[1]}|{run_id}".encode()).hexdigest()
                self.status, self.score, self.run_id, self.seen = "DETECTED", score, run_id, at
                self._changed("created", at)
        elif kind == "reviewed" and self.status == "DETECTED":
            self.status = "REVIEWED"
            self._changed("reviewed", at)
        elif kind == "dismissed" and self.status in OPEN:
            self.status = "DISMISSED"
            if user_id is not None:
                self.barred = at + self.snooze
            self._changed("dismissed", at, user_id, reason)

    def _changed(self, action: str, at: int, by=None, reason=None) -> None:
        self.changes.append((*self.key, self.id, self.status, self.score, self.run_id, pd.Timestamp(at, unit="ms"), by, reason, action))


_NAMES = [x.split()[0] for x in CHANGES.split(", ")]


def rows_of(frame: pd.DataFrame) -> Iterator[tuple]:
    """The events of a frame as time in milliseconds, kind, run, score, user and reason, missing values as None. Most keys have
    a few events each, so that work by columns would cost more than the events."""
    cells = [frame["at"].to_numpy("datetime64[ms]").astype("int64").tolist()]
    for name in ("kind", "run_id", "score", "user_id", "reason"):
        cells.append([None if x is None or x != x else x for x in frame[name].tolist()])
    return zip(*cells, strict=True)


def changes(events: DataFrame, period_days: float = 1, snooze_days: float = 28, delay: str = "0 seconds") -> DataFrame:
    """Changes (see CHANGES) of a stream of events (see EVENTS), in order for each page and type.

    A detection refreshes an open opportunity or makes a new one, unless a user dismissed the last within snooze_days; one that
    is still DETECTED and not seen again within period_days is cleared, by a timer of event time. Events of a batch are taken in
    order of time; those older than the watermark (delay) are dropped, as they could change what was already told. The state of
    PAGES_TOGETHER pages of one type is one row. With null keys or times an event counts for nothing."""
    period, snooze = round(period_days * DAY), round(snooze_days * DAY)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = zip(*state.get, strict=True) if state.exists else ()
        lives = {page: Life(page, key[1], tuple(rest), period, snooze) for page, *rest in held}
        if not state.hasTimedOut:
            rows = defaultdict(list)
            for frame in frames:
                for page, row in zip(frame["page_id"].tolist(), rows_of(frame), strict=True):
                    rows[page].append(row)
            for page, own in rows.items():
                life = lives.get(page) or lives.setdefault(page, Life(page, key[1], None, period, snooze))
                for r in sorted(own, key=lambda r: (r[0], *((x is None, x or "") for x in (r[1], r[2], r[4])))):
                    life.event(*r)
        now = state.getCurrentWatermarkMs()
        for life in lives.values():  # a page's timer may be due while its neighbours have events
            life.until(now)
        kept = [(page, *life.held()) for page, life in lives.items() if life.id is not None]
        state.update(tuple(map(list, zip(*kept, strict=True))) if kept else ([],) * 7)
        due = [x for life in lives.values() if (x := life.due()) is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due), now + 1))
        told = [x for life in lives.values() for x in life.changes]
        if told:
            yield pd.DataFrame(dict(zip(_NAMES, zip(*told, strict=True), strict=True)))

    whole = events.where("at is not null and page_id is not null and type is not null").withWatermark("at", delay)
    together = whole.withColumn("pages", F.expr(f"page_id div {PAGES_TOGETHER}")).groupBy("pages", "type")
    return together.applyInPandasWithState(fold, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_changes(events: DataFrame, path: str, checkpoint: str, **settings) -> None:
    """Appends the changes of all events that have come since the last run to the table at path, each once."""
    stream = changes(events, **settings).writeStream.format("parquet").outputMode("append")
    stream.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def closed(changes_: DataFrame, now, period_days: float = 1) -> DataFrame:
    """changes with those that timers make before now, where the watermark hasn't come so far yet."""
    newest = changes_.groupBy("page_id", "type").agg(F.max_by(F.struct(*[c for c in changes_.columns if c not in ("page_id", "type")]), "at").alias("x")).select("page_id", "type", "x.*")
    seen = changes_.where(F.col("action").isin("created", "updated")).groupBy("page_id", "type").agg(F.max("at").alias("_seen"))
    due = F.col("_seen") + F.make_dt_interval(secs=F.lit(period_days * 86_400))
    gone = newest.where("status = 'DETECTED'").join(seen, ["page_id", "type"]).where(due < F.lit(now).cast("timestamp"))
    late = gone.withColumns({"at": due, "status": F.lit("DISMISSED"), "reason": F.lit("SIGNAL_CLEARED"), "dismissed_by": F.lit(None).cast("string"), "action": F.lit("cleared")}).drop("_seen")
    return changes_.unionByName(late)


def current(changes_: DataFrame) -> DataFrame:
    """The newest state of each page and type, with how often it was created, cleared and dismissed."""
    counts = [F.count_if(F.col("action") == a).alias(n) for a, n in (("created", "n_created"), ("cleared", "n_cleared"), ("dismissed", "n_dismissed"))]
    newest = F.max_by(F.struct("id", "status", "score", "run_id", "at"), "at").alias("x")
    return changes_.groupBy("page_id", "type").agg(newest, *counts).select("page_id", "type", "x.*", "n_created", "n_cleared", "n_dismissed")
