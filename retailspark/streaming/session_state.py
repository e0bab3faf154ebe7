"""Per-user session state from interaction events, as a batch job and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from retailspark.plans.staging import staged
from retailspark.session import use_keyed_state

RECENT_CLICKS = 20
SHOWN_CLICKS = 10
STATE_DAYS = 7
STATE_MILLIS = STATE_DAYS * 24 * 3600 * 1000
CLICK_TYPES = ("click", "purchase")
EVENT_SCHEMA = "user_id string, item_id string, event_type string, category string, arrival timestamp, event_id long"


def _runs(days: DataFrame) -> DataFrame:
    """Days of a user's current run: nothing before a pause of seven days or more counts."""
    user = Window.partitionBy("user_id").orderBy("day")
    pause = F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(user))
    restarts = F.coalesce(pause >= STATE_MILLIS * 1000, F.lit(False))
    run = F.sum(restarts.cast("int")).over(user)
    marked = days.withColumn("run", run)
    whole = Window.partitionBy("user_id")
    return marked.withColumn("last_run", F.max("run").over(whole)).withColumn(
        "last_write", F.max("last_at").over(whole)
    ).where("run = last_run")


def _alive(last_write: str, as_of: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(F.col(last_write)) < STATE_MILLIS * 1000


def session_state_batch(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Last 20 clicks newest first, events per category, and click count, from history.

    Click list and category counts end with a pause of seven days; the click count never does.
    """
    dated = events.withColumn("day", F.to_date("arrival")).withColumn("arrival", F.col("arrival").cast("timestamp"))
    is_click, is_named = F.col("event_type").isin(*CLICK_TYPES), F.col("category") != ""

    def span(kept: Column) -> list[Column]:
        at = F.when(kept, F.col("arrival"))
        return [F.min(at), F.max(at)]

    click_span, named_span = span(is_click), span(is_named)
    # One row per user, day and category; all but the click lists comes from here.
    cells = staged(
        dated.groupBy("user_id", "day", "category").agg(
            F.max("arrival").alias("newest"), F.count_if(is_click).alias("clicks"), F.count_if(is_named).alias("n"),
            click_span[0].alias("click_first"), click_span[1].alias("click_last"),
            named_span[0].alias("named_first"), named_span[1].alias("named_last"),
        ),
        "session-cells",
    )
    as_of = (cells.agg(F.max("newest").alias("as_of")).scalar() if as_of is None else as_of).cast("timestamp")

    def live_days(name: str) -> DataFrame:
        days = cells.where(F.col(f"{name}_first").isNotNull()).groupBy("user_id", "day").agg(
            F.min(f"{name}_first").alias("first_at"), F.max(f"{name}_last").alias("last_at")
        )
        return _runs(days).where(_alive("last_write", as_of)).select("user_id", "day")

    newest = Window.partitionBy("user_id").orderBy(F.desc("arrival"), F.desc("event_id"))
    recent = (
        dated.where(is_click).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= RECENT_CLICKS)
        .join(live_days("click"), ["user_id", "day"])
        .groupBy("user_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda s: s.item_id).alias("recent_clicks")
        )
    )
    interest = (
        cells.where("n > 0").join(live_days("named"), ["user_id", "day"]).groupBy("user_id", "category").agg(F.sum("n").alias("n"))
        .groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("session_interest"))
    )
    users = cells.groupBy("user_id").agg(F.sum("clicks").alias("click_count"))
    return users.join(recent, "user_id", "left").join(interest, "user_id", "left").select(
        "user_id",
        F.coalesce("recent_clicks", F.array().cast("array<string>")).alias("recent_clicks"),
        F.coalesce("session_interest", F.create_map().cast("map<string,bigint>")).alias("session_interest"),
        "click_count",
    )


def user_features_view(users: DataFrame, state: DataFrame, n: int = SHOWN_CLICKS) -> DataFrame:
    """First n clicks, interests and count; empty values for users without state."""
    return users.select("user_id").join(state, "user_id", "left").select(
        "user_id",
        F.slice(F.coalesce("recent_clicks", F.array().cast("array<string>")), 1, n).alias("recent_clicks"),
        F.coalesce("session_interest", F.create_map().cast("map<string,bigint>")).alias("session_interest"),
        F.coalesce("click_count", F.lit(0)).alias("click_count"),
    )


def read_lines(spark: SparkSession, folder: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of text lines from a folder."""
    reader = spark.readStream.format("text")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def read_events(spark: SparkSession, folder: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream of JSON events, one object per line, from a folder."""
    return parse_events(read_lines(spark, folder, glob, max_files))


REQUIRED_TEXT, OPTIONAL_TEXT = ("user_id", "item_id", "event_type"), ("category",)


def judge_events(raw: DataFrame) -> DataFrame:
    """Every line of a text column ``value`` with its event, or with the reason why it is none.

    An event is a JSON object; user, item and type must be text, a category may be missing, the arrival must be a time.
    """
    parsed = raw.select(F.col("value").cast("string").alias("value")).withColumn("v", F.try_parse_json("value"))

    def kind(name: str) -> Column:
        """Type of a field: VOID for a null, NULL where there is none."""
        return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))

    reasons = F.when(F.col("v").isNull(), "not json").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
    for name in REQUIRED_TEXT:
        reasons = reasons.when(F.coalesce(kind(name), F.lit("VOID")) == "VOID", f"missing {name}").when(
            kind(name) != "STRING", f"{name} is not text"
        )
    for name in OPTIONAL_TEXT:
        reasons = reasons.when(~F.coalesce(kind(name), F.lit("VOID")).isin("VOID", "STRING"), f"{name} is not text")
    event = F.from_json("value", EVENT_SCHEMA)
    judged = parsed.withColumn("reason", reasons).select("value", "reason", F.when(F.col("reason").isNull(), event).alias("event"))
    no_time = F.col("reason").isNull() & F.col("event.arrival").isNull()
    return judged.withColumn("reason", F.when(no_time, "arrival is no time").otherwise(F.col("reason")))


def parse_events(raw: DataFrame) -> DataFrame:
    """Events from a text column ``value``, as from files or a message queue; lines that are none are left out."""
    return judge_events(raw).where("reason IS NULL").select("event.*")


def run_event_routing(raw: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream of lines to two tables by one pass over each micro-batch: events, and rejected lines with reasons."""
    judged = judge_events(raw).select(
        "event.*", F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"), "reason",
        F.when(F.col("reason").isNull(), "events").otherwise("rejected").alias("kind"),
    )
    run_to_table(judged, path, checkpoint, "append", by="kind")


def routed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the two tables, as far as it is written."""
    fields = f"{EVENT_SCHEMA}, line string, reason string, batch_id bigint, batch int, kind string"
    rows = spark.read.schema(fields).option("basePath", path).parquet(path).where(F.col("kind") == kind)
    return rows.select(*(["line", "reason"] if kind == "rejected" else [f.split()[0] for f in EVENT_SCHEMA.split(", ")]))


class Span:
    """A user's events without a pause of a lifetime: first and last time in microseconds, newest clicks, counts per category."""

    def __init__(self, first: int, last: int, clicks: list | None = None, counts: dict | None = None):
        self.first, self.last, self.clicks, self.counts = first, last, clicks or [], counts or {}

    def join(self, other: "Span") -> "Span":
        counts = dict(self.counts)
        for name, n in other.counts.items():
            counts[name] = counts.get(name, 0) + n
        clicks = sorted(self.clicks + other.clicks, key=lambda c: c[:2], reverse=True)[:RECENT_CLICKS]
        return Span(min(self.first, other.first), max(self.last, other.last), clicks, counts)


def joined_spans(spans: list[Span], lifetime: int) -> list[Span]:
    """Spans in the order of time, no two of them closer than a lifetime."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s.first, s.last)):
        if out and span.first - out[-1].last < lifetime:
            out[-1] = out[-1].join(span)
        else:
            out.append(span)
    return out


def spans_of(rows: pd.DataFrame, lifetime: int) -> list[Span]:
    """Spans of some rows of one user."""
    rows = rows.sort_values(["at", "event_id"])
    cuts = (rows["at"].diff() >= lifetime).cumsum()
    out = []
    for _, part in rows.groupby(cuts):
        newest = part.iloc[-RECENT_CLICKS:][::-1]
        clicks = [(int(a), int(e), i) for a, e, i in zip(newest["at"], newest["event_id"], newest["item_id"])]
        counts = {str(name): int(n) for name, n in part["category"].value_counts().items()}
        out.append(Span(int(part["at"].iloc[0]), int(part["at"].iloc[-1]), clicks, counts))
    return out


class SessionProcessor(StatefulProcessor):
    """Keeps the newest clicks, the category counts and the click count of one user.

    Clicks and category counts live until a lifetime after their last event, by the events' own time: a timer clears
    them when the watermark gets there, and a later event that arrives in the same micro-batch does so too. Rows of a micro-batch
    come in any order and in bounded parts; only spans without a pause are kept of them.
    """

    def __init__(self, lifetime_micros: int = STATE_MILLIS * 1000) -> None:
        self.lifetime = lifetime_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks = handle.getListState("recent_clicks", "at long, event_id long, item_id string")
        self.interest = handle.getMapState("session_interest", "category string", "n long")
        self.count = handle.getValueState("click_count", "n long")
        self.times = {
            name: handle.getValueState(f"{name}_time", "first long, last long") for name in ("clicks", "interest")
        }

    def ends_at(self, last: int) -> int:
        """Millisecond at which an entry is over."""
        return -(-(last + self.lifetime) // 1000)

    def held(self, name: str) -> list[Span]:
        """What the state holds, as a span; nothing if it is empty."""
        times = self.times[name].get()
        if times is None:
            return []
        clicks = [tuple(c) for c in self.clicks.get()] if name == "clicks" else []
        counts = {k[0]: v[0] for k, v in self.interest.iterator()} if name == "interest" else {}
        return [Span(times[0], times[1], clicks, counts)]

    def hold(self, name: str, before: list[Span], now: Span) -> None:
        """Put the newest span into the state and set its timer."""
        if name == "clicks":
            self.clicks.put(now.clicks)
        else:
            for category in set(before[0].counts if before else ()) - set(now.counts):
                self.interest.removeKey((category,))
            for category, n in now.counts.items():
                self.interest.updateValue((category,), (n,))
        self.times[name].update((now.first, now.last))
        self.handle.registerTimer(self.ends_at(now.last))

    def drop(self, name: str) -> None:
        (self.clicks if name == "clicks" else self.interest).clear()
        self.times[name].clear()

    def shown(self, key: tuple, order: int) -> pd.DataFrame:
        total = self.count.get()
        interest = {k[0]: v[0] for k, v in self.interest.iterator()} if self.times["interest"].exists() else {}
        clicks = sorted((tuple(c) for c in self.clicks.get()), reverse=True) if self.times["clicks"].exists() else []
        return pd.DataFrame({
            "user_id": [key[0]], "recent_clicks": [[c[2] for c in clicks]], "categories": [list(interest)],
            "counts": [list(interest.values())], "click_count": [total[0] if total is not None else 0], "written_at": [order],
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str, list[Span]] = {"clicks": [], "interest": []}
        pushed = 0
        for batch in rows:
            clicked = batch[batch["event_type"].isin(CLICK_TYPES)]
            named = batch[batch["category"].fillna("") != ""]
            pushed += len(clicked)
            for name, part in (("clicks", clicked), ("interest", named)):
                if len(part):
                    found[name] = joined_spans(found[name] + spans_of(part, self.lifetime), self.lifetime)
        if pushed:
            total = self.count.get()
            self.count.update(((total[0] if total is not None else 0) + pushed,))
        for name, spans in found.items():
            if spans:
                before = self.held(name)
                self.hold(name, before, joined_spans(before + spans, self.lifetime)[-1])
        yield self.shown(key, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, over = expiredTimerInfo.getExpiryTimeInMs(), False
        for name, times in self.times.items():
            held = times.get()
            # Newer events have set a later timer; this one is then without effect.
            if held is not None and self.ends_at(held[1]) <= now:
                self.drop(name)
                over = True
        if over:
            yield self.shown(key, now)

    def close(self) -> None:
        pass


def session_state(events: DataFrame, lifetime_millis: int = STATE_MILLIS, delay: str = "0 seconds") -> DataFrame:
    """Streaming form of the session state: a row per user and micro-batch with events, and one when an entry has ended.

    Events that come more than ``delay`` after newer ones of earlier micro-batches are dropped; the stream's progress counts them.
    """
    use_keyed_state(events.sparkSession)
    timed = events.withColumn("arrival", F.col("arrival").cast("timestamp")).withWatermark("arrival", delay)
    keyed = timed.select("user_id", "item_id", "event_type", "category", "arrival", F.unix_micros("arrival").alias("at"), "event_id")
    out = keyed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(lifetime_millis * 1000),
        outputStructType="user_id string, recent_clicks array<string>, categories array<string>, counts array<long>, "
                         "click_count long, written_at long",
        outputMode="Update",
        timeMode="EventTime",
    )
    return out.select(
        "user_id", "recent_clicks", F.map_from_arrays("categories", "counts").alias("session_interest"), "click_count", "written_at"
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished query dropped because they came behind its watermark."""
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", by: str | None = None) -> StreamingQuery:
    """Process everything that is there and append each micro-batch, tagged with its number.

    A batch that is replayed after a failure overwrites its own folder. ``by`` names a column to cut the output by.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        (tagged.partitionBy(by) if by else tagged).parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return query


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest state row of every user from the batches written so far."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy("user_id").agg(
        F.max_by(F.struct("recent_clicks", "session_interest", "click_count"), F.struct("batch_id", "written_at")).alias("s")
    ).select("user_id", "s.*")
