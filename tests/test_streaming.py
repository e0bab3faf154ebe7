import datetime as dt
import json
import os

from pyspark.sql import functions as F

from retailspark.sources import shop
from retailspark.streaming import monitor, session_state

FOLDER = "/root/testdata/sf0.001"


def write_lines(rows, folder, name):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)


def events_of(spark):
    rows = shop.interaction_events(spark, FOLDER).orderBy("arrival", "event_id").collect()
    return [
        {"user_id": r.user_id, "item_id": r.item_id, "event_type": r.event_type, "category": r.category,
         "arrival": r.arrival.isoformat(), "event_id": r.event_id} for r in rows
    ]


def as_dict(df):
    return {r.user_id: (list(r.recent_clicks), dict(r.session_interest), r.click_count) for r in df.collect()}


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rows = events_of(spark)
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    third = len(rows) // 3
    for number, part in enumerate((rows[:third], rows[third:2 * third], rows[2 * third:])):
        write_lines(part, source, f"part{number}.json")
        # Every call is a restart from the checkpoint.
        session_state.run_to_table(session_state.session_state(session_state.read_events(spark, source)), out, progress)
    got = as_dict(session_state.latest_state(spark, out))
    assert got == as_dict(session_state.session_state_batch(shop.interaction_events(spark, FOLDER)))


def run_weeks(spark, tmp_path, weeks, **options):
    """One restart per list of events; the last query that ran."""
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for number, rows in enumerate(weeks):
        write_lines(rows, source, f"{number}.json")
        events = session_state.read_events(spark, source)
        query = session_state.run_to_table(session_state.session_state(events, **options), out, progress)
    return out, query


def event(user, item, day, number, kind="click", category="c"):
    return {"user_id": user, "item_id": item, "event_type": kind, "category": category, "arrival": f"2024-{day}", "event_id": number}


def test_state_expires_by_event_time(spark, tmp_path):
    """A week without events clears lists and counts, by a timer or by the next event; the click count stays."""
    weeks = [
        [event("u", "a", "01-01T00:00:00", 1), event("v", "x", "01-02T00:00:00", 2), event("w", "n", "01-01T00:00:00", 3, "view")],
        [event("v", "y", "01-07T00:00:00", 4), event("u", "b", "01-08T00:00:00", 5, "view", "d")],  # u: the click is a week old, the view counts
        [event("v", "z", "01-15T00:00:00", 6)],
    ]
    out, _ = run_weeks(spark, tmp_path, weeks)
    got = as_dict(session_state.latest_state(spark, out))
    assert got == {"u": ([], {}, 1), "v": (["z"], {"c": 1}, 3), "w": ([], {}, 0)}


def test_pauses_inside_one_batch(spark, tmp_path):
    """Rows of one micro-batch in any order: only what follows the last pause stays."""
    rows = [event("u", f"i{d}", f"01-{d:02d}T00:00:00", d) for d in (20, 3, 1, 28, 27, 12, 5)]
    out, _ = run_weeks(spark, tmp_path, [rows])
    # 1, 3, 5 | 12 | 20 | 27, 28: seven days are a pause.
    assert as_dict(session_state.latest_state(spark, out)) == {"u": (["i28", "i27"], {"c": 2}, 7)}


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    weeks = [[event("u", "a", "01-10T00:00:00", 1)], [event("u", "old", "01-01T00:00:00", 2), event("u", "b", "01-11T00:00:00", 3)]]
    out, query = run_weeks(spark, tmp_path, weeks)
    assert as_dict(session_state.latest_state(spark, out)) == {"u": (["b", "a"], {"c": 2}, 2)}
    assert session_state.late_rows(query) == 1
    other, query = run_weeks(spark, tmp_path / "patient", weeks, delay="30 days")
    assert as_dict(session_state.latest_state(spark, other))["u"][2] == 3 and session_state.late_rows(query) == 0


def test_spans_join_in_any_order():
    import random

    draw = random.Random(1)
    for _ in range(50):
        times = sorted(draw.sample(range(200), draw.randint(1, 12)))
        spans = [session_state.Span(t, t, [(t, t, str(t))], {"c": 1}) for t in times]
        want = []
        for t in times:
            if want and t - want[-1][-1] < 10:
                want[-1].append(t)
            else:
                want.append([t])
        draw.shuffle(spans)
        found = []
        for span in spans:
            found = session_state.joined_spans([*found, span], 10)
        assert [(s.first, s.last, s.counts["c"]) for s in found] == [(w[0], w[-1], len(w)) for w in want]
        assert [[c[0] for c in s.clicks] for s in found] == [w[::-1][:session_state.RECENT_CLICKS] for w in want]


LINES = {
    '{"user_id": "u", "item_id": "i", "event_type": "click", "category": "c", "arrival": "2024-01-01T00:00:00", "event_id": 1}': None,
    '{"user_id": "", "item_id": "i", "event_type": "click", "arrival": "2024-01-01T00:00:00"}': None,
    '{"user_id": "u", "item_id": "i", "event_type": "click", "category": null, "arrival": "2024-01-01T00:00:00", "extra": 1}': None,
    '{"user_id": "u", "item_id": "i", ': "not json",
    "": "not json",
    "[1, 2]": "not an object",
    "7": "not an object",
    '{"item_id": "i", "event_type": "click"}': "missing user_id",
    '{"user_id": null, "item_id": "i", "event_type": "click"}': "missing user_id",
    '{"user_id": 5, "item_id": "i", "event_type": "click"}': "user_id is not text",
    '{"user_id": "u", "event_type": "click"}': "missing item_id",
    '{"user_id": "u", "item_id": "i"}': "missing event_type",
    '{"user_id": "u", "item_id": "i", "event_type": ["click"]}': "event_type is not text",
    '{"user_id": "u", "item_id": "i", "event_type": "click", "category": 3}': "category is not text",
    '{"user_id": "u", "item_id": "i", "event_type": "click", "arrival": "soon"}': "arrival is no time",
    '{"user_id": "u", "item_id": "i", "event_type": "click"}': "arrival is no time",
}


def test_lines_are_judged(spark):
    frame = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r.value: (r.reason, r.event) for r in session_state.judge_events(frame).collect()}
    assert {v: reason for v, (reason, _) in got.items()} == LINES
    assert session_state.parse_events(frame).count() == sum(r is None for r in LINES.values())


def test_routing_writes_both_tables(spark, tmp_path):
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    os.makedirs(source)
    for number, part in enumerate((list(LINES)[:7], list(LINES)[7:])):
        with open(f"{source}/{number}.txt", "w") as f:
            f.writelines(x + "\n" for x in part)
        session_state.run_event_routing(session_state.read_lines(spark, source), out, progress)
    bad = {r.line: r.reason for r in session_state.routed(spark, out, "rejected").collect()}
    assert bad == {v: r for v, r in LINES.items() if r}
    assert sorted(r.event_id or 0 for r in session_state.routed(spark, out, "events").collect()) == [0, 0, 1]


def test_batch_state_restarts_after_a_week(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("u", "a", "click", "c", day, 1), ("u", "b", "purchase", None, day + dt.timedelta(days=8), 2),
            ("v", "x", "view", "", day + dt.timedelta(days=8), 3)]
    events = spark.createDataFrame(rows, session_state.EVENT_SCHEMA)
    state = session_state.session_state_batch(events)
    assert as_dict(state) == {"u": (["b"], {}, 2), "v": ([], {}, 0)}
    later = session_state.session_state_batch(events, F.lit(day + dt.timedelta(days=30)))
    assert as_dict(later)["u"] == ([], {}, 2)
    users = spark.createDataFrame([("nobody",)], "user_id string")
    assert as_dict(session_state.user_features_view(users, state)) == {"nobody": ([], {}, 0)}


def test_retrain_signals(spark, tmp_path):
    counts = spark.createDataFrame([("1", 600), ("2", 500), ("3", 900), ("4", 200)], "check_at string, events long")
    assert [(r.check_at, r.new_events, r.new_version) for r in monitor.retrain_trigger(counts, 1000).orderBy("check_at").collect()] == [
        ("2", 1100, "v2"), ("4", 1100, "v3")
    ]
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for number, n in enumerate((6, 5, 9, 2)):
        write_lines([event("u", "a", "01-01T00:00:00", 1, "view", None)] * n, source, f"{number}.json")
        session_state.run_to_table(monitor.retrain_watch(session_state.read_events(spark, source), 10), out, progress)
    got = spark.read.parquet(f"{out}/batch=*").orderBy("event_count").collect()
    assert [(r.new_events, r.event_count, r.old_version, r.new_version) for r in got] == [(11, 11, "v1", "v2"), (11, 22, "v2", "v3")]


def fold(counts, threshold):
    total = mark = 0
    out = []
    for at, n in counts:
        total += n
        if total - mark >= threshold:
            out.append((at, total - mark, total, f"v{len(out) + 1}", f"v{len(out) + 2}"))
            mark = total
    return out


def test_retrain_signals_equal_the_fold(spark):
    import random

    draw = random.Random(3)
    for threshold in (1, 5, 40, 10_000):
        rows = [(f"{i:05d}", draw.choice([0, 0, 1, 2, 9, 30])) for i in range(400)]
        frame = spark.createDataFrame(rows, "check_at string, events long").repartition(5)
        got = monitor.retrain_trigger(frame, threshold).orderBy("check_at").collect()
        assert [tuple(r) for r in got] == fold(rows, threshold)
    assert monitor.retrain_trigger(spark.createDataFrame([], "check_at string, events long"), 5).count() == 0


def test_retrain_signals_of_a_million_checks(spark):
    """No array of checks, and ranges instead of one ordered task."""
    checks = spark.range(1_000_000).select(
        F.lpad(F.col("id").cast("string"), 7, "0").alias("check_at"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("events")
    )
    rows = [(r.check_at, r.events) for r in checks.collect()]
    got = monitor.retrain_trigger(checks, 20_000).orderBy("check_at").collect()
    assert [tuple(r) for r in got] == fold(rows, 20_000) and len(got) > 50


def test_alerts_are_strict(spark):
    metrics = spark.createDataFrame([("auc", 0.7), ("NDCG@50", 0.079), ("Recall@300", None)], "metric string, value double")
    assert [r.metric for r in monitor.metric_alerts(metrics).collect()] == ["NDCG@50"]
