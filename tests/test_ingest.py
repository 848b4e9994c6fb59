import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas as S
from tidewatch.operators import validation
from tidewatch.operators.dedupe import mark_first
from tidewatch.plans import daily
from tidewatch.sources.tables import Tables

UUID = "3f2504e0-4f89-11d3-9a0c-0305e82c33{:02x}"


def event(n=1, **change):
    base = {
        "event_id": UUID.format(n),
        "ts_event": "2026-01-13T09:00:00Z",
        "event_type": "transaction_initiated",
        "source_system": "core",
        "user_id": "user-7",
        "value": 12.5,
        "measurement_uncertainty": 0.05,
        "properties": {"channel": "app"},
    }
    return {k: v for k, v in {**base, **change}.items() if v is not ...}


@pytest.fixture
def bodies(spark):
    def build(*batches):
        rows = [
            (f"b{i}", datetime(2026, 1, 13, 10, i), b if isinstance(b, str) else json.dumps({"events": b}))
            for i, b in enumerate(batches)
        ]
        return spark.createDataFrame(rows, S.REQUEST_BODIES)

    return build


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def errors(df, rows):
    return [r["errors"] for r in rows(validation.check_events(validation.explode_bodies(df)), "batch_id", "seq")]


def test_valid_event_is_typed(bodies, one):
    got = one(validation.check_events(validation.explode_bodies(bodies([event()]))))
    assert got["errors"] == []
    assert got["ts_event"] == datetime(2026, 1, 13, 9) and got["value"] == 12.5
    assert json.loads(got["properties"]) == {"channel": "app"}


def test_optional_fields_default(bodies, one):
    bare = event(user_id=..., value=..., measurement_uncertainty=..., properties=..., extra=1)
    got = one(validation.check_events(validation.explode_bodies(bodies([bare]))))
    assert got["errors"] == [] and got["properties"] == "{}"
    assert got["user_id"] is None and got["value"] is None and got["measurement_uncertainty"] is None
    nulls = event(user_id=None, value=None, measurement_uncertainty=None)
    assert one(validation.check_events(validation.explode_bodies(bodies([nulls]))))["errors"] == []


@pytest.mark.parametrize("change, want", [
    ({"event_type": "unknown_event"}, "event_type:not_allowed"),
    ({"event_type": ...}, "event_type:missing"),
    ({"event_type": 5}, "event_type:malformed"),
    ({"event_id": "nope"}, "event_id:malformed"),
    ({"event_id": ...}, "event_id:missing"),
    ({"ts_event": "yesterday"}, "ts_event:malformed"),
    ({"ts_event": None}, "ts_event:missing"),
    ({"source_system": None}, "source_system:missing"),
    ({"source_system": ["x"]}, "source_system:malformed"),
    ({"user_id": 7}, "user_id:malformed"),
    ({"value": "abc"}, "value:malformed"),
    ({"measurement_uncertainty": -0.1}, "measurement_uncertainty:negative"),
    ({"properties": "text"}, "properties:malformed"),
    ({"properties": None}, "properties:malformed"),
])
def test_each_fault_is_named_once(bodies, rows, change, want):
    assert errors(bodies([event(**change)]), rows) == [[want]]


@pytest.mark.parametrize("raw", [
    UUID.format(1).upper(), "{" + UUID.format(1) + "}", "urn:uuid:" + UUID.format(1), UUID.format(1).replace("-", ""),
])
def test_uuid_forms_are_one_id(bodies, one, raw):
    got = one(validation.explode_bodies(bodies([event(event_id=raw)])))
    assert got["event_id"] == UUID.format(1)


@pytest.mark.parametrize("raw, want", [
    ("2026-01-13T10:00:00+01:00", datetime(2026, 1, 13, 9)),
    ("2026-01-13 09:00:00.250", datetime(2026, 1, 13, 9, 0, 0, 250000)),
    ("2026-01-13T09:00", datetime(2026, 1, 13, 9)),
    ("2026-01-13", datetime(2026, 1, 13)),
    (1768294800, datetime(2026, 1, 13, 9)),
    (1768294800000, datetime(2026, 1, 13, 9)),
])
def test_event_times(bodies, one, raw, want):
    assert one(validation.explode_bodies(bodies([event(ts_event=raw)])))["ts_event"] == want


def test_broken_bodies(bodies, rows):
    df = bodies("{not json", '{"other":1}', '{"events":5}', '{"events":[]}')
    assert errors(df, rows) == [["body:unparseable"], ["events:missing"], ["events:missing"]]


def test_first_copy_wins_and_history_counts(bodies, rows, spark):
    df = bodies([event(1), event(1, value=1), event(2)], [event(2), event(3, event_type="x"), event(4)])
    history = spark.createDataFrame([(UUID.format(4),)], "event_id string")
    judged = validation.classify(validation.explode_bodies(df), history)
    got = [(r["batch_id"], r["seq"], r["reason"]) for r in rows(judged, "batch_id", "seq")]
    assert got == [
        ("b0", 0, "ok"), ("b0", 1, "duplicate_event_id"), ("b0", 2, "ok"),
        ("b1", 0, "duplicate_event_id"), ("b1", 1, "validation_error"), ("b1", 2, "duplicate_event_id"),
    ]


def test_invalid_first_copy_does_not_take_the_id(bodies, rows):
    df = bodies([event(1, measurement_uncertainty=-1), event(1)])
    judged = validation.classify(validation.explode_bodies(df))
    assert [r["reason"] for r in rows(judged, "seq")] == ["validation_error", "ok"]


def test_whole_batches(bodies, rows):
    df = bodies([event(1), event(2, event_type="x")], [event(1), event(1)])
    judged = validation.classify(validation.explode_bodies(df), whole_batches=True)
    assert [r["reason"] for r in rows(judged, "batch_id", "seq")] == [
        "validation_error", "validation_error", "ok", "duplicate_event_id",
    ]


@pytest.mark.parametrize("large", [1, 3, 10**6])
def test_hot_id_and_hot_batch_whatever_counts_as_large(spark, rows, large):
    """A third of the rows share one id; half of them sit in one batch."""
    n = 300
    feed = spark.range(n).selectExpr(
        "if(id % 2 = 0, 0, id div 30) AS batch_id", "id AS seq",
        "concat('00000000-0000-0000-0000-', lpad(cast(if(id % 3 = 0, 0, id div 2) AS string), 12, '0')) AS event_id",
        "timestamp'2026-01-13 00:00:00' AS ts_event", "timestamp'2026-01-13 01:00:00' AS ts_ingested",
        "if(id = 151, 'bad', 'user_access') AS event_type", "'web' AS source_system", "'u' AS user_id",
        "1D AS value", "0D AS measurement_uncertainty", "'{}' AS properties",
    )
    for whole in (False, True):
        got = rows(validation.classify(feed, whole_batches=whole, large=large))
        bad = {r["batch_id"] for r in got if r["errors"]} if whole else set()
        seen, want = set(), {}
        for r in sorted(got, key=lambda r: (r["batch_id"], r["seq"])):
            if r["errors"] or r["batch_id"] in bad:
                want[r["seq"]] = "validation_error"
            else:
                want[r["seq"]] = "duplicate_event_id" if r["event_id"] in seen else "ok"
                seen.add(r["event_id"])
        assert {r["seq"]: r["reason"] for r in got} == want and len(got) == n


def test_mark_first_keeps_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, o long")
    assert [r["is_first"] for r in rows(mark_first(df, "k", ["o"]), "o")] == [True, True, True, False]


def test_receipts_and_payload(bodies, rows, one):
    df = bodies([event(1), event(1), event(2, event_type="x")])
    judged = validation.classify(validation.explode_bodies(df))
    receipt = validation.receipts(judged)
    assert one(receipt) == {
        "batch_id": "b0", "accepted": 1, "rejected": 2,
        "rejected_reasons": {"duplicate_event_id": 1, "validation_error": 1},
    }
    audit = one(validation.audit_of_ingest(receipt, "ops", F.lit(datetime(2026, 1, 13))))
    assert (audit["actor"], audit["action"], audit["entity_type"]) == ("ops", "ingest_events", "events_batch")
    assert json.loads(audit["payload"])["rejected"] == 2
    bad = [r for r in rows(validation.refused(judged)) if r["reason"] == "validation_error"]
    payload = json.loads(bad[0]["raw_payload"])
    assert payload["event_type"] == "x" and payload["errors"] == ["event_type:not_allowed"]


def test_ingest_is_idempotent(tables, bodies, rows, one):
    posts = bodies([event(1), event(2)], [event(1), event(2)])
    first = one(daily.ingest(tables, posts.where("batch_id = 'b0'")))
    again = one(daily.ingest(tables, posts.where("batch_id = 'b1'")))
    assert (first["accepted"], first["rejected"]) == (2, 0)
    assert (again["accepted"], again["rejected_reasons"]) == (0, {"duplicate_event_id": 2})
    assert tables.read("events_raw").count() == 2
    assert tables.read("events_quarantine").count() == 2
    assert tables.read("audit_log").count() == 2
    assert one(tables.read("events_raw").select("event_date").distinct())["event_date"] == date(2026, 1, 13)


def test_a_run_that_failed_before_the_events_can_be_repeated(tables, bodies, monkeypatch):
    posts = bodies([event(1), event(1), event(2, event_type="x")])
    append = Tables.append

    def fail_on_events(self, name, rows):
        if name == "events_raw":
            raise OSError("lost")
        append(self, name, rows)

    monkeypatch.setattr(Tables, "append", fail_on_events)
    with pytest.raises(OSError):
        daily.ingest(tables, posts)
    monkeypatch.setattr(Tables, "append", append)
    daily.ingest(tables, posts)
    assert tables.read("events_raw").count() == 1
    assert tables.read("events_quarantine").count() == 2
    assert tables.read("audit_log").count() == 1


def test_a_body_delivered_twice_is_accepted_once(tables, bodies, rows, one):
    once = bodies([event(1), event(2), event(3, event_type="x")])
    receipt = one(daily.ingest(tables, once.unionAll(once)))
    assert (receipt["accepted"], receipt["rejected_reasons"]) == (2, {"duplicate_event_id": 2, "validation_error": 2})
    assert tables.read("events_raw").count() == 2
    assert tables.read("events_quarantine").count() == 4


def test_an_empty_batch_is_answered_and_audited(tables, bodies, rows):
    got = rows(daily.ingest(tables, bodies([], [event(1)])), "batch_id")
    assert [(r["batch_id"], r["accepted"], r["rejected"]) for r in got] == [("b0", 0, 0), ("b1", 1, 0)]
    assert tables.read("audit_log").count() == 2


def test_a_judgement_that_is_kept_is_not_made_again(tables, bodies, rows, tmp_path):
    posts, kept = bodies([event(1), event(1), event(2, event_type="x")]), str(tmp_path / "judged")
    first = rows(daily.ingest(tables, posts, judged_at=kept))
    state = {n: rows(tables.read(n)) for n in ("events_raw", "events_quarantine", "audit_log")}
    assert rows(daily.ingest(tables, posts, judged_at=kept)) == first
    for name, before in state.items():
        assert sorted(map(str, rows(tables.read(name)))) == sorted(map(str, before))


def test_events_judged_just_now_are_looked_up_once(tables, bodies, tmp_path, monkeypatch):
    looked_up, known_ids = [], tables.known_ids
    monkeypatch.setattr(tables, "known_ids", lambda incoming: looked_up.append(1) or known_ids(incoming))
    posts, kept = bodies([event(1), event(2)]), str(tmp_path / "judged")
    daily.ingest(tables, posts, judged_at=kept, origin="s/0")
    assert len(looked_up) == 1 and tables.read("events_raw").count() == 2
    daily.ingest(tables, posts, judged_at=kept, origin="s/0")
    assert len(looked_up) == 2 and tables.read("events_raw").count() == 2


def test_rows_are_shuffled_once_to_be_judged_against_history(bodies, spark):
    history = spark.createDataFrame([(UUID.format(4),)], "event_id string")
    judged = validation.classify(validation.explode_bodies(bodies([event(1), event(4)])), history)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_a_batch_id_that_recurs_is_refused_body_by_body(tables, spark, rows):
    good, bad = json.dumps({"events": [event(1)]}), json.dumps({"events": [event(2, event_type="x")]})
    moments = [datetime(2026, 1, 13, 10), datetime(2026, 1, 13, 11)]
    posts = spark.createDataFrame([("b", m, b) for m, b in zip(moments, (good, bad))], S.REQUEST_BODIES)
    daily.ingest(tables, posts, whole_batches=True, path='/in"gest')
    kept = rows(tables.read("events_quarantine"))
    assert [json.loads(r["raw_payload"])["path"] for r in kept] == ['/in"gest']
    assert kept[0]["ts_ingested"] == moments[1] and tables.read("events_raw").count() == 1


def test_whole_batch_ingest_quarantines_the_body(tables, bodies, rows, one):
    receipt = daily.ingest(tables, bodies([event(1), event(2, event_type="x")], [event(3)], "{oops"), whole_batches=True)
    assert one(receipt)["batch_id"] == "b1"
    kept = {json.loads(r["raw_payload"])["errors"][0]: json.loads(r["raw_payload"]) for r in rows(tables.read("events_quarantine"))}
    assert set(kept) == {"event_type:not_allowed", "body:unparseable"}
    assert len(kept["event_type:not_allowed"]["body"]["events"]) == 2
    assert kept["body:unparseable"]["body"] == {"raw": "unparseable"}
    assert kept["event_type:not_allowed"]["path"] == "/ingest/events"
