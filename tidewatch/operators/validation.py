"""Parsing, checking and routing of incoming events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.functions.scores import any_of
from tidewatch.operators.dedupe import mark_first, mark_known
from tidewatch.operators.groups import LARGE_GROUP, join_group_facts
from tidewatch.operators.keys import surrogate_id
from tidewatch.sources.staging import stage

OK = "ok"
DUPLICATE = "duplicate_event_id"
INVALID = "validation_error"

EVENT_FIELDS = (
    "event_id", "ts_event", "event_type", "source_system", "user_id",
    "value", "measurement_uncertainty", "properties",
)
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_ISO_TIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}:?\d{2})?)?$"
)
# Numbers above this are epoch milliseconds, smaller ones seconds.
_MILLIS_FROM = 2e10
_NUMERIC_KINDS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def canonical_uuid(raw: Column) -> Column:
    """Lower-case hyphenated form of plain, braced, URN or hyphenless UUID text; else null."""
    digits = F.regexp_replace(F.lower(F.trim(raw)), r"^urn:uuid:|^\{|\}$|-", "")
    grouped = F.regexp_replace(
        digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )
    # Most ids come in this form; only the others are rewritten.
    plain = (F.length(raw) == 36) & raw.rlike(_UUID)
    return F.when(plain, raw).when(grouped.rlike(_UUID), grouped)


def _named_errors(found: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order; the list is filtered for rows with an error only."""
    wrong = any_of([F.coalesce(condition, F.lit(False)) for condition, _ in found])
    names = F.array_compact(F.array(*[F.when(condition, name) for condition, name in found]))
    return F.when(wrong, names).otherwise(F.array().cast("array<string>"))


def _text(name: str) -> Column:
    return F.try_variant_get(f"_raw.{name}", "$", "string")


def _kind(name: str, *prefixes: str) -> Column:
    return any_of([F.col(f"_kind.{name}").startswith(p) for p in prefixes])


def _event_time(name: str) -> Column:
    iso = F.when(
        _text(name).rlike(_ISO_TIME), F.replace(_text(name), F.lit(","), F.lit(".")).try_cast("timestamp")
    )
    number = F.try_variant_get(f"_raw.{name}", "$", "double")
    seconds = F.when(F.abs(number) > _MILLIS_FROM, number / 1000.0).otherwise(number)
    epoch = F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))
    return F.when(_kind(name, *_NUMERIC_KINDS), epoch).when(_kind(name, "STRING"), iso)


def deliveries(bodies: DataFrame) -> DataFrame:
    """Request bodies with ``delivery``, which tells equal and other bodies of one batch and moment apart.

    Landing folders and queues deliver at least once: a body that arrives again
    is a delivery of its own.
    """
    counted = bodies.groupBy("batch_id", "received_at", "body").agg(F.count(F.lit(1)).alias("_n"))
    number = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_number")
    name = F.concat_ws("/", F.hex(F.xxhash64("body")), F.lpad(F.col("_number").cast("string"), 9, "0"))
    return counted.select("batch_id", "received_at", "body", number).select(
        "batch_id", "received_at", "body", name.alias("delivery")
    )


def explode_bodies(bodies: DataFrame) -> DataFrame:
    """One row per event of each request body ``{"events": [...]}``, in order.

    Adds ``batch_id``, ``seq``, ``delivery`` and ``parse_errors`` to the typed
    event columns.  A body that is not JSON or has no event list yields one row
    that carries the error and ``seq`` 0; an empty event list yields none.
    """
    parsed = deliveries(bodies).select(
        "batch_id", "received_at", "delivery", F.try_parse_json("body").alias("_doc")
    ).withColumn("_events", F.try_variant_get("_doc", "$.events", "array<variant>"))
    broken = F.when(F.col("_doc").isNull(), "body:unparseable").when(
        F.col("_events").isNull(), "events:missing"
    )
    opened = parsed.select(
        "batch_id",
        "received_at",
        "delivery",
        broken.alias("_broken"),
        F.posexplode_outer("_events").alias("_pos", "_event"),
    ).where(F.col("_event").isNotNull() | F.col("_broken").isNotNull())

    # Each field is taken out of its event once, then its JSON type named once.
    fields = ", ".join(f"{name}: variant" for name in EVENT_FIELDS)
    taken = opened.withColumn("_raw", F.try_variant_get("_event", "$", f"struct<{fields}>"))
    named = taken.withColumn(
        "_kind", F.struct(*[F.schema_of_variant(f"_raw.{name}").alias(name) for name in EVENT_FIELDS])
    )

    def text(name: str) -> Column:
        return F.when(_kind(name, "STRING"), _text(name))

    def number(name: str) -> Column:
        usable = _kind(name, "STRING", *_NUMERIC_KINDS)
        return F.when(usable, F.try_variant_get(f"_raw.{name}", "$", "double"))

    given = F.col("_raw.properties")
    properties = F.when(_kind("properties", "OBJECT"), F.to_json(given)).when(
        given.isNull(), F.lit("{}")
    )
    typed = {
        "event_id": canonical_uuid(text("event_id")),
        "ts_event": _event_time("ts_event"),
        "event_type": text("event_type"),
        "source_system": text("source_system"),
        "user_id": text("user_id"),
        "value": number("value"),
        "measurement_uncertainty": number("measurement_uncertainty"),
        "properties": properties,
    }
    rows = named.select(
        "batch_id", "received_at", "delivery", "_broken", "_pos", "_kind",
        *[value.alias(name) for name, value in typed.items()],
    )
    # Stated in the event, yet unusable for the field; a JSON null states nothing.
    unusable = [
        (
            F.col(f"_kind.{name}").isNotNull()
            & ((F.col(f"_kind.{name}") != "VOID") | F.lit(name == "properties"))
            & F.col(name).isNull(),
            f"{name}:malformed",
        )
        for name in EVENT_FIELDS
    ]
    whole = F.col("_broken")
    return rows.select(
        "batch_id",
        F.coalesce("_pos", F.lit(0)).cast("bigint").alias("seq"),
        "delivery",
        F.col("received_at").alias("ts_ingested"),
        *EVENT_FIELDS,
        F.when(whole.isNotNull(), F.array(whole))
        .otherwise(_named_errors(unusable))
        .alias("parse_errors"),
    )


def check_events(rows: DataFrame) -> DataFrame:
    """Adds ``errors``: what keeps a typed event from being accepted, empty if nothing.

    Absent optional fields become null and absent properties ``{}``.
    """
    event_id, kind = F.col("event_id"), F.col("event_type")
    found = _named_errors([
        (event_id.isNull(), "event_id:missing"),
        (~event_id.rlike(_UUID), "event_id:malformed"),
        (F.col("ts_event").isNull(), "ts_event:missing"),
        (kind.isNull(), "event_type:missing"),
        (~kind.isin(*S.EVENT_TYPES), "event_type:not_allowed"),
        (F.col("source_system").isNull(), "source_system:missing"),
        (F.col("measurement_uncertainty") < 0, "measurement_uncertainty:negative"),
    ])
    if "parse_errors" in rows.columns:
        earlier = F.coalesce("parse_errors", F.array().cast("array<string>"))
        # A malformed field is also missing; report it once.
        named = F.transform(earlier, lambda e: F.split_part(e, F.lit(":"), F.lit(1)))
        fresh = F.filter(
            found, lambda e: ~F.array_contains(named, F.split_part(e, F.lit(":"), F.lit(1)))
        )
        broken = F.exists(earlier, lambda e: e.isin("body:unparseable", "events:missing"))
        found = F.when(F.size(earlier) == 0, found).when(broken, earlier).otherwise(F.concat(earlier, fresh))
    return rows.withColumns({
        "errors": found,
        "properties": F.coalesce("properties", F.lit("{}")),
    })


def classify(
    rows: DataFrame,
    history: DataFrame | None = None,
    whole_batches: bool = False,
    order: tuple[str, ...] = ("ts_ingested", "batch_id", "seq"),
    large: int = LARGE_GROUP,
) -> DataFrame:
    """Adds ``errors`` and ``reason`` to incoming events.

    ``ok`` for the first valid copy of an id that ``history`` does not hold,
    ``duplicate_event_id`` for the other valid copies, ``validation_error``
    otherwise.  With ``whole_batches`` one invalid event refuses its batch.
    """
    checked = check_events(rows)
    wrong = F.size("errors") > 0
    batch = ["batch_id"]
    if "delivery" in rows.columns:
        # Unique also if a batch id comes again or a body is delivered twice.
        order = (*order, "delivery")
        batch = ["batch_id", "ts_ingested", "delivery"]
    if whole_batches:
        keyed = checked.withColumn("_batch", F.concat_ws("/", *[F.col(c).cast("string") for c in batch]))
        bad = (
            keyed.groupBy("_batch")
            .agg(F.count(F.lit(1)).alias("_size"), F.max(wrong).alias("_refused"))
            .where("_refused")
        )
        checked = join_group_facts(
            keyed, bad, "_batch", "_size", F.struct(*order), large
        ).drop("_batch")
        wrong = wrong | F.coalesce("_refused", F.lit(False))
    # Only valid events compete for an id; refused ones get a key of their own.
    place = F.concat_ws("/", *[F.col(c).cast("string") for c in order])
    marked = checked.withColumn(
        "_id", F.when(wrong, F.concat(F.lit("!"), place)).otherwise(F.col("event_id"))
    )
    marked = mark_first(marked, "_id", list(order), large)
    taken = ~F.col("is_first")
    if history is not None:
        # Few of history's ids come back: they are looked up first, with the
        # incoming ids broadcast when the optimizer finds them small enough.
        # Staged, so that the rows are not shuffled to meet a few ids or none.
        incoming = rows.select("event_id").distinct()
        back = history.select("event_id").join(incoming, "event_id", "left_semi")
        keys = stage(back.distinct().select(F.col("event_id").alias("_id")), "known-again")
        marked = mark_known(marked, keys, "_id", F.struct(*order))
        taken = taken | F.col("is_known")
    reason = F.when(wrong, INVALID).when(taken, DUPLICATE).otherwise(OK)
    return marked.select(*rows.columns, "errors", reason.alias("reason"))


def accepted(classified: DataFrame) -> DataFrame:
    """Accepted events in the raw layout."""
    kept = classified.where(F.col("reason") == OK).withColumn("event_date", F.to_date("ts_event"))
    return kept.select(*S.EVENTS_RAW.names)


def _named(parts: list[Column], origin: str | None) -> Column:
    """Surrogate id of ``parts``, told apart by ``origin`` if there is one."""
    return surrogate_id(*parts) if origin is None else surrogate_id(*parts, F.lit(origin))


def refused(classified: DataFrame, origin: str | None = None) -> DataFrame:
    """Refused events as quarantine rows, one each, with the event and its errors.

    ``origin`` names the delivery: equal events of two deliveries get rows of their own.
    """
    payload = F.to_json(F.struct(*EVENT_FIELDS, "errors"))
    place = [c for c in ("batch_id", "seq", "ts_ingested", "reason", "delivery") if c in classified.columns]
    return classified.where(F.col("reason") != OK).select(
        _named([F.col(c) for c in place], origin).alias("quarantine_id"),
        "ts_ingested",
        "reason",
        payload.alias("raw_payload"),
        F.to_date("ts_ingested").alias("ingest_date"),
    )


def refused_bodies(bodies: DataFrame, classified: DataFrame, path: str, origin: str | None = None) -> DataFrame:
    """Batches with an invalid event as quarantine rows, one per request body."""
    bad = classified.where(F.size("errors") > 0).groupBy(
        "batch_id", F.col("ts_ingested").alias("received_at"), "delivery"
    ).agg(
        # Distinct codes: a short list however long the batch.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors")
    )
    document = F.coalesce(F.try_parse_json("body"), F.parse_json(F.lit('{"raw":"unparseable"}')))
    payload = F.to_json(F.struct(F.lit(path).alias("path"), "errors", document.alias("body")))
    return deliveries(bodies).join(bad, ["batch_id", "received_at", "delivery"]).select(
        _named([F.col("batch_id"), F.col("received_at"), F.col("delivery")], origin).alias("quarantine_id"),
        F.col("received_at").alias("ts_ingested"),
        F.lit(INVALID).alias("reason"),
        payload.alias("raw_payload"),
        F.to_date("received_at").alias("ingest_date"),
    )


def receipts(classified: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Per batch: accepted, rejected, and the rejections by reason.

    ``batches`` (one row per ``batch_id``) adds those without an event: nothing
    accepted and nothing rejected.
    """
    by_reason = classified.groupBy("batch_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    if batches is not None:
        by_reason = batches.select("batch_id").join(by_reason, "batch_id", "left")
    no = F.col("reason") != OK
    entries = F.collect_list(F.when(no, F.struct("reason", "n")))
    return by_reason.groupBy("batch_id").agg(
        F.coalesce(F.sum(F.when(~no, F.col("n"))), F.lit(0)).cast("bigint").alias("accepted"),
        F.coalesce(F.sum(F.when(no, F.col("n"))), F.lit(0)).cast("bigint").alias("rejected"),
        F.map_from_entries(F.array_sort(entries)).alias("rejected_reasons"),
    )


def audit_of_ingest(receipt: DataFrame, actor: str, ts: Column, origin: str | None = None) -> DataFrame:
    """One audit record per answered batch."""
    payload = F.to_json(F.struct("accepted", "rejected", "rejected_reasons"))
    action = F.lit("ingest_events")
    return receipt.select(
        _named([action, F.col("batch_id"), ts], origin).alias("audit_id"),
        ts.alias("ts"),
        F.lit(actor).alias("actor"),
        action.alias("action"),
        F.lit("events_batch").alias("entity_type"),
        F.lit(None).cast("string").alias("entity_id"),
        payload.alias("payload"),
    )
