"""Text expressions: numbers in messages, alert texts, e-mail and board lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- numbers ---------------------------------------------------------------
# SQL text rather than column objects: parsed in one call each.


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _power(base: int, exponent: str) -> str:
    """``base ** exponent`` as an exact integer decimal (two factors below 2**53)."""
    half = f"floor(({exponent}) / 2)"
    rest = f"(({exponent}) - {half})"
    wide = "cast(pow({}D, {}) as decimal(38,0))".format
    return f"({wide(base, half)} * {wide(base, rest)})"


def _above_tie(size: str, digits: str, shift: str) -> str:
    """Whether a double printed as ``digits * 10**shift`` rounds up at its last digit.

    ``digits`` ends in 5, so the printed form is a tie; the stored binary value
    may lie above or below it.  Both are compared as integers; a true tie goes
    to the even neighbour.
    """
    odd = f"(floor({digits} / 10) % 2 = 1)"
    mantissa = f"cast(cast({size} * pow(2D, scale) as bigint) as decimal(38,0))"
    stored = f"cast({mantissa} * {_power(10, f'greatest(0, -({shift}))')} as decimal(38,0))"
    whole = f"cast({digits} as decimal(38,0)) * {_power(10, f'greatest(0, {shift})')}"
    tie = f"cast(cast({whole} as decimal(38,0)) * {_power(2, 'scale')} as decimal(38,0))"
    verdict = _let("stored", stored, _let("tie", tie, f"if(stored = tie, {odd}, stored > tie)"))
    exact = _let("scale", f"54 - floor(log2({size}))", verdict)
    return f"if({size} >= 1e-12 and {size} < 1e15, {exact}, {odd})"


def _bare(number: str) -> str:
    """Trailing zeros and a trailing point dropped."""
    return f"rtrim('.', rtrim('0', {number}))"


def _four_digit_sql(name: str) -> str:
    # ``d.dddde+XX`` of the size, then its digits and exponent.
    digits = "cast(concat(substr(printed, 1, 1), substr(printed, 3, 4)) as bigint)"
    exponent = "cast(regexp_extract(printed, 'e(.*)$', 1) as int)"
    up = f"if({_above_tie('size', digits, f'{exponent} - 4')}, 1, 0)"
    settled = f"cast(concat(floor({digits} / 10) + {up}, 'e', {exponent} - 3) as double)"
    tie = f"{digits} % 10 = 5 and cast(printed as double) = size"
    sci = f"format_string('%.3e', if({tie}, {settled}, size))"
    sci = _let("printed", "format_string('%.4e', size)", sci)

    kept = "concat(substr(sci, 1, 1), substr(sci, 3, 3))"
    powered = f"concat({_bare('substr(sci, 1, 5)')}, regexp_extract(sci, '(e.*)$', 1))"
    whole = _bare(f"concat(substr({kept}, 1, ex + 1), '.', substr({kept}, ex + 2))")
    small = _bare(f"concat('0.', repeat('0', -ex - 1), {kept})")
    plain = f"case when ex < -4 or ex >= 4 then {powered} when ex >= 0 then {whole} else {small} end"
    general = _let("sci", sci, _let("ex", "cast(regexp_extract(sci, 'e(.*)$', 1) as int)", plain))
    body = f"""case
        when v is null then cast(null as string)
        when isnan(v) then 'nan'
        when abs(v) = double('infinity') then if(v < 0, '-inf', 'inf')
        when v = 0 then '0'
        else concat(if(v < 0, '-', ''), {_let('size', 'abs(v)', general)}) end"""
    return _let("v", name, body)


def _two_place_sql(name: str) -> str:
    number = "cast(replace(printed, '.', '') as bigint)"
    up = f"if({_above_tie('size', number, '-3')}, 1, 0)"
    settled = f"(floor({number} / 10) + {up}) / 100D"
    tie = "size < 1e12 and right(printed, 1) = '5' and cast(printed as double) = size"
    fixed = f"format_string('%.2f', if({tie}, {settled}, size))"
    body = _let("size", "abs(v)", _let("printed", "format_string('%.3f', size)", fixed))
    signed = f"if(v is null, cast(null as string), concat(if(v < 0, '-', ''), {body}))"
    return _let("v", name, signed)


def four_digits(name: str) -> Column:
    """Column ``name`` with four significant digits: 0.2, 100, 1.235e+04, 1e-05."""
    return F.expr(_four_digit_sql(name))


def two_places(name: str) -> Column:
    """Column ``name`` with two decimals, rounded on the stored binary value."""
    return F.expr(_two_place_sql(name))


# --- alert messages --------------------------------------------------------
# Fixed wording by method: the text between metric name and date, label and
# context field of two numbers, and the field shown as z where there is one.
_MESSAGE_PARTS = {
    "z_score": (
        "anomalous on",
        ("observed", "observed"), ("baseline_mean", "baseline_mean"), "z_score",
    ),
    "ewma": ("EWMA signal on", ("observed", "observed"), ("ewma", "ewma"), "ewma_z"),
    "change_point": (
        "change-point on", ("prev_mean", "previous_mean"), ("recent_mean", "recent_mean"), None,
    ),
    "seasonal_decomposition": (
        "seasonal deviation on",
        ("observed", "observed"), ("seasonal_mean", "seasonal_mean"), None,
    ),
    "regime_shift": (
        "regime shift on", ("prior_mean", "prior_mean"), ("recent_mean", "recent_mean"), None,
    ),
}


def _by_method(choose: Callable[[tuple], str]) -> str:
    cases = [f"when '{method}' then {choose(parts)}" for method, parts in _MESSAGE_PARTS.items()]
    return f"case context.method {' '.join(cases)} end"


def alert_message() -> Column:
    """Human-readable line over ``metric_name``, ``metric_date`` and ``context``."""
    label, number = (lambda i: _by_method(lambda parts: f"'{parts[i][0]}='")), (
        lambda i: _four_digit_sql(_by_method(lambda parts: f"context.{parts[i][1]}"))
    )
    z = _by_method(lambda parts: f"context.{parts[3]}" if parts[3] else "cast(null as double)")
    opening = f"concat_ws(' ', metric_name, {_by_method(lambda parts: repr(parts[0]))}, metric_date)"
    # The z part is null, hence skipped, for methods without one.
    numbers = (
        f"concat_ws(', ', concat({label(1)}, {number(1)}), concat({label(2)}, {number(2)}),"
        f" concat('z=', {_two_place_sql(z)}))"
    )
    return F.expr(f"concat({opening}, ': ', {numbers})")


# --- notifications ---------------------------------------------------------

def address_list(raw: Column) -> Column:
    """Comma-separated addresses, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def email_subject(prefix: str, severity: Column, metric: Column, day: Column) -> Column:
    line = F.concat(
        F.lit(prefix + " "), severity, F.lit(" "), metric, F.lit(" "),
        F.coalesce(day.cast("string"), F.lit("")),
    )
    return F.trim(line)


def number_text(value: Column) -> Column:
    """A double in its fewest digits: plain from 1e-4 up to 1e16, else like ``1.5e-05``."""
    given, size = value.cast("string"), F.abs(value)
    digits = F.regexp_replace(given.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.concat(digits, F.when(digits.endswith("."), "0").otherwise(""))
    mantissa = F.regexp_replace(F.substring_index(given, "E", 1), r"\.0$", "")
    power = F.substring_index(given, "E", -1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    steps = F.format_string("%02d", F.abs(power))
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~given.contains("E"), given)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, steps))
    )


def email_body(alert: dict[str, Column]) -> Column:
    """Seven lines; the labels are fixed."""
    labels = (
        ("Metric", "metric_name"),
        ("Severity", "severity"),
        ("Risk score", "risk_score"),
        ("Message", "message"),
        ("Timestamp", "ts"),
        ("Context", "context"),
    )
    lines = [F.lit("Alert details:")]
    for label, name in labels:
        shown = F.coalesce(alert[name].cast("string"), F.lit("None"))
        lines.append(F.concat(F.lit(f"{label}: "), shown))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


# --- board -----------------------------------------------------------------
NO_REPORT_TEXT = "No DQ reports yet."


def report_line() -> Column:
    """One line over ``report_date``, ``pass`` and ``confidence``."""
    shown = _two_place_sql("coalesce(confidence, 0D)")
    return F.expr(
        "concat(report_date, ' | pass=', if(pass, 'True', 'False'),"
        f" ' | confidence=', {shown})"
    )


def report_cards(line: Column) -> Column:
    """The report line cut into its trimmed parts."""
    return F.transform(F.split(line, r"\|"), lambda part: F.trim(part))


def currency(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))
