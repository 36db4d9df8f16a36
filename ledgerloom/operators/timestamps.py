"""Mixed timestamp formats and zones to UTC instants in microseconds.

An ordered cascade of anchored patterns rewrites each text to one canonical local form and the zone
it states; a strict cast then turns both into an instant.  Everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import bounded_side
from ..functions.days import month_number

#: Offsets of zone abbreviations.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00",
    "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "IST": "+05:30", "NPT": "+05:45", "SGT": "+08:00", "HKT": "+08:00", "AWST": "+08:00", "JST": "+09:00",
    "KST": "+09:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00",
    "NZST": "+12:00", "NZDT": "+13:00", "NST": "-03:30", "NDT": "-02:30", "BRT": "-03:00", "ART": "-03:00",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00",
    "HST": "-10:00",
}

FROM_SECONDS, TO_SECONDS = 1420070400, 2051222400  # 2015-01-01 and 2035-01-01 UTC

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?: ?((?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+))?(?: ?\[([A-Za-z0-9_+/-]+)\])?"
_TIME = rf"(?:(?:[Tt]|,? (?:at )?){_CLOCK})?{_ZONE}$"
_REST = "$4|$5|$6|$7|$8|$9|$10"
#: (anchored pattern, order of the date's parts in it). Tried from the top; each rewrites to y|m|d|H|M|S|fraction|ap|zone|[zone].
_FORMS = (
    ("ymd", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}", f"$1|$2|$3|{_REST}"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?()?)?{_ZONE}$", f"$1|$2|$3|{_REST}"),
    ("mdy", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}", f"$3|$1|$2|{_REST}"),
    ("dmy", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}", f"$3|$2|$1|{_REST}"),
    ("d mon y", rf"^(?:[A-Za-z]{{3,9}},? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}}){_TIME}", f"$3|$2|$1|{_REST}"),
    ("mon d y", rf"^(?:[A-Za-z]{{3,9}},? )?([A-Za-z]{{3,9}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}", f"$3|$1|$2|{_REST}"),
)
_NUMBER = r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?$"


def epoch_micros(text: Column, low: int = FROM_SECONDS, high: int = TO_SECONDS) -> Column:
    """Microseconds of a number that counts seconds, milli-, micro- or nanoseconds, whichever falls into [low, high) seconds."""
    n = text.try_cast("decimal(38,10)")
    # The unit is the one whose range holds the number; the ranges don't overlap.
    below = lambda digits: n < F.lit(high * 10**digits)
    scale = F.when(below(0), F.lit(1_000_000)).when(below(3), F.lit(1_000)).when(below(6), F.lit(1))
    micros = F.when(below(6), F.floor(n * scale)).when(below(9), F.floor(n / F.lit(1_000))).try_cast("bigint")
    return F.when((micros >= F.lit(low * 1_000_000)) & (micros < F.lit(high * 1_000_000)), micros)


def _offset(written: Column) -> Column:
    """``+5``, ``UTC+0530`` and the like as ``+05:00`` and ``+05:30``."""
    offset = F.regexp_replace(F.upper(written), r"^(?:UTC|GMT)(?=[+-])", "")
    offset = F.regexp_replace(offset, r"^([+-])(\d)(?=:|$)", "$10$2")
    return F.rpad(F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"), 6, ":00")


def with_instants(df: DataFrame, text: Column, zone: Column, date_order: Column, name: str = "utc_us", *, low: int = FROM_SECONDS, high: int = TO_SECONDS, shift_gaps: bool = True, ambiguous: str = "first") -> DataFrame:
    """`df` with a column of the UTC microseconds of the instant `text` states, or null.

    - Null, blank, unreadable text, impossible dates and times (30 February, month 13, hour 25) and
      instants outside [low, high) seconds give null.
    - A written offset, abbreviation or region holds; an offset beside a region in brackets decides.
      Otherwise `zone` holds, and UTC where that is null.  An unknown zone gives null.
    - ``01/02/2026`` follows `date_order` (``mdy`` or ``dmy``); with any other order it is read only
      where one of the two numbers is above 12.
    - Missing time parts are zero, digits below a microsecond are cut off.
    - A local time that occurs twice, with nothing written that tells which, is its first occurrence, its
      last or none at all, as `ambiguous` says: ``first``, ``last`` or ``reject``.
    - One that a clock change skips is moved on by the length of the gap (`shift_gaps`), or gives null
      with ``shift_gaps=False``.

    The work is staged in projections, each of which uses the one before it more than once, so the
    optimizer keeps them apart and every pattern runs at most once on a value.
    """
    kept = df.columns
    spaced = F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))
    staged = df.select("*", spaced.alias("__t"), F.coalesce(zone, F.lit("UTC")).alias("__zone"), F.lower(F.coalesce(date_order, F.lit(""))).alias("__order"))
    t, order = F.col("__t"), F.col("__order")
    parts = F.when(t.rlike(_NUMBER) & ~t.rlike(r"^\d{8}$|^\d{14}$"), F.lit(None))
    for form, pattern, rewritten in _FORMS:
        fits = t.rlike(pattern)
        if form in ("mdy", "dmy"):
            above = F.regexp_extract(t, r"^(\d{1,2})[-/.](\d{1,2})", 2 if form == "mdy" else 1).try_cast("int") > 12
            fits = ((order == form) | (~order.isin("mdy", "dmy") & above)) & fits
        parts = parts.when(fits, F.regexp_replace(t, pattern, rewritten))
    staged = staged.withColumn("__parts", F.split(parts, r"\|", -1))
    staged = staged.select(*kept, "__t", "__zone", *(F.col("__parts").getItem(i).alias(f"__p{i}") for i in range(10)))
    p = lambda i: F.col(f"__p{i}")
    hour = F.when(p(3) == "", F.lit(0)).otherwise(p(3).try_cast("int"))
    afternoon = F.when(F.lower(p(7)) == "p", 12).otherwise(0)
    hour = F.when(p(7) == "", hour).when(hour.between(1, 12), hour % 12 + afternoon)
    month = F.when(p(1).rlike(r"^\d"), p(1)).otherwise(month_number(p(1)).cast("string"))
    two = lambda c: F.lpad(F.when(c == "", F.lit("0")).otherwise(c), 2, "0")
    local = F.concat(
        p(0), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), two(p(2)), F.lit("T"), two(hour.cast("string")),
        F.lit(":"), two(p(4)), F.lit(":"), two(p(5)), F.lit("."), F.rpad(F.substring(p(6), 1, 6), 6, "0"),
    )
    named = F.when(p(8) != "", p(8)).when(p(9) != "", p(9))
    staged = staged.select(*kept, "__t", "__zone", local.alias("__local"), named.alias("__named"))
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    named = F.col("__named")
    at = (
        F.when(named.isNull(), F.concat(F.lit(" "), "__zone"))
        .when(named.rlike(r"^(?:UTC|GMT)?[+-]"), _offset(named))
        .when(named.contains("/"), F.concat(F.lit(" "), named))
        .otherwise(known[F.upper(named)])
    )
    staged = staged.select(*kept, "__t", "__local", at.alias("__at"))
    micros = F.unix_micros(F.concat("__local", "__at").try_cast("timestamp"))
    if ambiguous not in ("first", "last", "reject"):
        raise ValueError(f"ambiguous is {ambiguous!r}")
    if not shift_gaps or ambiguous != "first":
        staged = staged.select(*kept, "__t", "__local", F.when(F.col("__at").startswith(" "), F.trim("__at")).alias("__region"), micros.alias("__first"))
        first, region = F.col("__first"), F.col("__region")
        clock = lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), region))  # noqa: E731  what clocks there show, counted as if it were UTC
        day = F.lit(86_400_000_000)
        later = first + (clock(first) - first) - (clock(first + day) - (first + day))
        twice = F.coalesce((later > first) & (clock(later) == clock(first)), F.lit(False))
        micros = first if ambiguous == "first" else F.when(twice, later if ambiguous == "last" else F.lit(None)).otherwise(first)
        if not shift_gaps:  # the clock of an instant of a local time that exists shows that time
            there = clock(first) == F.unix_micros(F.concat("__local", F.lit("+00:00")).try_cast("timestamp"))
            micros = F.when(region.isNull() | first.isNull() | there, micros)
    staged = staged.select(*kept, "__t", micros.alias("__micros"))
    number = epoch_micros(F.when(t.rlike(_NUMBER), t), low, high)
    staged = staged.select(*kept, F.coalesce(number, "__micros").alias("__micros"))
    inside = (F.col("__micros") >= F.lit(low * 1_000_000)) & (F.col("__micros") < F.lit(high * 1_000_000))
    return staged.select(*kept, F.when(inside, F.col("__micros")).alias(name))


def normalised_instants(listings: DataFrame, zones: DataFrame, fields: dict[str, Column], *, key: str = "listing_id", source: str = "source_id", **options) -> DataFrame:
    """Distinct rows (key, field_name, utc_us), one for each field of `fields` that states an instant.

    `zones` has one row (source_id, tz_name, date_order) for each source; sources it doesn't list,
    and null ones, count as UTC.  Rows with a null key give no rows; a key with several rows gives
    each of their different instants.  Other columns are never read.
    """
    sides = zones.select(F.col("source_id").alias("_source"), "tz_name", "date_order").dropDuplicates(["_source"])
    long = listings.select(
        F.col(key).alias("_key"), F.col(source).alias("_of"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("text")) for n, c in fields.items()))).alias("_f"),
    ).where("_key is not null and _f.text is not null")
    long = long.join(bounded_side(sides), F.col("_of") == F.col("_source"), "left").select(
        F.col("_key").alias(key), F.col("_f.field_name").alias("field_name"), F.col("_f.text").alias("_text"), "tz_name", "date_order"
    )
    found = with_instants(long, F.col("_text"), F.col("tz_name"), F.col("date_order"), **options)
    # The generator holds the filter above the cascade; pushed below it, it would run the cascade twice.
    found = found.select(key, "field_name", F.explode(F.array("utc_us")).alias("utc_us"))
    return found.where("utc_us is not null").distinct()


def listing_instants(listings: DataFrame, zones: DataFrame, **options) -> DataFrame:
    fields = {n: F.col(n) for n in ("created", "created_at", "openrouter.created", "fetched_at")}
    return normalised_instants(listings, zones, fields, **options)
