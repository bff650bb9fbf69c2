"""Mixed timestamp formats and time zones (problem 1).

Every accepted notation is one branch of a single regular expression with named groups.  One
``regexp_replace`` per cell writes the named components behind a marker into one delimited string,
so the text is scanned once; the components are then checked against the calendar and assembled to
an instant by integer day arithmetic.  Everything runs inside JVM code generation; the only data
movement is the join with the site table, which Spark broadcasts by its own size check and
otherwise sorts (a hot site is then split by adaptive execution).

Defined results
---------------
* null, blank, incomplete, impossible and unknown notations give null (``*_found`` leaves them out);
* white space around a cell, no-break spaces included, does not count;
* digits behind the microsecond are cut, absent seconds are zero;
* a reading that needs a site and has none (null or unknown site code) gives null;
* an instant is UTC; an ambiguous wall-clock time is the earlier instant, a skipped one is read with
  the offset before the change;
* repeated rows give one result each; very long cells fail the anchored expression at once;
* further columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.binding import bind

MARK, SEP = "\u0001", "\u0002"
DAY_US = 86_400_000_000
# Fixed value: white space, no-break and zero-width ones included, for the inside of a character class.
BLANKS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# Month names as written in English and German.
MONTHS = (
    ("january", "jan", "januar", "jän", "jänner"),
    ("february", "feb", "februar"),
    ("march", "mar", "märz", "mär", "maerz", "mrz"),
    ("april", "apr"),
    ("may", "mai"),
    ("june", "jun", "juni"),
    ("july", "jul", "juli"),
    ("august", "aug"),
    ("september", "sep", "sept"),
    ("october", "oct", "oktober", "okt"),
    ("november", "nov"),
    ("december", "dec", "dezember", "dez"),
)
# Zone abbreviations, standard and daylight time. Which offset one stands for follows from the site's zone.
STANDARD = ("CET", "EET", "WET", "MEZ", "GMT", "EST", "CST", "MST", "PST", "AKST", "HST", "AST", "NST", "AEST", "ACST", "AWST", "NZST", "IST", "NPT", "BRT", "ART", "CLT", "JST", "KST", "SGT", "HKT", "PKT", "MSK", "SAST", "WAT", "CAT", "EAT")
DAYLIGHT = ("CEST", "EEST", "WEST", "MESZ", "BST", "EDT", "CDT", "MDT", "PDT", "AKDT", "ADT", "NDT", "AEDT", "ACDT", "NZDT", "BRST", "CLST")

PARTS = ("y", "y2", "m", "mon", "d", "n1", "n2", "h", "mi", "s", "f", "ap", "sg", "oh", "om", "z", "ab", "zid", "unix", "days", "dayf")


def _pattern() -> tuple[str, str]:
    """The alternation and, for each part, the replacement text that concatenates its groups (one branch matches, so the others are empty)."""
    names: dict[str, list[str]] = {p: [] for p in PARTS}

    def g(part: str, body: str) -> str:
        name = f"{part}x{len(names[part])}"
        names[part].append(name)
        return f"(?<{name}>{body})"

    month = "|".join(sorted((x for m in MONTHS for x in m), key=len, reverse=True))

    def zone() -> str:
        abbr = "|".join(sorted(STANDARD + DAYLIGHT + ("UTC", "UT"), key=len, reverse=True))
        area = r"[A-Za-z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+){1,2}"
        return (
            rf"(?:[ ]?(?:{g('z', 'Z')}|{g('sg', '[+\\-−]')}{g('oh', '[0-9]{1,2}')}(?::?{g('om', '[0-9]{2}')})?))?"
            rf"(?:[ ]?\[{g('zid', area)}\]|[ ]{g('zid', area)}|[ ]{g('ab', abbr)})?"
        )

    def clock(ampm: bool = True) -> str:
        half = rf"(?:[ ]?{g('ap', '[ap]')}\.?m\.?)?" if ampm else ""
        return rf"{g('h', '[0-9]{1,2}')}:{g('mi', '[0-9]{2}')}(?::{g('s', '[0-9]{2}')}(?:[.,]{g('f', '[0-9]+')})?)?{half}"

    weekday = r"(?:[A-Za-z]{2,10}\.?,?[ ]+)?"
    iso = rf"{g('y', '[0-9]{4}')}(?:-{g('m', '[0-9]{1,2}')}-{g('d', '[0-9]{1,2}')}|/{g('m', '[0-9]{1,2}')}/{g('d', '[0-9]{1,2}')})"
    branches = [
        rf"{iso}(?:(?:T|[ ]+){clock()}{zone()})?",
        rf"{g('y', '[0-9]{4}')}{g('m', '[0-9]{2}')}{g('d', '[0-9]{2}')}(?:T?{g('h', '[0-9]{2}')}{g('mi', '[0-9]{2}')}(?:{g('s', '[0-9]{2}')}(?:[.,]{g('f', '[0-9]+')})?)?{zone()})?",
        # numeric with the year last; the order of the first two numbers is decided later
        rf"{g('n1', '[0-9]{1,2}')}(?:/{g('n2', '[0-9]{1,2}')}/|\.{g('n2', '[0-9]{1,2}')}\.|-{g('n2', '[0-9]{1,2}')}-)(?:{g('y', '[0-9]{4}')}|{g('y2', '[0-9]{2}')})(?:,?[ ]+{clock()}{zone()})?",
        # day, month name, year
        rf"{weekday}{g('d', '[0-9]{1,2}')}\.?[ \-]+{g('mon', month)}\.?,?[ \-]+{g('y', '[0-9]{4}')}(?:,?[ ]+{clock()}(?:[ ]Uhr)?{zone()})?",
        # month name, day, year
        rf"{weekday}{g('mon', month)}\.?[ ]+{g('d', '[0-9]{1,2}')}(?:,[ ]*|[ ]+){g('y', '[0-9]{4}')}(?:,?[ ]+{clock()}{zone()})?",
        # time first
        rf"{clock()},[ ]*{g('mon', month)}\.?[ ]+{g('d', '[0-9]{1,2}')},?[ ]+{g('y', '[0-9]{4}')}{zone()}",
        rf"{g('days', '[0-9]{5}')}(?:\.{g('dayf', '[0-9]{1,15}')})?",
        rf"{g('unix', '[0-9]{10}|[0-9]{13}|[0-9]{16}|[0-9]{19}')}(?:\.{g('f', '[0-9]+')})?",
    ]
    # 14 digits are a compact date and time, 8 a compact date; the other lengths are numbers, so the compact branch must not take them
    branches[1] = r"(?=[0-9]{8}(?:T|\z)|[0-9]{14}(?![0-9]))" + branches[1]
    text = r"(?iu)\A(?:" + "|".join(branches) + r")\z"
    return text, MARK + SEP.join("".join(f"${{{n}}}" for n in names[p]) for p in PARTS)


PATTERN, TEMPLATE = _pattern()


def known_zones(spark: SparkSession) -> list[str]:
    """Zone ids that both Python and the JVM know: a fixed set of some 600 names, whatever the data."""
    ids = zoneinfo.available_timezones()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        ids &= set(jvm.java.lang.String.join("\n", jvm.java.time.ZoneId.getAvailableZoneIds()).split("\n"))
    return sorted(ids)


def trimmed(cell: Column) -> Column:
    return F.regexp_replace(cell, rf"\A[{BLANKS}]+|[{BLANKS}]+\z", "")


def with_components(df: DataFrame, cell: Column, out: str) -> DataFrame:
    """Adds array<string> of the parts in the order of PARTS, null where no notation fits."""
    df = bind(df, "#t", F.when(~cell.contains(MARK), F.regexp_replace(trimmed(cell), PATTERN, TEMPLATE)))
    text = F.col("`#t`")
    return bind(df, out, F.when(text.startswith(MARK), F.split(F.substring(text, 2, 1 << 20), SEP))).drop("#t")


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date by integer arithmetic (years from 1)."""
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    month = F.when(m > 2, m - 3).otherwise(m + 9)
    div = lambda a, b: F.floor(a / b).cast("long")  # noqa: E731  exact: the operands are far below 2**53
    return shifted * 365 + div(shifted, 4) - div(shifted, 100) + div(shifted, 400) + div(month * 153 + 2, 5) + d - 1 - 719468


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def to_utc(wall_us: Column, zone: Column) -> Column:
    """Microseconds of the wall clock in a zone to microseconds in UTC; java.time takes the earlier of two and the offset before a gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall_us), zone))


def iso_date(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")


def iso_instant(us: Column) -> Column:
    days = F.floor(us / DAY_US).cast("long")
    rest = us - days * DAY_US
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    sec = F.expr("0").cast("long") + F.floor(rest / 1_000_000).cast("long")
    return F.concat(iso_date(days), F.lit("T"), two(F.floor(sec / 3600)), F.lit(":"), two(F.floor(sec / 60) % 60), F.lit(":"), two(sec % 60), F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("Z"))


def normalise(df: DataFrame, cell: str, *, day_first: Column, zone: Column, as_date: bool, zones: list[str], out: str) -> DataFrame:
    """Adds the column ``out``: the normal form of ``cell``, or null.

    ``day_first`` (null: unknown) decides the order of numeric dates with the year last, ``zone``
    (null: unknown) is the zone id of wall-clock readings.  With ``as_date`` the result is a
    calendar date, in UTC only where the text has an offset, Z or Unix time.
    """
    p = lambda name: F.nullif(F.col("`#p`")[PARTS.index(name)], F.lit(""))
    num = lambda c: c.try_cast("long")
    df = with_components(df.withColumn("#df", day_first).withColumn("#zn", zone), F.col(f"`{cell}`"), "#p")
    month_no = F.coalesce(*(F.when(F.lower(p("mon")).isin(*names), F.lit(i)) for i, names in enumerate(MONTHS, 1)))
    first, second = num(p("n1")), num(p("n2"))
    hour, half = num(p("h")), F.lower(p("ap"))
    hour24 = F.when(half.isNull(), hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    offset = F.when(p("z").isNotNull(), F.lit(0)).when(
        p("oh").isNotNull() & (num(p("oh")) <= 18) & (F.coalesce(num(p("om")), F.lit(0)) < 60),
        F.when(p("sg") == "+", 1).otherwise(-1) * (num(p("oh")) * 60 + F.coalesce(num(p("om")), F.lit(0))),
    )
    bad_offset = p("oh").isNotNull() & offset.isNull()
    parts = F.struct(
        F.coalesce(num(p("y")), num(p("y2")) + 2000).alias("y"),
        F.coalesce(num(p("m")), month_no, F.when(F.col("`#df`"), second).when(~F.col("`#df`"), first)).cast("long").alias("m"),
        F.coalesce(num(p("d")), F.when(F.col("`#df`"), first).when(~F.col("`#df`"), second)).alias("d"),
        hour24.alias("h"), num(p("mi")).alias("mi"), F.coalesce(num(p("s")), F.lit(0)).cast("long").alias("s"),
        F.coalesce(num(F.rpad(F.substring(p("f"), 1, 6), 6, "0")), F.lit(0)).cast("long").alias("f"),
        p("h").isNotNull().alias("timed"), offset.cast("long").alias("off"), bad_offset.alias("bad"),
        F.upper(p("ab")).alias("ab"), p("zid").alias("zid"), p("unix").alias("unix"),
        num(p("days")).alias("days"), F.rpad(p("dayf"), 15, "0").alias("dayf"),
    )
    df = bind(df, "#c", F.when(F.col("`#p`").isNotNull(), parts))
    c = lambda name: F.col("`#c`")[name]
    valid_day = c("y").between(1, 9999) & c("m").between(1, 12) & (c("d") >= 1) & (c("d") <= _month_length(c("y"), c("m")))
    valid_time = ~c("timed") | (c("h").between(0, 23) & c("mi").between(0, 59) & c("s").between(0, 59))
    days = F.when(valid_day & valid_time & ~c("bad"), civil_days(c("y"), c("m"), c("d")))
    clock = F.when(c("timed"), ((c("h") * 60 + c("mi")) * 60 + c("s")) * 1_000_000 + c("f")).otherwise(F.lit(0).cast("long"))
    # a Unix time's unit follows from its length; what is behind the microsecond is cut
    digits = F.length(c("unix"))
    unix = F.when(digits == 10, num(c("unix")) * 1_000_000 + c("f")).when(digits == 13, num(c("unix")) * 1000 + F.floor(c("f") / 1000)).when(digits == 16, num(c("unix"))).when(digits == 19, F.floor(num(F.substring(c("unix"), 1, 16))))
    df = bind(df, "#d", F.struct(F.coalesce(days, F.when(c("days").isNotNull(), c("days") - 25569)).alias("day"), clock.alias("clock"), unix.cast("long").alias("unix"), F.floor(num(c("dayf")) * 864 / 10_000_000).cast("long").alias("dayf")))
    day, wall = F.col("`#d`.day"), F.col("`#d`.day") * DAY_US + F.col("`#d`.clock") + F.coalesce(F.col("`#d`.dayf"), F.lit(0))
    exact = F.when(c("off").isNotNull(), wall - c("off") * 60_000_000).when(c("ab").isin("UTC", "UT", "GMT"), wall)
    if as_date:
        result = F.when(F.col("`#d`.unix").isNotNull(), iso_date(F.floor(F.col("`#d`.unix") / DAY_US))).when(c("off").isNotNull(), iso_date(F.floor(exact / DAY_US))).otherwise(iso_date(day))
    else:
        site = F.when(F.col("`#zn`").isin(*zones), F.col("`#zn`"))
        named = F.when(c("zid").isin(*zones), c("zid"))
        lag = lambda month: (lambda t: t - to_utc(t, site))(civil_days(c("y"), F.lit(month), F.lit(1)) * DAY_US)
        df = bind(df, "#l", F.when(c("ab").isNotNull(), F.struct(F.least(lag(1), lag(7)).alias("low"), F.greatest(lag(1), lag(7)).alias("high"))))
        low, high = F.col("`#l`.low"), F.col("`#l`.high")
        daylight = F.when(low < high, high).otherwise(low + 3_600_000_000)
        local = (
            F.when(c("zid").isNotNull(), to_utc(wall, named))
            .when(c("ab").isin(*DAYLIGHT), wall - daylight)
            .when(c("ab").isin(*STANDARD), wall - low)
            .when(c("ab").isNull(), to_utc(wall, site))
        )
        df = bind(df, "#us", F.coalesce(F.col("`#d`.unix"), exact, local))
        result = iso_instant(F.col("`#us`"))
    return df.withColumn(out, result).drop("#p", "#df", "#zn", "#c", "#d", "#l", "#us")


def normalise_punches(punches: DataFrame, sites: DataFrame, zones: list[str]) -> DataFrame:
    """(punch_id, field, normal) of both clock columns; the cells are unpivoted first, so the expression is planned once."""
    cells = punches.select("punch_id", "site_code", F.explode(F.array(F.struct(F.lit("clock_in").alias("field"), F.col("clock_in").alias("cell")), F.struct(F.lit("clock_out").alias("field"), F.col("clock_out").alias("cell")))).alias("x")).select("punch_id", "site_code", "x.field", "x.cell").where("cell is not null")
    cells = cells.join(sites.select("site_code", "zone_id", "numeric_order"), "site_code", "left")
    return normalise(cells, "cell", day_first=F.col("numeric_order") == "DMY", zone=F.col("zone_id"), as_date=False, zones=zones, out="normal").select("punch_id", "field", "normal")


def found(spark: SparkSession, punches: DataFrame, sites: DataFrame, showcase: DataFrame, terms: DataFrame) -> DataFrame:
    """p1_found: one row for each cell that can be read."""
    zones = known_zones(spark)
    a = normalise_punches(punches, sites, zones).select(F.lit("datetime_punches").alias("tbl"), "field", F.col("punch_id").alias("row_key"), "normal")
    none = F.lit(None).cast("string")
    b = normalise(showcase.select("rec_id", "region", "signup_date"), "signup_date", day_first=F.coalesce(F.col("region") != "US", F.lit(True)), zone=none, as_date=True, zones=zones, out="normal")
    b = b.select(F.lit("showcase").alias("tbl"), F.lit("signup_date").alias("field"), F.col("rec_id").alias("row_key"), "normal")
    c = normalise(terms.select("term_id", "started_on"), "started_on", day_first=F.lit(True), zone=none, as_date=True, zones=zones, out="normal")
    c = c.select(F.lit("date_terms").alias("tbl"), F.lit("started_on").alias("field"), F.col("term_id").alias("row_key"), "normal")
    return a.unionByName(b).unionByName(c).where("normal is not null")
