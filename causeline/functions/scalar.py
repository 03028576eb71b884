"""Column functions on words, templates, times and keys (F1, F2, F9-F16, F19-F27, W1, W5). All are built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "**"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAY = 86400

_ISO = r"^ *(\d{4}-\d{2}-\d{2}) +(\d{1,2}:\d{1,2}:\d{1,2}) +([^ ]+) *(.*?) *$"
_SYSLOG = r"^ *(?:([12]\d{3}) +)?([A-Z][a-z]{2}) +(\d{1,2}) +(\d{1,2}:\d{1,2}:\d{1,2}) +([^ ]+) *(.*?) *$"


# --- parsing ---


def header(line: Column, default_year: int) -> Column:
    """struct<dt timestamp_ntz, host, message> of a log line, null if its head can't be read (F1).

    ``YYYY-MM-DD H:M:S host message`` or ``[YYYY] Mon D H:M:S host message``; a line without a year has the default one.
    """
    line = F.regexp_replace(line, r"\n$", "")
    iso = lambda k: F.regexp_extract(line, _ISO, k)
    sys = lambda k: F.regexp_extract(line, _SYSLOG, k)
    is_iso = line.rlike(_ISO)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), sys(2))
    year = F.when(sys(1) != "", sys(1)).otherwise(F.lit(str(default_year)))
    when = F.when(is_iso, F.concat_ws(" ", iso(1), iso(2))).when(
        line.rlike(_SYSLOG) & (month > 0), F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"), sys(3), F.lit(" "), sys(4))
    )
    stamp = F.try_to_timestamp(when, F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz")
    host, message = F.when(is_iso, iso(3)).otherwise(sys(5)), F.when(is_iso, iso(4)).otherwise(sys(6))
    return F.when(stamp.isNotNull() & (message != ""), F.struct(stamp.alias("dt"), host.alias("host"), message.alias("message")))


def message_from_word(line: Column, n: int) -> Column:
    """The words of the line from number n (0 is the first) on, joined by single spaces (F2)."""
    words = F.split(F.trim(line), r"\s+")
    return F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")


def removed(message: Column, blacklist: list[str]) -> Column:
    """True if any of the substrings is in the message (P5)."""
    out = F.lit(False)
    for b in blacklist:
        out = out | F.contains(message, F.lit(b))
    return out


# --- escapes ---


def add_esc(s: Column) -> Column:
    """Backslash before backslash, * and @."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("*"), F.lit("\\*")), F.lit("@"), F.lit("\\@"))


def restore_esc(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("\\@"), F.lit("@")), F.lit("\\*"), F.lit("*")), F.lit("\\\\"), F.lit("\\"))


def split_unescaped(s: Column, separator: str = "@@") -> Column:
    """Split at the separator where it isn't escaped."""
    return F.split(s, r"(?<!\\)" + separator)


# --- templates ---


def _at(words: Column, template: Column) -> Column:
    return F.arrays_zip(words.alias("w"), template.alias("t"))


def variables(words: Column, template: Column, wildcard: str = WILDCARD) -> Column:
    """Words where the template has the wildcard."""
    return F.transform(F.filter(_at(words, template), lambda x: x["t"] == wildcard), lambda x: x["w"])


def variable_locations(template: Column, wildcard: str = WILDCARD) -> Column:
    """Positions of wildcards, from 0."""
    return F.filter(F.transform(template, lambda t, i: F.when(t == wildcard, i)), lambda i: i.isNotNull())


def merge_template(a: Column, b: Column, wildcard: str = WILDCARD) -> Column:
    """Equal words stay, others become the wildcard; as long as the shorter one (F16)."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.when(x == y, x).otherwise(wildcard))


def wildcard_equal(a: Column, b: Column, wildcard: str = WILDCARD) -> Column:
    """Same length, and at every place equal or a wildcard on either side."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: (x["a"] == x["b"]) | (x["a"] == wildcard) | (x["b"] == wildcard))


def matches_template(words: Column, template: Column, wildcard: str = WILDCARD) -> Column:
    """The template's literals are where it has them; the word ``**`` itself only fits a wildcard."""
    return (F.size(words) == F.size(template)) & F.forall(_at(words, template), lambda x: (x["t"] == wildcard) | (x["w"] == x["t"]))


def ngrams(words: Column, n: int, compat: bool = False) -> Column:
    """Runs of n words (F20). compat: without the last one."""
    last = F.size(words) - n + (0 if compat else 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(words, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def restore_message(words: Column, seps: Column) -> Column:
    """Separators and words in turn; the words alone if there are no separators."""
    full = F.array_join(F.zip_with(seps, F.concat(words, F.array(F.lit(""))), lambda s, w: F.concat(s, w)), "")
    return F.when(seps.isNull(), F.array_join(words, "")).otherwise(full)


def labelled_variable(group: Column) -> Column:
    return F.concat(F.lit("*"), group, F.lit("*"))


def replace_variables(words: Column, template: Column, groups: Column, wildcard: str = WILDCARD) -> Column:
    """At wildcards, ``*group*`` if the word has one in the map ``groups``, else the wildcard."""
    return F.transform(_at(words, template), lambda x: F.when(x["t"] != wildcard, x["t"]).when(groups[x["w"]].isNotNull(), labelled_variable(groups[x["w"]])).otherwise(wildcard))


def word_label(word: Column) -> Column:
    """IPv4ADDR, IPv6ADDR, DATE, TIME, DIGIT or OTHER; known hosts are labelled by a join."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    v4 = rf"^{octet}(\.{octet}){{3}}$"
    group = "[0-9A-Fa-f]{1,4}"
    v6 = rf"^(({group}:){{7}}{group}|(?=(.*::))(?!.*::.*::)(({group}(:|$)|:)){{1,8}}(?<!(?<!:):))$"
    return (
        F.when(word.rlike(v4), "IPv4ADDR")
        .when(word.rlike(v6) & F.contains(word, F.lit(":")), "IPv6ADDR")
        .when(word.rlike(r"^\d+$"), "DIGIT")
        .when(word.rlike(r"^(\d{2}|\d{4})[-/]\d{2}[-/]\d{2}$"), "DATE")
        .when(word.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"), "TIME")
        .otherwise("OTHER")
    )


# --- times ---


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_epoch(sec: Column) -> Column:
    return F.timestamp_add("SECOND", sec.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def floor_time(ts: Column, size: int) -> Column:
    """The multiple of ``size`` seconds since that day's midnight at or before ts."""
    s = epoch(ts)
    midnight = F.floor(s / DAY) * DAY
    return from_epoch(midnight + F.floor((s - midnight) / size) * size)


def ceil_time(ts: Column, size: int) -> Column:
    """The first such multiple at or after ts; past the day's last one, the next midnight counts as it comes."""
    s = epoch(ts)
    midnight = F.floor(s / DAY) * DAY
    return from_epoch(midnight + F.ceil((s - midnight) / size) * size)


def is_separator(ts: Column, size: int) -> Column:
    return floor_time(ts, size) == ts


def short_time(ts: Column) -> Column:
    """YYYYMMDD at midnight, else YYYYMMDD_HHMMSS."""
    return F.when(is_separator(ts, DAY), F.date_format(ts, "yyyyMMdd")).otherwise(F.date_format(ts, "yyyyMMdd_HHmmss"))


def thread_name(area: Column, top: Column) -> Column:
    return F.concat_ws("_", area, short_time(top))


# --- keys ---

EVENT_TYPES = ("normal", "periodic_top", "periodic_end", "periodic_remainder")


def event_name(gid: Column, host: Column, kind: Column, note: Column) -> Column:
    """Display form of an event key."""
    core = F.concat(F.lit("[gid="), gid.cast("string"), F.lit(", host="), host, F.lit("]"))
    tail = F.concat(F.lit("("), note.cast("string"), F.lit("sec)"))
    return F.when(kind == 0, core).when(kind == 1, F.concat(F.lit("start"), core, tail)).when(kind == 2, F.concat(F.lit("end"), core, tail)).otherwise(F.concat(F.lit("remain"), core, tail))


def power2ceil(n: Column) -> Column:
    """Smallest power of two at or above n."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("long")


_H = 3600
#: Fixed values: (whole range at most, step) of an axis in seconds, and the step beyond.
TICKS = ((180, 10), (600, 60), (1800, 180), (_H, 300), (6 * _H, 600), (DAY, 6 * _H), (7 * DAY, DAY), (14 * DAY, 2 * DAY), (60 * DAY, 7 * DAY), (300 * DAY, 20 * DAY))
LAST_TICK = 50 * DAY


def tick_step(span: Column) -> Column:
    """Seconds between the ticks of a time axis over ``span`` seconds."""
    out = F.lit(LAST_TICK)
    for most, step in reversed(TICKS):
        out = F.when(span <= most, step).otherwise(out)
    return out
