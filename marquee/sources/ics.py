"""Calendars read in SQL: parse_ics() of marquee.sources.extract as Column expressions, without Python.

A calendar's state machine needs no state: after BEGIN:VEVENT an event is open, after END:VEVENT it is not, so
what a mark means follows from the mark before it. An event is the lines between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import trim
from marquee.functions.time import ZONE, from_local, rfc3339

_TEXTS = ("uid", "summary", "description", "location", "url", "status")
_ORDER = ("kind", *_TEXTS, "start_at", "end_at", "reason")


def unfolded(body: Column) -> Column:
    """The lines of a calendar (binary). Empty lines go first, so that they don't end a folded line."""
    text = F.regexp_replace(F.make_valid_utf8(body.cast("string")), r"[\r\n]++", "\n")
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\A\n", ""), r"\n[ \t]", ""), "\n")


def properties(lines: Column) -> Column:
    """name, params (array of texts) and value of the lines with a colon."""

    def read(line: Column) -> Column:
        at = F.position(F.lit(":"), line)
        head = F.split(F.substring(line, F.lit(1), at - 1), ";")
        return F.struct(F.upper(trim(F.get(head, F.lit(0)))).alias("name"), F.slice(head, F.lit(2), F.size(head)).alias("params"), F.substring(line, at + 1, F.length(line)).alias("value"))

    return F.transform(F.filter(lines, lambda x: x.contains(":")), read)


def _mark(p: Column) -> Column:
    return p["name"].isin("BEGIN", "END") & (F.upper(trim(p["value"])) == "VEVENT")


def unescaped(value: Column) -> Column:
    """Escaped backslashes part the text; within the parts the other escapes stand alone."""
    own = trim(value)
    parts = F.transform(F.split(own, r"\\\\"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\\[nN]", "\n"), r"\\([,;])", "$1"))
    return F.when(own.contains("\\"), F.array_join(parts, "\\")).otherwise(own)


def _param(p: Column, name: str) -> Column:
    """The last value of a parameter, unquoted; '' if there is none."""
    own = F.filter(p["params"], lambda x: x.contains("=") & (F.upper(trim(F.substring_index(x, "=", 1))) == name))
    value = F.get(own, F.size(own) - 1)
    return F.coalesce(F.regexp_replace(trim(F.substring(value, F.position(F.lit("="), value) + 1, F.length(value))), r'\A"++|"++\z', ""), F.lit(""))


def _with_time(rows: DataFrame, p: str, name: str) -> DataFrame:
    """``rows`` with _at and _why of the time in their property ``p``: one of them is null. In steps, so that
    what is used often is worked out once."""
    own = F.col(p)
    first = rows.withColumns({f"{p}_value": trim(own["value"]), f"{p}_zone": F.when(F.size(own["params"]) > 0, _param(own, "TZID")).otherwise(""), f"{p}_kind": F.when(F.size(own["params"]) > 0, F.upper(_param(own, "VALUE"))).otherwise("")})
    value = F.col(f"{p}_value")
    parted = first.withColumn(f"{p}_plain", F.when(value.rlike("[.,]"), F.regexp_replace(value, r"(?<=[0-9])[.,][0-9]++(?=Z?\z)", "")).otherwise(value))
    plain = F.col(f"{p}_plain")
    good = plain.rlike(r"\A(?!0000)[0-9]{8}T[0-9]{4}([0-9]{2})?Z?\z")
    read = parted.withColumn(f"{p}_local", F.when(good, F.try_to_timestamp(F.rpad(F.translate(plain, "TZ", ""), 14, "0"), F.lit("yyyyMMddHHmmss"))))
    local = F.col(f"{p}_local")
    told = read.withColumn(f"{p}_at", rfc3339(F.when(plain.endswith("Z"), local).otherwise(from_local(local))))
    date = (F.col(f"{p}_kind") == "DATE") | ((F.length(value) == 8) & ~value.contains("T"))
    why = F.when(date, "all-day event").when(~F.col(f"{p}_zone").isin("", ZONE), F.concat(F.lit("unsupported timezone "), f"{p}_zone")).when(F.col(f"{p}_at").isNull(), F.concat(F.lit(f"malformed {name}: "), value))
    return told.withColumn(f"{p}_why", F.when(own.isNotNull(), why))


def events(rows: DataFrame, own: str, kept: tuple[str, ...]) -> DataFrame:
    """``kept`` and what each event, the lines in column ``own``, is: a candidate, or a skip and why. Of lines with
    one name the first counts. Rows without lines have nulls."""
    first = lambda name: F.get(F.filter(own, lambda p: p["name"] == name), F.lit(0))
    found = rows.select(*kept, F.col(own).isNotNull().alias("_is"), *(first(t.upper())["value"].alias(f"_{t}") for t in _TEXTS), first("DTSTART").alias("_start"), first("DTEND").alias("_end"))
    found = found.withColumns({f"_{t}": F.when(F.col("_is"), F.coalesce(unescaped(F.col(f"_{t}")), F.lit(""))) for t in _TEXTS})
    timed = _with_time(_with_time(found, "_start", "DTSTART"), "_end", "DTEND")
    reason = (
        F.when(F.col("_summary") == "", "missing summary")
        .when(F.upper("_status") == "CANCELLED", "cancelled")
        .when(F.col("_is") & F.col("_start").isNull(), "missing DTSTART")
        .otherwise(F.coalesce("_start_why", "_end_why"))
    )
    timed = timed.withColumn("_reason", reason)
    good = F.col("_is") & F.col("_reason").isNull()
    out = {"kind": F.when(good, "candidate").when(F.col("_is"), "skip"), "uid": F.col("_uid"), "summary": F.col("_summary"), "start_at": F.when(good, F.col("_start_at")), "end_at": F.when(good, F.coalesce("_end_at", F.lit(""))), "reason": F.col("_reason")}
    out |= {c: F.when(good, F.col(f"_{c}")) for c in ("description", "location", "url", "status")}
    return timed.select(*kept, *(out[c].alias(c) for c in _ORDER))


def ics_rows(source: DataFrame, keys: tuple[str, ...], body: str = "body") -> DataFrame:
    """``keys``, kind, ordinal, the fields and reason of each row of each calendar, as parse_ics() gives them; a null
    body gives none. Columns of ``source`` with other names are not read."""
    lines = source.filter(F.col(body).isNotNull()).select(*keys, properties(unfolded(F.col(body))).alias("_lines"))
    at = F.filter(F.transform("_lines", lambda p, i: F.when(_mark(p), F.struct((i + 1).alias("at"), p["name"].alias("name")))), lambda m: m.isNotNull())
    marked = lines.select(*keys, "_lines", at.alias("_marks"))

    def told(m: Column, k: Column) -> Column:
        before = F.get(F.col("_marks"), k - 1)
        opened = F.coalesce(before["name"] == "BEGIN", F.lit(False))
        event = F.slice(F.col("_lines"), before["at"] + 1, m["at"] - before["at"] - 1)
        error = F.when(opened & (m["name"] == "BEGIN"), "nested VEVENT").when(~opened & (m["name"] == "END"), "END:VEVENT without BEGIN:VEVENT")
        return F.when(error.isNotNull(), F.struct(error.alias("error"), none.alias("own"))).when(opened, F.struct(error.alias("error"), event.alias("own")))

    last = F.get(F.col("_marks"), F.size("_marks") - 1)
    none = F.when(F.lit(False), F.col("_lines"))
    open_end = F.when(F.coalesce(last["name"] == "BEGIN", F.lit(False)), F.struct(F.lit("unterminated VEVENT").alias("error"), none.alias("own")))
    found = F.filter(F.concat(F.transform("_marks", told), F.array(open_end)), lambda x: x.isNotNull())
    rows = marked.select(*keys, F.posexplode(found).alias("_ordinal", "_found")).select(*keys, "_ordinal", F.col("_found.error").alias("_error"), F.col("_found.own").alias("_own"))
    read = events(rows, "_own", (*keys, "_ordinal", "_error"))
    own = {"kind": F.coalesce("kind", F.lit("error")), "reason": F.coalesce("_error", "reason")}
    return read.select(*keys, own["kind"].alias("kind"), F.col("_ordinal").alias("ordinal"), *(own.get(c, F.col(c)).alias(c) for c in _ORDER[1:]))
