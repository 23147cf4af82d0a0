"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}\x{85}]"
#: Venues whose slug follows from words in their name.
VENUE_RULES = {"sidney-and-matilda": ("sidney", "matilda"), "yellow-arch": ("yellow", "arch")}
#: Labels of the canonical fields.
FIELD_LABELS = {
    "name": "Name",
    "venue_slug": "Venue slug",
    "start_at": "Start",
    "end_at": "End",
    "genre": "Genre",
    "status": "Status",
    "description": "Description",
    "source_name": "Source name",
    "source_url": "Source URL",
}
#: The phrases that name an import run in notes, in order of priority.
RUN_PHRASES = ("manual ingest run ", "import run ")


#: What _SPACE stands for, one by one.
_WHITE = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(x, F.lit(_WHITE))


def collapse(x: Column) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.trim(F.regexp_replace(x, rf"{_SPACE}++", " "))


def folded(x: Column) -> Column:
    return F.lower(collapse(x))


def same_word(x: Column, word: str) -> Column:
    """Whether a text is ``word``, of plain letters, in any case by simple folding: of other letters the long s
    and the Kelvin sign alone fold to plain ones, and lower() leaves the former."""
    return F.translate(F.lower(x), "ſ", "s") == word.lower()


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def venue_slug(x: Column) -> Column:
    """slug(), but for names that the rules know."""
    low, out = F.lower(trim(x)), slug(trim(x))
    for name, words in reversed(VENUE_RULES.items()):
        known = F.lit(True)
        for w in words:
            known = known & low.contains(w)
        out = F.when(known, F.lit(name)).otherwise(out)
    return out


def first_non_empty(*xs: Column) -> Column:
    """The first that is more than white space, trimmed; else ''."""
    return F.coalesce(*(F.nullif(trim(x), F.lit("")) for x in xs), F.lit(""))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"<[^<>]++>", " ")


def blank_label(x: Column) -> Column:
    return F.when(trim(x) == "", F.lit("(blank)")).otherwise(x)


def origin_label(origin: Column) -> Column:
    return F.when(origin == "seed", "Seed data").when(origin == "test", "Test data").when(origin == "dev", "Development data").otherwise("")


def candidate_count_label(n: Column) -> Column:
    return F.when(n == 1, "New listing review - 1 candidate").otherwise(F.concat(F.lit("Duplicate review - "), n.cast("string"), F.lit(" candidates")))


def field_label(field: Column) -> Column:
    """The label of a canonical field; another name is its own label."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FIELD_LABELS.items() for x in pair)), field), field)


def strict_id(path: Column, prefix: str) -> Column:
    """The positive id that alone follows ``prefix`` in a path, in plain digits; else null."""
    rest = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))
    found = F.when(rest.rlike(r"\A[0-9]+\z"), rest.try_cast("bigint"))
    return F.when(found > 0, found)


def count_label(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def origin_run_id(notes: Column) -> Column:
    """The positive run id that notes name, by the first phrase that has one; else null."""
    def by(phrase: str) -> Column:
        found = F.regexp_extract_all(notes, F.lit(phrase + "([0-9]+)(?![0-9A-Za-z])"), F.lit(1))
        ids = F.filter(F.transform(found, lambda x: x.try_cast("bigint")), lambda x: x > 0)
        return F.try_element_at(ids, F.lit(1))

    return F.coalesce(*(by(p) for p in RUN_PHRASES))


def _part(x: Column) -> Column:
    return F.concat(F.octet_length(x).cast("string"), F.lit(":"), x, F.lit("\0"))


def candidate_fingerprint(*fields: Column) -> Column:
    """Content hash of a candidate: external id, name, venue slug, start, end, genre, status, description."""
    return F.sha2(F.concat(*(_part(F.coalesce(x, F.lit(""))) for x in (F.lit("review-stage-candidate:v1"), *fields))), 256)


def staging_key(fingerprints: Column) -> Column:
    """Key of a group from its members' fingerprints (array), in any order."""
    parts = F.array_join(F.transform(F.array_sort(fingerprints), _part), "")
    return F.concat(F.lit("v1:"), F.sha2(F.concat(_part(F.lit("review-stage-group:v2")), parts), 256))
