"""Addresses: references resolved against a base, as RFC 3986 says in section 5.2, by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a reference, each with the mark that tells it apart (RFC 3986, appendix B).
_PARTS = r"\A([A-Za-z][A-Za-z0-9+.-]*+:)?(//[^/?#]*+)?([^?#]*+)(\?[^#]*+)?(#.*+)?\z"
_NAMES = ("scheme", "authority", "path", "query", "fragment")
#: What an authority may be: a host, or an address in brackets, and a port.
_AUTHORITY = r"\A//(?:[^@\[\]]*+@)?(?:\[[0-9A-Fa-f:.]++\]|[^\[\]:@]*+)(?::([0-9]*+))?\z"


def parts(x: Column) -> Column:
    """scheme, authority, path, query and fragment with their marks, '' for those that are not there."""
    return F.struct(*(F.regexp_extract(x, _PARTS, i).alias(n) for i, n in enumerate(_NAMES, 1)))


def without_dots(path: Column) -> Column:
    """``path`` without its . and .. segments: each segment is put on a stack, and .. takes one off."""
    segments = F.split(path, "/")
    rooted = path.startswith("/")
    # The first segment of a rooted path is the empty one before its slash, which .. never takes off.
    named = F.when(rooted, F.slice(segments, F.lit(2), F.size(segments))).otherwise(segments)
    empty = F.slice(segments, 1, 0)

    def step(stack: Column, s: Column) -> Column:
        return F.when(s == ".", stack).when(s == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s)))

    kept = F.aggregate(named, empty, step)
    # A path that ends in a dot segment ends in a slash.
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(~path.contains("."), path).otherwise(F.concat(F.when(rooted, "/").otherwise(""), F.array_join(closed, "/")))


def well_formed(x: Column) -> Column:
    """Whether a text can be a reference: no control characters, whole percent codes in its path, a colon in its
    first segment only after a scheme, and a host and port that can be."""
    p = parts(x)
    port = F.regexp_extract(p["authority"], _AUTHORITY, 1)
    host = (p["authority"] == "") | (p["authority"].rlike(_AUTHORITY) & ((F.length(port) < 6) & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)))
    before = F.regexp_extract(x, r"\A[^?#]*+", 0)
    scheme = ~F.regexp_extract(x, r"\A[^/?#]*+", 0).contains(":") | (p["scheme"] != "")
    return ~x.rlike(r"[\x00-\x1f\x7f]") & ~before.rlike("%(?![0-9A-Fa-f]{2})") & scheme & host


def resolved(base: Column, reference: Column) -> Column:
    """``reference``, without white space around it, as a whole address; null if it or ``base`` is none."""
    ref = F.btrim(reference)
    made = F.get(F.transform(F.array(F.struct(parts(base).alias("b"), parts(ref).alias("r"))), _joined), F.lit(0))
    return F.when(well_formed(base) & well_formed(ref), made)


def _joined(x: Column) -> Column:
    b, r = x["b"], x["r"]
    own_scheme, own_host, own_path = r["scheme"] != "", r["authority"] != "", r["path"] != ""
    folder = F.regexp_extract(b["path"], r"\A.*/", 0)
    merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    path = F.when(own_scheme | own_host | r["path"].startswith("/"), without_dots(r["path"])).when(~own_path, b["path"]).otherwise(without_dots(merged))
    scheme = F.lower(F.when(own_scheme, r["scheme"]).otherwise(b["scheme"]))
    authority = F.when(own_scheme | own_host, r["authority"]).otherwise(b["authority"])
    query = F.when(own_scheme | own_host | own_path | (r["query"] != ""), r["query"]).otherwise(b["query"])
    return F.concat(scheme, authority, path, query, r["fragment"])
