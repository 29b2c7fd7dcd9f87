"""Street-like names as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes and directions, whole-name corrections.
SUFFIX = {
    "aly": "aly", "alley": "aly", "ave": "ave", "avenue": "ave", "av": "ave", "blvd": "blvd", "boulevard": "blvd",
    "cir": "cir", "circle": "cir", "cirs": "cir", "ct": "ct", "court": "ct", "cts": "ct", "dr": "dr", "drive": "dr", "drs": "dr",
    "ln": "ln", "lane": "ln", "mall": "mall", "pass": "pass", "pl": "pl", "place": "pl", "plz": "plz", "plaza": "plz",
    "rd": "rd", "road": "rd", "rds": "rd", "rdg": "rdg", "ridge": "rdg", "run": "run", "sq": "sq", "square": "sq",
    "st": "st", "street": "st", "str": "st", "ter": "ter", "terrace": "ter", "terr": "ter", "trl": "trl", "trail": "trl",
    "way": "way", "xing": "xing", "crossing": "xing", "byp": "byp", "bypass": "byp", "hwy": "hwy", "highway": "hwy", "pkwy": "pkwy", "parkway": "pkwy",
}
DIRECTION = {
    "n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w",
    "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se", "southeast": "se", "sw": "sw", "southwest": "sw",
}
NAME_FIXES = {
    "bicenntennial trail": "bicentennial trail",
    "deerfield": "deerfield trail",
    "s main sts": "s main st",
    "smithfield road trail underpass": "smithfield road trail",
    "hethwood trail underpass": "hethwood trail",
}


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The value of a key in a literal map; null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), key)


def tokens(raw: Column) -> Column:
    """Lower-cased words, punctuation counting as space; a null or blank text has none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.filter(F.split(plain, " "), lambda t: t != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(raw: Column, fixes: Mapping[str, str] = NAME_FIXES) -> Column:
    """struct(display, normalized): a direction is taken from the front or else the back, then a suffix from the back; the
    normal form is core, suffix, direction. Without any word both are null; a name that is only one word stays as it is."""

    def ends(toks: Column) -> Column:
        several = F.size(toks) > 1
        return F.struct(toks.alias("toks"), F.when(several, lookup(DIRECTION, F.element_at(toks, 1))).alias("head"), F.when(several, lookup(DIRECTION, F.element_at(toks, -1))).alias("tail"))

    def rest(e: Column) -> Column:
        toks, n = e["toks"], F.size(e["toks"]) - 1
        left = F.when(e["head"].isNotNull(), F.slice(toks, F.lit(2), n)).when(e["tail"].isNotNull(), F.slice(toks, F.lit(1), n)).otherwise(toks)
        return F.struct(F.coalesce(e["head"], e["tail"]).alias("direction"), left.alias("left"))

    def ending(r: Column) -> Column:
        return F.struct(r["direction"].alias("direction"), r["left"].alias("left"), F.when(F.size(r["left"]) > 1, lookup(SUFFIX, F.element_at(r["left"], -1))).alias("suffix"))

    def forms(r: Column) -> Column:
        core = F.when(r["suffix"].isNotNull(), F.slice(r["left"], F.lit(1), F.size(r["left"]) - 1)).otherwise(r["left"])
        normal = F.concat_ws(" ", F.array_join(core, " "), r["suffix"], r["direction"])
        shown = F.concat_ws(" ", F.upper(r["direction"]), F.array_join(F.transform(core, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " "), F.initcap(r["suffix"]))
        some = r["left"] != F.array(F.lit(""))
        return F.struct(F.when(some, shown).alias("display"), F.when(some, normal).alias("normalized"))

    toks = _once(F.array_join(tokens(raw), " "), lambda joined: F.split(F.coalesce(lookup(fixes, joined), joined), " "))
    return _once(_once(_once(_once(toks, ends), rest), ending), forms)


def compose(*parts: Column) -> Column:
    """Parts that are not blank, trimmed, with a space between."""
    return F.concat_ws(" ", *(F.when(F.trim(p.cast("string")) != "", F.trim(p.cast("string"))) for p in parts))


def canonical(raw: Column, exact: Mapping[str, str], known: list[str]) -> Column:
    """Exact alias first, then a known name whatever its case, then the text as it is."""
    return F.coalesce(lookup(exact, raw), lookup({k.upper(): k for k in known}, F.upper(raw)), raw)


def without_endings(raw: Column, endings: list[str]) -> Column:
    """The text without any of these words at its end, however often."""
    return F.regexp_replace(raw, "( (" + "|".join(endings) + "))+$", "")
