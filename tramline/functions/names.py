"""Names of places and services: normal forms, qualifiers, labels, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed palette by passenger-facing service class; other rail has the last colour.
COLOURS = (
    (("IC", "EC", "RJ", "rj", "LE", "SC", "AEx"), "b91c1c"),
    (("R", "Ex", "Rx"), "b45309"),
    (("Os", "Sp", "TL", "TLX", "LET"), "1c1745"),
    (("NJ", "EN", "ES"), "4c1d95"),
)
OTHER_COLOUR = "475569"
#: Words that tell a place from its neighbour, and so never go in a fuzzy match.
SIDES = ("ost", "west", "nord", "sud", "mitte", "vychod", "zapad", "sever", "jih", "stred", "vychod", "centrum", "juh", "wschodni", "zachodni", "polnocny", "poludniowy", "centralny")
#: Longest label of an end.
LABEL = 20

_ACCENTED = "áàâäãåąăčćçďđéèêëěęíìîïľĺłňńñóòôöőõřŕšśşťţúùûüůűýÿžźż"
_PLAIN = "aaaaaaaacccddeeeeeeiiiilllnnnoooooorrsssttuuuuuuyyzzz"


def normal(name: Column) -> Column:
    """Lower case, no accents, sharp s as ss, and runs of other characters than letters and digits as one blank."""
    plain = F.translate(F.lower(name), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def cleaned(name: Column) -> Column:
    """The normal form without parentheses and operational suffixes."""
    bare = F.regexp_replace(name, r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(normal(bare), r"\b(?:hl n|hlavni nadrazi|hbf|bf|gl|glowny|zast|zastavka|vyh|vyhybna|odb|odbocka|os n|n)$", ""))


def sides(normal_name: Column) -> Column:
    """The words of a normal form that tell sides, sorted."""
    return F.array_sort(F.array_intersect(F.split(normal_name, " "), F.array(*[F.lit(s) for s in dict.fromkeys(SIDES)])))


def label(name: Column, size: int = LABEL) -> Column:
    """At most so many characters, the last one then a dot."""
    return F.when(F.length(name) > size, F.concat(F.rtrim(F.substring(name, 1, size - 1)), F.lit("."))).otherwise(name)


def colour(category: Column) -> Column:
    out = F.lit(OTHER_COLOUR)
    for names, value in reversed(COLOURS):
        out = F.when(category.isin(*names), value).otherwise(out)
    return out
