"""Names and titles as column expressions: squashed forms, spelling variants, case, parts of a page title, sentences, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.linkage import fold
from tessera.operators.sequences import let

#: Spellings of a folded title taken as one; numbers up to twelve by their figures.
VARIANTS = (("wanna", "want to"), ("gonna", "goin to"), ("gotta", "got to"), ("gimme", "give me"), ("mister", "mr"), ("missus", "mrs"), ("saint", "st"), ("n", "and"), ("til", "until"), ("till", "until"))
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve".split()
#: Words of a title that stay small inside it.
SMALL = "a an and as at but by for from in into nor of on or the to with".split()
#: Licence classes by the first pattern that a licence's name has.
LICENCES = (("public domain", r"(?i)public domain|\bpd\b|cc0"), ("noncommercial", r"(?i)\bnc\b|non.?commercial"), ("no derivatives", r"(?i)\bnd\b|no.?deriv"), ("share alike", r"(?i)by-sa|share.?alike|gfdl"), ("attribution", r"(?i)\bcc[ -]by\b|attribution"))


def drop_g(folded: Column) -> Column:
    """Words in -ing as in -in."""
    return F.regexp_replace(folded, r"ing\b", "in")


def squash(folded: Column) -> Column:
    return F.replace(drop_g(folded), F.lit(" "), F.lit(""))


def squash_loose(folded: Column) -> Column:
    """squash() with every "ing" as "in", inside run-together words too."""
    return F.replace(squash(folded), F.lit("ing"), F.lit("in"))


def with_variants(folded: Column) -> Column:
    words = [*VARIANTS, *((w, str(i)) for i, w in enumerate(NUMBERS))]
    return reduce(lambda x, v: F.regexp_replace(x, rf"\b{v[0]}\b", v[1]), words, folded)


def title_keys(folded: Column) -> Column:
    """The squashed forms of a folded title, as it is and with variants."""
    return F.filter(F.array_distinct(F.array(squash(folded), squash(with_variants(folded)))), lambda k: k != "")


def same_title(a: Column, b: Column) -> Column:
    return F.arrays_overlap(title_keys(fold(a)), title_keys(fold(b)))


def acronym(folded: Column) -> Column:
    """First letters of the words but "and"."""
    words = F.filter(F.split(folded, " "), lambda w: (w != "and") & (w != ""))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def names_by_acronym(a: Column, b: Column) -> Column:
    """Either squashed name of three letters or more is the other's acronym."""
    short = lambda x, y: let(F.replace(x, F.lit(" "), F.lit("")), lambda s: (F.length(s) >= 3) & (s == acronym(y)))
    return short(a, b) | short(b, a)


def title_case(title: Column) -> Column:
    """Words with a capital, but for the small ones that are neither first nor last."""

    def of(words: Column) -> Column:
        inner = lambda w, i: (i > 0) & (i < F.size(words) - 1) & F.lower(w).isin(SMALL)
        return F.array_join(F.transform(words, lambda w, i: F.when(inner(w, i), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w))))), " ")

    return let(F.split(title, " "), of)


def slug(text: Column) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit("-"))


def display_name(text: Column) -> Column:
    """A file-like name as words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(text, r"[_\-\s]+", " ")))


def disambiguator(page: Column) -> tuple[Column, Column]:
    """A page's title without the bracketed part at its end, and that part ('' if there is none)."""
    pattern = r"(?s)^(.*?)\s*\(([^()]*)\)\s*$"
    return F.when(page.rlike(pattern), F.regexp_extract(page, pattern, 1)).otherwise(page), F.regexp_extract(page, pattern, 2)


def sides(cell: Column) -> Column:
    """The titles of a double A-side, quoted with a slash between; one if there are no two."""
    parts = F.filter(F.split(cell, r'"\s*/\s*"'), lambda p: F.trim(p) != "")
    return let(parts, lambda p: F.when(F.size(p) >= 2, p).otherwise(F.array(cell)))


def unquote(title: Column) -> Column:
    """What stands between a title's outer quotes, without a bracketed note after them."""
    plain = F.translate(F.trim(title), "“”", '""')
    inner = F.trim(F.regexp_extract(plain, r'^"(.*)"(\s*\([^()]*\))?\s*$', 1))
    return F.when(inner != "", inner).otherwise(F.trim(F.regexp_replace(plain, r'^"+|"+$', "")))


def sentences(text: Column) -> Column:
    """Runs that end with . ! or ? before white space or the end."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def fits(text: Column, words_per_second: float, seconds: float) -> Column:
    """Whether a text can be spoken in the time."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) / words_per_second <= seconds


def acts(credit: Column) -> Column:
    """The acts that a credit names, in order."""
    parts = F.split(F.regexp_replace(credit, r"(?i)\s+(featuring|feat\.?|ft\.?|with|and|vs\.?|x)\s+|\s*[&,;+/]\s*", "\x1f"), "\x1f")
    return F.array_distinct(F.filter(F.transform(parts, lambda a: F.trim(a)), lambda a: a != ""))


def licence_class(name: Column) -> Column:
    """The class of the first pattern that holds, else 'other'."""
    return reduce(lambda rest, k: F.when(name.rlike(k[1]), F.lit(k[0])).otherwise(rest), reversed(LICENCES), F.lit("other"))


def attribution(author: Column, licence: Column, source: Column) -> Column:
    """Author, licence and source that are there, as one line."""
    part = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.concat_ws(", ", F.coalesce(part(author), F.lit("unknown author")), part(licence), part(source))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits. In halves of 32 bits, as longs have no wrapping product."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda h, x: F.struct(h.cast("long").alias("h"), x.cast("long").alias("l"))

    def step(s: Column, digits: Column) -> Column:  # times 2**40 + 435
        mixed = s["l"].bitwiseXOR(F.conv(digits, 16, 10).cast("long"))
        return let(mixed, lambda x: pair(low(s["h"] * 435 + F.shiftright(x * 435, 32) + F.shiftleft(x, 8)), low(x * 435)))

    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("..")  , 0)
    end = F.aggregate(digits, pair(F.lit(0xCBF29CE4), F.lit(0x84222325)), step, lambda s: F.concat(F.lpad(F.hex(s["h"]), 8, "0"), F.lpad(F.hex(s["l"]), 8, "0")))
    return F.lower(end)
