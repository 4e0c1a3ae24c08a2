"""Tokenisers and text keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with")


def camel_split(s: Column) -> Column:
    """A hyphen between aB and between the letters of ABc."""
    return F.regexp_replace(s, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-")


def ascii_words(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z0-9_-]*"), F.lit(0))


def compact(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^a-z0-9]", "")


def lexical_terms(s: Column) -> Column:
    """Distinct lower-case terms of two letters or more, sorted."""
    words = F.regexp_extract_all(F.regexp_replace(s, r"(?<=[a-z])(?=[A-Z])", " "), F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= 2)))


def query_terms(s: Column) -> Column:
    """Terms of a query: split at case, lower-case, without stop words, plurals with their stem."""
    words = F.transform(ascii_words(camel_split(s)), lambda w: F.regexp_replace(F.lower(w), "_", "-"))
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "-")))
    good = F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(good, F.filter(F.transform(good, singular), lambda w: F.length(w) >= 2))))


def identifier_words(s: Column) -> Column:
    """Words of letters and digits, split at case boundaries, lower-case, in order."""
    split = F.regexp_replace(F.regexp_replace(s, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.transform(F.regexp_extract_all(split, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)


def singular(w: Column) -> Column:
    """ies to y in words over 5 letters; a last s goes from words over 4, but not of ss."""
    return (
        F.when((F.length(w) > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def inflections(w: Column) -> Column:
    """-s, -es, -ed, -ing; a last consonant behind a vowel doubled (not w, x, y); a last e dropped. Words of letters, three
    or more, alone."""
    none = F.array().cast("array<string>")
    double, stem = F.concat(w, F.substring(w, -1, 1)), F.regexp_replace(w, "e$", "")
    plain = F.array(*[F.concat(w, F.lit(x)) for x in ("s", "es", "ed", "ing")])
    doubled = F.when(w.rlike("[aeiou][^aeiouwxy]$"), F.array(F.concat(double, F.lit("ed")), F.concat(double, F.lit("ing")))).otherwise(none)
    dropped = F.when(w.endswith("e"), F.array(F.concat(w, F.lit("d")), F.concat(stem, F.lit("ing")))).otherwise(none)
    return F.when(w.rlike("^[a-z]{3,}$"), F.concat(plain, doubled, dropped)).otherwise(none)


def slug(s: Column, most: int = 96) -> Column:
    """Singular ASCII words, split where a small letter or digit meets a capital, joined by hyphens; none at the ends of what
    is cut; 'unnamed' for none."""
    words = F.regexp_extract_all(F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])|[_-]", " "), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    joined = F.array_join(F.transform(words, lambda w: singular(F.lower(w))), "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(joined, 1, most), "^-+|-+$", ""), F.lit("")), F.lit("unnamed"))


def natural_key(s: Column) -> Column:
    """A key under which digit runs order by value, however long: each becomes its number of digits, without leading
    zeros, and those digits (the raw text breaks ties)."""
    runs = F.regexp_extract_all(s, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x)), "")


def name_tokens(s: Column) -> Column:
    """Lower-case ASCII runs of letters and digits, in order, parted where a small letter meets a capital."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(s, "(?<=[a-z])(?=[A-Z])", " "), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def holds_longest(name: Column, phrase: Column) -> Column:
    """The cheap necessary condition of a phrase: its longest word, first of equals, stands somewhere, case aside. A word beyond ASCII
    proves nothing and passes."""
    word = F.reduce(phrase, F.lit(""), lambda best, w: F.when(F.octet_length(w) > F.octet_length(best), w).otherwise(best))
    return word.rlike("[^\\x00-\\x7F]") | F.contains(F.lower(name), F.lower(word))


def fold_key(s: Column) -> Column:
    """One key for all case forms of each letter, final sigma too: lower case of upper case, letter by letter, where both are
    single letters."""
    low = lambda c: F.lower(F.substring(F.upper(c), 1, 1))  # noqa: E731 the optimiser would make lower(upper(c)) lower(c)
    one = lambda c: F.when((F.length(F.upper(c)) == 1) & (F.length(low(c)) == 1), low(c)).otherwise(c)
    return F.array_join(F.transform(F.split(s, ""), one), "")


def python_lower(s: Column) -> Column:
    return F.lower(F.replace(s, F.lit("\u0130"), F.lit("i\u0307")))


def bounded_line(s: Column, most: int = 200) -> Column:
    """At most ``most`` bytes; a longer line is cut between letters and ends in three dots."""
    raw = s.cast("binary")
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
    cut = F.lit(most - 6)
    for k in (most - 5, most - 4, most - 3):
        cut = F.when(~inside(k), F.lit(k)).otherwise(cut)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit("...")))


def definition_line(text: Column, identifier: Column) -> Column:
    """The number of the line that defines an identifier: the first that it leads (with a full stop or a colon behind it)
    after a blank line, a heading or the start; else the first that it leads elsewhere; else its first table row; else 0."""
    lines = F.split(text, "\n")
    quoted = F.concat(F.lit("\\Q"), identifier, F.lit("\\E"))
    lead = F.concat(F.lit("^\\s*(?:[-*]\\s+)?(?:\\*\\*)?`?"), quoted, F.lit("`?(?:\\.(?:\\*\\*)?\\s|(?:\\*\\*)?\\s*:)"))
    row = F.concat(F.lit("^\\s*\\|\\s*`?"), quoted, F.lit("`?[\\s|.]"))
    free = F.transform(lines, lambda x, i: F.regexp_like(x, lead) & ((i == 0) | F.coalesce(F.get(lines, i - 1), F.lit("")).rlike("^\\s*(#.*)?$")))
    at = lambda found: F.coalesce(F.nullif(F.array_position(found, F.lit(True)), F.lit(0)), F.lit(None).cast("long"))
    hits = lambda shape: F.transform(lines, lambda x: F.regexp_like(x, shape))
    return F.coalesce(at(free), at(hits(lead)), at(hits(row)), F.lit(0).cast("long"))


def path_references(s: Column) -> Column:
    """Chains of two path segments or more."""
    return F.regexp_extract_all(s, F.lit(r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"), F.lit(0))


def requirement_ids(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\b[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-\d+\b"), F.lit(0))


def import_specifiers(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"""(?<!\w)(?:from|import)\s*["']([^"']+)["']"""), F.lit(1))


def holds_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words hold the phrase as a run of whole words."""
    glue = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(glue(words), glue(phrase))


def glob(pattern: str) -> str:
    """A path glob as an anchored regular expression: * stays in a segment, ** spans any number of segments."""
    import re

    out, parts = "", pattern.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += re.escape(part).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + ("" if last else "/")
    return f"^{out}$"


def python_strip(s: Column) -> Column:
    """Trim Unicode white space and the separators U+001C to U+001F."""
    space = r"[\s   -     　\u0085\u001c-\u001f]+"
    return F.regexp_replace(F.regexp_replace(s, "^" + space, ""), space + "$", "")


def percent_unescape(s: Column) -> Column:
    """What percent_escape wrote; null for what it can't have written."""
    out = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return F.when(percent_escape(out) == s, out)


def percent_escape(s: Column) -> Column:
    """%, : and ASCII controls as %XX."""
    out = F.regexp_replace(s, "%", "%25")
    for code in (*range(0x20), 0x7F, 0x3A):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out
