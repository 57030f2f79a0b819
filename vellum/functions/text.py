"""Text functions as Column expressions; no Python runs per row.

Lengths are code points. White space is what Java's \\s says; trimming removes it at
both ends, line breaks included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.vocabulary import ABBREVIATIONS

#: Marks in square brackets that transcribers leave in a text.
MARKS = r"\[[^\]]*\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column, spaced_and: bool = True) -> Column:
    """Lower-case words joined by dashes; `&` reads 'and', set apart or not."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and " if spaced_and else "and"), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def filler_key(c: Column) -> Column:
    """Loose key under which copies of one filler collapse."""
    return squash(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""))


def token_norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clean_lines(c: Column) -> Column:
    """Lines without bracketed marks, stripped; empty ones stay."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, MARKS, "")))


def first_line(c: Column) -> Column:
    return F.coalesce(F.get(F.filter(clean_lines(c), lambda x: x != ""), F.lit(0)), F.lit(""))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def headline_shaped(c: Column) -> Column:
    """Whether a line reads like a headline: capitals, or short, unpunctuated and title-cased."""
    words = _words(c)
    letters = F.regexp_count(c, F.lit("[A-Za-z]"))
    capitals = F.regexp_count(c, F.lit("[A-Z]"))
    last = F.regexp_replace(F.coalesce(F.get(words, F.size(words) - 1), F.lit("")), r"\.", "")
    sentence = F.endswith(c, F.lit(".")) & (F.size(words) > 4) & ~(F.lower(last).isin(*ABBREVIATIONS) | (F.length(last) <= 2))
    long = F.filter(words, lambda w: F.regexp_count(w, F.lit("[A-Za-z]")) >= 4)
    titled = F.filter(long, lambda w: w.rlike("^[^A-Za-z]*[A-Z]"))
    return (
        F.when(F.coalesce(letters, F.lit(0)) == 0, False)
        .when(capitals / letters >= 0.8, (F.size(words) <= 16) & (F.length(c) <= 120))
        .when((F.size(words) > 12) | (F.length(c) > 110) | c.rlike("[,;:]$") | sentence, False)
        .when(F.size(long) == 0, False)
        .otherwise(F.size(titled) / F.size(long) >= 0.6)
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often later expressions use them.

    Spark puts a projected expression into every place that uses it; a generator of one row
    stands in the way, at no shuffle.
    """
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def resolved_title(head: Column, stored: Column, model: Column) -> Column:
    """struct(title, title_source, title_model): a stored title, else the text's first line if it is headline-shaped."""
    own, drafter = strip(F.coalesce(stored, F.lit(""))), F.nullif(strip(F.coalesce(model, F.lit(""))), F.lit(""))
    none = F.lit(None).cast("string")
    make = lambda t, s, m: F.struct(t.alias("title"), s.alias("title_source"), m.alias("title_model"))
    return (
        F.when(own != "", make(own, F.when(drafter.isNotNull(), "machine").otherwise("human"), drafter))
        .when(headline_shaped(head), make(head, F.lit("machine"), none))
        .otherwise(make(none, none, none))
    )


def body_after_title(text: Column, title: Column) -> Column:
    """The text without its first line, if that line is the title but for case and spacing."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    cleaned = clean_lines(text)
    at = F.array_position(F.transform(cleaned, lambda x: x != ""), True)
    same = F.lower(squash(F.get(cleaned, F.greatest(at - 1, F.lit(0)).cast("int")))) == F.lower(squash(title))
    rest = F.slice(lines, at.cast("int") + 1, F.greatest(F.size(lines) - at.cast("int"), F.lit(0)))
    return strip(F.array_join(F.when((at > 0) & same & title.isNotNull(), rest).otherwise(lines), "\n"))


def title_case(c: Column) -> Column:
    """All-capital titles of more than four characters as lower case with word initials raised."""
    # An initial is a word character at the start or after a character that is none.
    raised = F.array_join(F.transform(F.split(F.lower(c), r"(?<=[^A-Za-z0-9_])(?=[a-z])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")
    return F.when((F.length(c) > 4) & (c == F.upper(c)), raised).otherwise(c)


def snippet(text: Column, title: Column, most: int = 180) -> Column:
    """The lines after a promoted headline as one string, cut at `most` with an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    norm = lambda c: F.lower(squash(F.regexp_replace(c, MARKS, "")))
    promoted = title.isNotNull() & (title != "") & (F.size(lines) > 0) & (norm(F.get(lines, F.lit(0))) == norm(title))
    rest = F.array_join(F.when(promoted, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), " ")
    full = F.coalesce(F.nullif(rest, F.lit("")), F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(full) > most, F.concat(F.regexp_replace(F.substring(full, 1, most - 3), r"\s+$", ""), F.lit("…"))).otherwise(full)


def excerpt(text: Column, most: int = 260) -> Column:
    """The text's beginning, cut at a space if one lies beyond 60 % of the length allowed."""
    flat = squash(text)
    cut = F.substring(flat, 1, most)
    space = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(space > 0.6 * most, F.substring(cut, F.lit(1), space.cast("int"))).otherwise(cut), F.lit("…")))


def edited_text(new: Column, machine: Column, most: int) -> Column:
    """A curator's text: line ends right-trimmed, capped; NULL if empty or equal to the machine's."""
    kept = F.substring(strip(F.regexp_replace(F.coalesce(new, F.lit("")), r"(?m)[ \t]+$", "")), 1, most)
    return F.when((kept != "") & ~kept.eqNullSafe(machine), kept)


def edited_title(new: Column, most: int = 300) -> Column:
    return F.nullif(F.substring(squash(F.coalesce(new, F.lit(""))), 1, most), F.lit(""))


def unquoted(c: Column) -> Column:
    """A suggestion without quotes around it or a full stop at its end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "^[\"'“”]+|[\"'“”]+$", ""), r"\.$", ""))


def html_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def clean_name(c: Column, most: int = 24) -> Column:
    return strip(F.substring(strip(F.regexp_replace(c, r"[^\p{L}\p{N} .'-]", "")), 1, most))


def serial_of(title: Column) -> Column:
    """The publication's name: what stands before the first comma."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.coalesce(F.nullif(squash(F.when(F.instr(t, ",") > 1, F.substring_index(t, ",", 1)).otherwise(t)), F.lit("")), F.lit("(untitled)"))


def year_of(sort_date: Column, date: Column) -> Column:
    digits = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1), F.lit(""))
    return F.coalesce(digits(sort_date), digits(date)).cast("int")


def initials(serial: Column, most: int = 3) -> Column:
    """Initials of a serial's name without a leading 'the'."""
    words = _words(F.regexp_replace(serial, "(?i)^the ", ""))
    return F.array_join(F.slice(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), 1, most), "")


def word_regex(alternatives: str) -> str:
    """A pattern for whole words whose boundaries are ASCII, as in engines without Unicode classes."""
    return rf"(?i)(?<![A-Za-z0-9_])({alternatives})(?![A-Za-z0-9_])"


#: Patterns that tell an object's subject; fixed values.
LOST = "lost|found|strayed|reward|stolen|missing"
MILESTONE = "married|marriage|wedding|bride|funeral|died|death of|passed away|born|birth|anniversary|engaged|engagement"
KIDS = "school|pupils?|children|boys|girls|scouts?|kiddies|juvenile|kindergarten"
SHOWS = "theat(?:er|re)|photoplay|movie|film|picture show|vaudeville|screen"
CIVIC = "council|civic|ordinance|sewer|paving|improvement association|ward|mayor|commissioners?"
PROPERTY = "lots?|bungalow|rent|for sale|acres?"
PRICE = r"\$[\d,]+(?:\.\d\d)?"


def about(c: Column, alternatives: str) -> Column:
    return c.rlike(word_regex(alternatives))


#: Fixed pattern of a printed price; boundaries are those of ASCII words.
SAYS_PRICE = r"(?i)(\$\s?\d|(?<![0-9A-Za-z_])\d+\s?(¢|cents?(?![0-9A-Za-z_]))|(?<![0-9A-Za-z_])\d+c(?![0-9A-Za-z_]))"
SAYS_PRICE_RE2 = r"(?i)(\$\s?\d|\b\d+\s?(¢|cents?\b)|\b\d+c\b)"
