"""Scalar functions: Column to Column, built-in expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import COMMERCIAL, FARMING, FARMING_WORD, INDUSTRIAL, KWH, REPAIRS, SIMPLE, SPAN, TRUE_WORDS, u


#: Never part of a text (a noncharacter): stands between groups of a match.
BETWEEN = "\uffff"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, u(r"^\s+|\s+$"), "")


def none_if_empty(c: Column) -> Column:
    """The value, evaluated once (nullif evaluates it twice)."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once.

    What f makes is interpreted instead of compiled. Many patterns in one row are
    best evaluated so: compiled, they are methods beyond the size (8,000 bytes)
    up to which the JVM optimises them, and all their time is in the patterns.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_one_group(pattern: str) -> bool:
    """Whether a pattern is a single group from its first character to its last, which is no other pattern without it."""
    bare = re.sub(r"\\\D|\[[^\]]*\]", "", pattern)
    return re.fullmatch(r"\((?!\?)(?:[^()\\]|\(\?(?:[:=!]|<[=!])[^()\\]*\))*\)", bare) is not None


def found(c: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    """The group of the pattern's first match as it is; null without a match (or where the group is empty).

    The search ends at the first match and runs once, unlike nullif(regexp_extract).
    """
    if group == 1 and is_one_group(pattern):  # opened at every place of the text, a group costs more than the rest of most searches
        pattern, group = pattern[1:-1], 0
    return F.get(F.filter(F.array(F.regexp_extract(c, u(pattern, flags), group)), lambda x: x != ""), F.lit(0))


def groups(c: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that is anchored at the text's start, as an array, by one match; null without a match."""
    parts = F.split(F.regexp_replace(c, u(f"{pattern}(?s:.*)"), BETWEEN.join(f"${k}" for k in range(1, n + 1))), BETWEEN, -1)
    return F.get(F.filter(F.array(parts), lambda x: F.size(x) == n), F.lit(0))


def first_match(c: Column, patterns: tuple[str, ...] | list[str], flags: str = "", group: int = 1) -> Column:
    """The stripped group of the first pattern that finds something; null if none does. Later patterns are tried only then."""
    return F.coalesce(*[strip(found(c, p, flags, group)) for p in patterns])


#: Characters that match Greek letters, case ignored, without being their capitals (but for the final sigma), and the dotted capital, which would become two characters.
ODD_LETTERS = (("\u00b5", "μ"), ("\u0345", "ι"), ("\u1fbe", "ι"), ("\u03d0", "β"), ("\u03d1", "θ"), ("\u03d5", "φ"), ("\u03d6", "π"), ("\u03f0", "κ"), ("\u03f1", "ρ"), ("\u03f5", "ε"), ("\u0130", "i"))


def fold(c: Column) -> Column:
    """Lower-cased, character by character, so that Greek words and Latin ones without i or s are found in it as the flag i finds them in the text, but much faster. Patterns: folded()."""

    def plain(x: Column) -> Column:
        for odd, letter in ODD_LETTERS:
            x = F.replace(x, F.lit(odd), F.lit(letter))
        return x

    even = F.when(c.rlike("[\u0345\u03d0-\u03f5]") | c.contains("\u00b5") | c.contains("\u1fbe") | c.contains("\u0130"), plain(c)).otherwise(c)
    return F.replace(F.lower(even), F.lit("ς"), F.lit("σ"))


def folded(pattern: str) -> str:
    """A pattern of letters, digits and small classes for texts of fold()."""
    return pattern.lower().replace("ς", "σ")


#: Neighbours of a match: up to so many equal pairs one after the other, which is what single pairs would find, with fewer matches.
MATCH = 8
PAIRS = "(?s)" + "(?:".join(rf"(.)\{k}" for k in range(1, MATCH + 1)) + ")?" * (MATCH - 1)


def collapse_doubled(c: Column, when: str = "always") -> Column:
    """Each pair of equal neighbours becomes one character, left to right; then fixed repairs.

    when: 'always', or 'auto': only texts most of whose characters are paired
    (plain text, such as digits that come twice, is left alone).
    """
    once = F.regexp_replace(c, PAIRS, "".join(f"${k}" for k in range(1, MATCH + 1)))
    out = once
    for old, new in REPAIRS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out if when == "always" else F.when(F.length(once) * 10 <= F.length(c) * 6, out).otherwise(c)


def normalize_line(c: Column) -> Column:
    """Stripped, each run of white space turned into two blanks. Then only blanks are left to strip, which takes no second pattern."""
    return F.trim(F.regexp_replace(c, u(r"\s+"), "  "))


def normalize_text(c: Column) -> Column:
    """Runs of blanks and tabs turned into one blank, then no-break spaces into blanks. Single blanks are left alone, and most texts have no others."""
    single = F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"[ \t]{2,}|\t", " ")).otherwise(c)
    # To look for a byte that few texts have is much faster than a replacement, which compares at every byte.
    return F.when(c.contains("\u00a0"), F.replace(single, F.lit("\u00a0"), F.lit(" "))).otherwise(single)


def parse_eu_money(c: Column) -> Column:
    """'*1.234,56 €' to 1234.56; null if it is no amount."""
    return strip(F.translate(c, ",.€*", ".")).try_cast("decimal(12,2)")


def parse_date(c: Column) -> Column:
    """A date from dd/MM/yyyy or dd-MM-yyyy; null if it is none."""
    s = strip(c)
    return F.coalesce(F.try_to_date(s, "dd/MM/yyyy"), F.try_to_date(s, "dd-MM-yyyy"))


def parse_date_multi(c: Column) -> Column:
    """dd/MM/yyyy or dd-MM-yyyy as dd/MM/yyyy; null if it is no date."""
    return F.date_format(parse_date(c), "dd/MM/yyyy")


def parse_date_span(c: Column) -> tuple[Column, Column]:
    """Both dates around a dash; null where there is none."""
    return tuple(parse_date(found(c, SPAN, group=k)) for k in (1, 2))


def parse_dotted_period(c: Column) -> tuple[Column, Column]:
    """Dates of dd.MM.yyyy-dd.MM.yyyy; both null if either is bad."""
    parts = F.split(c, "-", 2)
    days = [F.try_to_date(strip(F.get(parts, F.lit(k))), "dd.MM.yyyy") for k in (0, 1)]
    good = days[0].isNotNull() & days[1].isNotNull()
    return tuple(F.when(good, d) for d in days)


def parse_kwh(c: Column, same_line: bool = False) -> Column:
    """The number before kWh. Digits of the line before belong to it unless same_line, and make it null."""
    number = found(c, KWH.replace(r"\s", r"[^\S\n]") if same_line else KWH, "i")
    return strip(F.translate(number, ". ", "")).try_cast("double")


def strip_separators(c: Column) -> Column:
    """Without blanks and dashes."""
    return F.translate(c, " -", "")


def infer_subcategory(category: Column, multiplier: Column, context: Column) -> Column:
    """Of commercial invoices: farming by a word of the context, else simple or industrial by the multiplier."""
    by_size = F.when(multiplier == 1, SIMPLE).when(multiplier > 1, INDUSTRIAL)
    return F.when((category == COMMERCIAL) & multiplier.isNotNull(), F.when(F.upper(context).contains(FARMING_WORD), FARMING).otherwise(by_size))


def present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def confidence(*fields: Column) -> Column:
    """Share of fields that are there."""
    total = present(fields[0]).cast("int")
    for f in fields[1:]:
        total = total + present(f).cast("int")
    return total / F.lit(len(fields))


def review_reason(score: Column, threshold: float = 0.90, **fields: Column) -> Column:
    """'Missing: a, b (confidence: 0.67)' below the threshold, else null."""
    missing = F.concat_ws(", ", *[F.when(~present(c), F.lit(n)) for n, c in fields.items()])
    return F.when(score < threshold, F.concat(F.lit("Missing: "), missing, F.lit(" (confidence: "), F.format_string("%.2f", score), F.lit(")")))


def dedup_key(*fields: Column) -> Column:
    """Fields joined by _, null and empty ones as None."""
    return F.concat_ws("_", *[F.coalesce(none_if_empty(f.cast("string")), F.lit("None")) for f in fields])


def is_truthy(c: Column) -> Column:
    """Whether the text, lower-cased, is one of the true words; null is not."""
    return F.coalesce(F.lower(c.cast("string")).isin(*TRUE_WORDS), F.lit(False))


def reformat_date(c: Column) -> Column:
    """Dates as dd/MM/yyyy, day first; what is no date stays."""
    s = strip(c)
    day = F.coalesce(parse_date(s), *[F.try_to_date(s, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd")])
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), c)
