"""Text cleaning, quality and snippet expressions.

Everything here is a column expression: it runs inside the scan stage, with no
shuffle and no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII only; this class is every Unicode white space character plus
# the four information separators U+001C..U+001F.  (The property is measured to be
# some ten times faster than the same characters spelled out.)
SPACE_CHARS = r"\x1c-\x1f\p{IsWhite_Space}"
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
# The same characters one by one, for trimming: only the ends of a text are looked at.
SPACES = "".join(
    chr(c)
    for first, last in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    )
    for c in range(first, last + 1)
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# The noise patterns and quality limits of the corpus cleaner.
# (Looking back first keeps a search to the starts of runs.)
DOT_LEADER = "......"  # or more
BASE64_CHARS = 40
BASE64_RUN = rf"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{{{BASE64_CHARS},}}"
PAGE_NUMBER = rf"(?iu)^{SPACE}*\|?{SPACE}*(?:[ivxlcdm]{{1,6}}|\p{{Nd}}{{1,4}}){SPACE}*\|?{SPACE}*$"
LONG_WORD = 30
MIN_CHARS_PDF = 500
MIN_CHARS_OTHER = 60
MIN_WORD_MEAN = 2.2
MAX_WORD_MEAN = 18.0
MAX_DOC_GARBAGE = 0.35
MAX_CHUNK_GARBAGE = 0.5
MIN_CHUNK_ALNUM = 60
SNIPPET_CHARS = 400
LOW_QUALITY = "document parsed to low-quality text (scan/word-soup)"
DUPLICATE = "duplicate content"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it.

    The optimizer copies a column into every place that uses it when it moves a
    filter down; a lambda's variable cannot be copied that way.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def words(text: Column) -> Column:
    """White-space separated words; a blank text gives one empty word."""
    return F.split(strip(text), f"{SPACE}+")


def has_run(text: Column, n: int) -> Column:
    """Whether ``n`` characters in a row are no ASCII white space.

    Cheap, as a search looks only behind white space: what needs such a run is worked out
    for the few texts that have one.
    """
    return F.concat(F.lit(" "), text).rlike(rf"\s\S{{{n}}}")


def _garbage(text: Column, in_long: Column) -> Column:
    """The share, given the characters in long words."""
    blank = F.trim(text, F.lit(" \n")) == ""
    return let(
        in_long,
        lambda n: F.when(n > 0, n / F.length(F.translate(text, " \n", ""))).when(~blank, 0.0).otherwise(1.0),
    )


def _in_long(its_words: Column) -> Column:
    long = F.filter(its_words, lambda w: F.length(w) > LONG_WORD)
    return F.aggregate(long, F.lit(0), lambda total, w: total + F.length(w))


def long_runs(text: Column) -> Column:
    """Whether a text may hold a long word or base64.

    Where not, no part of it and nothing that cleaning leaves of it does; the functions that
    take this as ``runs`` need not look again.
    """
    return has_run(text, LONG_WORD + 1)


def garbage_fraction(text: Column, runs: Column | None = None) -> Column:
    """Share of the characters that sit in words longer than 30 characters."""
    found = lambda t: long_runs(t) if runs is None else runs & long_runs(t)
    return let(text, lambda t: _garbage(t, F.when(found(t), _in_long(words(t))).otherwise(0)))


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def has_alnum(text: Column, n: int) -> Column:
    """``alnum_count(text) >= n``, without looking further than the n-th of them."""
    return text.rlike(rf"\A[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{{n}}}")


def is_toc_line(line: Column) -> Column:
    return line.contains(DOT_LEADER)


def is_page_number_line(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def drop_toc_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~is_toc_line(x)), "\n")


def drop_page_number_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~is_page_number_line(x)), "\n")


def strip_base64(text: Column, runs: Column | None = None) -> Column:
    found = lambda t: has_run(t, BASE64_CHARS) if runs is None else runs & has_run(t, BASE64_CHARS)
    return let(text, lambda t: F.when(found(t), F.regexp_replace(t, BASE64_RUN, " ")).otherwise(t))


def clean_text(text: Column, runs: Column | None = None) -> Column:
    kept = F.filter(lines(text), lambda x: ~is_toc_line(x) & ~is_page_number_line(x))
    # A base64 run never crosses a line break, so the joined text can be cleaned at once.
    joined = strip_base64(F.array_join(kept, "\n"), runs)
    three = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(joined, three))


def is_low_quality(text: Column, ext: Column, runs: Column | None = None) -> Column:
    minimum = F.when(ext == ".pdf", MIN_CHARS_PDF).otherwise(MIN_CHARS_OTHER)

    def low(t: Column, its_words: Column, chars: Column) -> Column:
        in_long = _in_long(its_words) if runs is None else F.when(runs, _in_long(its_words)).otherwise(0)
        mean = chars / F.size(its_words)
        return (
            (F.length(strip(t)) < minimum)
            | (chars == 0)
            | (mean < MIN_WORD_MEAN)
            | (mean > MAX_WORD_MEAN)
            | (_garbage(t, in_long) > MAX_DOC_GARBAGE)
        )

    def with_chars(t: Column, its_words: Column) -> Column:
        return let(F.length(F.array_join(its_words, "")), lambda chars: low(t, its_words, chars))

    return let(text, lambda t: let(words(t), lambda its_words: with_chars(t, its_words)))


def keep_chunk(text: Column) -> Column:
    return keep_part(text, None)


def keep_part(text: Column, runs: Column | None) -> Column:
    """``keep_chunk`` of a part of a text whose ``long_runs`` are known."""
    return let(
        strip(text),
        lambda body: has_alnum(body, MIN_CHUNK_ALNUM) & (garbage_fraction(body, runs) <= MAX_CHUNK_GARBAGE),
    )


def snippet(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    return let(
        collapse(text),
        lambda flat: F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat),
    )


def decode_lenient(content: Column) -> Column:
    """UTF-8 with U+FFFD for bad bytes and universal newlines."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")
