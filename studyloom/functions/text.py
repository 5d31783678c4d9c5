"""Text expressions, built-in functions only.

White space is the Unicode set of 29 code points, written out because the engine's own class is narrower.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of white space, as first and last of each range.
WHITE_SPACE = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WS = "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in WHITE_SPACE) + "]+"
#: Rules out visible ASCII by one test of a character, where a class takes one for each of its ranges.
_RARE = "(?![!-~])"
#: A run of white space that is not a single blank, which would be replaced by itself.
_ODD_WS = f"{_RARE}(?: {_RARE}" + WS + "|[" + WS[1:-2].replace("\\u001c-\\u0020", "\\u001c-\\u001f") + "]" + WS[:-1] + "*)"


def _outside(kept: str) -> str:
    """A class of all other characters, as ranges: the engine tests a negated class several times slower."""
    points = [-1, *sorted(map(ord, kept)), 0x110000]
    return "[" + "".join(f"\\x{{{a + 1:x}}}-\\x{{{b - 1:x}}}" for a, b in itertools.pairwise(points) if b - a > 1) + "]"


#: The characters that light and full cleaning keep.
ASCII = "".join(map(chr, range(0x80)))
KEPT = "abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "0123456789" " .,!?'\"-:"
#: Fixed values of the question generator.
TOPIC_WORDS, NO_TOPIC, SENTENCE_CHARS, SNIPPET_CHARS = 6, "this topic", 40, 240
SOURCE_CHARS, EMBEDDING_CHARS, WEAK_CHARS, SCRIPT_CHARS = 1000, 2000, 200, 1500


def normalized(text: Column) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return F.trim(_single_blanks(text))


def blank(text: Column) -> Column:
    """True for null and for nothing but white space; the first other character decides."""
    return F.coalesce(~F.rlike(text, F.lit("[^" + WS[1:-1])), F.lit(True))


def _single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _ODD_WS, " ")


def light_clean(text: Column) -> Column:
    """White-space runs become a blank, then runs beyond ASCII do, which may leave double blanks inside; ends are trimmed."""
    return F.trim(F.regexp_replace(_single_blanks(text), _outside(ASCII) + "+", " "))


def full_clean(text: Column) -> Column:
    """Also removes page separators, web addresses, mail addresses and all but letters, digits and common marks.

    A mail address takes the whole of its word, so it is looked for where words start only, which keeps long words linear.
    """
    out = _single_blanks(text)
    for pattern in (r"--- PAGE \p{Nd}+ ---", "http[^ ]+|www[^ ]+", "(?<![^ ])[^ ]+@[^ ]+", _outside(KEPT)):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def words(text: Column, cleaned: bool = False) -> Column:
    """Non-empty words between white space; a ``cleaned`` text holds none but blanks."""
    return F.filter(F.split(text, " " if cleaned else WS), lambda w: w != "")


def topic(text: Column) -> Column:
    """The first six runs of ASCII letters and digits, or a stand-in."""
    head = F.regexp_extract(text, f"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){{1,{TOPIC_WORDS}}}+", 0)
    found = F.regexp_extract_all(head, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.lit(NO_TOPIC))


def sentences(text: Column, joined: bool = False) -> Column:
    """Up to three different sentences of 40 characters or more, case aside, first spelling first; only three are ever used.

    A ``joined`` text, as chunks are, is words with one blank between.
    """
    parts = F.split(text, r" (?<=[.!?] )") if joined else F.transform(F.split(text, r"(?<=[.!?])" + WS), normalized)
    parts = F.filter(parts, lambda s: F.char_length(s) >= SENTENCE_CHARS)
    seen = lambda acc, s: F.exists(acc, lambda y: F.lower(y) == F.lower(s))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) >= 3) | seen(acc, s), acc).otherwise(F.array_append(acc, s)))


def snippet(text: Column, joined: bool = False) -> Column:
    """The first 240 characters of the normalized text."""
    return F.trim(F.substring(text if joined else normalized(text), 1, SNIPPET_CHARS))


def answers(text: Column, joined: bool = False) -> Column:
    """The sentences, or else the snippet as the only one; none for blank text."""
    return answers_from(sentences(text, joined), snippet(text, joined))


def answers_from(found: Column, short: Column) -> Column:
    """:func:`answers` of a text's sentences and snippet, each used more than once here."""
    return F.when(F.size(found) > 0, found).when(short != "", F.array(short)).otherwise(F.array().cast("array<string>"))


def source_chunk(text: Column) -> Column:
    return F.substring(text, 1, SOURCE_CHARS)


def embedding_input(text: Column) -> Column:
    return F.substring(text, 1, EMBEDDING_CHARS)


def strong_chunk(text: Column) -> Column:
    """True for a chunk that is long enough to ask about."""
    return F.char_length(normalized_ends(text)) >= WEAK_CHARS


def normalized_ends(text: Column) -> Column:
    """White space at both ends removed."""
    return F.btrim(text, F.lit("".join(chr(c) for a, b in WHITE_SPACE for c in range(a, b + 1))))
