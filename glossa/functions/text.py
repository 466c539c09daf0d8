"""Text normalisation, tokens and n-grams as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation characters, markers, contractions and the URL class.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE_START, SENTENCE_END = "SENTSTART", "SENTEND"
FRENCH_CONTRACTIONS = ("l'", "c'", "j'", "t'", "qu'", "puisqu'", "lorsqu'")
URL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
SPLIT_OFF = r"([.!?,:;()+\-<>=\"])"

#: White space as regular expressions take it, with the four separators that they leave out, by its characters.
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a class; the flag for Unicode classes, which is slow, isn't needed.
WHITE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

PUNCT_CLASS = r"!-/:-@\[-`{-~"
NOT_APOSTROPHE = r"!-&(-/:-@\[-`{-~"


#: Bytes of a column that are held as Python objects at once.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """``column`` in pieces of about ``SLICE_BYTES``, at least a row each."""
    rows = max(1, min(len(column), len(column) * SLICE_BYTES // max(column.nbytes, 1)))
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        if len(part) > 1 and part.nbytes > 2 * SLICE_BYTES:  # rows of uneven size
            yield from slices(part)
        else:
            yield part


def by_slices(column: pa.Array, f: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """f over the values of ``column``, slice by slice, as an array; an Arrow batch is never a list of Python objects as a whole."""
    done = [pa.array(f(part.to_pylist()), kind) for part in slices(column)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.btrim(c, F.lit(WHITE_CHARACTERS))


def remove_newlines(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def remove_urls(c: Column) -> Column:
    """URLs with a scheme become one space; bare www names stay."""
    return F.regexp_replace(c, URL, " ")


def split_punctuation(c: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """A space before each run of punctuation that begins with other than an apostrophe, and after each that ends so, but not at the end of the text.

    No space goes in where an abbreviation (a substring, no word boundary
    needed) stands, from its start through its end.
    """

    def spaced(text: Column, start: str) -> Column:
        before = F.regexp_replace(text, f"({start}[^{PUNCT_CLASS}])([{NOT_APOSTROPHE}])", "$1 $2")
        return F.regexp_replace(before, f"([{NOT_APOSTROPHE}])([^{PUNCT_CLASS}])", "$1 $2")

    if not abbreviations:
        return spaced(c, "^|")
    held = "(" + "|".join(sorted((r"\Q" + a + r"\E" for a in abbreviations), key=len, reverse=True)) + ")"
    # what stands between abbreviations; only the first piece begins where the text does
    gaps = F.transform(F.split(c, held, -1), lambda gap, i: F.when(i == 0, spaced(gap, "^|")).otherwise(spaced(gap, "")))
    return F.array_join(F.flatten(F.zip_with(gaps, F.regexp_extract_all(c, F.lit(held), F.lit(1)), lambda gap, x: F.array(gap, F.coalesce(x, F.lit(""))))), "")


def split_french_contractions(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)(" + "|".join(rf"\b{x}" for x in FRENCH_CONTRACTIONS) + ")", " $1 ")


def isolate_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, SPLIT_OFF, r" $1 ")


def normalise_sentence(c: Column, lang: str = "e", markers: bool = True) -> Column:
    """Strip, split contractions (lang f), lower, isolate punctuation, add boundary markers."""
    out = strip(c)
    if lang == "f":
        out = split_french_contractions(out)
    out = isolate_punctuation(F.lower(out))
    return F.concat(F.lit(SENTENCE_START + " "), out, F.lit(" " + SENTENCE_END)) if markers else out


def normalise_transcript(c: Column) -> Column:
    """Lower, all punctuation but square brackets to spaces, white-space tokens."""
    return tokens(F.regexp_replace(F.lower(c), r"[!-/:-@\\^_`{-~]", " "))


def tokens(c: Column) -> Column:
    """White-space tokens, none of them empty."""
    # a split at one blank needs no regular expression, which would be compiled for each row; most white space is a blank already
    return F.array_remove(F.split(F.regexp_replace(c, WHITE.replace("\\x20", "\\x1F"), " "), " "), "")


def single_space_tokens(c: Column) -> Column:
    """Split at each blank; an empty text has one empty token."""
    return F.split(c, " ", -1)


def sentences(c: Column) -> Column:
    return F.transform(F.split(c, "\n", -1), strip)


def tagged_token(c: Column) -> Column:
    """word/TAG split at the last slash; without one the tag is null."""
    has = c.contains("/")
    return F.struct(F.when(has, F.regexp_extract(c, r"(?s)^(.*)/([^/]*)$", 1)).otherwise(c).alias("word"), F.when(has, F.regexp_extract(c, r"(?s)^(.*)/([^/]*)$", 2)).alias("tag"))


def ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-grams as arrays; none if there are fewer than n tokens."""
    empty = F.array().cast("array<array<string>>")
    return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.slice(toks, i, n))).otherwise(empty)


def bigram_pairs(toks: Column, last: str | None = None) -> Column:
    """Bigrams as structs (w1, w2), by whole columns; with ``last`` each last token stands before it too."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    if last is None:
        return F.arrays_zip(F.slice(toks, 1, n).alias("w1"), F.slice(toks, 2, n).alias("w2"))
    return F.when(F.size(toks) > 0, F.arrays_zip(toks.alias("w1"), F.concat(F.slice(toks, 2, n), F.array(F.lit(last))).alias("w2")))


def without_markers(toks: Column) -> Column:
    """Tokens without the first and last."""
    return F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))
