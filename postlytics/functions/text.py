"""Text scalar functions, all ``Column -> Column`` and JVM-side.

Every function here is a composition of built-in Spark SQL expressions, so
it stays inside whole-stage code generation and is evaluated where the
data lives. Regular expressions are written with explicit Unicode classes
so that they mean the same in Java (Spark) and RE2 (the DuckDB oracle):

* a word character is ``[\\p{L}\\p{N}_]`` (letters, numbers, underscore);
* whitespace is the list in ``WS_CLASS`` (what ``str.isspace`` accepts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlytics.functions.stopwords import ENGLISH_STOPWORDS

# --- fixed values (must equal the reference's behaviour) -------------------
# Characters treated as whitespace by Python's str.isspace / \s.
WS_CLASS = (r"\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NON_SPACE = "[^" + WS_CLASS + "]"
WORD_CHAR = r"[\p{L}\p{N}_]"
# URL pattern: "http(s)://" or "www." followed by non-space characters.
URL_PATTERN = r"https?://" + NON_SPACE + r"+|www\." + NON_SPACE + "+"
HASHTAG_PATTERN = "#" + WORD_CHAR + "+"
MENTION_PATTERN = "@" + WORD_CHAR + "+"
# Word tokenizer contractions that split one word into two tokens:
# cannot -> can not, gimme -> gim me, gonna -> gon na, gotta -> got ta,
# lemme -> lem me, wanna -> wan na.
CONTRACTION_PATTERN = (r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)"
                       r"|lem(?=me\b)|wan(?=na\b))")
# Sentiment label names, index = label id.
LABEL_NAMES = ("Negative", "Neutral", "Positive")
UNKNOWN_LABEL = 3
VADER_POS_THRESHOLD = 0.05
VADER_NEG_THRESHOLD = -0.05
GENERATION_MARKER = "Sentiment: "
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Every character outside ``[a-zA-Z]`` becomes one space, then lower.

    Length preserving (per code point), no trimming or space collapsing.
    """
    return F.lower(F.regexp_replace(_c(col), "[^a-zA-Z]", " "))


def remove_urls(col) -> Column:
    """Delete ``https?://\\S+`` and ``www\\.\\S+``."""
    return F.regexp_replace(_c(col), URL_PATTERN, "")


def normalize(col, urls_first: bool = True) -> Column:
    """Encoder preparation, clean + remove URLs + lower.

    ``urls_first=False`` reproduces the original order (clean first), in
    which URL removal can no longer match because ``://`` and ``.`` are gone.
    """
    c = _c(col)
    if urls_first:
        return F.lower(clean_text(remove_urls(c)))
    return F.lower(remove_urls(clean_text(c)))


def hashtags(col) -> Column:
    """C4: hashtags with the ``#``, case kept, repeats kept, in text order."""
    return F.regexp_extract_all(_c(col), F.lit(HASHTAG_PATTERN), 0)


def mentions(col) -> Column:
    """``@`` mentions; also fires inside e-mail addresses."""
    return F.regexp_extract_all(_c(col), F.lit(MENTION_PATTERN), 0)


def urls(col) -> Column:
    """URLs, same pattern as :func:`remove_urls`."""
    return F.regexp_extract_all(_c(col), F.lit(URL_PATTERN), 0)


def tokenize(col) -> Column:
    """Word tokens of a cleaned text (only ``[a-z ]`` left after C1).

    Splits on runs of spaces and applies the tokenizer's six contraction
    splits. Non-cleaned input is tokenized on whitespace the same way.
    """
    spaced = F.regexp_replace(_c(col), CONTRACTION_PATTERN, "$1 ")
    parts = F.split(F.trim(spaced), "[" + WS_CLASS + "]+")
    return F.filter(parts, lambda t: t != "")


def remove_stopwords(tokens, stopwords=ENGLISH_STOPWORDS) -> Column:
    """Drop stop words (case-sensitive), keeping order and repeats."""
    stop = list(stopwords)
    return F.filter(_c(tokens), lambda t: ~t.isin(stop))


def preprocess_tokens(col) -> Column:
    """C1 -> C7 -> C8 as an array of tokens (stemming is a separate job, C9)."""
    return remove_stopwords(tokenize(clean_text(col)))


def output_to_label(col) -> Column:
    """C11: model output text -> label, priority positive > negative > neutral.

    positive -> 2, negative -> 0, neutral -> 1, anything else -> 3.
    """
    low = F.lower(_c(col))
    return (F.when(low.isNull(), F.lit(None).cast("int"))
            .when(low.contains("positive"), F.lit(2))
            .when(low.contains("negative"), F.lit(0))
            .when(low.contains("neutral"), F.lit(1))
            .otherwise(F.lit(UNKNOWN_LABEL)))


def label_to_output(col) -> Column:
    """0/1/2 -> Negative/Neutral/Positive; anything else -> NULL."""
    c = _c(col)
    expr = None
    for i, name in enumerate(LABEL_NAMES):
        expr = (F.when(c == i, F.lit(name)) if expr is None
                else expr.when(c == i, F.lit(name)))
    return expr


def compound_to_label(col) -> Column:
    """Compound score -> label; >= 0.05 -> 2, <= -0.05 -> 0, else 1.

    NULL stays NULL; NaN is neither >= nor <= a number in Python, so -> 1.
    """
    c = _c(col)
    return (F.when(c.isNull(), F.lit(None).cast("int"))
            .when(F.isnan(c), F.lit(1))
            .when(c >= VADER_POS_THRESHOLD, F.lit(2))
            .when(c <= VADER_NEG_THRESHOLD, F.lit(0))
            .otherwise(F.lit(1)))


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), "^[" + WS_CLASS + "]+|[" + WS_CLASS + "]+$", "")


def parse_generation(col, split_marker: bool = True) -> Column:
    """Generated text -> label.

    Strips, keeps what follows the last ``"Sentiment: "`` (when
    ``split_marker``), then applies :func:`output_to_label`.
    """
    s = strip(col)
    if split_marker:
        s = F.element_at(F.split(s, GENERATION_MARKER), -1)
    return output_to_label(s)


def _py_slice(arr: Column, start: int | None, stop: int | None) -> Column:
    """Python list slicing ``arr[start:stop]`` for negative/None bounds."""
    n = F.size(arr)

    def norm(i, default):
        if i is None:
            return default
        if i < 0:
            return F.greatest(n + F.lit(i), F.lit(0))
        return F.least(F.lit(i), n)

    lo = norm(start, F.lit(0))
    hi = norm(stop, n)
    length = hi - lo
    return F.when(length > 0, F.slice(arr, lo + 1, length)).otherwise(
        F.array().cast("array<string>"))


def model_family(col, completion: bool = False) -> Column:
    """Model family from a model path.

    Default: split on ``_``, glue the first two parts without separator,
    then keep the last two ``/`` parts. ``completion=True``: keep the
    ``/`` parts ``[-3:-1]`` of the path instead.
    """
    c = _c(col)
    if completion:
        return F.array_join(_py_slice(F.split(c, "/"), -3, -1), "/")
    glued = F.array_join(_py_slice(F.split(c, "_"), None, 2), "")
    return F.array_join(_py_slice(F.split(glued, "/"), -2, None), "/")


def word_tokens(col) -> Column:
    """Tokens of 2+ word characters of the lower-cased text (count/TF-IDF)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_CHAR + "{2,}"), 0)


def long_word_tags(col, min_len: int = 12) -> Column:
    """Tags derived from prose: ``'#' + lower(word)`` for ASCII words of
    ``min_len`` or more letters, in text order (repeats kept)."""
    words = F.regexp_extract_all(_c(col), F.lit(WORD_CHAR + "+"), 0)
    long_words = F.filter(words, lambda w: w.rlike("^[A-Za-z]{%d,}$" % min_len))
    return F.transform(long_words, lambda w: F.concat(F.lit("#"), F.lower(w)))
