"""Functions on words, tokens and language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word that starts with one of these is joined without a space.
ATTACHED = (",", ".", "!", "?", ";", ":", "%", ")", "]", "}", "'", "’")


def strip_token(token: Column) -> Column:
    """``<|xx|>`` without its marks; anything else unchanged."""
    marked = F.startswith(token, F.lit("<|")) & F.endswith(token, F.lit("|>")) & (F.length(token) >= 4)
    return F.when(marked, F.substring(token, F.lit(3), F.length(token) - 4)).otherwise(token)


def language_tag(piece: Column) -> Column:
    """The code in ``<xx>`` or ``<xx-XX>``, null for any other piece."""
    pattern = "^<([a-z]{2}(?:-[A-Z]{2})?)>\\z"
    return F.when(F.rlike(piece, F.lit(pattern)), F.regexp_extract(piece, pattern, 1))


def is_english(code: Column) -> Column:
    return F.lower(F.split(code, "[-_]")[0]) == "en"


def target_language(code: Column, english_only: Column) -> Column:
    """What to set on a model: the code, or nothing on an English-only one, which refuses other languages."""
    fits = (code == "auto") | is_english(code)
    refused = F.raise_error(F.concat(F.lit("this model knows English only and was asked for "), code))
    return F.when(~english_only, code).when(fits, F.lit(None).cast("string")).otherwise(refused.cast("string"))


def chosen_language(explicit: Column, configured: Column) -> Column:
    """The language asked for, else the one configured, else null: to be detected."""
    return F.coalesce(explicit, configured)


def decoder_language(code: Column) -> Column:
    return F.when(code == "unknown", F.lit("auto")).otherwise(code)


def is_blank(text: Column) -> Column:
    """No character but Unicode white space."""
    return ~F.rlike(text, F.lit("(?U)\\S"))


def join_words(words: Column) -> Column:
    """Words with single spaces between them; punctuation, and an empty word, attach to what precedes them."""
    attached = lambda w: (w == "") | F.substring(w, 1, 1).isin(*ATTACHED)
    return F.aggregate(words, F.lit(""), lambda a, w: F.when((a == "") | attached(w), F.concat(a, w)).otherwise(F.concat(a, F.lit(" "), w)))


def mel_bins(identity: Column) -> Column:
    return F.when(F.contains(F.lower(identity), F.lit("large-v3")), 128).otherwise(80)


def shown(kind: str, start: Column, end: Column, text: Column) -> Column:
    """A one-line form with times to two decimals."""
    return F.format_string(f"{kind}(start=%.2f, end=%.2f, text='%s')", start, end, text)
