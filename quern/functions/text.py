"""Text expressions: tokens, counts, cleaning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: words left out of the BM25 vocabulary ---
STOPWORDS = (
    "a an and are as at be by for from has have he in is it its of on or that the to was were will with what which how do does did this these those there their".split()
)
#: A letter, number or underscore, in any script; the engine's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"
#: The words by their first letters, so that most words are told apart from them by one.
_BY_LETTER = "|".join(f"{c}(?:{'|'.join(w[1:] for w in STOPWORDS if w[0] == c)})" for c in sorted({w[0] for w in STOPWORDS}))
#: Runs of two and more that are no stopword, by the pattern alone: no lambda runs over the words.
TOKEN = f"(?<!{WORD})(?!(?:{_BY_LETTER})(?!{WORD})){WORD}{{2,}}"
NOISE = ("references", "bibliography", "acknowledg")


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more that are no stopwords; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def base_id(ident: Column) -> Column:
    """The id without its version: what comes before the first ``v``."""
    return F.substring_index(ident, "v", 1)


def strip_cites(text: Column) -> Column:
    """Removes bracketed number lists such as ``[6, 14]``."""
    return F.regexp_replace(text, r"\[\d+(?:\s*,\s*\d+)*\]", "")


def is_noise(section: Column) -> Column:
    """Bibliography and acknowledgement headings."""
    name = F.lower(collapse(F.coalesce(section, F.lit(""))))
    out = F.lit(False)
    for part in NOISE:
        out = out | F.contains(name, F.lit(part))
    return out


def authors_line(authors: Column, most: int = 5) -> Column:
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(F.size(authors) > most, " et al.").otherwise(""))


def rejoin_lines(text: Column) -> Column:
    """Joins words hyphenated at line ends and lines that go on in lower case; at most one blank line stays."""
    text = F.regexp_replace(text, f"({WORD})-\n({WORD})", "$1$2")
    text = F.regexp_replace(text, "\n(?=[a-z])", " ")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; there is no built-in for it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def clean(text: Column) -> Column:
    return rejoin_lines(nfkd(text))


def heading(text: Column) -> Column:
    return collapse(nfkd(text))


def clean_lines(text: Column, limit: int) -> Column:
    """Lines of 4 to 25 words without bullets, numbers and quotes, the first ``limit``."""
    bare = F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.btrim(F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")), F.lit("\"'")))
    return F.slice(F.filter(bare, lambda x: (word_count(x) > 3) & (word_count(x) <= 25)), 1, limit)


def as_list(value: Column) -> Column:
    """A JSON list of strings, or the value itself as the only element."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array(value))


def preview(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)
