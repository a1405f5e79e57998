"""Text columns: cleaning, names, slugs, hashes, words and trigrams. Built-ins only, but for NFC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lexigraph import config

# Letters that do not decompose and their plain forms (the first two lines one to one).
STROKED = "đłøħŧıŋ"
PLAIN = "dlohtin"
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))

# A name in a text: letters and digits, dots inside or before them, plus and hash signs after them; or a sentence mark.
NAME_TOKEN = r"\.?[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*[+#]*|[.!?]+"
SENTENCE_MARK = r"^[.!?]+$"

# Markup rewritten in this order by ``clean_html``.
HTML_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?i)</?h[1-6]\b[^>]*>", "\n\n"),
    (r"(?i)</?p\b[^>]*>", "\n\n"),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)
SPACE_RULES = ((r"[ \t\r\f]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _apply(col: Column, rules) -> Column:
    for pattern, value in rules:
        col = F.regexp_replace(col, F.lit(pattern), F.lit(value))
    return col


def clean_html(col: Column) -> Column:
    """Plain text of an HTML page; headings and list items keep their line breaks."""
    return _apply(_apply(col, HTML_RULES), SPACE_RULES)


def clean_plain(col: Column) -> Column:
    """Plain text with tidy white space."""
    return _apply(col, SPACE_RULES)


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C (Spark has no built-in)."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Letters without their accents (Spark has no decomposition)."""
    def bare(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))

    return text.map(bare)


def sanitize(col: Column, normalize: bool = True) -> Column:
    """Q2: a display name without markup, in NFC, with single spaces."""
    bare = F.regexp_replace(col, r"<[^>]*>", "")
    bare = nfc(bare) if normalize else bare
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def normalized_name(col: Column) -> Column:
    """Comparison form of a candidate name."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def slug(col: Column) -> Column:
    """URL form of a name: plain lower-case words joined by hyphens, at most 100 characters; empty if no Latin letter is left."""
    plain = F.translate(F.lower(without_marks(F.lower(col))), STROKED, PLAIN)
    for letter, two in LIGATURES:
        plain = F.replace(plain, F.lit(letter), F.lit(two))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\+", "-plus"), "#", "-sharp")
    hyphened = F.regexp_replace(plain, "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(hyphened, "^-+|-+$", ""), F.lit(config.SLUG_MAX_LENGTH)),
                            "-+$", "")


def name_tokens(col: Column) -> Column:
    """Lower-case tokens of a text for dictionary look-ups: names such as c++, node.js and .net stay whole."""
    return F.regexp_extract_all(F.lower(col), F.lit(NAME_TOKEN), 0)


def external_id(col: Column) -> Column:
    """A public id that is the same on every run."""
    return F.concat(F.lit("SK-"), F.substring(F.sha2(col, 256), 1, 16))


def split_words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def estimate_tokens(col: Column) -> Column:
    """Words times 1.3, rounded up."""
    return F.ceil(F.size(split_words(col)) * F.lit(config.TOKENS_PER_WORD)).cast("bigint")


def trigrams(col: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def preview(col: Column, chars: int = 500) -> Column:
    return F.substring(col, 1, chars)
