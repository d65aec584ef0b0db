"""Text repair, tokenising and folding as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text rules: white space, patterns and word lists. White space is spelt out: a class of a few characters
# costs far less than Java's Unicode mode.
_SPACES = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = f"[{_SPACES}]"
STRIPPED = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
DOT_LEADER = rf"(?:{SPACE}*+\.){{4,}}{SPACE}*+\p{{Nd}}*"
CONJUNCTIONS = "und|oder|bzw|sowie|beziehungsweise"
SOFT_BREAK = r"\n(?<![.!?:;]\n)(?!\n)"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+"
PARAGRAPH_BREAK = rf"\n{SPACE}*\n"
STOPWORDS = tuple(
    "der die das und oder aber auch ein eine einen einem einer eines ist sind war waren wird werden wurde wurden hat haben hatte"
    " wie was wer wo wann warum welche welcher welches gibt steht geht fuer für von vom mit auf aus bei zum zur den dem des im in an"
    " am sich nicht nur man mir mich ich wir sie es zu so dass ueber über beim als wenn noch schon mal".split()
)


def _where(c: Column, holds: Callable[[Column], Column], repaired: Callable[[Column], Column]) -> Column:
    """``repaired`` where the cheap test ``holds``, so that most texts are spared a pass; ``c`` is bound and made once."""
    return F.transform(F.array(c), lambda x: F.when(holds(x), repaired(x)).otherwise(x))[0]


def unify_newlines(c: Column) -> Column:
    return _where(c, lambda x: F.contains(x, F.lit("\r")), lambda x: F.regexp_replace(x, r"\r\n?", "\n"))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def repair_spaces(c: Column) -> Column:
    """No-break and thin spaces become spaces; soft hyphens go."""
    return F.translate(c, "  ­", "  ")


def drop_dot_leaders(c: Column) -> Column:
    """Table-of-contents dots with the page number behind them become one space."""
    return _where(c, lambda x: x.rlike(rf"\.{SPACE}*+\."), lambda x: F.regexp_replace(x, DOT_LEADER, " "))


def dehyphenate(c: Column) -> Column:
    """Joins words that a line end broke; a hyphen before a conjunction stays, with a space."""

    def joined(x: Column) -> Column:
        kept = F.regexp_replace(x, rf"(?U)(\w)-\n[ \t]*(?=(?iu:{CONJUNCTIONS})\b)", "$1- ")
        return F.regexp_replace(kept, r"(?U)(\w)-\n[ \t]*(\w)", "$1$2")

    return _where(c, lambda x: F.contains(x, F.lit("-\n")), joined)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(c, F.lit(STRIPPED))


def strip_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n")


def prepare(c: Column) -> Column:
    """Repairs extraction artefacts and keeps the lines."""
    repaired = drop_dot_leaders(repair_spaces(strip_controls(unify_newlines(F.coalesce(c, F.lit(""))))))
    return strip_lines(dehyphenate(repaired))


def reflow(c: Column) -> Column:
    """Resolves line breaks inside sentences. A single blank line collapses to one break, as it always did."""
    soft = F.regexp_replace(c, SOFT_BREAK, " ")
    narrow = F.regexp_replace(F.regexp_replace(soft, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return strip(strip_lines(narrow))


def normalize(c: Column) -> Column:
    return reflow(prepare(c))


def split_paragraphs(c: Column) -> Column:
    return F.split(c, PARAGRAPH_BREAK, -1)


def split_sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END, -1)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with diacritics and their bases, by Unicode decomposition, up to Latin Extended Additional."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in range(0xC0, 0x1F00)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return _where(F.lower(c), lambda x: x.rlike(r"[^\x00-\x7f]"), lambda x: F.translate(x, *_folding()))


def folded_word(word: str) -> str:
    """``fold`` of a lower-case word, outside of a plan."""
    return word if word.isascii() else word.translate(_folding_table())


@lru_cache(maxsize=1)
def _folding_table() -> dict[int, str]:
    return str.maketrans(*_folding())


def index_tokens(c: Column) -> Column:
    """Folded runs of letters and digits, as the inverted index holds them."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits with their diacritics, as a stemmer takes them."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def match_terms(c: Column) -> Column:
    """Words of a question for the ``sqlite`` profile: no operator signs, no stopwords unless all are, 32 at most."""
    words = F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"""["'()*:^-]""", " "), F.lit(r"(?U)\w{2,}"), F.lit(0))
    useful = F.filter(words, lambda w: ~F.lower(w).isin(*STOPWORDS))
    return F.slice(F.when(F.size(useful) > 0, useful).otherwise(words), 1, 32)


def match_query(c: Column) -> Column:
    """The words as a quoted OR query."""
    return F.array_join(F.transform(match_terms(c), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def query_terms(c: Column) -> Column:
    """Words of a question for the ``postgres`` profile: letters and digits, 32 at most."""
    return F.slice(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)), 1, 32)


def clean_title(c: Column) -> Column:
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit(" ")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
