"""Text columns: cleaning, tokens, keys and small scalar rules.  All built-in expressions, but for what tasks on bytes share with them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What cleaning replaces and the lines it removes.
ONE_FOR_ONE = ("‘’“”– ", "''\"\"- ")
LONGER = (("—", "--"), ("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"))
PAGE_NUMBER_LINES = (r"(?m)^\s*\d{1,4}\s*$", r"(?mi)^\s*Page\s+\d+\s+of\s+\d+\s*$", r"(?m)^\s*-\s*\d+\s*-\s*$")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
HEADER_LINES = (
    r"(?m)^THE\s+\w+\s+ACT,\s+\d{4}\s*$",
    rf"(?m)^\s*\[?\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\s+\d{{4}}\]?\s*$",
    r"(?m)^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$",
)
WORD_REPAIRS = {"diffic ulties": "difficulties", "diffic-ulties": "difficulties", "diffic_ulties": "difficulties"}
NOT_FOUND = "Not found in document"
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "regarding", "about", "concerning", "what", "how", "when", "where", "which")


def chain(text: Column, *patterns: str, by: str = "") -> Column:
    """Each pattern replaced in turn."""
    return reduce(lambda c, p: F.regexp_replace(c, p, by), patterns, text)


def missing_to_null(text: Column) -> Column:
    """The three ways to say nothing (null, empty, the sentinel) as null."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit(NOT_FOUND))


def fix_encoding(text: Column) -> Column:
    """Quotes, dashes, no-break spaces, soft hyphens and ligatures."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), LONGER, F.translate(text, *ONE_FOR_ONE))


def squeeze_lines(text: Column) -> Column:
    """Runs of blanks in a line to one, lines trimmed, newlines kept."""
    return chain(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^[ \t\r\f]+", r"(?m)[ \t\r\f]+$")


def clean_text(text: Column, remove_headers: bool = True) -> Column:
    """The whole cleaning; a blank text becomes empty."""
    out = chain(fix_encoding(text), *PAGE_NUMBER_LINES, *(HEADER_LINES if remove_headers else ()))
    out = F.regexp_replace(squeeze_lines(out), r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?m)^\s*[-_=]{3,}\s*$", "")
    out = F.regexp_replace(out, r"(\w+)-\n(\w+)", "$1$2")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(chain(out, r"^\s+", r"\s+$"))


def schema_of(df: DataFrame) -> StructType:
    """A copy of a schema, to which columns can be added."""
    return StructType(list(df.schema.fields))


def join_lines(text: Column) -> Column:
    """Broken words mended, every line squeezed and trimmed, joined by newlines, blank ones dropped."""
    text = reduce(lambda c, word: F.replace(c, F.lit(word), F.lit(WORD_REPAIRS[word])), WORD_REPAIRS, text)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sections_of(text: Column) -> Column:
    """Array of (number, content, char_count), content up to the next heading."""
    head = r"(?m)^(?:(?:Section|Sec\.?)\s*)?(\d+[A-Z]?)\.?\s*[-–—:]?\s+(?=\S)"
    parts = F.split(F.regexp_replace(text, head, "\u0001$1\u0002"), "\u0001")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.split_part(p, F.lit("\u0002"), F.lit(1)).alias("section_number"),
            F.trim(F.split_part(p, F.lit("\u0002"), F.lit(2))).alias("content"),
            F.length(F.trim(F.split_part(p, F.lit("\u0002"), F.lit(2)))).alias("char_count"),
        ),
    )


def long_enough(rows: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose text, stripped, has ``least`` characters or more."""
    return rows.filter(F.length(F.trim(F.coalesce(column, F.lit("")))) >= least)


def needs_ocr(text: Column, pages: Column, per_page: int = 50) -> Column:
    """Too few characters a page; no page, no need."""
    return F.when(pages > 0, F.length(F.trim(F.coalesce(text, F.lit("")))) < per_page * pages).otherwise(False)


def text_of(text: Column, question: Column, answer: Column, section_text: Column) -> Column:
    """C11: the first of text, question and answer, section text, empty."""
    pair = F.when(question.isNotNull() & answer.isNotNull(), F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer))
    return F.coalesce(F.nullif(text, F.lit("")), pair, F.nullif(section_text, F.lit("")), F.lit(""))


def longer_of(a: Column, b: Column) -> Column:
    """``a`` when it is longer than ``b``."""
    return F.when(F.length(F.coalesce(a, F.lit(""))) > F.length(F.coalesce(b, F.lit(""))), a).otherwise(b)


def title_of(name: Column) -> Column:
    """A file name's stem in title case."""
    stem = F.initcap(F.trim(F.translate(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), "_-", "  ")))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("Untitled Case"))


def file_title(title: Column, key: Column) -> Column:
    """A safe name, cut at 60, and the key."""
    return F.concat_ws("_", F.substring(F.regexp_replace(title, r"[^\w\-_.]", "_"), 1, 60), key)


def tokens(text: Column) -> Column:
    """Lower-case terms longer than a character that aren't numbers."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-/]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))


_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789-/"
_TERM_BYTES = bytes.maketrans(bytes(range(256)), bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256)))


def term_bytes(text: bytes) -> list[bytes]:
    """For use inside tasks: the words that :func:`tokens` chooses from, of a text in UTF-8; two letters outside ASCII have one of ASCII as lower case."""
    return text.replace(b"\xc4\xb0", b"i ").replace(b"\xe2\x84\xaa", b"k").translate(_TERM_BYTES).split()


def raw_length(text: Column) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def near_dup_key(text: Column, chars: int = 120) -> Column:
    """The first characters, squeezed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.substring(text, 1, chars), r"\s+", " ")))


def alphanumeric(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def sentences(text: Column, longer_than: int) -> Column:
    """Pieces between full stops, exclamation and question marks and newlines."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that it uses several times, made once a row."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def either(first: Column, *more: Column) -> Column:
    """Whether one of some conditions holds."""
    return reduce(lambda a, b: a | b, more, first)


def holds(text: Column, *words: str) -> Column:
    """Whether a text holds one of some words."""
    return either(*map(text.contains, words))


def found(value: Column, inferred: Column | None = None) -> Column:
    """A {value, status} field: extracted, else inferred, else not found."""
    other = F.lit(None).cast("string") if inferred is None else inferred

    def field(of: Column) -> Column:
        status = F.when(of["v"].isNotNull(), "extracted").when(of["o"].isNotNull(), "inferred").otherwise("not_found")
        return F.struct(F.coalesce(of["v"], of["o"]).alias("value"), status.alias("status"))

    return let(F.struct(value.alias("v"), other.alias("o")), field)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first match, null when there is none."""
    return let(F.regexp_extract(text, pattern, group), lambda m: F.when(m != "", m))


def all_matches(text: Column, *patterns: str, group: int = 0) -> Column:
    """Distinct matches of all patterns in order of pattern and place."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns])))
