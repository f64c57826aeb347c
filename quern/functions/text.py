"""Column functions for text: normalising, cleaning, tokens, identifiers. Null in, null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dashes that become a hyphen and spaces that become a space.
DASHES, SPACES = "\u2010\u2011\u2012\u2013\u2014", "\u202f\u00a0"
#: Characters outside Latin scripts (Cyrillic, CJK, Kana, Arabic, Devanagari, Thai, Hebrew, Hangul).
NON_LATIN = "[\\x{0400}-\\x{04FF}\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{0600}-\\x{06FF}\\x{0900}-\\x{097F}\\x{0E00}-\\x{0E7F}\\x{0590}-\\x{05FF}\\x{AC00}-\\x{D7AF}]"
#: Identifiers of equipment and papers (stock number, standard, part number, two letter codes, designator).
IDENTIFIERS = (
    r"\b\d{4}-\d{2}-\d{3}-\d{4}\b",
    r"\bMIL-[A-Z]+-\d+[A-Z]?\b",
    r"\bPN-\d{4,}\b",
    r"\b[A-Z]{2}\d{4}\b",
    r"\b\d{4}-[A-Z]{2}-\d{3}-\d{4}\b",
    r"\bAN/[A-Z]{3}-\d+[A-Z]?(?:\(V\)\d*)?\b",
)
#: Lines that open a section of a description, tried in this order.
SECTION_HEADERS = (r"^#{1,4}\s+.+", r"^\d{1,2}\)\s+.+", r"^\d{1,2}\.\s+.+", r"^\*\*[^*]+[:\.]\*\*")
CLASSIFICATIONS = ("UNCLASSIFIED", "CUI", "CONFIDENTIAL", "SECRET", "TOP SECRET")
BLANK = "[ \\t\\r\\n\\f]"


def normalise(c: Column) -> Column:
    """Dashes to hyphens, fixed spaces to spaces."""
    return F.translate(c, DASHES + SPACES, "-" * len(DASHES) + " " * len(SPACES))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """`normalise` after canonical composition; ASCII texts stay on the JVM side."""
    odd = c.rlike("[^\\x00-\\x7F]")
    return normalise(F.when(odd, _nfc(F.when(odd, c))).otherwise(c))


def strip(c: Column) -> Column:
    """Without ASCII white space at the ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def approx_tokens(c: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(F.size(tokens(c)) * F.lit(1.3).cast("double")).cast("int")


def label(c: Column) -> Column:
    """A safe label: other characters than letters, digits and _ become _; a leading digit gets one before it; empty or null is UNKNOWN."""
    s = F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    return F.when(s.isNull() | (s == ""), F.lit("UNKNOWN")).when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def is_foreign_script(c: Column) -> Column:
    """Whether a text of five characters or more has one outside Latin scripts; false for null."""
    return F.coalesce((F.length(c) >= 5) & c.rlike(NON_LATIN), F.lit(False))


def classification(c: Column) -> Column:
    """One of CLASSIFICATIONS, UNCLASSIFIED if it is none of them."""
    s = F.upper(F.trim(c))
    return F.when(s.isin(*CLASSIFICATIONS), s).otherwise(F.lit("UNCLASSIFIED"))


def shared_identifier(a: Column, b: Column) -> Column:
    """Whether two texts hold an identifier in common; false for null."""
    found = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    return reduce(lambda x, y: x | y, (F.coalesce(F.arrays_overlap(found(a, p), found(b, p)), F.lit(False)) for p in IDENTIFIERS))


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells between ' | '; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))), " | ")), "\n")


def query_terms(c: Column) -> Column:
    """A fulltext query of fuzzy terms, all wanted: signs of the query language are escaped."""
    return F.array_join(F.transform(tokens(c), lambda w: F.concat(F.regexp_replace(w, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1"), F.lit("~"))), " AND ")


def sections(c: Column) -> Column:
    """Sections of a description, headers included: by the first kind of header that occurs twice, else by paragraphs, else whole.

    Pieces under ten characters are left out. A blank text and one under ten
    characters have no sections; null stays null.
    """
    long = lambda a: F.filter(F.transform(a, strip), lambda x: F.length(x) >= 10)
    out = long(F.split(c, "\\n\\n"))
    for p in reversed(SECTION_HEADERS):
        twice = F.size(F.regexp_extract_all(c, F.lit(f"(?md){p}"), F.lit(0))) >= 2
        out = F.when(twice, long(F.split(c, f"(?md)(?={p})"))).otherwise(out)
    return F.when(F.size(out) > 0, out).when(c.isNotNull(), long(F.array(c)))


#: Letters that tell languages of other scripts than Latin, tried in this order.
SCRIPT_LANGUAGES = (
    ("uk", "[\u0404\u0406\u0407\u0454\u0456\u0457\u0490\u0491]"), ("ru", "[\u0400-\u04ff]"), ("ja", "[\u3040-\u30ff]"), ("zh", "[\u4e00-\u9fff]"), ("ko", "[\uac00-\ud7af]"),
    ("ar", "[\u0600-\u06ff]"), ("hi", "[\u0900-\u097f]"), ("th", "[\u0e00-\u0e7f]"), ("he", "[\u0590-\u05ff]"),
)


def script_language(c: Column) -> Column:
    """The language that a text's script speaks for, null for texts in Latin script or of under five characters."""
    out = F.lit(None).cast("string")
    for lang, letters in reversed(SCRIPT_LANGUAGES):
        out = F.when(c.rlike(letters), lang).otherwise(out)
    return F.when(is_foreign_script(c), out)


def json_text(c: Column) -> Column:
    """The JSON value within a model's answer: whole, after a thinking tag or an answer marker, in a fence, the last bracketed span, or that span repaired; null if none parses."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"(?is)^.*?(final answer|answer)\s*:\s*", "")
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    good = lambda s: F.when(F.try_parse_json(s).isNotNull() & strip(s).rlike(r"^[\[{]"), strip(s))
    return F.coalesce(good(c), good(bare), good(fence), _last_json(c))


def bracketed(text: str) -> list[tuple[int, int]]:
    """[start, end) of the outermost bracketed spans of a text, in one pass; brackets within quotes of a span don't count, and an unclosed one reaches to the end."""
    spans, stack, start, quoted, skip = [], [], 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"' and stack:
            quoted = True
        elif c in "{[":
            if not stack:
                start = i
            stack.append("}" if c == "{" else "]")
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                spans.append((start, i + 1))
        elif c in "}]":
            stack.clear()
    return spans + ([(start, len(text))] if stack else [])


def repaired_json(span: str) -> str:
    """A span with its usual faults mended: single quotes, bare keys, Python's constants, commas before closers, missing closers."""
    import re

    s = re.sub(r"(?<![\w\\])'((?:[^'\\]|\\.)*)'(?!\w)", lambda m: '"' + m.group(1).replace('"', '\\"') + '"', span)
    s = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', s)
    s = re.sub(r"\b(True|False|None)\b", lambda m: {"True": "true", "False": "false", "None": "null"}[m.group()], s)
    stack, quoted, skip = [], False, False
    for c in s:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif stack and c == stack[-1]:
            stack.pop()
    s = s.rstrip() + '"' * quoted
    return re.sub(r",\s*([}\]])", r"\1", s.rstrip(", ") + "".join(reversed(stack)))


@F.pandas_udf(T.StringType())
def _last_json(s: pd.Series) -> pd.Series:
    import json

    def last(text: str | None) -> str | None:
        spans = [text[a:b] for a, b in reversed(bracketed(text))] if text else []
        for own in (spans, map(repaired_json, spans)):
            for span in own:
                try:
                    json.loads(span)
                except ValueError:
                    continue
                return span
        return None

    return s.map(last)
