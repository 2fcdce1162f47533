"""Column functions on text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of a keyword query.
STOPWORDS = ("the", "is", "are", "for", "and", "or", "not", "when", "with", "from", "this", "than", "within", "reached")
#: Korean terms and the English words they stand for in a keyword query.
ALIASES = {
    "보정": ["compensation", "calibration"], "압력": ["pressure"], "캡": ["cap", "caps"], "전극": ["electrode"], "마모": ["wear", "abrasion"],
    "드리프트": ["drift"], "누설": ["leakage"], "위치": ["position"], "밸브": ["valve"], "케이블": ["cable"], "마찰": ["friction"], "교정": ["calibration"],
    "호밍": ["homing"], "윤활": ["lubrication"], "힘": ["force"], "냉각": ["cooling"], "밀링": ["milling"], "드레싱": ["milling"], "영점": ["zero"], "공급": ["supply"],
    "펌웨어": ["firmware"], "업데이트": ["update"], "제어권": ["master", "control"], "필드버스": ["fieldbus"], "전원": ["power", "voltage"], "공압": ["pneumatic"],
}
#: Phrases of a question that goes on from the one before.
FOLLOW_UP = "그럼|그다음|그 다음|다음엔|그건|그거|이 경우|더 자세히"
#: The forms of lines in a manual.
SECTION, ERROR_ROW = r"^\d+(?:\.\d+)*\s+\S", r"^Error number:\s*(\d+)\s*\|"
CAUSE_REMEDY, RESERVE = r"^Cause:\s*.+\s\|\sRemedy:\s*.+", r"(?i)^Error number:\s*\d+\s*\|\s*Error text:\s*Reserve(?:\s*\||$)"
TABLE_MARKER, FIGURE_MARKER = r"^\[Table(?:\s|;)", r"^\[(?:Figure|Fig\.|Uncaptioned image)"


def hash_id(*parts: Column, length: int = 32, sha1: bool = False) -> Column:
    """The first ``length`` hex digits of a hash of the parts, joined by a bar (F2)."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.sha1(joined) if sha1 else F.sha2(joined, 256), 1, length)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys and no blanks; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def collapsed(text: Column) -> Column:
    """Words broken by a hyphen at a line's end are joined, white space is one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-[ \t]*\n[ \t]*", ""), r"\s+", " "))


def letters_only(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def query_terms(text: Column, stop: Sequence[str] = STOPWORDS, most: int = 24, aliases: Mapping[str, Sequence[str]] = ALIASES) -> Column:
    """Distinct lower-case terms in order, without stopwords, then those of aliases found; at most ``most``."""
    own = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9-]+)"), F.lit(1)), lambda t: F.lower(t))
    more = [F.when(F.contains(text, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in aliases.items()]
    terms = F.concat(own, *more) if more else own
    return F.slice(F.array_distinct(F.filter(terms, lambda t: ~t.isin(*stop))), 1, most)


def follow_up_query(question: Column, before: Column, pattern: str = FOLLOW_UP) -> Column:
    """The question, after the user's turn before it where it goes on from that."""
    goes_on = question.rlike(pattern) & before.isNotNull() & (before != "")
    return F.when(goes_on, F.concat(before, F.lit("\n"), question)).otherwise(question)


def error_code(text: Column, supported: Sequence[str]) -> Column:
    """The only supported code in a text; with none supported the first of all; with several null (F8)."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])(E\d{3})(?!\d)"), F.lit(1)))
    known = F.filter(found, lambda c: c.isin(*supported))
    return F.when(F.size(known) == 1, known[0]).when(F.size(known) == 0, F.try_element_at(found, F.lit(1)))


def searchable(text: Column, least: int = 20) -> Column:
    """Whether enough Latin or Hangul letters are left without bracketed markers and section lines."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"(?m)^\d+(?:\.\d+)*\s+\S.*$", "")
    return F.length(F.regexp_replace(plain, "[^A-Za-z가-힣]", "")) >= least


def holds(text: Column, quote: Column) -> Column:
    """Whether a text contains a quote, both collapsed."""
    return F.contains(collapsed(text), collapsed(quote))


def shortest_line(text: Column, quote: Column, prefix: str | None = None) -> Column:
    """The shortest line that contains the quote (and has the prefix), the first of equals; else null."""
    fits = lambda x: F.contains(x, quote) & (x.rlike(prefix) if prefix else F.lit(True))
    lines = F.filter(F.split(text, "\n"), fits)
    pairs = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("line")))
    return F.array_min(pairs)["line"]


def row_text(headers: Column, cells: Column) -> Column:
    """header: value of a table row's cells, joined by bars; empty cells are left out (K1)."""
    pairs = F.arrays_zip(headers.alias("h"), cells.alias("c"))
    kept = F.filter(pairs, lambda p: p["c"].isNotNull() & (F.trim(p["c"]) != ""))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), " | ")


def unit_kind(line: Column) -> Column:
    """What a line of a manual is: the first form that fits (K5)."""
    return (
        F.when(line.rlike(RESERVE), "reserve").when(line.rlike(ERROR_ROW), "error_row").when(line.rlike(CAUSE_REMEDY), "cause_remedy")
        .when(line.rlike(TABLE_MARKER), "table_marker").when(line.rlike(FIGURE_MARKER), "figure").when(line.rlike(SECTION), "section")
        .when(F.contains(line, F.lit(" | ")), "table_row").otherwise("prose")
    )


def draw(*parts: Column) -> Column:
    """A number from 0 to below 1, evenly spread and always the same for the same parts: 32 bits of their MD5.

    Parts are written out and joined by "|", nulls as nothing.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
