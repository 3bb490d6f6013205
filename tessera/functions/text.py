"""Scalar text functions as native Column expressions.

Everything here builds Catalyst expressions, so it runs inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  Character classes that reproduce Python's ``str.strip`` /
# ``str.isspace`` and ``str.splitlines`` rules.  The same pattern text is
# valid in Java regex (Spark) and RE2 (DuckDB), so oracles can reuse it.
# ---------------------------------------------------------------------------
WS_CHARS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_CHARS + "]"
NON_WS = "[^" + WS_CHARS + "]"
LINE_BREAK = r"(?:\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"
RULE_WIDTH = 60          # length of the "=" rule under a chunk header
SCORE_FORMAT = "%.4f"    # score shown with four decimals
CLIP_CHARS = 1500        # characters of chunk text shown in a hit listing
MISSING = "N/A"          # shown for absent metadata


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- F3 / P2 ---------------------------------------------------------------
def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+\\z", "")


def py_lstrip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{WS}+", "")


def is_blank(c) -> Column:
    """Null or whitespace only."""
    c = _c(c)
    return c.isNull() | ~c.rlike(NON_WS)


# -- P1 / P2 / P3 ----------------------------------------------------------
def non_null_cells(cells) -> Column:
    """Drop missing cells, keep blanks."""
    return F.filter(_c(cells), lambda x: x.isNotNull())


def non_blank_cells(cells) -> Column:
    """Drop null and whitespace-only cells; kept values keep their spaces."""
    return F.filter(_c(cells), lambda x: x.isNotNull() & x.rlike(NON_WS))


# -- P6 / P7 ---------------------------------------------------------------
def row_plain_text(cells) -> Column:
    """Non-null cells joined by one space (blank cells kept)."""
    return F.array_join(non_null_cells(cells), " ")


def row_labelled_parts(columns, cells) -> Column:
    """``col: value`` for every non-blank cell, in column order."""
    pairs = F.arrays_zip(_c(columns).alias("k"), _c(cells).alias("v"))
    kept = F.filter(pairs, lambda p: p["v"].isNotNull() & p["v"].rlike(NON_WS))
    return F.transform(kept, lambda p: F.concat(F.coalesce(p["k"], F.lit("")), F.lit(": "), p["v"]))


def row_labelled_text(row_idx, columns, cells) -> Column:
    """``Row <n>: col: value | col: value``; null when no cell is left."""
    parts = row_labelled_parts(columns, cells)
    return F.when(F.size(parts) > 0,
                  F.concat(F.lit("Row "), (_c(row_idx) + 1).cast("string"), F.lit(": "),
                           F.array_join(parts, " | ")))


# -- P5 / P7 marker ---------------------------------------------------------
def has_marker_cell(cells, marker: str) -> Column:
    """P5: a non-null cell whose stripped text starts with ``marker``."""
    return F.exists(_c(cells), lambda x: x.isNotNull() & F.startswith(py_lstrip(x), F.lit(marker)))


def section_label(cells, marker: str) -> Column:
    """K7: label of a marker row.

    First non-null cell that *contains* the marker; ``Test Number <n>`` when
    the label pattern matches, else the stripped cell; ``Unknown Test`` if no
    cell contains the marker.
    """
    first = F.try_element_at(F.filter(_c(cells), lambda x: x.isNotNull() & x.contains(marker)), F.lit(1))
    stripped = py_strip(first)
    num = F.regexp_extract(stripped, LABEL_PATTERN, 1)
    return (F.when(first.isNull(), F.lit(UNKNOWN_LABEL))
            .when(stripped.rlike(LABEL_PATTERN), F.concat(F.lit(LABEL_PREFIX), num))
            .otherwise(stripped))


# Fixed values of the label rule.
LABEL_PATTERN = (r"(?i)Test Number[:\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*([0-9.]+)")
LABEL_PREFIX = "Test Number "
UNKNOWN_LABEL = "Unknown Test"


# -- P8 CSV text -------------------------------------------------------------
def csv_field(c) -> Column:
    """One field as pandas ``to_csv`` writes it (minimal quoting, doubled
    quotes, null as empty)."""
    c = _c(c)
    needs = c.rlike('[,"\\n\\r]')
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), F.lit("")).when(needs, quoted).otherwise(c)


def csv_line(cells) -> Column:
    return F.array_join(F.transform(_c(cells), lambda x: csv_field(x)), ",")


# -- P10 / P11 ---------------------------------------------------------------
def base_name(name) -> Column:
    """P10: file name without its last extension."""
    return F.regexp_replace(_c(name), r"\.[^./]*$", "")


def file_name(path) -> Column:
    """Last path component of a path or URL."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def chunk_id(base, sep: str, n) -> Column:
    """``base<sep><n>``."""
    return F.concat(_c(base), F.lit(sep), _c(n).cast("string"))


# -- P13 / P14 / P15 ----------------------------------------------------------
def or_missing(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(MISSING))


def clip(c, n: int = CLIP_CHARS) -> Column:
    return F.substring(_c(c), 1, n)


def score_text(c) -> Column:
    return F.format_string(SCORE_FORMAT, _c(c))


# -- A4 ------------------------------------------------------------------------
def line_count(c) -> Column:
    """Python ``len(text.splitlines())``."""
    c = _c(c)
    breaks = F.size(F.split(c, LINE_BREAK)) - 1
    tail = F.when((F.length(c) > 0) & ~c.rlike(LINE_BREAK + r"\z"), 1).otherwise(0)
    return (breaks + tail).cast("bigint")


# -- F5 ------------------------------------------------------------------------
REASONING_PATTERN = r"(?s)<reasoning>.*</reasoning>"


def strip_reasoning(c) -> Column:
    """Drop everything from the first open to the last close tag."""
    return F.regexp_replace(_c(c), REASONING_PATTERN, "")


# -- F12 -----------------------------------------------------------------------
def fill_template(template: str, **slots) -> Column:
    """Fill ``{name}`` slots in one pass (text put in is never re-scanned).

    The template is split at its slots on the driver (it is a parameter, not
    data) and the pieces are concatenated with the slot columns.
    """
    parts = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise KeyError(f"template slot {field!r} has no column")
            parts.append(F.coalesce(_c(slots[field]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
