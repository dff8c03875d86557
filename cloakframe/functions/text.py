"""Text helpers: scalar-to-text, field names, field paths, previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT_PATH = "<root>"

_STRIP = r"\A[\p{IsWhite_Space}\x1C-\x1F]+|[\p{IsWhite_Space}\x1C-\x1F]+\z"


def strip_unicode(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` knows only the blank)."""
    return F.regexp_replace(text, _STRIP, "")


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def identifier(name: str) -> str:
    """Column name as SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def strip_sql(text: str) -> str:
    """``strip_unicode`` as SQL text."""
    return f"regexp_replace({text}, {quoted(_STRIP)}, '')"


def cell_text(value: str, dtype: T.DataType) -> str:
    """Text of a scalar (SQL expression) as the rules see it; null stays null.

    Differs from a plain cast for booleans (``True``), doubles that Spark would
    write in scientific notation although they are printed plainly elsewhere,
    and timestamps with a fraction (always six digits).
    """
    plain = f"cast({value} as string)"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return value
    if isinstance(dtype, T.BooleanType):
        return f"initcap({plain})"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        digits = f"cast(cast(cast({value} as double) as decimal(38,21)) as string)"
        spelled = f"regexp_replace(regexp_replace({digits}, '0+$', ''), '[.]$', '.0')"
        return (f"CASE WHEN abs({value}) >= 1e7 AND abs({value}) < 1e16 OR abs({value}) >= 1e-4 "
                f"AND abs({value}) < 1e-3 THEN {spelled} ELSE {plain} END")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"CASE WHEN contains({plain}, '.') THEN rpad({plain}, instr({plain}, '.') + 6, '0') ELSE {plain} END"
    return plain


def normalize_name(name: str) -> str:
    """Field name with only ``[a-z0-9]`` runs, joined by ``_`` (driver side)."""
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def normalize_name_sql(name: str) -> str:
    """Field name normalization for names that are data (map keys), as SQL text."""
    return (f"regexp_replace(regexp_replace(lower({strip_sql(name)}), "
            f"'[^a-z0-9]+', '_'), '^_+|_+$', '')")


def hint_pattern(hints: tuple[str, ...]) -> str:
    """Pattern of normalized names that equal a hint or start or end with it as a word."""
    words = "|".join(hints)
    return rf"\A(?:(?:{words})(?:_.*)?|.*_(?:{words}))\z"


def name_fits(hints: tuple[str, ...], name: str) -> bool:
    return re.fullmatch(hint_pattern(hints)[2:-2], normalize_name(name)) is not None


def name_fits_sql(hints: tuple[str, ...], name: str) -> str:
    return f"rlike({normalize_name_sql(name)}, {quoted(hint_pattern(hints))})"


class FieldPath:
    """A field path below construction: fixed text as far as possible, SQL where it is data."""

    def __init__(self, parts: tuple[tuple[bool, str], ...] = ()):
        self.parts = parts

    def _text(self, text: str) -> FieldPath:
        if self.parts and self.parts[-1][0]:
            return FieldPath((*self.parts[:-1], (True, self.parts[-1][1] + text)))
        return FieldPath((*self.parts, (True, text)))

    def key(self, name: str) -> FieldPath:
        return self._text(f".{name}" if self.parts else name)

    def data_key(self, name: str) -> FieldPath:
        base = self._text(".") if self.parts else self
        return FieldPath((*base.parts, (False, name)))

    def index(self, position: str) -> FieldPath:
        return FieldPath((*self._text("[").parts, (False, f"cast({position} as string)")))._text("]")

    def sql(self) -> str:
        """Printable path; the empty path is the root."""
        parts = [quoted(p) if fixed else p for fixed, p in self.parts]
        if not parts:
            return quoted(ROOT_PATH)
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def safe_preview(value: Column, visible: int = 2) -> Column:
    """First and last ``visible`` characters around ``***``; short values all stars."""
    return F.when(F.length(value) <= 2 * visible, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.substring(value, 1, visible), F.lit("***"), F.right(value, F.lit(visible))))
