"""Protecting single values: masks, redaction, and replacing them in a text.

Every function takes and returns a Column and stays inside the JVM.  They are
applied to detected values, which are short, not to whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# (The letter beyond U+FFFF makes Java look behind by whole code points.)
_ALNUM = r"[\p{L}\p{N}𝐀]"
# Digits as str.isdigit() counts them: decimal digits plus these (superscripts,
# subscripts, circled and other non-decimal digits).
_DIGIT_CLASS = (
    r"\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿"
    r"❶-❾➀-➈➊-➒"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
_DIGIT = f"[{_DIGIT_CLASS}]"
_OTHER = f"[^{_DIGIT_CLASS}]"

# One alphanumeric character that is hidden: inside a run, or in a run of one or two.
_HIDDEN = (
    f"(?<={_ALNUM}){_ALNUM}(?={_ALNUM})"
    f"|(?<!{_ALNUM}){_ALNUM}(?!{_ALNUM})"
    f"|(?<!{_ALNUM}){_ALNUM}(?={_ALNUM}(?!{_ALNUM}))"
    f"|(?<=(?<!{_ALNUM}){_ALNUM}){_ALNUM}(?!{_ALNUM})"
)


def _stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), count.cast("int"))


def mask_middle(value: Column, keep_start: int = 1, keep_end: int = 1) -> Column:
    """Keep both ends; a value too short for that becomes all stars; null becomes ``""``."""
    size = F.length(value)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(size <= keep_start + keep_end, _stars(size))
        .otherwise(F.concat(
            F.substring(value, 1, keep_start),
            _stars(size - (keep_start + keep_end)),
            F.right(value, F.lit(keep_end)),
        ))
    )


def mask_tokens(value: Column) -> Column:
    """Mask every run of letters and numbers on its own, keep all other characters."""
    return F.regexp_replace(value, _HIDDEN, "*")


def mask_email(value: Column) -> Column:
    """Mask the part before the first ``@``, keep the domain."""
    at = F.instr(value, "@")
    return F.when(at == 0, mask_middle(value)).otherwise(
        F.concat(mask_tokens(F.substring_index(value, "@", 1)), F.substring(value, at, F.length(value))))


def mask_phone(value: Column) -> Column:
    """Keep the first five and last three digits and all separators.

    Up to four digits the value is masked as a whole; with five to eight digits
    the kept digits are all of them.
    """
    digits = F.length(F.regexp_replace(value, _OTHER, ""))
    head = F.regexp_extract(value, rf"\A(?:{_OTHER}*{_DIGIT}){{5}}", 0)
    tail = F.regexp_extract(value, rf"(?:{_DIGIT}{_OTHER}*){{3}}\z", 0)
    middle = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
    return (
        F.when(digits <= 4, mask_middle(value))
        .when(digits <= 8, value)
        .otherwise(F.concat(head, F.regexp_replace(middle, _DIGIT, "*"), tail))
    )


def mask_ip(value: Column) -> Column:
    """Keep the outer parts of a dotted quad; anything else is masked by token."""
    quad = rf"\A{_DIGIT}+\.{_DIGIT}+\.{_DIGIT}+\.{_DIGIT}+\z"
    return F.when(value.rlike(quad), F.concat(
        F.substring_index(value, ".", 1), F.lit(".***.***."), F.substring_index(value, ".", -1),
    )).otherwise(mask_tokens(value))


def mask_value(value: Column, entity_type: Column) -> Column:
    """Mask a value the way its entity type asks for."""
    return (
        F.when(entity_type == "EMAIL", mask_email(value))
        .when(entity_type == "PHONE", mask_phone(value))
        .when(entity_type == "IP_ADDRESS", mask_ip(value))
        .when(entity_type.isin("PERSON_NAME", "ADDRESS", "BIRTH_DATE"), mask_tokens(value))
        .when(entity_type.isin("TAX_CODE", "IBAN"), mask_middle(value, 2, 2))
        .otherwise(mask_middle(value))
    )


def redact_value(entity_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), entity_type, F.lit("]"))


def protect_value(mode: str, value: Column, entity_type: Column) -> Column:
    """Sanitized value for the two modes that need nothing but the value itself."""
    if mode == "mask":
        return mask_value(value, entity_type)
    if mode == "redact":
        return redact_value(entity_type)
    raise ValueError(f"mode {mode!r} needs the pseudonym table; see operators.pseudonyms")


# Replace all occurrences of each hit's value in {text}, one hit after the other;
# a later hit sees the text as the earlier ones left it.
REPLACE_IN_ORDER = "aggregate({hits}, {text}, (t, h) -> replace(t, h.value, h.sanitized))"
# New text of a non-text cell: the first hit replaces the whole value.
REPLACE_WHOLE = (
    "aggregate({hits}, cast(null as string), "
    "(t, h) -> CASE WHEN t IS NULL THEN h.sanitized ELSE replace(t, h.value, h.sanitized) END)"
)
