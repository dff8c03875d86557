"""Detection rules as data: entity types, patterns, field hints, label map.

Everything here is a driver-side constant.  Patterns are Java regular
expressions because Spark evaluates them on the executors.  They spell their
character classes out instead of using ``(?i)``, ``(?U)``, ``\\w``, ``\\s`` so
that Java agrees code point by code point with Python's ``re`` on ``str``:

* a word character is a letter, a number or ``_`` (no combining marks);
* white space also covers the separators U+001C..U+001F;
* a caseless ``[A-Z]`` also covers U+0130, U+0131, U+017F and U+212A;
* a lookbehind names one letter or digit beyond U+FFFF (already in its class),
  because only then does Java look back by whole code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------

ENTITY_TYPES = (
    "EMAIL",
    "PHONE",
    "TAX_CODE",
    "IBAN",
    "BIRTH_DATE",
    "ADDRESS",
    "IP_ADDRESS",
    "PERSON_NAME",
)
MODES = ("mask", "redact", "pseudonymize")
INPUT_FORMATS = ("csv", "json", "txt", "pdf", "sql")
REPORT_FORMATS = ("json", "html")

EMAIL_PATTERN = (
    r"(?<![\p{L}\p{N}_.𝐀-])[A-Za-z\u0130\u0131\u017F\u212A0-9._%+-]++"
    r"@[A-Za-z\u0130\u0131\u017F\u212A0-9.-]+\.[A-Za-z\u0130\u0131\u017F\u212A]{2,}(?![\p{L}\p{N}_.-])"
)
# A long run of address characters is passed over as a whole where no address can start in it: from its beginning if
# no @ follows, and from the first place an address could start if the part after the @ does not fit (any later place
# in the run meets the same @).  Without this, the search would start anew at every plus sign of an encoded token.
_RUN = r"[A-Za-z\u0130\u0131\u017F\u212A0-9._%+-]"
EMAIL_SEARCH = rf"{EMAIL_PATTERN}|(?<!{_RUN}){_RUN}{{256,}}+(?!@)|(?<![\p{{L}}\p{{N}}_.𝐀-]){_RUN}{{256,}}+"
PHONE_PATTERN = (
    r"(?<![\p{Nd}𝟎])(?:\+\p{Nd}{1,3}[\p{IsWhite_Space}\x1C-\x1F]?)?"
    r"(?:\(\p{Nd}{2,4}\)[\p{IsWhite_Space}\x1C-\x1F]?)?"
    r"\p{Nd}{2,4}[\p{IsWhite_Space}\x1C-\x1F.-]?\p{Nd}{3,4}[\p{IsWhite_Space}\x1C-\x1F.-]?\p{Nd}{3,4}(?!\p{Nd})"
)
TAX_CODE_PATTERN = (
    r"(?<![A-Za-z\u0130\u0131\u017F\u212A0-9])[A-Za-z\u0130\u0131\u017F\u212A]{6}\p{Nd}{2}"
    r"[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{2}[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{3}"
    r"[A-Za-z\u0130\u0131\u017F\u212A](?![A-Za-z\u0130\u0131\u017F\u212A0-9])"
)
IBAN_PATTERN = (
    r"(?<![A-Za-z\u0130\u0131\u017F\u212A0-9])[Ii\u0130\u0131][Tt]\p{Nd}{2}"
    r"[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{10}[A-Za-z\u0130\u0131\u017F\u212A0-9]{12}"
    r"(?![A-Za-z\u0130\u0131\u017F\u212A0-9])"
)
BIRTH_DATE_PATTERN = (
    r"(?<![\p{Nd}𝟎])(?:(?:0?[1-9]|[12]\p{Nd}|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19\p{Nd}{2}|20\p{Nd}{2})"
    r"|(?:19\p{Nd}{2}|20\p{Nd}{2})[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\p{Nd}|3[01]))(?!\p{Nd})"
)
IP_ADDRESS_PATTERN = (
    r"(?<![\p{Nd}𝟎])(?:(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})\.){3}"
    r"(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})(?!\p{Nd})"
)
# Possessive quantifiers: word characters and white space are disjoint, so no
# split is lost, and Java matches a long value in a loop instead of recursing.
PERSON_NAME_PATTERN = (
    r"\A[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]++"
    r"(?:[\p{IsWhite_Space}\x1C-\x1F]++[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]++)++\z"
)
ADDRESS_PATTERN = (
    r"(?iu)\A(?:via|viale|piazza|corso|largo|vicolo|piazzale|strada|street|road|avenue|boulevard|lane)"
    r"[\p{IsWhite_Space}\x1C-\x1F]+[^\n]+(?:\p{Nd}|,)[^\n]*\z"
)
PERSON_NAME_HINTS = (
    "full_name",
    "person_name",
    "name",
    "nome",
    "first_name",
    "last_name",
    "contact_name",
)
ADDRESS_HINTS = (
    "address",
    "street_address",
    "home_address",
    "billing_address",
    "shipping_address",
    "address_line",
    "indirizzo",
)

# External analyzer label -> entity type.
LABEL_MAP = {
    "EMAIL_ADDRESS": "EMAIL",
    "EMAIL": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "PHONE": "PHONE",
    "IT_FISCAL_CODE": "TAX_CODE",
    "IBAN_CODE": "IBAN",
    "DATE_TIME": "BIRTH_DATE",
    "BIRTH_DATE": "BIRTH_DATE",
    "LOCATION": "ADDRESS",
    "ADDRESS": "ADDRESS",
    "IP_ADDRESS": "IP_ADDRESS",
    "PERSON": "PERSON_NAME",
    "PERSON_NAME": "PERSON_NAME",
}
# Labels asked for when the caller names none.
DEFAULT_LABELS = (
    "EMAIL_ADDRESS",
    "PHONE_NUMBER",
    "IT_FISCAL_CODE",
    "IBAN_CODE",
    "DATE_TIME",
    "LOCATION",
    "IP_ADDRESS",
    "PERSON",
)

# --- rules ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """One regular-expression rule.

    ``min_bytes``, ``literal`` and ``gate`` describe text that *every* match
    contains.  They are cheap necessary conditions, checked before the full
    pattern; they never reject a text the pattern would match.
    """

    entity_type: str
    pattern: str
    confidence: float
    name: str
    min_bytes: int = 1
    literal: str | None = None
    gate: str | None = None
    # The pattern also matches stretches that are no hit; a hit contains ``literal``, those do not.
    passes_over: bool = False


@dataclass(frozen=True)
class ContextRule:
    """A whole-value rule that applies only to fields whose name fits a hint."""

    entity_type: str
    hints: tuple[str, ...]
    pattern: str
    confidence: float
    name: str


_DIGITS_GAP = r"\p{Nd}{2}[\p{IsWhite_Space}\x1C-\x1F.-]?\p{Nd}{3,4}[\p{IsWhite_Space}\x1C-\x1F.-]?\p{Nd}{3}"
_CODE_TAIL = (
    r"\p{Nd}{2}[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{2}"
    r"[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{3}"
)

DEFAULT_RULES = (
    Rule("EMAIL", EMAIL_SEARCH, 0.90, "email-regex", min_bytes=6, literal="@", passes_over=True),
    Rule("PHONE", PHONE_PATTERN, 0.70, "phone-regex", min_bytes=8, gate=_DIGITS_GAP),
    Rule("TAX_CODE", TAX_CODE_PATTERN, 0.95, "tax-code-regex", min_bytes=16, gate=_CODE_TAIL),
    Rule("IBAN", IBAN_PATTERN, 0.95, "iban-regex", min_bytes=27,
         gate=r"\p{Nd}{2}[A-Za-z\u0130\u0131\u017F\u212A]\p{Nd}{10}"),
    Rule("BIRTH_DATE", BIRTH_DATE_PATTERN, 0.85, "birth-date-regex", min_bytes=8,
         gate=r"[/-](?:0?[1-9]|1[0-2])[/-]"),
    Rule("IP_ADDRESS", IP_ADDRESS_PATTERN, 0.90, "ip-address-regex", min_bytes=7, literal=".",
         gate=r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}"),
)

CONTEXT_RULES = (
    ContextRule("PERSON_NAME", PERSON_NAME_HINTS, PERSON_NAME_PATTERN, 0.72, "person-name-context"),
    ContextRule("ADDRESS", ADDRESS_HINTS, ADDRESS_PATTERN, 0.78, "address-context"),
)


def check_entity_type(name: str) -> str:
    """Return ``name`` if it is one of the entity types, else raise ``ValueError``."""
    if name not in ENTITY_TYPES:
        raise ValueError(f"{name!r} is not a valid entity type; expected one of {', '.join(ENTITY_TYPES)}")
    return name


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"{mode!r} is not a valid mode; expected one of {', '.join(MODES)}")
    return mode


def entity_for_label(label: str) -> str:
    """Entity type of an external analyzer label; an entity type's own name passes through."""
    return LABEL_MAP.get(label) or check_entity_type(label)


_PY_ONLY_SYNTAX = re.compile(r"\\Z|\\.|\(\?P<|\(\?P=(\w+)\)", re.DOTALL)


def _java_syntax(pattern: str) -> str:
    """Spell the Python-only constructs (named groups, ``\\Z``) the way Java does."""

    def spell(m: re.Match[str]) -> str:
        if m.group(1):
            return rf"\k<{m.group(1)}>"
        return {"(?P<": "(?<", r"\Z": r"\z"}.get(m.group(0), m.group(0))

    return _PY_ONLY_SYNTAX.sub(spell, pattern)


def custom_rules(spark, patterns: Mapping[str, str | re.Pattern[str]] | None) -> tuple[Rule, ...]:
    """Turn ``{entity type: pattern}`` into rules that run after the default ones.

    Patterns are checked on the driver with the engine that will run them.  An
    unknown entity type, an invalid pattern and a pattern that matches the
    empty string (it would insert text everywhere) raise ``ValueError``.
    """
    rules = []
    for entity_type, raw in (patterns or {}).items():
        check_entity_type(entity_type)
        flags, unicode_flag = "d", "U"
        text = raw
        if isinstance(raw, re.Pattern):
            text = raw.pattern
            for letter, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)):
                flags += letter if raw.flags & bit else ""
            unicode_flag = "" if raw.flags & re.A else "U"
        java = f"(?{unicode_flag}{flags}){_java_syntax(text)}"
        try:
            regex = spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as exc:  # Py4J wraps PatternSyntaxException
            reason = str(getattr(exc, "java_exception", exc)).splitlines()[0]
            raise ValueError(f"Invalid custom regex rule for {entity_type}: {reason}") from exc
        if regex.matcher("").find():
            raise ValueError(f"Custom regex rule for {entity_type} matches the empty string")
        rules.append(Rule(entity_type, java, 0.80, f"custom-{entity_type.lower()}-regex"))
    return tuple(rules)


def select_rules(rules: Iterable, entities: Iterable[str] | None) -> tuple:
    """Keep the rules of the requested entity types (all when ``entities`` is None)."""
    if entities is None:
        return tuple(rules)
    wanted = {check_entity_type(e) for e in entities}
    return tuple(r for r in rules if r.entity_type in wanted)
