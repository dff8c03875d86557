"""Independent single-process statements of the expected results, used to check the Spark operators."""

import re
from itertools import groupby

# The rules as Python regular expressions.
RULES = {
    "EMAIL": r"(?i)(?<![\w.-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])",
    "PHONE": r"(?<!\d)(?:\+\d{1,3}\s?)?(?:\(\d{2,4}\)\s?)?\d{2,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?!\d)",
    "TAX_CODE": r"(?i)(?<![A-Z0-9])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![A-Z0-9])",
    "IBAN": r"(?i)(?<![A-Z0-9])IT\d{2}[A-Z]\d{10}[A-Z0-9]{12}(?![A-Z0-9])",
    "BIRTH_DATE": (
        r"(?<!\d)(?:(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19\d{2}|20\d{2})"
        r"|(?:19\d{2}|20\d{2})[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01]))(?!\d)"
    ),
    "IP_ADDRESS": (
        r"(?<!\d)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d)"
    ),
}
PERSON = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]+(?:\s+[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`-]+)+"
ADDRESS = (r"(?i)(?:via|viale|piazza|corso|largo|vicolo|piazzale|strada|street|road|avenue|boulevard|lane)"
           r"\s+.+(?:\d|,).*")
COMPILED = {name: re.compile(p) for name, p in RULES.items()}


def find(text, fits_person=False, fits_address=False):
    """Hits of one text in detection order: (type, value, start, end)."""
    hits = [(name, m.group(), m.start(), m.end()) for name, p in COMPILED.items() for m in p.finditer(text)]
    bare = text.strip()
    if bare and fits_person and re.fullmatch(PERSON, bare):
        hits.append(("PERSON_NAME", bare, 0, len(bare)))
    if bare and fits_address and re.fullmatch(ADDRESS, bare):
        hits.append(("ADDRESS", bare, 0, len(bare)))
    return hits


def middle(text, start=1, end=1):
    hidden = len(text) - start - end
    return "*" * len(text) if hidden <= 0 else text[:start] + "*" * hidden + text[-end:]


def tokens(text):
    return "".join(middle("".join(run)) if word else "".join(run) for word, run in groupby(text, str.isalnum))


def mask(value, kind):
    if kind == "EMAIL":
        local, at, domain = value.partition("@")
        return tokens(local) + at + domain if at else middle(value)
    if kind == "PHONE":
        where = [i for i, c in enumerate(value) if c.isdigit()]
        if len(where) <= 4:
            return middle(value)
        hidden = set(where[5:-3]) if len(where) > 8 else set()
        return "".join("*" if i in hidden else c for i, c in enumerate(value))
    if kind == "IP_ADDRESS":
        parts = value.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            return f"{parts[0]}.***.***.{parts[3]}"
        return tokens(value)
    return middle(value, 2, 2) if kind in ("TAX_CODE", "IBAN") else tokens(value)


def sanitize(text, hits, protect):
    for kind, value, *_ in hits:
        text = text.replace(value, protect(value, kind))
    return text
