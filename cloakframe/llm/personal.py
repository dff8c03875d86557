"""Personal data in texts: fixed patterns, and spans that a semi-Markov conditional random field adds.

The field scores whole candidate segments (their digits, groups, separators,
checksums, neighbours), not single tokens, and a dynamic program over segments
of bounded length chooses boundaries and types together.  It is fitted here:
pattern hits of a bounded sample of documents are the labelled segments, also
in spellings that the patterns do not know; digits and signs that no pattern
hits are the rest.  Texts are searched in zones, stretches of words with a
digit or an ``@``; no segment crosses a zone's border, so deciding zone by zone
is deciding the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# --- fixed values: kinds in their order, and their patterns -------------------
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# An address starts with a whole run of digits, and a run's later digits cannot start one where its first cannot.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# ------------------------------------------------------------------------------

# Documents the field is fitted on, stretches of text taken from them, and the longest zone of a stretch in characters.
SAMPLE, WINDOWS, WIDE = 4_000, 4_000, 200
# Zones of the sample that enter the fit, labelled and unlabelled ones, and the most tokens of such a zone.
ZONES, ZONE_TOKENS = 1_000, 48
# Most tokens of a segment.
LONGEST = 24
ROUNDS, RATE, RIDGE = 150, 0.1, 0.02
# A segment is added if its probability given the text is at least this.
SURE = 0.5

_WORDS = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_TOKENS = re.compile(r"[0-9]++|[^\W\d_]++|.", re.DOTALL)
_DIGITS = re.compile(r"[0-9]++")
_BEFORE, _AFTER = re.compile(r"(?<!\S)\S{1,78} \Z"), re.compile(r" \S{1,78}(?!\S)")
# Words that announce a value of a kind.
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "fon", "appel", "llame", "cell"),
}
_CUE_OF = {word: kind for kind, cues in CUES.items() for word in cues}


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum of card numbers."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of the kind, end)`` of the pattern hits, by start and kind."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        # Leading zeros aside, a part of more than three digits is too large.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words with a digit or ``@``, with at most two spaces between neighbours.

    A word beside an ``@`` that stands free belongs to its zone.
    """
    start = end = -1
    for m in _WORDS.finditer(text):
        a, b = m.span()
        if text[a] == "@" and (before := _BEFORE.search(text, max(0, a - 80), a)):
            a = max(before.start(), end)
        if text[b - 1] == "@" and (after := _AFTER.match(text, b, b + 80)):
            b = after.end()
        if end >= 0 and (a <= end or text[end:a] in (" ", "  ")):
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


def free_zones(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The zones without the words that a pattern hit touches; hits are in order."""
    merged: list[list[int]] = []
    for s, _, e in taken:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    k = 0
    for a, b in zones(text):
        while k < len(merged) and merged[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(merged) and merged[j][0] < b:
            if at < merged[j][0]:
                yield at, merged[j][0]
            at = max(at, merged[j][1])
            j += 1
        if at < b:
            yield at, b


# --- features of a whole segment ----------------------------------------------

_FEATURES = [
    *[f"digits:{n}" for n in ("0", "1-6", *map(str, range(7, 20)), "20+")], *[f"groups:{n}" for n in ("0", "1", "2", "3", "4", "5+")],
    *[f"last:{n}" for n in ("1", "2", "3", "4", "5+")], *[f"sep:{s}" for s in ("none", "space", "dot", "hyphen", "slash", "colon", "mixed", "other")],
    "equal groups", "plus", "paren", "unclosed", "luhn", "no luhn", "octets", "too large octet", "at", "two ats", "host with dot", "letters last",
    "letters", "letter and digits only", "leading zero", *[f"left:{c}" for c in ("edge", "letter", "digit", "sign")],
    *[f"right:{c}" for c in ("edge", "letter", "digit", "sign")], *[f"cue:{k}" for k in KINDS], "year", "one"]
_AT = {name: i for i, name in enumerate(_FEATURES)}
_SEPARATORS = {"": "none", " ": "space", ".": "dot", "-": "hyphen", "/": "slash", ":": "colon"}


def _neighbour(char: str) -> str:
    return "edge" if not char or char.isspace() else "digit" if char in "0123456789" else "letter" if char.isalpha() else "sign"


def features(value: str, left: str, right: str, cue: str | None) -> list[int]:
    """Numbers of the features that hold for a segment, between its neighbouring characters and after a cue for a kind."""
    groups = _DIGITS.findall(value)
    digits = "".join(groups)
    n = len(digits)
    names = [
        "one", f"digits:{'0' if not n else '1-6' if n < 7 else n if n < 20 else '20+'}", f"groups:{len(groups) if len(groups) < 5 else '5+'}",
        f"left:{_neighbour(left)}", f"right:{_neighbour(right)}"]
    signs = {c for c in re.sub(r"[0-9()+]+", "", value)}
    has_letters = any(c.isalpha() for c in signs)
    if has_letters:
        names.append("letters")
        signs = {c for c in signs if not c.isalpha()}
        if not signs:
            names.append("letter and digits only")
    names.append("sep:" + ("none" if not signs else _SEPARATORS.get(next(iter(signs)), "other") if len(signs) == 1
                           else "mixed" if signs <= set(" .-") else "other"))
    if groups:
        names.append(f"last:{len(groups[-1]) if len(groups[-1]) < 5 else '5+'}")
        if groups[0][0] == "0":
            names.append("leading zero")
        if len(groups) > 2 and len({len(g) for g in groups}) == 1:
            names.append("equal groups")
        if any(len(g) == 4 and g[:2] in ("19", "20") for g in groups):
            names.append("year")
    if value[:1] == "+":
        names.append("plus")
    if "(" in value or ")" in value:
        names.append("paren" if value.count("(") == value.count(")") else "unclosed")
    if 14 <= n <= 19 and not has_letters:
        names.append("luhn" if luhn(digits) else "no luhn")
    if len(groups) == 4 and not has_letters and ".".join(groups) == value:
        names.append("octets" if all(len(g) < 4 and int(g) < 256 for g in groups) else "too large octet")
    if "@" in value:
        local, _, host = value.partition("@")
        names.append("at" if "@" not in host and local.strip() and host.strip() else "two ats")
        if "." in host.strip(" ."):
            names.append("host with dot")
        if re.search(r"\.[A-Za-z]{2,12}\Z", host):
            names.append("letters last")
    if cue is not None:
        names.append(f"cue:{cue}")
    return [_AT[x] for x in dict.fromkeys(names)]


@dataclass
class Lattice:
    """Tokens of a zone and its candidate segments ``(first token, end token, features)``."""

    places: list[int]
    segments: list[tuple[int, int, list[int]]]


def lattice(text: str, start: int, end: int) -> Lattice | None:
    """Candidates of a zone: from a digit, letter, ``+`` or ``(`` to a digit or letter, with seven digits or an ``@`` at least.

    None when the zone can have none.
    """
    zone = text[start:end]
    if "@" not in zone and sum(map(len, _DIGITS.findall(zone))) < 7:
        return None
    tokens = _TOKENS.findall(zone)
    places = [start]
    for t in tokens:
        places.append(places[-1] + len(t))
    ends_at = [t[-1].isalnum() for t in tokens]
    begins = [t[0].isalnum() or t[0] in "+(" for t in tokens]
    digits = [len(t) if t[0] in "0123456789" else 0 for t in tokens]
    before = text[max(0, start - 40):start].split()
    said = _CUE_OF.get(before[-1].strip(".,:;()").lower()) if before else None
    segments = []
    for i in range(len(tokens)):
        if not begins[i]:
            continue
        cue = said if i == 0 else next((_CUE_OF[t.lower()] for t in tokens[max(0, i - 3):i] if t.lower() in _CUE_OF), None)
        n, at = 0, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            n += digits[j]
            at = at or tokens[j] == "@"
            if n > 24 and not at:
                break
            if ends_at[j] and (at or n >= 7):
                a, b = places[i], places[j + 1]
                segments.append((i, j + 1, features(text[a:b], text[a - 1:a], text[b:b + 1], cue)))
    return Lattice(places, segments) if segments else None


class Field:
    """Weights of the field: one per feature and kind, and one per pair of labels that follow each other (0: none)."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray) -> None:
        self.weights, self.follow = weights, follow

    @classmethod
    def zero(cls) -> Field:
        return cls(np.zeros((len(_FEATURES), len(KINDS))), np.zeros((len(KINDS) + 1,) * 2))


class Edges:
    """Segments of many lattices by the place they end at: unlabelled single tokens, and candidates once per kind."""

    def __init__(self, lattices: list[Lattice]) -> None:
        rows, flat = [], []
        for z, own in enumerate(lattices):
            rows += [(z, i, i + 1, 0, -1) for i in range(len(own.places) - 1)]
            for i, j, on in own.segments:
                rows += [(z, i, j, k + 1, len(flat)) for k in range(len(KINDS))]
                flat.append(on)
        order = sorted(rows, key=lambda r: (r[2], r[1]))
        self.zone, self.start, self.end, self.label, self.segment = (np.array(c, np.int64) for c in zip(*order))
        self.owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.on = np.array([x for f in flat for x in f], np.int64)
        self.n, self.zones = len(flat), len(lattices)
        self.last = np.array([len(own.places) - 1 for own in lattices])
        self.by_end = np.searchsorted(self.end, np.arange(self.last.max(initial=0) + 2))
        self.backwards = np.argsort(-self.start, kind="stable")
        self.by_start = np.searchsorted(-self.start[self.backwards], -np.arange(self.last.max(initial=0) + 1), side="right")

    def scores(self, field: Field) -> np.ndarray:
        sums = np.zeros((self.n, len(KINDS)))
        for k in range(len(KINDS)):
            sums[:, k] = np.bincount(self.owner, field.weights[self.on, k], self.n)
        score = np.zeros(len(self.zone))
        named = self.label > 0
        score[named] = sums[self.segment[named], self.label[named] - 1]
        return score

    def forward(self, field: Field, score: np.ndarray, best: bool = False) -> np.ndarray:
        """Log sum (or maximum) over all segmentations up to a place that end in a label: zones by places by labels."""
        add = np.maximum if best else np.logaddexp
        table = np.full((self.zones, self.last.max(initial=0) + 1, len(KINDS) + 1), -np.inf)
        table[:, 0, 0] = 0.0
        for p in range(1, table.shape[1]):
            at = slice(self.by_end[p], self.by_end[p + 1])
            ways = table[self.zone[at], self.start[at]] + field.follow[:, self.label[at]].T
            whole = ways.max(axis=1) if best else np.logaddexp.reduce(ways, axis=1)
            add.at(table[:, p], (self.zone[at], self.label[at]), whole + score[at])
        return table

    def backward(self, field: Field, score: np.ndarray) -> np.ndarray:
        table = np.full((self.zones, self.last.max(initial=0) + 1, len(KINDS) + 1), -np.inf)
        table[np.arange(self.zones), self.last] = 0.0
        for p in range(table.shape[1] - 2, -1, -1):
            at = self.backwards[self.by_start[p + 1]:self.by_start[p]]
            after = table[self.zone[at], self.end[at], self.label[at]] + score[at]
            np.logaddexp.at(table[:, p], self.zone[at], after[:, None] + field.follow[:, self.label[at]].T)
        return table

    def marginals(self, field: Field, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every segment after every label, and the log sum of each zone."""
        ahead, behind = self.forward(field, score), self.backward(field, score)
        whole = np.logaddexp.reduce(ahead[np.arange(self.zones), self.last], axis=1)
        ways = ahead[self.zone, self.start] + field.follow[:, self.label].T
        return np.exp(ways + (score + behind[self.zone, self.end, self.label] - whole[self.zone])[:, None]), whole

    def decode(self, field: Field) -> list[tuple[int, int, int, int, float]]:
        """``(zone, first token, end token, kind, probability)`` of the best segmentation's labelled segments."""
        score = self.scores(field)
        table = self.forward(field, score, best=True)
        chance = self.marginals(field, score)[0].sum(axis=1)
        arriving: dict[tuple[int, int, int], list[int]] = {}
        for e, key in enumerate(zip(self.zone.tolist(), self.end.tolist(), self.label.tolist())):
            arriving.setdefault(key, []).append(e)
        found = []
        for z in range(self.zones):
            p, y = int(self.last[z]), int(table[z, self.last[z]].argmax())
            while p:
                e, before = max(((e, b) for e in arriving[z, p, y] for b in range(len(KINDS) + 1)),
                                key=lambda w: (table[z, self.start[w[0]], w[1]] + field.follow[w[1], y] + score[w[0]], -w[0], -w[1]))
                if y:
                    found.append((z, int(self.start[e]), p, y - 1, float(chance[e])))
                p, y = int(self.start[e]), before
        return found


def fit(examples: list[tuple[Lattice, list[tuple[int, int, int]]]]) -> Field:
    """Weights of greatest conditional likelihood with a ridge, by full gradients with running scales.

    An example is a lattice and its labelled segments ``(first token, end
    token, kind)``; everything else in it is unlabelled.
    """
    field = Field.zero()
    if not examples:
        return field
    edges = Edges([own for own, _ in examples])
    truth = np.zeros(len(edges.zone), bool)
    covered = set()
    wanted = {(z, i, j, k + 1) for z, (_, named) in enumerate(examples) for i, j, k in named}
    for z, i, j, _ in wanted:
        covered.update((z, t) for t in range(i, j))
    chain: dict[tuple[int, int], int] = {}
    for e, key in enumerate(zip(edges.zone.tolist(), edges.start.tolist(), edges.end.tolist(), edges.label.tolist())):
        truth[e] = key in wanted or key[3] == 0 and (key[0], key[1]) not in covered
        if truth[e]:
            chain[key[0], key[2]] = key[3]
    seen_follow = np.zeros_like(field.follow)
    for e in np.flatnonzero(truth):
        before = chain[int(edges.zone[e]), int(edges.start[e])] if edges.start[e] else 0
        seen_follow[before, edges.label[e]] += 1
    named = edges.label > 0
    step = [np.zeros_like(field.weights), np.zeros_like(field.follow)]
    scale = [np.zeros_like(field.weights), np.zeros_like(field.follow)]
    for turn in range(1, ROUNDS + 1):
        ways, _ = edges.marginals(field, edges.scores(field))
        missing = truth[named] - ways[named].sum(axis=1)
        over = np.bincount(edges.segment[named] * len(KINDS) + edges.label[named] - 1, missing, edges.n * len(KINDS)).reshape(edges.n, -1)
        gradient = [np.stack([np.bincount(edges.on, over[edges.owner, k], len(_FEATURES)) for k in range(len(KINDS))], axis=1),
                    seen_follow - np.stack([ways[edges.label == y].sum(axis=0) for y in range(len(KINDS) + 1)], axis=1)]
        for k, weights in enumerate((field.weights, field.follow)):
            g = gradient[k] / len(examples) - RIDGE / len(examples) * weights * 10
            step[k] = 0.9 * step[k] + 0.1 * g
            scale[k] = 0.99 * scale[k] + 0.01 * g * g
            weights += RATE * (step[k] / (1 - 0.9 ** turn)) / (np.sqrt(scale[k] / (1 - 0.99 ** turn)) + 1e-6)
    return field


# --- examples -----------------------------------------------------------------

def spellings(value: str, kind: int) -> list[tuple[str, bool]]:
    """A pattern hit as it stands and in other spellings, and near misses; the second part tells which still are of the kind."""
    digits = "".join(_DIGITS.findall(value))
    if kind == 0:
        local, host = value.split("@", 1)
        return [(value, True), (f"{local} @ {host}", True), (f"{local}@ {host}", True), (f"{local}@{host.split('.')[0]}", False),
                (f"@{host}", False), (f"{local}@", False)]
    if kind == 1:
        parts = value.split(".")
        return [(value, True), (" . ".join(parts), True), (".".join([*parts[:3], "999"]), False), (".".join(parts[:3]), False),
                (".".join([*parts, parts[0]]), False), ("-".join(parts), False)]
    if kind == 2:
        last = str((int(digits[-1]) + 5) % 10)
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [(value, True), (".".join(fours), True), ("  ".join(fours), True), ("/".join(fours), True), (digits[:-1] + last, False),
                (".".join(fours)[:-1] + last, False), (digits + digits, False), (digits[:12], False)]
    bare = value.lstrip("+")
    local = re.sub(r"\A[0-9]{1,3}[^0-9]+", "", bare)
    made = [(value, True), (digits, False), (digits[:9], False), (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", False), (f"{digits[:7]}.{digits[7:]}", False),
            (f"20{digits[1:3]}-{digits[3:5]}-{digits[5:7]} {digits[7:9]}:{digits[5:7]}:{digits[3:5]}", False), (f"20{digits[1:3]}/{digits[3:5]}/{digits[5:7]}", False)]
    groups = _DIGITS.findall(local)
    if len(groups) >= 3 and 9 <= sum(map(len, groups)) <= 12 and re.search("[^0-9]", local):
        made += [(local, True), ("-".join(groups), True), (".".join(groups), True), (f"({groups[0]}) {'-'.join(groups[1:])}", True), (f"00{bare}", True)]
    return made


def examples(texts: list[str]) -> list[tuple[Lattice, list[tuple[int, int, int]]]]:
    """Labelled zones of the texts: pattern hits in all their spellings between the words they stood among, and zones without a hit.

    A zone that follows a word of ``CUES`` and has no hit is left out: nobody
    knows what it is.
    """
    made = []

    def add(text: str, a: int, b: int, hit: tuple[int, int, int] | None) -> None:
        own = lattice(text, a, b)
        if own is None or len(own.places) > ZONE_TOKENS:
            return
        if hit is None:
            made.append((own, []))
        elif hit[0] in own.places and hit[2] in own.places:
            found = (own.places.index(hit[0]), own.places.index(hit[2]))
            if any((i, j) == found for i, j, _ in own.segments):
                made.append((own, [(*found, hit[1])]))

    for text in texts:
        hits = base_spans(text)
        alone = [h for k, h in enumerate(hits) if not any(g is not h and g[0] < h[2] and h[0] < g[2] for g in hits)]
        for s, kind, e in alone:
            left, right = text[max(0, s - 20):s], text[e:e + 20]
            # Signs that cling to a hit stay; words with digits around it would need labels of their own.
            left, right = re.sub(r"\S*[0-9@]\S*", "x", left), re.sub(r"\S*[0-9@]\S*", "x", right)
            for value, good in spellings(text[s:e], kind):
                line = f"{left}{value}{right}"
                a, b = len(left), len(left) + len(value)
                around = [z for z in zones(line) if z[0] < b and a < z[1]]
                if len(around) == 1:
                    add(line, *around[0], (a, kind, b) if good else None)
        for a, b in free_zones(text, hits):
            before = text[max(0, a - 40):a].split()
            if not before or before[-1].strip(".,:;()").lower() not in _CUE_OF:
                add(text, a, b, None)
    # A fixed choice of both sorts, half each.
    chosen = []
    for sort in ([m for m in made if m[1]], [m for m in made if not m[1]]):
        sort.sort(key=lambda m: zlib.crc32(repr((m[0].places[1:4], m[0].segments[:2])).encode()))
        chosen += sort[:ZONES // 2]
    return chosen


def sample_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Short stretches around the zones of at most ``SAMPLE`` documents, at most ``WINDOWS`` of them.

    The documents are those with a digit or ``@`` whose identifiers hash
    lowest, the stretches again those that hash lowest; ties go by text.  Zones
    of more than ``WIDE`` characters are left to other documents.
    """
    rows = docs.select(F.xxhash64(F.lit("field"), F.col(id_col)).alias("_h"), F.col(text_col).alias("_t")) \
        .filter(F.col("_t").rlike("@|[0-9][^A-Za-z]{0,3}[0-9]{2}")).select("_h", F.xxhash64("_t").alias("_x"), "_t")
    # At most SAMPLE pairs of numbers are broadcast.
    least = rows.select("_h", "_x").orderBy("_h", "_x").limit(SAMPLE).distinct()

    def windows(batches):
        for batch in batches:
            found = []
            for text in batch.column("_t").to_pylist():
                found += [text[max(0, a - WIDE // 4):b + WIDE // 4] for a, b in zones(text) if b - a <= WIDE]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["w"])

    kept = rows.join(F.broadcast(least), ["_h", "_x"], "left_semi").select("_t").mapInArrow(windows, "w string").distinct()
    return [r["w"] for r in kept.orderBy(F.xxhash64("w"), "w").limit(WINDOWS).collect()]


_SPAN = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string())])


def find_personal(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, added``: personal data of every text, both as ``array<struct<s, e, kind>>`` by start and kind.

    ``base`` holds the pattern hits (offsets in code points, end exclusive),
    ``added`` the segments the field is ``SURE`` of; they never overlap a
    pattern hit.  Without ``field`` one is fitted on a bounded sample of
    ``docs``.  A null text counts as empty and has no spans; each row of a
    repeated text or identifier is searched by itself; long texts are searched
    as a whole; other columns are ignored.  An empty table, or one without a
    pattern hit in the sample, adds nothing.
    """
    if field is None:
        known = examples(sample_windows(docs, id_col, text_col))
        field = fit(known) if any(named for _, named in known) else None
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                base, lattices, owner = [], [], []
                added: list[list[dict]] = [[] for _ in range(len(part))]
                for k, text in enumerate(part.column("_t").to_pylist()):
                    hits = base_spans(text) if text else []
                    base.append([{"s": s, "e": e, "kind": KINDS[y]} for s, y, e in hits])
                    for a, b in free_zones(text, hits) if text and model is not None else ():
                        own = lattice(text, a, b)
                        if own is not None:
                            lattices.append(own)
                            owner.append(k)
                # Zones of like length share a table.
                order = sorted(range(len(lattices)), key=lambda z: len(lattices[z].places))
                at_once: list[int] = []

                def settle() -> None:
                    if at_once:
                        for z, i, j, y, chance in Edges([lattices[z] for z in at_once]).decode(model):
                            if chance >= SURE:
                                own = lattices[at_once[z]]
                                added[owner[at_once[z]]].append({"s": own.places[i], "e": own.places[j], "kind": KINDS[y]})
                        at_once.clear()

                for z in order:
                    if at_once and len(lattices[z].places) > 2 * len(lattices[at_once[0]].places):
                        settle()
                    at_once.append(z)
                settle()
                for found in added:
                    found.sort(key=lambda x: (x["s"], KINDS.index(x["kind"])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(base, pa.list_(_SPAN)), pa.array(added, pa.list_(_SPAN))], ["_id", "base", "added"])

    spans = "array<struct<s:bigint,e:bigint,kind:string>>"
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_t")).mapInArrow(
        run, f"_id bigint, base {spans}, added {spans}").withColumnRenamed("_id", id_col)


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Pattern hits and added spans of personal data in all documents."""
    found = find_personal(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    rank = F.create_map(*[v for i, k in enumerate(KINDS) for v in (F.lit(k), F.lit(i))])
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(
        x["s"].alias("s"), rank[x["kind"]].alias("r"), x["e"].alias("e"), x["kind"].alias("kind"))))
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"))
