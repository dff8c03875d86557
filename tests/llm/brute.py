"""Plain Python versions of the operators, over texts held in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

# The patterns of the contract.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(tokens: list[str], k: int = 5) -> frozenset:
    if len(tokens) >= k:
        return frozenset(tuple(tokens[i:i + k]) for i in range(len(tokens) - k + 1))
    return frozenset([tuple(tokens)] if tokens else [])


def base_secrets(text: str) -> list[tuple]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def similar_pairs(sets: dict) -> list[tuple]:
    """Pairs of keys with a similarity of three quarters, the later key first."""
    seen, pairs = defaultdict(list), []
    for key, own in sets.items():
        common = Counter(other for s in own for other in seen[s])
        pairs += [(key, other) for other, n in common.items() if 4 * n >= 3 * (len(own) + len(sets[other]) - n)]
        for s in own:
            seen[s].append(key)
    return pairs


def component_ids(texts: dict[int, str | None]) -> dict[int, int]:
    root = {d: d for d in texts}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for a, b in similar_pairs({d: shingles(words(t)) for d, t in texts.items()}):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def later_lines(texts: dict[int, str | None]) -> set[tuple[int, int]]:
    lines = {}
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            if words(line):
                lines[d, i] = shingles(words(line))
    return {later for later, _ in similar_pairs(lines)}


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def base_scores(texts: dict[int, str | None]) -> dict[int, tuple]:
    """``n_tokens, n_known, train_tokens, base_score, held_out`` per document."""
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(t for d in texts if not held[d] for t in tokens[d])
    total, kinds = sum(counts.values()), len(counts)
    return {d: (len(own), sum(counts[t] > 0 for t in own), total,
                sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), held[d]) for d, own in tokens.items()}


def tree_scores(train: list, texts: list, depth: int, least: int, divergence: float, chance: float = 1e-5) -> list[float]:
    """Score of every text by the suffix tree of ``train``, over bytes and across words."""
    def stream(text):
        return b"\n" * 6 + b" " + b"".join(w.encode() + b" " for w in words(text)) + b"\n"

    seen = defaultdict(Counter)
    for s in map(stream, train):
        for i in range(7, len(s)):
            for d in range(depth + 1):
                seen[s[i - d:i]][s[i]] += 1
    kept = {b""}
    for context, own in seen.items():
        if context and own.total() >= least:
            below = seen[context[1:]]
            if sum(n * math.log(n / own.total() * below.total() / below[x]) for x, n in own.items()) >= divergence:
                kept.add(context)
    scores = []
    for s in map(stream, texts):
        score = 0.0
        for i in range(7, len(s)):
            own = next(seen[s[i - d:i]] for d in range(depth, -1, -1) if s[i - d:i] in kept)
            score += math.log10((1 - 256 * chance) * own[s[i]] / own.total() + chance)
        scores.append(score)
    return scores


def planted_words(key: int | None, text: str | None) -> list[str]:
    """The words of a text, repeated from some word on if its identifier's checksum says so."""
    own = WORD.findall(text or "")
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not own:
        return own
    g, n = h // 10, len(own)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[a + (i - a) % p] if i >= a else own[i] for i in range(n)]


def periodic_runs(own: list) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs, by a scan for every period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(own) // 3 + 1):
        i = 0
        while i + q < len(own):
            j = i
            while j + q < len(own) and own[j] == own[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(own: list[str], found: list[tuple[int, int, int]]) -> str:
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(own) if i not in dropped)


# The patterns of the contract.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_personal(text: str) -> list[tuple]:
    def good(kind: str, value: str) -> bool:
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "phone":
            return 10 <= len(digits) <= 15
        if kind == "card":
            checked = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and checked % 10 == 0
        return True

    return sorted((m.start(), i, m.end(), kind) for i, (kind, pattern) in enumerate(PERSONAL.items())
                  for m in re.finditer(pattern, text) if good(kind, m[0]))
