"""All-match extraction with offsets, as Spark SQL expression text.

A record has many fields and every field meets many rules.  The expressions
are therefore written as SQL text and parsed once per query; building the same
tree call by call from Python takes seconds for a wide table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import ContextRule, Rule
from .text import ROOT_PATH, quoted, strip_sql

HIT_TYPE = T.StructType([
    T.StructField("field_ordinal", T.IntegerType()),
    T.StructField("item_ordinal", T.IntegerType()),
    T.StructField("field_path", T.StringType()),
    T.StructField("rule_rank", T.IntegerType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("detector_name", T.StringType()),
])
NO_HITS = f"cast(array() as array<{HIT_TYPE.simpleString()}>)"


class Place(NamedTuple):
    """Where a text sits in its record (SQL expressions); a text of its own sits at the root."""

    field: str = "0"
    item: str = "0"
    path: str = quoted(ROOT_PATH)


# Any digit rule needs a digit next to a digit or one of these separators …
_DIGIT_GATE = r"\p{Nd}[\p{Nd}./-]"
# … and the gate of every such rule starts with one of these characters.
_GATE_START = r"(?=[\p{Nd}/-])"


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` to ``name`` inside ``body``.

    A lambda parameter is evaluated once, whereas text that repeats an
    expression repeats its work.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# Running sums are taken in blocks of this many numbers: an array is copied for every number appended to it.
_SUMMED = 128


def _before(sizes: str, first: str) -> str:
    """``first`` plus the sum of all numbers before it, for every number of a short array."""
    return (f"aggregate({sizes}, named_struct('next', {first}, 'sums', cast(array() as array<int>)), "
            "(acc, step) -> named_struct('next', acc.next + step, 'sums', concat(acc.sums, array(acc.next))), acc -> acc.sums)")


def _all_before(sizes: str, first: str) -> str:
    """The same for an array of any length: block by block, from the sums of the blocks before."""
    blocks = f"transform(sequence(0, cast((size(z) - 1) div {_SUMMED} as int)), b -> slice(z, b * {_SUMMED} + 1, {_SUMMED}))"
    totals = "transform(bs, x -> aggregate(x, 0, (total, step) -> total + step))"
    return _let(sizes, "z", _let(blocks, "bs", f"flatten(zip_with(bs, {_before(totals, first)}, (x, at) -> {_before('x', 'at')}))"))


# 0-based start of every match in m, from the pieces g between the matches.
# m and the pieces after the first have the same length: next = start + match + piece.
_STARTS = _all_before("zip_with(slice(g, 2, size(m)), m, (p, q) -> length(p) + length(q))", "length(get(g, 0))")


def find_all_sql(text: str, pattern: str, item: str) -> str:
    """Array of ``item`` for every non-overlapping leftmost match of ``pattern``.

    ``item`` may use ``v`` (the matched text), ``s`` (its 0-based start in code
    points) and ``length(v)``.  A text without a match costs one pass.  A single
    match whose value occurs nowhere else is located by that value; otherwise
    the text is cut at its matches and the pieces are added up, because the
    same value may also stand where the rule rejects it.
    """
    p = quoted(pattern)
    found = f"locate(get(m, 0), {text})"
    alone = f"size(m) = 1 AND locate(get(m, 0), {text}, {found} + 1) = 0"
    cut = _let(f"split({text}, {p}, -1)", "g", _STARTS)
    starts = f"CASE WHEN {alone} THEN array({found} - 1) ELSE {cut} END"
    items = f"zip_with(m, {starts}, (v, s) -> {item})"
    return _let(f"regexp_extract_all({text}, {p}, 0)", "m", f"CASE WHEN size(m) > 0 THEN {items} END")


def find_all(text: str, pattern: str) -> Column:
    """``array<struct<value, char_start, char_end>>`` of all matches; null when there is none."""
    return F.expr(find_all_sql(
        text, pattern, "named_struct('value', v, 'char_start', s, 'char_end', s + length(v))"))


def _hit(rule: Rule | ContextRule, rank: int, place: Place, value: str, start: str, end: str) -> str:
    return (
        f"named_struct('field_ordinal', {place.field}, 'item_ordinal', {place.item}, 'field_path', {place.path}, "
        f"'rule_rank', {rank}, 'entity_type', {quoted(rule.entity_type)}, 'value', {value}, "
        f"'char_start', {start}, 'char_end', {end}, 'confidence', {float(rule.confidence)!r}D, "
        f"'detector_name', {quoted(rule.name)})"
    )


def may_match(text: str, rule: Rule) -> str:
    """Cheap necessary condition for ``rule`` to match ``text``."""
    checks = [f"octet_length({text}) >= {rule.min_bytes}"]
    if rule.literal:
        checks.append(f"contains({text}, {quoted(rule.literal)})")
    if rule.gate:
        checks.append(f"rlike({text}, {quoted(rule.gate)})")
    return " AND ".join(checks)


def rule_hits(text: str, rule: Rule, rank: int, place: Place) -> str:
    """Hits of one rule in one text, in text order.

    The condition stands outside the lambda expressions, so it is compiled and
    the interpreted part runs only for texts that may hold a match.
    """
    found = find_all_sql(text, rule.pattern, _hit(rule, rank, place, "v", "s", "s + length(v)"))
    if rule.passes_over:
        found = f"filter({found}, h -> contains(h.value, {quoted(rule.literal)}))"
    if rule.min_bytes <= 1:
        found = f"filter({found}, h -> length(h.value) > 0)"
    return f"CASE WHEN {may_match(text, rule)} THEN coalesce({found}, {NO_HITS}) ELSE {NO_HITS} END"


def single_hit(condition: str, rule: Rule, rank: int, place: Place, value: str, start: str, end: str) -> str:
    """One hit where ``condition`` holds, for typed values whose hits need no search."""
    return (f"CASE WHEN {condition} THEN array({_hit(rule, rank, place, value, start, end)}) "
            f"ELSE {NO_HITS} END")


def joined(arrays: list[str]) -> str:
    if not arrays:
        return NO_HITS
    return arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})"


def text_hits(text: str, rules: tuple[Rule, ...], place: Place = Place(),
              usable: set[str] | None = None) -> str:
    """Hits of all regular-expression rules in one text, rule by rule.

    ``usable`` names the entity types this text can hold (default: all).  Two
    shared checks let a text skip all digit rules: one for digits at all, one
    for the gate of any of the rules.  Each is one pass, where the rules' own
    gates would be one pass each.
    """
    parts: list[str] = []
    run: list[tuple[int, Rule]] = []

    def flush() -> None:
        if run:
            shortest = min(r.min_bytes for _, r in run)
            checks = [f"octet_length({text}) >= {shortest}", f"rlike({text}, {quoted(_DIGIT_GATE)})"]
            if len(run) > 1:
                any_gate = f"{_GATE_START}(?:{'|'.join(r.gate for _, r in run)})"
                checks.append(f"rlike({text}, {quoted(any_gate)})")
            hits = joined([rule_hits(text, r, k, place) for k, r in run])
            parts.append(f"CASE WHEN {' AND '.join(checks)} THEN {hits} ELSE {NO_HITS} END")
            run.clear()

    for rank, rule in enumerate(rules):
        if usable is not None and rule.entity_type not in usable:
            continue
        if rule.gate:
            run.append((rank, rule))
        else:
            flush()
            parts.append(rule_hits(text, rule, rank, place))
    flush()
    return joined(parts)


def context_hits(text: str, rules: list[tuple[int, ContextRule, str]], place: Place) -> str:
    """Whole-value hits of the field-name rules, with offsets into the stripped text.

    ``rules`` holds ``(rank, rule, condition that the field name fits)``.
    """
    if not rules:
        return NO_HITS
    each = [
        f"CASE WHEN {fits} AND rlike(w, {quoted(rule.pattern)}) "
        f"THEN array({_hit(rule, rank, place, 'w', '0', 'length(w)')}) ELSE {NO_HITS} END"
        for rank, rule, fits in rules
    ]
    any_fits = " OR ".join(fits for _, _, fits in rules)
    return (f"CASE WHEN {text} IS NOT NULL AND ({any_fits}) "
            f"THEN {_let(strip_sql(text), 'w', joined(each))} ELSE {NO_HITS} END")
