"""The registered queries as ANSI-style SQL for DuckDB.

DuckDB's regular expressions know no lookaround.  A boundary that must not be
part of a match is consumed instead and the value taken from a group, so the
patterns here are written independently of the ones Spark runs.
"""

from __future__ import annotations

# Patterns with consumed boundaries: group 1 is the value.
_EMAIL = (r"(?:^|[^\p{L}\p{N}_.\-])([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})(?:[^\p{L}\p{N}_.\-]|$)")
_PHONE = (r"(?:^|[^0-9])((?:\+[0-9]{1,3}\s?)?(?:\([0-9]{2,4}\)\s?)?"
          r"[0-9]{2,4}[\s.\-]?[0-9]{3,4}[\s.\-]?[0-9]{3,4})(?:[^0-9]|$)")
_TAX = r"(?:^|[^A-Za-z0-9])([A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z])(?:[^A-Za-z0-9]|$)"
_IBAN = r"(?:^|[^A-Za-z0-9])([Ii][Tt][0-9]{2}[A-Za-z][0-9]{10}[A-Za-z0-9]{12})(?:[^A-Za-z0-9]|$)"
_DATE = (r"(?:^|[^0-9])((?:0?[1-9]|[12][0-9]|3[01])[/\-](?:0?[1-9]|1[0-2])[/\-](?:19|20)[0-9]{2}"
         r"|(?:19|20)[0-9]{2}[/\-](?:0?[1-9]|1[0-2])[/\-](?:0?[1-9]|[12][0-9]|3[01]))(?:[^0-9]|$)")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?:^|[^0-9])((?:{_OCTET}\.){{3}}{_OCTET})(?:[^0-9]|$)"

_RULES = {
    "EMAIL": (0, _EMAIL, 0.9, "email-regex"),
    "PHONE": (1, _PHONE, 0.7, "phone-regex"),
    "TAX_CODE": (2, _TAX, 0.95, "tax-code-regex"),
    "IBAN": (3, _IBAN, 0.95, "iban-regex"),
    "BIRTH_DATE": (4, _DATE, 0.85, "birth-date-regex"),
    "IP_ADDRESS": (5, _IP, 0.9, "ip-address-regex"),
}
_TYPES = sorted([*_RULES, "PERSON_NAME", "ADDRESS"])


def _hits(source: str, keys: str, text: str, entity: str, pattern: str | None = None,
          name: str | None = None, confidence: float | None = None) -> str:
    """All matches of one rule: keys, rule_rank, entity_type, value, char_start, char_end, confidence, detector_name."""
    rank, default_pattern, default_confidence, default_name = _RULES[entity]
    first = pattern or default_pattern
    # After a match the search goes on from its last character, which is never a
    # boundary; so the next match may share the boundary that ended this one.
    later = first.replace("(?:^|", "(?:", 1)

    def step(rest: str, p: str, base: str, where: str) -> str:
        return f"""
  SELECT {keys}, substr(rest, s + length(v)) AS rest, base + s + length(v) - 1 AS base, v AS value, base + s AS found
  FROM (
    SELECT {keys}, rest, base, v, length(g[1]) + strpos(m, v) - 1 AS s FROM (
      SELECT {keys}, {rest} AS rest, {base} AS base, regexp_extract({rest}, '{p}', 0) AS m,
             regexp_extract({rest}, '{p}', 1) AS v, string_split_regex({rest}, '{p}') AS g
      FROM {where} WHERE regexp_matches({rest}, '{p}')
    )
  )"""

    return f"""
SELECT {keys}, {rank} AS rule_rank, '{entity}' AS entity_type, value,
       CAST(found AS INTEGER) AS char_start, CAST(found + length(value) AS INTEGER) AS char_end,
       CAST({confidence or default_confidence} AS DOUBLE) AS confidence, '{name or default_name}' AS detector_name
FROM (
  WITH RECURSIVE walk AS ({step(text, first, "CAST(0 AS BIGINT)", source)}
  UNION ALL {step("rest", later, "base", "walk")}
  ) SELECT * FROM walk
)"""


def _all_hits(source: str, keys: str, text: str) -> str:
    return " UNION ALL ".join(_hits(source, keys, text, e) for e in _RULES)


def _hits_of_fields(source: str, keys: str, fields: dict[str, str]) -> str:
    """All rules over several fields (name to text expression), with ``field_path``."""
    parts = []
    for name, expr in fields.items():
        sub = f"(SELECT {keys}, '{name}' AS field_path, {expr} AS t FROM {source})"
        parts.append(_all_hits(sub, f"{keys}, field_path", "t"))
    return " UNION ALL ".join(parts)


_HIT = "entity_type, value, char_start, char_end, confidence, detector_name"
_DOC_HITS = _all_hits("documents", "doc_id, source", "text")


def _plain(v: str) -> str:
    """Timestamp as text: seconds, or always six fraction digits."""
    return (f"CASE WHEN {v} = date_trunc('second', {v}) THEN strftime({v}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({v}, '%Y-%m-%d %H:%M:%S.%f') END")


# --- masks ------------------------------------------------------------------


def _stars(n: str) -> str:
    return f"repeat('*', CAST({n} AS INTEGER))"


def _middle(v: str, s: int = 1, e: int = 1) -> str:
    return (f"(CASE WHEN length({v}) <= {s + e} THEN {_stars(f'length({v})')} ELSE "
            f"left({v}, {s}) || {_stars(f'length({v}) - {s + e}')} || right({v}, {e}) END)")


def _tokens(v: str) -> str:
    """Character by character; the value is padded so that neighbours always exist."""
    w = f"('  ' || {v} || '  ')"

    def a(d: int) -> str:
        return f"regexp_full_match(substr({w}, CAST(i + {2 + d} AS INTEGER), 1), '[\\p{{L}}\\p{{N}}]')"

    hidden = (f"{a(0)} AND (({a(-1)} AND {a(1)}) OR (NOT {a(-1)} AND NOT {a(1)}) "
              f"OR (NOT {a(-1)} AND {a(1)} AND NOT {a(2)}) OR ({a(-1)} AND NOT {a(1)} AND NOT {a(-2)}))")
    return (f"array_to_string(list_transform(range(1, length({v}) + 1), "
            f"lambda i: CASE WHEN {hidden} THEN '*' ELSE substr({v}, CAST(i AS INTEGER), 1) END), '')")


def _email(v: str) -> str:
    local = f"split_part({v}, '@', 1)"
    return f"({_tokens(local)} || substr({v}, strpos({v}, '@')))"


def _phone(v: str) -> str:
    digits = f"length(regexp_replace({v}, '[^0-9]', '', 'g'))"
    nth = f"length(regexp_replace(substr({v}, 1, CAST(i AS INTEGER)), '[^0-9]', '', 'g'))"
    c = f"substr({v}, CAST(i AS INTEGER), 1)"
    return (f"(CASE WHEN {digits} <= 8 THEN {v} ELSE array_to_string(list_transform(range(1, length({v}) + 1), "
            f"lambda i: CASE WHEN regexp_full_match({c}, '[0-9]') AND {nth} > 5 AND {nth} <= {digits} - 3 "
            f"THEN '*' ELSE {c} END), '') END)")


def _ip(v: str) -> str:
    return f"(split_part({v}, '.', 1) || '.***.***.' || split_part({v}, '.', 4))"


def _mask(v: str, entity: str) -> str:
    return {"EMAIL": _email(v), "PHONE": _phone(v), "IP_ADDRESS": _ip(v),
            "TAX_CODE": _middle(v, 2, 2), "IBAN": _middle(v, 2, 2)}.get(entity) or _tokens(v)


def _mask_case(v: str) -> str:
    return "CASE entity_type " + " ".join(f"WHEN '{e}' THEN {_mask(v, e)}" for e in _TYPES) + " END"


def _preview(v: str, k: int = 2) -> str:
    return (f"(CASE WHEN length({v}) <= {2 * k} THEN repeat('*', CAST(length({v}) AS INTEGER)) "
            f"ELSE left({v}, {k}) || '***' || right({v}, {k}) END)")


# --- derived inputs ---------------------------------------------------------

_CODES = """(
SELECT c_custkey,
  'cf: ' || translate(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '0123456789', 'ABCDEFGHIJ')
    || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || 'M' || CASE WHEN c_custkey % 4 = 3 THEN '0x' ELSE '01' END
    || 'H' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || 'Z' || CASE WHEN c_custkey % 4 = 2 THEN '9' ELSE ';' END
    AS tax_text,
  CASE c_custkey % 4 WHEN 1 THEN 'FR' WHEN 2 THEN 'it' ELSE 'IT' END
    || lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0') || 'X' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')
    || lpad(CAST(c_nationkey AS VARCHAR), 12, 'AB12') || ' end' AS iban_text
FROM customer)"""

_CAPITALIZED = ("array_to_string(list_transform(string_split(p_name, ' '), "
                "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')")
_PEOPLE = f"""(
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ' ' || {_CAPITALIZED} || ' ' END AS contact_name
FROM part)"""

_ADDRESSES = """(
SELECT c_custkey, ['Via', 'piazza', 'Lane', 'Route', 'CORSO'][CAST(c_custkey % 5 + 1 AS INTEGER)] || ' '
  || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' || CAST(c_nationkey AS VARCHAR) END AS a
FROM customer)"""

_PROFILES = """(
SELECT c_custkey, c_mktsegment, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Rossi' AS full_name,
  strftime(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER), '%Y-%m-%d') AS birth_date,
  'Via Roma ' || c_nationkey AS address,
  '10.' || c_nationkey || '.' || (c_custkey % 256) || '.7' AS ip_address,
  CAST(3330000000 + c_custkey AS VARCHAR) AS phone,
  'user' || c_custkey || '@mail.example.com' AS email_0,
  'alt.user' || c_custkey || '@mail.example.com' AS email_1,
  c_custkey % 7 AS rank_1
FROM customer)"""

_PROFILE_FIELDS = {
    "full_name": "full_name", "birth_date": "birth_date", "address": "address", "ip_address": "ip_address",
    "phone": "phone", "contacts[0].email": "email_0", "contacts[1].email": "email_1",
}
_PROFILE_HITS = (
    _hits_of_fields(_PROFILES, "c_custkey, c_mktsegment", _PROFILE_FIELDS)
    + f"""
UNION ALL SELECT c_custkey, c_mktsegment, 'full_name', 6, 'PERSON_NAME', full_name, 0,
  CAST(length(full_name) AS INTEGER), 0.72, 'person-name-context' FROM {_PROFILES}
UNION ALL SELECT c_custkey, c_mktsegment, 'address', 7, 'ADDRESS', address, 0,
  CAST(length(address) AS INTEGER), 0.78, 'address-context' FROM {_PROFILES}"""
)


def _fold(text: str, hits: str) -> str:
    """Replace the values of a list of {v, s} one after the other."""
    return f"list_reduce(list_prepend({{'v': {text}, 's': ''}}, {hits}), lambda a, x: {{'v': replace(a.v, x.v, x.s), 's': ''}}).v"


def _sanitized(hits_sql: str, key: str, new_value: str) -> str:
    """Per key: hits in detection order as a list of {v, s}."""
    return f"""SELECT {key}, list({{'v': value, 's': {new_value}}} ORDER BY rule_rank, char_start) AS hits
FROM ({hits_sql}) GROUP BY {key}"""


def _sanitized_documents(new_value: str) -> str:
    return f"""
SELECT d.doc_id, CASE WHEN h.hits IS NULL THEN d.text ELSE {_fold('d.text', 'h.hits')} END AS text
FROM documents d LEFT JOIN ({_sanitized(_DOC_HITS, 'doc_id', new_value)}) h USING (doc_id)"""


def _counts(prefix: str = "n_") -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN entity_type = '{t}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {prefix}{t.lower()}"
        for t in _TYPES)


def _report(source: str, source_id: str, hits: str, fmt: str, mode: str, output: str | None, report: str) -> str:
    out = f"'out/' || s.source_id || '{output}'" if output else "CAST(NULL AS VARCHAR)"
    counts = ", ".join(f"coalesce(n_{t.lower()}, 0) AS n_{t.lower()}" for t in _TYPES)
    return f"""
SELECT s.source_id, s.source_id AS input_file, '{fmt}' AS input_format, record_count,
  '{mode}' AS sanitization_mode, coalesce(entities_found, 0) AS entities_found, {counts},
  average, lowest, highest, {out} AS output_file, 'out/' || s.source_id || '{report}' AS report_file,
  {out} AS planned_file, {'true' if output else 'false'} AS sanitized_output_generated
FROM (SELECT {source_id} AS source_id, count(*) AS record_count FROM {source} GROUP BY 1) s
LEFT JOIN (SELECT {source_id} AS source_id, count(*) AS entities_found, {_counts()},
  round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*), 9) AS average,
  min(confidence) AS lowest, max(confidence) AS highest FROM ({hits}) GROUP BY 1) h USING (source_id)"""


_FIRST_SEEN = "min({'s': source, 'r': rule_rank, 'd': doc_id, 'c': char_start})"
_NUMBERED = ("entity_type || '_' || CASE WHEN pseudonym_no < 1000 "
             "THEN lpad(CAST(pseudonym_no AS VARCHAR), 3, '0') ELSE CAST(pseudonym_no AS VARCHAR) END")

_LOOKUP = f"""
SELECT entity_type, value, pseudonym_no, {_NUMBERED} AS pseudonym FROM (
  SELECT entity_type, value, row_number() OVER (PARTITION BY entity_type ORDER BY f.s, f.r, f.d, f.c) AS pseudonym_no
  FROM (SELECT entity_type, value, {_FIRST_SEEN} AS f FROM ({_DOC_HITS}) GROUP BY 1, 2))"""

_LOOKUP_TWO_RUNS = f"""
SELECT entity_type, value, pseudonym_no, {_NUMBERED} AS pseudonym FROM (
  SELECT entity_type, value, row_number() OVER (
    PARTITION BY entity_type ORDER BY run, f.s, f.r, f.d, f.c) AS pseudonym_no
  FROM (SELECT entity_type, value, min(CASE WHEN source = (SELECT min(source) FROM documents) THEN 1 ELSE 2 END) AS run,
          {_FIRST_SEEN} AS f FROM ({_DOC_HITS}) GROUP BY 1, 2))"""

_JSON_BASE = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_K = "'{\"k\":' || k || '}'"

_EVENT_CELLS = """
SELECT event_id, 0 AS field_ordinal, 'event_type' AS field_path, 'event_type' AS field_name, event_type AS value FROM events
UNION ALL SELECT event_id, 1, 'value', 'value', CAST(value AS VARCHAR) FROM events
UNION ALL SELECT event_id, 2, 'props.k', 'k', json_extract_string(props, '$.k') FROM events
UNION ALL SELECT event_id, 3, 'items[0].kind', 'kind', event_type FROM events
UNION ALL SELECT event_id, 4, 'items[0].big', 'big', CASE WHEN user_id > 50 THEN 'True' ELSE 'False' END FROM events
UNION ALL SELECT event_id, 6, 'items[1].big', 'big', 'False' FROM events
UNION ALL SELECT event_id, 7, 'extra.the key', 'the key', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 8, 'ts', 'ts', """ + _plain("ts") + " FROM events"

_PATHS = """(SELECT page_id, regexp_replace(url, '^https?://|[?].*$', '', 'g')
  || ['.CSV', '.json', '.tar.Txt', '', '.exe', '.pdf'][CAST(page_id % 6 + 1 AS INTEGER)] AS path FROM pages)"""
_FILE = f"(SELECT page_id, regexp_extract('/' || path, '([^/]*)$', 1) AS f FROM {_PATHS})"
_SUFFIX = r"regexp_extract(f, '.(\.[^./]+)$', 1)"
_STEM = f"left(f, length(f) - length({_SUFFIX}))"

_NORMALIZE = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_HINT_NAME = _NORMALIZE.format(
    "['Contact Name', p_name || ' NAME', 'Home-Address ' || p_brand, 'nameless', 'Indirizzo.' || p_size, "
    "'first name'][CAST(p_partkey % 6 + 1 AS INTEGER)]")


def _fits(hints: str) -> str:
    return f"regexp_full_match({_HINT_NAME}, '(?:(?:{hints})(?:_.*)?|.*_(?:{hints}))')"


def _masked(entity: str) -> str:
    return (f"SELECT doc_id, char_start, value, {_mask('value', entity)} AS masked "
            f"FROM ({_hits('documents', 'doc_id', 'text', entity)})")


_LINEITEM = {
    "l_shipdate": _plain("l_shipdate"), "l_orderkey": "CAST(l_orderkey AS VARCHAR)",
    "l_partkey": "CAST(l_partkey AS VARCHAR)", "l_suppkey": "CAST(l_suppkey AS VARCHAR)",
    "l_extendedprice": "CAST(l_extendedprice AS VARCHAR)", "l_discount": "CAST(l_discount AS VARCHAR)",
    "l_tax": "CAST(l_tax AS VARCHAR)", "l_quantity": "CAST(l_quantity AS VARCHAR)",
}

_SCAN_COUNTS = f"""
SELECT s.source_id, s.record_count, h.entities_found, {', '.join(f'n_{t.lower()}' for t in _TYPES)}
FROM (SELECT c_mktsegment AS source_id, count(*) AS record_count FROM customer GROUP BY 1) s
JOIN (SELECT c_mktsegment AS source_id, count(*) AS entities_found, {_counts()}
      FROM ({_PROFILE_HITS}) GROUP BY 1) h USING (source_id)"""

_QUERY_ROWS = """(SELECT c_custkey, c_name || '@' || lower(n_name) || '.example.it' AS email,
  CAST(8800000000 + c_custkey AS VARCHAR) AS phone FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORACLE: dict[str, str] = {
    "detect_email": f"SELECT doc_id, {_HIT} FROM ({_hits('documents', 'doc_id', 'text', 'EMAIL')})",
    "detect_phone": f"SELECT doc_id, {_HIT} FROM ({_hits('documents', 'doc_id', 'text', 'PHONE')})",
    "detect_ip_address": f"SELECT doc_id, {_HIT} FROM ({_hits('documents', 'doc_id', 'text', 'IP_ADDRESS')})",
    "detect_tax_code": f"SELECT c_custkey, {_HIT} FROM ({_hits(_CODES, 'c_custkey', 'tax_text', 'TAX_CODE')})",
    "detect_iban": f"SELECT c_custkey, {_HIT} FROM ({_hits(_CODES, 'c_custkey', 'iban_text', 'IBAN')})",
    "detect_birth_date_cells": f"SELECT o_orderkey, field_path, {_HIT} FROM ("
    + _hits_of_fields("orders", "o_orderkey", {
        "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
        "o_orderdate": _plain("o_orderdate"), "o_orderpriority": "o_orderpriority"}) + ")",
    "detect_event_cells": f"SELECT event_id, field_path, {_HIT} FROM ("
    + _hits_of_fields("events", "event_id", {
        "ts": _plain("ts"), "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type", "value": "CAST(value AS VARCHAR)", "props": "props"}) + ")",
    "detect_lineitem_cells": "SELECT field_path, entity_type, count(*) AS hits, "
    "CAST(sum(char_start) AS BIGINT) AS start_sum, CAST(sum(char_end) AS BIGINT) AS end_sum FROM ("
    + _hits_of_fields("lineitem", "l_orderkey, l_linenumber", _LINEITEM) + ") GROUP BY 1, 2",
    "detect_person_name": f"""
SELECT p_partkey, 'contact_name' AS field_path, 'PERSON_NAME' AS entity_type, trim(contact_name) AS value,
  0 AS char_start, CAST(length(trim(contact_name)) AS INTEGER) AS char_end, CAST(0.72 AS DOUBLE) AS confidence,
  'person-name-context' AS detector_name FROM {_PEOPLE}
WHERE regexp_full_match(trim(contact_name), '[A-Z][A-Za-z]+( [A-Z][A-Za-z]+)+')""",
    "detect_address": f"""
SELECT c_custkey, 'ADDRESS' AS entity_type, a AS value, 0 AS char_start, CAST(length(a) AS INTEGER) AS char_end,
  CAST(0.78 AS DOUBLE) AS confidence, 'address-context' AS detector_name FROM {_ADDRESSES}
WHERE regexp_full_match(a, '(?i)(via|piazza|lane|corso) .+[0-9,].*')""",
    "detect_custom_rule": f"SELECT doc_id, {_HIT} FROM (" + " UNION ALL ".join([
        _hits("documents", "doc_id", "text", "EMAIL"),
        _hits("documents", "doc_id", "text", "EMAIL", r"(mail[0-9]+\.example)", "custom-email-regex", 0.8)]) + ")",
    "detect_external_spans": """
SELECT doc_id, CASE label WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'PERSON' THEN 'PERSON_NAME'
    WHEN 'LOCATION' THEN 'ADDRESS' ELSE label END AS entity_type,
  substr(text, s + 1, e - s) AS value, '<root>' AS field_path, s AS char_start, e AS char_end,
  doc_id % 100 / 100.0 AS confidence, 'presidio' AS detector_name
FROM (SELECT doc_id, text, CAST(greatest(strpos(text, '@') - 4, 0) AS INTEGER) AS s,
        CAST(strpos(text, '@') + 3 AS INTEGER) AS e,
        ['EMAIL_ADDRESS', 'PERSON', 'IBAN', 'LOCATION', 'CREDIT_CARD'][CAST(doc_id % 5 + 1 AS INTEGER)] AS label
      FROM documents WHERE contains(text, '@'))
WHERE label <> 'CREDIT_CARD'""",
    "entity_subset_filter": f"""SELECT source AS source_id, entity_type, count(*) AS hits FROM ({_DOC_HITS})
WHERE entity_type IN ('EMAIL', 'IP_ADDRESS') GROUP BY 1, 2""",
    "scan_pages": f"""SELECT page_id, entity_type, count(*) AS hits, min(char_start) AS first_start,
  max(char_end) AS last_end FROM ({_all_hits('pages', 'page_id', 'html')}) GROUP BY 1, 2""",
    "scan_conversations": f"SELECT conv_id, turn, field_path, {_HIT} FROM ("
    + _hits_of_fields("conversations", "conv_id, turn", {
        "role": "role",
        "text": "CASE WHEN turn % 2 = 0 THEN text || ' <' || role || conv_id || '@chat.example.com>' ELSE text END"})
    + ")",
    "detection_order_listing": f"""SELECT doc_id, entity_type, rule_rank, char_start, CAST(row_number() OVER (
  PARTITION BY doc_id ORDER BY rule_rank, char_start) AS INTEGER) AS listing_rank FROM ({_DOC_HITS})""",
    "flatten_cells": f"SELECT * FROM ({_EVENT_CELLS}) WHERE value IS NOT NULL",
    "flatten_customer_cells": """
SELECT c_custkey, 'c_custkey' AS field_path, 'c_custkey' AS field_name, CAST(c_custkey AS VARCHAR) AS value FROM customer
UNION ALL SELECT c_custkey, 'c_name', 'c_name', c_name FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', 'c_mktsegment', c_mktsegment FROM customer""",
    "flatten_variant_cells": """
SELECT event_id, event_type || '.v[0]' AS field_path, CAST(NULL AS VARCHAR) AS field_name,
  CAST(user_id AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, event_type || '.v[2]', NULL, 'True' FROM events
UNION ALL SELECT event_id, 'p.k', 'k', json_extract_string(props, '$.k') FROM events""",
    "variant_mixed_lists": """
SELECT event_id, 'v[0].a[0]' AS field_path, CAST(NULL AS VARCHAR) AS field_name, CAST(user_id AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'v[0].a[1].b', 'b', event_type FROM events
UNION ALL SELECT event_id, 'v[1]', NULL, '5' FROM events
UNION ALL SELECT event_id, 'v[2][0][0].k', 'k', json_extract_string(props, '$.k') FROM events""",
    "field_paths": f"""SELECT field_path, count(*) AS cells FROM ({_EVENT_CELLS}) WHERE value IS NOT NULL
GROUP BY field_path""",
    "normalize_field_name": "SELECT p_partkey, "
    + _NORMALIZE.format("' ' || p_name || '--' || p_type || '(' || p_size || ') '") + " AS normalized_name FROM part",
    "field_hint_predicate": "SELECT p_partkey, "
    + _fits("full_name|person_name|name|nome|first_name|last_name|contact_name") + " AS fits_person, "
    + _fits("address|street_address|home_address|billing_address|shipping_address|address_line|indirizzo")
    + " AS fits_address FROM part",
    "flatten_record_text": """SELECT s_suppkey, concat_ws(chr(10), CAST(s_suppkey AS VARCHAR), s_name,
  CAST(s_nationkey AS VARCHAR), CAST(s_acctbal AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'None' END)
  AS record_text FROM supplier""",
    "mask_email": _masked("EMAIL"),
    "mask_phone": _masked("PHONE"),
    "mask_ip": _masked("IP_ADDRESS"),
    "mask_tokenized": f"""SELECT p_partkey, {_tokens('t')} AS masked
FROM (SELECT p_partkey, p_name || ' - ' || p_brand || ' - ' || p_size AS t FROM part)""",
    "mask_middle": f"""SELECT c_custkey, {_middle('c_name')} AS masked_1, {_middle('c_mktsegment', 2, 2)} AS masked_2,
  {_middle('CAST(c_nationkey AS VARCHAR)', 2, 2)} AS masked_short FROM customer""",
    "mask_dispatch": f"SELECT c_custkey, entity_type, field_path, {_mask_case('value')} AS sanitized FROM ({_PROFILE_HITS})",
    "redact_values": f"""SELECT doc_id, entity_type, char_start, 'redact' AS mode,
  '[REDACTED_' || entity_type || ']' AS sanitized FROM ({_DOC_HITS})""",
    "pseudonymize_values": _LOOKUP,
    "pseudonym_map_merge": _LOOKUP_TWO_RUNS,
    "sanitize_documents_redact": _sanitized_documents("'[REDACTED_' || entity_type || ']'"),
    "sanitize_documents_mask": _sanitized_documents(_mask_case("value")),
    "sanitize_documents_pseudonymize": f"""
SELECT d.doc_id, CASE WHEN h.hits IS NULL THEN d.text ELSE {_fold('d.text', 'h.hits')} END AS text
FROM documents d LEFT JOIN (
  {_sanitized(f"SELECT * FROM ({_DOC_HITS}) JOIN ({_LOOKUP}) USING (entity_type, value)", 'doc_id', 'pseudonym')}
) h USING (doc_id)""",
    "sanitize_numeric_cells": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '[REDACTED_PHONE]' ELSE CAST(o_orderkey AS VARCHAR) END AS phone,
  '[REDACTED_BIRTH_DATE]' AS o_orderdate, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderkey % 3 = 0 AS flag
FROM orders""",
    "sanitize_nested_records": f"""
SELECT c_custkey, {_tokens('full_name')} AS full_name, {_tokens('birth_date')} AS birth_date,
  {_tokens('address')} AS address, {_ip('ip_address')} AS ip_address, {_phone('phone')} AS phone,
  {_email('email_0')} AS email_0, {_email('email_1')} AS email_1, rank_1 FROM {_PROFILES}""",
    "entity_counts": f"""SELECT source AS source_id, entity_type, count(*) AS entity_count
FROM ({_DOC_HITS}) GROUP BY 1, 2""",
    "detection_totals": f"SELECT source AS source_id, count(*) AS entities_found FROM ({_DOC_HITS}) GROUP BY 1",
    "confidence_summary": f"""SELECT source AS source_id,
  round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*), 9) AS average,
  min(confidence) AS min, max(confidence) AS max FROM ({_DOC_HITS}) GROUP BY 1""",
    "safe_previews": f"""SELECT p_partkey, {_preview('p_name')} AS name_preview,
  {_preview('CAST(p_size AS VARCHAR)')} AS size_preview FROM part""",
    "detection_listing": f"""SELECT source AS source_id, entity_type, 'text' AS field_path, doc_id AS record_index,
  char_start, char_end, confidence, detector_name, {_preview('value')} AS value_preview FROM ({_DOC_HITS})""",
    "transformation_listing": f"""SELECT source_id, entity_type, mode, field_path, record_index,
  {_preview('sanitized')} AS sanitized_preview FROM (
  SELECT source AS source_id, entity_type, 'mask' AS mode, 'text' AS field_path, doc_id AS record_index,
    {_mask_case('value')} AS sanitized FROM ({_DOC_HITS}))""",
    "display_listing": f"""SELECT source AS input_file, entity_type AS type, 'text' AS field, doc_id AS record
FROM ({_DOC_HITS})""",
    "audit_report": _report("documents", "source", _DOC_HITS, "json", "mask", "_mask_sanitized", "_mask_report.json"),
    "report_only": _report("customer", "c_mktsegment", _PROFILE_HITS, "csv", "redact", None, "_redact_report.html"),
    "display_header": f"""SELECT s.source AS input_file, 'mask' AS sanitization_mode,
  coalesce(n, 0) AS total_detections FROM (SELECT DISTINCT source FROM documents) s
LEFT JOIN (SELECT source, count(*) AS n FROM ({_DOC_HITS}) GROUP BY 1) h USING (source)""",
    "scan_job": _SCAN_COUNTS,
    "page_text_assembly": """SELECT conv_id, coalesce(trim(string_agg(text, chr(10) ORDER BY turn)
  FILTER (WHERE text <> ''), ' ' || chr(10) || chr(9) || chr(13)), '') AS text FROM conversations GROUP BY conv_id""",
    "record_count": "SELECT source AS source_id, count(*) AS record_count FROM documents GROUP BY 1",
    "infer_format": f"""SELECT page_id, suffix, suffix IN ('csv', 'json', 'txt', 'pdf', 'sql') AS supported
FROM (SELECT page_id, lower(ltrim({_SUFFIX}, '.')) AS suffix FROM {_FILE})""",
    "output_names": f"""SELECT page_id, f AS input_file, {_STEM} || '_mask_sanitized'
  || CASE WHEN lower({_SUFFIX}) = '.pdf' THEN '.txt' ELSE lower({_SUFFIX}) END AS sanitized_file,
  {_STEM} || '_redact_report.json' AS report_file FROM {_FILE}""",
    "csv_roundtrip": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'a "q", b' || chr(10) || c_name || ' ' END AS note FROM customer""",
    "json_roundtrip": """SELECT CAST(1 AS BIGINT) AS units, s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal,
  CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS note FROM supplier""",
    "json_lines_and_arrays": """SELECT form, CAST(1 AS BIGINT) AS units, event_id, user_id, event_type, props, value,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events, (VALUES ('lines'), ('splits'), ('arrays')) f(form)""",
    "json_large_array": """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS record_index, CAST(1 AS BIGINT) AS units,
  event_type, props, '}],{ ' || event_type AS signs FROM events""",
    "json_odd_values": """SELECT event_id, CAST(0 AS BIGINT) AS record_index, CAST(1 AS BIGINT) AS units,
  '{"a":"NaN","b":[' || user_id || ',"-Infinity"]}' AS content FROM events
UNION ALL SELECT event_id, 1, 1, '{"a":"' || chr(65533) || event_type || '"}' FROM events""",
    "csv_quoted_splits": """SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS record_index, c_custkey,
  'a "' || c_name || '",' || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN repeat(chr(10) || '"', 40) ELSE c_mktsegment END AS note,
  c_mktsegment FROM customer""",
    "csv_header_groups": """SELECT 'c_custkey|name, of' || chr(10) || 'all' AS header, count(*) AS records, count(*) AS "rows" FROM customer
UNION ALL SELECT 's_suppkey|s_name|s_acctbal', count(*), count(*) FROM supplier""",
    "text_roundtrip": """SELECT doc_id, regexp_replace(replace(regexp_replace(text, chr(10) || '$', ''), chr(13) || chr(10), chr(10)),
  chr(13), chr(10), 'g') || chr(10) AS content FROM documents""",
    "sql_dump_scan": "SELECT c_nationkey, entity_type, count(*) AS hits FROM ("
    + _all_hits("""(SELECT c_nationkey, 'insert into customer values (' || c_custkey || ', ' || chr(39) || lower(replace(c_name, '#', '.'))
  || '@example.it' || chr(39) || ', ' || chr(39) || c_mktsegment || chr(39) || ');' AS t FROM customer)""", "c_nationkey", "t") + ") GROUP BY 1, 2",
    "json_normalize": f"""
SELECT event_id, CAST(0 AS BIGINT) AS record_index, CAST(1 AS BIGINT) AS units, {_K} AS content
  FROM {_JSON_BASE} WHERE event_id % 4 IN (0, 1)
UNION ALL SELECT event_id, 1, 1, '{{"value":"' || event_type || '"}}' FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 2, 1, '{{"value":' || user_id || '}}' FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, 1, '{{"value":null}}' FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, NULL, 3, '{{"a":' || {_K} || ',"b":"' || event_type || '","c":null}}'
  FROM {_JSON_BASE} WHERE event_id % 4 = 2
UNION ALL SELECT event_id, NULL, 1, '{{"value":' || user_id || '}}' FROM events WHERE event_id % 4 = 3""",
    "json_typed_records": f"""
SELECT event_id, CAST(0 AS BIGINT) AS record_index, k, CAST(NULL AS BIGINT) AS a_k, CAST(NULL AS VARCHAR) AS b,
  CAST(NULL AS VARCHAR) AS value FROM {_JSON_BASE} WHERE event_id % 4 IN (0, 1)
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, event_type FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 2, NULL, NULL, NULL, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, NULL, NULL, k, event_type, NULL FROM {_JSON_BASE} WHERE event_id % 4 = 2
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 = 3""",
    "query_source": f"SELECT 'database' AS source_id, c_custkey, field_path, {_HIT} FROM ("
    + _hits_of_fields(_QUERY_ROWS, "c_custkey", {"email": "email", "phone": "phone"}) + ")",
    "query_rows_numbered": """SELECT row_number() OVER (ORDER BY customer NULLS LAST) - 1 AS record_index, customer
FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS customer FROM orders)""",
    "query_scan_job": """
SELECT entity_type, 'redact' AS mode, field_path, '[R***' || right(entity_type, 1) || ']' AS sanitized_preview,
  count(*) AS transformations FROM ("""
    + _hits_of_fields("events", "event_id", {
        "ts": _plain("ts"), "event_type": "event_type", "value": "CAST(value AS VARCHAR)", "props": "props",
        "user_id": "CAST(user_id AS VARCHAR)"}) + ") GROUP BY ALL",
    "batch_scan": f"""
SELECT 'csv' AS input_format, (SELECT count(*) FROM customer) AS csv_records, count(*) AS entities_found, {_counts()}
FROM ({_PROFILE_HITS})
UNION ALL SELECT 'txt', 0, count(*), {_counts()}
FROM ({_all_hits("(SELECT n_nationkey, n_name || '@example.com and 10.0.0.' || n_nationkey AS t FROM nation)", 'n_nationkey', 't')})""",
    "sanitize_job": f"""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {_tokens('full_name')} AS full_name, {_tokens('birth_date')} AS birth_date,
  {_tokens('address')} AS address, {_ip('ip_address')} AS ip_address, {_phone('phone')} AS phone, {_email('email_0')} AS email_0, {_email('email_1')} AS email_1,
  (SELECT count(*) FROM customer) AS reported_records, (SELECT count(*) FROM ({_PROFILE_HITS})) AS reported_entities, true AS reported_output
FROM {_PROFILES}""",
    "report_job": f"""SELECT 'redact' AS sanitization_mode, true AS no_output, entity_type, count(*) AS hits FROM ({_PROFILE_HITS}) GROUP BY entity_type""",
    "batch_sanitize": """SELECT form, c_custkey AS key, '[REDACTED_EMAIL]' AS value FROM customer, (VALUES ('csv'), ('json')) f(form)
UNION ALL SELECT 'txt', n_nationkey, 'nation ' || n_nationkey || ' at [REDACTED_IP_ADDRESS]' FROM nation""",
    "sanitize_json_by_path": """
SELECT 'record' AS form, CASE event_id % 6
  WHEN 0 THEN '{"id":' || event_id || ',"z":"' || event_type || ' [REDACTED_EMAIL]","v":"[REDACTED_PHONE]","n":null}'
  WHEN 1 THEN '{"z":1.5,"v":["[REDACTED_EMAIL]",{"v.w":"[REDACTED_IP_ADDRESS]"},true,[' || event_id || ']],"id":' || event_id || '}'
  WHEN 2 THEN '{"v":{"ip":"[REDACTED_IP_ADDRESS] or [REDACTED_IP_ADDRESS]","r":' || value || '},"id":' || event_id || ',"z":false}'
  WHEN 3 THEN replace(props, ': ', ':')
  WHEN 4 THEN '{"a.b":"[REDACTED_EMAIL]","a":{"b":"' || event_type || '","full_name":"[REDACTED_PERSON_NAME]"},"id":' || event_id || '}'
  ELSE '{"value":"[REDACTED_EMAIL]"}' END AS value FROM events
UNION ALL SELECT 'hit', hit FROM events JOIN (VALUES (0, 'EMAIL 1 z'), (0, 'PHONE 2 v'), (1, 'EMAIL 1 v[0]'), (1, 'IP_ADDRESS 2 v[1].v.w'),
  (2, 'IP_ADDRESS 0 v.ip'), (2, 'IP_ADDRESS 0 v.ip'), (4, 'EMAIL 0 a.b'), (4, 'PERSON_NAME 2 a.full_name'), (5, 'EMAIL 0 value')) h(k, hit)
  ON k = event_id % 6""",
    "pseudonymize_csv_job": """
SELECT c_custkey, 'EMAIL_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS mail
FROM (SELECT c_custkey, c_custkey * 7919 % 211 AS v FROM customer) JOIN (
  SELECT v, row_number() OVER (ORDER BY f.s, f.r) AS n FROM (
    SELECT c_custkey * 7919 % 211 AS v, min({'s': c_nationkey || '/', 'r': -c_custkey}) AS f FROM customer GROUP BY 1)) USING (v)""",
    "query_scan_pseudonyms": """
SELECT 'EMAIL' AS entity_type, 'u' || user_id || '@x.it' AS value, n AS pseudonym_no,
  'EMAIL_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS pseudonym,
  (SELECT count(*) FROM events) AS transformations
FROM (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS n FROM events GROUP BY user_id)""",
    "sanitize_dotted_fields": """SELECT c_custkey, '[REDACTED_EMAIL]' AS dotted, CAST(c_custkey AS VARCHAR) AS nested FROM customer""",
    "detect_wide_records": f"SELECT o_orderkey, CAST(o AS INTEGER) AS field_ordinal, field_path, {_HIT} FROM ("
    + _hits_of_fields("(SELECT *, 'o' || o_orderkey || '@x.it' AS mail FROM orders)", "o_orderkey", {
        "mail": "mail", "phone": "CAST(3330000000 + o_orderkey AS VARCHAR)", "o_orderdate": _plain("o_orderdate")})
    + ") JOIN (VALUES ('mail', 40), ('phone', 41), ('o_orderdate', 42)) f(field_path, o) USING (field_path)",
}
