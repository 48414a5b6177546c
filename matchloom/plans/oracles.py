"""DuckDB SQL that says the same as the registered queries, written for checking and not for speed."""

from __future__ import annotations

from ..operators.extraction import COMPANY, FIELD_PATTERNS, HEADER_COLUMNS
from . import synthetic
from .config import AUTO_MATCH, HEADER_KEYWORDS, REVIEW, VENDOR_STOPWORDS

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


def reference(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g')"


def plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def vendor(x: str) -> str:
    return f"array_to_string(list_filter(string_split({plain(x)}, ' '), lambda w: NOT list_contains({_LIST(VENDOR_STOPWORDS)}, w)), ' ')"


_SHAPES = (
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y"), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"), (r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
    (r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"), (r"[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}", "%d.%m.%Y"), (r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
    (r"[0-9]{1,2} [A-Za-z]{3} [0-9]{4}", "%d %b %Y"), (r"[0-9]{1,2} [A-Za-z]+ [0-9]{4}", "%d %B %Y"), (r"[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}", "%b %d, %Y"),
    (r"[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", "%B %d, %Y"), (r"[A-Za-z]{3} [0-9]{1,2} [0-9]{4}", "%b %d %Y"), (r"[A-Za-z]+ [0-9]{1,2} [0-9]{4}", "%B %d %Y"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "%d/%m/%y"), (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "%m/%d/%y"),
)


def date(x: str) -> str:
    clean = rf"regexp_replace(rtrim(trim({x}), ','), '\s+', ' ', 'g')"
    tried = ", ".join(f"CASE WHEN regexp_full_match({clean}, '{s}') THEN try_strptime({clean}, '{f}') END" for s, f in _SHAPES)
    return f"CAST(coalesce({tried}) AS DATE)"


def amount(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.]', '', 'g')"
    parts = f"string_split({kept}, '.')"
    return f"try_cast(CASE WHEN len({parts}) > 2 THEN array_to_string({parts}[1:len({parts}) - 1], '') || '.' || {parts}[len({parts})] ELSE {kept} END AS DOUBLE)"


def pick(debit: str, credit: str) -> str:
    return f"CASE WHEN {debit} <> 0 THEN {debit} ELSE {credit} END"


def levenshtein(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def by_date(a: str, b: str) -> str:
    d = f"abs(date_diff('day', {a}, {b}))"
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.5::DOUBLE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0::DOUBLE WHEN {d} = 0 THEN 1.0::DOUBLE WHEN {d} <= 3 THEN 1.0::DOUBLE - {d} / 6.0::DOUBLE ELSE 0.0::DOUBLE END"


def by_amount(a: str, b: str) -> str:
    r = f"(abs({a} - {b}) / greatest(abs({a}), abs({b})))"
    return (
        f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.5::DOUBLE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0::DOUBLE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE "
        f"WHEN {a} = 0 OR {b} = 0 THEN 0.0::DOUBLE WHEN {r} <= 0.01::DOUBLE THEN 1.0::DOUBLE ELSE exp(-10.0::DOUBLE * {r}) END"
    )


def jaro_ctes(pairs: str) -> str:
    """CTEs from ``pairs`` (a, b) to ``jaro`` (a, b, jaro, jw), the matching as a fold over a's characters."""
    w = "greatest(greatest(length(a), length(b)) // 2 - 1, 0)"
    lo, hi = f"greatest(1, x.i - {w})", f"least(length(b), x.i + {w})"
    at = f"CASE WHEN {hi} >= {lo} THEN instr(substr(acc.mask, {lo}, {hi} - {lo} + 1), substr(a, x.i, 1)) ELSE 0 END"
    step = f"{{'i': x.i, 'mask': CASE WHEN ({at}) > 0 THEN substr(acc.mask, 1, {lo} + ({at}) - 2) || chr(1) || substr(acc.mask, {lo} + ({at})) ELSE acc.mask END, 'hits': CASE WHEN ({at}) > 0 THEN acc.hits || substr(a, x.i, 1) ELSE acc.hits END}}"
    prefix = "CASE " + " ".join(f"WHEN length(a) >= {k} AND length(b) >= {k} AND substr(a, 1, {k}) = substr(b, 1, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
    return f"""jaro_pairs AS (SELECT DISTINCT a, b FROM {pairs}),
jaro_fold AS (SELECT a, b, list_reduce(list_transform(range(1, length(a) + 1), lambda i: {{'i': i, 'mask': b, 'hits': ''}}), lambda acc, x: {step}, {{'i': 0::BIGINT, 'mask': b, 'hits': ''}}) AS s FROM jaro_pairs),
jaro_hits AS (SELECT a, b, s.hits AS ha, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda j: substr(s.mask, j, 1) = chr(1)), lambda j: substr(b, j, 1)), '') AS hb FROM jaro_fold),
jaro_count AS (SELECT a, b, length(ha)::DOUBLE AS m, len(list_filter(range(1, length(ha) + 1), lambda k: substr(ha, k, 1) <> substr(hb, k, 1)))::DOUBLE AS t FROM jaro_hits),
jaro_value AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m / length(a) + m / length(b) + (m - t / 2) / m) / 3 END AS jaro FROM jaro_count),
jaro AS (SELECT a, b, jaro, CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE jaro + ({prefix}) * 0.1::DOUBLE * (1 - jaro) END AS jw FROM jaro_value)"""


RAW = f"raw_i AS ({synthetic.oracle(synthetic.INVOICES)}), raw_l AS ({synthetic.oracle(synthetic.LEDGER)})"
NORMALIZED = f"""{RAW},
inv AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) - 1 AS invoice_idx, invoice_number, {reference('invoice_number')} AS ref, {vendor('vendor_name')} AS ven, {date('date')} AS d, {amount('amount')} AS amt FROM raw_i),
led_all AS (SELECT batch_id, ordinal, reference, {reference('reference')} AS ref, {vendor('vendor')} AS ven, {date('date')} AS d, {amount('debit')} AS debit, {amount('credit')} AS credit FROM raw_l),
led_kept AS (SELECT * FROM led_all l WHERE l.d IS NULL OR NOT EXISTS (SELECT 1 FROM inv i WHERE i.batch_id = l.batch_id AND i.d IS NOT NULL) OR EXISTS (SELECT 1 FROM inv i WHERE i.batch_id = l.batch_id AND abs(date_diff('day', i.d, l.d)) <= 60)),
led AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) - 1 AS ledger_idx FROM led_kept)"""
VENDOR_PAIRS = "vendor_pairs AS (SELECT DISTINCT i.ven AS a, l.ven AS b FROM inv i JOIN led l USING (batch_id))"
SCORED = f"""{NORMALIZED}, {VENDOR_PAIRS}, {jaro_ctes('vendor_pairs')},
scores AS (SELECT i.batch_id, i.invoice_idx, l.ledger_idx, 0.4::DOUBLE * ({levenshtein('i.ref', 'l.ref')}) + 0.25::DOUBLE * j.jw + 0.2::DOUBLE * ({by_date('i.d', 'l.d')}) + 0.15::DOUBLE * ({by_amount('i.amt', '(' + pick('l.debit', 'l.credit') + ')')}) AS score
 FROM inv i JOIN led l USING (batch_id) JOIN jaro j ON j.a = i.ven AND j.b = l.ven)"""
#: Every injective map of the shorter side, best total first.
ASSIGNED = f"""{SCORED},
shape AS (SELECT batch_id, max(invoice_idx) + 1 AS n, max(ledger_idx) + 1 AS m FROM scores GROUP BY 1),
sides AS (SELECT s.batch_id, CASE WHEN n <= m THEN invoice_idx ELSE ledger_idx END AS r, CASE WHEN n <= m THEN ledger_idx ELSE invoice_idx END AS c, score, least(n, m) AS k, n <= m AS straight FROM scores s JOIN shape USING (batch_id)),
walk AS (SELECT batch_id, k, straight, 0 AS step, []::BIGINT[] AS path, 0.0::DOUBLE AS total FROM (SELECT DISTINCT batch_id, k, straight FROM sides)
 UNION ALL SELECT w.batch_id, w.k, w.straight, w.step + 1, list_append(w.path, s.c), w.total + s.score FROM walk w JOIN sides s ON s.batch_id = w.batch_id AND s.r = w.step AND NOT list_contains(w.path, s.c)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY round(total, 9) DESC, path) AS place FROM walk WHERE step = k) WHERE place = 1),
steps AS (SELECT batch_id, straight, unnest(path) AS c, unnest(range(0, len(path))) AS r FROM best),
assigned AS (SELECT s.batch_id, s.invoice_idx, s.ledger_idx, s.score FROM steps t JOIN scores s ON s.batch_id = t.batch_id AND s.invoice_idx = CASE WHEN straight THEN r ELSE c END AND s.ledger_idx = CASE WHEN straight THEN c ELSE r END)"""
_STATUS = f"CASE WHEN score >= {AUTO_MATCH}::DOUBLE THEN 'auto_match' WHEN score >= {REVIEW}::DOUBLE THEN 'review' ELSE 'unmatched' END"
MATCHED = f"""{ASSIGNED},
matched AS (SELECT a.batch_id, a.invoice_idx, a.ledger_idx, coalesce(nullif(i.invoice_number, ''), 'inv_' || a.invoice_idx) AS invoice_id, coalesce(nullif(l.reference, ''), 'led_' || a.ledger_idx) AS ledger_ref, round(a.score, 6) AS score, {_STATUS.replace('score', 'a.score')} AS status,
 i.ref AS invoice_number_norm, l.ref AS ledger_ref_norm, i.ven AS invoice_vendor, l.ven AS ledger_vendor, coalesce(strftime(i.d, '%Y-%m-%d 00:00:00'), 'None') AS invoice_date, coalesce(strftime(l.d, '%Y-%m-%d 00:00:00'), 'None') AS ledger_date, i.amt AS invoice_amount, l.debit AS ledger_debit
 FROM assigned a JOIN inv i ON i.batch_id = a.batch_id AND i.invoice_idx = a.invoice_idx JOIN led l ON l.batch_id = a.batch_id AND l.ledger_idx = a.ledger_idx)"""


def matched(invoices: str, ledger: str) -> str:
    """MATCHED over other raw rows."""
    return MATCHED.replace(RAW, f"raw_i AS ({invoices}), raw_l AS ({ledger})")


def values(rows: list[tuple], columns: str) -> str:
    """Rows in memory as one batch."""
    said = lambda v: "NULL::VARCHAR" if v is None else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, 0::BIGINT, {', '.join(map(said, r))})" for k, r in enumerate(rows)) + f") v(ordinal, batch_id, {columns})"


def blocks(sql: str) -> str:
    return f"raw_b AS ({synthetic.oracle(sql)}), b AS (SELECT doc_id, round_even(y / 10, 0) * 10 AS band, x, CAST(pos AS INT) AS pos, y, trim(text) AS text FROM raw_b WHERE text IS NOT NULL AND confidence >= 0.3)"


INVOICE_TEXTS = f"{blocks(synthetic.INVOICE_BLOCKS)}, docs AS (SELECT doc_id, list(text ORDER BY band, x, pos) AS texts FROM b GROUP BY doc_id)"


def found(name: str, group: int = 1) -> str:
    p = FIELD_PATTERNS[name].replace("'", "''")
    hit = lambda t: f"regexp_extract({t}, '(?i){p}', {group})"
    whole = hit("array_to_string(texts, ' ')")
    return f"trim(coalesce(list_filter(list_transform(texts, lambda t: {hit('t')}), lambda t: t <> '')[1], nullif({whole}, '')))"


def found_either(name: str) -> str:
    p = FIELD_PATTERNS[name].replace("'", "''")
    hit = lambda t: f"coalesce(nullif(regexp_extract({t}, '(?i){p}', 1), ''), regexp_extract({t}, '(?i){p}', 2))"
    whole = hit("array_to_string(texts, ' ')")
    return f"trim(coalesce(list_filter(list_transform(texts, lambda t: {hit('t')}), lambda t: t <> '')[1], nullif({whole}, '')))"


_VENDOR = FIELD_PATTERNS["vendor"]
VENDOR = (
    f"coalesce(list_filter(list_transform(texts, lambda t: trim(regexp_extract(t, '(?i){_VENDOR}', 1))), lambda t: t <> '')[1], "
    f"trim(list_filter(list_transform(texts[1:10], lambda t: regexp_extract(t, '{COMPANY}', 0)), lambda t: length(t) > 4)[1]))"
)

#: Rows of the ledger tables: the fold over blocks keeps the first block of a row as its anchor.
TABLE_ROWS = f"""{blocks(synthetic.LEDGER_BLOCKS)},
folded AS (SELECT doc_id, list_reduce(list_transform(list({{'x': x, 'y': y, 'text': text}} ORDER BY band, x, pos), lambda v: {{'anchor': NULL::DOUBLE, 'row': -1::BIGINT, 'cell': v, 'cells': []::STRUCT("row" BIGINT, x DOUBLE, "at" BIGINT, "text" VARCHAR)[]}}), lambda s, v:
 {{'anchor': CASE WHEN abs(v.cell.y - s.anchor) <= 15 THEN s.anchor ELSE v.cell.y END, 'row': CASE WHEN abs(v.cell.y - s.anchor) <= 15 THEN s.row ELSE s.row + 1 END, 'cell': v.cell,
  'cells': list_append(s.cells, {{'row': CASE WHEN abs(v.cell.y - s.anchor) <= 15 THEN s.row ELSE s.row + 1 END, 'x': v.cell.x, 'at': len(s.cells), 'text': v.cell.text}})}},
 {{'anchor': NULL::DOUBLE, 'row': -1::BIGINT, 'cell': NULL, 'cells': []::STRUCT("row" BIGINT, x DOUBLE, "at" BIGINT, "text" VARCHAR)[]}}) AS f FROM b GROUP BY doc_id),
cells AS (SELECT doc_id, unnest(f.cells) AS c FROM folded),
table_rows AS (SELECT doc_id, c.row AS row_idx, list(c.text ORDER BY c.x, c.at) AS cells FROM cells GROUP BY 1, 2)"""
HEADERS = f"{TABLE_ROWS}, headers AS (SELECT doc_id, min(row_idx) FILTER (WHERE len(list_intersect(list_transform(cells, lambda t: lower(t)), {_LIST(HEADER_KEYWORDS)})) >= 2) AS header FROM table_rows GROUP BY 1)"
_COLUMN = lambda t: "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), '{w}') THEN '{n}'" for n, w in HEADER_COLUMNS) + " ELSE 'other' END"
NAMED = f"{HEADERS}, names AS (SELECT h.doc_id, list_transform(r.cells, lambda t: {_COLUMN('t')}) AS names FROM headers h JOIN table_rows r ON r.doc_id = h.doc_id AND r.row_idx = h.header)"
_LAST = lambda n: f"list_filter(list_transform(range(1, least(len(cells), len(names)) + 1), lambda k: CASE WHEN names[k] = '{n}' THEN cells[k] END), lambda v: v IS NOT NULL)[-1]"
BY_HEADER = "SELECT r.doc_id, CAST(r.row_idx AS INT) AS row_idx, " + ", ".join(f"{_LAST(n)} AS {n}" for n in ("reference", "vendor", "date", "debit", "credit")) + " FROM table_rows r JOIN headers h ON h.doc_id = r.doc_id AND r.row_idx > h.header JOIN names m ON m.doc_id = r.doc_id"
_DATED = f"regexp_matches(t, '(?i){FIELD_PATTERNS['date']}')"
_MONEY = f"(NOT {_DATED} AND (regexp_matches(t, '(?i){FIELD_PATTERNS['amount']}') OR regexp_matches(t, '^[\\d,]+\\.\\d{{2}}$')))"
_REF = f"(NOT {_DATED} AND NOT {_MONEY} AND regexp_matches(t, '^[A-Z]{{2,}}\\d{{4,}}'))"
POSITIONAL = f"""{HEADERS},
loose AS (SELECT doc_id, row_idx, unnest(cells) AS t, unnest(range(0, len(cells))) AS place FROM table_rows JOIN headers USING (doc_id) WHERE header IS NULL AND len(cells) >= 2),
kinds AS (SELECT *, CASE WHEN {_DATED} THEN 'date' WHEN {_MONEY} THEN 'money' WHEN {_REF} THEN 'reference' WHEN length(t) > 3 THEN 'name' END AS kind FROM loose),
placed AS (SELECT *, min(place) FILTER (WHERE kind = 'reference') OVER (PARTITION BY doc_id, row_idx) AS first_ref, min(place) FILTER (WHERE kind = 'money') OVER (PARTITION BY doc_id, row_idx) AS first_money FROM kinds)"""
BY_POSITION = """SELECT doc_id, CAST(row_idx AS INT) AS row_idx, arg_max(t, place) FILTER (WHERE kind = 'reference') AS reference, arg_max(t, place) FILTER (WHERE kind = 'name' AND (first_ref IS NULL OR place < first_ref)) AS vendor,
 arg_max(t, place) FILTER (WHERE kind = 'date') AS date, arg_max(t, place) FILTER (WHERE kind = 'money' AND place = first_money) AS debit, arg_max(t, place) FILTER (WHERE kind = 'money' AND place > first_money) AS credit FROM placed GROUP BY 1, 2"""

_ASKED = f"SELECT CAST(floor(CAST(substr(doc_id, 4) AS BIGINT) / 6) AS BIGINT) AS batch_id, CAST(substr(doc_id, 4) AS BIGINT) AS ordinal, {found('invoice_number')} AS invoice_number, {VENDOR} AS vendor_name, {found('date')} AS date, coalesce({found('amount')}, {found_either('currency_amount')}) AS amount"
_BLOCKS_I = INVOICE_TEXTS.replace("raw_b", "raw_bi").replace("FROM b GROUP", "FROM bi GROUP").replace(", b AS", ", bi AS")
#: A run from blocks to matches: invoices and ledger rows as they are read off the blocks.
OF_IMAGES = f"{_BLOCKS_I}, {POSITIONAL}, names AS ({NAMED.split('names AS (', 1)[1][:-1]}), asked AS ({_ASKED} FROM docs), entries AS (SELECT CAST(substr(doc_id, 4) AS BIGINT) AS batch_id, CAST(row_idx AS BIGINT) AS ordinal, reference, vendor, date, debit, credit FROM (({BY_HEADER}) UNION ALL ({BY_POSITION})) WHERE coalesce(reference, vendor, date, debit, credit) IS NOT NULL), {matched('SELECT * FROM asked', 'SELECT * FROM entries')}"
