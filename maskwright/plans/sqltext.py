"""DuckDB common table expressions that restate the operators, and a builder that picks the ones a query names."""

from __future__ import annotations

import re

from ..functions.keys import _HEAD as HEAD
from ..functions.keys import CODA, DMY, HONORIFICS, NUCLEUS, ONSET, POOL, TIME, YEARS, YMD
from ..operators.attacks import STOP
from ..operators.construct import KEY
from ..operators.detect import DETECTORS, GOLD, LABELS
from ..operators.select import COST

_SPACE = r"[ \t\n\x0B\f\r]"


def _parts(pattern: str) -> str:
    return f"""SELECT doc_id, i, tok, length(tok) AS n, (sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS upto FROM (
        SELECT doc_id, unnest(p) AS tok, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS p FROM documents))"""


def n1(c: str) -> str:
    return f"replace(lower(trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))), 'ß', 'ss')"


def n2(c: str) -> str:
    bare = rf"regexp_replace({n1(c)}, '[.,;:!?\x27\x22()\[\]{{}}<>«»„“”‘’]', '', 'g')"
    honorific = "|".join(HONORIFICS)
    plain = rf"CASE WHEN regexp_matches({bare}, '^({honorific})($|[^\p{{L}}\p{{N}}_])') THEN regexp_replace({bare}, '^({honorific}) *', '') ELSE {bare} END"
    return f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"


def index32(hexdigest: str) -> str:
    return f"('0x' || substring({hexdigest}, 9, 8))::BIGINT"


def hmac_hex(c: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({c}))))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def synthetic(index: str, type_: str) -> str:
    def syllable(i: str) -> str:
        return f"({_list(ONSET)}[(({i}) % {len(ONSET)}) + 1] || {_list(NUCLEUS)}[((({i}) // 7) % {len(NUCLEUS)}) + 1] || {_list(CODA)}[((({i}) // 13) % {len(CODA)}) + 1])"

    first = f"({index}) % {POOL}"
    whole = f"({syllable(first)} || {syllable(f'({first}) // 3')} || CASE WHEN {type_} = 'PERSON' THEN '' ELSE {syllable(f'({first}) // 9')} END)"
    return f"(upper(substring({whole}, 1, 1)) || substring({whole}, 2))"


def format_preserving(source: str, index: str) -> str:
    byte = f"('0x' || substring(sha256(({index})::VARCHAR || ':' || ((i - 1) // 32)::VARCHAR), 2 * ((i - 1) % 32) + 1, 2))::INT"
    c = "substring(s.rest, i, 1)"
    letters = f"""array_to_string(list_transform(range(1, length(s.rest) + 1), lambda i: CASE
        WHEN {c} BETWEEN '0' AND '9' THEN ({byte} % 10)::VARCHAR WHEN {c} BETWEEN 'a' AND 'z' THEN chr(97 + {byte} % 26)
        WHEN {c} BETWEEN 'A' AND 'Z' THEN chr(65 + {byte} % 26) ELSE {c} END), '')"""
    b = [f"('0x' || substring(s.first_, {2 * k + 1}, 2))::INT" for k in range(4)]
    wide = f"({YEARS[0]} + ({b[0]} * 256 + {b[1]}) % {YEARS[1] - YEARS[0] + 1})"
    group = lambda p, n: f"regexp_extract(s.rest, '{p}', {n})"
    shaped = lambda p: f"regexp_matches(s.rest, '{p}') AND {group(p, 2)} = {group(p, 4)}"

    def parts(p: str, at: tuple[int, int, int]) -> tuple[str, str, str, str]:
        day, month, year = (group(p, n) for n in at)
        m = f"({b[2]} % (CASE WHEN length({month}) = 1 THEN 9 ELSE 12 END) + 1)"
        top = f"day(last_day(make_date(CASE WHEN length({year}) = 4 THEN {wide} ELSE 2000 + {b[0]} % 100 END, {m}, 1)))"
        d = f"({b[3]} % least({top}, CASE WHEN length({day}) = 1 THEN 9 ELSE 31 END) + 1)"
        y = f"(CASE WHEN length({year}) = 4 THEN {wide} ELSE {b[0]} % 100 END)"
        pad = lambda x, w: f"lpad(({x})::VARCHAR, length({w})::INT, '0')"
        return pad(d, day), pad(m, month), pad(y, year), group(p, 2)

    d, m, y, sep = parts(DMY, (1, 3, 5))
    d2, m2, y2, sep2 = parts(YMD, (5, 3, 1))
    hour = group(TIME, 1)
    clock = f"lpad(({b[0]} % (CASE WHEN length({hour}) = 1 THEN 10 ELSE 24 END))::VARCHAR, length({hour})::INT, '0') || ':' || lpad(({b[1]} % 60)::VARCHAR, 2, '0') || CASE WHEN {group(TIME, 4)} = '' THEN '' ELSE ':' || lpad(({b[2]} % 60)::VARCHAR, 2, '0') END"
    head = f"regexp_extract({source}, '{HEAD}', 1)"
    return f"""list_transform([{{'head': {head}, 'rest': substring({source}, length({head}) + 1), 'first_': sha256(({index})::VARCHAR || ':0')}}], lambda s: s.head || CASE
        WHEN {shaped(DMY)} THEN {d} || {sep} || {m} || {sep} || {y} WHEN {shaped(YMD)} THEN {y2} || {sep2} || {m2} || {sep2} || {d2}
        WHEN regexp_matches(s.rest, '{TIME}') THEN {clock} ELSE {letters} END)[1]"""


def _detectors() -> str:
    out = [f"""SELECT doc_id, '{n}' AS detector, ord, start, "end", word AS text, '{label}' AS type_src, {score}::DOUBLE AS score FROM words WHERE regexp_matches(word, '{p}')""" for n, (p, label, score) in DETECTORS.items()]
    cap = "^[A-ZÀ-Þ][a-zß-ÿ]+$"
    out.append(f"""SELECT doc_id, 'pair', ord, start, end2, word || ' ' || word2, 'PERSON NAME', 0.8 FROM (
        SELECT *, lead(start) OVER w AS start2, lead("end") OVER w AS end2, lead(word) OVER w AS word2 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
        WHERE regexp_matches(word, '{cap}') AND regexp_matches(word2, '{cap}') AND start2 = "end" + 1""")
    return " UNION ALL ".join(out)


LABEL = r"upper(trim(regexp_replace(regexp_replace(trim(type_src), '^[BIESUL][-_](.)', '\1'), '[ \t\-]+', '_', 'g'), '_'))"
_TABLE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
_OVERLAP = 't.doc_id = s.doc_id AND t."end" > s.start AND t.start < s."end"'

CTES: dict[str, str] = {
    "tokens": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, upto - n AS start, upto AS "end", tok FROM ({_parts(r'([\p{L}\p{N}_]+|[ \t\n\x0B\f\r]+|[^\p{L}\p{N}_ \t\n\x0B\f\r])')})
        WHERE NOT regexp_matches(tok, '^{_SPACE}+$')""",
    "words": rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, start, start + length(word) AS "end", word FROM (
        SELECT doc_id, i, upto - n + length(regexp_extract(tok, '^[^\p{{L}}\p{{N}}]*')) AS start, regexp_replace(tok, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS word
        FROM ({_parts(r'([^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+)')}) WHERE regexp_matches(tok, '[\p{{L}}\p{{N}}]'))""",
    "raw": _detectors(),
    "labelled": f"SELECT *, {LABEL} AS label_ FROM raw",
    "harmonised": f"""SELECT * EXCLUDE (label_, t_), coalesce(t_, 'MISC') AS type, t_ IS NOT NULL AS was_mapped FROM (SELECT *, CASE label_ {_TABLE} ELSE
        CASE WHEN label_ IN ('PERSON','LOC','ORG','DATETIME','CODE','DEMOGRAPHIC','QUANTITY','MISC') THEN label_ END END AS t_ FROM labelled)""",
    "spans": r"SELECT * FROM harmonised WHERE type <> 'CODE' OR (length(trim(text)) >= 5 AND regexp_matches(text, '[\p{L}\p{N}]'))",
    "gold": f"""SELECT doc_id, ord, start, "end", word AS text, type, type || ':' || lower(word) AS entity FROM (SELECT *, CASE {' '.join(f"WHEN regexp_matches(word, '{p}') THEN '{t}'" for t, p in GOLD.items())} END AS type FROM words) WHERE type IS NOT NULL""",
    "reach": 'SELECT *, max("end") OVER (PARTITION BY doc_id, type ORDER BY start, "end", detector ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach_ FROM spans',
    "clusters": 'SELECT *, sum(CASE WHEN reach_ IS NULL OR start >= reach_ THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, type ORDER BY start, "end", detector ROWS UNBOUNDED PRECEDING) AS cluster FROM reach',
    "voted": """SELECT *, "end" - start AS len_, min(start) OVER k AS env_start, max("end") OVER k AS env_end, count(DISTINCT detector) OVER k AS votes,
        count(DISTINCT detector) OVER (PARTITION BY doc_id) AS present, count(*) OVER (PARTITION BY doc_id, type, cluster, start, "end") AS agreed_ FROM clusters WINDOW k AS (PARTITION BY doc_id, type, cluster)""",
    "union_": """SELECT DISTINCT v.doc_id, type, env_start AS start, env_end AS "end", substring(d.text, env_start + 1, env_end - env_start) AS text, votes FROM voted v JOIN documents d USING (doc_id)""",
    # left to right with a cursor; recursion over the place in the document
    "sorted_": """SELECT doc_id, start, "end", text, type, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, text, type) AS r FROM (SELECT DISTINCT doc_id, start, "end", text, type FROM union_)""",
    "resolved": """SELECT doc_id, r - 1 AS ord, start, "end", text, type, kept FROM (
        WITH RECURSIVE walk AS (SELECT *, "end" AS cursor_, true AS kept FROM sorted_ WHERE r = 1
        UNION ALL SELECT s.*, CASE WHEN s.start >= w.cursor_ THEN s."end" ELSE w.cursor_ END, s.start >= w.cursor_ FROM walk w JOIN sorted_ s ON s.doc_id = w.doc_id AND s.r = w.r + 1) SELECT * FROM walk)""",
    "assigned": f"""SELECT *, {index32(hmac_hex('entity_key'))} AS idx FROM (SELECT *, type || chr(31) || {n2('text')} AS entity_key FROM resolved WHERE kept)""",
    "edits_b": f"""SELECT *, CASE WHEN type IN ('PERSON', 'LOC', 'ORG', 'DEMOGRAPHIC') THEN {synthetic('idx', 'type')} WHEN type = 'CODE' THEN {format_preserving('text', 'idx')} ELSE text END AS replacement FROM assigned""",
    "edits_c": "SELECT *, '[' || CASE WHEN type = 'LOC' THEN 'LOCATION' ELSE type END || ']' AS replacement FROM assigned",
    **{
        f"placed_{x}": f"""SELECT doc_id, start AS old_start, "end" AS old_end, start + shift AS new_start, start + shift + length(replacement) AS new_end, replacement, text, type FROM (
        SELECT *, coalesce(sum(length(replacement) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM edits_{x})"""
        for x in "bc"
    },
    **{
        f"release_{x}": f"""SELECT d.doc_id, CASE WHEN e.body IS NULL THEN d.text ELSE e.body || substring(d.text, e.last_ + 1) END AS released FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(substring(t, prev + 1, old_start - prev) || replacement, '' ORDER BY old_start) AS body, max(old_end) AS last_ FROM (
            SELECT p.*, d.text AS t, coalesce(lag(old_end) OVER (PARTITION BY p.doc_id ORDER BY old_start), 0) AS prev FROM placed_{x} p JOIN documents d USING (doc_id)) GROUP BY doc_id) e USING (doc_id)"""
        for x in "bc"
    },
    "predicted": 'SELECT detector AS source, doc_id, start, "end" FROM spans',
    "gold_tokens": 'SELECT doc_id, ord, type, entity FROM (SELECT t.doc_id, t.ord, s.type, s.entity, row_number() OVER (PARTITION BY t.doc_id, t.ord ORDER BY s.ord DESC) AS n FROM tokens t JOIN gold s ON ' + _OVERLAP + ") WHERE n = 1",
    "covered": "SELECT DISTINCT t.doc_id, t.ord, s.detector FROM tokens t JOIN spans s ON " + _OVERLAP,
    "stop": "SELECT unnest([" + ", ".join(f"'{w}'" for w in STOP) + "]) AS term",
    "cost": "SELECT unnest([" + ", ".join(f"'{k}'" for k in COST) + "]) AS detector, unnest([" + ", ".join(f"{v}::DOUBLE" for v in COST.values()) + "]) AS c",
}


def with_(body: str, extra: dict[str, str] | None = None) -> str:
    """The query preceded by the expressions it uses, directly or not."""
    known, need, order = CTES | (extra or {}), [body], []
    used: set[str] = set()
    while need:
        text = need.pop()
        for name in known:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                need.append(known[name])

    def visit(name: str) -> None:
        for other in known:
            if other != name and other in used and other not in order and re.search(rf"\b{other}\b", known[name]):
                visit(other)
        if name not in order:
            order.append(name)

    for name in [n for n in known if n in used]:
        visit(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" if order else "") + body
