"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from faultline.llm.fingerprint import LANES, MODULUS, UNIT
from faultline.llm.vectorcodes import ENTRIES, PARTS, SCALE

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _archives() -> str:
    group = "CAST('0x' || substr(sha1(payload), 5 * g + 1, 5) AS BIGINT)"
    digits = " || ".join(f"substr('{_BASE32}', CAST(({group} >> {s}) & 31 AS INT) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, url, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {digits}), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, url, CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, payload_bytes, payload_digest FROM m"""


def _fingerprints() -> str:
    def lanes(table: str, text: str, name: str) -> str:
        words = ", ".join(f"CAST('0x' || substr(md5(u), {8 * j + 1}, 8) AS BIGINT) AS w{j}" for j in range(LANES // 32))
        sums = ", ".join(f"CAST(coalesce(sum(2 * ((w{j} >> {i}) & 1) - 1), 0) AS BIGINT)" for j in range(LANES // 32) for i in range(32))
        return f"""{name}_units AS (SELECT doc_id, unnest(regexp_extract_all({text}, '{UNIT}')) AS u FROM {table}),
{name}_words AS (SELECT doc_id, {words} FROM {name}_units),
{name} AS (SELECT t.doc_id, [{sums}] AS v FROM {table} t LEFT JOIN {name}_words USING (doc_id) GROUP BY t.doc_id)"""

    text = lambda v: f"array_to_string(list_transform({v}, lambda x: printf('%04x', (x % {MODULUS} + {MODULUS}) % {MODULUS})), '')"
    dot = lambda a, b: f"CAST(list_sum(list_transform(range({LANES}), lambda i: {a}[i + 1] * {b}[i + 1])) AS BIGINT)"

    def like(a: str, b: str) -> str:
        both = f"({dot(a, a)} + {dot(b, b)})"
        return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {both} > 0 THEN greatest(least(2.0::DOUBLE * {dot(a, b)} / {both}, 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END"

    return f"""WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
 coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM base WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT doc_id, n, next_id, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM following),
{lanes("base", "text", "own")},
{lanes("edits", "edited", "changed")}
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, {text("a.v")} AS fingerprint, {text("b.v")} AS edited_fingerprint,
 {like("a.v", "b.v")} AS near_edited, {like("a.v", "c.v")} AS near_next
FROM edits e JOIN own a USING (doc_id) JOIN changed b USING (doc_id) JOIN own c ON c.doc_id = e.next_id"""


def _fill_in_middle() -> str:
    group = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    joined = lambda a, b: f"array_to_string(u[{a} + 1:{b}], '')"
    return rf"""WITH base AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM base),
drawn AS (SELECT *, len(u) AS n, least({group(0)} % (len(u) + 1), {group(1)} % (len(u) + 1)) AS a, greatest({group(0)} % (len(u) + 1), {group(1)} % (len(u) + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {group(2)} % 100 >= 50 THEN 'plain'
 WHEN {group(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (SELECT *, {joined("0", "a")} AS p, {joined("a", "b")} AS m, {joined("b", "n")} AS s FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM cut"""


def _vector_codes() -> str:
    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT r, vec_id, label, p, x, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d * {ENTRIES} + e) // {ENTRIES} AS d FROM
 (SELECT parts.*, b.e, CAST(list_sum(list_transform(range(len(b.x)), lambda i: (parts.x[i + 1] - b.x[i + 1]) * (parts.x[i + 1] - b.x[i + 1]))) AS BIGINT) AS d
 FROM parts JOIN b{k} b USING (p)) GROUP BY r, vec_id, label, p, x)"""

    def moved(k: int) -> str:
        return f"""c{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM
 (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(c.x, b.x) AS x FROM b{k} b LEFT JOIN c{k} c USING (p, e))"""

    return f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS (SELECT r, vec_id, label, p, list_transform(embedding[p * len(embedding) // {PARTS} + 1:(p + 1) * len(embedding) // {PARTS}],
 lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM kept, range({PARTS}) AS t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM (SELECT p, vec_id, min(x) AS x FROM parts WHERE vec_id IS NOT NULL GROUP BY p, vec_id)
 QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{assigned(0)},
{moved(0)},
{assigned(1)},
{moved(1)},
{assigned(2)},
coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _archives(), "op7_fingerprints": _fingerprints(), "op12_fill_in_middle": _fill_in_middle(),
            "op13_vector_codes": _vector_codes()}
