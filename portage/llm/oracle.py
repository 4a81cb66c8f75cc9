"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from portage.llm.chat import CLOSE, CONTROLS, ESCAPES, OPEN, PROBE
from portage.llm.warc import BASE32


def _escaped(text: str, line: bool = False) -> str:
    """SQL for the text in which a conversation's text stands in the formatted one."""
    text = f"replace({text}, '\\', '{ESCAPES['\\']}')"
    for control in CONTROLS:
        text = f"replace({text}, '{control}', '{ESCAPES[control[0]] + control[1:]}')"
    return f"replace({text}, chr(10), '{ESCAPES[chr(10)]}')" if line else text


def _base32(hexadecimal: str) -> str:
    """SQL for the base 32 of 40 hex digits, five at a time."""
    number = f"CAST('0x' || substr({hexadecimal}, 5 * i + 1, 5) AS INTEGER)"
    digits = " || ".join(f"substr('{BASE32}', (({number} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"list_aggregate(list_transform(range(8), lambda i: {digits}), 'string_agg', '')"


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text: each byte is followed by eight steps of one bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = f"CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS BIGINT), {steps}), lambda a, x: {step}), {0xFFFFFFFF})"


def _edit(path: str, cost: str, edit: str) -> str:
    """SQL for a path of edits (nine digits of cost, then the initials) and one more."""
    return f"lpad(CAST(CAST({path}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {path}[10:] || '{edit}'"


def _repair() -> str:
    """SQL for the repair: the best path to each of the four states, row by row, forward."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    reroled = {s: _edit(s, "2 + cut", "R") for s in ("s0", "s1", "s2", "s3")}
    kept = {s: _edit(s, "cut", "K") for s in ("s0", "s1", "s2", "s3")}
    gone = {s: _edit(s, "3", "D") for s in ("s0", "s1", "s2", "s3")}
    to_user = f"least({reroled['s0']}, {reroled['s1']}, {reroled['s3']})"
    as_user = f"least({kept['s0']}, {kept['s1']}, {kept['s3']})"
    inserted = f"least(n2, {_edit('n0', '2', 'I')}, {_edit('n1', '2', 'I')}, {_edit('n3', '2', 'I')})"
    return f"""
        WITH RECURSIVE h AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
            FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM h),
        seen AS (
            SELECT *, rtrim(text, {space}) AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again
            FROM damaged),
        placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), again) AS i
            FROM seen),
        judged AS (
            SELECT *, role[1] AS initial, said = '' OR again AS must_go,
                CAST(NOT (said = '' OR again) AND said[-1] NOT IN ('.', '!', '?') AS INTEGER) AS cut
            FROM placed),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (said = '') AS blank, count(*) FILTER (said <> '' AND again) AS duplicate, sum(cut) AS truncated
            FROM judged GROUP BY conv_id),
        pairs AS (
            SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair, i FROM judged),
        wrong AS (
            SELECT p.conv_id, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs p GROUP BY p.conv_id),
        paths AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000002I' AS s2, '000000004II' AS s3
            FROM counts
            UNION ALL
            SELECT conv_id, i, n0, n1, t2, least(n3, {_edit('t2', '2', 'I')})
            FROM (
                SELECT *, {inserted} AS t2 FROM (
                    SELECT p.conv_id, j.i, {gone['s0']} AS n0,
                        least({gone['s1']}, CASE WHEN NOT must_go AND initial = 's' THEN {kept['s0']} END) AS n1,
                        least({gone['s2']}, CASE WHEN NOT must_go THEN {to_user} END, CASE WHEN NOT must_go AND initial = 'u' THEN {as_user} END) AS n2,
                        least({gone['s3']}, CASE WHEN NOT must_go THEN {reroled['s2']} END, CASE WHEN NOT must_go AND initial = 'a' THEN {kept['s2']} END) AS n3
                    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1))),
        best AS (
            SELECT p.conv_id, CAST(least(s0, s3)[1:9] AS BIGINT) AS cost, least(s0, s3)[10:] AS audit
            FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i),
        edits AS (
            SELECT conv_id, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS i
            FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
        made AS (
            SELECT e.conv_id, p, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS k,
                first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id ORDER BY p) AS opened
            FROM edits e JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = greatest(e.i, 1)
            WHERE edit <> 'D'),
        repaired AS (
            SELECT conv_id, sha256(string_agg(
                CASE WHEN edit = 'K' THEN role WHEN (k - CAST(opened AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
            FROM made GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
            CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
            CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
            coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


_PROBE = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in PROBE)

_FOUND = {
    "op1_exact_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        met AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM met) WHERE k <= 5""",
    "op5_warc": f"""
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, {_base32("sha1(coalesce(html, ''))")} AS payload_digest
            FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op10_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_PROBE}))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length({_escaped("role", line=True)}) + length({_escaped("text")}) + {len(OPEN) + len(CLOSE) + 2}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op4_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS run
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        runs AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS run
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
        met AS (SELECT doc_id, r.n, s, item FROM runs r JOIN windows i ON r.n = i.n AND r.run = i.run),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        runs AS (
            SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS run
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
        later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_ranked_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT item_id, unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
        asked AS (SELECT item_id, term, count(*) AS often FROM b GROUP BY item_id, term),
        corpus AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d),
        found AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d)
            WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
        weighed AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM found, corpus GROUP BY term),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
            FROM found JOIN weighed USING (term) JOIN asked USING (term), corpus GROUP BY item_id, doc_id)
        SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0) WHERE k <= 20""",
    "op13_conversation_structure_repair": _repair(),
}

ORACLE_SQL = dict(_FOUND)
