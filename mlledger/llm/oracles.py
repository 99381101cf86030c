"""The queries in SQL, where SQL can express them.

The licence texts of the scan are data, so the SQL takes them from the same list.
"""

from __future__ import annotations

from mlledger.llm.license_digest import LICENSES

OP2 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scored)
WHERE rank <= 10
"""

OP4 = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
chats AS (
    SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text)
                         ORDER BY turn, role, text) AS whole,
           string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '')
                      || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
    FROM turns GROUP BY conv_id
),
distinct_chats AS (
    SELECT min(conv_id) AS conv_id, whole, any_value(rendered) AS rendered, count(*) AS n_copies
    FROM chats GROUP BY whole
)
SELECT conv_id, len(whole) AS n_turns, n_copies, 0 AS part, rendered
FROM distinct_chats AS a
WHERE NOT EXISTS (
    SELECT 1 FROM distinct_chats AS b
    WHERE len(b.whole) > len(a.whole) AND b.whole[1].text = a.whole[1].text
      AND b.whole[:len(a.whole)] = a.whole
)
"""

OP6 = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, unnest(list_distinct(
        CASE WHEN len(w) = 0 THEN []
             WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END)) AS shingle
    FROM words
), sizes AS MATERIALIZED (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM sets AS x JOIN sets AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    JOIN sizes AS m ON m.doc_id = x.doc_id JOIN sizes AS n ON n.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id
    HAVING 100 * count(*) >= 85 * (any_value(m.n) + any_value(n.n) - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached AS r JOIN links AS l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id,
       r.doc_id = min(r.other) AS kept
FROM reached AS r LEFT JOIN sizes AS s ON s.doc_id = r.doc_id
GROUP BY r.doc_id
"""


# The rule for lines that state a copyright, once more. These words make such a line
# part of the wording.
WORDING = (
    r"(?:(?:notice|holder|owner|law|license|licence|interest|statement|treat(?:y|ie)|act|permission"
    r"|disclaimer|protection|doctrine|status|information|ownership|right)s?"
    r"|and|or|in|on|of|for|to|is|are|as|that|which|under|above|applies|resulting)"
)
STATEMENT = (
    r"[ \t*#/;-]*(?:copyright:?[ \t]*(?:\(c\)|©|[0-9\[<{])|copyright:?[ \t]+[0-9A-Za-z]"
    r"|\(c\)[ \t]*(?:copyright|[0-9\[<{])|©|all rights reserved)[^\n]*"
)


def readings(text: str) -> tuple[str, str]:
    """SQL for the two canonical forms of a text: without all lines that state a copyright, and
    without those that open a block. A sign that no statement has is put before wording."""
    lower = (
        f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz')"
    )
    lower = (
        rf"regexp_replace({lower}, '(^|\n)([ \t*#/;-]*copyright:?[ \t]+)({WORDING}\b)', "
        r"'\1\2' || chr(1) || '\3', 'g')"
    )
    lines = rf"regexp_replace({lower}, '(^|\n){STATEMENT}', chr(10), 'g')"
    two, three = "chr(10) || chr(10)", "chr(10) || chr(10) || chr(10)"
    blocks = rf"regexp_replace({lower}, '\n(?:[ \t*#/;-]*\n)+', {three}, 'g')"
    blocks = rf"regexp_replace({blocks}, '(?:\A\n*|\n\n)(?:{STATEMENT}\n?)+', {two}, 'g')"
    signs = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}‐-―‘-‟•]+"
    return tuple(f"regexp_replace({form}, '{signs}', ' ', 'g')" for form in (lines, blocks))


def digest(text: str) -> str:
    out = rf"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'), ' ')"
    for old, new in (
        ("licence", "license"),
        ("sub license", "sublicense"),
        ("non infringement", "noninfringement"),
        ("non commercial", "noncommercial"),
        ("merchantibility", "merchantability"),
        ("acknowledgement", "acknowledgment"),
        ("organisation", "organization"),
        ("favour", "favor"),
        ("http www", "https www"),
    ):
        out = f"replace({out}, '{old}', '{new}')"
    return f"sha256({out})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


KNOWN = ", ".join(f"({quoted(key)}, {quoted(text)})" for key, text in LICENSES)
KNOWN_LINES, KNOWN_BLOCKS = readings("known")
TEXT_LINES, TEXT_BLOCKS = readings("text")
OP10 = f"""
WITH texts AS (
    SELECT license_id, known FROM (VALUES {KNOWN}) AS t(license_id, known)
), known AS MATERIALIZED (
    SELECT digest, min(license_id) AS license_id, bool_or(one) AS one FROM (
        SELECT license_id, {digest(KNOWN_LINES)} AS digest, NOT contains(known, chr(10)) AS one FROM texts
        UNION ALL SELECT license_id, {digest(KNOWN_BLOCKS)}, NOT contains(known, chr(10)) FROM texts
    ) GROUP BY digest
), forms AS MATERIALIZED (
    SELECT doc_id, {TEXT_LINES} AS form, {digest(TEXT_BLOCKS)} AS opened,
           row_number() OVER () AS row_no FROM documents
), notices AS (
    SELECT row_no, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
    FROM (SELECT row_no, {digest("line")} AS digest
          FROM (SELECT row_no, unnest(string_split(form, chr(10))) AS line FROM forms))
    JOIN known USING (digest) WHERE one GROUP BY row_no
)
SELECT doc_id, {digest("form")} AS digest, coalesce(a.license_id, b.license_id) AS license_id,
       coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notice_ids
FROM forms LEFT JOIN notices USING (row_no)
LEFT JOIN known AS a ON a.digest = {digest("form")}
LEFT JOIN known AS b ON b.digest = opened
"""

LOWERED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 by its table: 256 entries, each eight steps of the division.
OP11 = f"""
WITH crc_table AS MATERIALIZED (
    SELECT list(v ORDER BY i) AS entries FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, step:
            CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM (SELECT unnest(range(256)) AS i))
), doc_words AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS row_no, {WORDS} AS w FROM documents
), doc_features AS MATERIALIZED (
    SELECT row_no, unnest(w) AS feature FROM doc_words
), target_features AS MATERIALIZED (
    SELECT unnest({WORDS}) AS feature FROM benchmark
), buckets AS MATERIALIZED (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
        xor(c >> 8, entries[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
    FROM (
        SELECT feature, list_transform(range(length(hex(encode(feature))) // 2), lambda i:
            ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT) AS bytes
        FROM (SELECT feature FROM doc_features UNION SELECT feature FROM target_features)
    ), crc_table
), s AS (
    SELECT bucket, count(*) AS n FROM doc_features JOIN buckets USING (feature) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS n FROM target_features JOIN buckets USING (feature) GROUP BY bucket
), gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln(
        ((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_features) + 10000)::DOUBLE)
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target_features) + 10000)::DOUBLE)
    ))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket)
), weights AS (
    SELECT row_no, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM doc_features JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY row_no
), scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296::DOUBLE)))::BIGINT AS score
    FROM doc_words LEFT JOIN weights USING (row_no)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_features >= 20) AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM numbered
"""

OP12 = f"""
WITH doc_words AS MATERIALIZED (
    SELECT doc_id, row_number() OVER () AS row_no, {WORDS} AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, {WORDS} AS w FROM benchmark
), windows AS MATERIALIZED (
    SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (
        SELECT item_id, unnest(list_transform(range(greatest(len(w) - 9, 1)),
                                              lambda i: w[i + 1:i + 10])) AS x
        FROM items WHERE len(w) > 0)
), places AS (
    SELECT row_no, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS x
    FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS pos
          FROM doc_words, (SELECT DISTINCT n FROM windows))
), hits AS MATERIALIZED (
    SELECT row_no, pos, n, item_id FROM places JOIN windows USING (n, x)
), covered AS (
    SELECT row_no, count(DISTINCT place) AS n_hit
    FROM (SELECT DISTINCT row_no, unnest(range(pos, pos + n)) AS place FROM hits) GROUP BY row_no
), found AS (
    SELECT row_no, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
    FROM hits GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN covered USING (row_no) LEFT JOIN found USING (row_no)
"""

OP13 = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), facts AS (
    SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
           coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS copy
    FROM docs
), marks AS (
    SELECT doc_id, part, [
        len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
        regexp_matches(text, '[#$%&*|]'), copy] AS fails
    FROM facts
), flags AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counts AS MATERIALIZED (
    SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
    FROM marks LEFT JOIN flags USING (doc_id) GROUP BY ALL
), letters(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS letter, ascii(filter_order[step]) - 64 AS own,
           list_transform(string_split(filter_order[:step - 1], ''), lambda x: ascii(x) - 64) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), seen AS (
    SELECT part, filter_order, step, letter, n, good, toxic, fails[own] AS fails,
           step > 1 AND list_bool_or(list_transform(earlier, lambda i: fails[i])) AS gone,
           len(list_filter(fails, lambda f: f)) = 1 AS alone
    FROM counts, steps
), audited AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM seen GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM audited
"""

ORACLES: dict[str, str] = {
    "op2_kdtree_topk": OP2,
    "op4_chat_snapshots": OP4,
    "op6_odd_sketch_dedup": OP6,
    "op10_license_digests": OP10,
    "op11_target_resampling": OP11,
    "op12_benchmark_decontamination": OP12,
    "op13_filter_audit": OP13,
}
