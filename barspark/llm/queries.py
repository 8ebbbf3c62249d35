"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark.llm.chunking import op8_chunk_fingerprints
from barspark.llm.conversations import op12_tight_arcs
from barspark.llm.jaccard import op9_t_occurrence_join
from barspark.llm.languages import op5_kernel_languages
from barspark.llm.mixing import op6_entropy_mixing
from barspark.llm.negatives import op11_dual_tree
from barspark.llm.ngrams import op3_elias_fano_lm
from barspark.llm.pieces import op2_piece_transducer
from barspark.llm.quality import op1_byte_convolution
from barspark.llm.repetition import op7_suffix_repetition
from barspark.llm.secrets import op10_secret_ledger
from barspark.llm.sharding import op4_jump_sharding
from barspark.llm.urlfilter import op13_redirect_equivalence

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_byte_convolution": op1_byte_convolution,
    "op2_piece_transducer": op2_piece_transducer,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_jump_sharding": op4_jump_sharding,
    "op5_kernel_languages": op5_kernel_languages,
    "op6_entropy_mixing": op6_entropy_mixing,
    "op7_suffix_repetition": op7_suffix_repetition,
    "op8_chunk_fingerprints": op8_chunk_fingerprints,
    "op9_t_occurrence_join": op9_t_occurrence_join,
    "op10_secret_ledger": op10_secret_ledger,
    "op11_dual_tree": op11_dual_tree,
    "op12_tight_arcs": op12_tight_arcs,
    "op13_redirect_equivalence": op13_redirect_equivalence,
}

#: Joined by shingle, so every pair of texts that share one is counted; for tables of the size of tests.
_SIMILAR_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
classed AS (SELECT doc_id, words, array_to_string(words, ' ') AS class FROM worded),
classes AS (SELECT class, any_value(words) AS words, min(doc_id) AS least FROM classed WHERE len(words) > 0 GROUP BY class),
shingles AS (
    SELECT DISTINCT class, CASE WHEN len(words) < 4 THEN class ELSE array_to_string(words[k:k + 3], ' ') END AS shingle
    FROM (SELECT class, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM classes)),
sizes AS (SELECT class, count(*) AS n FROM shingles GROUP BY class),
shared AS (
    SELECT a.class AS u, b.class AS v, count(*) AS common
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class < b.class GROUP BY u, v),
links AS (
    SELECT u, v FROM shared JOIN sizes x ON x.class = u JOIN sizes y ON y.class = v
    WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (
    SELECT class, class AS other FROM classes
    UNION
    SELECT r.class, w.v FROM reached r JOIN ways w ON w.u = r.other),
components AS (SELECT r.class, min(c.least) AS component FROM reached r JOIN classes c ON c.class = r.other GROUP BY r.class)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM classed d LEFT JOIN sizes s ON s.class = d.class LEFT JOIN components c ON c.class = d.class
"""

#: Links in the plain forms that SQL can pick out: absolute, in double quotes, rel or http-equiv first.
_URL_SQL = r"""
WITH RECURSIVE parsed AS (
    SELECT row_number() OVER () AS row_id, page_id, html, contains(url, '://') AS good,
        CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
placed AS (
    SELECT row_id, page_id, html, good, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
    FROM parsed),
linked AS (
    SELECT p.host || p.tail AS u, substring(t.target, instr(t.target, '://') + 3) AS rest
    FROM placed p, (
        SELECT row_id, unnest(list_concat(
            regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1),
            regexp_extract_all(html, '<meta http-equiv="refresh" content="0; ?url=([^"]*)"', 1))) AS target
        FROM placed) t
    WHERE p.row_id = t.row_id AND p.good AND contains(t.target, '://')),
edges AS (
    SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v
    FROM linked),
ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reached AS (
    SELECT u AS a, u AS b FROM ways
    UNION
    SELECT r.a, w.v FROM reached r JOIN ways w ON w.u = r.b),
rules(h, p, rule, verdict) AS (VALUES
    ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
    ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
spots AS (
    SELECT DISTINCT host, path FROM placed
    UNION SELECT regexp_extract(a, '^[^/?]*'), regexp_extract(a, '^[^/?]*([^?]*)', 1) FROM reached),
fits AS (
    SELECT s.host, s.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
    FROM spots s JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p) GROUP BY s.host, s.path),
classes AS (
    SELECT r.a, min(r.b) AS alias_of, count(*) FILTER (f.verdict = 'block') > 0 AS blocked
    FROM reached r LEFT JOIN fits f ON f.host = regexp_extract(r.b, '^[^/?]*') AND f.path = regexp_extract(r.b, '^[^/?]*([^?]*)', 1) GROUP BY r.a)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict, c.alias_of
FROM placed p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path LEFT JOIN classes c ON p.good AND c.a = p.host || p.tail
"""

#: All scores of all anchors, for tables of the size of tests.
_NEGATIVES_SQL = """
WITH valid AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, b.row_id, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.row_id <> b.row_id),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id NULLS LAST) AS band FROM scored WHERE same QUALIFY band <= 5),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_row, p.band ORDER BY n.score DESC, n.vec_id NULLS LAST)::INT AS rank
    FROM positives p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT * FROM negatives WHERE rank <= 5
"""

def _repair_sql() -> str:
    """Conversation repair as a recursion over turns: for each state of the grammar the least (cost, letters, lines) of a prefix of turns."""
    never, nothing = "{'c': 1000000000::BIGINT, 's': '', 't': []::VARCHAR[]}", "{'c': 0::BIGINT, 's': '', 't': []::VARCHAR[]}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    edit = lambda x, cost, letter, line: f"{{'c': {x}.c + {cost}, 's': {x}.s || '{letter}', 't': {f'list_append({x}.t, {line})' if line else f'{x}.t'}}}"
    insert = lambda x, role: edit(x, 5, "I", f"'{role}:'")
    more = "CASE n.fault WHEN 'truncated' THEN 5 ELSE 0 END"
    may = "n.fault NOT IN ('blank', 'duplicate')"
    line = lambda role: f"{role} || ':' || n.text"

    def keep(x: str, initial: str) -> str:
        return f"CASE WHEN {may} AND n.role[1] = '{initial}' THEN {edit(x, more, 'K', line('n.role'))} ELSE {never} END"

    def rerole(x: str, role: str) -> str:
        return f"CASE WHEN {may} THEN {edit(x, f'1 + {more}', 'R', line(repr(role)))} ELSE {never} END"

    drop = lambda x: edit(x, 2, "D", "")
    into2 = [f for q in (0, 1, 3) for f in (keep(f"r.a{q}", "u"), rerole(f"r.a{q}", "user"))]
    step = (drop("r.a0"), least(drop("r.a1"), keep("r.a0", "s")), least(drop("r.a2"), *into2), least(drop("r.a3"), keep("r.a2", "a"), rerole("r.a2", "assistant")))
    # Insertions before the next turn: a user turn after states 0, 1 and 3, then an assistant turn.
    opened = lambda of: f"SELECT conv, i, b0 AS a0, b1 AS a1, u AS a2, {least('b3', insert('u', 'assistant'))} AS a3 FROM (SELECT *, {least('b2', insert('b0', 'user'), insert('b1', 'user'), insert('b3', 'user'))} AS u FROM ({of}))"
    crc = "xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"
    solid = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE drawn AS (SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS draw FROM conversations),
hurt AS (
    SELECT conv, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS i FROM hurt),
n AS (
    SELECT conv, i, turn, role, text, CASE WHEN NOT regexp_matches(text, '{solid}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        lag(role) OVER (PARTITION BY conv ORDER BY i) AS before
    FROM placed),
r AS (
    {opened(f"SELECT DISTINCT conv, 0::BIGINT AS i, {nothing} AS b0, {never} AS b1, {never} AS b2, {never} AS b3 FROM n")}
    UNION ALL
    {opened(f"SELECT n.conv, n.i, {step[0]} AS b0, {step[1]} AS b1, {step[2]} AS b2, {step[3]} AS b3 FROM r JOIN n ON n.conv = r.conv AND n.i = r.i + 1")}),
ends AS (SELECT conv, list_min([a0, a3]) AS best FROM r WHERE i = (SELECT max(m.i) FROM n m WHERE m.conv = r.conv)),
counts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM n GROUP BY conv)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM drawn) d LEFT JOIN counts c ON c.conv = d.conv LEFT JOIN ends e ON e.conv = d.conv
"""


ORACLE_SQL: dict[str, str] = {"op11_dual_tree": _NEGATIVES_SQL, "op12_tight_arcs": _repair_sql(), "op9_t_occurrence_join": _SIMILAR_SQL, "op13_redirect_equivalence": _URL_SQL}
