"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .chat import CONTROLS
from .topk import K1, B

_LOWER = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"


def _words(text: str) -> str:
    return rf"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"


#: Windows are strings of 50 words; the words under a window that starts in an earlier document go.
OP2 = f"""WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
    place AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM place),
    early AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN early USING (h) WHERE low < doc_id)),
    each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Intersections are counted from shared shingles, components followed from every document.
OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE [ws[k] || ' ' || ws[k + 1] FOR k IN range(1, len(ws))] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, side.b FROM reach JOIN side ON side.a = reach.b),
    low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low ON a = doc_id"""


def _escaped(text: str) -> str:
    """The text as the template escapes it: the escape character first, then each control string."""
    for k, control in enumerate(("\\", *CONTROLS)):
        text = f"replace({text}, '{control}', '\\{k};')"
    return text


_LINE = f"replace({_escaped('role')}, chr(10), '\\{len(CONTROLS) + 1};')"

OP7 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<|turn|>' || {_LINE} || chr(10) || {_escaped("text")} || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""

OP9 = f"""WITH d AS (SELECT doc_id, {_words(_LOWER)} AS ws FROM documents),
    t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
    m AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
    f AS (SELECT w, ln(1 + (n - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM t, m GROUP BY w, n),
    i AS (SELECT doc_id, w, tf * {K1 + 1}e0 / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * len(ws) / mean)) AS impact FROM t JOIN d USING (doc_id), m),
    q AS (SELECT doc_id AS query_id, w, idf FROM t JOIN f USING (w) WHERE doc_id % 100 = 0),
    r AS (SELECT query_id, doc_id, round(sum(impact * idf), 9) AS score FROM q JOIN i USING (w) GROUP BY ALL)
    SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, score FROM r QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {"op2_substring_dedup": OP2, "op6_minhash": OP6, "op7_chat": OP7, "op9_topk": OP9}
