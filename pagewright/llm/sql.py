"""SQL that states what some of the operators' queries must return, written for DuckDB.

Other ways than the operators': all pairs instead of candidates, patterns with
one letter left out instead of a trie, levels of a recursive view instead of
blocks.
"""

from __future__ import annotations

from pagewright.llm.chat import CONTROL, END, START
from pagewright.llm.merkle import _LOWER, _UPPER


def _small(text: str) -> str:
    """A-Z lower-cased."""
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


# The table of the checksum crc32 (reflected polynomial EDB88320), and a step for each byte.
_CRC_TABLE = """
    SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc"""


def _crc(text: str) -> str:
    code = f"hex(encode({text}))"
    byte = f"list_transform(range(length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), "
            "lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)")


_SPACE = r"[^\x20\x09-\x0D]+"

_COMPONENTS = """
    linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP9 = f"""
    WITH RECURSIVE vectors AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    usable AS (
      SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND list_count(v) = len(v)
        AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
    links AS (
      SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id
      WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
    {_COMPONENTS},
    degree AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id,
           vec_id <= coalesce(m.b, vec_id) AS kept
    FROM vectors LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least m ON m.a = vec_id"""

OP10 = f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all({_small("coalesce(text, '')")}, '{_SPACE}') AS w FROM documents),
    sets AS (
      SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END)) AS s
      FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id),
    links AS (
      SELECT c.a, c.b FROM common c JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
      WHERE 100 * c.shared >= 85 * (p.n + q.n - c.shared)),
    {_COMPONENTS}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
           d.doc_id <= coalesce(m.b, d.doc_id) AS kept
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least m ON m.a = d.doc_id"""


def _escaped(text: str) -> str:
    for first in "<[":
        rests = "|".join("".join("\\" + c if c in "|[]" else c for c in rest) for lead, rest in CONTROL if lead == first)
        text = f"regexp_replace({text}, '\\{first}(\\\\*)({rests})', '{first}\\\\\\1\\2', 'g')" if first == "[" else (
            f"regexp_replace({text}, '<(\\\\*)({rests})', '<\\\\\\1\\2', 'g')")
    return text


_SAYS = "</s>[INST] ok [/INST]"
OP11 = f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_SAYS}' UNION ALL SELECT -7, 1, 'assistant', '{_SAYS}'),
    said AS (
      SELECT *, role = 'assistant' AS learns, {_escaped('text')} AS e,
             replace(replace({_escaped('role')}, '\\', '\\\\'), chr(10), '\\n') AS r FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(sum(CASE WHEN learns THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (learns), '')) AS loss_sha256,
           CAST(sum({len(START) + len(END) + 1} + length(r) + length(e)) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"


def _levels(name: str, rows: str) -> str:
    return f"""{name}(k, lv, i, h, n) AS (
      SELECT k, 0::BIGINT, i, h, n FROM {rows}
      UNION ALL
      SELECT k, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY k, lv, n, i // 16)"""


def _siblings(rows: str, nodes: str, shift: int) -> str:
    """Siblings left and right of the ancestors of ``rows(r, k, i)``."""
    own = "(x.i >> (4 * y.lv))"
    return f"""
      SELECT x.r, {shift} + y.lv AS s, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < {own}), '') AS a,
             coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > {own}), '') AS b
      FROM {rows} x JOIN {nodes} y ON x.k = y.k AND y.n > 1 AND y.i // 16 = {own} // 16 GROUP BY x.r, y.lv"""


OP12 = f"""
    WITH RECURSIVE codes AS ({_CRC_TABLE}),
    hashed AS (
      SELECT doc_id, coalesce('s' || source, '-') AS k, {_leaf('text')} AS h,
             CASE WHEN {_crc('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_small('text'))} END AS claim
      FROM documents, codes),
    leaves AS (
      SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
             count(*) OVER (PARTITION BY k) AS n FROM hashed),
    {_levels('nodes', 'leaves')},
    subroots AS (
      SELECT k AS source, '' AS k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
    {_levels('tops', 'subroots')},
    ways AS (SELECT l.r, '' AS k, s.i FROM leaves l JOIN subroots s ON s.source = l.k),
    steps AS (
      SELECT *, row_number() OVER (PARTITION BY r ORDER BY s) - 1 AS step FROM (
        {_siblings('leaves', 'nodes', 0)} UNION ALL {_siblings('ways', 'tops', 1000)})),
    proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY step)) AS proof, count(*) AS depth FROM steps GROUP BY r),
    climb(r, step, h) AS (
      SELECT r, 0::BIGINT, coalesce(claim, h) FROM leaves
      UNION ALL SELECT c.r, c.step + 1, sha256(t.a || c.h || t.b) FROM climb c JOIN steps t ON t.r = c.r AND t.step = c.step)
    SELECT l.doc_id, l.h AS leaf, u.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
           c.h AS folded_root, c.h = t.h AS verified
    FROM leaves l JOIN subroots u ON u.source = l.k JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.r = l.r
    JOIN climb c ON c.r = l.r AND c.step = coalesce(p.depth, 0)"""

OP13 = f"""
    WITH RECURSIVE codes AS ({_CRC_TABLE}),
    runs AS (
      SELECT doc_id, {_small('w')} AS w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
    slips AS (
      SELECT w, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM runs, codes WHERE length(w) >= 6),
    counted AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM slips),
    words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    letters AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
    masks AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS mask, substr(word, 1, i) || substr(word, i + 2) AS less FROM letters),
    near AS (
      SELECT a.word, b.word AS x, b.n FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM masks a JOIN words b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM masks a JOIN words b ON a.less = b.word),
    best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, x, n AS m FROM near
             QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, x) = 1),
    forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN x END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
      FROM words w LEFT JOIN best b ON b.word = w.word),
    follow(word, last_form, step) AS (
      SELECT word, word, 0 FROM forms
      UNION ALL SELECT f.word, g.form, step + 1 FROM follow f JOIN forms g ON g.word = f.last_form WHERE g.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n
    FROM forms JOIN (SELECT word, arg_max(last_form, step) AS root FROM follow GROUP BY word) USING (word)"""

ORACLE_SQL = {"op10_minhash_dedup": OP10, "op11_chat_format": OP11, "op12_merkle_manifest": OP12, "op13_spelling_forms": OP13, "op9_vector_dedup": OP9}
