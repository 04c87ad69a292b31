"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {bits}), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (grp, pos, h, n)."""
    return f"""{name} AS (
        SELECT 0 AS k, grp, pos, h, n FROM {leaves}
        UNION ALL
        SELECT k + 1, grp, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY k, grp, pos // 2
    )"""


def _climb(name: str, starts: str, tree: str) -> str:
    """From each of ``starts`` (id, grp, pos, h, folded, proof) to the top: siblings and the folded value."""
    return f"""{name} AS (
        SELECT 0 AS k, id, grp, pos, h, folded, proof FROM {starts}
        UNION ALL
        SELECT c.k + 1, c.id, c.grp, c.pos // 2, p.h,
            sha256(CASE WHEN c.pos % 2 = 1 THEN coalesce(s.h, '') || c.folded ELSE c.folded || coalesce(s.h, '') END),
            c.proof || coalesce(s.h, '')
        FROM {name} c JOIN {tree} p ON p.grp = c.grp AND p.k = c.k + 1 AND p.pos = c.pos // 2
        LEFT JOIN {tree} s ON s.grp = c.grp AND s.k = c.k AND s.pos = xor(c.pos, 1)
    )"""


def _merkle() -> str:
    row = lambda n: " || ".join(_field(v) for v in ("doc_id::varchar", "source", "lang", n, "text"))
    top = lambda tree: f"(SELECT grp, h FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k DESC) AS r FROM {tree}) WHERE r = 1)"
    return f"""WITH RECURSIVE hashed AS (
        SELECT doc_id, lang, sha256({row('n_chars::varchar')}) AS h,
            CASE WHEN {_crc32('doc_id::varchar')} % 7 = 0 THEN sha256({row('(n_chars + 1)::varchar')}) END AS forged
        FROM documents
    ), leaves AS (
        SELECT *, coalesce('s' || lang, 'n') AS grp, count(*) OVER (PARTITION BY lang) AS n,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
            row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, h) AS id
        FROM hashed
    ), {_tree('nodes', 'leaves')}, tops AS (
        SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM {top('nodes')}
    ), {_tree('upper', 'tops')}, starts AS (
        SELECT id, grp, pos, h, coalesce(forged, h) AS folded, '' AS proof FROM leaves
    ), {_climb('inner_climb', 'starts', 'nodes')}, halfway AS (
        SELECT c.id, t.grp, t.pos, c.h, c.folded, c.proof
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS r FROM inner_climb) c JOIN tops t ON t.name = c.grp WHERE c.r = 1
    ), {_climb('outer_climb', 'halfway', 'upper')}, ends AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS r FROM outer_climb) WHERE r = 1
    )
    SELECT l.doc_id, l.h AS leaf, w.h AS subroot, e.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = e.h AS verified
    FROM leaves l JOIN halfway w ON w.id = l.id JOIN ends e ON e.id = l.id"""


def _phrases() -> str:
    return r"""WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), split AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
    ), occurrences AS (
        SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, range(1, 5) AS sizes(k)
    ), counts AS MATERIALIZED (
        SELECT lang, phrase, string_split(phrase, ' ') AS p, len(string_split(phrase, ' ')) AS k, f
        FROM (SELECT lang, phrase, count(*) AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 30)
    ), totals AS (
        SELECT lang, sum(len(w))::bigint AS n FROM split GROUP BY lang
    ), candidates AS (
        SELECT lang, k, phrase, p, f AS a FROM counts WHERE k > 1
    ), cuts AS (
        SELECT c.lang, c.phrase, c.a, i.cut, l.f AS l, r.f AS r, (2000000::hugeint * c.a) // (l.f + r.f) AS score
        FROM candidates c, range(1, 4) AS i(cut), counts l, counts r
        WHERE i.cut < c.k AND l.lang = c.lang AND l.k = i.cut AND l.phrase = array_to_string(c.p[1:i.cut], ' ')
            AND r.lang = c.lang AND r.k = c.k - i.cut AND r.phrase = array_to_string(c.p[i.cut + 1:c.k], ' ')
    ), lowest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts) WHERE place = 1
    ), inside AS (
        SELECT c.lang, array_to_string(c.p[b.at_word:b.at_word + s.size - 1], ' ') AS phrase, max(c.a) AS longer
        FROM candidates c, range(2, 4) AS s(size), range(1, 4) AS b(at_word) WHERE s.size < c.k AND b.at_word + s.size - 1 <= c.k GROUP BY ALL
    ), ranked AS (
        SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score::bigint AS score
        FROM lowest c JOIN totals t ON t.lang = c.lang LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
        WHERE i.longer IS NULL OR 100::hugeint * i.longer < 80::hugeint * c.a
    )
    SELECT * FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrases": _phrases(), "op13_merkle": _merkle()}
