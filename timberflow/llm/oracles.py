"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: Levels of eight that the statement of the manifest spells out for leaves and for languages: 8^7 rows and 8^3 languages.
LEAF_LEVELS, GROUP_LEVELS = 7, 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The 256 remainders of the CRC-32 polynomial 0xEDB88320, by eight halvings of each byte.
_CRC_TABLE = "crc0 AS (SELECT range AS i, range::BIGINT AS c FROM range(256)), " + ", ".join(
    f"crc{k + 1} AS (SELECT i, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM crc{k})" for k in range(8)
)
_CRC_TABLE += ", crcs AS (SELECT list(c ORDER BY i) AS crc_table FROM crc8)"


def _crc(byte_list: str) -> str:
    """CRC-32 of a list of byte values, where ``crc_table`` is at hand."""
    return f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda acc, b: xor(acc >> 8, crc_table[(xor(acc, b) & 255) + 1])), 4294967295)"


def _tree(name: str, levels: int) -> str:
    """Levels ``<name>0`` (given) upwards, siblings ``<name>s<k>`` and roots ``<name>_top``."""
    parts = []
    for k in range(levels):
        parts.append(f"{name}m{k} AS (SELECT grp FROM {name}{k} GROUP BY grp HAVING count(*) > 1)")
        parts.append(f"{name}{k + 1} AS (SELECT grp, r // 8 AS r, sha256(string_agg(d, '' ORDER BY r)) AS d FROM {name}{k} SEMI JOIN {name}m{k} USING (grp) GROUP BY grp, r // 8)")
        parts.append(
            f"{name}s{k} AS (SELECT a.grp, a.r, coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS lft, "
            f"coalesce(string_agg(b.d, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS rgt "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.grp = b.grp AND a.r // 8 = b.r // 8 WHERE a.grp IN (SELECT grp FROM {name}m{k}) GROUP BY a.grp, a.r)"
        )
    every = " UNION ALL ".join(f"SELECT grp, r, d, {k} AS k FROM {name}{k}" for k in range(levels + 1))
    parts.append(f"{name}_top AS (SELECT grp, arg_max(d, k) AS d FROM ({every}) GROUP BY grp)")
    return ", ".join(parts)


def _climb(start: str, name: str, levels: int, group: str, rank: str) -> str:
    """``<start>0`` (given, with ``folded`` and ``proof``) carried through all levels of a tree."""
    parts = []
    for k in range(levels):
        parts.append(
            f"{start}{k + 1} AS (SELECT f.* EXCLUDE (folded, proof), CASE WHEN s.grp IS NULL THEN folded ELSE sha256(lft || folded || rgt) END AS folded, "
            f"proof || coalesce(lft || rgt, '') AS proof FROM {start}{k} f LEFT JOIN {name}s{k} s ON f.{group} = s.grp AND f.{rank} // {8**k} = s.r)"
        )
    return ", ".join(parts)


def merkle() -> str:
    field = lambda name: f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([field(n) for n in ("doc_id", "source", "lang", "n_chars")] + [text]) + ")"
    lowered = field(f"translate(text, '{_UPPER}', '{_LOWER}')")
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"
    return f"""
    WITH {_CRC_TABLE},
    leaves AS (
        SELECT coalesce('=' || lang, '') AS grp, doc_id, {leaf(field("text"))} AS leaf,
               CASE WHEN {_crc(digits)} % 3 = 0 THEN {leaf(lowered)} END AS presented
        FROM documents, crcs),
    placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
    n0 AS (SELECT grp, rank AS r, leaf AS d FROM placed),
    {_tree("n", LEAF_LEVELS)},
    heads AS (SELECT '' AS all_, grp AS member, d AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM n_top),
    g0 AS (SELECT all_ AS grp, place AS r, subroot AS d FROM heads),
    {_tree("g", GROUP_LEVELS)},
    f0 AS (SELECT p.*, h.subroot, h.place, h.all_, coalesce(presented, leaf) AS folded, '' AS proof FROM placed p JOIN heads h ON p.grp = h.member),
    {_climb("f", "n", LEAF_LEVELS, "grp", "rank")},
    u0 AS (SELECT * FROM f{LEAF_LEVELS}),
    {_climb("u", "g", GROUP_LEVELS, "all_", "place")}
    SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified
    FROM u{GROUP_LEVELS} u JOIN g_top t ON u.all_ = t.grp
    """


def spelling() -> str:
    letters = r"[a-z\x{00C0}-\x{00FF}]+"
    utf8 = (
        "list_transform(range(0, strlen({0}) * 2, 2), lambda i: (CASE WHEN substr(hex(encode({0})), i + 1, 1) <= '9' THEN ord(substr(hex(encode({0})), i + 1, 1)) - 48 "
        "ELSE ord(substr(hex(encode({0})), i + 1, 1)) - 55 END * 16 + CASE WHEN substr(hex(encode({0})), i + 2, 1) <= '9' THEN ord(substr(hex(encode({0})), i + 2, 1)) - 48 "
        "ELSE ord(substr(hex(encode({0})), i + 2, 1)) - 55 END)::BIGINT)"
    ).format("(doc_id::VARCHAR || ':' || run)")
    return rf"""
    WITH {_CRC_TABLE},
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{letters}')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
    hashed AS (SELECT run, n, {_crc(utf8)} AS h FROM counted, crcs),
    typed AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cuts AS (
        SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
    pairs AS (
        SELECT x.word AS word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT x.word, w.word, w.n FROM cuts x JOIN words w ON x.a || x.b = w.word
        UNION SELECT w.word, x.word, x.n FROM cuts x JOIN words w ON x.a || x.b = w.word),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
    top AS (SELECT b.word, b.n_near, b.m, min(p.other) AS other FROM best b JOIN pairs p ON p.word = b.word AND p.m = b.m GROUP BY ALL),
    formed AS (
        SELECT w.word, w.n, coalesce(t.n_near, 0)::BIGINT AS n_near, CASE WHEN t.m >= 2 * w.n THEN t.other END AS form,
               CASE WHEN t.m >= 2 * w.n THEN t.m END AS form_n
        FROM words w LEFT JOIN top t USING (word)),
    walk AS (
        WITH RECURSIVE w(word, stop) AS (
            SELECT word, word FROM formed
            UNION ALL SELECT w.word, f.form FROM w JOIN formed f ON f.word = w.stop WHERE f.form IS NOT NULL)
        SELECT * FROM w)
    SELECT f.word, f.form, k.stop AS root, f.n, f.n_near, f.form_n
    FROM formed f JOIN walk k USING (word) JOIN formed e ON e.word = k.stop AND e.form IS NULL
    """
