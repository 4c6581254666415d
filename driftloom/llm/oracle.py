"""DuckDB SQL with the results of those queries that SQL can express over whole tables."""

OP5 = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE NULL END AS rest FROM pages),
p AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS rawhost FROM u),
q AS (SELECT page_id, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(substr(rest, length(rawhost) + 1), '^[^?#]*'), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')) t(verdict, rhost, rpath)),
m AS (SELECT q.page_id, q.host, q.path, r.rhost || r.rpath AS rule, r.verdict,
  row_number() OVER (PARTITION BY q.page_id, q.host, q.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM q JOIN r ON (q.host = r.rhost OR q.host LIKE '%.' || r.rhost) AND starts_with(q.path, r.rpath))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM q LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON q.page_id = m.page_id AND q.host = m.host AND q.path = m.path
"""

OP6 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM n WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5.0, 2.0, 1.0][CAST((n - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS ceiling FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, ceiling / weight) AS water FROM l WHERE level * weight <= ceiling),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN ceiling ELSE least(ceiling, water * weight) END AS target,
  CASE WHEN source_size > 0 THEN (CASE WHEN water IS NULL THEN ceiling ELSE least(ceiling, water * weight) END) / source_size ELSE 0.0 END AS ratio,
  (floor(CAST('0x' || substr(md5('mix/offset|' || coalesce(source, '')), 1, 3) AS INT) / 4096.0::DOUBLE * 1024) + 0.5) / 1024.0::DOUBLE AS u FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.ratio, t.u,
  row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(d.size + 1.0::DOUBLE) * 4), CAST('0x' || substr(md5('mix|' || CAST(d.doc_id AS VARCHAR)), 1, 2) AS INT), d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(k * ratio + u) - floor((k - 1) * ratio + u) AS BIGINT) * size AS taken FROM r
"""


OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit,
  [CAST('0x' || substr(h, 1, 8) AS BIGINT), CAST('0x' || substr(h, 9, 8) AS BIGINT), CAST('0x' || substr(h, 17, 8) AS BIGINT), CAST('0x' || substr(h, 25, 8) AS BIGINT)] AS r FROM d),
k AS (SELECT doc_id, text, unit, CAST(len(unit) AS BIGINT) AS n, least(r[1] % (len(unit) + 1), r[2] % (len(unit) + 1)) AS lo, greatest(r[1] % (len(unit) + 1), r[2] % (len(unit) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(unit[1:lo], '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(unit[lo + 1:hi], '') END AS middle, CASE WHEN form <> 'plain' THEN array_to_string(unit[hi + 1:n], '') END AS suffix FROM k)
SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def merkle_sql(within: int = 8, across: int = 4) -> str:
    """The tree level by level: ``within`` levels hold 8**within rows of a language, ``across`` levels 8**across languages."""
    field = lambda x: f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    ctes = [
        # CRC-32 of the id's digits, bit by bit
        "c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(x) AS BIGINT) for x in string_split(CAST(doc_id AS VARCHAR), '')]),"
        " lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y // 2, 3988292384 * (y % 2))))) % 3 = 0 AS bad FROM documents)",
        f"""l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS leaf,
  CASE WHEN bad THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS other FROM c)""",
        "a0 AS (SELECT doc_id, g, leaf, other AS fold, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total, '' AS proof FROM l)",
        "n0 AS (SELECT g, place, total, leaf AS node FROM a0)",
    ]

    def climb(k: int) -> None:
        """Level k of all trees: runs of eight nodes, and each row's fold and proof one level up. A finished tree stays as it is."""
        run = f"SELECT g, place // 8 AS place, (any_value(total) + 7) // 8 AS total, list(node ORDER BY place) AS kids FROM n{k} WHERE total > 1 GROUP BY g, place // 8"
        ctes.append(f"r{k + 1} AS ({run})")
        ctes.append(f"n{k + 1} AS (SELECT g, place, total, sha256(array_to_string(kids, '')) AS node FROM r{k + 1} UNION ALL SELECT g, place, total, node FROM n{k} WHERE total = 1)")
        here = f"CAST(a{k}.place % 8 AS INT)"
        ctes.append(
            f"a{k + 1} AS (SELECT doc_id, a{k}.g, leaf, CASE WHEN kids IS NULL THEN fold ELSE sha256(array_to_string(kids[1:{here}], '') || fold || array_to_string(kids[{here} + 2:8], '')) END AS fold,"
            f" a{k}.place // 8 AS place, coalesce(r{k + 1}.total, 1) AS total, proof || coalesce(array_to_string(kids[1:{here}], '') || array_to_string(kids[{here} + 2:8], ''), '') AS proof"
            f" FROM a{k} LEFT JOIN r{k + 1} ON a{k}.g = r{k + 1}.g AND a{k}.place // 8 = r{k + 1}.place)"
        )

    for k in range(within):
        climb(k)
    w = within + 1
    ctes.append(f"n{w} AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total, node, g AS name FROM n{within})")
    ctes.append(f"a{w} AS (SELECT doc_id, n{w}.g, leaf, fold, n{w}.place, n{w}.total, proof FROM a{within} JOIN n{w} ON a{within}.g = n{w}.name)")
    for k in range(w, w + across):
        climb(k)
    e = w + across
    ctes.append(f"s AS (SELECT doc_id, leaf, g FROM a0), o AS (SELECT l.doc_id, l.leaf, n{w}.node AS subroot FROM l JOIN n{w} ON l.g = n{w}.name)")
    text = f"SELECT a{e}.doc_id, a{e}.leaf, o.subroot, n{e}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n{e}.node AS verified FROM a{e} JOIN o ON a{e}.doc_id = o.doc_id AND a{e}.leaf = o.leaf, n{e}"
    return "WITH " + ",\n".join(ctes) + "\n" + text


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5, "op6_exact_dedup": OP6, "op8_mixing": OP8, "op11_fill_in_middle": OP11, "op13_merkle": merkle_sql()}
