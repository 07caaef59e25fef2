"""DuckDB SQL for the queries that SQL can express."""

from gradeloom.llm import mixing

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _moment() -> str:
    """First moment of a schedule, by the rank of the source, as nested cases over the segments."""
    cases = []
    for i, points in enumerate(mixing.SCHEDULES):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:])]
        total, before, inner = sum(areas), 0.0, []
        for k, (((t0, w0), (t1, w1)), area) in enumerate(zip(zip(points, points[1:]), areas)):
            w, s, b, d = w0 / total, (w1 - w0) / (t1 - t0) / total, before / total, area / total
            gap = f"greatest(share - {b!r}::double, 0)"
            at = f"least({t0!r}::double + 2 * {gap} / ({w!r}::double + sqrt({w * w!r}::double + 2 * {s!r}::double * {gap})), 1)"
            inner.append(f"WHEN share < {b + d!r} THEN {at}" if k < len(areas) - 1 else f"ELSE {at}")
            before += area
        body = f"CASE {' '.join(inner)} END" if len(inner) > 1 else inner[0].removeprefix("ELSE ")
        cases.append(f"WHEN rank % {len(mixing.SCHEDULES)} = {i} THEN {body}")
    return f"CASE {' '.join(cases)} END"


MIX = f"""
WITH sizes AS (SELECT doc_id, source, {WORDS}::bigint AS size FROM documents),
sources AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, (rank % 3 + 1)::double AS weight, source_size * 3 / (rank % 3 + 1)::double AS room FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY room, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
    / sum(weight) OVER (ORDER BY room, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT source, rank, source_size, CASE WHEN room <= level THEN source_size * 3.0::double
    ELSE max(level) FILTER (WHERE room > level) OVER () * weight END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws(':', '7', s.doc_id::varchar, s.size::varchar)),
      s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::bigint - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM placed),
counted AS (
  SELECT *, CASE WHEN size > 0 THEN whole + (whole < 3 AND start + size / 2 <= target - whole * source_size)::bigint
    ELSE 0 END AS copies, least((start + size / 2) / target, 1) AS share FROM passes)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies::int AS copies,
  CASE WHEN copies > 0 THEN round({_moment()}, 9) END AS first_position
FROM counted
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
sized AS (SELECT doc_id, s, len(s)::bigint AS n FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS shingle FROM sized),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * n_both >= 85 * (an + bn - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, other), doc_id) AS component_id,
  doc_id = coalesce(least(doc_id, other), doc_id) AS kept
FROM sized LEFT JOIN least ON doc_id = node
"""


HARD = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::bigint AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::int AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def _merkle(depth: int = 8) -> str:
    """Trees of up to 16 ** depth nodes, level by level; a run of siblings is one text, cut at a node's place."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    row = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    crc = """xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""leaves AS (
  SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(lower)} END AS changed FROM documents),
a0 AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS nodes FROM leaves),
w0 AS (SELECT *, coalesce(changed, leaf) AS own, '' AS proof FROM a0)"""
    ]

    def climb(t: str, path: str, tree: str) -> str:
        for k in range(depth):
            steps.append(f"""{t}r{k} AS (
  SELECT {tree}, place // 16 AS place, any_value(nodes) AS nodes, string_agg(digest, '' ORDER BY place) AS run
  FROM {t}{k} WHERE nodes > 1 GROUP BY {tree}, place // 16),
{t}{k + 1} AS (
  SELECT {tree}, place, (nodes + 15) // 16 AS nodes, sha256(run) AS digest FROM {t}r{k}
  UNION ALL SELECT {tree}, place, nodes, digest FROM {t}{k} WHERE nodes = 1),
{path}{k + 1} AS (
  SELECT p.* EXCLUDE (place, own, proof), p.place // 16 AS place,
    CASE WHEN run IS NULL THEN own ELSE sha256(substr(run, 1, 64 * (p.place % 16)) || own ||
      substr(run, 64 * (p.place % 16) + 65)) END AS own,
    CASE WHEN run IS NULL THEN proof ELSE proof || substr(run, 1, 64 * (p.place % 16)) ||
      substr(run, 64 * (p.place % 16) + 65) END AS proof
  FROM {path}{k} p LEFT JOIN {t}r{k} r ON p.{tree} IS NOT DISTINCT FROM r.{tree} AND p.place // 16 = r.place)""")
        return f"{t}{depth}"

    tops = climb("a", "w", "source")
    steps.append(f"""b0 AS (
  SELECT source, 0 AS tree, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS nodes
  FROM {tops}),
v0 AS (
  SELECT doc_id, leaf, 0 AS tree, b0.digest AS subroot, own, proof, b0.place AS place
  FROM w{depth} w JOIN b0 ON w.source IS NOT DISTINCT FROM b0.source)""")
    root = climb("b", "v", "tree")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, b.digest AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = b.digest AS verified
FROM v{depth}, {root} b"""


ORACLES = {"op13_hard_negatives": HARD, "op11_merkle_manifest": _merkle(), "op2_near_duplicates": NEAR, "op3_mix_sources": MIX}
