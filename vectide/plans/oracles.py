"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from ..functions.alignment import BLOSUM62_LETTERS, BLOSUM62_ROWS
from ..operators.checks import RESIDUES

_KEEP = RESIDUES + RESIDUES.lower()

_UNITS = """
lengths AS (
  SELECT vec_id AS ord, label, embedding::DOUBLE[] AS raw,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS len
  FROM embeddings),
u AS (SELECT ord, label, list_transform(raw, lambda x: x / len) AS e FROM lengths)"""

_PAIRS = """
pairs AS (
  SELECT a.ord AS i, b.ord AS j, list_dot_product(a.e, b.e) AS cs
  FROM u a JOIN u b ON a.ord < b.ord)"""

_COUNTS = """
counts AS (
  SELECT n_name AS sample_id, l_partkey % (SELECT count(*) FROM embeddings) AS protein_id,
         sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

_SAMPLES = """
samples AS (
  SELECT n_name AS sample_id, n_nationkey::BIGINT AS ord, r_name AS grp
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _weights(value: str = "value", source: str = "counts", name: str = "w") -> str:
    return f"""
{name} AS (
  SELECT sample_id, protein_id, {value} / sum({value}) OVER (PARTITION BY sample_id) AS weight
  FROM {source} WHERE value > 0)"""


def _kept(weights: str = "w", name: str = "kept") -> str:
    return f"""
{name} AS (SELECT * FROM u WHERE ord IN (SELECT protein_id FROM {weights}))"""


_ALL_KEPT = """
apart AS (
  SELECT a.ord AS i, b.ord AS j, list_dot_product(a.e, b.e) AS cs
  FROM kept a JOIN kept b ON a.ord < b.ord),
sig AS (SELECT median(sqrt(greatest(2 - 2 * cs, 0))) AS sigma FROM apart)"""


def _mmd(sigma: str, weights: str = "w", kept: str = "kept", p: str = "") -> str:
    """CTEs ending in {p}dist(sa, sb, d) over sample orders sa < sb."""
    return f"""
{p}kernel AS (
  SELECT a.ord AS i, b.ord AS j,
         CASE WHEN a.ord = b.ord THEN 1.0
              ELSE exp(-(1 - list_dot_product(a.e, b.e)) / ({sigma} * {sigma})) END AS k
  FROM {kept} a CROSS JOIN {kept} b),
{p}pk AS (
  SELECT x.sample_id, j, sum(weight * k) AS pk
  FROM {weights} x JOIN {p}kernel ON x.protein_id = i GROUP BY ALL),
{p}gram AS (
  SELECT sa.ord AS sa, sb.ord AS sb, sum(pk * y.weight) AS g
  FROM {p}pk JOIN {weights} y ON {p}pk.j = y.protein_id
  JOIN samples sa ON sa.sample_id = {p}pk.sample_id
  JOIN samples sb ON sb.sample_id = y.sample_id
  WHERE sa.ord <= sb.ord GROUP BY ALL),
{p}dist AS (
  SELECT g.sa, g.sb, sqrt(greatest(a.g + b.g - 2 * g.g, 0)) AS d
  FROM {p}gram g JOIN {p}gram a ON a.sa = g.sa AND a.sb = g.sa
  JOIN {p}gram b ON b.sa = g.sb AND b.sb = g.sb WHERE g.sa < g.sb)"""


def _named(dist: str = "dist", extra: str = "") -> str:
    return f"""
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(d, 6) + 0.0 AS distance{extra}
FROM {dist} JOIN samples a ON a.ord = sa JOIN samples b ON b.ord = sb"""


def _reach(nodes: str, links: str, name: str = "parts") -> str:
    """CTEs ending in {name}(node, component) by transitive closure."""
    return f"""
{name}_sym AS (SELECT i AS a, j AS b FROM {links} UNION SELECT j, i FROM {links}),
{name}_reach AS (
  SELECT {nodes}.ord AS node, {nodes}.ord AS root FROM {nodes}
  UNION SELECT r.node, s.b FROM {name}_reach r JOIN {name}_sym s ON s.a = r.root),
{name} AS (SELECT node, min(root) AS component FROM {name}_reach GROUP BY node)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts)


_PERMUTED = """
base AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS place FROM samples),
drawn AS MATERIALIZED (
  SELECT perm, ord, row_number() OVER (
    PARTITION BY perm ORDER BY md5('1-' || perm || '-' || sample_id), sample_id) AS place
  FROM samples, range(1, 1000) AS p(perm))"""

_CENTROIDS = """
both_ AS (SELECT sa, sb, d * d AS d2 FROM dist UNION ALL SELECT sb, sa, d * d FROM dist),
sizes AS (SELECT grp, count(*) AS n FROM samples GROUP BY grp),
mine AS (
  SELECT a.grp, a.ord, sum(CASE WHEN b.grp = a.grp THEN d2 ELSE 0 END) AS s
  FROM both_ JOIN samples a ON a.ord = sa JOIN samples b ON b.ord = sb GROUP BY ALL),
own AS (SELECT grp, sum(s) / 2 AS t FROM mine GROUP BY grp),
spreads AS MATERIALIZED (
  SELECT ord, grp, n, sqrt(abs(s / n - t / (n * n))) AS spread
  FROM mine JOIN own USING (grp) JOIN sizes USING (grp))"""


# past what the six places shown need to settle
_MEDIAN_ROUNDS = 120


def _medians(rounds: int) -> str:
    """Reweighting towards the spatial median, a fixed number of rounds."""
    steps = ["""
inside AS MATERIALIZED (
  SELECT sa, sb, d * d AS d2 FROM dist JOIN samples a ON a.ord = sa JOIN samples b ON b.ord = sb
  WHERE a.grp = b.grp),
near AS MATERIALIZED (SELECT sa, sb, d2 FROM inside UNION ALL SELECT sb, sa, d2 FROM inside),
w0 AS MATERIALIZED (SELECT ord, grp, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS w FROM samples)"""]
    for k in range(rounds):
        steps.append(f"""
s{k} AS MATERIALIZED (
  SELECT ord, grp, sqrt(abs(c - sum(w * c) OVER (PARTITION BY grp) / 2)) AS spread FROM (
    SELECT a.ord, a.grp, a.w, coalesce(sum(b.w * d2), 0) AS c
    FROM w{k} a LEFT JOIN near ON sa = a.ord LEFT JOIN w{k} b ON b.ord = sb GROUP BY ALL)),
w{k + 1} AS MATERIALIZED (
  SELECT ord, grp, 1 / greatest(spread, 1e-12) / sum(1 / greatest(spread, 1e-12)) OVER (PARTITION BY grp) AS w
  FROM s{k})""")
    return ",".join(steps)


_EDGES = "\nedges AS (SELECT i, j, greatest(least(cs, 1), 0) AS weight FROM pairs WHERE cs >= 0.35)"
_LINKS = "\nlinks AS (SELECT i, j, greatest(least(cs, 1), 0) AS weight FROM pairs WHERE cs >= 0.3)"

# dense Markov clustering as a recursive join, run past convergence
_MCL_STEPS = 60


def _mcl(inflation: float) -> str:
    return f"""
half AS (SELECT i, j, weight FROM edges UNION ALL SELECT j, i, weight FROM edges),
looped AS (SELECT * FROM half UNION ALL SELECT j, j, max(weight) FROM half GROUP BY j),
flow(it, i, j, v) AS (
  SELECT 0, i, j, weight / sum(weight) OVER (PARTITION BY j) FROM looped
  UNION ALL
  SELECT it, i, j, v / sum(v) OVER (PARTITION BY j) FROM (
    SELECT a.it + 1 AS it, a.i, b.j, pow(sum(a.v * b.v), {inflation}) AS v
    FROM flow a JOIN flow b ON a.j = b.i
    WHERE a.it < {_MCL_STEPS} AND a.v > 0 AND b.v > 0
    GROUP BY a.it, a.i, b.j) WHERE v > 0),
lead AS (
  SELECT j, i FROM flow WHERE it = {_MCL_STEPS}
  QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(v, 9) DESC, i) = 1),
steps AS (SELECT i, j FROM lead WHERE i <> j),""" + _reach(
        "u", "steps", "clusters"
    ).lstrip("\n")


_PARTITION = "\nSELECT node, component AS cluster FROM clusters"

_SEQS = f"""
seqs AS (
  SELECT doc_id AS protein_id, upper(regexp_replace(text, '[^{_KEEP}]', '', 'g')) AS s
  FROM documents),
texts AS (SELECT * FROM seqs WHERE s <> '')"""

_MATRIX = ", ".join(
    f"('{a}', '{b}', {v})"
    for a, row in zip(BLOSUM62_LETTERS, BLOSUM62_ROWS.strip().splitlines())
    for b, v in zip(BLOSUM62_LETTERS, row.split())
)

# one matrix row per step; gaps along the row by a running maximum
def _scores(gated: bool = False) -> str:
    """Scores of pairs of passages: all of them, or those with a vector and cosine >= 0."""
    if gated:
        catalog = """
catalog AS (SELECT ord, translate(s, 'UO', 'XX') AS s, length(s) AS len FROM passages WHERE s <> ''),
todo AS (
  SELECT a.ord AS i, b.ord AS j, a.s AS q, b.s AS t, a.len AS len_i, b.len AS len_j
  FROM catalog a JOIN catalog b ON a.ord < b.ord),"""
    else:
        catalog = """
catalog AS (
  SELECT p.ord, translate(s, 'UO', 'XX') AS s, length(s) AS len, e
  FROM passages p JOIN u USING (ord)),
todo AS (
  SELECT a.ord AS i, b.ord AS j, a.s AS q, b.s AS t, a.len AS len_i, b.len AS len_j,
         list_dot_product(a.e, b.e) AS cs
  FROM catalog a JOIN catalog b ON a.ord < b.ord WHERE list_dot_product(a.e, b.e) >= 0),"""
    return f"""
blosum(a, b, s) AS (VALUES {_MATRIX}),
passages AS (
  SELECT item_id AS ord, upper(regexp_replace(text, '[^{_KEEP}]', '', 'g')) AS s
  FROM benchmark),{catalog}
columns AS (
  SELECT i, j, q, len_i, c, substr(t, c, 1) AS letter
  FROM todo, generate_series(1, len_j) g(c)),
sub AS (
  SELECT b, list(s ORDER BY a) AS by_row FROM blosum GROUP BY b),
letters AS (SELECT string_agg(DISTINCT a, '' ORDER BY a) AS all_rows FROM blosum),
dp(r, i, j, q, len_i, c, by_row, h, f, best) AS (
  SELECT 0, i, j, q, len_i, c, by_row, 0, -100, 0
  FROM columns JOIN sub ON sub.b = letter
  UNION ALL
  SELECT r, i, j, q, len_i, c, by_row, greatest(m, e), f,
         greatest(best, m, e)
  FROM (
    SELECT *, coalesce(max(m + c) OVER (
        PARTITION BY i, j ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        - c - 11, -100) AS e
    FROM (
      SELECT *, greatest(0, f, before + by_row[
          strpos((SELECT all_rows FROM letters), substr(q, r, 1))]) AS m
      FROM (
        SELECT r + 1 AS r, i, j, q, len_i, c, by_row, best,
               greatest(f - 1, h - 12) AS f,
               coalesce(lag(h) OVER (PARTITION BY i, j ORDER BY c), 0) AS before
        FROM dp WHERE r < len_i)))),
scores AS (
  SELECT i, j, max(best) AS score FROM dp WHERE r = len_i GROUP BY i, j)"""


_SCORES = _scores()


_TWO = """
two AS (
  SELECT sample_id, CASE WHEN grp IN ('ASIA', 'EUROPE') THEN 'A' ELSE 'B' END AS grp
  FROM samples)"""

_CLR = """
logged AS (SELECT sample_id, protein_id AS feature, log2(value + 1) AS l FROM counts),
base AS (
  SELECT sample_id,
         0 - sum(l) / (SELECT count(DISTINCT feature) FROM logged) AS baseline
  FROM logged GROUP BY sample_id)"""

# t tail for an odd number of degrees of freedom: its finite cosine series
_OLS = """
grid AS (
  SELECT f.feature, b.sample_id, two.grp = 'A' AS hit,
         coalesce(l.l, 0) + b.baseline AS y
  FROM (SELECT DISTINCT feature FROM logged) f CROSS JOIN base b JOIN two USING (sample_id)
  LEFT JOIN logged l ON l.feature = f.feature AND l.sample_id = b.sample_id),
means AS (
  SELECT feature, hit, avg(y) AS m, count(*) AS n,
         sum(y * y) - count(*) * avg(y) * avg(y) AS rss
  FROM grid GROUP BY feature, hit),
fit AS (
  SELECT feature, max(m) FILTER (hit) - max(m) FILTER (NOT hit) AS lfc,
         sum(n) - 2 AS df,
         sqrt(sum(rss) / (sum(n) - 2) * sum(1.0 / n)) AS se
  FROM means GROUP BY feature),
tested AS (SELECT feature, lfc, lfc / se AS t, df::DOUBLE AS df FROM fit),
coef(k, c) AS (
  SELECT 1, 1.0::DOUBLE UNION ALL SELECT k + 1, c * (2 * k) / (2 * k + 1) FROM coef WHERE k < 200),
angle AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM tested),
tail AS (
  SELECT feature, lfc, t, df,
         1 - 2 / pi() * (th + sin(th) * (
           SELECT sum(c * pow(cos(th), 2 * k - 1)) FROM coef WHERE 2 * k - 1 <= df - 2)) AS p
  FROM angle)"""

_CENTRED = """
square AS (
  SELECT sa, sb, d * d AS d2 FROM dist UNION ALL SELECT sb, sa, d * d FROM dist
  UNION ALL SELECT ord, ord, 0 FROM samples),
rows_ AS (SELECT sa, avg(d2) AS m FROM square GROUP BY sa),
cells AS (
  SELECT s.sa, s.sb, -0.5 * (s.d2 - a.m - b.m + (SELECT avg(d2) FROM square)) AS b
  FROM square s JOIN rows_ a ON a.sa = s.sa JOIN rows_ b ON b.sa = s.sb)"""

_MMD1 = (_UNITS, _COUNTS, _SAMPLES, _weights(), _kept(), _mmd("1.0"))

_BINS = """
homes AS (
  SELECT c.node, c.component AS cluster, p.component FROM clusters c JOIN parts p USING (node)),
ranked AS (
  SELECT cluster, n, row_number() OVER (ORDER BY n DESC, component, cluster) AS rank
  FROM (SELECT cluster, min(component) AS component, count(*) AS n FROM homes GROUP BY cluster)),
inside AS (
  SELECT h.i AS node, h.weight FROM half h JOIN homes a ON a.node = h.i
  JOIN homes b ON b.node = h.j WHERE a.cluster = b.cluster),
score AS (
  SELECT cluster, homes.node, round(coalesce(sum(weight), 0), 9) AS s
  FROM homes LEFT JOIN inside USING (node) GROUP BY ALL),
medoid AS (
  SELECT cluster, node FROM score
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, node) = 1)"""

ORACLES: dict[str, str] = {
    "vec_normalize": _with(_UNITS)
    + """
SELECT ord AS protein_id, (d - 1)::INTEGER AS dim, round(e[d], 6) + 0.0 AS v
FROM u, generate_series(1, len(e)) g(d)""",
    "cosine_pairs": _with(_UNITS, _PAIRS, _LINKS)
    + "\nSELECT i, j, round(weight, 6) AS cosine FROM links",
    "cosine_clip": _with(_UNITS, _PAIRS)
    + """
SELECT protein_id, count(*) FILTER (cs > 0) AS degree, round(sum(greatest(least(cs, 1), 0)), 6) AS strength
FROM (SELECT i AS protein_id, cs FROM pairs UNION ALL SELECT j, cs FROM pairs)
GROUP BY protein_id""",
    "gaussian_kernel": _with(_UNITS)
    + """
SELECT a.ord AS protein_id, round(sum(exp(-(1 - list_dot_product(a.e, b.e)))), 6) AS density
FROM u a CROSS JOIN u b GROUP BY a.ord""",
    "kernel_pairs": _with(_UNITS, _PAIRS, _LINKS)
    + """
SELECT i, j, round(sqrt(greatest(2 - 2 * weight, 0)), 6) AS distance,
       round(exp(-(1 - weight)), 6) AS kernel FROM links""",
    "sequence_clean": _with(_SEQS)
    + """
SELECT protein_id, s AS sequence, length(s)::INTEGER AS residues FROM texts""",
    "sequence_remap": _with(_SEQS)
    + """
SELECT protein_id, replace(replace(s, 'U', 'X'), 'O', 'X') AS aligned,
       regexp_replace(s, '[UZOB]', 'X', 'g') AS modelled FROM texts""",
    "elided_names": """
SELECT page_id, CASE WHEN length(url) <= 25 THEN url
  ELSE substr(url, 1, 12) || '…' || right(url, 11) END AS label FROM pages""",
    "duplicate_ids": """
SELECT conv_id AS id, count(*) AS times FROM conversations GROUP BY conv_id HAVING count(*) > 1""",
    "invalid_sequences": f"""
SELECT doc_id, s = '' AS is_empty, regexp_matches(s, '[^{RESIDUES}]') AS has_symbols
FROM (SELECT doc_id, upper(regexp_replace(text, '\\*\\z', '')) AS s FROM documents)""",
    "bad_counts": """
SELECT c_mktsegment AS sample_id, c_custkey AS protein_id, c_acctbal AS value
FROM customer WHERE c_acctbal < 0 OR c_acctbal IS NULL""",
    "missing_vectors": """
SELECT DISTINCT l_partkey AS protein_id FROM lineitem
WHERE l_partkey NOT IN (SELECT vec_id FROM embeddings)""",
    "empty_samples": """
SELECT c_custkey AS sample_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey
HAVING coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 0) = 0""",
    "relative_abundance": _with(_COUNTS, _weights())
    + "\nSELECT sample_id, protein_id, round(weight, 9) AS weight FROM w",
    "presence_absence": _with(_COUNTS, _weights("sign(value)"))
    + "\nSELECT sample_id, protein_id, round(weight, 9) AS weight FROM w",
    "retained_proteins": _with(_COUNTS)
    + "\nSELECT DISTINCT protein_id FROM counts WHERE value > 0",
    "median_sigma": _with(_UNITS, _COUNTS, _weights(), _kept(), _ALL_KEPT)
    + "\nSELECT round(sigma, 6) AS sigma FROM sig",
    "kernel_gram": _with(*_MMD1) + "\nSELECT sa, sb, round(g, 6) AS g FROM gram",
    "sample_mmd": _with(
        _UNITS,
        _COUNTS,
        _SAMPLES,
        _weights(),
        _kept(),
        _ALL_KEPT,
        _mmd("(SELECT sigma FROM sig)"),
    )
    + _named(extra=", (SELECT round(sigma, 6) FROM sig) AS sigma"),
    "sample_mmd_unweighted": _with(
        _UNITS,
        _COUNTS,
        _SAMPLES,
        _weights("sign(value)"),
        _kept(),
        _ALL_KEPT,
        _mmd("(SELECT sigma FROM sig)"),
    )
    + _named(),
    "sample_mmd_fixed_sigma": _with(
        _UNITS, _COUNTS, _SAMPLES, _weights(), _kept(), _mmd("0.5")
    )
    + _named(),
    "similarity_graph": _with(_UNITS, _PAIRS, _EDGES)
    + "\nSELECT i, j, round(weight, 6) AS weight FROM edges",
    "components": _with(_UNITS, _PAIRS, _EDGES, _reach("u", "edges"), recursive=True)
    + "\nSELECT node, component FROM parts",
    "graph_shape": _with(_UNITS, _PAIRS, _EDGES, _reach("u", "edges"), recursive=True)
    + """
SELECT sum(n)::BIGINT AS proteins, (SELECT count(*) FROM edges) AS edges,
       count(*) FILTER (n = 1) AS isolated, count(*) AS components, max(n) AS largest_component
FROM (SELECT component, count(*) AS n FROM parts GROUP BY component)""",
    "mcl_bins": _with(_UNITS, _PAIRS, _EDGES, _mcl(2.0), recursive=True) + _PARTITION,
    "mcl_bins_coarse": _with(_UNITS, _PAIRS, _EDGES, _mcl(1.4), recursive=True)
    + _PARTITION,
    "mcl_bins_tiled": _with(_UNITS, _PAIRS, _EDGES, _mcl(2.0), recursive=True)
    + _PARTITION,
    "bin_names": _with(_UNITS, _PAIRS, _EDGES, _reach("u", "edges"), recursive=True)
    + """
SELECT component AS cluster, n AS size, rank, 'bin' || rank AS bin FROM (
  SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS rank
  FROM (SELECT component, count(*) AS n FROM parts GROUP BY component))""",
    "bin_table": _with(
        _UNITS, _PAIRS, _EDGES, _mcl(2.0), _reach("u", "edges"), _BINS, recursive=True
    )
    + """
SELECT 'bin' || rank AS bin, rank, n AS size, node AS representative
FROM ranked JOIN medoid USING (cluster)""",
    "bin_heatmap_grid": _with(
        _UNITS, _PAIRS, _EDGES, _mcl(2.0), _reach("u", "edges"), _BINS, recursive=True
    )
    + """,
first AS (SELECT cluster, node AS head FROM ranked JOIN medoid USING (cluster) WHERE rank = 1),
drawn AS (SELECT i, j, greatest(least(weight, 1), 0) AS weight FROM edges
          UNION ALL SELECT j, i, greatest(least(weight, 1), 0) FROM edges),
placed AS (
  SELECT node, row_number() OVER (ORDER BY node <> head, coalesce(weight, 0) DESC, node) AS place
  FROM homes JOIN first USING (cluster) LEFT JOIN drawn ON i = node AND j = head)
SELECT a.node AS protein, b.node AS partner, a.place AS protein_at, b.place AS partner_at,
       CASE WHEN a.node = b.node THEN 1.0 ELSE round(weight, 6) END AS similarity
FROM placed a CROSS JOIN placed b LEFT JOIN drawn ON i = a.node AND j = b.node""",
    "bin_glom": _with(_COUNTS)
    + """
SELECT sample_id, 'bin' || (label + 1) AS bin, round(sum(value), 6) AS value
FROM counts JOIN embeddings ON vec_id = protein_id GROUP BY ALL""",
    "bin_medoids": _with(_UNITS, _PAIRS, _LINKS)
    + """,
half AS (SELECT i, j, weight FROM links UNION ALL SELECT j, i, weight FROM links),
score AS (
  SELECT a.label, a.ord, round(coalesce(sum(h.weight) FILTER (b.label = a.label), 0), 9) AS s
  FROM u a LEFT JOIN half h ON h.i = a.ord LEFT JOIN u b ON b.ord = h.j GROUP BY ALL)
SELECT 'bin' || (label + 1) AS bin, ord FROM score
QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, ord) = 1""",
    "bin_heatmap": _with(_UNITS, _PAIRS, _LINKS)
    + """,
half AS (
  SELECT i, j, weight FROM links UNION ALL SELECT j, i, weight FROM links
  UNION ALL SELECT ord, ord, 1.0 FROM u)
SELECT 'bin' || (a.label + 1) AS bin, i, j, round(weight, 6) AS similarity
FROM half JOIN u a ON a.ord = i JOIN u b ON b.ord = j WHERE a.label = b.label""",
    "bin_heatmap_members": _with(_UNITS, _PAIRS, _LINKS)
    + """,
half AS (SELECT i, j, weight FROM links UNION ALL SELECT j, i, weight FROM links),
score AS (
  SELECT a.label, a.ord, round(coalesce(sum(h.weight) FILTER (b.label = a.label), 0), 9) AS s
  FROM u a LEFT JOIN half h ON h.i = a.ord LEFT JOIN u b ON b.ord = h.j GROUP BY ALL),
medoid AS (
  SELECT label, ord AS lead FROM score
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, ord) = 1)
SELECT 'bin' || (u.label + 1) AS bin, u.ord,
       CASE WHEN u.ord = lead THEN 1.0 ELSE round(coalesce(weight, 0), 6) END AS to_lead,
       u.ord <> lead AS follows
FROM u JOIN medoid USING (label) LEFT JOIN half ON half.i = u.ord AND half.j = lead""",
    "bin_sizes": """
SELECT size, count(*) AS bins FROM (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
GROUP BY size""",
    "coherence_purity": _with(
        _UNITS, _PAIRS, _EDGES, _reach("u", "edges"), recursive=True
    )
    + """,
tagged AS (SELECT label, component AS bin, count(*) AS n FROM parts JOIN u ON ord = node GROUP BY ALL),
sizes AS (SELECT component AS bin, count(*) AS size FROM parts GROUP BY ALL),
modal AS (
  SELECT *, sum(n) OVER (PARTITION BY label) AS total FROM tagged
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, bin) = 1)
SELECT label, bin, round(n / total, 6) AS coherence, round(n / size, 6) AS purity
FROM modal JOIN sizes USING (bin)""",
    "align_score": _with(_UNITS, _SCORES, recursive=True)
    + """
SELECT i, j, score::BIGINT AS score, len_i::BIGINT AS len_i, len_j::BIGINT AS len_j
FROM scores JOIN todo USING (i, j)""",
    "align_columns": _with(_UNITS, _SCORES, recursive=True)
    + """
SELECT i, j, score::BIGINT AS score FROM scores""",
    "evalue_gate": _with(_scores(gated=True), recursive=True)
    + """,
found AS (
  SELECT i, j, score, ln(least(len_i, len_j)::DOUBLE * (SELECT sum(len) FROM catalog)) / ln(10)
         - (0.267 * score - ln(0.041)) / ln(10) AS log_evalue
  FROM scores JOIN todo USING (i, j))
SELECT i, j, score::BIGINT AS score, round(log_evalue, 6) + 0.0 AS log_evalue
FROM found WHERE log_evalue <= -2""",
    "gated_similarity": _with(_UNITS, _SCORES, recursive=True)
    + """
SELECT i, j, round(least(cs, 1), 6) AS weight FROM scores JOIN todo USING (i, j)
WHERE cs > 0 AND least(len_i, len_j)::DOUBLE * (SELECT sum(len) FROM catalog)
  * pow(2, -(0.267 * score - ln(0.041)) / ln(2)) <= 0.01""",
    "regions_mass": _with(
        _UNITS,
        _COUNTS,
        _weights(),
        _kept(),
        _ALL_KEPT,
        "\nlinks AS (SELECT i, j FROM apart WHERE cs >= 0.3)",
        _reach("kept", "links"),
        recursive=True,
    )
    + """
SELECT component AS region, round(sum(weight), 6) AS mass
FROM w JOIN parts ON node = protein_id GROUP BY component""",
    "drop_regions_mmd": _with(
        _UNITS,
        _COUNTS,
        _SAMPLES,
        _weights(),
        _kept(),
        _ALL_KEPT,
        "\nlinks AS (SELECT i, j FROM apart WHERE cs >= 0.4)",
        _reach("kept", "links"),
        """
gone AS (
  SELECT component FROM w JOIN parts ON node = protein_id GROUP BY component
  ORDER BY round(sum(weight), 12) DESC, component LIMIT 1),
left_over AS (
  SELECT sample_id, protein_id, weight AS value FROM w JOIN parts ON node = protein_id
  WHERE component NOT IN (SELECT component FROM gone))""",
        _weights("value", "left_over", "w2"),
        _kept("w2", "kept2"),
        _mmd("(SELECT sigma FROM sig)", "w2", "kept2"),
        recursive=True,
    )
    + _named(extra=", (SELECT round(sigma, 6) FROM sig) AS sigma"),
    "pcoa_centered": _with(*_MMD1, _CENTRED)
    + "\nSELECT sa, sb, round(b, 9) + 0.0 AS b FROM cells",
    "hull": """
WITH p AS (
  SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT DISTINCT a.label AS family, a.vec_id AS protein_id
FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE NOT EXISTS (
  SELECT 1 FROM p c WHERE c.label = a.label
  AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)""",
    "bray_curtis": _with(_COUNTS, _SAMPLES, _weights())
    + """,
shared AS (
  SELECT a.sample_id AS x, b.sample_id AS y, sum(least(a.weight, b.weight)) AS m
  FROM w a JOIN w b ON a.protein_id = b.protein_id GROUP BY ALL)
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b,
       round(greatest(1 - coalesce(m, 0), 0), 6) AS distance
FROM samples a JOIN samples b ON a.ord < b.ord
LEFT JOIN shared ON x = a.sample_id AND y = b.sample_id""",
    "bray_curtis_bins": _with(_COUNTS, _SAMPLES)
    + """,
rolled AS (
  SELECT sample_id, label, sum(value) AS v FROM counts JOIN embeddings ON vec_id = protein_id
  GROUP BY ALL),
totals AS (SELECT sample_id, sum(v) AS total FROM rolled GROUP BY ALL),
shared AS (
  SELECT a.sample_id AS x, b.sample_id AS y, sum(abs(a.v - b.v)) AS gap, sum(least(a.v, b.v)) AS m
  FROM rolled a JOIN rolled b ON a.label = b.label GROUP BY ALL)
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b,
       round(1 - 2 * coalesce(m, 0) / (ta.total + tb.total), 6) AS distance
FROM samples a JOIN samples b ON a.ord < b.ord
JOIN totals ta ON ta.sample_id = a.sample_id JOIN totals tb ON tb.sample_id = b.sample_id
LEFT JOIN shared ON x = a.sample_id AND y = b.sample_id""",
    "permanova_f": _with(*_MMD1)
    + """,
sizes AS (SELECT grp, count(*) AS n FROM samples GROUP BY grp),
total AS (SELECT sum(d * d) / (SELECT count(*) FROM samples) AS t FROM dist),
within AS (
  SELECT sum(d * d / n) AS w FROM dist JOIN samples a ON a.ord = sa JOIN samples b ON b.ord = sb
  JOIN sizes ON sizes.grp = a.grp WHERE a.grp = b.grp),
shape AS (SELECT count(*) AS a, sum(n) AS n FROM sizes)
SELECT (a - 1)::INTEGER AS df_group, (n - a)::INTEGER AS df_residual, round(t, 9) AS ss_total,
       round((t - w) / t, 6) AS r2, round((t - w) / (a - 1) / (w / (n - a)), 6) AS f
FROM total, within, shape""",
    "permanova_p": _with(*_MMD1, _PERMUTED)
    + """,
labelled AS MATERIALIZED (
  SELECT perm, drawn.ord, grp FROM drawn JOIN base USING (place)
  UNION ALL SELECT 0, ord, grp FROM samples),
sizes AS (SELECT grp, count(*) AS n FROM samples GROUP BY grp),
shape AS (SELECT count(*) AS a, sum(n) AS n FROM sizes),
total AS (SELECT sum(d * d) / (SELECT count(*) FROM samples) AS t FROM dist),
within AS (
  SELECT a.perm, sum(d * d / n) AS w
  FROM dist JOIN labelled a ON a.ord = sa
  JOIN labelled b ON b.ord = sb AND b.perm = a.perm AND b.grp = a.grp
  JOIN sizes ON sizes.grp = a.grp GROUP BY a.perm),
tests AS (SELECT perm, (t - w) / (a - 1) / (w / (n - a)) AS f FROM within, total, shape)
SELECT round(o.f, 6) AS f, (count(*) FILTER (x.f >= o.f - 1.5e-8) + 1) / 1000.0::DOUBLE AS p
FROM tests x, tests o WHERE o.perm = 0 AND x.perm > 0 GROUP BY o.f""",
    "permdisp": _with(*_MMD1, _PERMUTED, _CENTROIDS)
    + """,
residuals AS (
  SELECT ord, grp, n, spread, spread - avg(spread) OVER (PARTITION BY grp) AS r FROM spreads),
every AS (
  SELECT perm, mine.grp, mine.n, theirs.r AS v
  FROM drawn JOIN residuals mine ON mine.ord = drawn.ord
  JOIN base USING (place) JOIN residuals theirs ON theirs.ord = base.ord
  UNION ALL SELECT 0, grp, n, spread FROM residuals),
groups AS (SELECT perm, grp, n, sum(v) AS s, sum(v * v) AS q FROM every GROUP BY perm, grp, n),
tests AS (
  SELECT perm, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)
               / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f
  FROM groups GROUP BY perm)
SELECT round(o.f, 6) AS f, (count(*) FILTER (x.f >= o.f - 1.5e-8) + 1) / 1000.0::DOUBLE AS p
FROM tests x, tests o WHERE o.perm = 0 AND x.perm > 0 GROUP BY o.f""",
    "permdisp_median": _with(*_MMD1)
    + f""",
{_medians(_MEDIAN_ROUNDS)}
SELECT sample_id, s.grp AS "group", round(spread, 6) AS spread
FROM s{_MEDIAN_ROUNDS - 1} s JOIN samples USING (ord)""",
    "permdisp_spread": _with(*_MMD1, _CENTROIDS)
    + """
SELECT sample_id, spreads.grp AS "group", round(spread, 6) AS spread
FROM spreads JOIN samples USING (ord)""",
    "clr": _with(_COUNTS, _CLR)
    + """
SELECT sample_id, feature, round(l + baseline, 6) + 0.0 AS clr
FROM logged JOIN base USING (sample_id) WHERE l > 0""",
    "clr_baseline": _with(_COUNTS, _CLR)
    + "\nSELECT sample_id, round(baseline, 6) AS baseline FROM base",
    "ols_slope": _with(_COUNTS, _SAMPLES, _TWO, _CLR, _OLS, recursive=True)
    + """
SELECT feature, round(lfc, 6) + 0.0 AS lfc, round(t, 6) + 0.0 AS t, df, round(p, 6) AS p FROM tail""",
    "bh_adjust": _with(_COUNTS, _SAMPLES, _TWO, _CLR, _OLS, recursive=True)
    + """,
placed AS (
  SELECT feature, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS v,
         row_number() OVER (ORDER BY p, feature) AS r FROM tail)
SELECT feature, round(p, 6) AS p, round(least(1, min(v) OVER (
  ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM placed""",
    "label_frequency": """
SELECT p_brand || ' ' || p_type AS label, count(*) AS n FROM part GROUP BY ALL
ORDER BY n DESC, label LIMIT 12""",
    "pooled_part_labels": """
WITH top AS (
  SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12)
SELECT p_partkey AS protein_id,
       CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'other' END AS label,
       CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN 2 ELSE 1 END AS layer
FROM part""",
    "tsne_neighbours": _with(
        _UNITS,
        _PAIRS,
        """
both_ AS (SELECT i, j, 1 - cs AS d FROM pairs UNION ALL SELECT j, i, 1 - cs FROM pairs),
near AS (
  SELECT i, j, d * d - min(d * d) OVER (PARTITION BY i) AS d2 FROM (
    SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 90)),
fit(step, i, lo, hi, beta) AS (
  SELECT DISTINCT 0, i, 0.0::DOUBLE, NULL::DOUBLE, 1.0::DOUBLE FROM near
  UNION ALL
  SELECT step, i, lo, hi, CASE WHEN hi IS NULL THEN 2 * beta ELSE (lo + hi) / 2 END FROM (
    SELECT step + 1 AS step, i, beta,
           CASE WHEN h > ln(30) THEN beta ELSE lo END AS lo,
           CASE WHEN h > ln(30) THEN hi ELSE beta END AS hi
    FROM (
      SELECT step, f.i AS i, lo, hi, beta,
             ln(sum(exp(-beta * d2))) + beta * sum(d2 * exp(-beta * d2)) / sum(exp(-beta * d2)) AS h
      FROM fit f JOIN near n ON n.i = f.i WHERE step < 120
      GROUP BY step, f.i, lo, hi, beta))),
one_way AS (
  SELECT n.i, n.j, exp(-beta * d2) / sum(exp(-beta * d2)) OVER (PARTITION BY n.i) AS p
  FROM near n JOIN fit f ON f.i = n.i AND step = 120),
sym AS (
  SELECT i, j, sum(p) / (2.0 * (SELECT count(*) FROM u)) AS p FROM (
    SELECT i, j, p FROM one_way UNION ALL SELECT j, i, p FROM one_way) GROUP BY i, j)""",
        recursive=True,
    )
    + """
SELECT i AS protein_id, count(*) AS neighbours, round(sum(p), 6) AS mass FROM sym GROUP BY i""",
    "fasta_records": _with(_SEQS)
    + """
SELECT row_number() OVER (ORDER BY protein_id) - 1 AS ord, protein_id, s AS sequence, true AS headed
FROM texts""",
    "embed_composition": _with(_SEQS)
    + f""",
shares AS (
  SELECT protein_id, d AS dim,
         (length(s) - length(replace(s, substr('{RESIDUES}', d + 1, 1), ''))) / length(s) AS x
  FROM texts, generate_series(0, 24) g(d))
SELECT protein_id, dim::INTEGER AS dim,
       round(x / sqrt(sum(x * x) OVER (PARTITION BY protein_id)), 6) AS v FROM shares""",
}
