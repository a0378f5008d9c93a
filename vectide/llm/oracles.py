"""DuckDB SQL for the operators that SQL can express, written apart from the operators."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _hash60(value: str) -> str:
    return f"('0x' || substr(md5(coalesce(CAST({value} AS VARCHAR), '')), 1, 15))::BIGINT"


# CRC-32 by the usual reflected polynomial: a table of 256 entries, then byte by byte
def _crcs(value: str = "text") -> str:
    """Checksums of all different values of a column."""
    return f"""
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
           THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) AS bytes(b)),
crcs AS (
  SELECT {value}, CASE WHEN v = '' THEN 0 ELSE xor(list_reduce(
      list_transform(regexp_extract_all(hex(encode(v)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]),
      4294967295), 4294967295) END AS crc
  FROM (SELECT DISTINCT {value}, CAST({value} AS VARCHAR) AS v FROM documents
        WHERE {value} IS NOT NULL), crc_table)
"""


def _ring(shards: int = 16, nodes: int = 64, slack: int = 2, together: int = 10) -> str:
    """The ring with its rounds written out; at most `shards` of them."""
    rounds = []
    for k in range(shards):
        loads = " UNION ALL ".join(
            ["SELECT -1 AS shard, 0 AS taken"]
            + [f"SELECT ask, take FROM round{j}" for j in range(k)]
        )
        left = f"SELECT arc, shard, bytes, done + take AS done FROM round{k - 1}" if k else (
            "SELECT arc, shard, bytes, 0::BIGINT AS done FROM demand"
        )
        rounds.append(f"""
round{k} AS MATERIALIZED (
  WITH load AS (SELECT s.shard, coalesce(sum(taken), 0)::BIGINT AS load
                FROM range({shards}) AS s(shard) LEFT JOIN ({loads}) l ON l.shard = s.shard
                GROUP BY s.shard),
  asked AS (
    SELECT a.arc, a.shard, a.bytes, a.done, coalesce(
      first_value(CASE WHEN load < capacity THEN a.shard END IGNORE NULLS)
        OVER (ORDER BY arc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      first_value(CASE WHEN load < capacity THEN a.shard END IGNORE NULLS)
        OVER (ORDER BY arc ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ask
    FROM ({left}) a JOIN load USING (shard), capacity)
  SELECT arc, a.shard, bytes, ask, done, greatest(0, least(bytes - done,
      capacity - load - coalesce(sum(bytes - done) OVER (PARTITION BY ask ORDER BY arc
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS take
  FROM asked a JOIN load ON load.shard = ask, capacity)""")
    pieces = " UNION ALL ".join(
        f"SELECT arc, ask AS shard, done AS begins, done + take AS ends FROM round{k} WHERE take > 0"
        for k in range(shards)
    )
    return f"""
WITH {_crcs()},
points AS (
  SELECT (i % {shards})::INT AS shard,
         {_hash60(f"'node-' || (i % {shards}) || '-' || (i // {shards})")} AS high
  FROM range({shards * nodes}) AS n(i)),
ordered AS (
  SELECT row_number() OVER (ORDER BY high, shard) AS arc, shard,
         lag(high, 1, -1) OVER (ORDER BY high, shard) AS low, high FROM points),
arcs AS MATERIALIZED (
  SELECT * FROM ordered UNION ALL
  SELECT max(arc) + 1, arg_min(shard, arc), max(high), {2**60 - 1} FROM ordered),
rows_ AS MATERIALIZED (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, crc,
         {_hash60("text")} AS place
  FROM documents LEFT JOIN crcs USING (text)),
located AS MATERIALIZED (
  SELECT r.*, arc, coalesce(sum(size) OVER (PARTITION BY arc ORDER BY place, doc_id, crc
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_
  FROM rows_ r JOIN arcs ON place > low AND place <= high),
demand AS MATERIALIZED (
  SELECT arc, shard, coalesce(sum(size), 0)::BIGINT AS bytes
  FROM arcs LEFT JOIN located USING (arc) GROUP BY arc, shard),
capacity AS MATERIALIZED (
  SELECT (sum(bytes) * {1000 + slack} // {1000 * shards} + 1)::BIGINT AS capacity FROM demand),
{",".join(rounds)},
pieces AS ({pieces}),
grouped AS (
  SELECT *, sum(size) OVER (PARTITION BY place) AS together,
         min(start_) OVER (PARTITION BY place) AS opens FROM located),
anchored AS (
  SELECT *, CASE WHEN together * {together} <= capacity THEN opens + together // 2
                 ELSE start_ + size // 2 END AS anchor
  FROM grouped, capacity),
placed AS (
  SELECT a.*, p.shard FROM anchored a
  JOIN pieces p ON p.arc = a.arc AND anchor >= begins AND anchor < ends)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, crc) - 1 AS slot,
       NULL::INT AS grown_shard
FROM placed
"""


_MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
         {_hash60("doc_id")} AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 3 * source_size AS most FROM s),
r AS (
  SELECT *, row_number() OVER ratio AS turn,
         sum(source_size) OVER () - coalesce(sum(most) OVER (
           ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS rest,
         sum(weight) OVER (ORDER BY most / weight, place
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW ratio AS (ORDER BY most / weight, place)),
level AS (
  SELECT turn AS first_, rest AS rest_, weights AS weights_ FROM r
  WHERE most * weights >= weight * rest ORDER BY turn LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN turn < first_ THEN most::DOUBLE
         ELSE (weight * rest_)::DOUBLE / weights_::DOUBLE END AS target
  FROM r, level),
o AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT
         AS taken
FROM e
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS digest
  FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM p),
c AS (
  SELECT *, list_transform(range(4), lambda k: ('0x' || substr(digest, 10 * k + 1, 10))::BIGINT)
         AS chunks FROM o)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((chunks[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM c
"""

_NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    {_WORDS}) AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)),
    lambda i: md5(array_to_string(words[i:i + 4], ' ')))) AS shingle
  FROM w WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY i, j),
links AS MATERIALIZED (
  SELECT i, j FROM shared JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (
  SELECT i AS a, j AS b FROM links UNION SELECT j, i FROM links
  UNION SELECT r.a, CASE WHEN l.i = r.b THEN l.j ELSE l.i END
  FROM reach r JOIN links l ON l.i = r.b OR l.j = r.b),
c AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""



def _levels(name: str, leaves: str, height: int) -> str:
    """A tree of eights for every `tree` of `leaves` (tree, i, h): levels `name`0 to `name`height.

    A level of one node is repeated above; `n` counts a level's nodes in the tree.
    """
    levels = [f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(height):
        levels.append(f"""
{name}{k + 1} AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (
    SELECT tree, i // 8 AS i,
           CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
    FROM {name}{k} GROUP BY tree, i // 8, n))""")
    return ",".join(levels)


def _folds(name: str, rows: str, height: int) -> str:
    """Siblings and the folded digest of `rows` (doc_id, tree, i, f, proof), level by level."""
    folds = [f"{name}_f0 AS MATERIALIZED (SELECT doc_id, tree, i, f, proof FROM {rows})"]
    for k in range(height):
        folds.append(f"""
{name}_f{k + 1} AS MATERIALIZED (
  SELECT r.doc_id, r.tree, r.i // 8 AS i,
         CASE WHEN l.n = 1 THEN r.f
              ELSE sha256(string_agg(CASE WHEN l.i = r.i THEN r.f ELSE l.h END, '' ORDER BY l.i)) END AS f,
         proof || CASE WHEN l.n = 1 THEN ''
              ELSE coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i <> r.i), '') END AS proof
  FROM {name}_f{k} r JOIN {name}{k} l ON l.tree = r.tree AND l.i // 8 = r.i // 8
  GROUP BY r.doc_id, r.tree, r.i, r.f, r.proof, l.n)""")
    return ",".join(folds)


def _merkle(height: int = 7, top: int = 3) -> str:
    """Trees of up to 8**height documents a language, 8**top languages."""
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = [
            f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in fields
        ]
        return f"sha256({' || '.join(parts)})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {_crcs("doc_id")},
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS h,
         CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f
  FROM documents LEFT JOIN crcs USING (doc_id)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
nodes AS (SELECT tree, i, h FROM ranked),
{_levels("l", "nodes", height)},
roots AS MATERIALIZED (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS lang FROM l{height}),
tops AS (SELECT tree, i, h FROM roots),
{_levels("t", "tops", top)},
started AS (SELECT doc_id, tree, i, f, '' AS proof FROM ranked),
{_folds("l", "started", height)},
upper_ AS (
  SELECT doc_id, '' AS tree, r.i, f, proof FROM l_f{height} x JOIN roots r ON r.lang = x.tree),
{_folds("t", "upper_", top)}
SELECT x.doc_id, d.h AS leaf, r.h AS subroot, t{top}.h AS root, sha256(proof) AS proof_sha256,
       x.f AS folded_root, x.f = t{top}.h AS verified
FROM t_f{top} x JOIN d USING (doc_id) JOIN roots r ON r.lang = d.tree, t{top}
"""


_AUDIT = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
cut_ AS (
  SELECT doc_id, part, text, regexp_extract_all(text, {_WORDS}) AS words,
         min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
fails AS MATERIALIZED (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
         {{'A': len(words) < 200,
          'B': 100 * len(list_distinct(words)) < 50 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(first < doc_id, false)}} AS f
  FROM cut_ LEFT JOIN labels USING (doc_id)),
long_ AS MATERIALIZED (
  SELECT part, good, bad, [x.k FOR x IN [{{'k': 'A', 'v': f.A}}, {{'k': 'B', 'v': f.B}},
    {{'k': 'C', 'v': f.C}}, {{'k': 'D', 'v': f.D}}, {{'k': 'E', 'v': f.E}}] IF x.v] AS failed
  FROM fails),
cells AS MATERIALIZED (
  SELECT part, failed, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad
  FROM long_ GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT array_to_string(o, '') AS filter_order, step::INT AS step, o[step] AS k, o[:step - 1] AS earlier
  FROM orders, range(1, 6) AS s(step)),
counted AS (
  SELECT part, filter_order, step, k,
    sum(CASE WHEN NOT list_has_any(failed, list_append(earlier, k)) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN here THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_contains(failed, k) AND list_has_any(failed, earlier) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = [k] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN here THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN here THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT *, list_contains(failed, k) AND NOT list_has_any(failed, earlier) AS here
        FROM cells, steps)
  GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op5_ring_shards": _ring(),
    "op6_mix_sources": _MIX,
    "op8_warc_revisits": _WARC,
    "op9_minhash_bayes": _NEAR,
    "op12_incremental_witnesses": _merkle(),
    "op13_filter_audit": _AUDIT,
}
