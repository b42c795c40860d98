"""The sentence alignment as SQL: sentences, costs, the table a row at a time, the way back, and the beads."""

from __future__ import annotations

from lexigrid.functions.vocab import NEVER_SPLIT
from lexigrid.operators import lengths as L
from lexigrid.plans import standins as S

#: White space and line breaks as Python's patterns take them, in RE2.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
CLOSING = """["''»”)\\]]"""

#: Ends of abbreviations that end no sentence get this in place of their full stop while sentences are cut.
HELD, CUT = "chr(2)", "chr(1)"


def sentences_sql(name: str, source: str, text: str) -> str:
    """(filename, i, body, lo, hi): numbered from 1, without blanks at the ends, and where they stand."""
    never = "|".join(sorted((a.replace(".", r"\.") for a in NEVER_SPLIT), key=len, reverse=True))
    held = rf"""regexp_replace(line, '(^|[\s\x0b\x1c-\x1f\x{{85}}\pZ(\["''«„])({never})\.', '\1\2' || {HELD}, 'g')"""
    marked = rf"""regexp_replace({held}, '([.!?…]+{CLOSING}*)({SPACE}|$)', '\1' || {CUT} || '\2', 'g')"""
    return rf"""
{name}_lines AS (
  SELECT filename, n, line, coalesce(sum(length(line) + length(brk)) OVER (PARTITION BY filename ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT filename, unnest(lines) AS line, unnest(list_append(brks, '')) AS brk, generate_subscripts(lines, 1) AS n
        FROM (SELECT filename, regexp_split_to_array({text}, '{LINE}') AS lines, regexp_extract_all({text}, '{LINE}') AS brks FROM {source}))),
{name}_cut AS (
  SELECT filename, n, k, piece, base + coalesce(sum(length(piece)) OVER (PARTITION BY filename, n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT filename, n, base, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k
        FROM (SELECT filename, n, base, string_split(replace({marked}, {HELD}, '.'), {CUT}) AS pieces FROM {name}_lines))),
{name} AS (
  SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY n, k) AS i, body, CAST(pos + skip AS INTEGER) AS lo, CAST(pos + skip + length(body) AS INTEGER) AS hi
  FROM (SELECT *, length(piece) - length(regexp_replace(piece, '^{SPACE}+', '')) AS skip, regexp_replace(piece, '^{SPACE}+|{SPACE}+$', '', 'g') AS body FROM {name}_cut)
  WHERE body <> '')"""


#: -log(erfc(x)): a series for small x, a continued fraction for large, at most that of the least tail.
LOG_TAIL = f"""-ln(greatest({L.LEAST}, CASE WHEN x < 2.5
  THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest(x, 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))
  ELSE exp(-least(x * x, 700)) / sqrt(pi()) / list_reduce(list_prepend(x, list_transform(range(0, 160), lambda k: (160 - k) / 2.0)), lambda f, h: x + h / f) END))"""


def _costs() -> str:
    """A table of the cost of each pair of lengths that a move may face."""
    return f"""
spans AS (
  SELECT filename, 0 AS side, i, d, sum(length(body)) AS w FROM (SELECT a.filename, a.i, d, b.body FROM src_sent a, (VALUES (1), (2)) AS t(d), src_sent b WHERE b.filename = a.filename AND b.i BETWEEN a.i - d + 1 AND a.i AND a.i >= d) GROUP BY ALL
  UNION ALL SELECT filename, 1, i, d, sum(length(body)) FROM (SELECT a.filename, a.i, d, b.body FROM hyp_sent a, (VALUES (1), (2)) AS t(d), hyp_sent b WHERE b.filename = a.filename AND b.i BETWEEN a.i - d + 1 AND a.i AND a.i >= d) GROUP BY ALL),
mv AS (SELECT * FROM (VALUES {", ".join(f"({k}, {di}, {dj}, {p})" for k, ((di, dj), p) in enumerate(L.PRIORS.items()))}) AS t(k, di, dj, prior)),
sized AS (SELECT filename, (SELECT count(*) FROM src_sent s WHERE s.filename = f.filename) AS n, (SELECT count(*) FROM hyp_sent h WHERE h.filename = f.filename) AS m FROM f),
faced AS (
  SELECT z.filename, r.i, c.j, k, di, dj, prior, coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b
  FROM sized z, LATERAL (SELECT unnest(range(0, n + 1)) AS i) r, LATERAL (SELECT unnest(range(0, m + 1)) AS j) c, mv
  LEFT JOIN spans x ON x.filename = z.filename AND x.side = 0 AND x.i = r.i AND x.d = mv.di LEFT JOIN spans y ON y.filename = z.filename AND y.side = 1 AND y.i = c.j AND y.d = mv.dj
  WHERE r.i >= di AND c.j >= dj),
tails AS (SELECT a, b, CASE WHEN a = 0 AND b = 0 THEN 0 ELSE {LOG_TAIL} END AS tail FROM (SELECT a, b, abs(b - a) / sqrt(greatest((a + b) / 2.0, 1e-9) * {L.VARIANCE}) / sqrt(2) AS x FROM (SELECT DISTINCT a, b FROM faced))),
priced AS (SELECT filename, i, j, k, di, dj, CAST(floor((tail - ln(prior)) * {L.UNIT} + 0.5) AS BIGINT) AS cost FROM faced JOIN tails USING (a, b))"""


#: Tables up to ``spelt``, a row a bead, to be put behind WITH RECURSIVE; ``f`` has the pairs of texts.
TABLES = f"""{S.PAIRS}, f AS (SELECT filename || '#' || bead_idx AS filename, source, hypothesis FROM pairs),
{sentences_sql('src_sent', 'f', 'source')}, {sentences_sql('hyp_sent', 'f', 'hypothesis')}, {_costs()},
trellis AS (
  SELECT filename, n, m, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS two, CAST([] AS BIGINT[]) AS one, CAST([0] AS BIGINT[]) AS row, CAST([0] AS BIGINT[]) AS way FROM sized
  UNION ALL
  SELECT filename, n, m, i, j, two, one, CASE WHEN j = 0 THEN [best] ELSE list_append(row, best) END, CASE WHEN j = 0 THEN [w] ELSE list_append(way, w) END
  FROM (
    SELECT u.filename, u.n, u.m, u.i, u.j, u.two, u.one, u.row, u.way, min(cost) AS best, arg_min(k, cost * 8 + k) AS w
    FROM (
      SELECT u.*, p.k, p.cost + CASE WHEN p.di = 2 THEN u.two[u.j - p.dj + 1] WHEN p.di = 1 THEN u.one[u.j - p.dj + 1] ELSE u.row[u.j] END AS cost
      FROM (
        SELECT filename, n, m, CASE WHEN j < m THEN i ELSE i + 1 END AS i, CASE WHEN j < m THEN j + 1 ELSE 0 END AS j,
          CASE WHEN j < m THEN two ELSE one END AS two, CASE WHEN j < m THEN one ELSE row END AS one, CASE WHEN j < m THEN row ELSE CAST([] AS BIGINT[]) END AS row, CASE WHEN j < m THEN way ELSE CAST([] AS BIGINT[]) END AS way
        FROM trellis WHERE i < n OR j < m) u
      JOIN priced p ON p.filename = u.filename AND p.i = u.i AND p.j = u.j) u
    GROUP BY ALL) u),
ways AS (SELECT filename, i, way FROM trellis WHERE j = m),
back AS (
  SELECT filename, n AS i, m AS j, CAST(NULL AS BIGINT) AS di, CAST(NULL AS BIGINT) AS dj, 0 AS step FROM sized
  UNION ALL
  SELECT b.filename, b.i - mv.di, b.j - mv.dj, mv.di, mv.dj, b.step + 1 FROM back b JOIN ways w ON w.filename = b.filename AND w.i = b.i JOIN mv ON mv.k = w.way[b.j + 1] WHERE b.i > 0 OR b.j > 0),
spelt AS (
  SELECT filename, i + 1 + x AS i1, CASE WHEN di = 2 AND dj = 2 THEN i + 1 + x ELSE i + di END AS i2, j + 1 AS j1, j + dj AS j2
  FROM back, LATERAL (SELECT unnest(range(0, CASE WHEN di = 2 AND dj = 2 THEN 2 ELSE 1 END)) AS x) WHERE di > 0 AND dj > 0)"""

BEADS = """SELECT b.filename, CAST(row_number() OVER (PARTITION BY b.filename ORDER BY i1, j1) - 1 AS INTEGER) AS bead_idx,
  (SELECT string_agg(body, ' ' ORDER BY i) FROM src_sent s WHERE s.filename = b.filename AND s.i BETWEEN i1 AND i2) AS source,
  (SELECT string_agg(body, ' ' ORDER BY i) FROM hyp_sent h WHERE h.filename = b.filename AND h.i BETWEEN j1 AND j2) AS hypothesis,
  (SELECT min(lo) FROM src_sent s WHERE s.filename = b.filename AND s.i = i1) AS src_start, (SELECT max(hi) FROM src_sent s WHERE s.filename = b.filename AND s.i = i2) AS src_end,
  (SELECT min(lo) FROM hyp_sent h WHERE h.filename = b.filename AND h.i = j1) AS hyp_start, (SELECT max(hi) FROM hyp_sent h WHERE h.filename = b.filename AND h.i = j2) AS hyp_end
FROM spelt b"""

BEADS_SQL = f"WITH RECURSIVE {TABLES} {BEADS}"
