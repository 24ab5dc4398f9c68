"""SQL that another engine runs on the same tables, for each registered query that SQL can express."""

from __future__ import annotations

from ..functions.stats import FAR, NEAR
from ..operators.events import METHOD_ORDER, ROLE_WEIGHTS

CELLS = """
cells AS (SELECT vec_id // 10 AS dataset_id, CAST(vec_id % 10 AS INTEGER) AS seq_id, label, pos,
  CASE WHEN (vec_id * 7 + pos * 13) % 17 = 0 THEN 0 WHEN v < -0.085 THEN 1 WHEN v < 0 THEN 2 WHEN v < 0.085 THEN 3 ELSE 4 END AS st
  FROM (SELECT vec_id, label, CAST(unnest(range(1, 65)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)),
counts AS (SELECT dataset_id, seq_id, count(*) FILTER (st > 0) AS valid_sites, count(*) FILTER (st = 0) AS missing_sites FROM cells GROUP BY ALL)"""
SITES = CELLS + """,
ts AS (SELECT p.dataset_id, p.seq_id AS a, q.seq_id AS b, r.seq_id AS c, p.pos, p.st AS x, q.st AS y, r.st AS z
  FROM cells p JOIN cells q ON p.dataset_id = q.dataset_id AND p.pos = q.pos AND p.seq_id < q.seq_id
  JOIN cells r ON r.dataset_id = p.dataset_id AND r.pos = p.pos AND q.seq_id < r.seq_id),
vs AS (SELECT *, CAST(x = y AS INTEGER) AS m12, CAST(x = z AS INTEGER) AS m13, CAST(y = z AS INTEGER) AS m23
  FROM ts WHERE x > 0 AND y > 0 AND z > 0 AND NOT (x = y AND x = z))"""
PAIRS = CELLS + """,
pi AS (SELECT p.dataset_id, p.seq_id AS s1, q.seq_id AS s2, count(*) FILTER (p.st > 0 AND q.st > 0) AS valid, count(*) FILTER (p.st > 0 AND p.st = q.st) AS same
  FROM cells p JOIN cells q ON p.dataset_id = q.dataset_id AND p.pos = q.pos AND p.seq_id < q.seq_id GROUP BY ALL),
ident AS (SELECT *, CASE WHEN valid > 0 THEN same / valid ELSE 0.0 END AS identity FROM pi)"""
RICH = SITES + """,
rich AS (SELECT *, CASE WHEN m12 = 1 THEN 0 WHEN m13 = 1 THEN 1 ELSE 2 END AS cat FROM vs WHERE m12 + m13 + m23 = 1)"""
WALK = SITES + """,
steps AS (SELECT dataset_id, a, b, c, pos, 0 AS target, m12 - m13 AS step FROM vs UNION ALL SELECT dataset_id, a, b, c, pos, 1, m12 - m23 FROM vs UNION ALL SELECT dataset_id, a, b, c, pos, 2, m13 - m23 FROM vs),
walk AS (SELECT *, sum(step) OVER w AS height FROM steps WHERE step <> 0 WINDOW w AS (PARTITION BY dataset_id, a, b, c, target ORDER BY pos)),
tops AS (SELECT *, greatest(max(height) OVER w, 0) AS top FROM walk WINDOW w AS (PARTITION BY dataset_id, a, b, c, target ORDER BY pos)),
firsts AS (SELECT *, min(pos) OVER (PARTITION BY dataset_id, a, b, c, target, height) AS first_at FROM tops),
topat AS (SELECT t.*, coalesce((CASE WHEN t.top > 0 THEN f.pos END), 0) AS top_pos FROM tops t LEFT JOIN (SELECT dataset_id, a, b, c, target, height, min(pos) AS pos FROM walk GROUP BY ALL) f
  ON f.dataset_id = t.dataset_id AND f.a = t.a AND f.b = t.b AND f.c = t.c AND f.target = t.target AND f.height = t.top),
exc0 AS (SELECT dataset_id, a, b, c, target, count(*) AS n_sites, count(*) FILTER (step = 1) AS plus, max(height) AS max_height, min(height) AS min_height, max(top - height) AS descent FROM topat GROUP BY ALL HAVING count(*) >= 4),
exc AS (SELECT e.*, t.pos AS end_pos, t.top_pos AS begin_after FROM exc0 e JOIN topat t USING (dataset_id, a, b, c, target) WHERE t.top - t.height = e.descent
  QUALIFY row_number() OVER (PARTITION BY dataset_id, a, b, c, target ORDER BY t.pos) = 1)"""
SIGNALS = WALK + f""",
sig0 AS (SELECT dataset_id, a, b, c, CASE target WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS recombinant, target, descent, n_sites, plus, begin_after + 1 AS begin, end_pos AS "end" FROM exc WHERE descent >= 6),
sig1 AS (SELECT *, ((dataset_id * 10 + a) * 10 + b) * 100 + c * 10 + target AS signal_id, [{", ".join(f"'{m}'" for m in METHOD_ORDER)}][CAST((dataset_id + a + b + c + target) % 7 + 1 AS INTEGER)] AS method, CAST(pow(2.0, -descent) AS DOUBLE) AS local_p FROM sig0),
signals AS (SELECT *, least(1.0, local_p * 120) AS corrected_p FROM sig1)"""


def _rank(m: str = "method") -> str:
    return f"list_position([{', '.join(repr(x) for x in METHOD_ORDER)}], {m})"


EVENTS = SIGNALS + f""",
ev0 AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, recombinant ORDER BY corrected_p, local_p, {_rank()}, signal_id) AS k FROM signals),
ev AS (SELECT *, signal_id AS event_id FROM ev0 WHERE k = 1)"""


def _seg(begin: str, end: str, n: int = 64) -> str:
    return f"CASE WHEN {begin} <= {end} THEN [{{'lo': {begin}, 'hi': {end}}}] ELSE [{{'lo': {begin}, 'hi': {n}}}, {{'lo': 1, 'hi': {end}}}] END"


def _span(b: str, e: str, n: int = 64) -> str:
    return f"(CASE WHEN {b} <= {e} THEN {e} - {b} + 1 ELSE {n} - {b} + 1 + {e} END)"


def _overlap(b1: str, e1: str, b2: str, e2: str) -> str:
    common = f"(SELECT count(*) FROM range(1, 65) g(p) WHERE {_in('p', b1, e1)} AND {_in('p', b2, e2)})"
    return f"(2.0 * {common} / ({_span(b1, e1)} + {_span(b2, e2)}))"


def _in(p: str, b: str, e: str) -> str:
    return f"(CASE WHEN {b} <= {e} THEN {p} BETWEEN {b} AND {e} ELSE {p} >= {b} OR {p} <= {e} END)"


def _tract(p: str, b: str, e: str) -> str:
    return f"(CASE WHEN {b} < {e} THEN {p} BETWEEN {b} AND {e} ELSE {p} >= {b} OR {p} <= {e} END)"


def _horner(coefficients, x: str) -> str:
    out = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r})"
    return out


def _tail(z: str) -> str:
    y = f"(abs({z}) * 0.5)"
    inner = f"(CASE WHEN {y} >= 3 THEN 1.0 WHEN {y} < 1 THEN {_horner(NEAR, f'({y} * {y})')} * {y} * 2.0 ELSE {_horner(FAR, f'({y} - 2.0)')} END)"
    return f"(CASE WHEN {z} = 0 THEN 0.0 WHEN abs({z}) < 5.9999999 THEN least({inner} + 1.0, 1.0 - {inner}) ELSE 1e-9 / pow(1.6, (abs({z}) - 5.999999) * 10.0) END)"


def _pad(source: str, cols: str, keys: str, h: int) -> str:
    return f"""
idx0 AS (SELECT {cols}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS INTEGER) AS idx, CAST(count(*) OVER (PARTITION BY {keys}) AS INTEGER) AS n FROM {source}),
pad AS (SELECT *, idx AS place, 0 AS lap FROM idx0 WHERE n >= {2 * h} UNION ALL SELECT *, idx + n, 1 FROM idx0 WHERE idx < {h} AND n >= {2 * h} AND n > {h} UNION ALL SELECT *, idx - n, -1 FROM idx0 WHERE idx >= n - {h} AND n >= {2 * h} AND n > {h})"""


T = "dataset_id, a, b, c"
CHI = SITES + "," + _pad("vs", f"{T}, pos, m12, m13, m23", T, 6) + f""",
lr AS (SELECT {T}, pos, idx, lap, {", ".join(f"sum({m}) OVER (PARTITION BY {T} ORDER BY place ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l_{m}, sum({m}) OVER (PARTITION BY {T} ORDER BY place ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS r_{m}" for m in ("m12", "m13", "m23"))} FROM pad),
flat AS (SELECT {T}, pos, idx, 0 AS pair, l_m12 AS l, r_m12 AS r FROM lr WHERE lap = 0 UNION ALL SELECT {T}, pos, idx, 1, l_m13, r_m13 FROM lr WHERE lap = 0 UNION ALL SELECT {T}, pos, idx, 2, l_m23, r_m23 FROM lr WHERE lap = 0),
chi AS (SELECT *, CASE WHEN l + r > 0 AND 12 - l - r > 0 THEN pow(l * (6.0 - r) - (6.0 - l) * r, 2) * 2.0 / (6.0 * (l + r) * (12.0 - l - r)) ELSE 0.0 END AS chi FROM flat)"""
BOOT = CELLS + """,
wins AS (SELECT CAST(w AS INTEGER) AS win, CAST(((w * 8 - 8 + k - 1) % 64 + 64) % 64 + 1 AS INTEGER) AS pos FROM range(0, 10) g(w) CROSS JOIN range(1, 17) h(k)),
dist0 AS (SELECT p.dataset_id, win, p.seq_id AS s1, q.seq_id AS s2, count(*) AS v, count(*) FILTER (p.st <> q.st) AS d FROM cells p JOIN cells q ON p.dataset_id = q.dataset_id AND p.pos = q.pos AND p.seq_id < q.seq_id JOIN wins ON wins.pos = p.pos WHERE p.st > 0 AND q.st > 0 GROUP BY ALL),
dist AS (SELECT dataset_id, win, s1, s2, CASE WHEN d = 0 THEN 0.0 WHEN (v - d) / v <= 0.25 THEN 10.0 ELSE -0.75 * ln((4.0 * ((v - d) / v) - 1.0) / 3.0) END AS d FROM dist0)"""
#: 100 replicates of windows of 16 sites: draws of the congruential generator from seed 3, two thrown away first and each site's last one.
PROFILES = CELLS.replace("cells AS", "RECURSIVE lcg(i, s) AS (SELECT 0, CAST(3 AS UBIGINT) UNION ALL SELECT i + 1, (s * 214013 + 2531011) & 4294967295 FROM lcg WHERE i < 2 + 16 * 100),\ncells AS", 1) + """,
drawn AS (SELECT (i - 3) % 100 + 1 AS rep, least(15, floor(((s >> 16) & 32767) / 32767.0 * 15)) AS site FROM lcg WHERE i >= 3),
weights AS (SELECT rep, site, count(*) AS n FROM drawn WHERE rep < 100 GROUP BY ALL UNION ALL SELECT 0, k, 1 FROM range(0, 16) g(k)),
placed AS (SELECT w AS win, k AS site, (w * 4 - 8 + k + 64) % 64 + 1 AS pos FROM range(0, 18) g(w) CROSS JOIN range(0, 16) h(k)),
met AS (SELECT p.dataset_id, p.seq_id AS s1, q.seq_id AS s2, p.pos, CAST(p.st <> q.st AS INTEGER) AS differ FROM cells p JOIN cells q ON p.dataset_id = q.dataset_id AND p.pos = q.pos AND p.seq_id < q.seq_id WHERE p.st > 0 AND q.st > 0),
sums AS (SELECT dataset_id, s1, s2, win, rep, sum(n) AS v, sum(n * differ) AS d FROM met JOIN placed USING (pos) JOIN weights USING (site) GROUP BY ALL),
prof AS (SELECT dataset_id, s1, s2, CAST(win AS INTEGER) AS win, rep, CASE WHEN d = 0 THEN 0.0 WHEN (v - d) / v <= 0.25 THEN 10.0 ELSE -0.75 * ln((4.0 * ((v - d) / v) - 1.0) / 3.0) END AS d FROM sums),
three AS (SELECT x.dataset_id, x.s1 AS a, x.s2 AS b, y.s2 AS c, x.win, x.d AS d12, y.d AS d13, z.d AS d23 FROM prof x JOIN prof y ON x.dataset_id = y.dataset_id AND x.win = y.win AND x.rep = y.rep AND x.s1 = y.s1 AND x.s2 < y.s2
  JOIN prof z ON z.dataset_id = x.dataset_id AND z.win = x.win AND z.rep = x.rep AND z.s1 = x.s2 AND z.s2 = y.s2 WHERE x.d < 2 AND y.d < 2 AND z.d < 2),
tri AS (SELECT p.dataset_id, p.seq_id AS a, q.seq_id AS b, r.seq_id AS c FROM counts p JOIN counts q ON p.dataset_id = q.dataset_id AND p.seq_id < q.seq_id JOIN counts r ON r.dataset_id = p.dataset_id AND q.seq_id < r.seq_id),
voted AS (SELECT tri.*, CAST(g.w AS INTEGER) AS win, count(d12) AS usable, count(*) FILTER (d12 < d13 AND d12 < d23) AS v12, count(*) FILTER (d13 < d12 AND d13 < d23) AS v13, count(*) FILTER (d23 < d12 AND d23 < d13) AS v23
  FROM tri CROSS JOIN range(0, 18) g(w) LEFT JOIN three t ON t.dataset_id = tri.dataset_id AND t.a = tri.a AND t.b = tri.b AND t.c = tri.c AND t.win = g.w GROUP BY ALL)"""
REL = SITES + """,
rel AS (SELECT *, CASE WHEN x = 0 OR y = 0 OR z = 0 THEN 0 WHEN x = y AND x = z THEN 5 WHEN x = y THEN 2 WHEN x = z THEN 3 WHEN y = z THEN 4 ELSE 1 END AS relation FROM ts),
tal AS (SELECT dataset_id, a, b, c, CAST(w AS INTEGER) AS win, """ + ", ".join(f"count(*) FILTER (relation = {k}) AS r{k}" for k in range(6)) + """
  FROM rel JOIN range(0, 10) g(w) ON pos > w * 5 AND pos <= w * 5 + 16 GROUP BY ALL)"""
def _corr(x: list[str], y: list[str]) -> str:
    """Correlation of two lists of six, to nine digits; 0 where one does not vary."""
    add = lambda v: "(" + " + ".join(v) + ")"
    part = lambda a, b: f"(6 * {add([f'{p} * {q}' for p, q in zip(a, b, strict=True)])} - {add(a)} * {add(b)})"
    return f"CASE WHEN {add([*x, *y])} IS NOT NULL THEN CASE WHEN {part(x, x)} > 1e-12 AND {part(y, y)} > 1e-12 THEN round({part(x, y)} / sqrt({part(x, x)} * {part(y, y)}), 9) ELSE 0.0 END END"


def _group_corr() -> str:
    """Correlation of i and o over a group; 0 where one does not vary."""
    part = lambda a, b: f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b}))"
    return f"CASE WHEN {part('i', 'i')} > 1e-9 AND {part('o', 'o')} > 1e-9 THEN {part('i', 'o')} / sqrt({part('i', 'i')} * {part('o', 'o')}) ELSE 0.0 END"


def _late() -> str:
    orders = (((0, 1, 2),), ((1, 0, 2),), ((2, 1, 0),), ((0, 2, 1),), ((1, 2, 0), (2, 0, 1)))
    sums = ", ".join([f"count(*) FILTER (h{i}) AS v{i}" for i in range(6)] + [f"count(*) FILTER (h{i} AND x{k} <> own) AS d{i}{k}" for i in range(6) for k in range(3)])
    apart = ", ".join(f"CASE WHEN v{i} > 0 THEN d{i}{k} / v{i} END AS a{i}{k}" for i in range(6) for k in range(3))
    best = []
    for c, (i, j) in enumerate(((0, 1), (2, 3), (4, 5))):
        mine = lambda o: [f"m.a{g}{k}" for g in (i, j) for k in o]  # noqa: B023, E731
        each = [f"greatest({', '.join(_corr([f's.a{g}{k}' for g in (i, j) for k in range(3)], mine(o)) for o in kinds)})" for kinds in orders]
        best.append(f"[{', '.join(each)}] AS c{c}")
    closest = lambda g: f"list_value(s.a{g}0, s.a{g}1, s.a{g}2)[m.role + 1] <= least(s.a{g}0, s.a{g}1, s.a{g}2)"
    return EVENTS + f""",
rep AS (SELECT event_id, dataset_id, "begin", "end", [recombinant] || list_filter([a, b, c], lambda x: x <> recombinant) AS reps FROM ev),
rv AS (SELECT r.event_id, r.dataset_id, r.reps, r."begin", r."end", p.pos, p.st AS x0, q.st AS x1, t.st AS x2 FROM rep r JOIN cells p ON p.dataset_id = r.dataset_id AND p.seq_id = r.reps[1]
  JOIN cells q ON q.dataset_id = r.dataset_id AND q.seq_id = r.reps[2] AND q.pos = p.pos JOIN cells t ON t.dataset_id = r.dataset_id AND t.seq_id = r.reps[3] AND t.pos = p.pos
  WHERE p.st > 0 AND q.st > 0 AND t.st > 0 AND NOT (p.st = q.st AND p.st = t.st)),
rn AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS j, count(*) OVER e AS n, count(*) FILTER (pos < "begin") OVER e AS ib, count(*) FILTER (pos <= "end") OVER e AS ie FROM rv WINDOW e AS (PARTITION BY event_id)),
rw AS (SELECT *, least(60, n // 2) AS w, {_in('pos', '"begin"', '"end"')} AS h5 FROM rn),
rg AS (SELECT *, ((ib - 1 - j) % n + n) % n < w AS h0, ((j - ib) % n + n) % n < w AS h1, ((ie - 1 - j) % n + n) % n < w AS h2, ((j - ie) % n + n) % n < w AS h3, NOT h5 AS h4 FROM rw),
rs AS (SELECT event_id, reps, seq_id, {sums} FROM (SELECT g.*, s.seq_id, s.st AS own FROM rg g JOIN cells s ON s.dataset_id = g.dataset_id AND s.pos = g.pos WHERE s.st > 0) GROUP BY event_id, reps, seq_id),
ra AS (SELECT *, {apart} FROM rs),
me AS (SELECT *, list_position(reps, seq_id) - 1 AS role FROM ra WHERE list_contains(reps, seq_id)),
co AS (SELECT s.event_id, s.seq_id, CAST(m.role AS INTEGER) AS role, {', '.join(best)}, s.v0 + s.v1 > 10 OR s.v2 + s.v3 > 10 AS overlap, coalesce({closest(4)} AND {closest(5)}, false) AS affinity
  FROM ra s JOIN me m ON m.event_id = s.event_id WHERE NOT list_contains(s.reps, s.seq_id)),
ck AS (SELECT event_id, seq_id, role, overlap, affinity, {', '.join(f"c{c}[1] AS r{c}, list_max(c{c}) AS m{c}, CASE WHEN list_max(c{c}) IS NOT NULL THEN CAST(list_position(c{c}, list_max(c{c})) - 1 AS INTEGER) END AS k{c}" for c in range(3))} FROM co),
cd AS (SELECT *, {', '.join(f"coalesce(k{c} = 0 AND r{c} > 0.83, false) AS t{c}, coalesce(k{c} BETWEEN 1 AND 3 AND m{c} > 0.83, false) AS u{c}" for c in range(3))} FROM ck)"""


NAMES = """
names AS (SELECT vec_id // 10 AS dataset_id, CAST(vec_id % 10 AS INTEGER) AS seq_id, CASE WHEN vec_id % 3 = 0 THEN 'REF-' || label || ':' || vec_id WHEN vec_id % 7 = 0 THEN 'x|REF' ELSE 'seq ' || vec_id END AS name FROM embeddings),
keyed AS (SELECT *, lower(trim(regexp_extract(name, '(?i)(?:^|[\\s|])REF(?:[-_:]?)([^<\\s|:]*)', 1))) AS lab FROM names WHERE regexp_matches(name, '(?i)(?:^|[\\s|])REF')),
keys AS (SELECT *, CASE WHEN lab <> '' THEN 'label:' || lab ELSE 'sequence:' || seq_id END AS key FROM keyed),
grp AS (SELECT dataset_id, key, row_number() OVER (PARTITION BY dataset_id ORDER BY min(seq_id)) AS ref_group FROM keys GROUP BY dataset_id, key),
groups AS (SELECT n.dataset_id, n.seq_id, coalesce(ref_group, 0) AS ref_group FROM names n LEFT JOIN keys k USING (dataset_id, seq_id) LEFT JOIN grp USING (dataset_id, key))""".replace("LEFT JOIN grp USING (dataset_id, key)", "LEFT JOIN grp ON grp.dataset_id = n.dataset_id AND grp.key = k.key")
END = '"end"'
REGIONS = """,
rs0 AS (SELECT event_id, p.seq_id AS s1, q.seq_id AS s2, p.st AS x, q.st AS y, CAST(p.pos AS BIGINT) AS pos, begin AS tb, "end" AS te FROM ev JOIN cells p ON p.dataset_id = ev.dataset_id JOIN cells q ON q.dataset_id = ev.dataset_id AND q.pos = p.pos AND q.seq_id <> p.seq_id WHERE p.st > 0 AND q.st > 0),
rs AS (SELECT *, unnest(list_filter([CASE WHEN TRACT THEN 'in' ELSE 'out' END, CASE WHEN ((tb - 1 - pos) % 64 + 64) % 64 < 20 THEN 'begin_left' END, CASE WHEN ((pos - tb) % 64 + 64) % 64 < 20 THEN 'begin_right' END, CASE WHEN ((te - pos) % 64 + 64) % 64 < 20 THEN 'end_left' END, CASE WHEN ((pos - te - 1) % 64 + 64) % 64 < 20 THEN 'end_right' END], lambda r: r IS NOT NULL)) AS region FROM rs0)""".replace("TRACT", _tract("pos", "tb", "te"))
FASTA = "string_agg(substr('-ACGT', CAST(st + 1 AS INTEGER), 1), '' ORDER BY pos)"
HIT = "EXISTS (SELECT 1 FROM ev WHERE ev.dataset_id = s.dataset_id{extra} AND " + _tract("s.pos", "ev.begin", 'ev."end"') + ")"
DECISIONS = """
dec AS (SELECT ((event_id * 7) % 500) AS event_id, event_id AS decision_id, epoch_us(ts) AS t_us, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'viewed' END AS state FROM events)"""


def sql() -> dict[str, str]:
    w = lambda cte, body: f"WITH {cte}\n{body}"
    weights = "[" + ", ".join(map(str, ROLE_WEIGHTS)) + "]"
    out = {
        "encode_residues": "SELECT doc_id, CAST(length(t) - length(translate(t, 'Aa', '')) AS BIGINT) AS n_a, CAST(length(t) - length(translate(t, 'Cc', '')) AS BIGINT) AS n_c, CAST(length(t) - length(translate(t, 'Gg', '')) AS BIGINT) AS n_g, CAST(length(t) - length(translate(t, 'TtUu', '')) AS BIGINT) AS n_t, CAST(length(translate(t, 'AaCcGgTtUu', '')) AS BIGINT) AS n_missing FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        "sequence_fragments": "SELECT doc_id, CAST(length(f) AS BIGINT) AS n, md5(f) AS digest FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z.?!*-]', '', 'g')) AS f FROM documents)",
        "partition_markers": "SELECT source, CAST(i AS INTEGER) AS pos FROM (SELECT source, text, unnest(range(1, length(text) + 1)) AS i FROM (SELECT source, arg_min(text, doc_id) AS text FROM documents GROUP BY source)) WHERE substr(text, i, 1) = '!'",
        "encode_cells": w(CELLS, "SELECT dataset_id, seq_id, pos, st FROM cells"),
        "sequence_counts": w(CELLS, "SELECT * FROM counts"),
        "site_classes": w(CELLS, "SELECT dataset_id, count(*) FILTER (k1 >= 2) AS variable_sites, count(*) FILTER (k2 >= 2) AS informative_sites FROM (SELECT dataset_id, pos, count(*) AS k1, count(*) FILTER (n >= 2) AS k2 FROM (SELECT dataset_id, pos, st, count(*) AS n FROM cells WHERE st > 0 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"),
        "pair_identity": w(PAIRS, "SELECT dataset_id, s1, s2, valid, same, round(identity, 6) AS identity FROM ident"),
        "identity_summary": w(PAIRS, "SELECT dataset_id, round(min(identity), 6) AS min_identity, round(avg(identity), 6) AS mean_identity, count(*) FILTER (valid = 0) AS pairs_without_sites, min(identity) < 0.6 AS low_identity FROM ident GROUP BY ALL"),
        "eligible_rows": w(CELLS, "SELECT * FROM counts WHERE valid_sites >= 60"),
        "dataset_summary": w(CELLS, "SELECT dataset_id, n_rows, active_count, n_triplets, round(2.0 * ln(4.0 * active_count) / 64, 6) AS min_distance, least(n_triplets, 2114125312) AS correction FROM (SELECT dataset_id, count(*) AS n_rows, count(*) FILTER (valid_sites >= 60) AS active_count, CAST(active_count * (active_count - 1) * (active_count - 2) // 6 AS BIGINT) AS n_triplets FROM counts GROUP BY ALL) WHERE active_count > 0"),
        "row_curation": w(CELLS, "SELECT dataset_id, seq_id, CASE WHEN valid_sites < 60 THEN 'disabled' WHEN valid_sites < 61 THEN 'masked' ELSE 'enabled' END AS row_state FROM counts"),
        "name_search": "SELECT doc_id, name FROM (SELECT doc_id, source || '_' || lang AS name FROM documents) WHERE contains(lower(name), 'src1') ORDER BY doc_id LIMIT 500",
        "normalised_names": "WITH n AS (SELECT lang AS dataset_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents), m AS (SELECT dataset_id, doc_id, CASE WHEN trim(name) = '' THEN 'Sequence_' || k ELSE trim(name) END AS seq_name FROM n) SELECT dataset_id, doc_id, seq_name, count(*) OVER (PARTITION BY dataset_id, seq_name) > 1 AS duplicated FROM m",
        "reference_groups": w(NAMES, "SELECT dataset_id, seq_id, CAST(ref_group AS INTEGER) AS ref_group FROM groups WHERE ref_group > 0"),
        "group_compaction": "WITH r AS (SELECT vec_id // 10 AS dataset_id, CAST(vec_id % 10 AS INTEGER) AS seq_id, label FROM embeddings), f AS (SELECT dataset_id, label, row_number() OVER (PARTITION BY dataset_id ORDER BY min(seq_id)) AS g FROM r WHERE label <> 0 GROUP BY dataset_id, label) SELECT dataset_id, seq_id, label, CAST(g AS INTEGER) AS compact_group FROM r JOIN f USING (dataset_id, label)",
        "triplets_exploratory": w(CELLS, "SELECT p.dataset_id, p.seq_id AS a, q.seq_id AS b, r.seq_id AS c FROM counts p JOIN counts q ON p.dataset_id = q.dataset_id AND p.seq_id < q.seq_id JOIN counts r ON r.dataset_id = p.dataset_id AND q.seq_id < r.seq_id"),
        "triplets_distinct_origins": w(CELLS, "SELECT p.dataset_id, p.seq_id AS a, q.seq_id AS b, r.seq_id AS c FROM counts p JOIN counts q ON p.dataset_id = q.dataset_id AND p.seq_id < q.seq_id AND p.seq_id // 2 <> q.seq_id // 2 JOIN counts r ON r.dataset_id = p.dataset_id AND q.seq_id < r.seq_id AND r.seq_id // 2 <> q.seq_id // 2 AND r.seq_id // 2 <> p.seq_id // 2"),
        "triplets_query_reference": w(NAMES, "SELECT x.dataset_id, q.seq_id AS q, x.seq_id AS r1, y.seq_id AS r2 FROM groups x JOIN groups y ON x.dataset_id = y.dataset_id AND x.ref_group <> y.ref_group AND x.seq_id < y.seq_id JOIN groups q ON q.dataset_id = x.dataset_id AND q.ref_group = 0 WHERE x.ref_group > 0 AND y.ref_group > 0"),
        "correction_plan": w(NAMES, "SELECT dataset_id, CAST(queries AS BIGINT) AS queries, CAST(refs AS BIGINT) AS refs, CAST(g AS BIGINT) AS ref_groups, CAST(queries * (refs * refs - sq) // 2 AS BIGINT) AS n_triplets, CAST(least(queries * g * (g - 1) // 2, 2114125312) AS BIGINT) AS correction FROM (SELECT dataset_id, coalesce(sum(n) FILTER (ref_group = 0), 0) AS queries, coalesce(sum(n) FILTER (ref_group > 0), 0) AS refs, count(*) FILTER (ref_group > 0) AS g, coalesce(sum(n * n) FILTER (ref_group > 0), 0) AS sq FROM (SELECT dataset_id, ref_group, count(*) AS n FROM groups GROUP BY ALL) GROUP BY ALL)"),
        "triplet_sites": w(SITES, "SELECT dataset_id, a, b, c, pos, m12, m13, m23 FROM vs"),
        "rdp_categories": w(RICH, "SELECT dataset_id, a, b, c, count(*) AS rich_sites, count(*) FILTER (cat = 0) AS n12, count(*) FILTER (cat = 1) AS n13, count(*) FILTER (cat = 2) AS n23 FROM rich GROUP BY ALL"),
        "rdp_rolling": w(RICH + "," + _pad("rich", f"{T}, pos, cat", T, 5).replace("n >= 10", "n >= 11") + f", roll AS (SELECT {T}, lap, {', '.join(f'sum(CAST(cat = {k} AS INTEGER)) OVER (PARTITION BY {T} ORDER BY place ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c{k}' for k in range(3))} FROM pad)", f"SELECT {T}, count(*) AS windows, CAST(max(c0) AS BIGINT) AS top12, CAST(max(c1) AS BIGINT) AS top13, CAST(max(c2) AS BIGINT) AS top23, CAST(min(c0) AS BIGINT) AS low12 FROM roll WHERE lap = 0 GROUP BY ALL"),
        "maxchi_profile": w(CHI, f"SELECT {T}, pair, count(*) AS boundaries, CAST(max(abs(l - r)) AS BIGINT) AS top_difference, round(max(chi), 6) AS top_chi, round(avg(chi), 6) AS mean_chi FROM chi GROUP BY ALL"),
        "maxchi_strongest": w(CHI + f", best AS (SELECT *, count(*) OVER (PARTITION BY {T}) AS n_gated, row_number() OVER (PARTITION BY {T} ORDER BY chi DESC, idx, pair) AS k FROM chi WHERE abs(l - r) > 2)", f"SELECT {T}, n_gated, pair, pos, round(chi, 6) AS chi, round({_tail('(-sqrt(chi))')}, 9) AS p FROM best WHERE k = 1"),
        "chimaera_targets": w(WALK, "SELECT dataset_id, a, b, c, target, count(*) AS sites, count(*) FILTER (step = 1) AS first_parent FROM walk GROUP BY ALL"),
        "geneconv_runs": w(SITES + f", g AS (SELECT {T}, pos, CASE WHEN m12 = 1 THEN 0 WHEN m13 = 1 THEN 1 WHEN m23 = 1 THEN 2 ELSE 3 END AS cat FROM vs), n AS (SELECT *, CASE WHEN lag(cat) OVER w = cat THEN 0 ELSE 1 END AS new FROM g WINDOW w AS (PARTITION BY {T} ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY {T} ORDER BY pos) AS run FROM n), r AS (SELECT {T}, cat, run, count(*) AS sites, min(pos) AS first, max(pos) AS last FROM i GROUP BY ALL)", f"SELECT {T}, cat, count(*) AS n_runs, CAST(max(sites) AS BIGINT) AS longest, min(first) AS first, max(last) AS last FROM r GROUP BY ALL"),
        "geneconv_counts": w(SITES, f"SELECT {T}, count(*) AS variable_sites, count(*) FILTER (m12 = 0) AS d12, count(*) FILTER (m13 = 0) AS d13, count(*) FILTER (m23 = 0) AS d23, count(*) FILTER (m12 + m13 + m23 = 0) AS all_differ FROM vs GROUP BY ALL"),
        "threeseq_walk": w(WALK, "SELECT dataset_id, a, b, c, target, count(*) AS sites, CAST(max(height) AS BIGINT) AS top, CAST(min(height) AS BIGINT) AS low, CAST(arg_max(height, pos) AS BIGINT) AS final FROM walk GROUP BY ALL"),
        "threeseq_excursion": w(WALK, "SELECT dataset_id, a, b, c, target, n_sites, plus, CAST(max_height AS BIGINT) AS max_height, CAST(min_height AS BIGINT) AS min_height, CAST(descent AS BIGINT) AS descent, begin_after, end_pos FROM exc"),
        "threeseq_p": w(WALK.replace("cells AS", "RECURSIVE cells AS", 1) + f""",
keys AS (SELECT DISTINCT plus, n_sites - plus AS minus, descent AS fall FROM exc),
dp(plus, minus, fall, used, u, d, p) AS (SELECT plus, minus, fall, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM keys WHERE plus > 0 AND minus > 0 AND fall > 0
  UNION ALL SELECT plus, minus, fall, used + 1, u + CAST(s = 1 AS BIGINT), CAST(CASE WHEN s = 1 THEN greatest(d - 1, 0) ELSE d + 1 END AS BIGINT) AS d1, sum(p * (CASE WHEN s = 1 THEN plus - u ELSE minus - (used - u) END) / (plus + minus - used))
  FROM dp CROSS JOIN (VALUES (1), (-1)) g(s) WHERE used < plus + minus AND d < fall AND (CASE WHEN s = 1 THEN plus - u ELSE minus - (used - u) END) > 0 GROUP BY plus, minus, fall, used, u + CAST(s = 1 AS BIGINT), d1),
told AS (SELECT plus, minus, fall, least(1.0, sum(p)) AS p FROM dp WHERE d = fall GROUP BY ALL)""", f"SELECT {T}, target, CAST(e.plus AS BIGINT) AS plus, CAST(n_sites - e.plus AS BIGINT) AS minus, CAST(descent AS BIGINT) AS descent, round(coalesce(t.p, 1.0), 9) AS p, true AS exact FROM exc e LEFT JOIN told t ON t.plus = e.plus AND t.minus = e.n_sites - e.plus AND t.fall = e.descent"),
        "bootscan_windows": "SELECT d.dataset_id, CAST(w AS INTEGER) AS win, CAST(((w * 16 - 16 + k - 1) % n + n) % n + 1 AS INTEGER) AS pos FROM (SELECT vec_id // 10 AS dataset_id, max(len(embedding)) AS n FROM embeddings GROUP BY ALL) d CROSS JOIN range(0, 6) g(w) CROSS JOIN range(1, 33) h(k)",
        "role_metrics": w(EVENTS + f""",
rep AS (SELECT event_id, dataset_id, "begin", "end", [recombinant] || list_filter([a, b, c], lambda x: x <> recombinant) AS reps FROM ev),
rd0 AS (SELECT r.event_id, p.seq_id AS s1, q.seq_id AS s2, {_in('p.pos', '"begin"', '"end"')} AS inner_, count(*) FILTER (p.st > 0 AND q.st > 0) AS v, count(*) FILTER (p.st > 0 AND q.st > 0 AND p.st <> q.st) AS d
  FROM rep r JOIN cells p ON p.dataset_id = r.dataset_id JOIN cells q ON q.dataset_id = p.dataset_id AND q.pos = p.pos AND q.seq_id <> p.seq_id GROUP BY ALL),
rd AS (SELECT *, CASE WHEN v = 0 THEN 10.0 WHEN d = 0 THEN 0.0 WHEN (v - d) / v <= 0.25 THEN 10.0 ELSE -0.75 * ln((4.0 * ((v - d) / v) - 1.0) / 3.0) END AS x FROM rd0),
who AS (SELECT event_id, unnest(reps) AS row_, CAST(unnest(range(0, 3)) AS INTEGER) AS role FROM rep),
pf AS (SELECT w.event_id, w.role, w.row_, rd.s2 AS other, coalesce(max(x) FILTER (inner_), 10.0) AS i, coalesce(max(x) FILTER (NOT inner_), 10.0) AS o FROM who w JOIN rd ON rd.event_id = w.event_id AND rd.s1 = w.row_ GROUP BY ALL),
own AS (SELECT event_id, role, {_group_corr()} AS r, avg(abs(i - o)) AS moved FROM pf GROUP BY ALL),
lo AS (SELECT event_id, role, avg(r) AS r FROM (SELECT p.event_id, w.role, p.role AS of_, {_group_corr()} AS r FROM pf p JOIN who w ON w.event_id = p.event_id AND w.role <> p.role AND w.row_ <> p.other GROUP BY ALL) GROUP BY ALL),
tu AS (SELECT a.event_id, a.role, avg(CAST((a.i - b.i) * (a.o - b.o) < 0 AS INTEGER)) AS t FROM pf a JOIN pf b ON a.event_id = b.event_id AND a.role = b.role AND a.other <> b.other GROUP BY ALL)""", "SELECT event_id, role, 0 AS metric, round(1 - r, 6) AS score FROM own UNION ALL SELECT event_id, role, 3, round(r, 6) FROM lo UNION ALL SELECT event_id, role, 5, round(moved, 6) FROM own UNION ALL SELECT event_id, role, 7, round(t, 6) FROM tu"),
        "distance_correlation_set": w(_late(), f"SELECT event_id, seq_id, role, {', '.join(f'r{c}, k{c}, m{c}' for c in range(3))}, overlap, affinity, t0 OR t1 OR t2 AS direct, t0 AND t1 AS strong, u0 OR u1 OR u2 AS inverse, overlap AND (t0 OR t1 OR t2) AND (affinity OR (t0 AND t1)) AS member FROM cd"),
        "bootstrap_votes": w(PROFILES, f"SELECT {T}, win, usable, v12, v13, v23 FROM voted"),
        "bootstrap_regions": w(PROFILES + f", pv AS (SELECT {T}, win, 0 AS pair, v12 AS votes FROM voted UNION ALL SELECT {T}, win, 1, v13 FROM voted UNION ALL SELECT {T}, win, 2, v23 FROM voted), fl AS (SELECT *, win - row_number() OVER (PARTITION BY {T}, pair ORDER BY win) AS g FROM pv WHERE votes >= 70)", f"SELECT {T}, pair, min(win) AS first, max(win) AS last, count(*) AS windows, round(avg(votes), 6) AS mean_votes FROM fl GROUP BY {T}, pair, g"),
        "bootscan_votes": w(BOOT, f"SELECT x.dataset_id, x.s1 AS a, x.s2 AS b, y.s2 AS c, count(*) AS usable, count(*) FILTER (x.d < y.d AND x.d < z.d) AS v12, count(*) FILTER (y.d < x.d AND y.d < z.d) AS v13, count(*) FILTER (z.d < x.d AND z.d < y.d) AS v23 FROM dist x JOIN dist y ON x.dataset_id = y.dataset_id AND x.win = y.win AND x.s1 = y.s1 AND x.s2 < y.s2 JOIN dist z ON z.dataset_id = x.dataset_id AND z.win = x.win AND z.s1 = x.s2 AND z.s2 = y.s2 WHERE x.d < 2 AND y.d < 2 AND z.d < 2 GROUP BY ALL"),
        "siscan_patterns": w(REL, f"SELECT {T}, {', '.join(f'count(*) FILTER (relation = {k}) AS r{k}' for k in range(6))} FROM rel GROUP BY ALL"),
        "siscan_tallies": w(REL, f"SELECT {T}, win, r0, r1, r2, r3, r4, r5 FROM tal"),
        "siscan_switches": w(REL + f", p AS (SELECT {T}, win, CASE WHEN r2 >= r3 AND r2 >= r4 THEN 0 WHEN r3 >= r4 THEN 1 ELSE 2 END AS pair FROM tal), n AS (SELECT *, CASE WHEN lag(pair) OVER (PARTITION BY {T} ORDER BY win) = pair THEN 0 ELSE 1 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY {T} ORDER BY win) AS run FROM n)", f"SELECT {T}, CAST(run AS BIGINT) AS run, pair, min(win) AS first, max(win) AS last, count(*) AS sites FROM i GROUP BY {T}, run, pair"),
        "phylpro_profile": w(CELLS + ", poly AS (SELECT dataset_id, pos FROM cells WHERE st > 0 GROUP BY ALL HAVING count(DISTINCT st) >= 2), pf AS (SELECT p.dataset_id, p.seq_id AS t, q.seq_id AS o, p.pos, CAST(p.st > 0 AND q.st > 0 AND p.st <> q.st AS INTEGER) AS miss FROM cells p JOIN cells q ON p.dataset_id = q.dataset_id AND p.pos = q.pos AND p.seq_id <> q.seq_id JOIN poly ON poly.dataset_id = p.dataset_id AND poly.pos = p.pos)," + _pad("pf", "dataset_id, t, o, pos, miss", "dataset_id, t, o", 10) + ", lr AS (SELECT dataset_id, t, o, idx, pos, lap, sum(miss) OVER (PARTITION BY dataset_id, t, o ORDER BY place ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l, sum(miss) OVER (PARTITION BY dataset_id, t, o ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS r FROM pad), s AS (SELECT dataset_id, t AS seq_id, idx, pos, count(*) AS n, sum(l) AS sx, sum(r) AS sy, sum(l * r) AS sxy, sum(l * l) AS sxx, sum(r * r) AS syy FROM lr WHERE lap = 0 GROUP BY ALL)", "SELECT dataset_id, seq_id, idx, pos, round(CASE WHEN n * sxx - sx * sx <= 0 OR n * syy - sy * sy <= 0 THEN 1.0 ELSE (n * sxy - sx * sy) / (sqrt(CAST(n * sxx - sx * sx AS DOUBLE)) * sqrt(CAST(n * syy - sy * sy AS DOUBLE))) END, 6) AS correlation FROM s"),
        "missing_runs": "WITH g AS (SELECT doc_id, i AS pos, CASE WHEN contains('AaCcGgTtUu', substr(text, i, 1)) THEN 0 ELSE 1 END AS gap FROM (SELECT doc_id, text, CAST(unnest(range(1, length(text) + 1)) AS INTEGER) AS i FROM documents WHERE text IS NOT NULL)), n AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g WHERE gap = 1), r AS (SELECT doc_id, min(pos) AS first, max(pos) AS last, count(*) AS sites FROM n GROUP BY doc_id, run) SELECT * FROM r WHERE sites >= 10",
        "jc_matrix": w(PAIRS, "SELECT dataset_id, s1, s2, round(CASE WHEN valid = 0 THEN 10.0 WHEN valid = same THEN 0.0 WHEN same / valid <= 0.25 THEN 10.0 ELSE -0.75 * ln((4.0 * (same / valid) - 1.0) / 3.0) END, 6) AS distance FROM ident"),
        "signals": w(SIGNALS, 'SELECT signal_id, dataset_id, a, b, c, recombinant, method, begin, "end", round(local_p, 9) AS local_p, round(corrected_p, 9) AS corrected_p FROM signals'),
        "strongest_signal": w(SIGNALS + f", r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY corrected_p, local_p, {_rank()}, signal_id) AS k FROM signals)", 'SELECT dataset_id, signal_id, method, begin, "end", round(corrected_p, 9) AS corrected_p FROM r WHERE k = 1'),
        "signal_dedupe": w(SIGNALS + f', r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, a, b, c, recombinant, begin, "end" ORDER BY corrected_p, local_p, {_rank()}, signal_id) AS k FROM signals)', "SELECT signal_id, method FROM r WHERE k = 1"),
        "breakpoint_match": w(EVENTS + f""",
            rich AS (SELECT *, CASE WHEN m12 = 1 THEN 0 WHEN m13 = 1 THEN 1 ELSE 2 END AS cat FROM vs WHERE m12 + m13 + m23 = 1),
            nb AS (SELECT event_id, pos AS low, cat, coalesce(lead(pos) OVER o, first_value(pos) OVER o) AS high, coalesce(lead(cat) OVER o, first_value(cat) OVER o) AS nc FROM ev JOIN rich USING ({T}) WINDOW o AS (PARTITION BY event_id ORDER BY pos)),
            bp AS (SELECT event_id, 'begin' AS side, begin AS site FROM ev UNION ALL SELECT event_id, 'end', "end" FROM ev),
            ds AS (SELECT bp.*, low, high, CASE WHEN {_in("site", "low", "high")} THEN 0 ELSE least((low - site + 64) % 64, (site - high + 64) % 64) END AS distance FROM bp JOIN nb USING (event_id) WHERE cat <> nc),
            near AS (SELECT * FROM ds QUALIFY row_number() OVER (PARTITION BY event_id, side ORDER BY distance, low, high) = 1),
            st AS (SELECT near.*, (pos - low + 64) % 64 AS k, (high - low + 64) % 64 AS n, x > 0 AND y > 0 AND z > 0 AS has FROM near JOIN ev USING (event_id) JOIN ts USING ({T})),
            ok AS (SELECT event_id, side, k FROM st WHERE k <= n AND has QUALIFY row_number() OVER (PARTITION BY event_id, side ORDER BY abs(k - n // 2), k) = 1)""",
            "SELECT near.*, CAST((low - 1 + k) % 64 + 1 AS INTEGER) AS moved_to, (SELECT NOT has FROM st WHERE st.event_id = near.event_id AND st.side = near.side AND st.k = st.n // 2) AS gap FROM near JOIN ok USING (event_id, side)"),
        "project_import": w(CELLS + """,
            n AS (SELECT dataset_id, dataset_id % 21 + 1 AS v, count(*) AS n, sum(seq_id) AS ids, count(*) FILTER (seq_id = dataset_id % 10) AS masked FROM counts GROUP BY dataset_id),
            r AS (SELECT *, CASE WHEN v > 19 THEN 'unknown version' WHEN n < 3 THEN 'fewer than three sequences' WHEN dataset_id % 11 = 5 THEN 'unknown method' END AS reason FROM n)""",
            """SELECT dataset_id, reason, CASE WHEN reason IS NULL THEN concat_ws(',', 'RDP', CASE WHEN v >= 10 THEN 'MaxChi' END, CASE WHEN v >= 12 THEN 'CHIMAERA' END, CASE WHEN v >= 13 THEN 'GENECONV' END,
              CASE WHEN v >= 14 AND dataset_id % 3 <> 0 THEN '3SEQ' END, CASE WHEN v >= 17 AND dataset_id % 2 = 0 THEN 'BootScan' END) END AS methods,
            CASE WHEN reason IS NULL THEN n END AS n_rows, CASE WHEN reason IS NULL THEN CAST(ids AS BIGINT) END AS seq_ids, CASE WHEN reason IS NULL THEN masked END AS n_masked FROM r"""),
        "tract_overlap": w(EVENTS, f'SELECT x.dataset_id, x.event_id AS i, y.event_id AS j, round({_overlap("x.begin", "x.\"end\"", "y.begin", "y.\"end\"")}, 6) AS overlap FROM ev x JOIN ev y ON x.dataset_id = y.dataset_id AND x.event_id < y.event_id WHERE {_overlap("x.begin", "x.\"end\"", "y.begin", "y.\"end\"")} > 0.3'),
        "support_pairs": w(EVENTS, f'SELECT e.dataset_id, e.event_id, s.signal_id FROM signals s JOIN ev e ON s.dataset_id = e.dataset_id AND len(list_intersect([s.a, s.b, s.c], [e.a, e.b, e.c])) >= 2 WHERE {_overlap("s.begin", "s.\"end\"", "e.begin", "e.\"end\"")} > 0.3'),
        "uncommitted_signals": w(EVENTS, f'SELECT s.signal_id FROM signals s WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE s.dataset_id = e.dataset_id AND s.a = e.a AND s.b = e.b AND s.c = e.c AND {_overlap("s.begin", "s.\"end\"", "e.begin", "e.\"end\"")} > 0.8)'),
        "pair_gate": w(PAIRS + ", ok AS (SELECT dataset_id, s1, s2 FROM ident WHERE identity >= 0.22)", "SELECT x.dataset_id, x.s1 AS a, x.s2 AS b, y.s2 AS c FROM ok x JOIN ok y ON x.dataset_id = y.dataset_id AND x.s1 = y.s1 AND x.s2 < y.s2 JOIN ok z ON z.dataset_id = x.dataset_id AND z.s1 = x.s2 AND z.s2 = y.s2"),
        "three_set_vote": w(PAIRS + ", m AS (SELECT DISTINCT dataset_id, s1 AS seq_id, 0 AS s FROM ident WHERE identity > 0.3 UNION ALL SELECT DISTINCT dataset_id, s2, 1 FROM ident WHERE identity > 0.3 UNION ALL SELECT dataset_id, seq_id, 2 FROM counts WHERE valid_sites > 60)", "SELECT dataset_id, seq_id, count(*) AS votes FROM m GROUP BY ALL HAVING count(*) >= 2"),
        "detectable_closure": w(SIGNALS + ", m AS (SELECT DISTINCT dataset_id, 0 AS role, a AS member FROM signals UNION SELECT DISTINCT dataset_id, 1, b FROM signals UNION SELECT DISTINCT dataset_id, 2, c FROM signals), two AS (SELECT dataset_id, member FROM m GROUP BY ALL HAVING count(DISTINCT role) >= 2)", "SELECT * FROM m UNION SELECT dataset_id, CAST(r AS INTEGER) AS role, member FROM two CROSS JOIN range(0, 3) g(r)"),
        "erased_union": w(SIGNALS + f', cut AS (SELECT dataset_id, recombinant, unnest({_seg("begin", chr(34) + "end" + chr(34))}) AS s FROM signals), p AS (SELECT DISTINCT dataset_id, recombinant, unnest(range(s.lo, s.hi + 1)) AS pos FROM cut), g AS (SELECT *, pos - row_number() OVER (PARTITION BY dataset_id, recombinant ORDER BY pos) AS k FROM p)', "SELECT dataset_id, recombinant, CAST(min(pos) AS INTEGER) AS lo, CAST(max(pos) AS INTEGER) AS hi FROM g GROUP BY dataset_id, recombinant, k"),
        "inside_outside_rates": w(EVENTS, "SELECT event_id AS signal_id, " + ", ".join(f"round(avg({m}) FILTER ({_tract('pos', 'begin', chr(34) + 'end' + chr(34))}), 6) AS {m}_in, round(avg({m}) FILTER (NOT {_tract('pos', 'begin', chr(34) + 'end' + chr(34))}), 6) AS {m}_out" for m in ("m12", "m13", "m23")) + " FROM ev JOIN vs USING (dataset_id, a, b, c) GROUP BY event_id"),
        "role_vote": w(EVENTS + f", sc AS (SELECT event_id, CAST(r AS INTEGER) AS role, CAST(m AS INTEGER) AS metric, (event_id * 31 + m * 17 + r * (m + 5) * 13) % 11 AS score FROM ev CROSS JOIN range(0, 3) g(r) CROSS JOIN range(0, 9) h(m)), tp AS (SELECT *, max(score) OVER (PARTITION BY event_id, metric) AS top FROM sc), wn AS (SELECT *, count(*) OVER (PARTITION BY event_id, metric) AS n FROM tp WHERE score = top), pt AS (SELECT event_id, role, sum({weights}[metric + 1] * CASE WHEN n = 1 THEN 1.0 ELSE 0.5 END) AS points FROM wn GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, role) AS k, sum(points) OVER (PARTITION BY event_id) AS total, coalesce(lead(points) OVER (PARTITION BY event_id ORDER BY points DESC, role), 0) AS nxt FROM pt)", "SELECT event_id, role, CAST(points AS DOUBLE) AS points, round(CASE WHEN total > 0 THEN (points - nxt) / total ELSE 0 END, 6) AS confidence FROM rk WHERE k = 1"),
        "review_latest": w(DECISIONS, "SELECT event_id, arg_max(state, (t_us, decision_id)) AS state FROM dec GROUP BY event_id"),
        "next_undecided": w(EVENTS + "," + DECISIONS + ", l AS (SELECT event_id, arg_max(state, (t_us, decision_id)) AS state FROM dec GROUP BY event_id)", "SELECT dataset_id, min(event_id) AS event_id FROM ev LEFT JOIN l USING (event_id) WHERE state IS NULL OR state NOT IN ('accepted', 'rejected') GROUP BY dataset_id"),
        "plot_thinning": w(WALK + f", k AS (SELECT *, count(*) OVER v AS n, row_number() OVER (PARTITION BY {T}, target ORDER BY pos) - 1 AS i, min(height) OVER v AS lo, max(height) OVER v AS hi FROM walk WINDOW v AS (PARTITION BY {T}, target))", f"SELECT {T}, target, pos, CAST(height AS BIGINT) AS height FROM k WHERE i % greatest(1, CAST(ceil(n / 10) AS BIGINT)) = 0 OR pos IN (1, 64) OR height = lo OR height = hi"),
        "tree_panel": w(PAIRS.replace("WITH", "") + "," + EVENTS.split(CELLS + ",", 1)[1] + ", an AS (SELECT dataset_id, event_id, unnest([a, b, c]) AS anchor FROM ev), bo AS (SELECT dataset_id, s1 AS anchor, s2 AS row, identity FROM ident UNION ALL SELECT dataset_id, s2, s1, identity FROM ident), al AS (SELECT dataset_id, event_id, row, max(identity) AS identity FROM (SELECT an.dataset_id, event_id, row, identity FROM bo JOIN an USING (dataset_id, anchor) UNION ALL SELECT dataset_id, event_id, anchor, 2.0 FROM an) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, event_id ORDER BY identity DESC, row) AS rank FROM al)", "SELECT dataset_id, event_id, row, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 6"),
        "prior_erasures": w(EVENTS + f', cut AS (SELECT dataset_id, event_id AS earlier, unnest({_seg("begin", chr(34) + "end" + chr(34))}) AS s FROM ev)', "SELECT e.dataset_id, e.event_id, count(DISTINCT earlier) AS n_earlier FROM ev e JOIN cut c ON c.dataset_id = e.dataset_id AND c.earlier < e.event_id AND e.begin + 5 >= c.s.lo AND e.begin - 5 <= c.s.hi GROUP BY ALL"),
        "masked_fasta": w(EVENTS, "SELECT dataset_id, seq_id, " + FASTA.replace("st + 1", "CASE WHEN hit THEN 0 ELSE st END + 1") + " AS sequence FROM (SELECT s.*, " + HIT.replace("{extra}", " AND ev.recombinant = s.seq_id") + " AS hit FROM cells s) GROUP BY dataset_id, seq_id"),
        "columns_removed_fasta": w(EVENTS, "SELECT dataset_id, seq_id, coalesce(" + FASTA + " FILTER (NOT hit), '') AS sequence FROM (SELECT s.*, " + HIT.replace("{extra}", "") + " AS hit FROM cells s) GROUP BY dataset_id, seq_id"),
        "sequences_removed_fasta": w(EVENTS, "SELECT dataset_id, seq_id, " + FASTA + " AS sequence FROM cells s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.dataset_id = s.dataset_id AND ev.recombinant = s.seq_id) GROUP BY dataset_id, seq_id"),
        "enabled_fasta": w(CELLS, "SELECT dataset_id, seq_id, " + FASTA + " AS sequence FROM cells JOIN counts USING (dataset_id, seq_id) WHERE valid_sites >= 61 GROUP BY dataset_id, seq_id"),
        "fragments": w(EVENTS + ', f AS (SELECT s.dataset_id, s.seq_id AS origin, ev.event_id, ' + FASTA.replace("st + 1", f"CASE WHEN {_tract('s.pos', 'ev.begin', 'ev.' + chr(34) + 'end' + chr(34))} THEN st ELSE 0 END + 1").replace("ORDER BY pos", "ORDER BY s.pos") + ' AS sequence FROM cells s JOIN ev ON ev.dataset_id = s.dataset_id AND ev.recombinant = s.seq_id GROUP BY ALL)', "SELECT dataset_id, origin, min(event_id) AS event_id, sequence FROM f WHERE length(replace(sequence, '-', '')) >= 5 GROUP BY dataset_id, origin, sequence"),
        "flagship": w(RICH + ", n AS (SELECT dataset_id, a, b, c, count(*) AS rich_sites, count(*) FILTER (cat = 0) AS n12, count(*) FILTER (cat = 1) AS n13, count(*) FILTER (cat = 2) AS n23 FROM rich GROUP BY ALL), k AS (SELECT *, CASE WHEN n12 >= n13 AND n12 >= n23 THEN '12' WHEN n13 >= n23 THEN '13' ELSE '23' END AS top, (greatest(n12, n13, n23) - least(n12, n13, n23)) / rich_sites AS contrast FROM n)", "SELECT dataset_id, a, b, c, rich_sites, top, round(contrast, 6) AS contrast FROM k QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY contrast DESC, rich_sites DESC, a, b, c) <= 10"),
        "chi_only_events": w(EVENTS + f', sp AS (SELECT e.event_id, s.method FROM signals s JOIN ev e ON s.dataset_id = e.dataset_id AND len(list_intersect([s.a, s.b, s.c], [e.a, e.b, e.c])) >= 2 WHERE {_overlap("s.begin", "s." + END, "e.begin", "e." + END)} > 0.3)', "SELECT event_id, bool_and(method IN ('MaxChi', 'CHIMAERA')) AS chi_only FROM sp GROUP BY event_id"),
        "role_hypotheses": w(EVENTS, "SELECT event_id, 0 AS hypothesis, a AS recombinant, b AS parent1, c AS parent2 FROM ev UNION ALL SELECT event_id, 1, b, a, c FROM ev UNION ALL SELECT event_id, 2, c, a, b FROM ev"),
        "masked_followup": w(EVENTS, "SELECT event_id, k.seq_id, CASE WHEN recombinant = a THEN b ELSE a END AS parent1, CASE WHEN recombinant = c THEN b ELSE c END AS parent2 FROM counts k JOIN ev USING (dataset_id) WHERE valid_sites = 60 AND k.seq_id NOT IN (a, b, c)"),
        "regional_distances": w(EVENTS + REGIONS, "SELECT event_id, s1, s2, region, count(*) AS valid, count(*) FILTER (x <> y) AS differences, round(CASE WHEN count(*) FILTER (x <> y) = 0 THEN 0.0 WHEN count(*) FILTER (x = y) / count(*) <= 0.25 THEN 10.0 ELSE -0.75 * ln((4.0 * (count(*) FILTER (x = y) / count(*)) - 1.0) / 3.0) END, 6) AS distance FROM rs JOIN (SELECT event_id, a, b, c FROM ev) USING (event_id) WHERE s1 IN (a, b, c) AND s2 IN (a, b, c) AND s1 < s2 GROUP BY event_id, s1, s2, region"),
        "phylogenetic_set": w(EVENTS + REGIONS + ", pd AS (SELECT event_id, s1, s2, region, count(*) FILTER (x <> y) / count(*) AS d FROM rs WHERE region IN ('in', 'out') GROUP BY ALL), pg AS (SELECT event_id, s1, region, max(d) FILTER (s2 = recombinant) AS own, min(d) FILTER (s2 <> recombinant) AS parent, count(*) AS k FROM pd JOIN (SELECT event_id, recombinant, a, b, c FROM ev) USING (event_id) WHERE s2 IN (a, b, c) AND s1 NOT IN (a, b, c) GROUP BY ALL)", "SELECT event_id, s1 AS seq_id FROM pg WHERE k = 3 AND own < parent GROUP BY ALL HAVING count(*) = 2"),
        "breakpoint_view": w(EVENTS + ", bp AS (SELECT dataset_id, event_id, a, b, c, 'begin' AS side, begin AS site FROM ev UNION ALL SELECT dataset_id, event_id, a, b, c, 'end', " + END + " FROM ev), sh AS (SELECT event_id, side, site, dataset_id, k.seq_id, CAST(row_number() OVER (PARTITION BY event_id, side ORDER BY k.seq_id NOT IN (a, b, c), k.seq_id) AS INTEGER) AS row FROM bp JOIN counts k USING (dataset_id)), o AS (SELECT *, CAST(o AS INTEGER) AS offset_, CAST(((site + o - 1) % 64 + 64) % 64 + 1 AS INTEGER) AS pos FROM sh CROSS JOIN range(-10, 11) g(o) WHERE row <= 5)", "SELECT event_id, side, o.seq_id, row, offset_ AS \"offset\", o.pos, st FROM o JOIN cells c ON c.dataset_id = o.dataset_id AND c.seq_id = o.seq_id AND c.pos = o.pos"),
        "review_edits": "WITH l AS (SELECT (event_id * 7) % 500 AS event_id, event_id AS edit_id, ts, CASE WHEN event_id % 3 = 0 THEN CAST(trunc(value) AS INTEGER) % 64 + 1 END AS b, CASE WHEN event_id % 2 = 0 THEN CAST(trunc(value) AS INTEGER) % 64 + 1 END AS e FROM events) SELECT event_id, arg_max(b, (ts, edit_id)) FILTER (b IS NOT NULL) AS begin, arg_max(e, (ts, edit_id)) FILTER (e IS NOT NULL) AS " + END + " FROM l GROUP BY event_id",
        "event_csv": w(EVENTS, "SELECT event_id, event_id || ',' || method || ',' || recombinant || ',' || begin || ',' || " + END + " AS line FROM ev"),
        "tract_fasta": w(EVENTS, "SELECT event_id, s.seq_id, string_agg(substr('-ACGT', CAST(st + 1 AS INTEGER), 1), '' ORDER BY CASE WHEN pos >= begin THEN pos ELSE pos + 64 END) AS sequence FROM ev JOIN cells s ON s.dataset_id = ev.dataset_id AND s.seq_id = ev.recombinant WHERE CASE WHEN begin <= " + END + " THEN pos BETWEEN begin AND " + END + " ELSE pos >= begin OR pos <= " + END + " END GROUP BY event_id, s.seq_id"),
        "readers_roundtrip": w(CELLS, "SELECT dataset_id, seq_id, 's' || seq_id AS name, " + FASTA + " AS sequence FROM cells GROUP BY dataset_id, seq_id"),
        "project_roundtrip": w(CELLS, "SELECT dataset_id, seq_id, 's' || seq_id AS name, " + FASTA + " AS sequence, 'enabled' AS row_state FROM cells GROUP BY dataset_id, seq_id"),
        "siegmund": f"WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) + 10.0 AS u, l_linenumber + 20.0 AS m, l_linenumber + 12.0 AS d FROM lineitem), x AS (SELECT *, u + m AS n, m - u AS x, d - 0.5 AS b FROM q), h AS (SELECT *, (2 * b - x) / n AS h FROM x), t AS (SELECT *, {_tail('h')} AS t FROM h), v AS (SELECT *, (1 - t) / (2 * h * (h * (1 - t / 2) + exp(-h * h / 2) * 0.3989422804014327)) AS nu FROM t) SELECT l_orderkey, l_linenumber, round(CASE WHEN d <= x THEN 1.0 ELSE 1 - exp(-nu * nu * (1 + 2 * h * (b - x)) * exp(-2 * b * (b - x) / n)) END, 9) AS p FROM v",
        "scalar_functions": f"SELECT l_orderkey, l_linenumber, round({_tail('z')}, 9) AS tail, round(CASE WHEN q + r > 0 AND 100 - q - r > 0 THEN pow(q * (50.0 - r) - (50.0 - q) * r, 2) * 2.0 / (50.0 * (q + r) * (100.0 - q - r)) ELSE 0.0 END, 6) AS chi, round(least(1.0, p * 120), 9) AS bonferroni, round(1 - pow(1 - p, 120), 9) AS sidak, round(round_even(h, 0), 1) AS half_even FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / 6.0 AS z, CAST(l_quantity AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS r, CAST(l_linenumber AS DOUBLE) / 100.0 AS p, CAST(l_quantity AS DOUBLE) / 4.0 AS h FROM lineitem)",
    }
    return out
