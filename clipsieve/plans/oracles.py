"""What each query of the catalogue must return, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from clipsieve.functions.scalar import PALETTE
from clipsieve.functions.vocab import ADJECTIVES, AUXILIARIES, CLOTHING, PREPOSITIONS, QUANTITIES
from clipsieve.plans.fixtures import NOUNS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ENTITIES = _list([*NOUNS, *(f"{n}s" for n in NOUNS)])
ADJ, DESC = _list(ADJECTIVES), _list([*ADJECTIVES, *CLOTHING])
ITEM_RE = r"^\[(\w+)\]\s*(.+?)\s*->\s*(.+)"
SINGULAR = f"CASE WHEN list_contains({_list(NOUNS)}, w) THEN w ELSE w[:-2] END"

ITEMS = """
item AS (SELECT l_orderkey AS video, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, t) - 1 AS q_idx, t AS item FROM (
  SELECT l.*, CASE WHEN l_quantity = 50 THEN 'no brackets ' || p_name
    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '[CW] why did two ' || p_name || 's run -> y'
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '[TN] what is the ' || split_part(p_name, ' ', -1) || ' in ' || split_part(p_name, ' ', 1) || ' doing -> x'
    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '[DC] where did they go -> z'
    WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '[DL] what does the ' || p_name || ' do after the big anvil falls -> x'
    ELSE '[TN] what does the ' || p_name || ' do -> x' END AS t
  FROM lineitem l JOIN part ON p_partkey = l_partkey) u)"""

PARSED = (
    ITEMS
    + f""",
parsed AS (SELECT video, q_idx, item, CASE WHEN m THEN regexp_extract(item, '{ITEM_RE}', 1) END AS qtype, CASE WHEN m THEN regexp_extract(item, '{ITEM_RE}', 2) END AS question,
  CASE WHEN m THEN regexp_extract(item, '{ITEM_RE}', 3) END AS answer FROM (SELECT *, regexp_matches(item, '{ITEM_RE}') AS m FROM item) z)"""
)

TOKENS = (
    PARSED
    + """,
tok AS (SELECT video, q_idx, list_transform(list_filter(string_split_regex(lower(question), '\\s+'), lambda x: x <> ''), lambda x: ltrim(rtrim(x, '.,?!;:''"'), '''"')) AS t FROM parsed WHERE question IS NOT NULL)"""
)


def _mentions(source: str, positions: str) -> str:
    """Mentions at the given positions (from 1) of the token lists t in source."""
    return f"""
hit AS (SELECT video, q_idx, t, unnest({positions}) AS i FROM {source}),
near AS (SELECT *, t[i] AS w, coalesce(list_max(list_filter(range(1, i), lambda j: NOT list_contains({ADJ}, t[j]) AND NOT list_contains({_list(QUANTITIES)}, t[j]))), 0) AS blk,
  CASE WHEN i < len(t) AND list_contains({_list(PREPOSITIONS)}, t[i + 1]) THEN t[i + 2 : least(len(t), i + 5)] ELSE [] END AS ahead FROM hit),
cut AS (SELECT *, t[blk + 1 : i - 1] AS bef, coalesce(list_min(list_filter(range(1, len(ahead) + 1), lambda k: NOT list_contains({DESC}, ahead[k]) AND ahead[k] <> 'the')), len(ahead) + 1) AS stop FROM near),
parts AS (SELECT *, list_filter(bef, lambda x: list_contains({ADJ}, x)) AS adj, list_filter(ahead[1 : stop - 1], lambda x: x <> 'the') AS des FROM cut),
mention AS (SELECT video, q_idx, array_to_string(adj || [w] || CASE WHEN len(des) > 0 THEN [t[i + 1]] || des ELSE [] END, ' ') AS mention, w AS noun, {SINGULAR} AS singular,
  (NOT list_contains({_list(NOUNS)}, w)) OR len(list_filter(bef, lambda x: list_contains({_list(QUANTITIES)}, x))) > 0 AS is_plural, CAST(i - 1 AS BIGINT) AS position,
  CASE WHEN len(des) > 0 THEN des[1] WHEN len(adj) > 0 THEN adj[1] ELSE '' END AS desc_key FROM parts)"""


REST = f""",
aux AS (SELECT *, list_min(list_filter(range(2, len(t) + 1), lambda i: list_contains({_list(AUXILIARIES)}, t[i]))) AS a FROM tok),
rest AS (SELECT video, q_idx, CASE WHEN a IS NULL THEN t ELSE t[a + 1 : len(t)] END AS t FROM aux),"""
SUBJECTS = TOKENS + REST + _mentions("rest", f"list_filter(range(1, len(t) + 1), lambda i: list_contains({ENTITIES}, t[i]))[1:1]").replace("mention AS (", "subj AS (")
CLUSTERS = SUBJECTS + ", clus AS (SELECT video, singular, desc_key, count(*) AS cnt, min(q_idx) AS first_pos FROM subj GROUP BY ALL)"
MERGED = (
    CLUSTERS
    + """,
target AS (SELECT video, singular, min(desc_key) AS d FROM clus WHERE desc_key <> '' GROUP BY ALL HAVING count(*) = 1),
mrg AS (SELECT s.* EXCLUDE (desc_key), s.desc_key = '' AND d IS NOT NULL AS was_bare, CASE WHEN s.desc_key = '' AND d IS NOT NULL THEN d ELSE s.desc_key END AS desc_key FROM subj s LEFT JOIN target USING (video, singular))"""
)
SCORED = (
    MERGED
    + """,
agg AS (SELECT video, singular, desc_key, count(*) AS cnt, min(CASE WHEN NOT was_bare THEN q_idx END) AS first_pos, bool_or(is_plural) AS pl, sum(len(string_split(mention, ' '))) AS words FROM mrg GROUP BY ALL),
sco AS (SELECT *, CAST(cnt * 10 - CASE WHEN pl THEN 15 ELSE 0 END + CASE WHEN desc_key <> '' THEN 5 ELSE 0 END + CASE WHEN words / cnt > 1.5 THEN 3 ELSE 0 END - CASE WHEN singular = 'anvil' THEN 10 ELSE 0 END AS BIGINT) AS score FROM agg)"""
)
PICK = """,
pick AS (SELECT * FROM (SELECT video, singular, desc_key, mention AS prompt_word, row_number() OVER (PARTITION BY video, singular, desc_key ORDER BY contains(mention, ' ') DESC, count(*) DESC, min(CASE WHEN was_bare THEN 1000000 ELSE 0 END + q_idx)) AS r FROM mrg GROUP BY video, singular, desc_key, mention) q WHERE r = 1)"""
SELECTED = (
    SCORED
    + PICK
    + """,
top AS (SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC, (desc_key <> '') DESC, cnt DESC, first_pos) = 1),
sel AS (SELECT i.video, prompt_word, cnt AS subject_question_count, total_questions, score FROM (SELECT video, count(*) AS total_questions FROM item GROUP BY video) i LEFT JOIN (top JOIN pick USING (video, singular, desc_key)) USING (video))"""
)

DATA = """
data AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS prompt_word, CAST(floor(o_totalprice / 100) AS BIGINT) AS frame_count, o_orderkey AS input_pos, o_orderstatus FROM orders),
idx AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS video_id, '/videos/' || CAST(l_orderkey AS VARCHAR) || '.mp4' AS path FROM lineitem),
cls AS (SELECT video_id, prompt_word, path, CASE WHEN prompt_word IS NULL OR regexp_full_match(prompt_word, '\\s*') THEN 'skipped' WHEN path IS NULL THEN 'failed' WHEN o_orderstatus = 'F' THEN 'skipped' END AS status,
  CASE WHEN prompt_word IS NULL OR regexp_full_match(prompt_word, '\\s*') THEN 'null or empty prompt' WHEN path IS NULL THEN 'video file not found' WHEN o_orderstatus = 'F' THEN 'output already exists' END AS error_message
  FROM data LEFT JOIN idx USING (video_id))"""
RUN = DATA + ", run AS (SELECT video_id, CASE CAST(video_id AS BIGINT) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'dry_run' WHEN 2 THEN 'skipped' ELSE 'success' END AS status FROM cls WHERE status IS NULL AND CAST(video_id AS BIGINT) % 7 <> 6)"
FRAMES = "fr AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_type, least(value / 200.0, 1.0) AS score FROM events)"
VIDEOS = "vid AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY 1)"
_MASK = """mask AS (SELECT DISTINCT CAST(floor((epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01')) / {seconds}) AS BIGINT) AS frame,
  CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS obj, user_id % 150 AS px FROM events)"""
DAY, HOUR = _MASK.format(seconds=86400), _MASK.format(seconds=3600)
AREA = ", area AS (SELECT frame, obj, count(*) AS area FROM mask GROUP BY ALL)"


def _square(source: str, r: int, keys: str = "frame") -> str:
    return f"SELECT DISTINCT {keys}, (px // 15 + dy) * 15 + px % 15 + dx AS px FROM {source}, range(-{r}, {r + 1}) a(dx), range(-{r}, {r + 1}) b(dy) WHERE px % 15 + dx BETWEEN 0 AND 14 AND px // 15 + dy BETWEEN 0 AND 9"


def _eroded(source: str, r: int) -> str:
    grid = f"SELECT frame, px, CASE WHEN px % 15 + dx BETWEEN 0 AND 14 AND px // 15 + dy BETWEEN 0 AND 9 THEN (px // 15 + dy) * 15 + px % 15 + dx ELSE -1 END AS q FROM {source}, range(-{r}, {r + 1}) a(dx), range(-{r}, {r + 1}) b(dy)"
    return f"SELECT g.frame, g.px FROM ({grid}) g LEFT JOIN {source} s ON s.frame = g.frame AND s.px = g.q GROUP BY g.frame, g.px HAVING count(*) = count(s.px)"


GROUPS = (
    HOUR
    + """,
grown AS (SELECT DISTINCT frame, obj, (px // 15 + dy) * 15 + px % 15 + dx AS px FROM mask, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) WHERE px % 15 + dx BETWEEN 0 AND 14 AND px // 15 + dy BETWEEN 0 AND 9),
edge AS (SELECT DISTINCT a.frame, a.obj AS a, b.obj AS b FROM grown a JOIN grown b ON a.frame = b.frame AND a.px = b.px),
reach(frame, a, b) AS (SELECT frame, a, b FROM edge UNION SELECT r.frame, r.a, e.b FROM reach r JOIN edge e ON r.frame = e.frame AND r.b = e.a),
grp AS (SELECT frame, obj, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS grp FROM (SELECT frame, a AS obj, min(b) AS root FROM reach GROUP BY ALL) z)"""
)
#: Spots on frames of real size, as fixtures.hd_runs makes them.
HD = """spot AS (SELECT CAST(floor((epoch(date_trunc('hour', ts)) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS frame,
  CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) + 5 * (user_id % 4) AS obj,
  (user_id * 7919 + event_id * 104729) % 1850 AS x, (user_id * 6007 + event_id * 75011) % 1060 AS top, 20 + event_id % 41 AS w, unnest(range(0, 6 + user_id % 11)) AS k FROM events),
raw AS (SELECT frame, obj, top + k AS y, x + k * k % 5 AS x0, x + k * k % 5 + w - k % 3 AS x1 FROM spot)"""


def _islands(source: str, lines: str, keys: str = "") -> str:
    """Runs of a line that overlap or adjoin (for links: overlap) as one island each, told by its beginning."""
    return f"""SELECT *, max(CASE WHEN fresh THEN x0 END) OVER (PARTITION BY {lines} ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, coalesce(x0 {keys or '>'} max(x1) OVER (PARTITION BY {lines} ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM {source}) z"""


def _runs(source: str, lines: str) -> str:
    return f"SELECT {lines}, min(x0) AS x0, max(x1) AS x1 FROM ({_islands(source, lines)}) z GROUP BY {lines}, island"


HD_RUNS = f"WITH RECURSIVE {HD}, run AS MATERIALIZED ({_runs('raw', 'frame, obj, y')})"
#: Every run moved to each line of the ellipse, unlike the engine, which leaves out what neighbours cover.
_HD_MOVED = "SELECT frame, obj, y + dy AS y, greatest(x0 - CAST(round(sqrt(2500 - dy * dy)) AS BIGINT), 0) AS x0, least(x1 + CAST(round(sqrt(2500 - dy * dy)) AS BIGINT), 1920) AS x1 FROM run, range(-50, 51) t(dy) WHERE y + dy BETWEEN 0 AND 1079"
HD_GROUPS = f"""{HD_RUNS}, moved AS ({_HD_MOVED}),
member AS MATERIALIZED (SELECT frame, obj, min(obj) OVER (PARTITION BY frame, y, island) AS low FROM ({_islands('moved', 'frame, y', '>=')}) z),
link AS (SELECT DISTINCT frame, low AS a, obj AS b FROM member UNION SELECT DISTINCT frame, obj, low FROM member),
near(frame, a, b) AS (SELECT frame, a, b FROM link UNION SELECT r.frame, r.a, e.b FROM near r JOIN link e ON r.frame = e.frame AND r.b = e.a),
grp AS (SELECT frame, obj, dense_rank() OVER (PARTITION BY frame ORDER BY root) AS grp FROM (SELECT frame, a AS obj, min(b) AS root FROM near GROUP BY ALL) z)"""
_INDICES = "CASE WHEN n > {m} THEN list_transform(range(0, {m}), lambda i: CASE WHEN i = {m} - 1 THEN n - 1 ELSE CAST(trunc(i * ((n - 1) / CAST({m} - 1 AS DOUBLE))) AS BIGINT) END) ELSE range(0, n) END"
_BLEND = "CAST(floor(0.5 * {v} + 0.5 * {c}) AS BIGINT)"


def _overlay(last: str = "SELECT frame, px, r, g, b FROM s5") -> str:
    steps = [f"s0 AS (SELECT p.frame, p.px, r, g, b, {', '.join(f'coalesce(bool_or(obj = {o}), false) AS o{o}' for o in range(1, 6))} FROM pix p LEFT JOIN mask m ON m.frame = p.frame AND m.px = p.px GROUP BY p.frame, p.px, r, g, b)"]
    for o in range(1, 6):
        cols = ", ".join(f"CASE WHEN o{o} THEN {_BLEND.format(v=ch, c=PALETTE[o - 1][k])} ELSE {ch} END AS {ch}" for k, ch in enumerate("rgb"))
        steps.append(f"s{o} AS (SELECT * EXCLUDE (r, g, b), {cols} FROM s{o - 1})")
    pix = "pix AS (SELECT frame, px, (px * 7 + frame) % 256 AS r, (px * 11 + frame) % 256 AS g, (px * 13 + frame) % 256 AS b FROM (SELECT unnest(range(0, max(frame) + 1)) AS frame FROM mask) f, range(0, 150) t(px))"
    return f"WITH {DAY}, {pix}, {', '.join(steps)} {last}"


#: A step of the ordered fold: st has each video's groups (lists of pixels) after frame number t, dets the detections of
#: frame number t, in order, as structs det and px. A detection joins the first group with the greatest overlap.
_STEP = """
st(video, t, groups) AS (SELECT video, CAST(0 AS BIGINT), groups FROM start UNION ALL
  SELECT video, t + 1, list_transform(range(1, len(groups) + 1), lambda k: list_distinct(flatten(list_transform(list_filter(pick, lambda p: p.g = k), lambda p: p.px)))) FROM (
    SELECT s.video, s.t, s.groups, list_transform(d.dets, lambda x: {'px': x.px, 'g': list_position(list_transform(s.groups, lambda y: len(list_intersect(y, x.px))), list_max(list_transform(s.groups, lambda y: len(list_intersect(y, x.px)))))}) AS pick
    FROM st s JOIN dets d ON d.video = s.video AND d.t = s.t + 1) z),
joined AS (SELECT video, frame, x.det AS det, CAST(list_position(list_transform(groups, lambda y: len(list_intersect(y, x.px))), list_max(list_transform(groups, lambda y: len(list_intersect(y, x.px))))) AS BIGINT) AS g, x.px AS px
  FROM (SELECT d.video, d.frame, s.groups, unnest(d.dets) AS x FROM dets d JOIN st s ON s.video = d.video AND s.t = d.t - 1) z)"""
FOLD = (
    HOUR
    + """,
rows AS (SELECT frame // 24 AS video, frame, obj, px, min(frame) OVER (PARTITION BY frame // 24) AS first FROM mask),
start AS (SELECT video, list_transform(range(1, max(obj) + 1), lambda k: list_transform(list_filter(list({'o': obj, 'p': px}), lambda x: x.o = k), lambda x: x.p)) AS groups FROM rows WHERE frame = first GROUP BY video),
each AS (SELECT video, frame, obj AS det, list(px) AS px FROM rows WHERE frame > first GROUP BY ALL),
dets AS (SELECT video, frame, list({'det': det, 'px': px} ORDER BY det) AS dets, row_number() OVER (PARTITION BY video ORDER BY frame) AS t FROM each GROUP BY video, frame),"""
    + _STEP
)
#: The fold on runs: mine has each detection's common pixels with a union of those of the frame before that have joined a group.
HD_FOLD = f"""{HD_RUNS}, moved AS (SELECT frame, obj, y + dy AS y, greatest(x0 - 40, 0) AS x0, least(x1 + 40, 1920) AS x1 FROM run, range(-40, 41) t(dy) WHERE y + dy BETWEEN 0 AND 1079),
grown AS MATERIALIZED ({_runs('moved', 'frame, obj, y')}),
ord AS (SELECT frame, frame // 24 AS video, row_number() OVER (PARTITION BY frame // 24 ORDER BY frame) - 1 AS t FROM (SELECT DISTINCT frame FROM grown) z),
det AS MATERIALIZED (SELECT video, t, obj AS det, y, x0, x1 FROM grown JOIN ord USING (frame)),
raw0 AS (SELECT video, det % 4 + 1 AS grp, y, x0, x1 FROM det WHERE t = 0),
start AS MATERIALIZED ({_runs('raw0', 'video, grp, y')}),
groups AS (SELECT video, max(grp) AS n FROM start GROUP BY video),
cut AS (SELECT video, t + 1 AS t, y, det AS m, x0, x1 FROM det WHERE t > 0 UNION ALL SELECT video, 1, y, -grp, x0, x1 FROM start),
edges AS (SELECT DISTINCT video, t, y, x0 AS x FROM cut UNION SELECT video, t, y, x1 FROM cut),
piece AS (SELECT video, t, y, x AS x0, lead(x) OVER (PARTITION BY video, t, y ORDER BY x) AS x1 FROM edges),
atom AS MATERIALIZED (SELECT p.video, p.t, p.y, p.x0, p.x1, list_sort(list(c.m)) AS ms FROM piece p JOIN cut c ON c.video = p.video AND c.t = p.t AND c.y = p.y AND c.x0 <= p.x0 AND c.x1 >= p.x1 GROUP BY ALL),
common AS MATERIALIZED (SELECT d.video, d.t, d.det, a.ms, sum(least(d.x1, a.x1) - greatest(d.x0, a.x0)) AS n FROM det d JOIN atom a ON a.video = d.video AND a.t = d.t AND a.y = d.y AND a.x0 < d.x1 AND d.x0 < a.x1 GROUP BY ALL),
seen AS MATERIALIZED (SELECT video, t, list(DISTINCT det ORDER BY det) AS dets FROM det WHERE t > 0 GROUP BY ALL),
pairs AS MATERIALIZED (SELECT s.video, s.t, s.dets, list({{'ms': c.ms, 'n': c.n, 'det': c.det}}) AS cs FROM seen s LEFT JOIN common c ON c.video = s.video AND c.t = s.t GROUP BY ALL),
step(video, t, pick) AS (SELECT video, CAST(0 AS BIGINT), list_transform(range(1, n + 1), lambda g: {{'m': -g, 'g': g}}) FROM groups UNION ALL
  SELECT video, t + 1, list_transform(dets, lambda d: {{'m': d, 'g': list_position(list_transform(ov, lambda o: o[list_position(dets, d)]), list_max(list_transform(ov, lambda o: o[list_position(dets, d)])))}}) FROM (
    SELECT s.video, s.t, p.dets, list_transform(range(1, g.n + 1), lambda k: list_transform(p.dets, lambda d: coalesce(list_sum(list_transform(list_filter(p.cs, lambda c: c.det = d AND list_has_any(c.ms, list_transform(list_filter(s.pick, lambda q: q.g = k), lambda q: q.m))), lambda c: c.n)), 0))) AS ov
    FROM step s JOIN pairs p ON p.video = s.video AND p.t = s.t + 1 JOIN groups g ON g.video = s.video) z)
SELECT video, frame, q.m AS det, q.g AS grp FROM (SELECT video, t, unnest(pick) AS q FROM step WHERE t > 0) z JOIN ord USING (video, t)"""
DETECTED = HOUR + ", det AS (SELECT frame // 24 AS video, frame % 24 AS frame, obj - 1 AS det, px, (frame % 24 * 7 + (obj - 1) * 13 + frame // 24) % 20 / 20.0::DOUBLE AS score FROM mask), vids AS (SELECT video, max(frame) + 1 AS n FROM det GROUP BY video)"
SEGMENT_ONE = (
    DETECTED
    + """,
big AS (SELECT video, frame, det FROM det WHERE score >= 0.5 GROUP BY video, frame, det QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY count(*) DESC, det) = 1),
sel AS (SELECT video, det + 1 AS selected FROM big WHERE frame = 0),
seg AS (SELECT d.video, d.frame, selected AS obj, px FROM det d JOIN big b ON b.video = d.video AND b.frame = d.frame AND b.det = d.det JOIN sel ON sel.video = d.video)"""
)
_NEAR = """
grown AS (SELECT DISTINCT video, {o}, (px // 15 + dy) * 15 + px % 15 + dx AS px FROM {source}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) WHERE px % 15 + dx BETWEEN 0 AND 14 AND px // 15 + dy BETWEEN 0 AND 9),
edge AS (SELECT DISTINCT a.video, a.{o} AS a, b.{o} AS b FROM grown a JOIN grown b ON a.video = b.video AND a.px = b.px {more}),
reach(video, a, b) AS (SELECT video, a, b FROM edge UNION SELECT r.video, r.a, e.b FROM reach r JOIN edge e ON r.video = e.video AND r.b = e.a),
grp AS (SELECT video, {o}, dense_rank() OVER (PARTITION BY video ORDER BY root) AS grp FROM (SELECT video, a AS {o}, min(b) AS root FROM reach GROUP BY ALL) z)"""
SEGMENT_MANY = (
    DETECTED
    + ", sure AS (SELECT * FROM det WHERE score >= 0.5), first AS (SELECT video, det, px FROM sure WHERE frame = 0),"
    + _NEAR.format(o="det", source="first", more="")
    + """,
start AS (SELECT video, list_transform(range(1, max(grp) + 1), lambda k: list_distinct(list_transform(list_filter(list({'o': grp, 'p': px}), lambda x: x.o = k), lambda x: x.p))) AS groups FROM first JOIN grp USING (video, det) GROUP BY video),
spine AS (SELECT video, unnest(range(1, n)) AS t FROM vids),
each AS (SELECT video, frame AS t, det, list(px) AS px FROM sure GROUP BY ALL),
dets AS (SELECT s.video, s.t, s.t AS frame, coalesce(list({'det': det, 'px': px} ORDER BY det) FILTER (det IS NOT NULL), []) AS dets FROM spine s LEFT JOIN each e ON e.video = s.video AND e.t = s.t GROUP BY ALL),"""
    + _STEP
    + """,
seg AS (SELECT DISTINCT video, CAST(0 AS BIGINT) AS frame, grp AS obj, px FROM first JOIN grp USING (video, det) UNION SELECT DISTINCT video, frame, g AS obj, unnest(px) AS px FROM joined)"""
)
PROMPTED = (
    DETECTED
    + """, two AS (SELECT video, frame, det AS prompt, px % 2 AS side, px FROM det WHERE score >= 0.2),
big AS (SELECT video, frame, prompt, side FROM two GROUP BY video, frame, prompt, side QUALIFY row_number() OVER (PARTITION BY video, frame, prompt ORDER BY count(*) DESC, side) = 1),
own AS (SELECT two.* FROM two JOIN big USING (video, frame, prompt, side)), first AS (SELECT * FROM own WHERE frame = 0),"""
    + _NEAR.format(o="prompt", source="first", more="UNION SELECT video, p, p FROM vids, range(0, 5) t(p)")
    + ", seg AS (SELECT DISTINCT video, frame, grp AS obj, px FROM own JOIN grp USING (video, prompt))"
)
_SOME = "list_transform(range(0, 10), lambda i: CASE WHEN i = 9 THEN m - 1 ELSE CAST(trunc(i * ((m - 1) / 9.0::DOUBLE)) AS BIGINT) END)"
TRACKED = (
    DETECTED
    + f""",
sure AS (SELECT * FROM det WHERE score >= 0.5),
top AS (SELECT video, frame, arg_min(det, (-score, det)) AS det, max(score) AS sc FROM sure GROUP BY ALL),
cand AS (SELECT top.*, n FROM top JOIN vids USING (video) WHERE frame % 5 = 0 OR frame = n - 1),
anchor AS (SELECT video, frame AS a, det, sc, n FROM cand QUALIFY row_number() OVER (PARTITION BY video ORDER BY sc >= 0.9 DESC, CASE WHEN sc >= 0.9 THEN frame END, sc DESC, frame) = 1),
shape AS (SELECT a.video, a, sc, n, list(DISTINCT px) AS anchor FROM anchor a JOIN sure s ON s.video = a.video AND s.frame = a.a AND s.det = a.det WHERE sc >= 0.3 GROUP BY ALL),
way AS (SELECT video, 'f' AS dir, 1 AS step, n - a AS m, a, anchor FROM shape UNION ALL SELECT video, 'b', -1, a + 1, a, anchor FROM shape WHERE a > 0),
pas AS (SELECT video, dir, m, a, anchor, pos, a + step * pos AS frame, m <= 10 OR list_contains({_SOME}, pos) AS kept FROM (SELECT *, unnest(range(0, m)) AS pos FROM way) z),
trk AS (SELECT video, dir, pos, list_transform(list_filter(anchor, lambda p: (p + frame) % 3 <> 0), lambda p: (p + frame) % 150) AS px FROM pas WHERE kept AND pos % 7 <> 6),
fil AS (SELECT p.video, p.dir, p.frame, t.px FROM pas p JOIN trk t ON t.video = p.video AND t.dir = p.dir AND (p.m > 10 OR t.pos = p.pos) QUALIFY row_number() OVER (PARTITION BY p.video, p.dir, p.pos ORDER BY abs(t.pos - p.pos), t.pos) = 1),
both_ways AS (SELECT coalesce(f.video, b.video) AS video, coalesce(f.frame, b.frame) AS frame, CASE WHEN len(f.px) > 0 OR b.px IS NULL THEN f.px ELSE b.px END AS px FROM (SELECT * FROM fil WHERE dir = 'f') f FULL JOIN (SELECT * FROM fil WHERE dir = 'b') b ON f.video = b.video AND f.frame = b.frame),
spine AS (SELECT video, a, sc, len(anchor) AS area0, unnest(range(0, n)) AS frame FROM shape),
got AS (SELECT s.*, list_distinct(coalesce(px, [])) AS px FROM spine s LEFT JOIN both_ways w ON w.video = s.video AND w.frame = s.frame),
checked AS (SELECT *, len(px) AS area, len(px) > 0 AND (len(px) > 3.0 * area0 OR len(list_filter(px, lambda p: p < 60)) / greatest(len(px), 1) < 0.1) AS flagged FROM got)"""
)
BATCH = DATA + """, bat AS (SELECT video_id, prompt_word, path, id, frame_count, frame_count / 29.97::DOUBLE AS dur, CASE WHEN id % 19 = 0 THEN 'done' WHEN id % 17 = 0 THEN 'unknown' WHEN id % 11 = 0 THEN 'raises' WHEN id % 13 = 0 THEN 'empty' ELSE 'good' END AS kind
  FROM (SELECT cls.*, frame_count, input_pos AS id FROM cls JOIN data USING (video_id)) z WHERE status IS NULL)"""

_MOVED = "list_transform(list_filter({px}, lambda p: (p + {frame}) % 4 <> 0), lambda p: (p + 1) % 150)"
#: Each mask out of the one before, along both passes.
FOLLOWED = TRACKED.partition("pas AS")[0] + f"""
walk(video, dir, pos, frame, px) AS (SELECT video, dir, CAST(0 AS BIGINT), a, {_MOVED.format(px="anchor", frame="a")} FROM way
  UNION ALL SELECT video, dir, pos + 1, w.a + w.step * (pos + 1), {_MOVED.format(px="px", frame="(w.a + w.step * (pos + 1))")} FROM walk JOIN way w USING (video, dir) WHERE pos + 1 < w.m),
both_ways AS (SELECT coalesce(f.video, b.video) AS video, coalesce(f.frame, b.frame) AS frame, CASE WHEN len(f.px) > 0 OR b.px IS NULL THEN f.px ELSE b.px END AS px
  FROM (SELECT * FROM walk WHERE dir = 'f') f FULL JOIN (SELECT * FROM walk WHERE dir = 'b') b ON f.video = b.video AND f.frame = b.frame)"""


def _color(k: int) -> str:
    return f"[{', '.join(str(c[k]) for c in PALETTE)}][((c_custkey - 4) % 12 + 12) % 12 + 1]"


ORACLES: dict[str, str] = {
    "prompt_select": f"WITH {SELECTED} SELECT * FROM sel",
    "qa_parse": f"WITH {PARSED} SELECT video, q_idx, qtype, question, answer FROM parsed",
    "subject_extract": f"WITH {SUBJECTS} SELECT * FROM subj",
    "entity_mentions": f"WITH {TOKENS}, {_mentions('tok', f'list_filter(range(1, len(t) + 1), lambda i: list_contains({ENTITIES}, t[i]))')} SELECT video, q_idx, position, mention, singular, is_plural, desc_key FROM mention",
    "cluster_counts": f"WITH {CLUSTERS} SELECT * FROM clus",
    "bare_merge": f"WITH {MERGED} SELECT video, singular, desc_key, count(*) AS cnt, count(*) FILTER (was_bare) AS bare FROM mrg GROUP BY ALL",
    "cluster_score": f"WITH {SCORED} SELECT video, singular, desc_key, cnt, first_pos, score FROM sco",
    "top5_candidates": f"WITH {SCORED}, ex AS (SELECT video, singular, desc_key, mention AS example FROM mrg QUALIFY row_number() OVER (PARTITION BY video, singular, desc_key ORDER BY was_bare, q_idx) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, first_pos) AS rank FROM sco) SELECT video, rank, singular || '(' || CASE WHEN desc_key = '' THEN 'generic' ELSE desc_key END || ')' AS entity, score, cnt AS subject_count, example FROM r JOIN ex USING (video, singular, desc_key) WHERE rank <= 5",
    "prompt_pick": f"WITH {MERGED}{PICK} SELECT video, singular, desc_key, prompt_word FROM pick",
    "noun_distribution": f"WITH {SELECTED}, w AS (SELECT list_filter(string_split(prompt_word, ' '), lambda x: list_contains({ENTITIES}, x))[1] AS w, video FROM sel WHERE prompt_word IS NOT NULL) SELECT {SINGULAR} AS noun, count(*) AS n FROM w WHERE w IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(video) LIMIT 15",
    "coverage": f"WITH {SELECTED} SELECT video, subject_question_count, total_questions, subject_question_count / total_questions AS coverage, CASE WHEN 200 * subject_question_count % total_questions = 0 AND 200 * subject_question_count // total_questions % 2 = 1 THEN (200 * subject_question_count // total_questions + CASE 200 * subject_question_count // total_questions % 4 WHEN 1 THEN -1 ELSE 1 END) / 200 ELSE round(subject_question_count / total_questions, 2) END AS coverage_2 FROM sel WHERE prompt_word IS NOT NULL",
    "prompt_counts": f"WITH {SELECTED} SELECT count(*) AS total, count(prompt_word) AS valid, count(*) - count(prompt_word) AS without FROM sel",
    "job_classify": f"WITH {DATA} SELECT * FROM cls",
    "job_lpt_order": f"WITH {DATA} SELECT video_id, frame_count, row_number() OVER (ORDER BY frame_count DESC, input_pos) - 1 AS queue_pos FROM data",
    "results_summary": f"WITH {RUN}, a AS (SELECT true AS p, status FROM cls WHERE status IS NOT NULL UNION ALL SELECT false, status FROM run) SELECT count(*) AS total, count(*) FILTER (NOT p AND status = 'success') AS success, count(*) FILTER (p OR status IN ('skipped', 'dry_run')) AS skipped, count(*) FILTER (NOT p AND status = 'failed') AS failed FROM a",
    "unprocessed_jobs": f"WITH {RUN} SELECT video_id FROM cls WHERE status IS NULL AND video_id NOT IN (SELECT video_id FROM run)",
    "index_last_wins": "SELECT 'clip' || CAST(l_suppkey AS VARCHAR) AS video_id, max('/v/' || CAST(l_linenumber AS VARCHAR) || '/clip' || CAST(l_suppkey AS VARCHAR) || '.mp4') AS path FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1",
    "frame_reduction": f"WITH {DATA}, f AS (SELECT video_id, frame_count, CASE WHEN input_pos % 5 = 0 THEN 0.0 ELSE 29.97 END::DOUBLE AS fps FROM data), g AS (SELECT *, CASE WHEN fps > 0 THEN frame_count / fps ELSE 0.0::DOUBLE END AS duration_sec FROM f) SELECT video_id, frame_count, duration_sec, duration_sec > 60 AS frame_reduction, CASE WHEN duration_sec > 60 THEN CAST(trunc(60.0::DOUBLE * fps) AS BIGINT) END AS max_frames FROM g",
    "uniform_subsample": f"WITH {VIDEOS} SELECT video, CAST(unnest(range(0, len(x))) AS BIGINT) AS pos, unnest(x) AS frame_idx FROM (SELECT video, {_INDICES.format(m=16)} AS x FROM vid) z",
    "fps_resample": f"WITH RECURSIVE {VIDEOS}, walk(video, n, f, due, kept) AS (SELECT video, n, CAST(0 AS BIGINT), CAST(29.97 AS DOUBLE) / CAST(10.0 AS DOUBLE), true FROM vid UNION ALL SELECT video, n, f + 1, CASE WHEN f + 1 >= due THEN due + CAST(29.97 AS DOUBLE) / CAST(10.0 AS DOUBLE) ELSE due END, f + 1 >= due FROM walk WHERE f + 1 < n) SELECT video, f AS frame_idx FROM walk WHERE kept",
    "tracker_subsample": f"WITH {VIDEOS}, x AS (SELECT DISTINCT video, unnest(list_append({_INDICES.format(m=20)}, video % n)) AS frame_idx FROM vid) SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame_idx) - 1 AS pos, frame_idx FROM x",
    "anchor_frame": f"WITH {FRAMES}, c AS (SELECT *, max(frame_idx) OVER (PARTITION BY video) AS last FROM fr), k AS (SELECT * FROM c WHERE frame_idx % 5 = 0 OR frame_idx = last), early AS (SELECT video, min(frame_idx) AS f FROM k WHERE score >= 0.9 GROUP BY video), best AS (SELECT video, frame_idx AS f FROM k QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC, frame_idx) = 1), p AS (SELECT b.video, coalesce(e.f, b.f) AS anchor_idx FROM best b LEFT JOIN early e USING (video)) SELECT p.video, anchor_idx, score AS anchor_score, score >= 0.3 AS found FROM p JOIN fr ON fr.video = p.video AND frame_idx = anchor_idx",
    "largest_detection": f"WITH {HOUR}{AREA} SELECT frame AS frame_idx, obj AS det_idx, area FROM area QUALIFY row_number() OVER (PARTITION BY frame ORDER BY area DESC, obj) = 1",
    "nearest_fill": f"WITH {FRAMES}, t AS (SELECT video, frame_idx AS t FROM fr WHERE event_type = 'view'), n AS (SELECT fr.video, frame_idx, t, row_number() OVER (PARTITION BY fr.video, frame_idx ORDER BY abs(frame_idx - t), t) AS r FROM fr LEFT JOIN t USING (video)) SELECT video, frame_idx, t AS source_idx FROM n WHERE r = 1",
    "fwd_bwd_merge": f"WITH {HOUR}{AREA}, f AS (SELECT frame AS frame_idx, CASE WHEN frame % 4 = 0 THEN 0 ELSE area END AS fa FROM area WHERE obj = 1), b AS (SELECT frame AS frame_idx, CASE WHEN frame % 4 = 0 THEN 0 ELSE area END AS ba FROM area WHERE obj = 3) SELECT frame_idx, CASE WHEN fa > 0 THEN fa ELSE coalesce(ba, fa) END AS area, CASE WHEN fa > 0 OR ba IS NULL THEN 'forward' ELSE 'backward' END AS direction FROM f FULL JOIN b USING (frame_idx)",
    "spine_fill": f"WITH {HOUR}{AREA} SELECT f AS frame_idx, coalesce(area, 0) AS area, area IS NOT NULL AS tracked FROM (SELECT unnest(range(0, max(frame) + 1)) AS f FROM mask) s LEFT JOIN (SELECT * FROM area WHERE obj = 5) a ON a.frame = f",
    "track_counters": f"WITH {HOUR}{AREA} SELECT count(*) AS frames, count(area) AS tracked, count(*) - count(area) AS empty FROM (SELECT unnest(range(0, max(frame) + 1)) AS f FROM mask) s LEFT JOIN (SELECT * FROM area WHERE obj = 5) a ON a.frame = f",
    "mask_area": f"WITH {DAY}{AREA} SELECT * FROM area",
    "mask_area_bitmap": f"WITH {DAY}{AREA} SELECT * FROM area",
    "mask_union": f"WITH {DAY} SELECT frame, count(DISTINCT px) AS area FROM mask GROUP BY frame",
    "mask_union_bitmap": f"WITH {DAY} SELECT frame, count(DISTINCT px) AS area FROM mask GROUP BY frame",
    "mean_mask_area": f"WITH {DAY} SELECT count(*) AS total_area, count(*) / (150 * (max(frame) + 1)) AS mean_area_frac FROM mask",
    "proximity_groups_hd": f"{HD_GROUPS} SELECT frame, obj, grp FROM grp",
    "group_union_hd": f"{HD_GROUPS}, own AS (SELECT frame, grp, y, x0, x1 FROM run JOIN grp USING (frame, obj)) SELECT frame, grp, CAST(sum(x1 - x0) AS BIGINT) AS area FROM ({_runs('own', 'frame, grp, y')}) z GROUP BY ALL",
    "mask_dilate_hd": f"{HD_RUNS}, moved AS ({_HD_MOVED}) SELECT frame, obj, count(*) AS runs, CAST(sum(x1 - x0) AS BIGINT) AS area FROM ({_runs('moved', 'frame, obj, y')}) z GROUP BY ALL",
    "mask_overlap_pairs_hd": f"{HD_RUNS} SELECT a.frame, a.obj AS a, b.obj AS b, CAST(sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS BIGINT) AS overlap FROM run a JOIN run b ON a.frame = b.frame AND a.y = b.y AND a.obj < b.obj AND a.x0 < b.x1 AND b.x0 < a.x1 GROUP BY ALL",
    "assign_groups_hd": HD_FOLD,
    "mask_overlap_pairs": f"WITH {DAY} SELECT a.frame, a.obj AS a, b.obj AS b, count(*) AS overlap FROM mask a JOIN mask b ON a.frame = b.frame AND a.px = b.px AND a.obj < b.obj GROUP BY ALL",
    "mask_dilate": f"WITH {HOUR} {_square('mask', 1, 'frame, obj')}",
    # Rows of an ellipse of radius 3 reach 0, 2, 3, 3, 3, 2, 0 cells to both sides.
    "mask_dilate_ellipse": f"WITH {HOUR} SELECT DISTINCT frame, obj, (px // 15 + dy) * 15 + px % 15 + dx AS px FROM mask, range(-3, 4) a(dx), range(-3, 4) b(dy) WHERE abs(dx) <= [3, 3, 2, 0][abs(dy) + 1] AND px % 15 + dx BETWEEN 0 AND 14 AND px // 15 + dy BETWEEN 0 AND 9",
    "mask_erode": f"WITH {DAY}, one AS (SELECT DISTINCT frame // 5 AS frame, px FROM mask) {_eroded('one', 1)}",
    "mask_preprocess": f"WITH {DAY}, one AS (SELECT DISTINCT frame // 5 AS frame, px FROM mask), er AS ({_eroded('one', 1)}), di AS ({_square('er', 2)}) SELECT frame, count(*) AS area, CAST(sum(px) AS BIGINT) AS px_sum FROM di GROUP BY frame",
    "proximity_groups": f"WITH RECURSIVE {GROUPS} SELECT frame, obj, grp FROM grp",
    "group_union": f"WITH RECURSIVE {GROUPS} SELECT frame, grp, count(DISTINCT px) AS area FROM mask JOIN grp USING (frame, obj) GROUP BY ALL",
    "area_gate": f"WITH {HOUR}{AREA}, an AS (SELECT obj, min(area) AS a FROM area WHERE frame < 24 GROUP BY obj) SELECT frame, obj, CASE WHEN area > 3.0 * a THEN 0 ELSE area END AS area, area > 3.0 * a AS flagged FROM area JOIN an USING (obj)",
    "overlap_gate": f"WITH {DAY}, g AS (SELECT m.frame, m.obj, count(*) AS area, count(s.px) AS overlap FROM (SELECT * FROM mask WHERE obj <> 5) m LEFT JOIN (SELECT * FROM mask WHERE obj = 5 AND px < 30) s ON s.frame = m.frame AND s.px = m.px GROUP BY ALL) SELECT frame, obj, CASE WHEN overlap / greatest(area, 1) < 0.10 THEN 0 ELSE area END AS area, overlap, overlap / greatest(area, 1) < 0.10 AS flagged FROM g",
    "cosine_gate": "WITH a AS (SELECT label, arg_min(embedding, vec_id) AS an FROM embeddings GROUP BY label) SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings JOIN a USING (label) WHERE list_cosine_similarity(embedding::DOUBLE[], an::DOUBLE[]) >= 0.35",
    "object_color": f"SELECT c_custkey - 3 AS object_id, CAST({_color(0)} AS BIGINT) AS r, CAST({_color(1)} AS BIGINT) AS g, CAST({_color(2)} AS BIGINT) AS b FROM customer",
    "overlay_blend": _overlay(),
    "overlay_clips": _overlay("SELECT row_number() OVER (ORDER BY frame) - 1 AS frame_idx, md5(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY px)) AS digest FROM s5 WHERE frame IN (SELECT frame FROM mask) GROUP BY frame"),
    "frames_with_masks": f"WITH {HOUR} SELECT f AS frame, count(DISTINCT obj) AS n_masks FROM (SELECT unnest(range(0, max(frame) + 1)) AS f FROM mask) s LEFT JOIN mask ON frame = f GROUP BY f",
    "video_id": r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') || '_' || substr(md5(url), 1, 8) AS video_id FROM pages",
    "cover_crop": "WITH p AS (SELECT p_partkey, p_size * 16 AS w0, (p_partkey % 40 + 1) * 16 AS h0 FROM part), s AS (SELECT *, greatest(512::DOUBLE / w0, 256::DOUBLE / h0) AS k FROM p), c AS (SELECT p_partkey, CAST(ceil(w0 * k) AS BIGINT) AS w, CAST(ceil(h0 * k) AS BIGINT) AS h FROM s) SELECT p_partkey, w, h, CAST(floor((w - 512) / 2) AS BIGINT) AS x, CAST(floor((h - 256) / 2) AS BIGINT) AS y FROM c",
    "working_size": "WITH p AS (SELECT p_partkey, p_size * 40 AS w0, (p_partkey % 60 + 1) * 20 AS h0 FROM part), s AS (SELECT *, greatest(w0, h0) / 512::DOUBLE AS k FROM p), c AS (SELECT p_partkey, CAST(CASE WHEN k > 1 THEN trunc(w0 / k) ELSE w0 END AS BIGINT) AS w, CAST(CASE WHEN k > 1 THEN trunc(h0 / k) ELSE h0 END AS BIGINT) AS h FROM s) SELECT p_partkey, w - w % 8 AS w, h - h % 8 AS h FROM c",
    "status_json": f"""WITH {DATA} SELECT '{{"video_id":"' || video_id || '"' || CASE WHEN prompt_word IS NULL THEN '' ELSE ',"prompt_word":"' || prompt_word || '"' END || ',"status":"' || status || '","error_message":"' || error_message || '"}}' AS json FROM cls WHERE status IS NOT NULL""",
    "frame_names": f"WITH {FRAMES} SELECT video, frame_idx, 'frame_' || lpad(CAST(frame_idx AS VARCHAR), 6, '0') || '.png' AS name FROM fr",
    "required_missing": "SELECT n_name AS name FROM nation WHERE n_regionkey >= 3",
    "prompt_list": "WITH s AS (SELECT p_partkey, string_split(array_to_string(list_filter([p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 5 = 0 THEN '' END], lambda x: x IS NOT NULL), ' , '), ',') AS x FROM part) SELECT p_partkey, CAST(unnest(range(0, len(x))) AS BIGINT) AS pos, trim(unnest(x)) AS prompt FROM s",
    "saved_subset": f"WITH {DAY} SELECT obj, count(*) AS pixels, count(DISTINCT frame) AS frames FROM mask WHERE frame < 12 GROUP BY obj",
    "latest_file": "WITH f AS (SELECT user_id, ts, '/v/' || event_type || '/' || CASE WHEN event_id % 50 = 0 THEN 'edited.mp4' ELSE CAST(event_id AS VARCHAR) || '.mp4' END AS path FROM events) SELECT user_id, path FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ends_with(path, '/edited.mp4') DESC, ts DESC, path DESC) = 1",
    "assign_groups": f"WITH RECURSIVE {FOLD} SELECT video, frame, det, g AS \"group\" FROM joined",
    "segment_one": f"WITH {SEGMENT_ONE} SELECT video, frame, obj, count(*) AS area, CAST(sum(px) AS BIGINT) AS px_sum FROM seg GROUP BY ALL",
    "segment_one_header": f"WITH {SEGMENT_ONE} SELECT v.video, any_value(selected) AS selected, any_value(n) AS n_frames, count(px) AS total_area, count(px) / (150 * any_value(n)) AS mean_area_frac, CASE WHEN any_value(selected) IS NULL THEN 'no objects found' END AS error FROM vids v LEFT JOIN sel ON sel.video = v.video LEFT JOIN seg ON seg.video = v.video GROUP BY v.video",
    "segment_many": f"WITH RECURSIVE {SEGMENT_MANY} SELECT video, frame, obj, count(*) AS area, CAST(sum(px) AS BIGINT) AS px_sum FROM seg GROUP BY ALL",
    "segment_many_header": f"""WITH RECURSIVE {SEGMENT_MANY}, mem AS (SELECT video, grp, '"' || grp || '":[' || string_agg(CAST(det AS VARCHAR), ',' ORDER BY det) || ']' AS m, count(*) AS c FROM grp GROUP BY video, grp),
info AS (SELECT video, '{{"multi_object":true,"num_raw_detections":' || CAST(sum(c) AS BIGINT) || ',"num_groups":' || count(*) || ',"merge_proximity_px":1,"groups":{{' || string_agg(m, ',' ORDER BY grp) || '}}}}' AS merge_info FROM mem GROUP BY video),
area AS (SELECT video, count(*) AS total_area FROM seg GROUP BY video)
SELECT v.video, coalesce(total_area, 0) AS total_area, merge_info, CASE WHEN merge_info IS NULL THEN 'no objects found' END AS error FROM vids v LEFT JOIN info USING (video) LEFT JOIN area USING (video)""",
    "segment_prompts": f"WITH RECURSIVE {PROMPTED} SELECT video, frame, obj, count(*) AS area, CAST(sum(px) AS BIGINT) AS px_sum FROM seg GROUP BY ALL",
    "segment_prompts_header": f"""WITH RECURSIVE {PROMPTED}, mem AS (SELECT video, grp, '"' || grp || '":[' || string_agg('"' || ['cup', 'dog', 'hat', 'kite', 'rope'][prompt + 1] || '"', ',' ORDER BY prompt) || ']' AS m FROM grp GROUP BY video, grp),
info AS (SELECT video, '{{"multi_prompt":true,"prompts":["cup","dog","hat","kite","rope"],"num_groups":' || count(*) || ',"merge_proximity_px":1,"groups":{{' || string_agg(m, ',' ORDER BY grp) || '}}}}' AS merge_info FROM mem GROUP BY video),
area AS (SELECT video, count(*) AS total_area FROM seg GROUP BY video)
SELECT video, n AS n_frames, coalesce(total_area, 0) AS total_area, coalesce(total_area, 0) / (150 * n) AS mean_area_frac, merge_info FROM vids JOIN info USING (video) LEFT JOIN area USING (video)""",
    "segment_tracked": f"WITH {TRACKED} SELECT video, frame, 1 AS obj, count(*) AS area, CAST(sum(p) AS BIGINT) AS px_sum FROM (SELECT video, frame, unnest(px) AS p FROM checked WHERE NOT flagged) z GROUP BY ALL",
    "segment_tracked_header": f"WITH {TRACKED}, i AS (SELECT video, any_value(a) AS anchor_frame, any_value(sc) AS anchor_score, any_value(area0) / 150 * 100 AS anchor_area_percent, count(*) FILTER (area > 0) AS propagated, count(*) FILTER (area > 0 AND NOT flagged) AS verified, count(*) FILTER (flagged) AS flagged, CAST(sum(CASE WHEN flagged THEN 0 ELSE area END) AS BIGINT) AS total_area FROM checked GROUP BY video) SELECT video, n AS n_frames, coalesce(total_area, 0) AS total_area, CASE WHEN anchor_frame IS NULL THEN 'no anchor found' END AS error, anchor_frame, anchor_score, anchor_area_percent, propagated, verified, flagged FROM vids LEFT JOIN i USING (video)",
    "segment_followed": f"WITH RECURSIVE {FOLLOWED} SELECT video, frame, 1 AS obj, count(*) AS area, CAST(sum(p) AS BIGINT) AS px_sum FROM (SELECT DISTINCT video, frame, unnest(px) AS p FROM both_ways) z GROUP BY ALL",
    "inpaint_groups": f"WITH {DAY}, days AS (SELECT DISTINCT frame FROM mask), c AS (SELECT frame, px, count(*) AS k FROM mask GROUP BY ALL), p AS (SELECT d.frame, t.px, 50 * coalesce(k, 0) AS add FROM days d, range(0, 150) t(px) LEFT JOIN c ON c.frame = d.frame AND c.px = t.px) SELECT frame AS frame_idx, md5(string_agg(printf('%02x%02x%02x', ((px * 7 + frame) % 256 + add) % 256, ((px * 11 + frame) % 256 + add) % 256, ((px * 13 + frame) % 256 + add) % 256), '' ORDER BY px)) AS digest, 'model' AS method FROM p GROUP BY frame",
    "inpaint_fallback": f"WITH {DAY} SELECT DISTINCT CAST(frame // 7 AS BIGINT) AS video, frame AS frame_idx, CASE WHEN frame // 2 % 2 = 1 THEN 'fallback' ELSE 'model' END AS method, CASE WHEN frame // 2 % 2 = 1 THEN 'a chunk that fails' END AS fallback_reason, CAST(0 AS BIGINT) AS changed_outside FROM mask",
    "run_batch": f"WITH {BATCH} SELECT video_id, prompt_word, path AS input_video_path, CASE WHEN kind <> 'unknown' THEN '/out/' || video_id || '.mp4' END AS output_video_path, CASE WHEN kind NOT IN ('done', 'unknown') THEN round(dur, 2) END AS duration_seconds, CASE WHEN kind NOT IN ('done', 'unknown') THEN dur > 60 END AS frame_reduction_applied, CASE kind WHEN 'done' THEN 'skipped' WHEN 'good' THEN 'success' ELSE 'failed' END AS status, CASE kind WHEN 'done' THEN 'output already exists' WHEN 'unknown' THEN 'no information on the video file' WHEN 'raises' THEN 'a job that fails' WHEN 'empty' THEN 'no edited video came out' END AS error_message FROM bat",
    "batch_passed": f"WITH {BATCH} SELECT count(*) AS total, count(*) FILTER (kind = 'good') AS passed FROM bat",
    "worker_ordinals": f"WITH {BATCH}, q AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN id % 17 <> 0 THEN frame_count END DESC NULLS LAST, video_id) - 1 AS p FROM bat) SELECT video_id, CASE WHEN p // 3 % 2 = 0 THEN p % 3 ELSE 2 - p % 3 END AS worker, p // 3 + 1 AS ordinal, CASE kind WHEN 'done' THEN 'skipped' WHEN 'good' THEN 'success' ELSE 'failed' END AS status FROM q",
    "first_jobs": "SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS prompt_word, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM orders ORDER BY o_orderkey LIMIT 1000",
    "prompt_examples": f"WITH {SELECTED} SELECT video, prompt_word FROM sel WHERE prompt_word IS NOT NULL ORDER BY video LIMIT 20",
    "zipped_frames": f"WITH {FRAMES} SELECT video, frame_idx, event_type, score FROM fr WHERE frame_idx < 40 AND frame_idx % 3 <> 1",
    "decode_resampled": f"WITH RECURSIVE {FRAMES}, {VIDEOS}, r AS (SELECT video, n, CASE WHEN video % 2 = 0 THEN 29.97::DOUBLE / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS step FROM vid), walk(video, n, step, f, due, kept) AS (SELECT video, n, step, CAST(0 AS BIGINT), step, true FROM r UNION ALL SELECT video, n, step, f + 1, CASE WHEN f + 1 >= due THEN due + step ELSE due END, f + 1 >= due FROM walk WHERE f + 1 < n), k AS (SELECT video, f AS frame_idx, row_number() OVER (PARTITION BY video ORDER BY f) - 1 AS pos FROM walk WHERE kept) SELECT video, pos, frame_idx, 10.0::DOUBLE AS fps, event_type FROM k JOIN fr USING (video, frame_idx) WHERE pos < 25",
    "decode_uniform": f"WITH {FRAMES}, {VIDEOS}, x AS (SELECT video, n, CASE WHEN n > 16 THEN {_INDICES.format(m=16)} WHEN video % 2 = 0 THEN list_filter(range(0, n), lambda f: list_contains([0, 3, 6, 9, 12, 15], f)) ELSE range(0, n) END AS x FROM vid), k AS (SELECT video, n, unnest(x) AS frame_idx, CAST(unnest(range(0, len(x))) AS BIGINT) AS pos FROM x) SELECT video, pos, frame_idx, CASE WHEN n > 16 AND video % 2 = 0 THEN 29.97::DOUBLE ELSE 10.0::DOUBLE END AS fps, event_type FROM k JOIN fr USING (video, frame_idx)",
    "clip_round_trip": f"WITH {DAY}, days AS (SELECT DISTINCT frame FROM mask), p AS (SELECT frame, t.px FROM days, range(0, 150) t(px)), m AS (SELECT frame, md5(string_agg(printf('%02x%02x%02x', (px * 7 + frame) % 256, (px * 11 + frame) % 256, (px * 13 + frame) % 256), '' ORDER BY px)) AS digest FROM p GROUP BY frame) SELECT CAST(frame // 7 AS BIGINT) AS video, frame AS frame_idx, 10 AS h, 15 AS w, digest, count(*) OVER (PARTITION BY frame // 7) AS n, count(*) OVER (PARTITION BY frame // 7) / 25.0::DOUBLE AS duration_sec FROM m",
    "clip_seek": f"WITH {FRAMES}, {VIDEOS}, x AS (SELECT video, n, {_INDICES.format(m=4)} AS x FROM vid), k AS (SELECT video, unnest(x) AS frame_idx, CAST(unnest(range(0, len(x))) AS BIGINT) AS pos FROM x) SELECT video, pos, frame_idx, printf('%012x', video * 1000003 + frame_idx) AS rgb FROM k",
    "movie_probe": "SELECT p_partkey, CASE WHEN ok THEN 30000.0::DOUBLE / 1001.0::DOUBLE ELSE 0.0::DOUBLE END AS fps, CASE WHEN whole THEN p_size * 16 ELSE 0 END AS width, CASE WHEN whole THEN p_size * 9 ELSE 0 END AS height, CASE WHEN ok THEN n ELSE 0 END AS frame_count, CASE WHEN ok THEN n / (30000.0::DOUBLE / 1001.0::DOUBLE) ELSE 0.0::DOUBLE END AS duration_sec FROM (SELECT *, p_partkey % 300 AS n, p_partkey % 13 <> 0 AS whole, p_partkey % 13 <> 0 AND p_partkey % 300 > 0 AS ok FROM part) z",
    "picture_round_trip": f"WITH {DAY}, days AS (SELECT DISTINCT frame FROM mask), p AS (SELECT frame, t.px FROM days, range(0, 150) t(px)) SELECT CAST(frame // 7 AS BIGINT) AS video, frame AS frame_idx, 10 AS h, 15 AS w, md5(string_agg(printf('%02x%02x%02x', (px * 7 + frame) % 256, (px * 11 + frame) % 256, (px * 13 + frame) % 256), '' ORDER BY px)) AS digest FROM p GROUP BY frame",
    "saved_archives": f"WITH {DAY} SELECT CAST(frame // 7 AS VARCHAR) AS video, frame % 7 AS frame, obj, count(*) AS area FROM mask WHERE obj IN (2, 5) AND frame % 7 < 4 GROUP BY ALL",
    "status_batches": f"WITH {RUN} SELECT 'batch-' || CAST(CAST(video_id AS BIGINT) % 3 AS VARCHAR) AS batch, status, count(*) AS records FROM run GROUP BY ALL",
    "best_detection": f"WITH {DETECTED} SELECT video, frame, arg_min(det, (-score, det)) AS det, max(score) AS score FROM (SELECT DISTINCT video, frame, det, score FROM det WHERE score >= 0.5) z GROUP BY ALL",
    "mask_scales": "WITH p AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size * 5 > 127.5 ELSE p_size % 2 = 1 END AS bit FROM part) SELECT p_partkey, bit, CASE WHEN bit THEN 255 ELSE 0 END AS byte, p_size / 150 * 100 AS percent, CAST(p_size AS VARCHAR) || 'x' || CAST(k AS VARCHAR) AS resolution, greatest(2, (k % 64) // least(greatest(k % 9, 1), 4)) AS threads, k - p_size AS back, k AS grey, lpad(CAST(k AS VARCHAR), 6, '0') || '.png' AS edited, 'mask_f' || lpad(CAST(k AS VARCHAR), 6, '0') || '_o' || CAST(p_size AS VARCHAR) || '.png' AS mask, 'remove the ' || p_name || ' here' AS request, greatest(p_size % 8, 4) AS grow FROM p",
    "resources": "SELECT count(*) = 0 AS available, CASE WHEN count(*) = 0 THEN 'available' ELSE 'missing: ' || string_agg(n_name, ', ' ORDER BY n_name) END AS message FROM nation WHERE n_regionkey >= 3",
}
