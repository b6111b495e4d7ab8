"""DuckDB SQL that gives the rows of each registered query of the geographic engine."""

from __future__ import annotations

WAY = "4611686018427387904"
RELATION = "(-9223372036854775807 - 1)"
COASTLINE = f"({RELATION} + {WAY})"
SIDE = 156250

NODES = """nodes AS (
    SELECT p_partkey AS id, CAST(p_partkey * 48271 % 2000003 - 1000000 AS INTEGER) AS x, CAST(p_partkey * 69621 % 2000003 - 1000000 AS INTEGER) AS y FROM part
)"""
WAYS = """ways AS (
    SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS nodes FROM lineitem GROUP BY l_orderkey
)"""
SPREAD = """spread AS (
    SELECT id, n.pos, n.node FROM (SELECT id, unnest(list_transform(nodes, lambda v, i: {pos: i, node: v})) AS n FROM ways WHERE len(nodes) >= 2)
)"""
LINES = """met AS (
    SELECT s.id, s.pos, x, y FROM spread s LEFT JOIN nodes n ON n.id = s.node
), lines AS (
    SELECT id, list({x: x, y: y} ORDER BY pos) AS line, count(*) AS n FROM met GROUP BY id HAVING count(x) = count(*)
)"""
ALL_LINES = f"{NODES}, {WAYS}, {SPREAD}, {LINES}"


def tile(column: str, level: int = 0) -> str:
    return f"CAST(floor(({column}) / {float(SIDE << level)}) AS INTEGER)"


def morton(x: str, y: str) -> str:
    def spread(v: str) -> str:
        out = f"(CAST({v} AS BIGINT) & 4294967295)"
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = f"(({out} | ({out} << {shift})) & {mask})" if shift == 16 else f"list_transform([{out}], lambda v{shift}: (v{shift} | (v{shift} << {shift})) & {mask})[1]"
        return out

    code = f"(CAST({spread(x)} AS HUGEINT) + 2 * CAST({spread(y)} AS HUGEINT))"
    return f"CAST(CASE WHEN {code} >= 9223372036854775808::HUGEINT THEN {code} - 18446744073709551616::HUGEINT ELSE {code} END AS BIGINT)"


def coordinate(column: str) -> str:
    part = f"rtrim(lpad(CAST(abs(CAST({column} AS BIGINT)) % 10000000 AS VARCHAR), 7, '0'), '0')"
    return f"(CASE WHEN {column} < 0 THEN '-' ELSE '' END || CAST(abs(CAST({column} AS BIGINT)) // 10000000 AS VARCHAR) || '.' || CASE WHEN {part} = '' THEN '0' ELSE {part} END)"


LINE_TILES = f"""ranges AS (
    SELECT id, line, {tile("list_min(list_transform(line, lambda p: p.x))")} AS x0, {tile("list_max(list_transform(line, lambda p: p.x))")} AS x1,
           {tile("list_min(list_transform(line, lambda p: p.y))")} AS y0, {tile("list_max(list_transform(line, lambda p: p.y))")} AS y1
    FROM lines
), cells AS (
    SELECT id, line, x0, x1, y0, y1, CAST(tile_x AS INTEGER) AS tile_x, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS tile_y
    FROM (SELECT *, unnest(generate_series(x0, x1)) AS tile_x FROM ranges)
), segments AS (
    SELECT c.id, tile_x, tile_y, x0 = x1 OR y0 = y1 AS narrow, tile_x::BIGINT * {SIDE} AS l, tile_y::BIGINT * {SIDE} AS b,
           line[i].x::BIGINT AS ax, line[i].y::BIGINT AS ay, line[i + 1].x::BIGINT AS bx, line[i + 1].y::BIGINT AS by_
    FROM (SELECT *, unnest(generate_series(1, len(line) - 1)) AS i FROM cells) c
), sides AS (
    SELECT *, (bx - ax) * (b - ay) - (by_ - ay) * (l - ax) AS s1, (bx - ax) * (b + {SIDE} - ay) - (by_ - ay) * (l - ax) AS s2,
           (bx - ax) * (b - ay) - (by_ - ay) * (l + {SIDE} - ax) AS s3, (bx - ax) * (b + {SIDE} - ay) - (by_ - ay) * (l + {SIDE} - ax) AS s4
    FROM segments
), hits AS (
    SELECT DISTINCT id, tile_x, tile_y FROM sides
    WHERE narrow OR (least(ax, bx) <= l + {SIDE} AND greatest(ax, bx) >= l AND least(ay, by_) <= b + {SIDE} AND greatest(ay, by_) >= b
        AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0)
)"""

TAGGED = f"""tagged AS (
    SELECT o_orderkey AS id, o_orderpriority AS priority,
           CASE o_orderstatus WHEN 'F' THEN 'building' WHEN 'O' THEN 'highway' ELSE 'natural' END AS k,
           CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'residential' ELSE 'coastline' END AS v
    FROM orders
)"""
FEATURES = f"""features AS (
    SELECT lines.id, line, {WAY} + lines.id AS combined_id,
           '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || array_to_string(list_transform(line, lambda p: '[' || {coordinate("p.x")} || ',' || {coordinate("p.y")} || ']'), ',')
           || ']}},"properties":{{"' || CASE WHEN k < 'priority' THEN k || '":"' || v || '","priority":"' || priority ELSE 'priority":"' || priority || '","' || k || '":"' || v END
           || '"}},"id":"way/' || CAST(lines.id AS VARCHAR) || '"}}' AS json
    FROM lines JOIN tagged USING (id) WHERE k <> 'natural'
)"""
PLACED = f"""line_hits AS (
    SELECT {WAY} + id AS combined_id, tile_x, tile_y FROM hits WHERE id IN (SELECT id FROM features)
), placed AS (
    SELECT combined_id, json, n_tiles, n_tiles > 1 AND strlen(json) > 2048 AS external
    FROM features JOIN (SELECT combined_id, count(*) AS n_tiles FROM line_hits GROUP BY 1) USING (combined_id)
)"""

SQUARES = """squares AS (
    SELECT s_suppkey AS id, s_suppkey * 104729 % 1600000 - 800000 AS cx, s_suppkey * 130363 % 1600000 - 800000 AS cy, (s_suppkey % 7 + 1) * 40000 AS h FROM supplier
)"""


def _squares(hole: str) -> str:
    inside = f"s.cx - s.h // 2 <= l AND s.cx + s.h // 2 >= l + {SIDE} AND s.cy - s.h // 2 <= b AND s.cy + s.h // 2 >= b + {SIDE}"
    return f"""WITH {SQUARES}, ranges AS (
    SELECT *, {tile("cx - h")} AS x0, {tile("cx + h")} AS x1, {tile("cy - h")} AS y0, {tile("cy + h")} AS y1 FROM squares
), s AS (
    SELECT *, tile_x::BIGINT * {SIDE} AS l, tile_y::BIGINT * {SIDE} AS b
    FROM (SELECT *, unnest(generate_series(y0, y1)) AS tile_y FROM (SELECT *, unnest(generate_series(x0, x1)) AS tile_x FROM ranges))
)
SELECT id, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y FROM s
WHERE x0 = x1 OR y0 = y1 OR (cx - h < l + {SIDE} AND cx + h > l AND cy - h < b + {SIDE} AND cy + h > b AND NOT ({hole} AND {inside}))"""


VERSIONS = """versions AS (
    SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version, event_type <> 'error' AS visible, event_id, event_type, ts, value FROM events
)"""
CHANGES = f"""{VERSIONS}, changes AS (
    SELECT *, CASE WHEN version = 1 THEN 'create' WHEN event_type = 'error' THEN 'delete' ELSE 'modify' END AS op FROM versions
)"""
EDITED = """edited AS (
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 83 = 0
)"""
SETS = """WITH ops AS (
    SELECT event_id % 20 AS key, event_id AS op_seq, user_id % 50 AS v, event_type FROM events
), operands AS (
    SELECT key, v AS value, op_seq, 1 AS added FROM ops WHERE event_type IN ('view', 'click', 'signup')
    UNION ALL SELECT key, v + 1, op_seq, 1 FROM ops WHERE event_type IN ('view', 'click', 'signup')
    UNION ALL SELECT key, v, op_seq, 0 FROM ops WHERE event_type IN ('error', 'purchase', 'signup')
), last AS (
    SELECT key, value, arg_max(added, op_seq * 2 + added) AS added FROM operands GROUP BY key, value
)
SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS state FROM last WHERE added = 1 GROUP BY key"""
MEMBERS = f"""members AS (
    SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS way,
           CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS role
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
)"""

_IDS = f"""SELECT p_partkey AS combined_id, 0 AS type, p_partkey AS id, 'node' AS type_name FROM part
UNION ALL SELECT o_orderkey + {WAY}, 1, o_orderkey, 'way' FROM orders
UNION ALL SELECT c_custkey + {RELATION}, 2, c_custkey, 'relation' FROM customer"""
_TEXT = "CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END || CAST(p_partkey % 90 AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.' || CAST(p_partkey * 7919 % 1000003 AS VARCHAR) || CAST(p_partkey AS VARCHAR) END"
_POINTS = "array_to_string(list_transform(line, lambda p: CAST(p.x AS VARCHAR) || ' ' || CAST(p.y AS VARCHAR)), ',')"
_WAY_PATH = "lpad(CAST(n // 1000000 AS VARCHAR), CAST(greatest(3, len(CAST(n // 1000000 AS VARCHAR))) AS INTEGER), '0') || '/' || lpad(CAST(n // 1000 % 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || '.json'"

ORACLE = {
    "nodes_by_tile": f"WITH {NODES}, t AS (SELECT {tile('x')} AS tile_x, {tile('y')} AS tile_y, count(*) AS n FROM nodes GROUP BY 1, 2) SELECT tile_x, tile_y, {morton('tile_x', 'tile_y')} AS tile_pos, n FROM t",
    "tile_round_trip": f"WITH {NODES} SELECT id, {tile('x')} AS tile_x, {tile('y')} AS tile_y FROM nodes",
    "tile_levels": f"WITH {NODES} " + " UNION ALL ".join(f"SELECT {tile('x', z)} AS tile_x, {tile('y', z)} AS tile_y, count(*) AS n, {z} AS level FROM nodes GROUP BY 1, 2" for z in range(4)),
    "level_tiles": f"""WITH {NODES}, t AS (SELECT {tile('x', 1)} AS tx, {tile('y', 1)} AS ty FROM nodes), grid AS (
    SELECT CAST(unnest(generate_series(x0, x1)) AS INTEGER) AS tile_x, tile_y FROM (SELECT x0, x1, CAST(unnest(generate_series(y0, y1)) AS INTEGER) AS tile_y FROM (SELECT min(tx) AS x0, max(tx) AS x1, min(ty) AS y0, max(ty) AS y1 FROM t))
) SELECT tile_x, tile_y, count(tx) AS n FROM grid LEFT JOIN t ON tx = tile_x AND ty = tile_y GROUP BY 1, 2""",
    "coord_text": f"WITH {NODES} SELECT id, {coordinate('x')} AS x_text, {coordinate('y')} AS y_text FROM nodes",
    "coord_parse": f"""WITH t AS (SELECT p_partkey AS id, {_TEXT} AS text FROM part)
SELECT id, text, CAST(CASE WHEN text LIKE '-%' THEN -1 ELSE 1 END * (CAST(split_part(ltrim(text, '-'), '.', 1) AS BIGINT) * 10000000 + CAST(rpad(left(split_part(text, '.', 2), 7), 7, '0') AS BIGINT)) AS INTEGER) AS fixed FROM t""",
    "coord_fixed": "WITH t AS (SELECT p_partkey AS id, CAST(floor((p_retailprice / 7 - 100) * 10000000.0::DOUBLE) AS INTEGER) AS fixed FROM part) SELECT id, fixed, fixed * 1e-7::DOUBLE AS degrees FROM t",
    "size_texts": """WITH t AS (SELECT p_partkey AS id, p_partkey * p_partkey * 1000 AS n FROM part)
SELECT id, CASE WHEN n >= 1099511627776 THEN printf('%.2f TiB', floor(n / 1099511627776.0::DOUBLE * 100 + 0.5) / 100) WHEN n >= 1073741824 THEN printf('%.2f GiB', floor(n / 1073741824.0::DOUBLE * 100 + 0.5) / 100)
    WHEN n >= 1048576 THEN printf('%.2f MiB', floor(n / 1048576.0::DOUBLE * 100 + 0.5) / 100) WHEN n >= 1024 THEN printf('%.2f KiB', floor(n / 1024.0::DOUBLE * 100 + 0.5) / 100) ELSE CAST(n AS VARCHAR) || ' B' END AS size_text FROM t""",
    "combined_ids": _IDS,
    "location_paths": f"""WITH w AS (SELECT o_orderkey * 7919 AS n FROM orders), c AS (SELECT o_orderkey AS n FROM orders)
SELECT {WAY} + n AS combined_id, 'way/' || {_WAY_PATH} AS path, {WAY} + n AS back FROM w
UNION ALL SELECT {COASTLINE} + n, 'coastline/' || lpad(CAST(n // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') || '.json', {COASTLINE} + n FROM c""",
    "type_counts": f"SELECT type, count(*) AS n FROM ({_IDS}) GROUP BY type",
    "latest_version": f"WITH {VERSIONS} SELECT id, max(version) AS version, arg_max(visible, version) AS visible, arg_max(event_type, version) AS event_type, arg_max(event_id, version) AS event_id FROM versions GROUP BY id",
    "reverse_refs": f"SELECT l_partkey AS ref, count(DISTINCT l_orderkey) AS n, string_agg(DISTINCT CAST(l_orderkey + {WAY} AS VARCHAR), ',' ORDER BY CAST(l_orderkey + {WAY} AS VARCHAR)) AS referrers FROM lineitem GROUP BY l_partkey",
    "way_points": f"WITH {ALL_LINES} SELECT id, n, {_POINTS} AS points FROM lines",
    "way_missing_node_guard": f"WITH {ALL_LINES.replace('FROM part', 'FROM part WHERE p_partkey % 50 <> 0')} SELECT id, n FROM lines",
    "relation_way_points": f"""WITH {NODES}, {WAYS}, {MEMBERS}, whole AS (
    SELECT id FROM members m JOIN customer ON c_custkey = m.id AND c_mktsegment = 'BUILDING' LEFT JOIN ways ON ways.id = m.way GROUP BY m.id HAVING count(ways.id) = count(*)
), spread AS (
    SELECT m.id, m.pos, m.role, unnest(list_transform(w.nodes, lambda v, i: {{place: i, node: v}})) AS s FROM members m JOIN whole USING (id) JOIN ways w ON w.id = m.way WHERE m.way % 17 <> 0
)
SELECT s.id, pos, role, string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ',' ORDER BY s.s.place) AS points FROM spread s JOIN nodes ON nodes.id = s.s.node GROUP BY s.id, pos, role""".replace("SELECT id FROM members m", "SELECT m.id FROM members m"),
    "way_bounds": f"WITH {ALL_LINES} SELECT id, list_min(list_transform(line, lambda p: p.x)) AS min_x, list_max(list_transform(line, lambda p: p.x)) AS max_x, list_min(list_transform(line, lambda p: p.y)) AS min_y, list_max(list_transform(line, lambda p: p.y)) AS max_y FROM lines",
    "segment_density": f"""WITH {ALL_LINES}, steps AS (SELECT line[i].x::DOUBLE AS ax, line[i].y::DOUBLE AS ay, line[i + 1].x AS bx, line[i + 1].y AS by_ FROM (SELECT line, unnest(generate_series(1, len(line) - 1)) AS i FROM lines)),
d AS (SELECT sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS d FROM steps) SELECT count(*) AS segments, round(sum(d) / count(*), 4) AS mean FROM d WHERE d > 0""",
    "line_tiles": f"WITH {ALL_LINES}, {LINE_TILES} SELECT id, tile_x, tile_y, {morton('tile_x', 'tile_y')} AS tile_pos FROM hits",
    "line_tile_counts": f"WITH {ALL_LINES}, {LINE_TILES} SELECT tile_x, tile_y, count(*) AS n FROM hits GROUP BY 1, 2",
    "square_tiles": _squares("false"),
    "square_ring_tiles": _squares("id % 2 = 0"),
    "area_rule_way": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN false WHEN o_orderkey % 13 = 0 THEN true ELSE o_orderstatus = 'F' END AS is_area FROM orders",
    "area_rule_relation": "SELECT c_custkey AS id, c_custkey % 9 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_area FROM customer",
    "way_kinds": f"""WITH {WAYS}, {TAGGED} SELECT id, CASE WHEN k = 'building' AND len(nodes) >= 3 THEN 'area' WHEN k = 'building' AND len(nodes) >= 4 AND nodes[1] = nodes[len(nodes)] THEN 'area' ELSE 'line' END AS kind,
    CASE WHEN k = 'building' AND len(nodes) >= 3 THEN len(nodes) + 1 ELSE len(nodes) END AS n FROM ways JOIN tagged USING (id) WHERE k <> 'natural' AND len(nodes) >= 2""",
    "feature_json": f"WITH {ALL_LINES}, {TAGGED}, {FEATURES} SELECT combined_id, json FROM features",
    "external_features": f"WITH {ALL_LINES}, {TAGGED}, {FEATURES}, {LINE_TILES}, {PLACED} SELECT combined_id, n_tiles, CAST(strlen(json) AS INTEGER) AS n_bytes, external FROM placed",
    "tile_document": f"""WITH {ALL_LINES}, {TAGGED}, {FEATURES}, {LINE_TILES}, {PLACED}, docs AS (
    SELECT tile_x, tile_y, count(*) AS n, string_agg(CASE WHEN external THEN '{{"type":"Reference","location":"way/' || {_WAY_PATH.replace("n // ", f"(combined_id - {WAY}) // ").replace("n % ", f"(combined_id - {WAY}) % ")} || '"}}' ELSE json END, chr(10) ORDER BY combined_id) AS document
    FROM line_hits JOIN placed USING (combined_id) GROUP BY 1, 2
) SELECT {morton('tile_x', 'tile_y')} AS tile_pos, n, CAST(strlen(document) AS INTEGER) AS n_bytes, md5(document) AS digest FROM docs""",
    "assembled_squares": f"WITH {SQUARES} SELECT id, 1 AS n_shapes, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_inners, CAST(cx - h AS INTEGER) AS min_x, CAST(cy + h AS INTEGER) AS max_y FROM squares",
    "set_merge": SETS,
    "set_merge_partial": SETS,
    "map_merge": "WITH last AS (SELECT event_id % 20 AS key, user_id % 50 AS id, arg_max(event_type, event_id) AS value FROM events GROUP BY 1, 2) SELECT key, id, value FROM last WHERE value <> 'error'",
    "counter_merge": "SELECT key, CAST(sum(value) AS BIGINT) AS value FROM (SELECT DISTINCT event_id % 7 AS key, 100 AS value FROM events UNION ALL SELECT event_id % 11, user_id % 5 FROM events) GROUP BY key",
    "change_filter": f"WITH {CHANGES} SELECT op, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM changes WHERE ts > (SELECT ts FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)) GROUP BY op",
    "dirty_set": f"WITH {CHANGES} SELECT id, arg_min(version - 1, version) AS first_old, arg_max(op, version) AS last_new FROM changes GROUP BY id",
    "apply_changes": f"""WITH {CHANGES}, last AS (SELECT id, max(version) AS version, arg_max(op, version) <> 'delete' AS visible, arg_max(value, version) AS value FROM changes GROUP BY id)
SELECT id, version, visible, CASE WHEN visible THEN CAST(floor(value * 1000) AS INTEGER) END AS x, CASE WHEN visible THEN CAST(floor(value * 10) AS INTEGER) END AS y FROM last""",
    "change_problems": f"""WITH {CHANGES}, kept AS (SELECT * FROM changes WHERE event_id % 5 <> 0),
met AS (SELECT *, lag(version) OVER w AS before, lag(op <> 'delete') OVER w AS was FROM kept WINDOW w AS (PARTITION BY id ORDER BY version))
SELECT id, version, CASE WHEN op <> 'create' AND before IS NULL THEN 'does not exist' WHEN op = 'modify' AND was AND version <> before + 1 THEN 'version does not follow' END AS problem FROM met
WHERE (op <> 'create' AND before IS NULL) OR (op = 'modify' AND was AND version <> before + 1)""",
    "affected_closure": f"""WITH RECURSIVE edges AS (
    SELECT l_partkey AS ref, l_orderkey + {WAY} AS referrer FROM lineitem
    UNION ALL SELECT o_orderkey + {WAY}, o_custkey + {RELATION} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
), reached AS (
    SELECT p_partkey AS combined_id FROM part WHERE p_partkey % 97 = 0
    UNION SELECT referrer FROM reached JOIN edges ON ref = combined_id
) SELECT combined_id FROM reached""",
    "ref_integrity": f"SELECT DISTINCT l_partkey AS ref, l_orderkey + {WAY} AS referrer FROM lineitem WHERE (l_partkey + l_orderkey) % 101 = 0",
    "store_diff": f"""WITH {EDITED} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM orders a FULL JOIN edited b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus""",
    "stale_orders": f"""WITH {EDITED}, s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 71 = 0 THEN 1 ELSE 2 + o_orderkey % 2 END AS version, o_totalprice FROM edited), p AS (
    SELECT o.o_orderkey AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN s.version < 2 + o.o_orderkey % 2 THEN 'older' WHEN s.o_totalprice <> o.o_totalprice THEN 'different' END AS problem
    FROM orders o LEFT JOIN s ON s.id = o.o_orderkey
) SELECT id, problem FROM p WHERE problem IS NOT NULL""",
    "tile_patch": f"""WITH {ALL_LINES}, {LINE_TILES}, old AS (SELECT id, tile_x, tile_y FROM hits), changed AS (
    SELECT id, CASE WHEN id % 83 = 0 AND len(line) > 2 THEN line[1:2] ELSE line END AS line FROM lines WHERE id % 97 <> 0
), new AS (
    WITH lines AS (SELECT * FROM changed), {LINE_TILES} SELECT id, tile_x, tile_y FROM hits
)
SELECT coalesce(old.id, new.id) AS id, coalesce(old.tile_x, new.tile_x) AS tile_x, coalesce(old.tile_y, new.tile_y) AS tile_y,
       CASE WHEN old.id IS NULL THEN 'add' WHEN new.id IS NULL THEN 'delete' ELSE 'replace' END AS action
FROM old FULL JOIN new ON old.id = new.id AND old.tile_x = new.tile_x AND old.tile_y = new.tile_y
WHERE old.id IS NULL OR new.id IS NULL OR new.id % 89 = 0""",
    "table_stats": "SELECT 'nodes' AS table_name, count(*) AS n_rows FROM part UNION ALL SELECT 'ways', count(DISTINCT l_orderkey) FROM lineitem",
}
_NEW_NODES = NODES.replace("AS INTEGER) AS x", "AS INTEGER) + CASE WHEN p_partkey % 97 = 0 THEN 60000 ELSE 0 END AS x")
_NEW_WAYS = f"""old_{WAYS}, ways AS (
    SELECT id, CASE WHEN id % 103 = 0 AND len(nodes) > 2 THEN nodes[1:len(nodes) - 1] ELSE nodes END AS nodes FROM old_ways WHERE id % 101 <> 0
)"""
_WAY_NUMBER = f"(combined_id - {WAY})"
_REFERENCE = """'{"type":"Reference","location":"way/' || """ + _WAY_PATH.replace("n // ", f"{_WAY_NUMBER} // ").replace("n % ", f"{_WAY_NUMBER} % ") + """ || '"}'"""
ORACLE["updated_tiles"] = f"""WITH {_NEW_NODES}, {_NEW_WAYS}, {SPREAD}, {LINES}, {TAGGED}, {FEATURES}, {LINE_TILES}, {PLACED}
SELECT {morton('tile_x', 'tile_y')} AS tile_pos, combined_id, md5(CASE WHEN external THEN {_REFERENCE} ELSE json END) AS digest FROM line_hits JOIN placed USING (combined_id)"""
ORACLE["polygon_tiles_general"] = f"""WITH {SQUARES}, corners AS (
    SELECT * FROM (VALUES (0, 0, -3), (1, 5, 1), (2, 1, 4), (3, -4, 0), (4, 0, -3)) c(i, a, b)
), points AS (
    SELECT id, ring, i, CAST(trunc(cx + h * a / (CASE ring WHEN 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END)) AS BIGINT) AS x, CAST(trunc(cy + h * b / (CASE ring WHEN 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END)) AS BIGINT) AS y
    FROM squares, corners, (VALUES (0), (1)) r(ring)
), boxes AS (
    SELECT id, ring, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY id, ring
), ranges AS (
    SELECT id, {tile("x0")} AS tx0, {tile("x1")} AS tx1, {tile("y0")} AS ty0, {tile("y1")} AS ty1 FROM boxes WHERE ring = 0
), cells AS (
    SELECT *, tile_x::BIGINT * {SIDE} AS l, tile_y::BIGINT * {SIDE} AS b FROM (SELECT *, unnest(generate_series(ty0, ty1)) AS tile_y FROM (SELECT *, unnest(generate_series(tx0, tx1)) AS tile_x FROM ranges))
), edges AS (
    SELECT p.id, p.ring, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM points p JOIN points q ON q.id = p.id AND q.ring = p.ring AND q.i = p.i + 1
), sides AS (
    SELECT c.id, c.tile_x, c.tile_y, tx0 = tx1 OR ty0 = ty1 AS narrow, e.*, c.l, c.b, e.ring AS r,
           (bx - ax) * (b - ay) - (by_ - ay) * (l - ax) AS s1, (bx - ax) * (b + {SIDE} - ay) - (by_ - ay) * (l - ax) AS s2,
           (bx - ax) * (b - ay) - (by_ - ay) * (l + {SIDE} - ax) AS s3, (bx - ax) * (b + {SIDE} - ay) - (by_ - ay) * (l + {SIDE} - ax) AS s4
    FROM cells c JOIN edges e ON e.id = c.id
), rings AS (
    SELECT s.id, tile_x, tile_y, s.r AS ring, bool_or(narrow) AS narrow,
           bool_or((least(ax, bx) < l + {SIDE} AND greatest(ax, bx) > l AND least(ay, by_) < b + {SIDE} AND greatest(ay, by_) > b AND least(s1, s2, s3, s4) < 0 AND greatest(s1, s2, s3, s4) > 0)
               OR (ay = by_ AND ay > b AND ay < b + {SIDE} AND least(ax, bx) < l + {SIDE} AND greatest(ax, bx) >= l)) AS edge,
           count(*) FILTER ((ay > b + {SIDE // 2}) <> (by_ > b + {SIDE // 2}) AND l + {SIDE // 2} < (bx - ax) * (b + {SIDE // 2} - ay)::DOUBLE / nullif(by_ - ay, 0) + ax) % 2 = 1 AS centre,
           bool_or(x0 < l + {SIDE} AND x1 > l AND y0 < b + {SIDE} AND y1 > b) AS meets
    FROM sides s JOIN boxes ON boxes.id = s.id AND boxes.ring = s.r GROUP BY s.id, tile_x, tile_y, s.r
), hits AS (
    SELECT id, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y FROM rings GROUP BY id, tile_x, tile_y
    HAVING bool_or(narrow) OR (bool_or(ring = 0 AND meets AND (edge OR centre)) AND NOT bool_or(ring = 1 AND meets AND NOT edge AND centre))
)
SELECT id, tile_x, tile_y, {morton('tile_x', 'tile_y')} AS tile_pos FROM hits"""
ORACLE |= {
    "multipoint_tiles": f"WITH {ALL_LINES}, p AS (SELECT id, unnest(line) AS p FROM lines), t AS (SELECT DISTINCT id, {tile('p.x')} AS tile_x, {tile('p.y')} AS tile_y FROM p) SELECT id, tile_x, tile_y, {morton('tile_x', 'tile_y')} AS tile_pos FROM t",
    "multipoint_json": f"""WITH {ALL_LINES}, texts AS (
    SELECT id, list_transform(line, lambda p: '[' || {coordinate("p.x")} || ',' || {coordinate("p.y")} || ']') AS t FROM lines
) SELECT id, CASE WHEN id % 2 = 0 OR len(t) < 2 THEN '{{"type":"Point","coordinates":' || t[1] || '}}' ELSE '{{"type":"MultiPoint","coordinates":[' || t[1] || ',' || t[2] || ']}}' END AS json FROM texts""",
    "step_measures": f"""WITH {ALL_LINES}, p AS (SELECT id, line[1].x::DOUBLE AS ax, line[1].y::DOUBLE AS ay, line[2].x::DOUBLE AS bx, line[2].y::DOUBLE AS by_, line[3].x::DOUBLE AS cx, line[3].y::DOUBLE AS cy FROM lines)
SELECT id, round(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 4) AS step, 0.5::DOUBLE * abs((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) AS area FROM p""",
    "tile_gate": f"SELECT type, count(*) FILTER (type <> 0 AND id % 7 <> 0) AS n, count(*) FILTER (id % 7 <> 0) AS n_with_nodes FROM ({_IDS}) GROUP BY type",
    "bounds_relations": f"""WITH {SQUARES}, b AS (SELECT id, cx - h AS x0, cx + h AS x1, cy - h AS y0, cy + h AS y1 FROM squares)
SELECT a.id, a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1 AS contains, a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 AS intersects FROM b a JOIN b ON b.id = a.id + 1""",
    "way_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT 1 + 97 * i FROM range(21) t(i)) AND o_orderkey < 2000",
}
_CORNERED = [("x + i * h", "y"), ("x + m * h", "y + i * h"), ("x + m * h - i * h", "y + m * h"), ("x", "y + m * h - i * h")]
_CLOCKWISE = [("x", "y + i * h"), ("x + i * h", "y + m * h"), ("x + m * h", "y + m * h - i * h"), ("x + m * h - i * h", "y")]


def _around(sides: list[tuple[str, str]]) -> str:
    lists = " || ".join(f"list_transform(range(m), lambda i: CAST({a} AS VARCHAR) || ' ' || CAST({b} AS VARCHAR))" for a, b in sides)
    return f"array_to_string({lists} || [CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR)], ',')"


ORACLE["assembled_relations"] = f"""WITH base AS (
    SELECT s_suppkey AS id, s_suppkey * 104729 % 1600000 - 800000 AS ox, s_suppkey * 130363 % 1600000 - 800000 AS oy, s_suppkey % 3 + 3 AS n, (s_suppkey % 5 + 1) * 1000 AS w
    FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0
), rings AS (
    SELECT id, true AS is_outer, ox AS x, oy AS y, w // 2 AS h, 2 * n AS m FROM base
    UNION ALL SELECT id, false, ox + w, oy + w, w // 2, 2 FROM base
    UNION ALL SELECT id, true, ox + w + w // 4, oy + w + w // 4, (w - w // 4 * 2) // 2, 2 FROM base WHERE n = 5
) SELECT id, is_outer, CAST(4 * m AS BIGINT) AS n, CASE WHEN is_outer THEN {_around(_CORNERED)} ELSE {_around(_CLOCKWISE)} END AS points FROM rings"""
_SQUARE_RING = lambda h, turn: "'[' || " + " || ',' || ".join(
    f"'[' || {coordinate(f'(cx + ({a}) * {h})')} || ',' || {coordinate(f'(cy + ({b}) * {h})')} || ']'" for a, b in [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)][::turn]
) + " || ']'"
_LEVELS = " UNION ALL ".join(
    f"""SELECT combined_id, json, {z} AS level, {tile("x0", z)} AS tx0, {tile("x1", z)} AS tx1, {tile("y0", z)} AS ty0, {tile("y1", z)} AS ty1, {SIDE << z} AS side, x0, x1, y0, y1, hx0, hx1, hy0, hy1, kind FROM made WHERE kind <> 'node' OR {z} = 0"""
    for z in range(3)
)
_NAMED = lambda kind, geometry, properties, number: f"""'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":' || {geometry} || '}}{properties},"id":"' || {number} || '"}}'"""
ORACLE["updated_areas"] = f"""WITH {SQUARES}, moved AS (
    SELECT id, cx + CASE WHEN id % 7 = 0 AND id % 13 <> 0 THEN 70000 ELSE 0 END AS cx, cy, h, h // 2 AS q FROM squares
), made AS (
    SELECT {WAY} + id * 2 AS combined_id, 'area' AS kind, {_NAMED("Polygon", "'[' || " + _SQUARE_RING("h", 1) + " || ']'", ',"properties":{"building":"yes"}', "'way/' || CAST(id * 2 AS VARCHAR)")} AS json,
           cx - h AS x0, cx + h AS x1, cy - h AS y0, cy + h AS y1, NULL AS hx0, NULL AS hx1, NULL AS hy0, NULL AS hy1 FROM moved WHERE id % 13 <> 0
    UNION ALL SELECT {WAY} + id * 2 + 1, 'line', {_NAMED("LineString", _SQUARE_RING("q", 1), "", "'way/' || CAST(id * 2 + 1 AS VARCHAR)")},
           cx - q, cx + q, cy - q, cy + q, NULL, NULL, NULL, NULL FROM moved WHERE id % 13 <> 0 AND id % 2 = 0
    UNION ALL SELECT {RELATION} + id, 'area', {_NAMED("Polygon", "'[' || " + _SQUARE_RING("h", 1) + " || ',' || " + _SQUARE_RING("q", -1) + " || ']'", ',"properties":{"type":"multipolygon"}', "'relation/' || CAST(id AS VARCHAR)")},
           cx - h, cx + h, cy - h, cy + h, cx - q, cx + q, cy - q, cy + q FROM moved WHERE id % 13 <> 0 AND id % 2 = 0
    UNION ALL SELECT id * 10, 'node', {_NAMED("Point", f"'[' || {coordinate('(cx - h)')} || ',' || {coordinate('(cy - h)')} || ']'", ',"properties":{"shop":"a"}', "'node/' || CAST(id * 10 AS VARCHAR)")},
           cx - h, cx - h, cy - h, cy - h, NULL, NULL, NULL, NULL FROM moved WHERE id % 3 = 0
    UNION ALL SELECT id * 10 + 2, 'node', {_NAMED("Point", f"'[' || {coordinate('(cx + h)')} || ',' || {coordinate('(cy + h)')} || ']'", ',"properties":{"shop":"b"}', "'node/' || CAST(id * 10 + 2 AS VARCHAR)")},
           cx + h, cx + h, cy + h, cy + h, NULL, NULL, NULL, NULL FROM moved WHERE id % 17 = 0 AND id % 13 <> 0
), ranges AS ({_LEVELS}), cells AS (
    SELECT *, tile_x::BIGINT * side AS l, tile_y::BIGINT * side AS b FROM (SELECT *, unnest(generate_series(ty0, ty1)) AS tile_y FROM (SELECT *, unnest(generate_series(tx0, tx1)) AS tile_x FROM ranges))
), hits AS (
    SELECT level, combined_id, json, {morton('tile_x', 'tile_y')} AS tile_pos FROM cells WHERE tx0 = tx1 OR ty0 = ty1
        OR (kind = 'area' AND x0 < l + side AND x1 > l AND y0 < b + side AND y1 > b AND NOT coalesce(hx0 <= l AND hx1 >= l + side AND hy0 <= b AND hy1 >= b + side, false))
        OR (kind = 'line' AND x0 <= l + side AND x1 >= l AND y0 <= b + side AND y1 >= b AND NOT (x0 < l AND x1 > l + side AND y0 < b AND y1 > b + side))
) SELECT CAST(level AS INTEGER) AS level, tile_pos, combined_id, md5(json) AS digest FROM hits"""
ORACLE["compared_stores"] = """SELECT 'points' AS table_name, CASE WHEN p_partkey % 101 = 0 THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM part
WHERE p_partkey <= 1000 AND (p_partkey % 101 = 0 OR p_partkey % 103 = 0) GROUP BY ALL
UNION ALL SELECT 'ways', 'changed', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 211 = 0 GROUP BY l_orderkey HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'ways', 'added', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 223 = 0 HAVING count(*) > 0"""
ORACLE["batched_lookup"] = f"""WITH {NODES}, {WAYS}, spread AS (
    SELECT id, n.pos, n.node FROM (SELECT id, unnest(list_transform(nodes, lambda v, i: {{pos: i, node: v}})) AS n FROM ways)
) SELECT s.id, count(*) AS n, string_agg(CASE WHEN n.id IS NULL THEN '-' ELSE CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR) END, ',' ORDER BY pos) AS points
FROM spread s LEFT JOIN nodes n ON n.id = s.node AND n.id % 50 <> 0 GROUP BY s.id"""
_LEAST = 927.067380381451 * (1 << 11)
_MEAN = "list_sum(list_transform(range(1, len(line)), lambda i: sqrt((line[i].x::DOUBLE - line[i + 1].x) * (line[i].x::DOUBLE - line[i + 1].x) + (line[i].y::DOUBLE - line[i + 1].y) * (line[i].y::DOUBLE - line[i + 1].y)))) / (len(line) - 1)"
_AREAS = "list_transform(range(2, len(line)), lambda i: abs(line[i - 1].x::DOUBLE * line[i].y + line[i].x::DOUBLE * line[i + 1].y + line[i + 1].x::DOUBLE * line[i - 1].y - line[i - 1].x::DOUBLE * line[i + 1].y - line[i].x::DOUBLE * line[i - 1].y - line[i + 1].x::DOUBLE * line[i].y))"
ORACLE["simplify_lines"] = f"""WITH RECURSIVE {ALL_LINES}, steps AS (
    SELECT id, len(line) AS n_before, (len(line) - 2) >> 11 AS fewest, line FROM lines WHERE len(line) >= 4
    UNION ALL
    SELECT id, n_before, fewest, line[1:k] || line[k + 2:] FROM (
        SELECT id, n_before, fewest, line, list_position({_AREAS}, list_min({_AREAS})) AS k FROM steps WHERE len(line) > 2 AND len(line) - 2 >= fewest AND {_MEAN} < {_LEAST}::DOUBLE
    )
), last AS (
    SELECT id, n_before, arg_min(line, len(line)) AS line FROM steps GROUP BY id, n_before
)
SELECT id, CAST(n_before AS INTEGER) AS n_before, CAST(CASE WHEN len(line) = 2 AND {_MEAN} < {_LEAST}::DOUBLE THEN 0 ELSE len(line) END AS INTEGER) AS n_after FROM last"""
ORACLE["changes_stream"] = ORACLE["apply_changes"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
