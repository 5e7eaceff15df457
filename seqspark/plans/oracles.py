"""DuckDB SQL for the queries."""

from __future__ import annotations

from seqspark.functions.keys import SLOT_COUNT
from seqspark.plans import queries as q
from seqspark.sources.schemas import REASONS


def _slot(key: str) -> str:
    """CRC-32 of the key's bytes, bit by bit, modulo the number of slots."""
    data = f"hex(encode({key}))"
    octets = f"list_transform(range(strlen({key})), lambda i: CAST('0x' || substr({data}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)"
    return f"CAST(xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: {step})) % {SLOT_COUNT} AS INTEGER)"


LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS sequence_key, ts, epoch_us(ts) AS us, event_id AS tie FROM events)"
OWNERS = f"""owners AS (
  SELECT CAST(v AS BIGINT) AS version, CAST(s AS INTEGER) AS slot,
    CASE v WHEN 1 THEN 'node-a' WHEN 2 THEN ['node-a', 'node-b'][s % 2 + 1] ELSE ['node-a', 'node-b', 'node-c'][s % 3 + 1] END AS node_id
  FROM range({SLOT_COUNT}) AS t(s), (VALUES (1), (2), (3)) AS x(v))"""
SLOTS = f"slots AS (SELECT sequence_key, {_slot('sequence_key')} AS slot FROM (SELECT DISTINCT sequence_key FROM log))"
IDLE_US = 24 * 3600 * 1_000_000
SESSIONS = f"""gaps AS (SELECT *, coalesce(us - lag(us) OVER w >= {IDLE_US}, false) AS broken FROM log WINDOW w AS (PARTITION BY sequence_key ORDER BY us, tie)),
numbered AS (SELECT *, CAST(sum(CAST(broken AS INT)) OVER (PARTITION BY sequence_key ORDER BY us, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM gaps),
sums AS (SELECT sequence_key, sid, count(*) AS n, CAST(ceil(count(*) / 10) AS BIGINT) AS r FROM numbered GROUP BY ALL),
used AS (SELECT *, (r + CASE WHEN (n - (r - 1) * 10) / 10 >= 0.5 THEN 1 ELSE 0 END) * 10 AS u FROM sums),
based AS (SELECT *, CAST(coalesce(sum(u) OVER (PARTITION BY sequence_key ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM used),
ids AS (SELECT sequence_key, tie, sid, base + row_number() OVER (PARTITION BY sequence_key, sid ORDER BY us, tie) AS id FROM numbered JOIN based USING (sequence_key, sid))"""


def _next_step(step: str, elapsed_us: str, used: str, size: str, least: int, most: int, increase: int, decrease: int) -> str:
    own = f"greatest({step}, {least})"
    lasts = f"CAST(trunc(CAST({elapsed_us} * 1000 AS DOUBLE) / (CAST({used} AS DOUBLE) / CAST({size} AS DOUBLE))) AS BIGINT)"
    return (
        f"CAST(CASE WHEN {lasts} <= {increase * 1000} THEN CASE WHEN {own} >= {most // 2} THEN {most} ELSE {own} * 2 END "
        f"WHEN {lasts} >= {decrease * 1000} THEN greatest({own} // 2, {least}) ELSE {own} END AS BIGINT)"
    )


HOUR, DAY = 3_600_000_000, 86_400_000_000
_ADAPT = lambda elapsed: _next_step("step", elapsed, "cur - st + 1", "en - st + 1", 2, 16, 24 * HOUR, 48 * HOUR)


def _one_more(rows: str) -> str:
    """The state after a request: evicted, then moved on, then prefetched."""
    return f"""
  SELECT sequence_key, rn, us, tie, CASE WHEN pre THEN w + size2 ELSE w END AS w, st, en, cur, step, act, CASE WHEN pre THEN w + 1 ELSE stby END AS stby, ev, lost FROM (
    SELECT *, CASE WHEN pre THEN {_ADAPT("(us - act)")} END AS size2 FROM (
      SELECT *, stby = 0 AND CAST(cur - st + 1 AS DOUBLE) / (en - st + 1) >= 0.5 AS pre FROM (
        SELECT sequence_key, rn, us, tie, w2 AS w, CASE WHEN move THEN s2 ELSE st END AS st, CASE WHEN move THEN w2 ELSE en END AS en,
          CASE WHEN move THEN s2 ELSE cur + 1 END AS cur, CASE WHEN move THEN w2 - s2 + 1 ELSE step END AS step, CASE WHEN move THEN us ELSE act END AS act,
          CASE WHEN move THEN CAST(0 AS BIGINT) ELSE stby END AS stby, ev, lost FROM (
          SELECT *, CASE WHEN move AND stby = 0 THEN w + size1 ELSE w END AS w2, CASE WHEN stby = 0 THEN w + 1 ELSE stby END AS s2 FROM (
            SELECT *, CASE WHEN en = 0 THEN CAST(2 AS BIGINT) WHEN move THEN {_ADAPT("(us - act)")} END AS size1 FROM (
              SELECT *, en = 0 OR cur >= en AS move FROM (
                SELECT sequence_key, rn, us, tie, w, CASE WHEN gone THEN 0 ELSE st END AS st, CASE WHEN gone THEN 0 ELSE en END AS en, CASE WHEN gone THEN 0 ELSE cur END AS cur,
                  CASE WHEN gone THEN 0 ELSE step END AS step, act, CASE WHEN gone THEN 0 ELSE stby END AS stby, ev + CAST(gone AS BIGINT) AS ev,
                  lost + CASE WHEN gone THEN en - cur + CASE WHEN stby > 0 THEN w - stby + 1 ELSE 0 END ELSE 0 END AS lost
                FROM ({rows}))))))))"""


_FIRST = "SELECT sequence_key, rn, us, tie, 0::BIGINT AS w, 0::BIGINT AS st, 0::BIGINT AS en, 0::BIGINT AS cur, 0::BIGINT AS step, 0::BIGINT AS act, 0::BIGINT AS stby, 0::BIGINT AS ev, 0::BIGINT AS lost, false AS gone FROM ordered WHERE rn = 1"
_NEXT = f"SELECT o.sequence_key, o.rn, o.us, o.tie, s.w, s.st, s.en, s.cur, s.step, s.act, s.stby, s.ev, s.lost, o.us - s.us >= {36 * HOUR} AS gone FROM states s JOIN ordered o ON o.sequence_key = s.sequence_key AND o.rn = s.rn + 1"
REPLAY = f"""WITH RECURSIVE {LOG},
ordered AS (SELECT sequence_key, us, tie, row_number() OVER (PARTITION BY sequence_key ORDER BY us, tie) AS rn FROM log),
states AS ({_one_more(_FIRST)} UNION ALL {_one_more(_NEXT)})"""


def _values(rows: list[tuple]) -> str:
    def text(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "[" + ", ".join(map(text, x)) + "]::VARCHAR[]" if isinstance(x, list) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def _manifest(rows: list[tuple]) -> str:
    return _values([(service, k, *entry) for service, entries in rows for k, entry in enumerate(entries)])


SEMVER = r"^v[0-9]+\.[0-9]+\.[0-9]+$"
RELEASES = f"""r(service, place, version, contract, clients) AS ({_manifest(q.MANIFESTS)}), old(service, place, version, contract, clients) AS ({_manifest(q.RELEASED)}),
tags(tag) AS ({_values([(t,) for t in q.TAGS])}),
root(module, version) AS (VALUES ('gen/go/sequence', 'v0.2.0'), ('pkg/sequence', 'v0.2.0')),
mods(client, module, version) AS (VALUES ('pkg/sequence/v0.1.0', 'gen/go/sequence', 'v0.1.0'), ('pkg/sequence/v0.2.0', 'gen/go/sequence', 'v0.2.0')),
c AS (SELECT service, place, version, contract, unnest(clients) AS client, regexp_extract(contract, '^(.*)/v[^/]*$', 1) AS cpath, regexp_extract(contract, '/(v[^/]*)$', 1) AS cver FROM r)"""

_VALID_TAG = lambda t, p: f"(starts_with({t}, '{p}') AND length(regexp_extract({t}, '^(.*)/v[^/]*$', 1)) > {len(p)} AND regexp_matches(regexp_extract({t}, '^.*/(v[^/]*)$', 1), '{SEMVER}'))"

ORACLE_SQL: dict[str, str] = {
    "first_ids": f"""WITH {LOG}, {OWNERS}, {SLOTS}
SELECT tie AS event_id, sequence_key, slot, node_id, row_number() OVER (PARTITION BY sequence_key ORDER BY ts, tie) AS id
FROM log JOIN slots USING (sequence_key) JOIN owners USING (slot) WHERE version = 2""",
    "slot_for_key": f"SELECT sequence_key, {_slot('sequence_key')} AS slot FROM (SELECT CAST(user_id AS VARCHAR) AS sequence_key FROM events UNION SELECT c_name FROM customer)",
    "slot_histogram": f"""SELECT {_slot('k')} AS slot, CAST(sum(n) AS BIGINT) AS n_requests, count(*) AS n_keys
FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1""",
    "key_validity": r"""SELECT kind, row_id, CASE WHEN k IS NULL THEN 'null' WHEN k = '' THEN 'empty' WHEN length(k) > 256 OR strlen(k) > 256 THEN 'too_long' WHEN NOT regexp_matches(k, '\S') THEN 'blank' END AS problem
FROM (SELECT 'documents' AS kind, doc_id AS row_id, text AS k FROM documents UNION ALL SELECT 'pages', page_id, url FROM pages)""",
    "allocate_ordered": "SELECT event_type AS sequence_key, event_id AS tie, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS id FROM events",
    "reserve_ranges": """SELECT CAST(l_suppkey AS VARCHAR) AS sequence_key, l_orderkey AS seq, CAST(m - s + 1 AS BIGINT) AS first_id, CAST(m AS BIGINT) AS last_id
FROM (SELECT *, coalesce((SELECT max(s_suppkey * 1000) FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0), 0) + sum(s) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS m
  FROM (SELECT l_suppkey, l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1, 2))""",
    "watermark_after_prefetch": """SELECT sequence_key, n, CAST((r + CASE WHEN (n - (r - 1) * 10) / 10 >= 0.5 THEN 1 ELSE 0 END) * 10 AS BIGINT) AS max_id
FROM (SELECT CAST(user_id AS VARCHAR) AS sequence_key, count(*) AS n, CAST(ceil(count(*) / 10) AS BIGINT) AS r FROM events GROUP BY 1)""",
    "range_of_id": """SELECT sequence_key, id, (id - 1) // 100 * 100 + 1 AS first_id, (id - 1) // 100 * 100 + 100 AS last_id
FROM (SELECT event_type AS sequence_key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS id FROM events)""",
    "idle_gap_allocate": f"WITH {LOG}, {SESSIONS} SELECT sequence_key, tie, sid, id FROM ids",
    "idle_discarded": f"""WITH {LOG}, {SESSIONS}
SELECT sequence_key, sid, r * 10 - n AS discarded_active, u - r * 10 AS discarded_standby FROM based QUALIFY lead(sid) OVER (PARTITION BY sequence_key ORDER BY sid) IS NOT NULL""",
    "step_decision": f"""SELECT o_orderkey, active_step, elapsed_us, {_next_step('active_step', 'elapsed_us', '(o_orderkey % 9 + 1)', '10', 10, 100, 100 * DAY, 400 * DAY)} AS next_step
FROM (SELECT o_orderkey, CAST(10 * pow(2, o_orderkey % 5) AS BIGINT) AS active_step, epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS elapsed_us FROM orders)
WHERE elapsed_us IS NOT NULL""",
    "adaptive_replay": f"{REPLAY} SELECT sequence_key, tie, cur AS id, step AS active_step, w AS watermark, ev AS evictions, lost AS discarded FROM states",
    "stream_allocate": f"{REPLAY} SELECT sequence_key, tie, cur AS id, w AS watermark FROM states",
    "route_latest_newer": f"""WITH {OWNERS}
SELECT version, node_id, slot, CAST(known AS BIGINT) AS known FROM owners, (VALUES (0), (2), (3)) AS x(known)
WHERE version = (SELECT max(version) FROM owners o WHERE o.version > known)""",
    "route_violations": f"""WITH base AS (SELECT s AS slot, s % 2 AS entry, ['node-a', 'node-b'][s % 2 + 1] AS node_id FROM range({SLOT_COUNT}) AS t(s)),
forms AS (
  SELECT v AS version, base.* REPLACE (CASE WHEN v = 14 AND entry = 0 THEN '' WHEN v = 15 THEN 'node-a' ELSE node_id END AS node_id)
  FROM base, (VALUES (10), (11), (12), (13), (14), (15), (0)) AS x(v) WHERE v <> 11 OR slot <> 5
  UNION ALL VALUES (12, 7, 0, 'node-a'), (13, {SLOT_COUNT}, 1, 'node-b')),
told AS (
  SELECT version, 'bad_version' AS problem FROM forms WHERE version <= 0
  UNION SELECT 16, 'bad_json'
  UNION SELECT version, 'empty_node' FROM forms WHERE node_id = ''
  UNION SELECT version, 'duplicate_node' FROM forms WHERE node_id <> '' GROUP BY version, node_id HAVING count(DISTINCT entry) > 1
  UNION SELECT version, 'slot_range' FROM forms WHERE slot NOT BETWEEN 0 AND {SLOT_COUNT - 1}
  UNION SELECT version, 'duplicate_slot' FROM forms WHERE slot BETWEEN 0 AND {SLOT_COUNT - 1} GROUP BY version, slot HAVING count(*) > 1
  UNION SELECT version, 'coverage' FROM forms GROUP BY version HAVING count(DISTINCT slot) FILTER (WHERE slot BETWEEN 0 AND {SLOT_COUNT - 1}) <> {SLOT_COUNT})
SELECT CAST(version AS BIGINT) AS version, problem FROM told""",
    "route_diff": f"""WITH {OWNERS}, a AS (SELECT slot FROM owners WHERE version = 2 AND node_id = 'node-b'), b AS (SELECT slot FROM owners WHERE version = 3 AND node_id = 'node-b')
SELECT slot, 'dropped' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT slot, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "route_update_verdict": """SELECT CAST(h AS BIGINT) AS held_version, CAST(v AS BIGINT) AS version, CASE WHEN h IS NULL OR v > h THEN 'apply' WHEN v < h THEN 'regression' WHEN hc = c THEN 'noop' ELSE 'conflict' END AS verdict, count(*) AS n
FROM (VALUES (1, 1), (2, 2), (3, 3), (NULL, NULL)) AS held(h, hc), (VALUES (1, 1), (2, 2), (3, 3), (3, 2)) AS offers(v, c) GROUP BY 1, 2, 3""",
    "owner_lookup": f"""WITH {LOG}, {OWNERS}, {SLOTS}
SELECT node_id, count(*) AS n_requests, count(DISTINCT sequence_key) AS n_keys FROM log JOIN slots USING (sequence_key) JOIN owners USING (slot) WHERE version = 3 GROUP BY 1""",
    "owner_asof": f"""WITH {LOG}, {OWNERS}, {SLOTS},
p(version, taken, applies) AS (SELECT CAST(v AS BIGINT), CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) FROM ({_values(q.PUBLISHED)}) AS t(v, a, b)),
w AS (SELECT log.*, slot, (SELECT max(version) FROM p WHERE taken <= ts) AS taken_version, (SELECT max(version) FROM p WHERE applies <= ts) AS applied FROM log JOIN slots USING (sequence_key)),
served AS (
  SELECT tie, slot, o.version, o.node_id FROM w JOIN owners o USING (slot) WHERE o.version = w.applied
    AND (w.applied = w.taken_version OR EXISTS (SELECT 1 FROM owners n WHERE n.version = w.taken_version AND n.slot = w.slot AND n.node_id = o.node_id)))
SELECT w.tie, w.slot, served.version, served.node_id FROM w LEFT JOIN served USING (tie)""",
    "fetch_verdict": f"""WITH {LOG}, {OWNERS}, {SLOTS},
v AS (SELECT tie, node_id, dayofmonth(ts) * 4 AS managed, row_number() OVER (PARTITION BY sequence_key ORDER BY ts, tie) = 1 AS new FROM log JOIN slots USING (sequence_key) JOIN owners USING (slot) WHERE version = 3),
r AS (SELECT *, CASE WHEN tie % 10 = 0 THEN 'SEQUENCE_ALLOCATOR_PAUSED' WHEN node_id <> 'node-b' THEN 'SEQUENCE_SLOT_NOT_OWNER' WHEN new AND managed >= 50 THEN 'SEQUENCE_CAPACITY_EXHAUSTED' END AS reason FROM v)
SELECT tie, reason, CASE WHEN reason = 'SEQUENCE_SLOT_NOT_OWNER' THEN CASE WHEN tie % 7 IN (0, 1) THEN 'INVALID_ARGUMENT' WHEN CASE WHEN tie % 7 = 2 THEN 4 ELSE tie % 7 END <= 3 THEN 'SEQUENCE_ROUTE_EXPIRED' ELSE 'RETRY' END ELSE reason END AS answer FROM r""",
    "endpoint_ready_owner": f"""WITH e(name, node_id, state) AS ({_values(q.ENDPOINTS)})
SELECT node_id, min(name) AS name, (SELECT CASE WHEN count(*) FILTER (WHERE state = 'READY') > 0 THEN 'READY' WHEN count(*) = 0 OR count(*) FILTER (WHERE state = 'TRANSIENT_FAILURE') > 0 THEN 'TRANSIENT_FAILURE' ELSE 'CONNECTING' END FROM e) AS overall
FROM e WHERE node_id <> '' GROUP BY node_id HAVING count(*) = 1 AND min(state) = 'READY'""",
    "endpoint_round_robin": f"""WITH e(name, node_id, state) AS ({_values(q.ENDPOINTS)}), r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS k, count(*) OVER () AS n FROM e WHERE state = 'READY')
SELECT event_id, name FROM events JOIN r ON event_id % n = k""",
    "endpoint_reconcile": f"""WITH e(name, node_id, state) AS ({_values(q.ENDPOINTS)}), w(name, node_id) AS (VALUES ('e2', 'node-b'), ('e6', 'node-y'), ('e7', 'node-e'))
SELECT name, CASE WHEN w.name IS NULL THEN e.node_id ELSE w.node_id END AS node_id, CASE WHEN w.name IS NULL THEN 'removed' WHEN e.name IS NULL THEN 'added' ELSE 'kept' END AS change FROM e FULL JOIN w USING (name)""",
    "get_route": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'SEQUENCE_ROUTE_UNAVAILABLE' WHEN event_id % 5 >= 3 THEN 'not_modified' ELSE 'snapshot' END AS answer FROM events""",
    "audit_ids": f"""WITH {LOG}, {SESSIONS}, marks AS (SELECT sequence_key, sum(u) AS mark FROM based GROUP BY 1)
SELECT sequence_key, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) - count(DISTINCT id) AS n_duplicates, max(id) AS max_id, max(id) - count(DISTINCT id) AS n_gaps, max(mark) >= max(id) AS covered
FROM ids JOIN marks USING (sequence_key) GROUP BY 1""",
    "allocator_metrics": f"""WITH {LOG}, last AS (SELECT sequence_key, max(us) AS us FROM log GROUP BY 1)
SELECT count(*) AS cached_keys, 45::BIGINT AS managed_memory, 100::BIGINT AS memory_limit, CAST(45 AS DOUBLE) / 100 AS memory_utilization, 0 AS admission_rejected, count(*) AS cleanup_scanned, count(*) FILTER (WHERE us <= 1706486400000000) AS cleanup_evicted FROM last""",
    "cleanup": f"""WITH {LOG}, {SLOTS}, state AS (SELECT slot, sequence_key, max(us) AS us, count(*) AS n FROM log JOIN slots USING (sequence_key) GROUP BY ALL),
turns AS (SELECT *, (slot - 14000 + {SLOT_COUNT}) % {SLOT_COUNT} AS turn FROM state),
due AS (SELECT * FROM turns WHERE turn < 4096 AND us <= 1706486400000000 ORDER BY turn, sequence_key LIMIT 1024)
SELECT count(*) FILTER (WHERE n % 17 <> 0) AS evicted, count(*) FILTER (WHERE n % 17 = 0) AS inflight, CAST(coalesce(sum(greatest(100 - n, 0)) FILTER (WHERE n % 17 <> 0), 0) AS BIGINT) AS discarded_active,
  CAST(coalesce(sum(CASE WHEN n >= 50 THEN 100 ELSE 0 END) FILTER (WHERE n % 17 <> 0), 0) AS BIGINT) AS discarded_standby, (14000 + 4096) % {SLOT_COUNT} AS cursor FROM due""",
    "parse_memory_limit": f"""WITH v(value) AS ({_values([(x,) for x in q.SIZES])}),
p AS (SELECT value, regexp_extract(trim(value), '^([0-9]+)(TiB|GiB|MiB|KiB|B)?$', 1) AS d, regexp_extract(trim(value), '^([0-9]+)(TiB|GiB|MiB|KiB|B)?$', 2) AS u FROM v),
n AS (SELECT value, CAST(nullif(d, '') AS HUGEINT) * CASE u WHEN 'TiB' THEN 1099511627776 WHEN 'GiB' THEN 1073741824 WHEN 'MiB' THEN 1048576 WHEN 'KiB' THEN 1024 ELSE 1 END AS b FROM p),
k AS (SELECT value, CASE WHEN b <= 18446744073709551615::HUGEINT THEN b END AS b FROM n)
SELECT value, CAST(b AS VARCHAR) AS bytes, CASE WHEN b IS NULL THEN 'invalid' WHEN b < 67108864 THEN 'too_small' WHEN b >= 9223372036854775807 THEN 'unlimited' END AS problem FROM k""",
    "memory_limit_source": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part),
d AS (SELECT *, CASE WHEN n % 3 <> 0 AND n > 0 THEN n * 1073741824 END AS cg, CASE WHEN n % 5 <> 0 THEN 26843545600 END AS sy FROM p),
a AS (SELECT *, CAST(floor(least(cg, sy) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS auto, CASE WHEN cg IS NOT NULL AND (sy IS NULL OR cg <= sy) THEN 'cgroup' WHEN sy IS NOT NULL THEN 'system' END AS found FROM d)
SELECT p_partkey, CASE WHEN n % 7 = 0 THEN 536870912 WHEN n % 4 = 0 AND n % 8 <> 0 THEN 1073741824 ELSE auto END AS limit_bytes,
  CASE WHEN n % 7 = 0 THEN 'configuration' WHEN n % 4 = 0 AND n % 8 <> 0 THEN 'environment' ELSE found END AS source FROM a""",
    "release_violations": f"""WITH {RELEASES},
sel AS (SELECT DISTINCT service, place FROM c JOIN root ON root.module = regexp_extract(client, '^(.*)/v[^/]*$', 1) AND root.version = regexp_extract(client, '^.*/(v[^/]*)$', 1)),
told AS (
  SELECT service, version, 'bad_service' AS problem, service AS subject FROM r WHERE NOT regexp_matches(service, '^[a-z][a-z0-9]*$')
  UNION SELECT service, version, 'bad_version', version FROM r WHERE NOT regexp_matches(version, '{SEMVER}')
  UNION SELECT service, version, 'duplicate_version', version FROM r GROUP BY 1, 2 HAVING count(*) > 1
  UNION SELECT service, version, 'clients_without_contract', version FROM r WHERE contract = '' AND len(clients) > 0
  UNION SELECT service, version, 'bad_contract', contract FROM r WHERE contract <> '' AND NOT {_VALID_TAG('contract', 'gen/go/')}
  UNION SELECT service, version, 'foreign_contract', contract FROM r WHERE contract <> '' AND NOT starts_with(contract, 'gen/go/' || service || '/')
  UNION SELECT service, version, 'bad_client', client FROM c WHERE NOT {_VALID_TAG('client', 'pkg/')}
  UNION SELECT service, version, 'duplicate_client', client FROM c GROUP BY service, place, version, client HAVING count(*) > 1
  UNION SELECT service, version, 'missing_tag', tag FROM (SELECT service, version, contract AS tag FROM r UNION SELECT service, version, client FROM c) WHERE tag <> '' AND tag NOT IN (SELECT tag FROM tags)
  UNION SELECT service, version, 'root_contract', contract FROM r WHERE contract <> '' AND NOT EXISTS (SELECT 1 FROM root WHERE module = regexp_extract(contract, '^(.*)/v[^/]*$', 1) AND root.version = regexp_extract(contract, '^.*/(v[^/]*)$', 1))
  UNION SELECT service, version, 'client_contract', client FROM c WHERE contract <> '' AND NOT EXISTS (SELECT 1 FROM mods WHERE mods.client = c.client AND mods.module = cpath AND mods.version = cver)
  UNION SELECT service, version, 'no_selected_client', version FROM r WHERE len(clients) > 0 AND (service, place) NOT IN (SELECT (service, place) FROM sel)
  UNION SELECT service, version, 'removed_release', version FROM old WHERE (service, version) NOT IN (SELECT (service, version) FROM r)
  UNION SELECT old.service, old.version, 'changed_contract', old.contract FROM old JOIN r USING (service, version) WHERE old.contract <> r.contract
  UNION SELECT old.service, old.version, 'removed_client', x FROM (SELECT *, unnest(clients) AS x FROM old) AS old JOIN r USING (service, version) WHERE NOT list_contains(r.clients, x))
SELECT service, version, problem, subject FROM told""",
    "node_ticks": """WITH RECURSIVE t AS (
  SELECT CAST(k AS BIGINT) AS tick, n AS node_id, k % 2 = 0 AND k NOT BETWEEN 40 AND 49 AS beat, CASE WHEN k >= 30 THEN 3 WHEN k >= 10 THEN 2 ELSE 1 END AS v,
    CASE WHEN k >= 30 THEN CASE n WHEN 'node-a' THEN [3] ELSE [0, 1, 2] END WHEN k >= 10 THEN CASE n WHEN 'node-a' THEN [0, 2] ELSE [1, 3] END ELSE CASE n WHEN 'node-a' THEN [0, 1, 2, 3] ELSE [] END END AS own
  FROM range(61) AS r(k), (VALUES ('node-a'), ('node-b')) AS x(n)),
s AS (
  SELECT node_id, tick, false AS paused, CAST(0 AS BIGINT) AS version, CAST([] AS INTEGER[]) AS slots, 0 AS elapsed, CAST(v AS BIGINT) AS pv, tick + 3 AS pt, CAST(own AS INTEGER[]) AS ps, CAST(v AS BIGINT) AS kv, CAST(own AS INTEGER[]) AS ks FROM t WHERE tick = 0
  UNION ALL
  SELECT node_id, tick, paused AND NOT taken, version, CASE WHEN taken THEN kept ELSE slots END,
    CASE WHEN beat THEN 0 ELSE elapsed END, CASE WHEN taken AND rv > version THEN rv ELSE pv END, CASE WHEN taken AND rv > version THEN tick + 3 ELSE pt END,
    CASE WHEN taken AND rv > version THEN list_filter(rs, lambda x: NOT list_contains(kept, x)) ELSE ps END, CASE WHEN taken THEN rv ELSE kv END, CASE WHEN taken THEN rs ELSE ks END
  FROM (SELECT *, beat AND (v > kv OR paused) AS taken, CASE WHEN paused AND rv > version THEN CAST([] AS INTEGER[]) ELSE list_filter(slots, lambda x: list_contains(rs, x)) END AS kept
    FROM (SELECT t.node_id, t.tick, t.beat, CAST(t.v AS BIGINT) AS v, b.kv, b.ks, CASE WHEN t.v > b.kv THEN CAST(t.v AS BIGINT) ELSE b.kv END AS rv, CASE WHEN t.v > b.kv THEN CAST(t.own AS INTEGER[]) ELSE b.ks END AS rs,
        b.paused OR b.elapsed >= 3 AS paused, CASE WHEN due THEN b.pv ELSE b.version END AS version, CASE WHEN due THEN list_sort(list_distinct(b.slots || b.ps)) ELSE b.slots END AS slots,
        CASE WHEN b.elapsed >= 3 THEN b.elapsed ELSE b.elapsed + 1 END AS elapsed, CASE WHEN due THEN NULL ELSE b.pv END AS pv, b.pt, b.ps
      FROM (SELECT *, elapsed < 3 AND pv IS NOT NULL AND pt <= tick + 1 AS due FROM s) AS b JOIN t ON t.node_id = b.node_id AND t.tick = b.tick + 1)))
SELECT node_id, tick, paused, version, array_to_string(list_sort(slots), ',') AS slots FROM s""",
    "tree_drift": """WITH n AS (SELECT 'p' || page_id || CASE WHEN contains(url, '#') THEN '.htm' ELSE '.html' END AS path, CASE WHEN contains(url, '?') THEN html || '!' ELSE html END AS text FROM pages),
t AS (SELECT 'p' || page_id || '.html' AS path, html AS text FROM pages)
SELECT path, CASE WHEN t.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n FULL JOIN t USING (path) WHERE n.text IS DISTINCT FROM t.text""",
    "watermark_advance": """WITH m AS (SELECT CAST(s_suppkey AS VARCHAR) AS sequence_key, s_suppkey * 10 AS max_id FROM supplier),
d AS (SELECT CAST(c_custkey AS VARCHAR) AS sequence_key, c_custkey % 7 AS step FROM customer WHERE c_custkey % 7 > 0)
SELECT sequence_key, CAST(coalesce(max_id, 0) + coalesce(step, 0) AS BIGINT) AS max_id, CASE WHEN step > 0 THEN '2024-02-01' ELSE '2024-01-01' END AS updated_on FROM m FULL JOIN d USING (sequence_key)""",
    "metadata_integers": """SELECT event_id, CAST(CASE WHEN event_id % 7 IN (0, 1) THEN event_id WHEN event_id % 7 = 6 THEN -event_id END AS BIGINT) AS version FROM events""",
    "names_or_default": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'sequence' ELSE c_name END AS name FROM customer",
    "memory_utilization": """WITH m AS (SELECT p_partkey, CAST(greatest(p_size - p_partkey % 20, 0) AS BIGINT) AS managed FROM part)
SELECT p_partkey, managed, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(managed AS DOUBLE) / 64 END AS utilization FROM m""",
    "route_answer_problem": """SELECT event_id, CASE WHEN (event_id % 2 = 0) = (event_id % 5 > 1) THEN 'invalid' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'unavailable' END AS problem FROM events""",
    "route_reopen": f"""WITH {OWNERS} SELECT slot, CASE version WHEN 2 THEN 'dropped' ELSE 'added' END AS change, CAST(3 AS BIGINT) AS version
FROM owners WHERE node_id = 'node-b' AND version > 1""",
    "route_publication": f"""WITH {OWNERS}, n AS (SELECT version, node_id, '{{"node_id":"' || node_id || '","slots":[' || string_agg(CAST(slot AS VARCHAR), ',' ORDER BY slot) || ']}}' AS entry FROM owners GROUP BY version, node_id)
SELECT version, '{{"nodes":[' || string_agg(entry, ',' ORDER BY node_id) || ']}}' AS payload FROM n GROUP BY version""",
    "client_retry": f"""WITH r AS (SELECT event_id, [NULL, {", ".join(f"'{r}'" for r, _ in REASONS.values())}][event_id % {len(REASONS) + 1} + 1] AS reason, CASE WHEN event_id % 4 = 0 THEN 'UNAVAILABLE' ELSE 'INTERNAL' END AS code FROM events)
SELECT event_id, coalesce(reason IN ('SEQUENCE_SLOT_NOT_OWNER', 'SEQUENCE_ROUTE_EXPIRED'), false) OR code = 'UNAVAILABLE' AS again FROM r""",
    "ids_not_increasing": f"""WITH {LOG}, b AS (SELECT sequence_key, tie, tie % 100 AS id, lag(tie % 100) OVER (PARTITION BY sequence_key ORDER BY us, tie) AS before FROM log)
SELECT * FROM b WHERE id <= before""",
    "release_lookup": f"""WITH {RELEASES}, w(version) AS (VALUES ('v0.1.0'), ('v9.0.0'))
SELECT DISTINCT service, w.version, 'foreign_service' AS problem, service AS subject FROM r, w WHERE service <> 'sequence'
UNION ALL SELECT 'sequence', version, 'no_release', version FROM w WHERE version NOT IN (SELECT version FROM r WHERE service = 'sequence')""",
    "selected_clients": rf"""WITH {RELEASES}, x AS (SELECT service, place, version, unnest(clients) AS client, generate_subscripts(clients, 1) AS k FROM r)
SELECT service, CAST(place AS INTEGER) AS place, x.version, arg_min(client, k) AS client FROM x JOIN root ON client = root.module || '/' || root.version GROUP BY ALL""",
    "tag_parts": """WITH k AS (SELECT p_partkey, p_partkey % 5 AS m, CAST(p_partkey AS VARCHAR) AS n FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN 'gen/go/p' || n WHEN 1 THEN 'gen/go/p/v2' WHEN 2 THEN 'pkg/p' || n WHEN 3 THEN 'gen/go/' ELSE '' END AS path,
  CASE m WHEN 0 THEN 'v1.2.' || n WHEN 1 THEN 'v' || n WHEN 2 THEN 'v0.0.1' WHEN 3 THEN 'v1.0.' || n ELSE '' END AS version, m = 0 AS valid FROM k""",
}

ORACLE_SQL["version_barrier"] = f"""WITH log AS ({ORACLE_SQL["node_ticks"]}), w AS (SELECT n AS node_id, CAST(v AS BIGINT) AS version, CAST(t AS BIGINT) AS tick FROM (VALUES ('node-a'), ('node-b')) AS a(n), range(1, 5) AS b(v), (VALUES (5), (35)) AS c(t))
SELECT w.node_id, w.version, w.tick, (SELECT min(greatest(log.tick, w.tick)) FROM log WHERE log.node_id = w.node_id AND log.version >= w.version) AS ready_tick FROM w"""
