"""DuckDB SQL for the graph queries, over the same relational tables."""

from __future__ import annotations

from graphlens.plans import code_oracle

_VERB = "CASE o_orderpriority WHEN '1-URGENT' THEN 'POST' WHEN '2-HIGH' THEN 'PUT' WHEN '4-NOT SPECIFIED' THEN 'DELETE' WHEN '5-LOW' THEN 'PATCH' ELSE 'GET' END"
_EP = f"'endpoint:' || {_VERB} || ':/orders/' || o_orderkey || ':get'"
_NATIVE = "CASE lang WHEN 'de' THEN 'Uses reflection' WHEN 'fr' THEN 'Creates dynamic proxies' WHEN 'es' THEN 'Loads resources' ELSE 'Custom scope' END"
_STEREO = "concat_ws(',', CASE WHEN s_suppkey % 3 = 0 THEN 'TRANSACTION_INTERCEPTOR' END, CASE WHEN s_suppkey % 5 = 0 THEN 'RETRY_INTERCEPTOR' END)"
_PROXIED = "s_suppkey % 3 = 0 OR s_suppkey % 5 = 0"

PRELUDE = f"""WITH RECURSIVE nodes AS MATERIALIZED (
  SELECT 'module:r' || r_regionkey AS id, r_name AS name, 'MODULE' AS type, r_name AS artifact, NULL AS file, NULL AS ann, NULL AS instr, NULL AS proxy, NULL AS verb, NULL AS path, NULL AS spec, NULL AS dflt, NULL AS version, NULL AS severity, NULL AS issue FROM region
  UNION ALL BY NAME SELECT 'module:n' || n_nationkey AS id, n_name AS name, 'MODULE' AS type, n_name AS artifact FROM nation
  UNION ALL BY NAME SELECT 'class:c' || c_custkey AS id, c_name AS name, 'CONTROLLER' AS type, c_mktsegment || '.java' AS file, 'RestController' || CASE WHEN c_custkey % 10 = 0 THEN ',Deprecated' ELSE '' END AS ann FROM customer
  UNION ALL BY NAME SELECT 'class:s' || s_suppkey AS id, s_name AS name, 'SERVICE' AS type, 'Service' || CASE WHEN s_suppkey % 3 = 0 THEN ',Transactional' ELSE '' END AS ann, CASE WHEN s_acctbal > 5000 THEN 'true' END AS instr FROM supplier
  UNION ALL BY NAME SELECT 'class:p' || p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'REPOSITORY' WHEN 1 THEN 'COMPONENT' ELSE 'DATA_REPOSITORY' END AS type FROM part
  UNION ALL BY NAME SELECT 'proxy:s' || s_suppkey AS id, 'proxy of ' || s_name AS name, 'PROXY' AS type, {_STEREO} AS proxy FROM supplier WHERE {_PROXIED}
  UNION ALL BY NAME SELECT {_EP} AS id, 'order ' || o_orderkey AS name, 'CONTROLLER_ENDPOINT' AS type, {_VERB} AS verb, '/orders/' || o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'true' END AS spec FROM orders
  UNION ALL BY NAME SELECT 'auth_rule:O' AS id, 'open orders' AS name, 'AUTH_RULE' AS type
  UNION ALL BY NAME SELECT 'security_filter_chain:r' || r_regionkey AS id, r_name AS name, 'SECURITY_FILTER_CHAIN' AS type FROM region
  UNION ALL BY NAME SELECT 'security_flag:csrf_r' || r_regionkey AS id, 'CSRF_DISABLED' AS name, 'SECURITY_FLAG' AS type FROM region WHERE r_regionkey % 2 = 0
  UNION ALL BY NAME SELECT 'external_service:n' || n_nationkey AS id, n_name AS name, 'EXTERNAL_SERVICE' AS type FROM nation
  UNION ALL BY NAME SELECT 'test:p' || p_partkey AS id, 'test of p' || p_partkey AS name, 'TEST' AS type FROM part WHERE p_partkey % 7 = 0
  UNION ALL BY NAME SELECT 'test:s' || s_suppkey AS id, 'test of s' || s_suppkey AS name, 'TEST' AS type FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL BY NAME SELECT 'metric:' || range AS id, 'metric ' || range AS name, 'METRIC' AS type FROM range(10)
  UNION ALL BY NAME SELECT 'trace_span:' || range AS id, 'span ' || range AS name, 'TRACE_SPAN' AS type FROM range(10)
  UNION ALL BY NAME SELECT DISTINCT 'message_topic:' || event_type AS id, event_type AS name, 'MESSAGE_TOPIC' AS type FROM events
  UNION ALL BY NAME SELECT 'config_key:n' || n_nationkey AS id, 'app.' || n_name AS name, 'CONFIG_KEY' AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS dflt FROM nation
  UNION ALL BY NAME SELECT 'config_value:n' || n_nationkey AS id, n_name AS name, 'CONFIG_VALUE' AS type FROM nation WHERE n_nationkey % 3 <> 0
  UNION ALL BY NAME SELECT DISTINCT 'dto:' || p_brand AS id, p_brand AS name, 'DATA_TRANSFER_OBJECT' AS type FROM part
  UNION ALL BY NAME SELECT DISTINCT 'persistence_entity:' || p_type AS id, p_type AS name, 'PERSISTENCE_ENTITY' AS type FROM part
  UNION ALL BY NAME SELECT 'schema_migration:r' || r_regionkey AS id, 'V' || r_regionkey AS name, 'SCHEMA_MIGRATION' AS type, CAST(r_regionkey AS VARCHAR) AS version FROM region
  UNION ALL BY NAME SELECT 'schema_table:n' || n_nationkey AS id, n_name AS name, 'SCHEMA_TABLE' AS type FROM nation
  UNION ALL BY NAME SELECT 'schema_column:n' || n_nationkey AS id, 'id_' || n_name AS name, 'SCHEMA_COLUMN' AS type FROM nation
  UNION ALL BY NAME SELECT 'perf:issue:' || doc_id AS id, 'N+1 query' AS name, 'PERFORMANCE_ISSUE' AS type, 'HIGH' AS severity FROM labels JOIN documents USING (doc_id) WHERE quality = 0
  UNION ALL BY NAME SELECT 'perf:hint:' || doc_id AS id, 'cacheable' AS name, 'PERFORMANCE_HINT' AS type, 'LOW' AS severity FROM labels JOIN documents USING (doc_id) WHERE quality = 1
  UNION ALL BY NAME SELECT 'compat_issue:' || doc_id AS id, {_NATIVE} AS name, 'COMPATIBILITY_ISSUE' AS type, {_NATIVE} AS issue FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
), ol AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
op AS (SELECT * FROM ol JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50),
edges AS MATERIALIZED (
  SELECT 'module:n' || n_nationkey AS s, 'module:r' || n_regionkey AS t, 'DEPENDS_ON' AS type FROM nation
  UNION SELECT {_EP}, 'class:c' || o_custkey, 'ROUTES_TO' FROM orders
  UNION SELECT {_EP}, 'auth_rule:O', 'SECURED_BY' FROM orders WHERE o_orderstatus = 'O'
  UNION SELECT 'security_filter_chain:r' || r_regionkey, 'security_flag:csrf_r' || r_regionkey, 'CONFIGURED_BY' FROM region WHERE r_regionkey % 2 = 0
  UNION SELECT 'class:c' || o_custkey, 'class:s' || l_suppkey, 'CALLS' FROM ol WHERE l_quantity >= 49
  UNION SELECT 'class:c' || o_custkey, 'proxy:s' || l_suppkey, 'CALLS' FROM ol JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49 AND ({_PROXIED})
  UNION SELECT 'proxy:s' || s_suppkey, 'class:s' || s_suppkey, 'CALLS' FROM supplier WHERE {_PROXIED}
  UNION SELECT 'class:s' || l_suppkey, 'class:p' || l_partkey, 'INJECTS' FROM lineitem WHERE l_quantity >= 49
  UNION SELECT 'class:p' || l_partkey, 'class:s' || l_suppkey, 'INJECTS' FROM lineitem WHERE l_quantity <= 1 AND l_returnflag = 'R'
  UNION SELECT 'class:c' || o_custkey, 'class:p' || l_partkey, 'INJECTS' FROM ol WHERE l_quantity = 50 AND l_returnflag = 'A'
  UNION SELECT 'class:s' || s_suppkey, 'external_service:n' || s_nationkey, 'CALLS_REMOTE' FROM supplier
  UNION SELECT 'class:c' || c_custkey, 'external_service:n' || c_nationkey, 'CALLS_REMOTE' FROM customer WHERE c_mktsegment = 'MACHINERY'
  UNION SELECT 'test:p' || p_partkey, 'class:p' || p_partkey, 'TESTS' FROM part WHERE p_partkey % 7 = 0
  UNION SELECT 'test:s' || s_suppkey, 'class:s' || s_suppkey, 'MOCKS' FROM supplier WHERE s_suppkey % 5 = 0
  UNION SELECT 'test:s' || s_suppkey, 'class:s' || s_suppkey, 'TESTS' FROM supplier WHERE s_suppkey % 7 = 0
  UNION SELECT 'class:s' || s_suppkey, 'metric:' || (s_suppkey % 10), 'MEASURES' FROM supplier WHERE s_suppkey % 2 = 0
  UNION SELECT 'class:s' || s_suppkey, 'trace_span:' || (s_suppkey % 10), 'TRACES' FROM supplier WHERE s_suppkey % 4 = 0
  UNION SELECT 'class:c' || user_id, 'message_topic:' || event_type, 'PUBLISHES_TO' FROM events WHERE event_type IN ('purchase', 'signup')
  UNION SELECT 'message_topic:' || event_type, 'class:c' || user_id, 'SUBSCRIBES_FROM' FROM events WHERE event_type NOT IN ('purchase', 'signup')
  UNION SELECT 'config_key:n' || n_nationkey, 'config_value:n' || n_nationkey, 'RESOLVES_TO' FROM nation WHERE n_nationkey % 3 <> 0
  UNION SELECT 'class:s' || s_suppkey, 'config_key:n' || s_nationkey, 'USES_CONFIG' FROM supplier
  UNION SELECT {_EP}, 'dto:' || p_brand, 'ACCEPTS' FROM op
  UNION SELECT {_EP}, 'dto:' || p_brand, 'RETURNS' FROM op WHERE l_returnflag = 'R'
  UNION SELECT 'dto:' || p_brand, 'persistence_entity:' || p_type, 'MAPS_TO' FROM part WHERE p_size = 50
  UNION SELECT 'schema_migration:r' || n_regionkey, 'schema_table:n' || n_nationkey, 'CONTAINS' FROM nation
  UNION SELECT 'schema_table:n' || n_nationkey, 'schema_column:n' || n_nationkey, 'CONTAINS' FROM nation
  UNION SELECT 'persistence_entity:' || p_type, 'schema_table:n' || p_size, 'SCHEMA_MAPS_TO' FROM part WHERE p_size < 25
)"""

_UNSECURED = "SELECT id, verb, path, CASE WHEN verb IN ('POST','PUT','DELETE','PATCH') THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM nodes WHERE type = 'CONTROLLER_ENDPOINT' AND id NOT IN (SELECT s FROM edges WHERE type = 'SECURED_BY') AND id NOT IN (SELECT t FROM edges WHERE type = 'SECURED_BY')"
_UNDEFINED = "SELECT id, name, 'STARTUP_FAILURE' AS risk FROM nodes WHERE type = 'CONFIG_KEY' AND dflt <> 'true' AND id NOT IN (SELECT s FROM edges WHERE type = 'RESOLVES_TO')"
_UNDOCUMENTED = "SELECT id, path, verb FROM nodes WHERE type = 'CONTROLLER_ENDPOINT' AND spec IS NULL"
_UNTESTED = "SELECT id, name, type FROM nodes WHERE type IN ('SERVICE','REPOSITORY','COMPONENT') AND id NOT IN (SELECT t FROM edges WHERE type = 'TESTS')"
_RULES = "(VALUES ('ARCH-001','ERROR','INJECTS','CONTROLLER','REPOSITORY'),('ARCH-002','ERROR','INJECTS','CONTROLLER','DATA_REPOSITORY'),('ARCH-003','ERROR','INJECTS','REPOSITORY','SERVICE'),('ARCH-004','WARNING','PUBLISHES_TO','CONTROLLER','MESSAGE_TOPIC'),('ARCH-005','WARNING','CALLS_REMOTE','CONTROLLER','EXTERNAL_SERVICE'){more}) r(rule_id, severity, edge, st, tt)"
_VIOLATIONS = "SELECT rule_id, r.severity, e.s AS source_id, e.t AS target_id FROM edges e JOIN " + _RULES + " ON e.type = r.edge JOIN nodes a ON a.id = e.s AND a.type = r.st JOIN nodes b ON b.id = e.t AND b.type = r.tt"
_JOINED = "coalesce(string_agg(DISTINCT {0}, ',' ORDER BY {0}), '')"
_INJ = "inj AS (SELECT DISTINCT s, t FROM edges WHERE type = 'INJECTS')"
_CYCLES = """c1 AS (SELECT s a FROM inj WHERE s = t),
c2 AS (SELECT x.s a, x.t b FROM inj x JOIN inj y ON x.t = y.s AND y.t = x.s WHERE x.s < x.t),
c3 AS (SELECT x.s a, x.t b, y.t c FROM inj x JOIN inj y ON x.t = y.s JOIN inj z ON y.t = z.s AND z.t = x.s WHERE x.s < x.t AND x.s < y.t AND x.t <> y.t),
c4 AS (SELECT x.s a, x.t b, y.t c, z.t d FROM inj x JOIN inj y ON x.t = y.s JOIN inj z ON y.t = z.s JOIN inj w ON z.t = w.s AND w.t = x.s
  WHERE x.s < x.t AND x.s < y.t AND x.s < z.t AND x.t <> y.t AND y.t <> z.t AND x.t <> z.t),
cyc AS (SELECT CAST(1 AS BIGINT) AS length, a || ' -> ' || a AS path FROM c1 UNION SELECT 2, a || ' -> ' || b || ' -> ' || a FROM c2
  UNION SELECT 3, a || ' -> ' || b || ' -> ' || c || ' -> ' || a FROM c3 UNION SELECT 4, a || ' -> ' || b || ' -> ' || c || ' -> ' || d || ' -> ' || a FROM c4)"""
#: Classes on cycles: all of the projection's cycles go from services to parts and back.
_KNOTS = """ss AS (SELECT DISTINCT x.s AS a, y.t AS b FROM inj x JOIN inj y ON x.t = y.s WHERE x.s LIKE 'class:s%' AND y.t LIKE 'class:s%'),
sr AS (SELECT a, b FROM ss UNION SELECT sr.a, ss.b FROM sr JOIN ss ON sr.b = ss.a),
scc AS (SELECT f.a AS id, min(f.b) AS root FROM sr f JOIN sr g ON g.a = f.b AND g.b = f.a GROUP BY f.a),
member AS (SELECT id, root FROM scc
  UNION SELECT x.t, c.root FROM inj x JOIN scc c ON c.id = x.s JOIN inj y ON y.s = x.t JOIN scc d ON d.id = y.t AND d.root = c.root),
comp AS (SELECT root, min(id) AS least FROM member GROUP BY root)"""
_LONG = """short AS (SELECT a AS id FROM c2 UNION SELECT b FROM c2 UNION SELECT a FROM c4 UNION SELECT b FROM c4 UNION SELECT c FROM c4 UNION SELECT d FROM c4),
long AS (SELECT least FROM comp WHERE root NOT IN (SELECT root FROM scc JOIN short USING (id)))"""
_GUARDED = "SELECT t FROM edges WHERE type = 'CALLS' AND s IN (SELECT id FROM nodes WHERE type = 'PROXY' AND regexp_matches(proxy, 'RETRY|CIRCUIT_BREAKER_INTERCEPTOR'))"
_ISSUES = (
    "iss AS (SELECT 'DEPENDENCY_HEALTH' AS dimension, path AS node_id, 'dependency cycle' AS reason, 20 AS penalty, 'MEDIUM' AS level FROM cyc"
    f" UNION ALL SELECT 'SECURITY_HEALTH', id, 'unsecured endpoint', CASE severity WHEN 'CRITICAL' THEN 25 ELSE 15 END, severity FROM ({_UNSECURED})"
    " UNION ALL SELECT 'DEPENDENCY_HEALTH', least, 'long dependency cycle', 20, 'MEDIUM' FROM long"
    " UNION ALL SELECT 'SECURITY_HEALTH', id, 'CSRF disabled', 20, 'HIGH' FROM nodes WHERE type = 'SECURITY_FLAG'"
    f" UNION ALL SELECT 'RESILIENCE_HEALTH', s, 'remote call without retry', 15, 'MEDIUM' FROM edges WHERE type = 'CALLS_REMOTE' AND t IN (SELECT id FROM nodes) AND s NOT IN ({_GUARDED})"
    f" UNION ALL SELECT 'TEST_HEALTH', id, 'untested', 5, 'MEDIUM' FROM ({_UNTESTED})"
    " UNION ALL SELECT 'OBSERVABILITY_HEALTH', id, 'no metrics or traces', 8, 'MEDIUM' FROM nodes WHERE type IN ('SERVICE','CONTROLLER') AND id NOT IN (SELECT s FROM edges WHERE type IN ('MEASURES','TRACES'))"
    " UNION ALL SELECT 'OBSERVABILITY_HEALTH', id, 'not instrumented', 5, 'MEDIUM' FROM nodes WHERE type IN ('SERVICE','CONTROLLER') AND instr IS NULL"
    " UNION ALL SELECT 'OBSERVABILITY_HEALTH', id, 'no health indicator', 10, 'HIGH' FROM nodes WHERE type = 'DATA_REPOSITORY'"
    " UNION ALL SELECT 'OBSERVABILITY_HEALTH', s, 'untraced remote call', 12, 'HIGH' FROM edges WHERE type = 'CALLS_REMOTE' AND s NOT IN (SELECT s FROM edges WHERE type = 'TRACES')"
    f" UNION ALL SELECT 'CONTRACT_HEALTH', id, 'undocumented endpoint', 10, 'LOW' FROM ({_UNDOCUMENTED})"
    f" UNION ALL SELECT 'CONTRACT_HEALTH', id, 'undefined property', 8, 'HIGH' FROM ({_UNDEFINED})"
    f" UNION ALL SELECT 'ARCHITECTURE_RULES_HEALTH', source_id, 'rule violation', CASE severity WHEN 'ERROR' THEN 20 ELSE 10 END, CASE severity WHEN 'ERROR' THEN 'HIGH' ELSE 'MEDIUM' END FROM ({_VIOLATIONS.format(more='')})),"
    " dims AS (SELECT dimension, CAST(count(node_id) AS BIGINT) AS n_issues, CAST(greatest(0, 100 - coalesce(sum(penalty), 0)) AS BIGINT) AS score FROM"
    " (VALUES ('DEPENDENCY_HEALTH'),('SECURITY_HEALTH'),('RESILIENCE_HEALTH'),('TEST_HEALTH'),('OBSERVABILITY_HEALTH'),('CONTRACT_HEALTH'),('ARCHITECTURE_RULES_HEALTH')) d(dimension) LEFT JOIN iss USING (dimension) GROUP BY dimension)"
)


def _bfs(edges: str, seeds: str, depth: int, both: bool = False) -> str:
    back = f" UNION SELECT t, s FROM ({edges})" if both else ""
    return (
        f"step AS (SELECT s, t FROM ({edges}){back}), walk AS (SELECT id AS seed, id, 0 AS depth FROM ({seeds})"
        f" UNION SELECT w.seed, step.t, w.depth + 1 FROM walk w JOIN step ON step.s = w.id WHERE w.depth < {depth}),"
        " seen AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY ALL)"
    )


def _calls(kinds: str) -> str:
    return f"SELECT DISTINCT s, t FROM edges WHERE type IN ({kinds})"


def sql(body: str, *steps: str) -> str:
    """A statement over the projected graph."""
    return ", ".join((PRELUDE, *steps)) + "\n" + body


def flat(body: str) -> str:
    """A statement over the projected graph that needs no recursion and reads each part of it once or twice."""
    return PRELUDE.replace("WITH RECURSIVE", "WITH").replace(" AS MATERIALIZED (", " AS (") + "\n" + body


_META = "concat_ws(' ', artifact, file, ann, instr, proxy, verb, path, spec, dflt, version, severity, issue)"


def _field(name: str, text: str) -> str:
    """Words (id, w) of a field and its totals."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
    return f"{name}_w AS (SELECT id, {words} AS w FROM nodes), {name}_t AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM {name}_w WHERE len(w) > 0)"


def _met(name: str, field: str, word: str, boost: float = 1) -> str:
    """(id, score) of the nodes with a word in a field."""
    hits = f"SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = '{word}')) AS tf FROM {field}_w WHERE list_contains(w, '{word}')"
    idf = "ln(1 + (docs - df + 0.5) / (df + 0.5))"
    part = f"{boost} * {idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"
    return f"{name} AS (SELECT id, {part} AS score FROM ({hits}) h, {field}_t, (SELECT count(*) AS df FROM ({hits})) d)"


def _phrase(name: str, field: str, first: str, second: str, boost: float) -> str:
    """(id, score) of the nodes with two words in a row."""
    tf = f"len(list_filter(range(1, len(w)), lambda i: w[i] = '{first}' AND w[i + 1] = '{second}'))"
    idf = " + ".join(f"(SELECT ln(1 + (max(docs) - count(*) + 0.5) / (count(*) + 0.5)) FROM {field}_w, {field}_t WHERE list_contains(w, '{w}'))" for w in (first, second))
    return f"{name} AS (SELECT id, {boost} * ({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM (SELECT id, len(w) AS dl, {tf} AS tf FROM {field}_w) h, {field}_t WHERE tf > 0)"


def _best(rows: str) -> str:
    return f"SELECT n.id, n.name, n.type, round(s.score, 4) AS score FROM ({rows}) s JOIN nodes n USING (id) ORDER BY score DESC, n.id LIMIT 10"


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    name, kind, data = _field("name", "coalesce(name, '')"), _field("kind", "type"), _field("data", _META)
    start = "SELECT 'class:c0' AS id"
    closure = "clos AS (SELECT 'class:c0' AS id UNION SELECT e.t FROM clos JOIN edges e ON e.s = clos.id WHERE e.type IN ('IMPLEMENTS','EXTENDS','CALLS'))"
    trans = "SELECT id FROM nodes WHERE type = 'PROXY' AND contains(proxy, 'TRANSACTION_INTERCEPTOR')"
    flow_edges = "SELECT DISTINCT s, t FROM edges WHERE type IN ('MAPS_TO','CALLS','RETURNS','ACCEPTS') AND t IN (SELECT id FROM nodes)"
    terms = "toks AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, type, artifact, file, ann, instr, proxy, verb, path, spec, dflt, version, severity, issue)), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM nodes), post AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks), tf AS (SELECT id, dl, term, count(*) AS tf FROM post GROUP BY ALL), tot AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM toks WHERE len(w) > 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
    commits = "SELECT md5(conv_id || ':' || turn) AS hash, text AS message, CASE role WHEN 'user' THEN 'GPG' WHEN 'assistant' THEN 'SSH' END AS signature FROM conversations"
    old = "SELECT o_orderkey AS path, o_totalprice AS size, CASE WHEN o_orderdate < (SELECT m FROM mid) THEN o_orderstatus ELSE 'O' END AS sha256 FROM orders WHERE o_orderdate < (SELECT m FROM mid) OR o_orderstatus = 'O'"
    return code_oracle.oracle_sql() | {
        "graph_summary": sql("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"),
        "api_surface": sql("SELECT n.id, n.path, n.verb, coalesce(e.t, 'unknown') AS controller FROM nodes n LEFT JOIN edges e ON e.s = n.id AND e.type = 'ROUTES_TO' WHERE n.type = 'CONTROLLER_ENDPOINT'"),
        "trace_message_flow": sql("SELECT 'producer' AS role, s AS id, name FROM edges e LEFT JOIN nodes n ON n.id = e.s WHERE e.type = 'PUBLISHES_TO' AND t = 'message_topic:purchase' UNION ALL SELECT 'consumer', t, name FROM edges e LEFT JOIN nodes n ON n.id = e.t WHERE e.type = 'SUBSCRIBES_FROM' AND s = 'message_topic:purchase'"),
        "module_dependency_graph": sql(f"SELECT m.id, m.artifact, {_JOINED.format('d.name')} AS depends_on FROM nodes m LEFT JOIN edges e ON e.s = m.id AND e.type = 'DEPENDS_ON' LEFT JOIN nodes d ON d.id = e.t WHERE m.type = 'MODULE' GROUP BY m.id, m.artifact"),
        "cross_module_violations": sql("SELECT a.name AS source, b.name AS target, a.layer AS source_layer, b.layer AS target_layer FROM edges e JOIN lay a ON a.id = e.s JOIN lay b ON b.id = e.t WHERE e.type = 'DEPENDS_ON' AND b.layer < a.layer", "lay AS (SELECT id, name, CAST(CASE WHEN contains(lower(name), 'america') THEN 0 WHEN contains(lower(name), 'a') THEN 1 WHEN contains(lower(name), 'e') THEN 2 END AS BIGINT) AS layer FROM nodes WHERE type = 'MODULE')"),
        "audit_security_boundaries": sql(_UNSECURED),
        "security_filter_chain": sql(f"SELECT c.id, c.name, {_JOINED.format('f.name')} AS flags FROM nodes c LEFT JOIN edges e ON e.s = c.id AND e.type = 'CONFIGURED_BY' LEFT JOIN nodes f ON f.id = e.t WHERE c.type = 'SECURITY_FILTER_CHAIN' GROUP BY c.id, c.name"),
        "trace_config_property": sql("SELECT role, r.id, NOT bool_or(role = 'definition') OVER () AND dflt <> 'true' AS undefined FROM (SELECT 'consumer' AS role, s AS id, t AS k FROM edges WHERE type = 'USES_CONFIG' UNION ALL SELECT 'definition', t, s FROM edges WHERE type = 'RESOLVES_TO') r JOIN nodes n ON n.id = r.k WHERE n.name = (SELECT 'app.' || n_name FROM nation WHERE n_nationkey = 3)"),
        "audit_undefined_properties": sql(_UNDEFINED),
        "undocumented_endpoints": sql(_UNDOCUMENTED),
        "dto_lineage": sql("SELECT CASE type WHEN 'ACCEPTS' THEN 'input' ELSE 'output' END AS direction, type AS relation, s AS id FROM edges WHERE type IN ('ACCEPTS','RETURNS') AND t = 'dto:' || (SELECT min(p_brand) FROM part) UNION ALL SELECT 'mapping', type, t FROM edges WHERE type = 'MAPS_TO' AND s = 'dto:' || (SELECT min(p_brand) FROM part)"),
        "service_topology": sql(f"SELECT n.id, n.name, count(e.s) AS n_callers, {_JOINED.format('e.s')} AS callers FROM nodes n LEFT JOIN edges e ON e.t = n.id AND e.type = 'CALLS_REMOTE' WHERE n.type = 'EXTERNAL_SERVICE' GROUP BY n.id, n.name"),
        "resilience_gaps": flat(
            "SELECT e.s AS source_id, e.t AS target_id FROM edges e WHERE e.type = 'CALLS_REMOTE' AND EXISTS (SELECT 1 FROM nodes a WHERE a.id = e.s) AND EXISTS (SELECT 1 FROM nodes b WHERE b.id = e.t)"
            " AND NOT EXISTS (SELECT 1 FROM edges c JOIN nodes p ON p.id = c.t WHERE c.s = e.s AND c.type = 'CALLS' AND p.type = 'PROXY'"
            " AND regexp_matches(p.proxy, 'RETRY|CIRCUIT_BREAKER|BULKHEAD|TIME_LIMITER'))"
        ),
        "test_coverage_map": sql("SELECT count(*) FILTER (x) AS tested, count(*) FILTER (NOT x AND m) AS mocked_only, count(*) FILTER (NOT x AND NOT m) AS untested FROM (SELECT id IN (SELECT t FROM edges WHERE type = 'TESTS') AS x, id IN (SELECT t FROM edges WHERE type = 'MOCKS') AS m FROM nodes WHERE type NOT IN ('TEST','PROXY','MODULE'))"),
        "untested_components": sql(_UNTESTED),
        "observability_map": sql(f"SELECT lower(n.type) AS kind, n.id, {_JOINED.format('e.s')} AS watched_by FROM nodes n LEFT JOIN edges e ON e.t = n.id AND e.type IN ('MEASURES','TRACES') WHERE n.type IN ('METRIC','TRACE_SPAN') GROUP BY n.type, n.id"),
        "uninstrumented_services": sql("SELECT id, name, type FROM nodes WHERE type IN ('SERVICE','CONTROLLER') AND instr IS NULL AND id NOT IN (SELECT s FROM edges WHERE type IN ('MEASURES','TRACES'))"),
        "architecture_rules": flat(_VIOLATIONS.format(more="")),
        "custom_rule": flat(_VIOLATIONS.format(more=",('OWN-001','WARNING','CALLS','CONTROLLER','SERVICE')")),
        "performance_antipatterns": sql("SELECT id, CASE type WHEN 'PERFORMANCE_ISSUE' THEN 'issue' ELSE 'hint' END AS kind, name, severity FROM nodes WHERE type IN ('PERFORMANCE_ISSUE','PERFORMANCE_HINT')"),
        "entity_schema": sql("SELECT mapped, unmapped_entities, unmapped_tables, CAST(CASE WHEN mapped = 0 AND unmapped_entities = 0 THEN 100 ELSE greatest(0, 100 - 15 * unmapped_entities - 5 * unmapped_tables) END AS BIGINT) AS score FROM (SELECT count(*) FILTER (id IN (SELECT s FROM edges WHERE type = 'SCHEMA_MAPS_TO')) AS mapped, count(*) FILTER (id NOT IN (SELECT s FROM edges WHERE type = 'SCHEMA_MAPS_TO')) AS unmapped_entities FROM nodes WHERE type = 'PERSISTENCE_ENTITY'), (SELECT count(*) AS unmapped_tables FROM nodes WHERE type = 'SCHEMA_TABLE' AND id NOT IN (SELECT t FROM edges WHERE type = 'SCHEMA_MAPS_TO'))"),
        "migration_timeline": sql(f"SELECT m.id, CAST(m.version AS BIGINT) AS version, {_JOINED.format('t.name')} AS tables, {_JOINED.format('c.name')} AS columns FROM nodes m LEFT JOIN edges e ON e.s = m.id AND e.type = 'CONTAINS' LEFT JOIN nodes t ON t.id = e.t LEFT JOIN edges f ON f.s = t.id AND f.type = 'CONTAINS' LEFT JOIN nodes c ON c.id = f.t WHERE m.type = 'SCHEMA_MIGRATION' GROUP BY m.id, m.version"),
        "native_compatibility": sql("SELECT *, CASE WHEN readiness >= 80 THEN 'Near-ready' WHEN readiness >= 50 THEN 'Work needed' ELSE 'Not ready' END AS label FROM (SELECT *, CAST(greatest(0, least(100, 100 - 15*reflection - 12*proxies - 8*resources - 10*scopes - 10*lazies)) AS BIGINT) AS readiness FROM (SELECT count(*) FILTER (contains(i, 'reflect')) AS reflection, count(*) FILTER (contains(i, 'prox')) AS proxies, count(*) FILTER (contains(i, 'resource')) AS resources, count(*) FILTER (contains(i, 'scope')) AS scopes, count(*) FILTER (contains(i, 'lazy')) AS lazies, CAST(0 AS BIGINT) AS aot FROM (SELECT lower(issue) AS i FROM nodes WHERE type = 'COMPATIBILITY_ISSUE')))"),
        "find_by_annotation": sql("SELECT id, name, type FROM nodes WHERE list_contains(string_split(ann, ','), 'Transactional')"),
        "dead_components": sql("SELECT id, name, type, id IN (SELECT t FROM edges WHERE type = 'TESTS') AS tested FROM nodes WHERE type IN ('SERVICE','REPOSITORY','COMPONENT','CONTROLLER') AND id NOT IN (SELECT t FROM edges WHERE type IN ('INJECTS','CALLS','IMPLEMENTS','EXTENDS','PUBLISHES_TO','SUBSCRIBES_FROM','CALLS_REMOTE','USES_CONFIG'))"),
        "deprecated_usage": sql("SELECT n.id, e.s AS caller FROM nodes n LEFT JOIN edges e ON e.t = n.id AND e.type = 'CALLS' WHERE list_contains(string_split(n.ann, ','), 'Deprecated')"),
        "string_usage": "SELECT file, line, trim(raw, ' ') AS content FROM (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS BIGINT) AS line, string_split(text, chr(10))[i] AS raw FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)) WHERE contains(raw, 'License') ORDER BY file, line LIMIT 500",
        "simulate_dependency_injection": "SELECT qualified_name, bean_name, is_primary, rank IS NOT NULL AND row_number() OVER (ORDER BY rank NULLS LAST, qualified_name) = 1 AS resolved, min(rank) OVER () IS NULL AS ambiguous FROM (SELECT 'class:s' || s_suppkey AS qualified_name, s_name AS bean_name, s_suppkey % 11 = 0 AS is_primary, CASE WHEN count(*) OVER () = 1 THEN 0 WHEN s_suppkey % 11 = 0 THEN 2 END AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey = 3)",
        "git_provenance": f"SELECT substr(hash, 1, 8) AS hash8, message, CASE WHEN signature = 'GPG' THEN 'GPG_FORBIDDEN' ELSE 'MISSING_SIGNATURE' END AS violation FROM ({commits}) WHERE signature IS NULL OR signature <> 'SSH'",
        "list_projects": "SELECT substr(sha256('/src/' || r_name), 1, 16) AS id, r_name AS name, '/src/' || r_name AS root, 'PENDING' AS status, count(n_nationkey) AS nodes FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
        "refresh_changes": f"WITH mid AS (SELECT to_timestamp((epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2)::TIMESTAMP AS m FROM orders), a AS ({old}), b AS (SELECT o_orderkey AS path, o_totalprice AS size, o_orderstatus AS sha256 FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.sha256 <> b.sha256 THEN 'modified' END AS change FROM a FULL JOIN b USING (path)) SELECT change, count(*) AS n FROM d WHERE change IS NOT NULL GROUP BY change",
        "snapshot_diff": sql("SELECT 'node_added' AS change, count(*) AS n FROM late UNION ALL SELECT 'edge_added', count(*) FROM edges WHERE s IN (SELECT id FROM late) UNION ALL SELECT 'impacted', count(DISTINCT t) FROM edges WHERE s IN (SELECT id FROM late) AND t IN (SELECT id FROM nodes)", "mid AS (SELECT to_timestamp((epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2)::TIMESTAMP AS m FROM orders)", f"late AS (SELECT {_EP} AS id FROM orders WHERE o_orderdate >= (SELECT m FROM mid))"),
        "authorization_rules": sql("SELECT id, name, CAST(NULL AS VARCHAR) AS annotation, CAST(NULL AS VARCHAR) AS expression FROM nodes WHERE type = 'AUTH_RULE'"),
        "instrumented_services": sql("SELECT count(*) FILTER (instr = 'true') AS instrumented, count(*) AS total FROM nodes WHERE type IN ('SERVICE','CONTROLLER')"),
        "rule_counts": sql(f"SELECT count(*) AS violations, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM ({_VIOLATIONS.format(more='')})"),
        "provenance_summary": f"SELECT CASE WHEN signature = 'GPG' THEN 'GPG_FORBIDDEN' ELSE 'MISSING_SIGNATURE' END AS violation, count(*) AS n, FALSE AS compliant FROM ({commits}) WHERE signature IS NULL OR signature <> 'SSH' GROUP BY 1",
        "node_by_name": sql("SELECT id, name, type FROM nodes WHERE name = 'order 1'"),
        "export_dot": sql("SELECT 'node' AS part, '\"' || id || '\" [label=\"' || name || '\"];' AS value FROM nodes UNION ALL SELECT 'edge', '\"' || s || '\" -> \"' || t || '\" [label=\"' || type || '\"];' FROM edges"),
        "export_cypher": sql("SELECT 'node' AS part, 'CREATE (:' || type || ' {id: ''' || id || ''', name: ''' || name || '''});' AS value FROM nodes UNION ALL SELECT 'edge', 'MATCH (a {id: ''' || s || '''}), (b {id: ''' || t || '''}) CREATE (a)-[:' || type || ']->(b);' FROM edges"),
        "cyclic_classes": sql("SELECT m.id, c.least AS component FROM member m JOIN comp c USING (root)", _INJ, _KNOTS),
        "dependency_cycles": sql("SELECT length, path FROM cyc", _INJ, _CYCLES),
        "architectural_health": sql("SELECT dimension, n_issues, score, CASE WHEN score < 60 THEN 'CRITICAL' WHEN score < 80 THEN 'IMPROVE' ELSE 'healthy' END AS note FROM dims UNION ALL SELECT 'OVERALL', n, sc, CASE WHEN sc >= 90 THEN 'A' WHEN sc >= 80 THEN 'B' WHEN sc >= 70 THEN 'C' WHEN sc >= 60 THEN 'D' ELSE 'F' END FROM (SELECT CAST(sum(n_issues) AS BIGINT) AS n, CAST(round(avg(score)) AS BIGINT) AS sc FROM dims)", _INJ, _CYCLES, _KNOTS, _LONG, _ISSUES),
        "remediation_backlog": sql("SELECT dimension, score, node_id, reason, level, 'Fix ' || reason || ' of ' || node_id || ' (' || lower(dimension) || ', penalty ' || penalty || ').' AS prompt FROM iss JOIN dims USING (dimension)", _INJ, _CYCLES, _KNOTS, _LONG, _ISSUES),
        "fix_context": sql("SELECT 'class:s3' AS node_id, 'untested at class:s3: ' || string_agg(l, '; ' ORDER BY l) AS prompt FROM (SELECT 'out ' || type || ' ' || t AS l FROM edges WHERE s = 'class:s3' UNION ALL SELECT 'in ' || type || ' ' || s FROM edges WHERE t = 'class:s3')"),
        "blast_radius": sql("SELECT DISTINCT n.id, n.name, n.type FROM seen JOIN nodes n USING (id) WHERE seen.depth > 0", closure, _bfs("SELECT s, t FROM edges", "SELECT id FROM clos", 3, both=True)),
        "transaction_boundaries": sql(f"SELECT c.t AS id, CAST(min(depth) AS BIGINT) AS depth FROM seen JOIN edges c ON c.s = seen.id AND c.type = 'CALLS' WHERE c.t IN ({trans}) GROUP BY c.t", _bfs(_calls("'CALLS'"), start, 5)),
        "transaction_scope": sql("SELECT n.id, n.name, n.type, CAST(d AS BIGINT) AS depth, (SELECT count(*) FROM edges r WHERE r.type = 'CALLS_REMOTE' AND r.s = n.id) AS remote_calls FROM (SELECT id, min(depth) AS d FROM sc GROUP BY id) JOIN nodes n USING (id)", "sc AS (SELECT 'class:c0' AS id, 0 AS depth UNION SELECT e.t, depth + 1 FROM sc JOIN edges e ON e.s = sc.id WHERE e.type = 'CALLS' AND depth < 20 AND (depth = 0 OR sc.id IN (SELECT id FROM nodes WHERE type IN ('SERVICE','PROXY'))))"),
        "transaction_risk": sql(
            "SELECT 'class:s3' AS id, EXISTS (SELECT 1 FROM edges WHERE type = 'CALLS' AND t = 'class:s3' AND s IN"
            f" ({trans})) AS transactional,"
            " (SELECT count(*) FROM edges WHERE type = 'CALLS_REMOTE' AND s = 'class:s3' AND t IN (SELECT id FROM nodes)) AS remote,"
            " CAST(0 AS BIGINT) AS exceptions, EXISTS (SELECT 1 FROM edges WHERE type = 'CALLS' AND t = 'class:s3' AND s IN"
            f" ({trans})) AND EXISTS (SELECT 1 FROM edges WHERE type = 'CALLS_REMOTE' AND s = 'class:s3') AS distributed_risk,"
            " CAST(0 AS BIGINT) AS performance_issues"
        ),
        "request_flow": sql("SELECT n.id, n.name, n.type, CAST(min(depth) AS BIGINT) AS depth, coalesce(contains(any_value(proxy), 'TRANSACTION_INTERCEPTOR'), FALSE) OR coalesce(contains(any_value(ann), 'Transactional'), FALSE) AS transactional FROM seen JOIN nodes n USING (id) GROUP BY n.id, n.name, n.type", _bfs(_calls("'ROUTES_TO','CALLS','INJECTS','IMPLEMENTS'"), f"SELECT {_EP} AS id FROM orders WHERE o_orderkey = 1", 40)),
        "data_flow": sql("SELECT n.id, n.name, n.type, CAST(d AS BIGINT) AS depth, d > 0 AND n.id IN (SELECT t FROM edges WHERE type IN ('RETURNS','MAPS_TO')) AS sink FROM (SELECT id, min(depth) AS d FROM seen GROUP BY id) JOIN nodes n USING (id)", _bfs(flow_edges, "SELECT id FROM nodes WHERE contains(name, 'order 1')", 5)),
        "search_boolean": sql(
            _best("SELECT id, a.score + b.score AS score FROM a JOIN b USING (id) WHERE id NOT IN (SELECT id FROM name_w WHERE list_contains(w, '000000003') OR list_contains(w, '000000006'))"),
            kind, data, name, _met("a", "kind", "service", 2), _met("b", "data", "transactional"),
        ),
        "search_phrase": sql(_best("SELECT id, sum(score) AS score FROM (FROM a UNION ALL FROM b) GROUP BY id"), name, kind, _phrase("a", "name", "proxy", "of", 3), _met("b", "kind", "module")),
        "search_prefix": sql(_best("SELECT id, 1 + a.score AS score FROM a JOIN name_w USING (id) WHERE len(list_filter(w, lambda x: starts_with(x, 'suppl'))) > 0"), name, data, _met("a", "data", "true")),
        "search_near": sql(_best("SELECT id, CAST(1 AS DOUBLE) AS score FROM name_w WHERE len(list_filter(w, lambda x: levenshtein(x, 'ordr') <= 1)) > 0 AND id NOT IN (SELECT id FROM data_w WHERE list_contains(w, 'post'))"), name, data),
        "search_architecture": sql("SELECT n.id, n.name, n.type, score FROM (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM tf JOIN df USING (term), tot WHERE term IN ('transactional', 'service', 'true') GROUP BY id ORDER BY score DESC, id LIMIT 10) JOIN nodes n USING (id)", terms),
    }
