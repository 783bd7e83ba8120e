"""DuckDB SQL for the nodes and edges that resolvers make of the files in `code`."""

from __future__ import annotations

_BASE = """WITH s AS (SELECT s_suppkey AS s, s_nationkey AS n, n_regionkey AS r, 'n' || s_nationkey || '.S' || s_suppkey AS f FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
offer AS (SELECT r, count(*) AS k, min(f) AS single, min(f) FILTER (s % 3 = 0) AS main FROM s GROUP BY r),
port AS (SELECT n.n, n.r, 'class:' || coalesce(CASE WHEN k = 1 THEN single ELSE main END, 'r' || n.r || '.Port') AS target FROM n LEFT JOIN offer USING (r))
"""
_E = "'n' || n || '.E' || s"
_GET, _PUT = "'endpoint:GET:/s' || s || '/get:get' || s", "'endpoint:POST:/s' || s || '/put:put' || s"


def _node(id_: str, name: str, kind: str, source: str = "s") -> str:
    return f"SELECT DISTINCT 'node' AS part, {id_} AS a, {name} AS b, '{kind}' AS type FROM {source}"


def _edge(a: str, b: str, kind: str, source: str = "s") -> str:
    return f"SELECT DISTINCT 'edge' AS part, {a} AS a, {b} AS b, '{kind}' AS type FROM {source}"


_PARTS = {
    "code_beans": [
        _node("'class:' || f", "f", "SERVICE"), _node("'class:' || f || 'Repo'", "f || 'Repo'", "REPOSITORY"), _node("'class:web.C' || s", "'web.C' || s", "CONTROLLER"),
        _node("'class:conf.F' || n", "'conf.F' || n", "COMPONENT", "n"), _node("'class:conf.N' || n", "'conf.N' || n", "COMPONENT", "n"),
        _node("target", "substr(target, 7)", "SERVICE", "port WHERE target LIKE '%.Port'"),
    ],
    "code_injections": [
        _edge("'class:' || f", "'class:' || f || 'Repo'", "INJECTS"), _edge("'class:web.C' || s", "'class:' || f", "INJECTS"), _edge("'class:conf.N' || n", "target", "INJECTS", "port"),
    ],
    "code_calls": [
        _node("'proxy:' || f", "f || '$Proxy'", "PROXY"), _edge("'class:' || f", "'class:' || f || 'Repo'", "CALLS"), _edge("'class:' || f", "'class:Class'", "CALLS"),
        _edge("'class:' || f", "'class:KafkaTemplate'", "CALLS"), _edge("'class:web.C' || s", "'class:' || f", "CALLS"), _edge("'class:web.C' || s", "'proxy:' || f", "CALLS"),
        _edge("'proxy:' || f", "'class:' || f", "CALLS"),
    ],
    "code_endpoints": [
        _node(_GET, "'GET /s' || s || '/get'", "CONTROLLER_ENDPOINT"), _node(_PUT, "'POST /s' || s || '/put'", "CONTROLLER_ENDPOINT"),
        _edge(_GET, "'class:web.C' || s", "ROUTES_TO"), _edge(_PUT, "'class:web.C' || s", "ROUTES_TO"),
    ],
    "code_security": [
        _node("'auth_rule:web.C' || s || '.PreAuthorize'", "'PreAuthorize on web.C' || s", "AUTH_RULE"),
        *(_edge(x, "'auth_rule:web.C' || s || '.PreAuthorize'", "SECURED_BY") for x in (_GET, _PUT, "'class:web.C' || s")),
        _node("'security_filter_chain:conf.Sec' || r_regionkey || '.chain'", "'SecurityFilterChain-chain'", "SECURITY_FILTER_CHAIN", "region"),
        _node("'security_flag:conf.Sec' || r_regionkey || '.CSRF_DISABLED'", "'CSRF_DISABLED'", "SECURITY_FLAG", "region"),
        _edge("'security_filter_chain:conf.Sec' || r_regionkey || '.chain'", "'security_flag:conf.Sec' || r_regionkey || '.CSRF_DISABLED'", "CONFIGURED_BY", "region"),
    ],
    "code_persistence": [
        _node("'data_repo:n' || n || '.D' || s", "'n' || n || '.D' || s", "DATA_REPOSITORY"), _node(f"'persistence_entity:' || {_E}", _E, "PERSISTENCE_ENTITY"),
        *(_edge(f"'persistence_entity:' || {_E}", f"'persistence_entity:' || {_E}", k) for k in ("HAS_MANY", "BELONGS_TO")),
    ],
    "code_messaging": [
        _node("'message_topic:in' || n", "'in' || n", "MESSAGE_TOPIC"), _node("'message_topic:out' || n", "'out' || n", "MESSAGE_TOPIC"),
        _edge("'message_topic:in' || n", "'class:' || f", "SUBSCRIBES_FROM"), _edge("'class:' || f", "'message_topic:out' || n", "PUBLISHES_TO"),
    ],
    "code_configuration": [
        _node("'config_properties:conf.P' || n", "'ConfigProperties:conf.P' || n", "CONFIG_PROPERTIES", "n"), _node("'config_key:pre' || n || '.size'", "'pre' || n || '.size'", "CONFIG_KEY", "n"),
        _node("'config_key:app.n' || n", "'app.n' || n", "CONFIG_KEY"), _edge("'class:' || f", "'config_key:app.n' || n", "USES_CONFIG"),
        _node("'config_value:app.n' || n", "'app.n' || n || '=v' || n", "CONFIG_VALUE", "s WHERE n % 3 <> 0"),
        _edge("'config_key:app.n' || n", "'config_value:app.n' || n", "RESOLVES_TO", "s WHERE n % 3 <> 0"),
    ],
    "code_remote_calls": [
        _node("'external_service:x' || n", "'x' || n", "EXTERNAL_SERVICE", "n"), _node("'feign_client:conf.F' || n", "'conf.F' || n", "FEIGN_CLIENT", "n"),
        _edge("'feign_client:conf.F' || n", "'external_service:x' || n", "CALLS_REMOTE", "n"), _edge("'class:conf.F' || n", "'feign_client:conf.F' || n", "CALLS_REMOTE", "n"),
    ],
    "code_tests": [
        _node("'test:' || f || 'Test'", "f || 'Test'", "TEST"), _edge("'test:' || f || 'Test'", "'class:' || f", "TESTS"), _edge("'test:' || f || 'Test'", "'class:' || f || 'Repo'", "MOCKS"),
    ],
    "code_observability": [
        _node("'metric:metric' || s", "'metric' || s", "METRIC"), _node("'trace_span:span' || s", "'span' || s", "TRACE_SPAN"),
        _edge("'class:' || f", "'metric:metric' || s", "MEASURES"), _edge("'class:' || f", "'trace_span:span' || s", "TRACES"),
    ],
    "code_performance": [
        _node("'perf:n_plus_one:' || f || '.run'", "'N+1 Query Risk: ' || f || '.run'", "PERFORMANCE_ISSUE"), _edge("'class:' || f", "'perf:n_plus_one:' || f || '.run'", "PERFORMANCE_RISK"),
        _node(f"'perf:fetch_strategy:' || {_E} || '.many'", f"'Lazy fetch: ' || {_E} || '.many'", "PERFORMANCE_ISSUE"),
        _edge(f"'class:' || {_E}", f"'perf:fetch_strategy:' || {_E} || '.many'", "PERFORMANCE_RISK"),
    ],
    "code_schema": [
        _node("'schema_migration:' || s", "'V' || s || '__x.sql'", "SCHEMA_MIGRATION"), _node("'schema_table:t' || s", "'t' || s", "SCHEMA_TABLE"),
        _node("'schema_column:t' || s || '.id'", "'id'", "SCHEMA_COLUMN"), _node("'schema_column:t' || s || '.c' || s", "'c' || s", "SCHEMA_COLUMN"),
        _edge(f"'persistence_entity:' || {_E}", "'schema_table:t' || s", "SCHEMA_MAPS_TO"),
    ],
    "code_contains": [
        _edge("'schema_migration:' || s", "'schema_table:t' || s", "CONTAINS"), _edge("'schema_table:t' || s", "'schema_column:t' || s || '.id'", "CONTAINS"),
        _edge("'schema_table:t' || s", "'schema_column:t' || s || '.c' || s", "CONTAINS"), _edge("'config_properties:conf.P' || n", "'config_key:pre' || n || '.size'", "CONTAINS", "n"),
    ],
    "code_native": [
        _node("'compat_issue:reflection:' || f", "f || ' — ' || substr('Uses reflection without explicit AOT hints', 1, 40)", "COMPATIBILITY_ISSUE"),
        _edge("'class:' || f", "'compat_issue:reflection:' || f", "COMPATIBILITY_RISK"),
    ],
    "code_transfers": [
        _node(f"'dto:' || {_E}", "'E' || s", "DATA_TRANSFER_OBJECT"), _edge(_GET, f"'dto:' || {_E}", "RETURNS"), _edge(_PUT, f"'dto:' || {_E}", "ACCEPTS"),
        _edge(f"'dto:' || {_E}", f"'persistence_entity:' || {_E}", "MAPS_TO"), _edge("'data_repo:n' || n || '.D' || s", f"'persistence_entity:' || {_E}", "MAPS_TO"),
    ],
    "code_modules": [
        _node("'module:m' || n", "'m' || n", "MODULE", "n"), _edge("'module:m' || n", "'module:m' || r", "DEPENDS_ON", "n"),
    ],
}


def _note(id_: str, key: str, value: str, source: str = "s") -> str:
    return f"SELECT {id_} AS id, '{key}' AS key, {value} AS value FROM {source}"


_NOTES = [
    _note("'class:' || f", "beanName", "'s' || s"), _note("'class:' || f || 'Repo'", "beanName", "'s' || s || 'Repo'"), _note("'class:web.C' || s", "beanName", "'c' || s"),
    _note("'class:conf.F' || n", "beanName", "'f' || n", "n"), _note("'class:conf.N' || n", "beanName", "'n' || n", "n"), _note("'class:' || f", "PRIMARY", "'TRUE'", "s WHERE s % 3 = 0"),
    _note("'class:' || f", "hasStructuredLogging", "'true'"), _note("'class:' || f", "instrumented", "'true'"), _note("'class:' || f", "usesReflection", "'true'"),
    _note(_GET, "operationSummary", "'get ' || s"), _note(_GET, "hasOpenApiAnnotation", "'true'"), _note("'proxy:' || f", "PROXY_STEREOTYPE", "'TRANSACTION_INTERCEPTOR'"),
]


def oracle_sql() -> dict[str, str]:
    """Query name -> SQL."""
    return {k: _BASE + "\nUNION ALL ".join(v) for k, v in _PARTS.items()} | {"code_notes": _BASE + "\nUNION ALL ".join(_NOTES)}
