"""OCSF 1.1 events as Spark struct expressions (P10 base event, P11 severity name,
P12-P15 class enrichers, P16 observables).

Everything is a column expression over the raw line and a rule label struct
(``class_uid, class_name, activity_id, activity_name, severity_id, category_uid,
category_name``): regex extraction, ``when`` chains and struct building — JVM-side and
inside whole-stage codegen. Absent fields are NULL in a fixed schema (the reference uses
sparse dicts). ``time`` and ``metadata.uid`` come from the input (arrival time, line id)
instead of the wall clock and a random UUID, so replays give identical events.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — extraction patterns, severity names and status classes of the
# reference's event builder (Java syntax; case-insensitive ones carry (?i)).
# ---------------------------------------------------------------------------
IP_RE = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
PORT_RE = r"(?i)\bport[= ](\d+)"
USER_RE = r"(?i)(?:for(?: invalid user)?|user[= ])\s+(\S+)"
HTTP_METHOD_RE = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
HTTP_STATUS_RE = r'(?i)\bHTTP/[\d.]+"?\s+(\d{3})\b|\bstatus[= ](\d{3})\b'
HTTP_PATH_RE = r"(?i)(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) (/\S*)"
HTTP_BYTES_RE = r'HTTP/[\d.]+"?\s+\d{3}\s+(\d+)'
DB_HOST_RE = r"(?i)host[= ](\S+?)(?:\s|,|$)"
DB_PORT_RE = r"(?i)port[= ](\d+)"
DB_USER_RE = r"(?i)user[= ](\S+?)(?:\s|,|$)"
DB_NAME_RE = r"(?i)(?:db|database)=(\S+?)(?:\s|,|$)"
DB_TABLE_RE = r"(?i)table[= ](\S+?)(?:\s|,|$)"
DB_ROWS_RE = r"(?i)rows[= ](\d+)"
DB_DURATION_RE = r"(?i)duration[= ](\d+)"
SERVICE_RE = r"(?i)service\s+(\S+)"

SEVERITY_NAMES = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical"}
# first digit of the HTTP status code -> (status_id, status)
HTTP_STATUS_CLASS = {"2": (1, "Success"), "3": (1, "Success"), "4": (2, "Failure"), "5": (2, "Failure")}
OCSF_VERSION = "1.1.0"
PRODUCT = {"name": "logweave", "vendor_name": "logweave", "version": "1.0.0"}

SSH_AUTH, HTTP, DATASTORE, APP_LIFECYCLE = 3002, 4002, 5001, 1007


def _x(raw: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or NULL when there is no match."""
    return F.nullif(F.regexp_extract(raw, pattern, group), F.lit(""))


def _obs(name: str, type_id: int, type_name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(type_id).alias("type_id"),
                                              F.lit(type_name).alias("type"), value.alias("value")))


def severity_name(sev: Column, names: dict = SEVERITY_NAMES) -> Column:
    """0..5 -> name, anything else 'Unknown'."""
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[sev], F.lit("Unknown"))


def ocsf_event(raw: Column, label: Column, time_col: Column | None = None,
               uid_col: Column | None = None) -> Column:
    """Full OCSF event struct for ``raw`` with rule label ``label``."""
    cls = label["class_uid"]
    act = label["activity_id"]
    sev = label["severity_id"]
    ms = (F.unix_millis(time_col.cast("timestamp")) if time_col is not None
          else F.lit(None).cast("bigint"))
    uid = uid_col if uid_col is not None else F.lit(None).cast("string")

    ips = F.regexp_extract_all(raw, F.lit(IP_RE), 1)
    ip0 = F.get(ips, 0)
    ip1 = F.get(ips, 1)
    is_ssh, is_http, is_db, is_app = (cls == SSH_AUTH, cls == HTTP, cls == DATASTORE, cls == APP_LIFECYCLE)

    # --- P12 SSH / authentication
    ssh_user = _x(raw, USER_RE)
    ssh_port = _x(raw, PORT_RE)
    low = F.lower(raw)
    auth_id = F.when(low.contains("publickey"), 99).otherwise(2)
    auth_name = (F.when(low.contains("publickey"), "Public Key")
                 .when(low.contains("password"), "Password").otherwise("SSH"))
    ssh_fail = sev >= 4

    # --- P13 HTTP
    method = _x(raw, HTTP_METHOD_RE)
    code_txt = F.coalesce(_x(raw, HTTP_STATUS_RE, 1), _x(raw, HTTP_STATUS_RE, 2))
    code = code_txt.try_cast("int")
    first_digit = F.substring(code.cast("string"), 1, 1)
    http_sid = (F.when(code.isNull(), 0).when(first_digit.isin("2", "3"), 1)
                .when(first_digit.isin("4", "5"), 2).otherwise(0))
    http_sname = (F.when(code.isNull(), "Unknown").when(first_digit.isin("2", "3"), "Success")
                  .when(first_digit.isin("4", "5"), "Failure").otherwise("Unknown"))
    path = _x(raw, HTTP_PATH_RE)
    length = _x(raw, HTTP_BYTES_RE).try_cast("bigint")

    # --- P14 datastore
    db_name = _x(raw, DB_NAME_RE)
    db_table = _x(raw, DB_TABLE_RE)
    db_host = _x(raw, DB_HOST_RE)
    db_port = _x(raw, DB_PORT_RE)
    db_user = _x(raw, DB_USER_RE)
    rows = _x(raw, DB_ROWS_RE)
    dur = _x(raw, DB_DURATION_RE)

    # --- P15 service
    svc = _x(raw, SERVICE_RE)

    status_id = (F.when(is_ssh, F.when(ssh_fail, 2).otherwise(1)).when(is_http, http_sid)
                 .when(is_db | is_app, 1))
    status = (F.when(is_ssh, F.when(ssh_fail, "Failure").otherwise("Success")).when(is_http, http_sname)
              .when(is_db | is_app, "Success"))

    user = F.when(is_ssh & ssh_user.isNotNull(),
                  F.struct(ssh_user.alias("name"), F.lit(1).alias("type_id"), F.lit("User").alias("type")))
    src_endpoint = F.when((is_ssh | is_http) & ip0.isNotNull(),
                          F.struct(ip0.alias("ip"), F.lit(None).cast("bigint").alias("port")))
    ssh_dst_port = F.when(ssh_port.isNotNull(), ssh_port.try_cast("bigint")).otherwise(F.lit(22).cast("bigint"))
    dst_endpoint = (
        F.when(is_ssh & ip0.isNotNull(),
               F.struct(ip1.alias("ip"), ssh_dst_port.alias("port"), F.lit(None).cast("string").alias("hostname")))
        .when(is_http & ip1.isNotNull(),
              F.struct(ip1.alias("ip"), F.lit(None).cast("bigint").alias("port"),
                       F.lit(None).cast("string").alias("hostname")))
        .when(is_db & (db_host.isNotNull() | db_port.isNotNull()),
              F.struct(F.lit(None).cast("string").alias("ip"), db_port.try_cast("bigint").alias("port"),
                       db_host.alias("hostname"))))
    http_request = F.when(is_http & (method.isNotNull() | path.isNotNull()),
                          F.struct(method.alias("http_method"),
                                   F.when(path.isNotNull(), F.struct(path.alias("path"),
                                                                     F.lit("http").alias("scheme"))).alias("url")))
    http_response = F.when(is_http & (code.isNotNull() | length.isNotNull()),
                           F.struct(code.alias("code"), length.alias("length")))
    database = F.when(is_db & (db_name.isNotNull() | db_table.isNotNull()),
                      F.struct(db_name.alias("name"), db_table.alias("table")))
    actor = F.when(is_db & db_user.isNotNull(),
                   F.struct(F.struct(db_user.alias("name"), F.lit(1).alias("type_id")).alias("user")))
    app = F.when(is_app & svc.isNotNull(), F.struct(svc.alias("name")))

    obs_all = F.array(
        F.when(is_ssh, _obs("user.name", 4, "User Name", ssh_user)),
        F.when(is_ssh, _obs("src_endpoint.ip", 2, "IP Address", ip0)),
        F.when(is_http, _obs("http_request.url.path", 6, "URL String", path)),
        F.when(is_http, _obs("http_response.code", 12, "HTTP Response Code", code.cast("string"))),
        F.when(is_http, _obs("src_endpoint.ip", 2, "IP Address", ip0)),
        F.when(is_db, _obs("database.table", 26, "Table Name", db_table)),
        F.when(is_app, _obs("app.name", 7, "Resource Name", svc)),
    )
    observables = F.filter(obs_all, lambda o: o.isNotNull())

    return F.struct(
        cls.alias("class_uid"), label["class_name"].alias("class_name"),
        act.alias("activity_id"), label["activity_name"].alias("activity_name"),
        label["category_uid"].alias("category_uid"), label["category_name"].alias("category_name"),
        sev.alias("severity_id"), severity_name(sev).alias("severity"),
        (cls.cast("bigint") * 100 + act).alias("type_uid"),
        F.concat(label["class_name"], F.lit(": "), label["activity_name"]).alias("type_name"),
        ms.alias("time"), raw.alias("message"), raw.alias("raw_data"),
        F.struct(F.lit(OCSF_VERSION).alias("version"),
                 F.struct(*[F.lit(v).alias(k) for k, v in PRODUCT.items()]).alias("product"),
                 uid.alias("uid"), ms.alias("logged_time")).alias("metadata"),
        observables.alias("observables"),
        status_id.alias("status_id"), status.alias("status"),
        F.when(is_ssh, auth_id).alias("auth_protocol_id"), F.when(is_ssh, auth_name).alias("auth_protocol"),
        user.alias("user"), src_endpoint.alias("src_endpoint"), dst_endpoint.alias("dst_endpoint"),
        http_request.alias("http_request"), http_response.alias("http_response"),
        database.alias("database"), actor.alias("actor"),
        app.alias("app"), app.alias("service"),
        F.when(is_db, rows.try_cast("bigint")).alias("affected_rows"),
        F.when(is_db, dur.try_cast("bigint")).alias("duration"),
    )


def event_uid(line_id: Column) -> Column:
    """Deterministic event uid from the line id (idempotent replays)."""
    return F.md5(F.concat(F.lit("evt:"), line_id.cast("string")))


def render_observables(obs: Column) -> Column:
    return F.array_join(F.transform(obs, lambda o: F.concat(o["name"], F.lit("="), o["value"])), ";")


def flat_event_columns(ev: str = "ocsf_event") -> list[Column]:
    """Scalar view of an event struct (reports, checks)."""
    e = F.col(ev)
    return [
        e.class_uid.cast("bigint").alias("class_uid"), e.type_uid.alias("type_uid"), e.type_name.alias("type_name"),
        e.severity.alias("severity"), e.status_id.cast("bigint").alias("status_id"), e.status.alias("status"),
        e.auth_protocol_id.cast("bigint").alias("auth_protocol_id"), e.auth_protocol.alias("auth_protocol"),
        e.user["name"].alias("user_name"), e.src_endpoint.ip.alias("src_ip"),
        e.dst_endpoint.ip.alias("dst_ip"), e.dst_endpoint.port.alias("dst_port"),
        e.dst_endpoint.hostname.alias("dst_hostname"),
        e.http_request.http_method.alias("http_method"), e.http_request.url.path.alias("url_path"),
        e.http_response.code.cast("bigint").alias("http_code"), e.http_response.length.alias("http_length"),
        e.database["name"].alias("db_name"), e.database.table.alias("db_table"),
        e.actor.user["name"].alias("actor_user"), e.affected_rows.alias("affected_rows"),
        e.duration.alias("duration"), e.app["name"].alias("app_name"),
        render_observables(e.observables).alias("observables"),
    ]


# ---------------------------------------------------------------------------
# DuckDB twin of flat_event_columns (oracle only)
# ---------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_flat_event(raw: str, cls: str, sev: str, act: str, cname: str, aname: str) -> str:
    """Select-list computing the flat event columns in DuckDB."""
    def x(p, g=1):
        return f"nullif(regexp_extract({raw}, {_q(p)}, {g}), '')"
    ips = f"regexp_extract_all({raw}, {_q(IP_RE)}, 1)"
    ip0 = f"(CASE WHEN len({ips}) > 0 THEN {ips}[1] END)"
    ip1 = f"(CASE WHEN len({ips}) > 1 THEN {ips}[2] END)"
    code = f"TRY_CAST(coalesce({x(HTTP_STATUS_RE, 1)}, {x(HTTP_STATUS_RE, 2)}) AS INTEGER)"
    fd = f"substr(CAST({code} AS VARCHAR), 1, 1)"
    ssh, http, db, app = (f"({cls} = {SSH_AUTH})", f"({cls} = {HTTP})", f"({cls} = {DATASTORE})",
                          f"({cls} = {APP_LIFECYCLE})")
    low = f"lower({raw})"
    sev_name = "CASE " + " ".join(f"WHEN {sev} = {k} THEN {_q(v)}" for k, v in SEVERITY_NAMES.items()) + " ELSE 'Unknown' END"
    user = x(USER_RE)
    port = x(PORT_RE)
    path = x(HTTP_PATH_RE)
    method = x(HTTP_METHOD_RE)
    length = f"TRY_CAST({x(HTTP_BYTES_RE)} AS BIGINT)"
    dbh, dbp, dbn, dbt, dbu = x(DB_HOST_RE), x(DB_PORT_RE), x(DB_NAME_RE), x(DB_TABLE_RE), x(DB_USER_RE)
    svc = x(SERVICE_RE)
    obs_parts = [
        f"CASE WHEN {ssh} AND {user} IS NOT NULL THEN 'user.name=' || {user} END",
        f"CASE WHEN {ssh} AND {ip0} IS NOT NULL THEN 'src_endpoint.ip=' || {ip0} END",
        f"CASE WHEN {http} AND {path} IS NOT NULL THEN 'http_request.url.path=' || {path} END",
        f"CASE WHEN {http} AND {code} IS NOT NULL THEN 'http_response.code=' || CAST({code} AS VARCHAR) END",
        f"CASE WHEN {http} AND {ip0} IS NOT NULL THEN 'src_endpoint.ip=' || {ip0} END",
        f"CASE WHEN {db} AND {dbt} IS NOT NULL THEN 'database.table=' || {dbt} END",
        f"CASE WHEN {app} AND {svc} IS NOT NULL THEN 'app.name=' || {svc} END",
    ]
    cols = {
        "class_uid": f"CAST({cls} AS BIGINT)",
        "type_uid": f"CAST({cls} AS BIGINT) * 100 + {act}",
        "type_name": f"{cname} || ': ' || {aname}",
        "severity": sev_name,
        "status_id": (f"CAST(CASE WHEN {ssh} THEN (CASE WHEN {sev} >= 4 THEN 2 ELSE 1 END) "
                      f"WHEN {http} THEN (CASE WHEN {code} IS NULL THEN 0 WHEN {fd} IN ('2','3') THEN 1 "
                      f"WHEN {fd} IN ('4','5') THEN 2 ELSE 0 END) WHEN {db} OR {app} THEN 1 END AS BIGINT)"),
        "status": (f"CASE WHEN {ssh} THEN (CASE WHEN {sev} >= 4 THEN 'Failure' ELSE 'Success' END) "
                   f"WHEN {http} THEN (CASE WHEN {code} IS NULL THEN 'Unknown' WHEN {fd} IN ('2','3') THEN 'Success' "
                   f"WHEN {fd} IN ('4','5') THEN 'Failure' ELSE 'Unknown' END) WHEN {db} OR {app} THEN 'Success' END"),
        "auth_protocol_id": f"CAST(CASE WHEN {ssh} THEN (CASE WHEN contains({low}, 'publickey') THEN 99 ELSE 2 END) END AS BIGINT)",
        "auth_protocol": (f"CASE WHEN {ssh} THEN (CASE WHEN contains({low}, 'publickey') THEN 'Public Key' "
                          f"WHEN contains({low}, 'password') THEN 'Password' ELSE 'SSH' END) END"),
        "user_name": f"CASE WHEN {ssh} THEN {user} END",
        "src_ip": f"CASE WHEN {ssh} OR {http} THEN {ip0} END",
        "dst_ip": f"CASE WHEN {ssh} OR {http} THEN {ip1} END",
        "dst_port": (f"CASE WHEN {ssh} AND {ip0} IS NOT NULL THEN (CASE WHEN {port} IS NOT NULL THEN TRY_CAST({port} AS BIGINT) ELSE 22 END) "
                     f"WHEN {db} THEN TRY_CAST({dbp} AS BIGINT) END"),
        "dst_hostname": f"CASE WHEN {db} THEN {dbh} END",
        "http_method": f"CASE WHEN {http} THEN {method} END",
        "url_path": f"CASE WHEN {http} THEN {path} END",
        "http_code": f"CAST(CASE WHEN {http} THEN {code} END AS BIGINT)",
        "http_length": f"CASE WHEN {http} THEN {length} END",
        "db_name": f"CASE WHEN {db} THEN {dbn} END",
        "db_table": f"CASE WHEN {db} THEN {dbt} END",
        "actor_user": f"CASE WHEN {db} THEN {dbu} END",
        "affected_rows": f"CASE WHEN {db} THEN TRY_CAST({x(DB_ROWS_RE)} AS BIGINT) END",
        "duration": f"CASE WHEN {db} THEN TRY_CAST({x(DB_DURATION_RE)} AS BIGINT) END",
        "app_name": f"CASE WHEN {app} THEN {svc} END",
        "observables": "concat_ws(';', " + ", ".join(obs_parts) + ")",
    }
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


FLAT_EVENT_NAMES = ("class_uid", "type_uid", "type_name", "severity", "status_id", "status", "auth_protocol_id",
                    "auth_protocol", "user_name", "src_ip", "dst_ip", "dst_port", "dst_hostname", "http_method",
                    "url_path", "http_code", "http_length", "db_name", "db_table", "actor_user", "affected_rows",
                    "duration", "app_name", "observables")
