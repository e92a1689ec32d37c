"""Ordered OCSF rule tables (S2 load_rules, S3 reload_rules, A14 rule_stats).

A rule is a case-insensitive regex plus seven OCSF label fields. The first rule (lowest
``rule_order``) whose regex is *found* in the text wins. Rule tables are configuration:
a handful to a few hundred rows, so they are read on the driver and shipped to tasks as
literals or a broadcast table (size is bounded by the rule file, not by the data).
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    pattern: str
    class_uid: int
    class_name: str
    activity_id: int
    activity_name: str
    severity_id: int
    category_uid: int
    category_name: str


RULE_SCHEMA = T.StructType([
    T.StructField("rule_order", T.IntegerType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("class_uid", T.IntegerType(), False),
    T.StructField("class_name", T.StringType(), False),
    T.StructField("activity_id", T.IntegerType(), False),
    T.StructField("activity_name", T.StringType(), False),
    T.StructField("severity_id", T.IntegerType(), False),
    T.StructField("category_uid", T.IntegerType(), False),
    T.StructField("category_name", T.StringType(), False),
])

# Field names of the rule file, in file order.
RULE_FILE_FIELDS = ("ocsf_class_uid", "ocsf_class_name", "activity_id", "activity_name",
                    "severity_id", "category_uid", "category_name")

# ---------------------------------------------------------------------------
# FIXED VALUES — the default rule set must equal the reference's rule file:
# same patterns, same OCSF fields, same order (first match wins).
# ---------------------------------------------------------------------------
_IAM = "Identity & Access Management"
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(r"/api/|/v[0-9]+/|/graphql|/rpc/|/rest/", 6006, "API Activity", 1, "Read", 1, 6, "Application Activity"),
    Rule(r"/api/.*login|/api/.*auth|/api/.*token|/api/.*session|/api/.*oauth", 6006, "API Activity", 2, "Create", 2, 6, "Application Activity"),
    Rule(r"(?:POST|PUT|PATCH) /api/|(?:POST|PUT|PATCH) /v[0-9]+/", 6006, "API Activity", 2, "Create", 1, 6, "Application Activity"),
    Rule(r"(?:DELETE) /api/|(?:DELETE) /v[0-9]+/", 6006, "API Activity", 4, "Delete", 2, 6, "Application Activity"),
    Rule(r"sshd.*accepted|ssh.*login.*success|accepted (?:password|publickey) for", 3002, "SSH Activity", 1, "Logon", 1, 3, _IAM),
    Rule(r"sshd.*failed|ssh.*login.*fail|failed password for|authentication failure.*ssh", 3002, "SSH Activity", 1, "Logon", 4, 3, _IAM),
    Rule(r"sshd.*disconnect|ssh.*disconnect|connection closed by .*port", 3002, "SSH Activity", 2, "Logoff", 1, 3, _IAM),
    Rule(r'"?GET /|method=GET|\bGET\b.*HTTP', 4002, "HTTP Activity", 1, "GET", 1, 4, "Network Activity"),
    Rule(r'"?POST /|method=POST|\bPOST\b.*HTTP', 4002, "HTTP Activity", 2, "POST", 1, 4, "Network Activity"),
    Rule(r'status=[45]\d\d|HTTP/[0-9.]+" [45]\d\d|\b[45]\d\d (?:error|status)', 4002, "HTTP Activity", 0, "Unknown", 4, 4, "Network Activity"),
    Rule(r"(?:db|database|connection).*(?:open|established|connected)|connecting to (?:db|database)", 5001, "Datastore Activity", 1, "Open", 1, 5, "Discovery"),
    Rule(r"(?:db|database|connection).*(?:close|closed|disconnected|released)", 5001, "Datastore Activity", 2, "Close", 1, 5, "Discovery"),
    Rule(r"(?:execut|run).*query|\bquery\b.*(?:took|ms|rows)|SELECT .*FROM|INSERT INTO|UPDATE .*SET", 5001, "Datastore Activity", 3, "Query", 1, 5, "Discovery"),
    Rule(r"auth.*fail|authentication failed|invalid credentials|unauthorized|permission denied", 3002, "Authentication", 1, "Logon", 4, 3, _IAM),
    Rule(r"auth.*success|authentication succeed|login success|user .*authenticated", 3002, "Authentication", 1, "Logon", 1, 3, _IAM),
    Rule(r"service .*(?:start|started|starting)|started service|systemd.*started|launching service", 1007, "Application Lifecycle", 1, "Install", 1, 1, "System Activity"),
    Rule(r"service .*(?:stop|stopped|stopping)|stopped service|systemd.*stopped|shutting down service", 1007, "Application Lifecycle", 4, "Disable", 1, 1, "System Activity"),
    Rule(r"connection (?:established|accepted|opened)|new connection from|connect from", 4001, "Network Activity", 1, "Open", 1, 4, "Network Activity"),
    Rule(r"\bspawned\b|\bforked\b|child process|new process|pid[= ]\d+", 1007, "Application Lifecycle", 1, "Install", 1, 1, "System Activity"),
    Rule(r"\bERROR\b|\bException\b|\bCRITICAL\b|\bFATAL\b|\bPANIC\b", 2001, "Security Finding", 1, "Create", 4, 2, "Findings"),
)

# Lower-case texts of which a match of the pattern contains all of one group. Labelling tries
# a rule's regex only where a group occurs; patterns that are not listed are always tried.
RULE_WORDS: dict[str, tuple[tuple[str, ...], ...]] = dict(zip((r.pattern for r in DEFAULT_RULES), (
    (("/",),),
    (("/api/",),),
    ((" /api/",), (" /v",)),
    (("delete /",),),
    (("ssh",), ("accepted p",)),
    (("ssh",), ("failed password for",)),
    (("ssh",), ("connection closed by ",)),
    (("get /",), ("method=get",), ("http", "get")),
    (("post /",), ("method=post",), ("http", "post")),
    (("status=",), ("http/",), (" error",), (" status",)),
    (("db",), ("database",), ("connecti",)),
    (("db",), ("database",), ("connection",)),
    (("query",), ("select ", "from"), ("insert into",), ("update ", "set")),
    (("auth", "fail"), ("invalid credentials",), ("unauthorized",), ("permission denied",)),
    (("auth", "succe"), ("login success",), ("user ", "authenticated")),
    (("service",), ("systemd",)),
    (("service",), ("systemd",)),
    (("connection ",), ("connect from",)),
    (("spawned",), ("forked",), ("child process",), ("new process",), ("pid=",), ("pid ",)),
    (("error",), ("exception",), ("critical",), ("fatal",), ("panic",)),
), strict=True))


def rules_from_yaml_text(text: str) -> list[Rule]:
    """Parse a rule file. A missing ``rules`` key gives no rules; each rule needs all 7
    fields plus ``pattern`` (a missing one raises KeyError, like a malformed file)."""
    import yaml

    data = yaml.safe_load(text) or {}
    out = []
    for r in data.get("rules", []) or []:
        out.append(Rule(r["pattern"], int(r["ocsf_class_uid"]), r["ocsf_class_name"],
                        int(r["activity_id"]), r["activity_name"], int(r["severity_id"]),
                        int(r["category_uid"]), r["category_name"]))
    return out


def read_rules_file(path: str) -> list[Rule]:
    with open(path, encoding="utf-8") as fh:
        return rules_from_yaml_text(fh.read())


def rules_df(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rule table with ``rule_order`` = 1-based position in the list."""
    rows = [(i + 1, *astuple(r)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rule table from a YAML file, or the default set."""
    return rules_df(spark, DEFAULT_RULES if path is None else read_rules_file(path))


def reload_rules(spark: SparkSession, path: str) -> DataFrame:
    """S3: re-read the file (call at the start of each batch / micro-batch)."""
    return load_rules(spark, path)


def rule_stats(rules: DataFrame, source: str = "<default>") -> DataFrame:
    """Rules loaded and their source."""
    return rules.agg(F.count(F.lit(1)).alias("rules_loaded")).withColumn("source", F.lit(source))


def rules_as_list(rules) -> list[Rule]:
    """Rules as a driver-side list; accepts a list or a (small, bounded) rule DataFrame."""
    if isinstance(rules, DataFrame):
        rows = rules.orderBy("rule_order").collect()
        return [Rule(r.pattern, r.class_uid, r.class_name, r.activity_id, r.activity_name,
                     r.severity_id, r.category_uid, r.category_name) for r in rows]
    return list(rules)
