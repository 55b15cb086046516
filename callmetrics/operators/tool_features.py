"""Derived columns of tool records. The marker and alias lists are part of the results they must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmetrics.functions.text import collapsed, has_marker, tool_name

#: Markers of side effects, in the order in which they are tried.
SIDE_EFFECTS = (
    ("delete", ("delete", "remove", "drop", "clear", "purge")),
    ("execute", ("execute", "run", "shell", "command", "script", "eval", "code")),
    ("external_communication", ("send", "email", "message", "post", "publish", "notify", "tweet", "slack")),
    ("write", ("write", "create", "update", "edit", "patch", "save", "set", "add", "upload", "move", "copy")),
    ("read", ("read", "list", "get", "fetch", "search", "find", "query", "inspect", "show", "view", "describe")),
)
#: Markers of authentication.
AUTH = ("api key", "oauth", "token", "credential", "login", "auth", "secret", "bearer")
#: Markers of domains, in the order in which they are tried.
DOMAINS = (
    ("filesystem", ("filesystem", "file", "directory", "path", "folder")),
    ("math/data processing", ("tensorflow", "torch", "model", "dataset", "hugging", "fairseq", "inference", "transformers", "dataframe", "csv")),
    ("web/fetch mock", ("browser", "playwright", "page", "screenshot", "http", "url", "fetch", "web")),
    ("search/retrieval", ("search", "query", "retrieval", "rank")),
    ("git/version-control", ("git", "commit", "repository", "branch", "diff", "pull request")),
    ("calendar/time", ("calendar", "event", "schedule", "time", "timezone", "date", "clock")),
    ("memory/notes", ("memory", "note", "entity", "knowledge graph", "relation")),
    ("math/data processing", ("math", "calculate", "factorial", "triangle", "number", "aggregate", "statistics")),
    ("image", ("image", "vision", "photo", "stable diffusion", "pixel")),
    ("audio", ("audio", "speech", "sound", "voice")),
    ("database/sql", ("database", "sql", "table", "record")),
    ("messaging/email mock", ("email", "message", "slack", "notification", "send", "inbox")),
    ("cloud/storage mock", ("bucket", "object storage", "cloud", "blob", "s3")),
    ("issue-tracking", ("issue", "ticket", "bug", "label", "assignee", "milestone")),
    ("system/admin mock", ("system", "admin", "service", "process", "log", "environment")),
)
#: Labels of side-effect hints by substring.
HINTS = (
    ("write", "writes_data"), ("create", "creates_resource"), ("delete", "deletes_resource"), ("remove", "deletes_resource"), ("move", "moves_resource"),
    ("update", "updates_resource"), ("send", "external_communication"), ("execute", "executes_code"), ("run", "executes_code"),
)
#: Categories of sources.
CATEGORIES = {
    "mcp_fixture": "local_mcp_fixture_schema", "real_public_mcp": "real_public_mcp_schema_local", "reference_mcp_repo": "real_public_mcp_schema_local",
    "converted_bfcl": "converted_bfcl_api_style", "converted_api_style": "converted_api_style", "converted_apibank": "converted_api_bank_style",
    "converted_api_bank": "converted_api_bank_style", "apibank": "converted_api_bank_style", "converted_toolbench": "converted_toolbench_style", "canonical_json": "canonical_local_schema",
}
#: Canonical domains and the aliases of some.
CANONICAL = (
    "filesystem", "search/retrieval", "database/sql", "calendar/time", "git/version-control", "issue-tracking", "messaging/email mock", "web/fetch mock", "cloud/storage mock", "math/data processing", "memory/notes", "system/admin mock",
)
ALIASES = {
    "search": "search/retrieval", "retrieval": "search/retrieval", "database": "database/sql", "sql": "database/sql", "calendar": "calendar/time", "time": "calendar/time", "git": "git/version-control",
    "version-control": "git/version-control", "communication": "messaging/email mock", "messaging": "messaging/email mock", "email": "messaging/email mock", "web": "web/fetch mock", "fetch": "web/fetch mock",
    "cloud": "cloud/storage mock", "storage": "cloud/storage mock", "math": "math/data processing", "data_science": "math/data processing", "data-science": "math/data processing", "bfcl_api": "math/data processing",
    "memory": "memory/notes", "notes": "memory/notes", "system": "system/admin mock", "admin": "system/admin mock", "browser": "web/fetch mock",
}
MUTATING = ("write", "delete", "execute", "external_communication")


def first_of(text: Column, rules, default: str | Column) -> Column:
    """The label of the first rule with a marker in the text."""
    out = F.lit(default) if isinstance(default, str) else default
    for label, markers in reversed(rules):
        out = F.when(has_marker(text, markers), label).otherwise(out)
    return out


def args(predicate) -> Column:
    return F.coalesce(F.size(F.filter("arguments", predicate)), F.lit(0))


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def schema(raw: Column, arguments: str = "arguments") -> Column:
    """The schema of a record as a variant object: its text, unwrapped once if it is JSON in a JSON string, else rebuilt from its arguments."""
    v = F.try_parse_json(raw)
    inner = F.try_parse_json(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    quoted = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    named = F.filter(arguments, lambda a: a["name"].isNotNull())
    first = F.filter(named, lambda a, i: F.array_position(named["name"], a["name"]) == i + 1)
    node = lambda a: F.to_json(F.struct(a["type"].alias("type"), a["description"].alias("description"), a["enum"].alias("enum"), F.try_parse_json(a["items_schema"]).alias("items"), F.try_parse_json(a["properties"]).alias("properties")))
    members = F.array_join(F.transform(first, lambda a: F.concat(quoted(a["name"]), F.lit(":"), node(a))), ",")
    required = F.to_json(F.filter(first, lambda a: F.coalesce(a["required"], F.lit(False)))["name"])
    built = F.try_parse_json(F.coalesce(F.concat(F.lit('{"type":"object","properties":{'), members, F.lit('},"required":'), required, F.lit("}")), F.lit('{"type":"object"}')))
    return F.coalesce(F.when(is_object(v), v), F.when(is_object(inner), inner), built)


def type_below(json: Column, kind: str) -> Column:
    """Whether any node of the JSON text (no blanks between its members) has that type, alone or in a list."""
    return json.rlike(rf'"type":("{kind}"|\[[^\]]*"{kind}")')


def canonical_domain(domain: Column) -> Column:
    """The canonical spelling of a domain, an alias resolved; others as they are, blank ones null."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(domain), "_", " "), r"\s+", " ")), " / ", "/")
    known = F.create_map(*[F.lit(x) for kv in [*((d, d) for d in CANONICAL), *ALIASES.items()] for x in kv])
    return F.coalesce(F.element_at(known, plain), F.element_at(known, F.regexp_replace(plain, " ", "_")), F.nullif(F.trim(domain), F.lit("")))


EMPTY = "array<string>"


def once(df: DataFrame) -> DataFrame:
    """The same rows; what is built on their columns doesn't evaluate them again.

    The optimizer would otherwise copy an expression to each place that uses it, and a lambda would evaluate it for every
    element. A row number can't be copied, so the projection stays; columns nobody uses are still pruned.
    """
    return df.withColumn("at", F.monotonically_increasing_id()).where(F.col("at") >= 0).drop("at")


def features(df: DataFrame) -> DataFrame:
    """The derived columns of tools (tool_name, tool_purpose, server_name, domain, source_type, arguments, doc_snippets, input_schema_raw).

    Counts are those of the schema's properties (none if they are a list); enumerations and types count at any depth. Null
    texts and lists count as empty. A column ``synthetic`` marks made tools, if there is one.
    """
    made = F.coalesce(F.col("synthetic"), F.lit(False)) if "synthetic" in df.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    df = df.withColumns({"schema": schema(F.col("input_schema_raw")), "purpose": collapsed(F.col("tool_purpose")), "said": F.lower(F.concat_ws(" ", text("tool_name"), text("tool_purpose")))})
    extra = F.try_variant_get("schema", "$.additionalProperties", "variant")
    df = df.withColumns({
        "schema_json": F.to_json("schema"), "props": F.try_variant_get("schema", "$.properties", "map<string,variant>"), "named": F.coalesce(F.try_variant_get("schema", "$.required", EMPTY), F.array().cast(EMPTY)),
        "closed": F.coalesce((F.schema_of_variant(extra) == "BOOLEAN") & ~F.try_variant_get(extra, "$", "boolean"), F.lit(False)), "canonical": canonical_domain(F.col("domain")),
    })
    nodes = F.filter(F.map_values("props"), is_object)
    bare = F.filter(nodes, lambda x: F.coalesce(F.try_variant_get(x, "$.description", "string"), F.lit("")) == "")
    keys = F.coalesce(F.map_keys("props"), F.array().cast(EMPTY))
    df = df.withColumns({
        "normalized_name": tool_name(F.col("tool_name")), "summary": F.substring("purpose", 1, 180), "documentation_length": F.length("purpose"), "num_arguments": F.size(keys), "num_required": F.size(F.array_intersect(keys, F.col("named"))),
        "num_enum": F.regexp_count("schema_json", F.lit(r'"enum":\[')), "undescribed": F.coalesce(F.size(bare), F.lit(0)), "below": F.coalesce(F.to_json("props"), F.lit("")),
    })
    df = df.withColumns({f"has_{k}": type_below(F.col("below"), k) for k in ("array", "object", "boolean", "string")})
    n = F.col("num_arguments")
    described = args(lambda a: F.coalesce(a["description"], F.lit("")) != "")
    listed = F.greatest(F.coalesce(F.size("arguments"), F.lit(0)), F.lit(0))
    undocumented = F.when(n == 0, 0.35).when(F.col("undescribed") > 0, F.least(F.lit(0.35), 0.1 + 0.25 * F.col("undescribed") / F.greatest(n, F.lit(1)))).otherwise(0.0)
    ambiguity = F.when(F.col("documentation_length") < 80, 0.25).otherwise(0.0) + undocumented + F.when(F.col("closed"), 0.0).otherwise(0.15)
    ambiguity = ambiguity + F.when((F.col("num_enum") == 0) & F.col("has_string"), 0.1).otherwise(0.0) + F.when(n >= 5, 0.1).otherwise(0.0)
    documented = F.when(F.col("documentation_length") > 0, 0.4).otherwise(0.0) + F.when(F.coalesce(F.size("doc_snippets"), F.lit(0)) > 0, 0.2).otherwise(0.0)
    documented = documented + F.when(listed > 0, 0.4 * described / F.greatest(listed, F.lit(1))).otherwise(0.0)
    placed = F.lower(F.concat_ws(" ", text("source_type"), text("server_name"), text("tool_name"), text("tool_purpose")))
    acting = F.concat_ws(" ", F.lower(F.coalesce("canonical", F.lit("general"))), F.col("said"))
    plain_domain = F.when(F.coalesce("source_type", F.lit("")).startswith("bfcl"), "math/data processing").otherwise("general")
    df = df.withColumns({
        "inferred_domain": first_of(placed, DOMAINS, plain_domain), "side_effect_type": first_of(acting, SIDE_EFFECTS, "unknown"), "auth_required": has_marker(F.lower("purpose"), AUTH),
        "ambiguity": F.round(F.least(ambiguity, F.lit(1.0)) + 1e-9, 4), "completeness": F.round(F.least(documented, F.lit(1.0)) + 1e-9, 4),
        "source_category": F.when(made, "safe_synthetic_mcp_like").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), F.col("source_type")), F.col("source_type"))),
        "hints": F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(F.col("said").contains(m), label) for m, label in HINTS]))), ","),
    })
    df = df.withColumn("resolved_domain", F.coalesce("canonical", "inferred_domain"))
    hinted = F.col("said").rlike("similar|variant|mode|filter|selector")
    hard = F.col("has_object") | F.col("has_array") | (F.col("num_enum") > 0) | F.col("side_effect_type").isin(*MUTATING) | (F.col("ambiguity") >= 0.45) | hinted | (n > 5)
    medium = n.between(3, 5) | (n > F.col("num_required"))
    return df.withColumn("difficulty", F.when(hard, "hard").when(medium, "medium").otherwise("easy")).drop("schema", "props", "named", "closed", "below", "said")
