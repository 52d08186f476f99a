"""Domains of files by where they lie and what they are called."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame, functions as F

# Directory names and extensions, and the domains they stand for.
DIRECTORIES = {
    "docs": "documentation", "doc": "documentation", "documentation": "documentation", "src": "code", "lib": "code", "tests": "testing", "test": "testing",
    "config": "configuration", "configs": "configuration", "deploy": "deployment", "deployment": "deployment", "infra": "infrastructure", "infrastructure": "infrastructure",
    "api": "api", "scripts": "scripts", "ops": "operations", "security": "security", "auth": "authentication", "frontend": "frontend", "backend": "backend",
    "db": "database", "database": "database", "models": "models", "schemas": "schemas",
}
EXTENSIONS = {
    ".sql": "database", ".proto": "api", ".graphql": "api", ".openapi": "api", ".swagger": "api", ".yml": "configuration", ".yaml": "configuration", ".toml": "configuration",
    ".ini": "configuration", ".cfg": "configuration", ".env": "configuration", ".dockerfile": "deployment", ".tf": "infrastructure", ".hcl": "infrastructure",
    ".md": "documentation", ".rst": "documentation", ".adoc": "documentation",
}
CONFIDENCE = {"explicit": 1.0, "path_rule": 0.9, "directory_name": 0.7, "extension": 0.5, "fallback": 0.3}


def _mapped(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key] if names else F.lit(None).cast("string")


def by_prefix(paths: DataFrame, path: str, prefixes: DataFrame) -> DataFrame:
    """``paths`` with ``prefix_domain``: the domain of the longest folder of ``prefixes``
    (prefix, domain) that a path lies in; null if none.  A path meets the table only at
    the depths that the table has, in an equi-join."""
    parts = F.split(F.regexp_replace("prefix", "^/+|/+$", ""), "/+")
    table = prefixes.where("prefix is not null").select(F.size(parts).alias("_depth"), F.array_join(parts, "/").alias("_at"), "domain").groupBy("_depth", "_at").agg(F.min("domain").alias("_domain"))
    depths = [r._depth for r in table.select("_depth").distinct().collect()]  # folders are not deep
    rows = paths.select("*", F.monotonically_increasing_id().alias("_row"), F.split(F.regexp_replace(path, "^/+|/+$", ""), "/+").alias("_parts"))
    if not depths:
        return paths.withColumn("prefix_domain", F.lit(None).cast("string"))
    each = rows.select("_row", "_parts", F.explode(F.array(*map(F.lit, sorted(depths)))).alias("_depth")).where(F.size("_parts") > F.col("_depth"))
    hits = each.select("_row", "_depth", F.array_join(F.slice("_parts", F.lit(1), F.col("_depth")), "/").alias("_at")).join(table, ["_depth", "_at"])
    best = hits.groupBy("_row").agg(F.max_by("_domain", "_depth").alias("prefix_domain"))
    return rows.join(best, "_row", "left").drop("_row", "_parts")


def classify(path: Column, *, rules: list[tuple[str, str, int]] = (), default: str | None = None, root: str | None = None, directories: dict[str, str] = DIRECTORIES, extensions: dict[str, str] = EXTENSIONS, prefix_domain: Column | None = None) -> Column:
    """struct(domain, source, confidence) of a path: an explicit default, the first of the
    ``rules`` (pattern, domain, priority) by falling priority that fits the path below
    ``root``, the longest prefix of a table, the parent folder's name, the extension, else
    the name of the root or of the parent folder."""
    made = lambda domain, source: F.struct(domain.alias("domain"), F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).alias("confidence"))
    if default:
        return made(F.lit(default), "explicit")
    inner = path if root is None else F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    name, parent = F.regexp_extract(path, "([^/]*)/*$", 1), F.lower(F.regexp_extract(path, "([^/]+)/+[^/]+/*$", 1))
    suffix = F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]+)$", 1))
    last = F.lit(root.rstrip("/").rsplit("/", 1)[-1].lower()) if root is not None else parent
    answer = made(F.coalesce(F.nullif(last, F.lit("")), F.lit("general")), "fallback")
    for source, domain in (("extension", _mapped(extensions, suffix)), ("directory_name", _mapped(directories, parent)), ("path_rule", prefix_domain)):
        if domain is not None:
            answer = F.when(domain.isNotNull(), made(domain, source)).otherwise(answer)
    for pattern, domain, _ in reversed(sorted(rules, key=lambda r: -r[2])):
        answer = F.when(inner.rlike("^" + translate(pattern)), made(F.lit(domain), "path_rule")).otherwise(answer)
    return answer
