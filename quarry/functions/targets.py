"""From a raw syntax fact to its relation and targets, by language: column expressions, so that facts never leave the JVM.

A fact gives (relation or null, reason or null, targets). Targets are modules with candidate paths, symbols with an optional
qualifier, or configuration keys. Statements fall into clauses (before a quoted module, inside braces, after a keyword),
clauses into entries at commas, and entries at white space into a name and perhaps `as` and an alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Relations by kind of fact, kinds that give none, languages.
RELATIONS = {"import": "imports", "export": "exports", "call": "calls", "inherits": "inherits", "implements": "implements", "schema": "uses_schema", "configuration": "configured_by"}
SILENT = ("decorator", "route", "tests")
JAVASCRIPT = ("javascript", "typescript", "tsx")

_BRACES = r"\{([^}]*)\}"


def _at_commas(clause: Column) -> Column:
    return F.filter(F.transform(F.split(clause, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def entries(clause: Column) -> Column:
    """array of struct(name, alias) of a clause's well-formed entries."""
    split = F.transform(_at_commas(clause), lambda x: F.split(x, " "))
    good = F.filter(split, lambda e: e[0].rlike(r"^(\*|[\w$.]+)$") & ((F.size(e) == 1) | ((F.size(e) == 3) & (F.get(e, 1) == "as"))))
    return F.transform(good, lambda e: F.struct(e[0].alias("name"), F.get(e, 2).alias("alias")))


def names(text: Column) -> Column:
    """The identifiers of a text; whatever stands between them parts them."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_$]+"), lambda x: x.rlike(r"^[A-Za-z_$]"))


def called(text: Column) -> Column:
    """What is called, without arguments that stand in between."""
    return F.regexp_replace(text, r"\([^()]*\)", "")


def _target(kind: str, value: Column, qualifier: Column | None = None, alias: Column | None = None, imported: Column | None = None, paths: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    rest = [(none if c is None else c).alias(n) for n, c in (("qualifier", qualifier), ("alias", alias), ("imported_name", imported))]
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), *rest, (F.array().cast("array<string>") if paths is None else paths).alias("candidate_paths"))


def _binding(module: Column, imported: Column | None, alias: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(module.alias("module"), (none if imported is None else imported).alias("imported"), (none if alias is None else alias).alias("alias"))


def _bindings(facts: DataFrame) -> DataFrame:
    """Adds `_bound`, what an import or export binds (module, imported, alias), and whether an export is of the file's own."""
    python, script, dart = F.col("language") == "python", F.col("language").isin(*JAVASCRIPT), F.col("language") == "dart"
    # what stands before the first quoted string, the string, and what follows
    told = facts.withColumns({
        "_before": F.regexp_replace("_text", r"(?s)['\"].*$", ""), "_source": F.regexp_extract("_text", r"['\"]([^'\"]+)['\"]", 1), "_after": F.regexp_replace("_text", r"(?s)^[^'\"]*['\"][^'\"]*['\"]", ""),
        "_halves": F.split(F.regexp_replace("_text", r"^(?:import|from)\s+", ""), r"\s+import\b\s*", 2),
    })
    clause = F.regexp_replace(F.regexp_replace("_before", r"\bfrom\s*$", ""), r"^\s*(?:import|export)\b(?:\s+type\b(?=\s*[\w{*]))?", "")
    told = told.withColumn("_clause", clause).withColumn("_from", F.col("_text").rlike(r"^from\s") & F.get("_halves", 0).rlike(r"^[\w.]+$"))
    listed = F.when(script, F.regexp_extract("_clause", _BRACES, 1)).when(python & F.col("_from"), F.translate(F.coalesce(F.get("_halves", 1), F.lit("")), "()", "  ")).when(python & F.col("_text").rlike(r"^import\s"), F.get("_halves", 0))
    told = told.withColumns({"_inner": entries(F.coalesce(listed, F.lit(""))), "_outer": entries(F.when(script, F.regexp_replace("_clause", _BRACES, "")).otherwise(""))})
    source, ending = F.col("_source"), F.col("_before").rlike(r"\bfrom\s*$")
    named = lambda e: F.when(e["name"] != "*", e["name"])
    whole = F.transform("_inner", lambda e: _binding(e["name"], None, F.coalesce(e["alias"], F.split(e["name"], r"\.")[0])))
    parts = F.transform("_inner", lambda e: _binding(F.get("_halves", 0), named(e), F.coalesce(e["alias"], named(e))))
    spaces = F.transform(F.filter("_outer", lambda e: (e["name"] == "*") & e["alias"].isNotNull()), lambda e: _binding(source, None, e["alias"]))
    braced = F.transform(F.filter("_inner", lambda e: e["name"] != "*"), lambda e: _binding(source, e["name"], F.coalesce(e["alias"], e["name"])))
    default = F.transform(F.filter("_outer", lambda e: (e["name"] != "*") & e["alias"].isNull()), lambda e: _binding(source, e["name"], e["name"]))
    told = told.withColumns({"_braced": braced, "_every": F.concat(spaces, braced, default)})
    star, alone = F.exists("_outer", lambda e: e["name"] == "*"), F.array(_binding(source, None, None))
    variable = F.nullif(F.regexp_extract("_before", r"([\w$]+)\s*=\s*require\s*\(\s*$", 1), F.lit(""))
    alias = F.nullif(F.regexp_extract("_after", r"\bas\s+(\w+)", 1), F.lit(""))
    quoted, exports = source != "", F.col("kind") == "export"
    bound = (
        F.when(exports & script & quoted & ending, F.when(star, F.array(_binding(source, None, F.lit("*")))).otherwise(F.col("_braced")))
        .when(exports, None).when(python, F.when(F.col("_from"), parts).otherwise(whole))
        .when(script & quoted & ending, F.when(F.size("_every") > 0, F.col("_every")).otherwise(alone)).when(script & quoted & F.col("_before").rlike(r"^\s*import\s*$"), alone)
        .when(script & quoted & variable.isNotNull(), F.array(_binding(source, None, variable)))
        .when(dart & quoted & F.col("_before").rlike(r"\bimport\s*$"), F.array(_binding(source, None, alias)))
    )
    return told.withColumn("_own", exports & ~(script & quoted & ending)).withColumn("_bound", bound)


def _spelled(facts: DataFrame) -> DataFrame:
    """Adds `_found`: the spelled types of a fact (in parentheses, in its clauses, or a bare name), or what it calls."""
    plain = F.col("_text")
    for _ in range(4):  # type arguments, from the inside
        plain = F.regexp_replace(plain, r"<[^<>]*>", "")
    told = facts.withColumn("_plain", F.trim(plain)).withColumn("_sections", F.split("_plain", r"\s*\b(?=(?:extends|implements|with)\s)"))
    wanted = lambda x: F.when(F.col("kind") == "implements", x.rlike(r"^implements\s")).otherwise(x.rlike(r"^(?:extends|with)\s"))
    told = told.withColumn("_named", F.flatten(F.transform(F.filter("_sections", wanted), lambda x: _at_commas(F.regexp_replace(x, r"^\w+\s+", "")))))
    p = F.col("_plain")
    types = (
        F.when(p.startswith("(") & p.endswith(")"), _at_commas(F.substring(p, F.lit(2), F.length(p) - 2))).when(F.size("_named") > 0, F.col("_named"))
        .when(p.rlike(r"^[A-Za-z_$][\w$.?]*$"), F.array(p)).otherwise(F.array().cast("array<string>"))
    )
    return told.withColumn("_found", F.when(F.col("kind") == "call", F.array(called(F.col("_text")))).when(F.col("kind").isin("inherits", "implements", "schema"), types))


def with_targets(facts: DataFrame) -> DataFrame:
    """Adds (relation, reason, targets) to facts (language, kind, target_text, relative_path, ...).

    Without targets the relation is null and a reason says why, but for silent kinds. A null text counts as empty. Each step
    is a projection of its own, so that no expression stands in the plan more often than it is written here.
    """
    told = _spelled(_bindings(facts.withColumn("_text", F.trim(F.coalesce("target_text", F.lit(""))))))
    path, language = F.col("relative_path"), F.col("language")
    paths = lambda m: F.when(language == "python", T.python_module_paths(path, m)).when(language == "dart", T.dart_module_paths(path, m)).otherwise(T.javascript_module_paths(path, m))
    modules = F.transform("_bound", lambda b: _target("module", b["module"], None, b["alias"], b["imported"], paths(b["module"])))
    symbols = F.transform(F.filter(F.transform("_found", names), lambda n: F.size(n) > 0), lambda n: _target("symbol", F.element_at(n, -1), F.try_element_at(n, F.lit(-2))))
    key = T.configuration_key(F.col("_text"))
    kind = F.col("kind")
    found = F.when(kind.isin("import", "export"), modules).when(kind == "configuration", F.when(key.isNotNull(), F.array(_target("configuration", key)))).otherwise(symbols)
    told = told.withColumn("targets", F.array_distinct(found))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), kind)
    some, silent = F.coalesce(F.size("targets"), F.lit(0)) > 0, kind.isin(*SILENT) | F.col("_own")
    why = (
        F.when(known.isNull(), "unsupported_fact_kind").when(kind.isin("import", "export"), F.concat(F.lit("unsupported_"), kind, F.lit("_syntax")))
        .when(kind == "configuration", "unsupported_configuration_key").when(kind == "call", "unsupported_symbol_target").otherwise("unsupported_type_target")
    )
    none = F.array().cast(told.schema["targets"].dataType)
    return told.select(*facts.columns, F.when(some, known).alias("relation"), F.when(~some & ~silent, why).alias("reason"), F.coalesce("targets", none).alias("targets"))
