"""Column functions over texts, names and paths; all built-in expressions, nothing leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the search language and of task parsing.
MAX_QUERY, MAX_TERMS = 500, 20
MAX_IDENTIFIERS, MAX_PHRASES, MAX_PATHS, MAX_LEXICAL, MAX_PLANNED = 20, 5, 10, 6, 12
JS_EXTENSIONS = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")

#: English words that are no identifiers of a task.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall must "
    "to of in for on with at by from as into through during before after above below between out off over under again further then once "
    "here there when where why how all both each few more most other some such no nor not only own same so than too very just because "
    "but and or if while about up down it its this that these those i me my we our you your he him his she her they them their "
    "which what who whom get set let make use using used also need want like please help try something anything everything "
    "code file function method class module part way thing"
).split()

#: Patterns of task actions; the first action in this order that is found holds.
ACTIONS = {
    "explain": r"\b(?:explain|describe|document|summarize|overview)\b|\b(?:how\s+does|what\s+does|walk\s+me\s+through)\b",
    "refactor": r"\b(?:refactor|restructure|reorganize|rename|move|extract|inline|simplify|clean\s*up|improve)\b",
    "test": r"\b(?:add|write|create|implement)\s+(?:a\s+)?(?:test|tests|spec|specs)\b|\b(?:test|spec|coverage|assert|verify|validate)\b|\b(?:check|ensure)\s+(?:that|the|this|it)\b",
    "diagnose": r"\b(?:diagnose|debug|investigate|troubleshoot)\b|\b(?:find\s+(?:the\s+)?(?:bug|error|issue|problem|crash|failure|root\s+cause))\b"
    r"|\b(?:why\s+(?:is|does|did|are|was|were|can't|won't|doesn't|isn't))\b|\b(?:what(?:'s|\s+is)\s+wrong|broken|failing|doesn't\s+work|not\s+working)\b|\b(?:traceback|stack\s+trace|segfault)\b",
    "change": r"\b(?:fix|patch|repair|correct|resolve)\b|\b(?:add|implement|create|write|introduce|insert)\b|\b(?:remove|delete|drop|strip|eliminate)\b"
    r"|\b(?:update|modify|change|edit|adjust)\b|\b(?:display|show|render|style|layout|position|place|hide|toggle|animate)\b",
}
#: What counts as a qualified name, a name, a quotation and a path in a task.
_QUALIFIED = r"(?<![.\w])([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)(?![.\w])"
_IDENTIFIER = r"(?<![.\w/\\])([A-Za-z_][A-Za-z0-9_]{1,63})(?![.\w/\\])"
_QUOTED = r"\"([^\"]{1,200})\"|'([^']{1,200})'"
_PATH_WITH_FOLDER = r"(?<![.\w])([A-Za-z_][A-Za-z0-9_]*(?:[/\\][A-Za-z0-9_]+)*[/\\][A-Za-z0-9_]+\.[A-Za-z]{1,10})(?![.\w])"
_PATH = r"(?<![.\w])([A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)*\.[A-Za-z]{1,10})(?![.\w])"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stable_id(*parts: Column) -> Column:
    """SHA-256 over the parts, each led by the four big-endian bytes of its UTF-8 length; hex."""
    led = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), F.encode(p, "utf-8")) for p in parts]
    return F.sha2(F.concat(*led), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: a quarter of the characters, at least one a line; 0 for the empty text."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.floor(F.length(text) / 4).cast("int"), F.lit(1), lines)).cast("int")


def bounded(text: Column, n: int = 500) -> Column:
    return F.substring(text, 1, n)


#: Fixed value: the spaces of Unicode.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def collapse_space(text: Column) -> Column:
    """White space runs as one space; none, nor any other space of Unicode, at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(_SPACES))


def snippet(*candidates: Column, n: int = 300) -> Column:
    """The first candidate that is not blank, white space collapsed, cut to n characters with dots."""
    full = F.coalesce(*[F.nullif(collapse_space(c), F.lit("")) for c in candidates], F.lit(""))
    return F.when(F.length(full) <= n, full).otherwise(F.concat(F.rtrim(F.substring(full, 1, n - 3), F.lit(_SPACES)), F.lit("...")))


def search_terms(query: Column) -> Column:
    """The query's words, at most MAX_TERMS; empty for a query that is blank, too long or has none."""
    q = F.trim(query)
    return F.when((F.length(q) > 0) & (F.length(q) <= MAX_QUERY), F.slice(_all(q, r"(?U)\w+", 0), 1, MAX_TERMS)).otherwise(F.array().cast("array<string>"))


def match_expression(query: Column) -> Column:
    """The bounded full-text expression: every word as a prefix, all of them wanted."""
    return F.array_join(F.transform(search_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"*'))), " AND ")


def _accents() -> tuple[str, str]:
    """Small Latin letters with marks, and the plain letters that they are built on."""
    built = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: d[0] for c, d in built.items() if c == c.lower() and len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}
    return "".join(plain), "".join(plain.values())


def folded(text: Column) -> Column:
    """Lower case, without accents on Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())


#: Fixed value: what an index token is.
TOKEN = r"(?U)[\p{L}\p{N}\p{Co}_]+"


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters, digits and underscores, lower-cased and without accents."""
    return _all(folded(text), TOKEN, 0)


def rank_score(bm25: Column) -> Column:
    """A match's strength in [0.75, 0.95]."""
    r = F.greatest(bm25, F.lit(0.0))
    return F.lit(0.75) + F.lit(0.2) * r / (F.lit(1.0) + r)


def exact_score(query: Column, qualified_name: Column) -> Column:
    """1 for the qualified name, else 0.98; half of that if the query is one plain word."""
    plain = ~query.contains(".") & ~query.contains(" ")
    return F.when(qualified_name == query, 1.0).otherwise(0.98) * F.when(plain, 0.5).otherwise(1.0)


# --- tasks ----------------------------------------------------------------------------------------------------------


def qualified_identifiers(task: Column) -> Column:
    return F.slice(F.array_distinct(_all(task, _QUALIFIED)), 1, MAX_IDENTIFIERS)


def identifiers(task: Column) -> Column:
    """Single identifiers that are no part of a qualified one and no stop word."""
    # all qualified ones are left out, before the cut to MAX_IDENTIFIERS of the reported list
    inside = F.flatten(F.transform(qualified_identifiers(task), lambda q: F.split(q, r"\.")))
    words = F.array_except(F.array_distinct(_all(task, _IDENTIFIER)), inside)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w))), 1, MAX_IDENTIFIERS)


def path_candidates(task: Column) -> Column:
    first = F.transform(_all(task, _PATH_WITH_FOLDER), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    return F.slice(F.array_distinct(F.concat(first, _all(task, _PATH))), 1, MAX_PATHS)


def quoted_phrases(task: Column) -> Column:
    both = F.zip_with(_all(task, _QUOTED, 1), _all(task, _QUOTED, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.slice(F.array_distinct(F.filter(both, lambda x: x != "")), 1, MAX_PHRASES)


#: Letters beyond ASCII that fold to ASCII ones.
FOLDING = "[\u017f\u212a]"


def ascii_words(text: Column) -> Column:
    """A text without characters beyond ASCII, which are no part of a word to RE2, but to Java's word bounds before Java 19."""
    return F.regexp_replace(text, r"[^\x00-\x7f]|\x0b", "\x01")


def ascii_pattern(pattern: str) -> str:
    """A pattern of lower-case letters as RE2 reads it with (?i): words of ASCII letters, but FOLDING letters match s and k."""
    word = "[A-Za-z0-9_]"
    meant = {r"\b": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", r"\s": r"[\t\n\f\r ]", "s": "[s\u017f]", "k": "[k\u212a]"}
    return "".join(meant.get(x, x) for x in re.findall(r"\\.|.", pattern))


def task_action(task: Column, actions: dict[str, str] = ACTIONS) -> Column:
    found = F.coalesce(*[F.when(task.rlike(f"(?i){pattern}"), action) for action, pattern in actions.items()])
    return F.coalesce(found, F.lit("unknown"))


def lexical_queries(qualified: Column, phrases: Column, idents: Column) -> Column:
    """Qualified names, phrases, identifiers of three letters or more, then neighbouring pairs of those; at most MAX_LEXICAL."""
    led = F.concat(qualified, phrases)
    wide = F.array_except(F.filter(idents, lambda w: F.length(w) >= 3), led)
    n = F.greatest(F.size(wide) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(wide, F.lit(1), n), F.slice(wide, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(F.array_distinct(F.concat(led, wide, pairs)), 1, MAX_LEXICAL)


def _asked(*parts: Column) -> tuple[Column, Column]:
    """(all values that a task could search for, those of them that a search takes)."""
    asked = F.transform(F.concat(*parts), lambda x: F.trim(x))
    return asked, F.filter(asked, lambda x: (F.length(x) > 0) & (F.length(x) <= MAX_QUERY) & x.rlike(r"(?U)[\p{L}\p{N}]"))


def planned_queries(focus: Column, qualified: Column, paths: Column, phrases: Column, lexical: Column, task: Column) -> Column:
    """Search queries of a task in order, distinct, at most MAX_PLANNED; its first words if nothing else is left."""
    _, usable = _asked(focus, qualified, paths, phrases, lexical)
    some = F.slice(F.array_distinct(usable), 1, MAX_PLANNED)
    words = F.substring(F.array_join(F.slice(_all(task, r"(?U)\w+", 0), 1, MAX_TERMS), " "), 1, MAX_QUERY)
    return F.when(F.size(some) > 0, some).otherwise(F.filter(F.array(words), lambda x: x != ""))


def discarded_inputs(focus: Column, qualified: Column, paths: Column, phrases: Column, lexical: Column) -> Column:
    """How many values planned_queries leaves out: those that no search takes, and distinct ones beyond MAX_PLANNED."""
    asked, usable = _asked(focus, qualified, paths, phrases, lexical)
    return F.size(asked) - F.size(usable) + F.greatest(F.size(F.array_distinct(usable)) - MAX_PLANNED, F.lit(0))


# --- paths and code targets -----------------------------------------------------------------------------------------


def normal_path(path: Column) -> Column:
    """POSIX normal form of a path: empty and . segments go, .. takes the one before it (or stays at the front)."""
    absolute = F.startswith(path, F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (x == "..") & (F.size(done) > 0) & (last != "..")
        return F.when(x.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).when((x == "..") & absolute, done).otherwise(F.concat(done, F.array(x)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def is_safe_path(path: Column) -> Column:
    """Whether a path is relative, without drive, upward segment or NUL."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (F.length(F.trim(p)) > 0) & ~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & ~p.contains("\x00")


def _paths() -> Column:
    return F.array().cast("array<string>")


def python_module_paths(source_path: Column, module: Column) -> Column:
    """File candidates of a Python module; each leading dot but the first goes one folder up from the source's."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    name = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != "")
    folders = F.filter(F.split(F.regexp_replace(source_path, r"[^/]*$", ""), "/"), lambda x: x != "")
    above = F.size(folders) - (dots - 1)
    parts = F.when(dots == 0, name).otherwise(F.concat(F.slice(folders, F.lit(1), F.greatest(above, F.lit(0))), name))
    base = F.array_join(parts, "/")
    found = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    return F.when((F.size(parts) == 0) | ((dots > 0) & (above < 0)), _paths()).otherwise(found)


def _relative(source_path: Column, module: Column) -> Column:
    return normal_path(F.concat(F.regexp_replace(source_path, r"[^/]*$", ""), module))


def javascript_module_paths(source_path: Column, module: Column) -> Column:
    """File candidates of a relative module: itself if it has an extension, else with each one, else its index files."""
    endings = F.array(*[F.lit(x) for x in [*JS_EXTENSIONS, *[f"/index{e}" for e in JS_EXTENSIONS]]])
    made = lambda base: F.when(base.rlike(r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"), F.array(base)).otherwise(F.transform(endings, lambda e: F.concat(base, e)))
    # a transform over one value, so that the base stands in the plan once
    return F.when(~module.rlike(r"^\.\.?/"), _paths()).otherwise(F.flatten(F.transform(F.array(_relative(source_path, module)), made)))


def dart_module_paths(source_path: Column, module: Column) -> Column:
    """package: modules lie below lib/, dart: ones nowhere, others beside the source."""
    rest = F.regexp_extract(module, r"^package:[^/]*/(.+)$", 1)
    inside = F.when(rest != "", F.array(F.concat(F.lit("lib/"), rest))).otherwise(_paths())
    return F.when(module.startswith("dart:"), _paths()).when(module.startswith("package:"), inside).otherwise(F.array(_relative(source_path, module)))


def configuration_key(text: Column) -> Column:
    """The text if it is a well-formed key, else null."""
    return F.when(text.rlike(r"^[A-Za-z_][A-Za-z0-9_.:-]{0,127}$"), text)


def is_schema_name(kind: Column, qualified_name: Column) -> Column:
    leaf = F.lower(F.substring_index(qualified_name, ".", -1))
    return kind.isin("class", "interface") & leaf.rlike("(schema|request|response|model|dto)$")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
