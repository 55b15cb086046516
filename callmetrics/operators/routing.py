"""Scores of a request against a tool, as column expressions over token sets that are made once a row, before any join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmetrics.functions import text
from callmetrics.operators import requests as rq

#: Words of families of actions.
ACTIONS = {
    "read": ("read", "open", "show", "inspect", "display", "view", "get", "retrieve", "lookup", "look"), "search": ("search", "find", "lookup", "query", "filter", "list", "discover"),
    "create": ("create", "add", "make", "generate", "schedule", "insert", "write"), "update": ("update", "edit", "modify", "change", "patch", "rename", "set"), "delete": ("delete", "remove", "erase", "destroy", "drop"),
    "send": ("send", "email", "message", "notify", "post", "publish", "share"), "compute": ("calculate", "compute", "convert", "estimate", "solve", "measure"), "transfer": ("transfer", "move", "pay", "deposit", "withdraw"),
}
#: What asks for nothing to be changed, and the families that change something.
READ_ONLY = ("read-only", "only inspect", "only preview", "do not create", "do not update", "do not delete", "do not modify")
WRITING = ("create", "update", "delete", "send", "transfer")
#: Markers in requests.
MARKERS = {
    "negative_marker": ("unrelated to", "out of domain", "should not be called", "is a distractor", "do not use", "do not call", "without using"),
    "no_tool_marker": ("no tool call", "do not actually call", "don't actually call", "planning only", "only want a checklist"),
    "missing_info_marker": ("do not know", "don't know", "missing", "not sure what input", "not sure which", "provide later", "send later"),
}
#: Fixed values: (arguments of which one must be there, cues of which one must be in the request, bonus).
CUES = (
    (("pattern",), ("find", "search", "look under", "markdown", "python", "json", "text files", "glob"), 10), (("head", "tail"), ("read", "show", "first", "last", "top", "trailing", "lines"), 10),
    (("content",), ("write", "save", "create file", "containing the text", "with content"), 10),
)
#: Cues of the two bonuses for tools whose only argument is a path.
MAKING, PLACES, EXISTING, LISTING = ("create", "ensure", "mkdir", "set up", "prepare"), ("directory", "folder", "path"), ("exist", "exists", "directory", "folder", "path"), ("list", "show contents", "inspect", "directory contents")


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


#: What ``overlap`` needs of either side.
OVERLAP = ("low", "tokens", "pairs", "meant")


def request_side(request: Column, *fields: str) -> Column:
    """Those fields of a request: a struct, so that nothing else is made or moved."""
    r = F.coalesce(request, F.lit(""))
    tokens = text.retrieval_tokens(r)
    all_ = {"low": F.lower(r), "plain": text.routing_text(r), "tokens": F.array_distinct(tokens), "pairs": F.array_distinct(text.bigrams(tokens)), "meant": text.semantic_tokens(r)}
    return F.struct(*[all_[f].alias(f) for f in fields])


def search_text() -> Column:
    """The text a tool is searched by: its name, purpose, snippets, warnings and arguments."""
    parts = F.concat(F.array("tool_name", "tool_purpose"), F.coalesce("doc_snippets", F.array().cast("array<string>")), F.coalesce("usage_warnings", F.array().cast("array<string>")))
    argued = F.coalesce(F.flatten(F.transform("arguments", lambda a: F.array(a["name"], a["description"]))), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(parts, argued), lambda x: x != ""), " ")


def text_side(t: Column, *fields: str) -> Column:
    return request_side(t, *fields)


def overlap(q: Column, t: Column) -> Column:
    """Twice the common tokens, once the further words of common meaning, four times the common pairs, six if all of the request stands in the text."""
    shared = F.array_intersect(q["tokens"], t["tokens"])
    meant = F.array_except(F.array_intersect(q["meant"], t["meant"]), shared)
    return 2 * F.size(shared) + F.size(meant) + 4 * common(q["pairs"], t["pairs"]) + F.when(t["low"].contains(q["low"]), 6).otherwise(0)


def router_overlap(q: Column, t: Column) -> Column:
    return 2 * common(q["tokens"], t["tokens"]) + F.when(t["low"].contains(q["low"]), 5).otherwise(0)


def intent_bonus(low: Column, name: Column, arguments: Column) -> Column:
    """Bonuses for requests whose cues fit a tool's arguments."""
    names = F.coalesce(arguments, F.array().cast("array<string>"))
    out = F.lit(0)
    for needed, cues, bonus in CUES:
        out = out + F.when(F.arrays_overlap(names, F.array(*map(F.lit, needed))) & rq.any_of(low, cues), bonus).otherwise(0)
    only_path = (F.size(F.array_distinct(names)) == 1) & F.array_contains(names, "path")
    made = (rq.any_of(low, MAKING) & rq.any_of(low, PLACES)) | (low.contains("make sure") & rq.any_of(low, EXISTING))
    return F.coalesce(out + F.when(only_path & name.contains("create") & made, 8).otherwise(0) + F.when(only_path & name.contains("list") & rq.any_of(low, LISTING), 8).otherwise(0), F.lit(0))


def mention_adjustment(plain: Column, name: Column) -> Column:
    """-80 for each spelling of the name the request forbids, 18 for each it selects."""
    return F.aggregate(text.name_variants(name), F.lit(0), lambda s, n: s + F.when(rq.forbids(plain, n), -80).otherwise(0) + F.when(rq.selects(plain, n), 18).otherwise(0))


def families(memory: Column, low: Column) -> Column:
    """Families of actions whose words stand in a text."""
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    hit = lambda terms: F.arrays_overlap(memory, F.array(*map(F.lit, terms))) | rq.any_of(padded, [f" {t} " for t in terms])
    return F.array_compact(F.array(*[F.when(hit(terms), family) for family, terms in ACTIONS.items()]))


def conflict(a: Column, b: Column) -> Column:
    """Both have families of actions, and none in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def read_write_conflict(low: Column, tool: Column) -> Column:
    return rq.any_of(low, READ_ONLY) & F.arrays_overlap(tool, F.array(*map(F.lit, WRITING)))


def normalized_overlap(a: Column, b: Column) -> Column:
    """Common tokens over the root of the second set's size; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common(a, b) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))


def prototype_score(query: Column, tokens: Column, weight: Column) -> Column:
    """The weight times twice the common tokens and their number over the root of the prototype's size."""
    n = common(query, tokens)
    return F.when(n == 0, 0.0).otherwise(weight * (2.0 * n + n / F.sqrt(F.greatest(F.size(tokens), F.lit(1)).cast("double"))))
