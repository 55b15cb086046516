"""Predicates over request texts: does a request forbid a tool, select it, or ask for no call at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmetrics.functions.text import routing_text

#: Phrases that forbid a tool, {} being its name.
FORBID = (
    "{} is a distractor", "{} should not be called", "{} is not the right tool", "{} is the wrong tool", "do not use {}", "do not call {}", "avoid {}", "without using {}", "instead of {}", "rather than {}",
)
#: Phrases that select a tool.
SELECT = ("use {}", "using {}", "call {}", "route to {}", "select {}", "choose {}", "correct tool is {}", "right tool is {}", "{} should handle", "{} should be used")
#: What stands before "not NAME" or after it, up to 160 characters off, in a request that forbids it.
BEFORE, AFTER = r"\b(?:boundary\s+check|should\s+handle|correct\s+tool\s+is|route\s+to|select)\b.{0,160}\bnot\s+", r".{0,160}\b(?:should\s+handle|correct\s+tool|appropriate\s+direct\s+action)\b"
#: Reasons to call no tool (a phrase that begins with ~ is a pattern), in the order tried. Of each list of groups, every group must have a phrase in the text.
ABSTAIN = (
    ("explanation_instead_of_action", [["do not actually call", "do not perform the action"]]),
    ("no_tool_call_requested", [["no tool call"]]),
    ("checklist_only", [["only want a checklist"]]),
    ("ambiguous_action", [["not sure what input or action is intended"]]),
    ("missing_required_information", [["i do not know"], [" yet", "required input", "required field"]]),
    ("missing_required_information", [[r"~\b(?:i\s+)?(?:may|might|would)?\s*need\b.+\bbut\b.+\b(?:do\s+not\s+know|don t\s+know|not\s+sure|missing|lack)\b"]]),
    ("known_path_no_search_needed", [["i already know the exact path"], ["no search or discovery is needed", "no search is needed"]]),
    ("read_vs_search_mismatch", [["read the exact item i named directly"], ["do not search", "retrieve candidates", "browse with"]]),
    ("readonly_preview_only", [["only inspect what would happen before using"], ["do not create", "do not update", "do not delete", "do not send", "do not execute", "mutate anything"]]),
    ("readonly_preview_only", [["only preview what would change"], ["do not create", "do not overwrite", "do not delete", "do not send", "do not execute", "mutate anything"]]),
    ("readonly_preview_only", [["without changing it"], ["do not write", "do not update", "do not delete", "do not overwrite", "do not mutate"]]),
    ("destructive_vs_readonly_mismatch", [["need a change made"], ["not a read only lookup"], ["do not satisfy this with a read"]]),
    ("destructive_vs_readonly_mismatch", [["do not merely read", "not merely read"], ["create", "overwrite", "write", "update", "change"]]),
    ("adjacent_wrong_intent", [["this is adjacent to"], ["but the intended capability is"]]),
    ("adjacent_wrong_intent", [["this is a boundary check"], [" should handle "], [" not "]]),
    ("out_of_domain_request", [["is unrelated to"]]),
)


def any_of(text: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p[1:]) if p.startswith("~") else text.contains(p) for p in phrases])


def with_name(text: Column, name: Column, phrases) -> Column:
    """Whether one of the phrases stands in the text with the name in its place."""
    made = [F.concat(F.lit(p.split("{}")[0]), name, F.lit(p.split("{}")[1])) for p in phrases]
    return (name != "") & reduce(lambda a, b: a | b, [text.contains(p) for p in made])


def forbids(request: Column, tool: Column) -> Column:
    """A phrase that forbids the tool, or "not NAME" near words that name what should be used instead."""
    text, name = routing_text(request), routing_text(tool)
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    far = F.rlike(text, F.concat(F.lit(BEFORE), quoted, F.lit(r"\b"))) | F.rlike(text, F.concat(F.lit(r"\bnot\s+"), quoted, F.lit(r"\b"), F.lit(AFTER)))
    return with_name(text, name, FORBID) | ((name != "") & text.contains(F.concat(F.lit("not "), name)) & far)


def selects(request: Column, tool: Column) -> Column:
    """A request that forbids a tool doesn't select it."""
    return ~forbids(request, tool) & with_name(routing_text(request), routing_text(tool), SELECT)


def abstention(request: Column) -> Column:
    """The reason for which the request wants no call, or null; an empty request is one."""
    text = routing_text(request)
    out = F.lit(None).cast("string")
    for reason, groups in reversed(ABSTAIN):
        out = F.when(reduce(lambda a, b: a & b, [any_of(text, g) for g in groups]), reason).otherwise(out)
    return F.when(text == "", "empty_request").otherwise(out)
