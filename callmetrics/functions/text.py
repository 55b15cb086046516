"""Tokenizers and text rules as column expressions. The tokenizers differ on purpose; each belongs to one operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def distractor_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, longer than one character."""
    return F.filter(found(F.lower(text), "[a-z0-9]+"), lambda x: F.length(x) > 1)


def retrieval_tokens(text: Column) -> Column:
    return found(F.lower(text), "[a-z0-9_./*?-]+")


#: The stop words of the trigger predicate.
BEHAVIOR_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with")


def behavior_tokens(text: Column) -> Column:
    """Retrieval tokens without the punctuation at their ends, stop words and single characters."""
    bare = F.transform(retrieval_tokens(text), lambda x: F.regexp_replace(x, r"^[.,;:!?]+|[.,;:!?]+$", ""))
    return F.filter(bare, lambda x: (F.length(x) > 1) & ~x.isin(*BEHAVIOR_STOP))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a blank."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def routing_text(text: Column) -> Column:
    """Lower case; runs of ``_ . / : -`` and of white space become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[_./:-]+", " "), r"\s+", " "))


def normalized_request(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def tool_name(name: Column) -> Column:
    """Lower case, everything but ASCII letters and digits to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def token_count(text: Column) -> Column:
    """Runs of letters, digits and underscores, and single other characters that aren't white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def has_marker(text: Column, markers) -> Column:
    """Whether any marker stands in the text: a phrase anywhere, a word as a whole word."""
    words = [m for m in markers if " " not in m]
    hit = F.lit(False)
    if words:
        hit = text.rlike(f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)")
    for phrase in (m for m in markers if " " in m):
        hit = hit | text.contains(phrase)
    return hit


def normalized_path(path: Column) -> Column:
    """Backslashes to slashes, leading ``./`` dropped; URLs lose slashes at the end, other paths ``.`` parts and repeated slashes."""
    p = F.regexp_replace(F.trim(F.regexp_replace(path, r"\\", "/")), r"^(\./)+", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/\.$", ""), r"/{2,}", "/")
    plain = F.when(plain.isin("", "/"), F.when(plain == "", ".").otherwise("/")).otherwise(F.regexp_replace(plain, "/$", ""))
    return F.when(p.contains("://"), F.regexp_replace(p, "/+$", "")).otherwise(plain)


#: Stop words of the memory and the boundary tokenizer.
MEMORY_STOP = (
    "a", "about", "after", "all", "an", "and", "any", "are", "as", "be", "by", "call", "do", "for", "from", "help", "i", "in", "input", "is", "it", "me", "need", "of", "on", "or", "please", "request", "set", "task", "the", "this",
    "to", "tool", "use", "using", "with",
)
BOUNDARY_STOP = (
    "a", "an", "and", "any", "are", "ask", "be", "call", "do", "field", "fields", "for", "from", "if", "in", "input", "inputs", "is", "it", "not", "or", "parameter", "parameters", "request", "required", "should", "that", "the",
    "this", "to", "tool", "unsupported", "use", "when",
)
#: Groups of words that mean the same.
ALIAS_GROUPS = (
    ("find", "search", "lookup", "locate", "query", "retrieve"), ("read", "show", "view", "open", "display", "fetch"), ("create", "add", "insert", "new", "make", "ensure"),
    ("update", "edit", "modify", "patch", "write", "save", "append"), ("delete", "remove", "clear", "drop"), ("send", "email", "notify", "post", "publish", "transfer"), ("path", "file", "directory", "folder", "location"),
    ("content", "text", "body", "message", "payload"), ("account", "acct", "customer", "client", "user"), ("identifier", "id", "name", "title", "key"),
)


def with_parts(tokens: Column, gaps: str) -> Column:
    """Each token, followed by its parts between ``gaps``."""
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.split(t, gaps))))


def less(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def variants(tokens: Column, *more) -> Column:
    """Distinct tokens and, of each, the variants ``more`` gives (null for none)."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.array_compact(F.array(t, *[m(t) for m in more])))))


def ends(token: Column, end: str, longer: int) -> Column:
    return token.endswith(end) & (F.length(token) > longer)


def memory_tokens(text: Column) -> Column:
    """Distinct tokens and their parts without stop words, and their stems of plurals and participles."""
    kept = lambda t: (F.length(t) > 1) & ~t.isin(*MEMORY_STOP)
    bare = F.filter(F.transform(found(F.lower(text), "[a-z0-9_./-]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), kept)
    return variants(F.filter(with_parts(bare, "[_./-]+"), kept), lambda t: F.when(ends(t, "s", 4), less(t, 1)), lambda t: F.when(ends(t, "ing", 5), less(t, 3)))


def boundary_tokens(text: Column) -> Column:
    """Distinct parts of tokens longer than two characters without stop words, and their variants."""
    parts = F.filter(with_parts(retrieval_tokens(text), "[-_/.]+"), lambda t: (F.length(t) > 2) & ~t.isin(*BOUNDARY_STOP))
    ing, ed = lambda t: ends(t, "ing", 5), lambda t: ends(t, "ed", 4)
    return variants(parts, lambda t: F.when(ing(t), less(t, 3)), lambda t: F.when(ing(t), F.concat(less(t, 3), F.lit("e"))), lambda t: F.when(ed(t), less(t, 2)), lambda t: F.when(ed(t), less(t, 1)), lambda t: F.when(ends(t, "s", 4), less(t, 1)))


def stemmed(tokens: Column) -> Column:
    """Stems of tokens, each with the words of its alias group."""
    bare = F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, r"^[._\-/*?]+|[._\-/*?]+$", "")), lambda t: F.length(t) > 1)
    stems = F.transform(bare, lambda t: F.when(ends(t, "ing", 5), less(t, 3)).when(ends(t, "ed", 4), less(t, 2)).when(ends(t, "s", 4), less(t, 1)).otherwise(t))
    groups = F.create_map(*[x for g in ALIAS_GROUPS for w in g for x in (F.lit(w), F.array(*map(F.lit, g)))])
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(stems), lambda t: F.concat(F.array(t), F.coalesce(F.element_at(groups, t), F.array().cast("array<string>"))))))


def semantic_tokens(text: Column) -> Column:
    return stemmed(with_parts(retrieval_tokens(text), r"[-_./*?]+"))


def doc_tokens(text: Column) -> Column:
    """As ``semantic_tokens``, over tokens without ``*`` and ``?``."""
    return stemmed(with_parts(found(F.lower(text), "[a-z0-9_./-]+"), "[-_./]+"))


def name_variants(name: Column) -> Column:
    """Spellings of a tool's name in routing text, in order, no blank ones."""
    forms = [routing_text(name), *[routing_text(F.replace(name, F.lit(c), F.lit(" "))) for c in "_-."]]
    return F.array_sort(F.filter(F.array_distinct(F.array(*forms)), lambda x: x != ""))


def safe_directory(name: Column, most: int = 80) -> Column:
    """Everything but letters, digits, dots, underscores and hyphens to underscores, cut to ``most`` characters."""
    return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def trimmed_words(text: Column, most: int) -> Column:
    """At most so many words, joined by single blanks; a cut text ends in a full stop."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), "[.,]+$", ""), F.lit(".")))


def distinct_lines(lines: Column, most: int | None = None) -> Column:
    """Lines with collapsed blanks, each once, in order; blank ones dropped."""
    clean = F.array_distinct(F.filter(F.transform(lines, collapsed), lambda x: x != ""))
    return clean if most is None else F.slice(clean, 1, most)
