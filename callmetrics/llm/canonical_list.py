"""Values typed freely, mapped to the entry of a reference list they mean. Built-in SQL throughout.

A value is read as a whole and, if it has several words, without its first or its last word (a prefix such as "our" or a
suffix such as a version). A reading means an entry if, in this order,
1. its words are those of the entry's name or of an alias, in any order, "and" left out, or written together;
2. its words, some cut short with a full stop, are beginnings of the entry's words;
3. it is within a few edits of the name or an alias, by a partition-based pigeonhole join: each reference form is cut
   into k + 1 segments, of which k edits leave at least one whole, moved by k places at most; substrings of the value at
   those places are joined with the segments by equality and the pairs verified with the built-in ``levenshtein``; a reading without a word may have one edit for eight letters.
   Only lengths that some form has are tried, so values of any length are read whole and cost no more than the list is long.
Values that match nothing come out of an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Edits allowed to a reference form of so many letters: one up to 5, two up to 9, three up to 11, four beyond (two swaps).
EDITS = "CASE WHEN {n} <= 3 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 9 THEN 2 WHEN {n} <= 11 THEN 3 ELSE 4 END"
WORDS = r"array_remove(split(lower({x}), '[^\\pL\\pN]+'), '')"
MAX_EDITS = 4

MAPPED = rf"""
WITH entry AS (SELECT id, explode(concat(array(name), coalesce(aliases, array()))) AS form FROM {{reference}} WHERE id IS NOT NULL),
     form_words AS (SELECT id, {WORDS.format(x="form")} AS w FROM entry WHERE form IS NOT NULL),
     forms AS (SELECT DISTINCT id, array_join(w, '') AS joined, array_remove(w, 'and') AS w FROM form_words WHERE size(w) > 0),
     value_words AS (SELECT v, contains(v, '.') AS short, {WORDS.format(x="v")} AS w FROM (SELECT DISTINCT v FROM {{found}} WHERE v IS NOT NULL)),
     several AS (
       SELECT v, short, explode(CASE WHEN size(w) > 1 THEN array(struct(0 AS dropped, w AS w), struct(1 AS dropped, slice(w, 2, size(w) - 1) AS w), struct(1 AS dropped, slice(w, 1, size(w) - 1) AS w))
                                     ELSE array(struct(0 AS dropped, w AS w)) END) AS r
       FROM value_words WHERE size(w) > 0),
     readings AS (SELECT v, short, r.dropped AS dropped, array_join(r.w, '') AS joined, array_remove(r.w, 'and') AS w FROM several),

     form_keys AS (SELECT id, joined AS k FROM forms UNION SELECT id, array_join(array_sort(w), ' ') FROM forms),
     value_keys AS (SELECT v, dropped, joined AS k FROM readings UNION ALL SELECT v, dropped, array_join(array_sort(w), ' ') FROM readings),
     exact AS (SELECT v, 1 AS step, dropped, id FROM value_keys JOIN form_keys USING (k)),

     short_forms AS (SELECT id, size(w) AS words, array_join(w, ' ') AS text FROM forms),
     short_values AS (SELECT v, dropped, size(w) AS words, array_join(w, ' ') AS text, concat('^', array_join(w, '[^ ]* '), '[^ ]*$') AS begins FROM readings WHERE short AND size(w) > 0),
     short AS (
       SELECT v, 2 AS step, dropped, id
       FROM short_values r JOIN short_forms f ON r.words = f.words AND regexp_replace(r.text, '([^ ])[^ ]*', '$1') = regexp_replace(f.text, '([^ ])[^ ]*', '$1')
       WHERE f.text RLIKE r.begins),
     sure AS (SELECT v, min(struct(step, dropped, id)).id AS id FROM (SELECT * FROM exact UNION ALL SELECT * FROM short) GROUP BY v),

     sized AS (SELECT id, form, length(form) AS n, {EDITS.format(n="length(form)")} AS k FROM (SELECT id, joined AS form FROM forms UNION SELECT id, array_join(reverse(w), '') FROM forms)),
     segment AS (
       SELECT id, form, n, k, i, substring(form, CAST(floor(i * n / (k + 1)) AS INT) + 1, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT)) AS piece
       FROM (SELECT *, explode(sequence(0, k)) AS i FROM sized WHERE k > 0)),
     open_values AS (SELECT r.v, r.dropped, r.joined, length(r.joined) AS m FROM readings r LEFT ANTI JOIN sure ON r.v = sure.v),
     lengths AS (SELECT v, dropped, joined, m, n, k FROM (SELECT *, explode(sequence(m - {MAX_EDITS}, m + {MAX_EDITS})) AS n FROM open_values) JOIN (SELECT DISTINCT n, k FROM segment) USING (n)),
     places AS (SELECT *, CAST(floor(i * n / (k + 1)) AS INT) AS at, CAST(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) AS INT) AS wide
                FROM (SELECT *, explode(sequence(0, k)) AS i FROM lengths WHERE abs(m - n) <= k)),
     pieces AS (SELECT v, dropped, joined, n, i, substring(joined, at + move + 1, wide) AS piece
                FROM (SELECT *, explode(sequence(-k, k)) AS move FROM places) WHERE at + move >= 0 AND at + move + wide <= m),
     pairs AS (SELECT DISTINCT v, dropped, joined, id, form, s.k AS k FROM pieces p JOIN segment s ON p.n = s.n AND p.i = s.i AND p.piece = s.piece),
     near AS (SELECT v, dropped, id, length(form) AS n, levenshtein(joined, form, k) AS d FROM pairs),
     fuzzy AS (SELECT v, min(struct(d + dropped, -n, id)).id AS id FROM near WHERE d >= 0 AND d + dropped <= {MAX_EDITS} AND (dropped = 0 OR d <= n DIV 8) GROUP BY v)
SELECT v, id FROM sure UNION ALL SELECT v, id FROM fuzzy
"""


def mapped(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Each distinct ``v`` of ``values`` that means an entry of ``reference`` (id, name, aliases), with its ``id``.

    Ties go to the fewest edits, then the longest form, then the smallest id. Null and blank values mean nothing; an empty
    list maps nothing. The list is joined like any
    table, as Spark's size check decides.
    """
    return values.sparkSession.sql(MAPPED, found=values, reference=reference)


def unmatched(values: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct values that mean no entry; blank ones (white space of any kind) are no values."""
    return values.sparkSession.sql(r"SELECT DISTINCT a.v FROM {a} a LEFT ANTI JOIN (SELECT v AS known FROM {m}) ON a.v = known WHERE a.v RLIKE '[^\\s\\pZ]'", a=values, m=matched)
