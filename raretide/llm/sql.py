"""DuckDB SQL of the operators that SQL can express, generated from the same fixed values."""

from __future__ import annotations

from raretide.llm import licenses, quality

EXACT_DEDUP_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source),
p AS (SELECT lang, source, term, cells.n, 1 + (1000000000 * (cells.n + 2)::HUGEINT) // (s.total + 2 * v.kept) AS p,
  1 + (1000000000 * (lang_n + 2)::HUGEINT) // (v.total + 2 * v.kept) AS q FROM cells JOIN s USING (lang, source) JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN list_transform(range(least(len(w), 1)), lambda i: array_to_string(w, ' '))
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d),
named AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN sha256(array_to_string(g, chr(10))) END AS k, g FROM s),
sets AS (SELECT k, min(doc_id) AS least, any_value(n) AS n, any_value(g) AS g FROM named WHERE k IS NOT NULL GROUP BY k),
rows AS (SELECT k, n, unnest(g) AS x FROM sets),
links AS (SELECT a.k AS a, b.k AS b FROM rows a JOIN rows b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k AS a, k AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
ends AS (SELECT reach.a AS k, min(least) AS component_id FROM reach JOIN sets ON sets.k = reach.b GROUP BY reach.a)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM named LEFT JOIN ends USING (k)
"""

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _distance(letter: str, bins: int, total: str) -> str:
    def term(x):
        return f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) WHEN {x} IS NOT NULL THEN 0.0 END)"

    parts = []
    for i in range(bins):
        p, q = f"(s.{letter}{i} / nullif(s.{total}, 0))", f"(r.{letter}{i} / nullif(r.{total}, 0))"
        parts.append(f"{term(p)} + {term(q)} - 2 * {term(f'(({p} + {q}) / 2)')}")
    return f"sqrt(greatest(0.0, ({' + '.join(parts)}) / 2))"


def quality_sql() -> str:
    classes = list(quality.CHARACTER_CLASSES.values())
    lists = quality.COMMON_WORDS
    n = len(next(iter(lists.values())))
    class_counts = [f"len(regexp_extract_all(t, {_quoted(p)})) AS c{i}" for i, p in enumerate(classes)]
    guesses = "greatest(" + ", ".join(
        f"{{'n': len(list_filter(w, lambda x: list_contains({common!r}, x))), 'name': '{name}'}}" for name, common in lists.items()) + ").name"
    word_counts = [
        f"len(list_filter(w, lambda x: x = CASE ref " + " ".join(f"WHEN '{name}' THEN {_quoted(common[k])}" for name, common in lists.items()) + f" END)) AS w{k}"
        for k in range(n)]
    k = len(classes)
    bins = [f"c{i}" for i in range(k + 2)] + [f"w{i}" for i in range(n + 1)]
    failed = f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_SHARE} * n_words)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
windows AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i,
  unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k FROM words),
repeats AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY rid),
guessed AS (SELECT *, CASE WHEN lang IN ({", ".join(map(_quoted, lists))}) THEN lang ELSE {guesses} END AS ref FROM words),
counted AS (SELECT rid, doc_id, ref, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS chars,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, {", ".join(class_counts)}, {", ".join(word_counts)} FROM guessed),
s AS (SELECT counted.*, coalesce(covered.n, 0) AS n_repeat_words, chars - word_chars AS c{k},
  word_chars - {" - ".join(f"c{i}" for i in range(k))} AS c{k + 1},
  n_words - {" - ".join(f"w{i}" for i in range(n))} AS w{n} FROM counted LEFT JOIN covered USING (rid)),
r AS (SELECT ref, {", ".join(f"sum({b}) AS {b}" for b in [*bins, "chars", "n_words"])} FROM s WHERE NOT {failed} GROUP BY ref),
v AS (SELECT s.*, {failed.replace("n_", "s.n_")} AS base_failed, {_distance("c", k + 2, "chars")} AS char_distance,
  {_distance("w", n + 1, "n_words")} AS word_distance FROM s LEFT JOIN r USING (ref))
SELECT doc_id, n_words, word_chars, c{list(quality.CHARACTER_CLASSES).index("symbol")} AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((chars >= {quality.MIN_CHARS} AND char_distance > {quality.MAX_CHAR_DISTANCE})
    OR (n_words >= {quality.MIN_COMMON_WORDS_TEXT} AND word_distance > {quality.MAX_WORD_DISTANCE}), false) AS kept
FROM v
"""


def license_sql() -> str:
    words = r"regexp_extract_all(lower({}), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)}, {_quoted(t)})" for (a, b), t in licenses.TEMPLATES.items())
    dice = "2.0 * len(list_intersect({0}, t.b)) / (len({0}) + len(t.b))"
    return f"""
WITH templates AS (SELECT license, wording, len(w) AS words, list_distinct({pairs.format("w")}) AS b
  FROM (SELECT *, {words.format("text")} AS w FROM (VALUES {rows}) AS v(license, wording, text))),
cut AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS lines, {words.format("text")} AS w
  FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS u FROM cut
  UNION ALL SELECT doc_id, -1, text FROM cut WHERE len(lines) > 1),
grams AS (SELECT doc_id, line, list_distinct({pairs.format("w")}) AS b FROM (SELECT doc_id, line, {words.format("u")} AS w FROM units)),
held AS (SELECT rid, doc_id, lines, {pairs.format("w")} AS pairs FROM cut),
places AS (SELECT rid, unnest(range(1, len(pairs) + 1)) AS p, unnest(pairs) AS bigram FROM held),
starts AS (SELECT rid, license, wording, p FROM places JOIN (SELECT license, wording, unnest(b) AS bigram FROM templates) USING (bigram)),
line_of AS (SELECT rid, flatten(list_transform(range(0, len(lines)),
  lambda i: list_transform({words.format("lines[i + 1]")}, lambda x: i))) AS line_no FROM held WHERE rid IN (SELECT rid FROM starts)),
windows AS (SELECT doc_id, line_no[p] AS line, license, wording, list_distinct(pairs[p:p + t.words - 2]) AS b
  FROM starts JOIN templates t USING (license, wording) JOIN held USING (rid) JOIN line_of USING (rid)),
scored AS (
  SELECT doc_id, line, license, wording, {dice.format("g.b")} AS dice FROM grams g, templates t WHERE len(g.b) > 0
  UNION ALL SELECT doc_id, line, license, wording, {dice.format("g.b")} FROM windows g JOIN templates t USING (license, wording)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, wording, line) AS k
  FROM scored WHERE dice >= {licenses.SIMILARITY})
SELECT doc_id, license, wording, round(dice, 6) AS dice, line::INT AS line FROM ranked WHERE k = 1
"""


QUALITY_SQL, LICENSE_SQL = quality_sql(), license_sql()
