"""SQL of the queries that SQL can express."""

from __future__ import annotations

from logfold.llm import rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _bucket(x: str) -> str:
    shift = f"greatest(length(bin({x})) - 6, 0)"
    return f"(({x}) >> {shift}) << {shift}"


def rules_sql() -> str:
    values = {
        "letters_per_word": "word_chars * 100 // greatest(n_words, 1)",
        "symbols_per_mille": "n_symbols * 1000 // greatest(n_words, 1)",
        "upper_per_mille": "n_upper * 1000 // greatest(word_chars, 1)",
        "dup_lines_per_mille": "n_dup_lines * 1000 // greatest(n_lines, 1)",
        "repeats_per_mille": "n_repeat_words * 1000 // greatest(n_words, 1)",
    }
    slack = " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in rules.MEASURES.items())
    below = " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in rules.MEASURES.items() if v[1] is not None)
    some = ", ".join(f"'{k}'" for k in rules.SOME)
    long = " UNION ALL ".join(f"SELECT rid, lang, source, '{k}' AS name, CAST({v} AS BIGINT) AS x, base_failed FROM m" for k, v in values.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                  coalesce(source, '') AS source, {_WORDS} AS w FROM documents),
p AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
t AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM p
      WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM t WHERE gram IS NOT NULL) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS j FROM again) GROUP BY rid),
l AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS dups
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             coalesce(l.dups, 0) AS n_dup_lines, coalesce(l.lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r ON r.rid = d.rid LEFT JOIN l ON l.rid = d.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS ({long}),
s AS (SELECT lv, CASE WHEN lv < 2 THEN lang ELSE '' END AS lang, CASE WHEN lv < 1 THEN source ELSE '' END AS source, name, bin_, count(*) AS n
      FROM (SELECT lang, source, name, {_bucket("x")} AS bin_, unnest([0, 1, 2]) AS lv FROM v WHERE NOT base_failed AND (x > 0 OR name NOT IN ({some}))) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, name ORDER BY bin_) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, name) AS docs FROM s),
q AS (SELECT lv, lang, source, name, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bin_ END) AS q1,
             min(CASE WHEN upto * 4 >= docs * 3 THEN bin_ END) AS q3 FROM u GROUP BY ALL),
f AS (SELECT lv, lang, source, name, docs, q1 - {rules.SPREAD} * (q3 - q1) - CASE name {below} END AS low,
             q3 + {rules.SPREAD} * (q3 - q1) + CASE name {slack} END AS high FROM q),
j AS (SELECT v.rid, v.x, CASE WHEN f0.docs >= {rules.MIN_GROUP} THEN f0.low WHEN f1.docs >= {rules.MIN_GROUP} THEN f1.low ELSE f2.low END AS low,
             CASE WHEN f0.docs >= {rules.MIN_GROUP} THEN f0.high WHEN f1.docs >= {rules.MIN_GROUP} THEN f1.high ELSE f2.high END AS high,
             CASE WHEN f0.docs >= {rules.MIN_GROUP} THEN 0 WHEN f1.docs >= {rules.MIN_GROUP} THEN 1 ELSE 2 END AS level
      FROM v LEFT JOIN f f0 ON f0.lv = 0 AND f0.lang = v.lang AND f0.source = v.source AND f0.name = v.name
             LEFT JOIN f f1 ON f1.lv = 1 AND f1.lang = v.lang AND f1.name = v.name
             LEFT JOIN f f2 ON f2.lv = 2 AND f2.name = v.name),
k AS (SELECT rid, bool_and(coalesce(x >= low, true) AND coalesce(x <= high, true)) AS ok, max(level) AS level FROM j GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_upper AS BIGINT) AS n_upper, base_failed, NOT base_failed AND ok AS kept, CAST(level AS INTEGER) AS level
FROM m JOIN k USING (rid)"""


#: conv_id % 100 of 64-bit ids; crc32 is spelled out over the decimal digits.
TRIE_SQL = """
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                  CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'k': k, 'chars': chars} ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS s FROM h LEFT JOIN l b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(s) AS n, d, list_transform(s[1:d], lambda x: x.k) AS node, CASE WHEN d > 0 THEN s[d].chars ELSE 0 END AS chars
      FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r)),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY node, d),
c AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (node, d)),
u AS (SELECT node[1:a] AS node, a AS d, CAST(sum((n_children = 0)::INT) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved
      FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, u.saved AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN u USING (node, d) LEFT JOIN g q ON v.d > 0 AND q.d = v.d - 1 AND q.node = v.node[1:v.d - 1]"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
b AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, s.n),
m AS (SELECT row, doc_id, 25 + (75 * len(w) * s.n) // s.l AS m FROM d, s),
x AS (SELECT item_id, row, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM t JOIN q USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score
      FROM x JOIN m USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""


ORACLES = {"op1_quality_rules": rules_sql(), "op11_prefix_trie": TRIE_SQL, "op12_length_strata": SEARCH_SQL}
