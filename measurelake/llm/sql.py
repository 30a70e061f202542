"""SQL equivalents of the queries that SQL can express."""

from __future__ import annotations

from measurelake.llm import licenses, mixing

_SQL: dict[str, str] = {}


def all_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL["op9_warc_index"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), c AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN c USING (payload_digest)
"""

_SQL["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _license_sql() -> str:
    known = licenses.known_sentences()
    names = ", ".join(f"'{said}': '{name}'" for said, name in known.items())
    # Without a look behind: a word of negation before a sentence is taken with it, and then both dropped.
    negated = "|".join(sorted(licenses.NEGATED, key=len, reverse=True))
    said = "|".join(sorted(known, key=lambda k: (-len(k), k)))
    longer = f" {' '.join(licenses.MORE_RULES[1][1])} "
    met = ", ".join(
        f"CASE WHEN contains({f"replace(seq, '{longer}', ' ')" if name == 'BSD-2-Clause' else 'seq'}, "
        f"' {' '.join(rule)} ') THEN '{name}' END" for name, rule in (*licenses.RULES, *licenses.MORE_RULES))
    return f"""
WITH s AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'licen|permi|distribut|softw') THEN
    regexp_replace(regexp_replace(lower(text), '{licenses.REMARK.replace("(?=[ \\t])", "[ \\t]")}', ' ', 'g'), '{licenses.OTHER}', ' ', 'g')
    ELSE '' END AS normal FROM documents
), f AS (
  SELECT doc_id, list_filter(regexp_extract_all(normal, '(?:(?:{negated}) )?\\b(?:{said})\\b'),
    lambda x: NOT regexp_matches(x, '^(?:{negated}) ')) AS said FROM s
), q AS (
  SELECT doc_id, list_transform(said, lambda x: MAP {{{names}}}[x]) AS ids FROM f
), m AS (
  SELECT *, ' ' || coalesce(array_to_string(ids, ' '), '') || ' ' AS seq FROM q
), l AS (SELECT *, list_filter([{met}], lambda x: x IS NOT NULL) AS met FROM m)
SELECT doc_id, len(ids) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
  coalesce(array_to_string(list_filter(met, lambda x, n: list_position(met, x) = n), ','), '') AS licenses
FROM l
"""


_SQL["op6_license_scan"] = _license_sql()


def mixing_sql(documents: str, sweeps: int = mixing.SWEEPS, exact: bool = False) -> tuple[str, str]:
    """Tables of a WITH clause that end in ``mixed``, and the columns of :func:`mixing.mixture`."""
    rate = "(SELECT rate FROM mix_rate)"
    listed = "MAP {" + ", ".join(f"'{c}': {s}" for c, s in mixing.TARGETS["lang"].items()) + "}"
    tables = [f"""
mix_words AS (
  SELECT *, coalesce(source, '(none)') AS m_source, coalesce(lang, '(none)') AS m_lang,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS m_tokens
  FROM {documents}
)""", """
mix_docs AS (
  SELECT *, CASE WHEN m_tokens < 200 THEN 'brief' WHEN m_tokens < 1000 THEN 'middle' ELSE 'long' END
    AS m_topic FROM mix_words
)""", """
mix_cells AS (
  SELECT m_source, m_lang, m_topic, CAST(sum(m_tokens) AS DOUBLE) AS tokens
  FROM mix_docs GROUP BY ALL HAVING sum(m_tokens) > 0
)""", f"""
mix_langs AS (
  SELECT m_lang, sum(tokens) AS mass, {listed}[m_lang] AS asked FROM mix_cells GROUP BY 1
)""", """
mix_lang_targets AS (
  SELECT m_lang, CASE WHEN asked IS NULL THEN mass / sum(mass) OVER ()
    ELSE asked * (1.0 - sum(CASE WHEN asked IS NULL THEN mass ELSE 0.0 END) OVER () / sum(mass) OVER ())
      / sum(asked) OVER () END AS t_lang FROM mix_langs
)""", """
mix_0 AS (
  SELECT c.*, tokens AS share, t_lang,
    1.0::DOUBLE / (SELECT count(DISTINCT m_source) FROM mix_cells) AS t_source,
    1.0::DOUBLE / (SELECT count(DISTINCT m_topic) FROM mix_cells) AS t_topic
  FROM mix_cells c JOIN mix_lang_targets USING (m_lang)
)"""]
    number = 0
    if exact:
        able = ", ".join(f"sum(tokens) OVER (PARTITION BY m_{d}) / (total * t_{d})" for d in mixing.DIMENSIONS)
        tables += [f"""
mix_able AS MATERIALIZED (SELECT *, least({able}) AS able FROM (SELECT *, sum(tokens) OVER () AS total FROM mix_0))
""", f"""
mix_bound AS MATERIALIZED (
  SELECT * EXCLUDE (able), tokens / least({mixing.RATE}, {mixing.SLACK} * min(able) OVER ()) AS most FROM mix_able
)"""]
        sweeps = mixing.BOUNDED_SWEEPS + mixing.LAST_SWEEPS
    before = "mix_bound" if exact else "mix_0"
    for sweep in range(sweeps):
        if exact and 0 < sweep < mixing.BOUNDED_SWEEPS:
            tables.append(f"""
mix_{number + 1} AS MATERIALIZED (SELECT * REPLACE (least(share, most / total) AS share) FROM {before})""")
            number += 1
            before = f"mix_{number}"
        for dim in mixing.DIMENSIONS:
            tables.append(f"""
mix_{number + 1} AS MATERIALIZED (
  SELECT * REPLACE (share * t_{dim} / sum(share) OVER (PARTITION BY m_{dim}) AS share) FROM {before}
)""")
            number += 1
            before = f"mix_{number}"
    tables.append(f"""
mix_rates AS (
  SELECT m_source, m_lang, m_topic, share * sum(tokens) OVER () / tokens AS m_weight FROM mix_{number}
)""")
    least_rate = f"least({mixing.RATE}, 1.0 / max(m_weight))" if exact else mixing.RATE
    tables.append(f"""
mix_rate AS (SELECT {least_rate} AS rate {"FROM mix_rates" if exact else ""})""")
    named = "coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))"
    tables.append(f"""
mixed AS (
  SELECT d.*, m_weight, least(1.0, {rate} * m_weight) AS m_probability,
    m_tokens = 0 OR CAST(('0x' || substr(md5({named}), 1, 8)) AS UBIGINT)
      / 4294967296.0 < least(1.0, {rate} * m_weight) AS m_kept
  FROM mix_docs d LEFT JOIN mix_rates USING (m_source, m_lang, m_topic)
)""")
    columns = """doc_id, m_source AS source, m_lang AS lang, m_topic AS topic, m_tokens AS n_tokens,
  round(m_weight, 6) AS weight, round(m_probability, 6) AS probability, m_kept AS kept"""
    return ", ".join(tables), columns


def _mix_query(exact: bool) -> str:
    tables, columns = mixing_sql("documents", exact=exact)
    return f"WITH {tables} SELECT {columns} FROM mixed"


_SQL["op10_source_mix"] = _mix_query(exact=False)
_SQL["op10_target_mix"] = _mix_query(exact=True)


def line_sql(documents: str) -> str:
    """Tables of a WITH RECURSIVE clause that end in ``line_told``, the rows of line_classes."""
    return f"""
line_all AS (
  SELECT doc_id, CAST(no - 1 AS INTEGER) AS line_no, trim(line, ' \t\r') AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS no FROM {documents}
  ) WHERE length(trim(line, ' \t\r')) > 0
), line_texts AS MATERIALIZED (
  SELECT line, length(line) AS size, row_number() OVER () AS id FROM (SELECT DISTINCT line FROM line_all)
), line_links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM line_texts a JOIN line_texts b
    ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.id <> b.id
  WHERE levenshtein(a.line, b.line) <= least(2, least(a.size, b.size) // 6)
), line_reach AS (
  SELECT a, b FROM line_links
  UNION SELECT r.a, l.b FROM line_reach r JOIN line_links l ON r.b = l.a
), line_class AS (
  SELECT t.id, t.line, least(t.id, coalesce(min(r.b), t.id)) AS class,
    (SELECT count(*) FROM line_links l WHERE l.a = t.id) AS n_links
  FROM line_texts t LEFT JOIN line_reach r ON r.a = t.id GROUP BY 1, 2
), line_told AS (
  SELECT doc_id, line_no, n_links,
    first_value(doc_id) OVER w AS class_doc, first_value(line_no) OVER w AS class_line,
    row_number() OVER w = 1 AS kept
  FROM line_all JOIN line_class USING (line)
  WINDOW w AS (PARTITION BY class ORDER BY doc_id, line_no)
)"""


_SQL["op1_line_dedup"] = f"WITH RECURSIVE {line_sql('documents')} SELECT * FROM line_told"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL["op11_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))
    END AS shingles FROM w
), e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM s
"""

_SQL["op13_collocations"] = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS number, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p
), t AS (SELECT lang, number, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM w),
g AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM t WINDOW o AS (PARTITION BY number ORDER BY place)
), f AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM g GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL
    GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL
    GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL
    GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j.cut, x.a AS l, y.a AS r,
    CAST(c.a AS HUGEINT) * 2000000 // (x.a + y.a) AS score
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS cut) j ON j.cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:j.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[j.cut + 1:], ' ')
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM cuts
), parts AS (
  SELECT c.lang, array_to_string(c.words[s.i:s.i + t.m - 1], ' ') AS phrase, c.a
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS i) s ON true JOIN (SELECT unnest([2, 3]) AS m) t
    ON t.m < c.k AND s.i + t.m - 1 <= c.k
), longest AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longest m ON m.lang = w.lang AND m.phrase = w.phrase
  WHERE w.place = 1 AND (m.longer IS NULL OR 100 * CAST(m.longer AS HUGEINT) < 80 * CAST(w.a AS HUGEINT))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def merkle_sql(levels: int = 16) -> str:
    """Proofs of trees of up to 3 ** ``levels`` leaves, and as many sources."""
    def told(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    no_feeds = "replace(text, chr(10), '')"
    crc = """xor(4294967295, list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_concat([CAST(ord(c) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
    tables = [f"""
d AS MATERIALIZED (
  SELECT doc_id, source, {leaf('text')} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {leaf(no_feeds)} END AS claim FROM documents
)""", """
s0 AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
)""", """
t0 AS MATERIALIZED (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM s0)"""]

    def climb(tree: str, group: str) -> None:
        for level in range(levels):
            tables.append(f"""
{tree}{level + 1} AS MATERIALIZED (
  SELECT {group} AS g, i // 3 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
    (n + 2) // 3 AS n FROM {tree}{level} GROUP BY {group}, i // 3, n
)""")

    def walk(tree: str, path: str) -> None:
        for level in range(levels):
            tables.append(f"""
{tree}_run{level} AS (SELECT g, i // 3 AS run, n, list(h ORDER BY i) AS hs FROM {tree}{level} GROUP BY g, i // 3, n)""")
            tables.append(f"""
{path}{level + 1} AS MATERIALIZED (
  SELECT p.* REPLACE (
    CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string(
      list_concat(list_concat(hs[1:p.i % 3], [folded]), hs[p.i % 3 + 2:]), '')) END AS folded,
    CASE WHEN n = 1 THEN proof ELSE proof || coalesce(array_to_string(
      list_concat(hs[1:p.i % 3], hs[p.i % 3 + 2:]), ''), '') END AS proof,
    p.i // 3 AS i)
  FROM {path}{level} p JOIN {tree}_run{level} r ON r.g = p.g AND r.run = p.i // 3
)""")

    climb("t", "g")
    tables.append(f"""
u0 AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t{levels})""")
    climb("u", "g")
    tables.append("""
p0 AS (SELECT doc_id, leaf, g, i, coalesce(claim, leaf) AS folded, '' AS proof FROM s0)""")
    walk("t", "p")
    tables.append(f"""
q0 AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, t.h AS subroot, 0 AS g, p.g AS i, p.folded, p.proof FROM p{levels} p JOIN t{levels} t ON t.g = p.g
)""")
    walk("u", "q")
    return f"""WITH {",".join(tables)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM q{levels}, (SELECT h FROM u{levels})"""


_SQL["op12_merkle_manifest"] = merkle_sql()
