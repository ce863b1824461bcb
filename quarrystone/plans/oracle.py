"""SQL of the catalog's queries, for DuckDB over the same tables. Queries that SQL can't express, or only far too slowly
over whole tables, have none here and are tested on fixtures."""

from __future__ import annotations

from quarrystone.functions.text import ABBREVIATIONS, SPACE, STOP_WORDS, TERM, WORD

_W = WORD.replace("'", "''")
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_ROOT = "(SELECT DISTINCT doc_id, pos, type, text, source_name, source_url, page, heading_path, table_id, caption, headers, rows FROM blocks)"
DIMS = 64


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{_W}')"


def gaps(x: str) -> str:
    return f"regexp_split_to_array({x}, '{_W}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def keyword_tokens(x: str) -> str:
    return f"list_filter({words(fold(x))}, lambda t: NOT list_contains({_STOP}, t))"


def lexical_terms(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{TERM}')), lambda t: NOT list_contains({_STOP}, t))"


def filled(x: str) -> str:
    return f"CASE WHEN trim({x}) <> '' THEN {x} END"


def row_text(row: str, heads: str) -> str:
    cells = f"list_filter(list_transform(range(1, least(len({row}), len({heads})) + 1), lambda i: CASE WHEN {clean(f'{row}[i]')} <> '' THEN {heads}[i] || ' = ' || {clean(f'{row}[i]')} END), lambda t: t IS NOT NULL)"
    return f"(CASE WHEN len({cells}) = 0 THEN '' ELSE array_to_string({cells}, '; ') || '.' END)"


def lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(filled(p) for p in parts) + ")"


_PATH = "array_to_string(coalesce(heading_path, []), ' > ')"
_ROWS = f"array_to_string(list_filter(list_transform(rows, lambda r: {row_text('r', 'headers')}), lambda t: t <> ''), chr(10))"
_RENDERED = f"CASE WHEN type = 'table' THEN {lines(_PATH, 'caption', _ROWS)} ELSE {lines(_PATH, 'text')} END"
_SUFFIX = """concat_ws(', ', 'source ' || CASE WHEN trim(source_name) <> '' THEN source_name END, 'page ' || page,
    'table ' || CASE WHEN trim(table_id) <> '' THEN table_id END, 'rows ' || row_start || '-' || row_end)"""


def _marks(x: str) -> str:
    cut = "chr(1)"
    listed = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    opener = "(^|[\\s\\x01(\\[\"''“‘«])"
    out = f"regexp_replace(replace({x}, {cut}, ' '), '([.!?][\"''”’»)\\]]*)\\s+', '\\1' || {cut}, 'g')"
    out = f"regexp_replace({out}, '(?i){opener}({listed})\\.\\x01', '\\1\\2. ', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{opener}(\\p{{Lu}})\\.\\x01(\\p{{Lu}})', '\\1\\2. \\3', 'g')"
    out = f"regexp_replace({out}, '([0-9])\\.\\x01(\\p{{Ll}})', '\\1. \\2', 'g')"
    return f"regexp_replace({out}, '\\.\\.\\x01', '.. ', 'g')"


_UNIT = "(SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS vec FROM embeddings)"


def _neighbours(k: int) -> str:
    return f"""u AS MATERIALIZED {_UNIT},
    s AS (SELECT a.id AS src, b.id AS dst, round(list_inner_product(a.vec, b.vec), 6) AS score FROM u a JOIN u b ON a.id <> b.id),
    n AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s) WHERE rank <= {k})"""


def _pagerank(rounds: int = 64) -> str:
    """p: the ranks (id, r) of the first round whose change is below a millionth of the number of nodes."""
    parts = [f"{_neighbours(3)}, g AS MATERIALIZED (SELECT DISTINCT src, dst FROM n), c AS (SELECT count(*)::DOUBLE AS c FROM u), d AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS d FROM g GROUP BY src), r0 AS MATERIALIZED (SELECT id, 1 / c AS r FROM u, c)"]
    for i in range(rounds):
        parts.append(
            f"""x{i} AS (SELECT dst AS id, sum(r / d) AS got FROM g JOIN r{i} ON r{i}.id = g.src JOIN d ON d.src = g.src GROUP BY dst),
            l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM d)),
            r{i + 1} AS MATERIALIZED (SELECT u.id, 0.85 * coalesce(got, 0) + 0.85 * lost / c + 0.15 / c AS r FROM u LEFT JOIN x{i} ON x{i}.id = u.id, c, l{i})"""
        )
    every = " UNION ALL ".join(f"SELECT {i} AS k, r{i}.id, r{i}.r, abs(r{i}.r - r{i - 1}.r) AS moved FROM r{i} JOIN r{i - 1} ON r{i}.id = r{i - 1}.id" for i in range(1, rounds + 1))
    parts.append(f"""h AS MATERIALIZED ({every}), w AS (SELECT min(k) AS k FROM (SELECT k FROM h, c GROUP BY k, c HAVING sum(moved) < 1e-6 * c)),
        p AS MATERIALIZED (SELECT id, r FROM h WHERE k = (SELECT k FROM w))""")
    return ", ".join(parts)


def _hashed(table: str, key: str) -> str:
    """(id, b, v): the parts of hashed vectors that aren't zero, normalised."""
    return f"""t AS (SELECT {key} AS id, unnest({words("lower(text)")}) AS w FROM {table}),
    h AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM t),
    p AS (SELECT id, h % {DIMS} AS b, sum(CASE WHEN (h // {DIMS}) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM h GROUP BY id, b),
    l AS (SELECT id, greatest(sqrt(sum(v * v)), 1e-12) AS l FROM p GROUP BY id),
    e AS MATERIALIZED (SELECT p.id, b, v / l AS v FROM p JOIN l ON p.id = l.id)"""


def _retrieval(question: str, vocabulary: str, more: str = "") -> str:
    """Scores of entities, relations, subchunks and keywords for the question, then seeds and ranked relations."""
    fact = """coalesce(source, '') || ' --[' || coalesce(CASE WHEN trim(relation) <> '' THEN trim(relation) END, 'related to') || ']--> '
        || coalesce(target, '') || CASE WHEN trim(coalesce(description, '')) <> '' THEN '. ' || trim(description) ELSE '' END"""
    return f"""en AS MATERIALIZED (SELECT DISTINCT * FROM entities), re AS MATERIALIZED (SELECT DISTINCT * FROM relations),
    su AS MATERIALIZED (SELECT DISTINCT id, parent_id, text FROM subchunks), vo AS MATERIALIZED (SELECT * FROM {vocabulary}),
    d0 AS (SELECT entity_id, unnest(descriptions) AS d, generate_subscripts(descriptions, 1) AS i FROM en),
    d1 AS (SELECT entity_id, d, min(i) AS i FROM d0 GROUP BY ALL), d2 AS (SELECT entity_id, string_agg(d, ' ' ORDER BY i) AS d FROM d1 GROUP BY entity_id),
    src AS (SELECT 'e' || en.entity_id AS id, name || ': ' || coalesce(d2.d, '') AS text FROM en LEFT JOIN d2 ON en.entity_id = d2.entity_id
      UNION ALL SELECT 'r' || relation_id, {fact} FROM re UNION ALL SELECT 's' || id, text FROM su UNION ALL SELECT 'k' || keyword_id, keyword FROM vo
      UNION ALL SELECT 'q', '{question}'{more}), {_hashed('src', 'id')},
    q AS (SELECT b, v FROM e WHERE id = 'q'),
    sc AS MATERIALIZED (SELECT src.id, round(coalesce(x.s, 0), 6) AS score FROM src LEFT JOIN (SELECT e.id, sum(e.v * q.v) AS s FROM e JOIN q ON e.b = q.b GROUP BY e.id) x ON x.id = src.id),
    seeds AS MATERIALIZED (SELECT en.*, score FROM en JOIN sc ON sc.id = 'e' || entity_id ORDER BY score DESC, entity_id LIMIT 10),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY matched DESC, score DESC, relation_id) AS rank FROM
      (SELECT re.*, (coalesce({fold('source')} IN (SELECT key FROM seeds), false))::BIGINT + (coalesce({fold('target')} IN (SELECT key FROM seeds), false))::BIGINT AS matched, score
       FROM re JOIN sc ON sc.id = 'r' || relation_id) WHERE matched > 0)"""


def oracle_sql() -> dict[str, str]:
    from quarrystone.plans.catalog import QUESTION

    question = QUESTION.replace("'", "''")
    chunk_windows = f"""
    WITH d AS (SELECT doc_id, {words('text')} AS w, {gaps('text')} AS g FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 450 THEN 1 ELSE ceil((len(w) - 450) / 390.0)::INT + 1 END)) AS n FROM d)
    SELECT doc_id, n AS chunk_no, array_to_string(w[n * 390 + 1 : n * 390 + 450], ' ') AS text,
      {strip("array_to_string(list_transform(range(n * 390 + 1, least(n * 390 + 450, len(w)) + 1), lambda i: w[i] || g[i + 1]), '')")} AS source_text FROM s"""
    runs = f"""
    WITH b AS (SELECT *, type = 'table' AS t, {_RENDERED} AS said,
        hash(coalesce(source_name, ''), coalesce(source_url, ''), coalesce(page, -1), coalesce(heading_path, [])) AS k FROM {_ROOT}),
    o AS (SELECT *, (lag(k) OVER w IS NULL OR t OR lag(t) OVER w OR lag(k) OVER w <> k)::INT AS o FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM o)
    SELECT doc_id, min(pos) AS run_pos, string_agg(said, chr(10) || chr(10) ORDER BY pos) AS source_text FROM r WHERE NOT t GROUP BY doc_id, r"""
    entity_terms = f"""x AS (SELECT DISTINCT entity_id AS id, array_to_string(descriptions, ' ') AS text FROM entities),
    t AS MATERIALIZED (SELECT id, unnest({lexical_terms('text')}) AS term FROM x)"""
    hybrid = f"""
    WITH x AS MATERIALIZED (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_hashed('x', 'id').replace('t AS (', 'z AS (', 1).replace('FROM t)', 'FROM z)', 1)},
    t AS MATERIALIZED (SELECT id, unnest({lexical_terms('text')}) AS term FROM x),
    c AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM t a JOIN t b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
    y AS (SELECT a.id AS src, b.id AS dst, sum(a.v * b.v) AS s FROM e a JOIN e b ON a.b = b.b AND a.id <> b.id GROUP BY ALL),
    o AS (SELECT a.id AS src, b.id AS dst FROM x a JOIN x b ON a.id <> b.id),
    i AS (SELECT o.src, o.dst, coalesce(c.n, 0) AS n FROM o LEFT JOIN c ON c.src = o.src AND c.dst = o.dst),
    m AS MATERIALIZED (SELECT src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM i) WHERE rank <= 3),
    s AS (SELECT o.src, o.dst, round(coalesce(y.s, 0), 6) AS score FROM o LEFT JOIN y ON y.src = o.src AND y.dst = o.dst),
    f AS (SELECT s.*, row_number() OVER (PARTITION BY s.src ORDER BY score DESC, s.dst) AS rank FROM s ANTI JOIN m ON s.src = m.src AND s.dst = m.dst)
    SELECT src, dst, 'lexical' AS channel, rank FROM m UNION ALL SELECT src, dst, 'semantic', rank + 3 FROM f WHERE rank <= 3"""
    vocabulary = f"""(SELECT row_number() OVER (ORDER BY keyword) - 1 AS keyword_id, keyword, df FROM
    (SELECT keyword, count(*) AS df FROM (SELECT id, unnest(list_distinct({keyword_tokens('text')})) AS keyword FROM (SELECT DISTINCT id, text FROM subchunks))
     GROUP BY keyword HAVING count(*) >= 2))"""
    graph_expanded = f"""
    WITH {_neighbours(4)}, q AS (SELECT vec FROM u WHERE id = 0), a AS (SELECT u.id, round(list_inner_product(u.vec, q.vec), 6) AS score FROM u, q),
    seeds AS (SELECT id FROM a ORDER BY score DESC, id LIMIT 4),
    cand AS (SELECT id FROM seeds UNION SELECT dst FROM n WHERE src IN (SELECT id FROM seeds))
    SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM a WHERE id IN (SELECT id FROM cand) ORDER BY score DESC, id LIMIT 8"""
    tau = f"""
    WITH c AS (SELECT DISTINCT id, {words('text')} AS w FROM chunks WHERE table_row_texts IS NULL AND text IS NOT NULL),
    p AS (SELECT id, w, unnest(range(0, 4)) AS part FROM c),
    b AS (SELECT *, round_even(part * len(w) / 4.0, 0)::INT AS f, round_even((part + 1) * len(w) / 4.0, 0)::INT AS t FROM p)
    SELECT id AS parent_id, part, array_to_string(w[f + 1 : t], ' ') AS text FROM b WHERE t > f"""
    chosen = f"""pa AS (SELECT chunk_id, count(*) AS n FROM (SELECT unnest(list_distinct(chunk_ids)) AS chunk_id FROM seeds UNION ALL SELECT chunk_id FROM ranked WHERE rank <= 12 AND chunk_id IS NOT NULL) GROUP BY chunk_id),
    sk AS MATERIALIZED (SELECT su.id, score, row_number() OVER (ORDER BY n DESC, score DESC, su.id) AS rank FROM su JOIN pa ON pa.chunk_id = su.parent_id JOIN sc ON sc.id = 's' || su.id ORDER BY rank LIMIT 4),
    po AS (SELECT keyword_id, keyword, row_number() OVER (ORDER BY score DESC, keyword_id) AS rank FROM vo JOIN sc ON sc.id = 'k' || keyword_id ORDER BY rank LIMIT 24),
    ke AS (SELECT id, unnest(list_distinct({keyword_tokens('text')})) AS keyword FROM su),
    fi AS MATERIALIZED (SELECT ke.id, min(rank) AS rank FROM ke JOIN po ON po.keyword = ke.keyword GROUP BY ke.id),
    ne AS (SELECT rank, count(*) AS n FROM fi GROUP BY rank),
    op AS (SELECT rank FROM (SELECT rank, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ne) WHERE b < 12),
    kw AS (SELECT fi.id, score, row_number() OVER (ORDER BY score DESC, fi.id) AS rank FROM fi JOIN sc ON sc.id = 's' || fi.id WHERE fi.rank IN (SELECT rank FROM op) AND fi.id NOT IN (SELECT id FROM sk) ORDER BY rank LIMIT 6)"""
    both = "(SELECT id, 'skeleton' AS channel, rank, score FROM sk UNION ALL SELECT id, 'keyword', rank + 4, score FROM kw)"
    channels = f"WITH {_retrieval(question, vocabulary)}, {chosen} SELECT * FROM {both}"
    label = f"""|| CASE WHEN {_SUFFIX} <> '' THEN ', ' || {_SUFFIX} ELSE '' END || ']' || chr(10) || coalesce(CASE WHEN trim(source_text) <> '' THEN source_text END, text)"""
    fact = """coalesce(source, '') || ' --[' || coalesce(CASE WHEN trim(relation) <> '' THEN trim(relation) END, 'related to') || ']--> '
        || coalesce(target, '') || CASE WHEN trim(coalesce(description, '')) <> '' THEN '. ' || trim(description) ELSE '' END"""
    sub = "(SELECT DISTINCT id, parent_id, text, source_text, source_name, source_url, page, table_id, row_start, row_end FROM subchunks)"
    facts = f"(SELECT string_agg('- ' || {fact}, chr(10) ORDER BY rank) AS facts FROM ranked WHERE rank <= 12)"
    told = f"""WITH {_retrieval(question, vocabulary)}, {chosen}, o AS (SELECT rank, '[chunk ' || parent_id || ', subchunk ' || s.id {label} AS entry FROM {sub} s JOIN {both} b ON b.id = s.id)
        SELECT 'Graph facts:' || chr(10) || facts || chr(10) || chr(10) || (SELECT string_agg(entry, chr(10) || chr(10) ORDER BY rank) FROM o) AS context FROM {facts}"""
    diagnosed = f"""WITH {_retrieval(question, vocabulary)}, {chosen}
        SELECT (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM sk) AS skeleton_ids, (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM kw) AS keyword_ids,
          (SELECT string_agg(s.id || ':' || coalesce(source_name, source_url), ',' ORDER BY s.id) FROM {sub} s JOIN {both} b ON b.id = s.id WHERE coalesce(source_name, source_url) IS NOT NULL) AS sources,
          (SELECT string_agg(entity_id::VARCHAR, ',' ORDER BY score DESC, entity_id) FROM seeds) AS seeds, facts FROM {facts}"""
    rendered = f"""WITH ch AS (SELECT DISTINCT id, text, source_text, source_name, page, table_id, row_start, row_end FROM chunks WHERE text IS NOT NULL),
        src AS (SELECT id, text FROM ch UNION ALL SELECT -1, '{question}'), {_hashed('src', 'id')}, q AS (SELECT b, v FROM e WHERE id = -1),
        x AS (SELECT e.id, sum(e.v * q.v) AS s FROM e JOIN q ON e.b = q.b GROUP BY e.id),
        o AS (SELECT '[chunk ' || ch.id {label} AS entry, row_number() OVER (ORDER BY round(coalesce(x.s, 0), 6) DESC, ch.id) AS rank FROM ch LEFT JOIN x ON x.id = ch.id)
        SELECT string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context FROM o WHERE rank <= 6"""
    more = " UNION ALL SELECT 'c' || id, text FROM (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL)"
    compared = f"""WITH {_retrieval(question, vocabulary, more)}, {chosen},
        tx AS MATERIALIZED (SELECT substr(id, 2)::BIGINT AS id, score, row_number() OVER (ORDER BY score DESC, substr(id, 2)::BIGINT) AS rank FROM sc WHERE id LIKE 'c%'),
        ce AS MATERIALIZED (SELECT substr(id, 2)::BIGINT AS id, b, v FROM e WHERE id LIKE 'c%'),
        cp AS (SELECT a.id AS src, b.id AS dst, sum(a.v * b.v) AS s FROM ce a JOIN ce b ON a.b = b.b AND a.id <> b.id GROUP BY ALL),
        cs AS (SELECT a.id AS src, b.id AS dst, round(coalesce(s, 0), 6) AS score FROM (SELECT id FROM tx WHERE rank <= 5) a JOIN tx b ON a.id <> b.id LEFT JOIN cp ON cp.src = a.id AND cp.dst = b.id),
        cn AS (SELECT dst FROM (SELECT dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM cs) WHERE r <= 4),
        gr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM tx WHERE rank <= 5 OR id IN (SELECT dst FROM cn))
        SELECT 'text' AS strategy, rank, id, score FROM tx WHERE rank <= 10 UNION ALL SELECT 'graph', rank, id, score FROM gr WHERE rank <= 10 UNION ALL SELECT 'two_channel', rank, id, score FROM {both}"""
    return {
        "relation_rank": f"WITH {_retrieval(question, vocabulary)} SELECT relation_id, source, target, relation, description, chunk_id, matched, score, rank FROM ranked WHERE rank <= 20",
        "two_channel_retrieve": channels,
        "two_channel_context": told,
        "two_channel_diagnostics": diagnosed,
        "context_render": rendered,
        "three_way_comparison": compared,
        "clean_documents": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "tokenize_stats": f"SELECT doc_id, len({words('text')}) AS n_words, len(list_distinct({words('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL",
        "keyword_token_counts": f"SELECT id, len({keyword_tokens('text')}) AS n_tokens FROM (SELECT DISTINCT id, text FROM subchunks) WHERE text IS NOT NULL",
        "lexical_term_counts": f"SELECT id, len({lexical_terms('text')}) AS n_terms FROM (SELECT DISTINCT id, text FROM subchunks) WHERE text IS NOT NULL",
        "sentence_stats": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({_marks('text')}, chr(1)), lambda s: {strip('s')}),
            lambda s: len({words('s')}) >= 3) AS s FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, len(s) AS n_sentences, array_to_string(s, '|') AS sentences FROM s""",
        "render_blocks": f"SELECT doc_id, pos, {_RENDERED} AS rendered FROM {_ROOT}",
        "relation_texts": """SELECT DISTINCT relation_id, coalesce(source, '') || ' --[' || coalesce(CASE WHEN trim(relation) <> '' THEN trim(relation) END, 'related to')
            || ']--> ' || coalesce(target, '') || CASE WHEN trim(coalesce(description, '')) <> '' THEN '. ' || trim(description) ELSE '' END AS fact FROM relations""",
        "entity_texts": """WITH e AS (SELECT DISTINCT * FROM entities), d AS (SELECT entity_id, name, unnest(descriptions) AS d, generate_subscripts(descriptions, 1) AS i FROM e),
            f AS (SELECT entity_id, d, min(i) AS i FROM d GROUP BY ALL), s AS (SELECT entity_id, string_agg(d, ' ' ORDER BY i) AS s FROM f GROUP BY entity_id)
            SELECT e.entity_id, e.name || ': ' || coalesce(s.s, '') AS entity_text FROM e LEFT JOIN s ON e.entity_id = s.entity_id""",
        "subchunk_labels": f"""SELECT id, '[chunk ' || parent_id || ', subchunk ' || id || CASE WHEN {_SUFFIX} <> '' THEN ', ' || {_SUFFIX} ELSE '' END || ']' || chr(10)
            || coalesce(CASE WHEN trim(source_text) <> '' THEN source_text END, text) AS entry
            FROM (SELECT DISTINCT id, parent_id, text, source_text, source_name, page, table_id, row_start, row_end FROM subchunks)""",
        "block_errors": f"""SELECT doc_id, pos, CASE WHEN e IS NOT NULL THEN 'block ' || pos || ': ' || e END AS error FROM (SELECT *, CASE
            WHEN trim(coalesce(type, '')) = '' THEN 'type is blank' WHEN type <> 'table' AND text IS NULL THEN 'text is missing'
            WHEN type = 'table' AND trim(coalesce(table_id, '')) = '' THEN 'table_id is blank'
            WHEN type = 'table' AND (headers IS NULL OR len(headers) = 0 OR len(list_filter(headers, lambda h: trim(coalesce(h, '')) = '')) > 0) THEN 'headers are missing or blank'
            WHEN type = 'table' AND rows IS NULL THEN 'rows are missing'
            WHEN type = 'table' AND len(list_filter(rows, lambda r: len(r) <> len(headers))) > 0 THEN 'row ' || list_position(list_transform(rows, lambda r: len(r) <> len(headers)), true)
              || ' does not have ' || len(headers) || ' cells'
            WHEN type = 'table' AND len(list_filter(rows, lambda r: len(list_filter(r, lambda c: c IS NULL)) > 0)) > 0 THEN 'row ' ||
              list_position(list_transform(rows, lambda r: len(list_filter(r, lambda c: c IS NULL)) > 0), true) || ' has a null cell'
            WHEN source_name IS NULL THEN 'source_name is missing' WHEN len(list_filter(heading_path, lambda h: h IS NULL)) > 0 THEN 'heading_path has a null heading'
            WHEN page < 1 THEN 'page is below 1' END AS e FROM {_ROOT})""",
        "rebuilt_tables": f"""WITH t AS (SELECT doc_id, pos, list_transform(headers, lambda h: {clean('h')}) AS h, rows FROM {_ROOT} WHERE type = 'table'),
            w AS (SELECT *, greatest(len(h), coalesce(list_max(list_transform(rows, lambda r: len(r))), 0)) AS w FROM t),
            n AS (SELECT *, list_transform(range(1, w + 1), lambda i: CASE WHEN coalesce(h[i], '') = '' THEN 'Column ' || i ELSE h[i] END) AS n FROM w)
            SELECT doc_id, pos, list_transform(range(1, w + 1), lambda i: CASE WHEN len(list_filter(n[1 : i], lambda k: {fold('k')} = {fold('n[i]')})) > 1
              THEN n[i] || ' (' || len(list_filter(n[1 : i], lambda k: {fold('k')} = {fold('n[i]')})) || ')' ELSE n[i] END) AS headers,
              len(list_filter(rows, lambda r: len(list_filter(r, lambda c: {clean('c')} <> '')) > 0)) AS n_rows FROM n""",
        "text_runs": runs,
        "word_chunks": chunk_windows,
        "numbered_chunks": f"SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS id FROM ({chunk_windows})",
        "tau_text_subchunks": tau,
        "normalised_vectors": f"SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm, round(vec[1], 6) AS first FROM {_UNIT}",
        "mean_vectors": f"""WITH u AS {_UNIT}, l AS (SELECT label::BIGINT AS label, vec_id FROM embeddings),
            x AS (SELECT label, unnest(range(1, {DIMS + 1})) AS i, vec FROM l JOIN u ON u.id = l.vec_id), m AS (SELECT label, i, avg(vec[i]) AS m FROM x GROUP BY ALL),
            n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
            SELECT n.label, round(max(CASE WHEN i = 1 THEN m / n END), 6) AS first, round(max(CASE WHEN i = {DIMS} THEN m / n END), 6) AS last FROM m JOIN n ON m.label = n.label GROUP BY n.label""",
        "semantic_knn": f"WITH {_neighbours(5)} SELECT src, dst, rank, score FROM n",
        "lexical_cooccurrence": f"""WITH {entity_terms}, k AS (SELECT term FROM t GROUP BY term HAVING count(*) > 1)
            SELECT a.id AS a, b.id AS b, count(*) AS common FROM t a JOIN t b ON a.term = b.term AND a.id < b.id WHERE a.term IN (SELECT term FROM k) GROUP BY ALL""",
        "lexical_cooccurrence_topk": f"""WITH {entity_terms}, c AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM t a JOIN t b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
            p AS (SELECT a.id AS src, b.id AS dst, coalesce(c.n, 0) AS common FROM x a JOIN x b ON a.id <> b.id LEFT JOIN c ON c.src = a.id AND c.dst = b.id)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY common DESC, dst) AS rank FROM p) WHERE rank <= 3""",
        "hybrid_knn": hybrid,
        "pagerank_core": f"""WITH {_pagerank()}, o AS (SELECT id, round(r, 10) AS pagerank, row_number() OVER (ORDER BY round(r, 12) DESC, id) - 1 AS core_no FROM p)
            SELECT o.* FROM o, c WHERE core_no < greatest(1, ceil(round(0.2 * c, 9)))""",
        "pagerank_converged": f"WITH {_pagerank()} SELECT id, round(r, 10) AS pagerank FROM p",
        "keyword_vocabulary": f"SELECT * FROM {vocabulary}",
        "keyword_edges": f"""SELECT v.keyword_id, s.id AS subchunk_id FROM (SELECT id, unnest(list_distinct({keyword_tokens('text')})) AS keyword FROM (SELECT DISTINCT id, text FROM subchunks)) s
            JOIN {vocabulary} v ON v.keyword = s.keyword""",
        "hashed_vectors": f"""WITH {_hashed('documents', 'doc_id')} SELECT doc_id AS id, round(coalesce(a.v, 0), 6) AS first, round(coalesce(z.v, 0), 6) AS last FROM documents
            LEFT JOIN e a ON a.id = doc_id AND a.b = 0 LEFT JOIN e z ON z.id = doc_id AND z.b = {DIMS - 1}""",
        "text_retrieve": f"""WITH src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, '{question}'), {_hashed('src', 'id')},
            q AS (SELECT b, v FROM e WHERE id = -1),
            s AS (SELECT d.doc_id AS id, round(coalesce(x.s, 0), 6) AS score FROM documents d LEFT JOIN (SELECT e.id, sum(e.v * q.v) AS s FROM e JOIN q ON e.b = q.b GROUP BY e.id) x ON x.id = d.doc_id)
            SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 6""",
        "knn_retrieve": graph_expanded,
        "seed_adjacency": """WITH e AS (SELECT DISTINCT entity_id, list_distinct(chunk_ids) AS c FROM entities)
            SELECT chunk_id, count(*) AS n FROM (SELECT unnest(c) AS chunk_id FROM e WHERE len(c) >= 3) GROUP BY chunk_id""",
        "corpus_key": """WITH p AS (SELECT doc_id, arg_max(requested_url, loaded_at) AS u FROM web_pages GROUP BY doc_id)
            SELECT substr(sha256('[' || string_agg('"' || u || '"', ',' ORDER BY doc_id) || ']'), 1, 16) AS request_key FROM p""",
        "pdf_tables": f"""WITH b AS (SELECT * FROM {_ROOT} WHERE page IS NOT NULL AND type = 'table' AND len(rows) > 0)
            SELECT doc_id || '-' || pos || '-table.pdf' AS file, page, doc_id || '-' || pos || '-table.pdf-page-' || page || '-table-1' AS table_id, headers,
              list_transform(rows, lambda r: list_transform(r, lambda c: CASE WHEN regexp_full_match({clean('c')}, '[0-9]{{1,3}}( [0-9]{{3}})+') THEN replace({clean('c')}, ' ', '') ELSE {clean('c')} END)) AS rows FROM b""",
        "html_text": f"""WITH b AS (SELECT doc_id, pos, type, headers, rows, {clean('text')} AS t FROM {_ROOT} WHERE source_url IS NOT NULL),
            k AS (SELECT *, (type = 'table' AND len(list_filter(rows, lambda r: len(list_filter(r, lambda c: trim(coalesce(c, '')) <> '')) > 0)) > 0) OR (type <> 'table' AND t <> '') AS kept FROM b),
            l AS (SELECT *, max(CASE WHEN type = 'heading' AND t <> '' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hp FROM k),
            h AS (SELECT l.*, g.t AS top FROM l LEFT JOIN b g ON g.doc_id = l.doc_id AND g.pos = l.hp),
            x AS (SELECT doc_id, pos, CASE WHEN type = 'table' THEN concat_ws(chr(10), top, array_to_string(list_filter(list_transform(rows, lambda r: {row_text('r', 'headers')}), lambda q: q <> ''), chr(10)))
              WHEN type = 'heading' THEN t ELSE concat_ws(chr(10), top, t) END AS said FROM h WHERE kept)
            SELECT doc_id AS page_id, string_agg(said, chr(10) ORDER BY pos) AS text FROM x GROUP BY doc_id""",
        "pdf_paragraphs": f"""WITH b AS (SELECT *, {clean('text')} AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS i FROM {_ROOT}
            WHERE page IS NOT NULL AND type <> 'table' AND text IS NOT NULL)
            SELECT doc_id || '.pdf' AS file, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS pos, t AS text FROM b WHERE t <> ''""",
    }
