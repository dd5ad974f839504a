"""DuckDB SQL for the library's queries.

Queries without an entry can't be put in SQL: greedy merging (greedy_communities, community_hierarchy) and Louvain's method
(louvain_communities); tests check those against brute force.
"""

from __future__ import annotations

from factloom.operators.extraction import ASKS, RULES, TEMPERATURES
from factloom.schemas import STRATEGIES

SQL: dict[str, str] = {}

# Pieces of SQL.

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def words(x: str) -> str:
    return WORDS.format(x)


def edit_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def name_match(n: str, e: str) -> str:
    n, e = f"lower(trim({n}))", f"lower({e})"
    return f"(CASE WHEN {n} = '' OR {e} = '' THEN 0.0::DOUBLE WHEN contains({e}, {n}) THEN 1.0::DOUBLE ELSE {edit_ratio(n, e)} END)"


def char_jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ''))", f"list_distinct(string_split({b}, ''))"
    return f"(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))))"


def stable_id(prefix: str, x: str) -> str:
    return f"('{prefix}_' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('{prefix}:' || lower({x}))), 1, 12))"


def windows(key: str, needle: str, hay: str, source: str) -> str:
    """CTEs that end in ``best`` (key, r): the best window of each (key, needle, hay) of ``source``; distinct keys."""
    return f"""w0 AS (SELECT DISTINCT {key} AS k, {needle} AS a, {hay} AS b FROM {source}),
w1 AS (SELECT *, length(a) AS n, greatest(2, length(a) // 3) AS off, length(b) AS m FROM w0),
w2 AS (SELECT k, a, b, m, unnest(list_distinct([greatest(1, n - off), n, n + off])) AS w FROM w1 WHERE n > 0 AND m > 0 AND NOT contains(b, a) AND greatest(1, n - off) <= m),
w3 AS (SELECT k, a, b, w, unnest(range(1, m - w + 2)) AS p FROM w2 WHERE w <= m),
w4 AS (SELECT k, a, b, max({edit_ratio("a", "substr(b, p, w)")}) AS r FROM w3 GROUP BY k, a, b),
best AS (SELECT w1.k, CASE WHEN n = 0 OR m = 0 THEN 0.0::DOUBLE WHEN contains(w1.b, w1.a) THEN 1.0::DOUBLE WHEN greatest(1, n - off) > m THEN {edit_ratio("w1.a", "w1.b")} ELSE w4.r END AS r
  FROM w1 LEFT JOIN w4 ON w1.k = w4.k AND w1.a = w4.a AND w1.b = w4.b)"""


# The star schema as facts.

FACTS = """
f AS (
  SELECT n_nationkey::BIGINT AS key, 'nat_' || n_nationkey AS head_id, 'rel_in' AS relation_id, 'reg_' || r_regionkey AS tail_id, n_name AS head_name, 'inRegion' AS relation_name, r_name AS tail_name, n_nationkey::BIGINT AS ord
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_suppkey, 'sup_' || s_suppkey, 'rel_based', 'nat_' || n_nationkey, s_name, 'basedIn', n_name, s_suppkey + 1000000000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_custkey, 'cus_' || c_custkey, 'rel_based', 'nat_' || n_nationkey, c_name, 'basedIn', n_name, c_custkey + 2000000000000 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
SUPPLIES = """
fs AS (SELECT * FROM f UNION ALL
  SELECT l_suppkey + l_partkey, 'sup_' || l_suppkey, 'rel_supplies', 'par_' || l_partkey, s_name, 'supplies', p_name, l_suppkey * 1000000000 + l_partkey + 300000000000000000
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def pool(source: str) -> str:
    return f"""
t AS (SELECT head_id || ':' || relation_id || ':' || tail_id || ':' || s AS triple_id, head_id, relation_id, tail_id, head_name, relation_name, tail_name, key,
    CASE WHEN key % 5 = 0 THEN '' WHEN key % 5 = 1 THEN head_name ELSE head_name || ' ' || relation_name || ' ' || tail_name END AS evidence,
    ['tot', 'open_ie', 'loose'][s + 1] AS strategy, 0.5::DOUBLE + (key % 4) / 10.0::DOUBLE AS confidence, ord * 3 + s AS ord
  FROM {source}, (SELECT unnest([0, 1, 2]) AS s) WHERE s = 0 OR (s = 1 AND key % 2 = 0) OR (s = 2 AND key % 3 = 0))"""


NAMED = f"""{FACTS}, {pool("f")},
d AS (SELECT 'doc_' || head_id AS doc_id, 'Records: ' || head_name || ' ' || relation_name || ' ' || CASE WHEN key % 3 = 1 THEN replace(tail_name, 'A', 'E') ELSE tail_name END || '.' AS text FROM f),
nm AS (SELECT t.*, d.text AS source FROM t JOIN d ON d.doc_id = 'doc_' || t.head_id)"""
SCORED = f"""{NAMED},
m0 AS (SELECT *, {name_match("head_name", "evidence")} AS s, {name_match("tail_name", "evidence")} AS o, {name_match("relation_name", "evidence")} AS r,
    CASE WHEN evidence = '' THEN 0.0::DOUBLE ELSE {char_jaccard("lower(evidence)", "lower(source)")} END AS c FROM nm),
eb AS (SELECT *, (CASE WHEN s = 1 AND o = 1 AND r = 1 THEN 1.0::DOUBLE ELSE (s + o + r) / 3 END) * 0.35::DOUBLE AS eb_complete, s * 0.25::DOUBLE AS eb_subject, o * 0.25::DOUBLE AS eb_object, c * 0.15::DOUBLE AS eb_conciseness FROM m0),
pairs AS (SELECT DISTINCT head_id, head_name, tail_name, relation_name, source FROM nm),
ends AS (SELECT head_id || '|h' AS k, lower(head_name) AS a, lower(source) AS b FROM pairs UNION ALL SELECT head_id || '|t', lower(tail_name), lower(source) FROM pairs),
{windows("k", "a", "b", "ends")},
wt AS (SELECT head_id, unnest({words("head_name || ' ' || relation_name || ' ' || tail_name")}) AS w, 1 AS x, 0 AS y FROM pairs UNION ALL SELECT head_id, unnest({words("source")}), 0, 1 FROM pairs),
wc AS (SELECT head_id, w, sum(x) AS x, sum(y) AS y FROM wt GROUP BY head_id, w),
co AS (SELECT head_id, sum(least(x, y))::DOUBLE / sum(greatest(x, y)) AS j FROM wc GROUP BY head_id),
sc AS (SELECT eb.*, eb_complete + eb_subject + eb_object + eb_conciseness AS eb_total, bh.r AS ah, bt.r AS tt, bh.r * 0.45::DOUBLE AS ec_subject, bt.r * 0.45::DOUBLE AS ec_object, co.j * 0.1::DOUBLE AS ec_coherence
  FROM eb JOIN best bh ON bh.k = eb.head_id || '|h' JOIN best bt ON bt.k = eb.head_id || '|t' JOIN co ON co.head_id = eb.head_id)"""
DECIDED = f"""{SCORED},
st AS (SELECT head_id, relation_id, tail_id, count(DISTINCT strategy) AS n FROM t GROUP BY ALL),
de AS (SELECT sc.*, ec_subject + ec_object + ec_coherence AS ec_total, CASE WHEN st.n >= 2 AND ah >= 0.9 AND tt >= 0.9 THEN 'F1_consensus' WHEN evidence <> '' AND eb_total >= 0.9 THEN 'F2_explicit_evidence'
    WHEN ec_subject + ec_object + ec_coherence >= 0.75 THEN 'F3_soft_grounding' ELSE 'rejected' END AS filter_tag
  FROM sc JOIN st ON sc.head_id = st.head_id AND sc.relation_id = st.relation_id AND sc.tail_id = st.tail_id)"""

# Text and identifiers

SQL["tokenize_counts"] = f"SELECT doc_id, len({words('text')})::BIGINT AS n_tokens, len(list_distinct({words('text')}))::BIGINT AS n_distinct FROM documents"
SQL["word_counts"] = f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({words('text')}) AS word FROM documents) GROUP BY lang, word HAVING count(*) >= 20"
NEXT = "p AS (SELECT a.conv_id, a.turn, coalesce(a.text, '') AS a, coalesce(b.text, '') AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
SQL["multiset_jaccard"] = f"""WITH {NEXT}, w AS (SELECT conv_id, turn, unnest({words("a")}) AS w, 1 AS x, 0 AS y FROM p UNION ALL SELECT conv_id, turn, unnest({words("b")}), 0, 1 FROM p),
c AS (SELECT conv_id, turn, w, sum(x) AS x, sum(y) AS y FROM w GROUP BY 1, 2, 3), j AS (SELECT conv_id, turn, round(sum(least(x, y))::DOUBLE / sum(greatest(x, y)), 6) AS j FROM c GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(j, 1.0::DOUBLE) AS by_column, coalesce(j, 1.0::DOUBLE) AS by_rows FROM p LEFT JOIN j USING (conv_id, turn)"""
SQL["lexical_overlap"] = f"""SELECT a.conv_id, a.turn, round(CASE WHEN len({words("a.text")}) = 0 OR len({words("b.text")}) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(list_distinct({words("a.text")}), list_distinct({words("b.text")})))::DOUBLE / len(list_distinct(list_concat({words("a.text")}, {words("b.text")}))) END, 6) AS overlap
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
SQL["char_jaccard"] = f"""WITH {NEXT} SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE round({char_jaccard('a', 'b')}, 6) END AS chars,
  CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE round({char_jaccard('lower(a)', 'lower(b)')}, 6) END AS conciseness FROM p"""
SQL["edit_ratio"] = f"SELECT p_partkey, round({edit_ratio('p_name', 'p_type')}, 6) AS ratio, round({name_match('p_type', 'p_name')}, 6) AS matched FROM part"
SQL["best_window"] = f"""WITH q AS (SELECT p_partkey, p_name, 'one ' || lower(p_type) || ' ' || lower(p_brand) || ' a wodget, ringlet or balt' AS hay FROM part),
{windows("p_partkey", "p_name", "hay", "q")} SELECT k AS p_partkey, round(r, 6) AS ratio, round(r, 6) AS surface FROM best"""
SQL["stable_ids"] = f"SELECT c_custkey, {stable_id('cls', 'c_name')} AS class_id, {stable_id('ent', chr(39).join(['c_name || ', ' é', '']))} AS entity_id FROM customer"
SQL["community_ids"] = "SELECT c_nationkey, 'cm_0_' || substr(sha1('0:' || c_nationkey || ':' || string_agg(c_name, ',' ORDER BY c_name)), 1, 12) AS community_id FROM customer GROUP BY c_nationkey"
SQL["squeezed_names"] = r"SELECT p_partkey, p_name || ' ' || p_brand AS name, regexp_matches(replace(p_name, ' ', ''), '^[a-z]\w*$') AS predicate FROM part"
SQL["lead_summaries"] = "SELECT c_nationkey, c_mktsegment, substr(substr(string_agg(c_name, ', ' ORDER BY c_name), 1, 280) || '. In nation ' || c_nationkey || '.', 1, 280) AS summary FROM customer GROUP BY 1, 2"

# Vectors

SQL["hash_embedding"] = """WITH p AS (SELECT p_partkey, '  ' || lower(p_name) || '  ' AS s FROM part), g AS (SELECT p_partkey, substr(s, i, 3) AS tri FROM (SELECT p_partkey, s, unnest(range(1, length(s) - 1)) AS i FROM p)),
h AS (SELECT p_partkey, sha256(tri) AS h FROM g)
SELECT p_partkey, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS weight
FROM h GROUP BY p_partkey, bucket HAVING sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) <> 0"""
SQL["vector_top_k"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(q.v, e.v))) AS score FROM e, e q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
SQL["vector_blend"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id, a.v, list_transform(range(1, len(a.v) + 1), lambda i: 0.6::DOUBLE * b.v[i] + 0.4::DOUBLE * a.v[i]) AS m FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_dot_product(m, v) / sqrt(list_dot_product(m, m)), 5) AS with_own, 1.0::DOUBLE AS length FROM x"""

# Schema induction

SQL["chunks"] = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 180 + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i AS chunk_index, md5(array_to_string(list_slice(w, i * 180 + 1, i * 180 + 200), ' ')) AS text_md5 FROM c"""
SQL["class_support"] = """WITH p AS (
  SELECT doc_id, 0 AS i, CASE WHEN doc_id % 2 = 0 THEN upper('Source ' || source) ELSE 'Source ' || source END AS name, CASE WHEN doc_id % 3 = 0 THEN 'from ' || source ELSE '' END AS description, 'Lang  ' || lang AS parent, source AS alias FROM documents
  UNION ALL SELECT doc_id, 1, 'Lang  ' || lang, '', NULL, NULL FROM documents)
SELECT lower(regexp_replace(name, '\\s+', ' ', 'g')) AS key, arg_min(name, doc_id) AS name, coalesce(arg_min(description, doc_id) FILTER (description <> ''), '') AS description,
  coalesce(array_to_string(list_sort(list(DISTINCT parent) FILTER (parent IS NOT NULL)), '|'), '') AS parents, coalesce(array_to_string(list_sort(list(DISTINCT alias) FILTER (alias IS NOT NULL)), '|'), '') AS aliases, count(*) AS support
FROM p GROUP BY 1 HAVING count(*) >= 5""".replace("\\\\s", "\\s")
SQL["relation_support"] = """SELECT 'writtenIn' || lang AS name, 'source ' || arg_min(source, doc_id) AS domain, 'lang ' || lang AS range, CASE WHEN bool_or(doc_id % 97 = 5) THEN 'undirected' ELSE 'directed' END AS direction,
  bool_or(doc_id % 301 = 7) AS symmetric, false AS transitive, count(*) AS support FROM documents GROUP BY lang HAVING count(*) >= 5"""
SQL["induced_schema"] = f"""WITH s AS (SELECT source, arg_min(CASE WHEN doc_id % 2 = 0 THEN upper('Source ' || source) ELSE 'Source ' || source END, doc_id) AS name, list(DISTINCT lang) AS ls FROM documents GROUP BY source HAVING count(*) >= 5),
l AS (SELECT lang, arg_min(source, doc_id) AS source, {stable_id("cls", "'Lang  ' || lang")} AS id FROM documents GROUP BY lang HAVING count(*) >= 5),
p AS (SELECT s.source, string_agg(l.id, '|' ORDER BY l.id) AS refs FROM (SELECT source, unnest(ls) AS lang FROM s) s JOIN l ON s.lang = l.lang GROUP BY s.source)
SELECT {stable_id("cls", "s.name")} AS id, s.name, coalesce(p.refs, '') AS refs FROM s LEFT JOIN p ON s.source = p.source
UNION ALL SELECT id, 'Lang  ' || lang, '' FROM l
UNION ALL SELECT {stable_id("rel", "'writtenIn' || l.lang")}, 'writtenIn' || l.lang, CASE WHEN s.name IS NULL THEN '' ELSE {stable_id("cls", "s.name")} || '|' END || l.id FROM l LEFT JOIN s ON l.source = s.source"""
SQL["extended_schema"] = """WITH a AS (SELECT doc_id, unnest(['source ' || source, 'lang ' || lang]) AS key FROM documents), e AS (SELECT key, count(*) AS support FROM a WHERE doc_id % 2 = 0 GROUP BY key)
SELECT * FROM e UNION ALL SELECT key, count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.key = a.key) GROUP BY key"""
SQL["class_ancestry"] = """WITH RECURSIVE up(class_id, ancestor_id) AS (VALUES ('cls_region', 'cls_place'), ('cls_nation', 'cls_place'), ('cls_supplier', 'cls_party'), ('cls_customer', 'cls_party')),
a AS (SELECT c AS class_id, c AS ancestor_id FROM (VALUES ('cls_place'), ('cls_region'), ('cls_nation'), ('cls_party'), ('cls_supplier'), ('cls_customer'), ('cls_part')) v(c)
  UNION SELECT a.class_id, up.ancestor_id FROM a JOIN up ON a.ancestor_id = up.class_id) SELECT * FROM a"""
ENTITIES = """
en AS (SELECT 'reg_' || r_regionkey AS entity_id, r_name AS name, 'cls_region' AS type_id, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'nat_' || n_nationkey, n_name, 'cls_nation', n_nationkey + 1000000000000 FROM nation
  UNION ALL SELECT 'sup_' || s_suppkey, s_name, 'cls_supplier', s_suppkey + 2000000000000 FROM supplier UNION ALL SELECT 'cus_' || c_custkey, c_name, 'cls_customer', c_custkey + 3000000000000 FROM customer
  UNION ALL SELECT 'par_' || p_partkey, p_name, 'cls_part', p_partkey + 4000000000000 FROM part)"""
SQL["name_lookup"] = f"""WITH {ENTITIES}, k AS (SELECT entity_id, ord * 2 AS o, lower(name) AS key FROM en UNION ALL SELECT entity_id, ord * 2 + 1, lower(replace(name, '#', ' ')) FROM en)
SELECT key, arg_min(entity_id, o) AS first_id, arg_max(entity_id, o) AS last_id FROM k GROUP BY key"""

# Extraction

SQL["extracted_triples"] = f"""WITH {FACTS} SELECT head_id AS doc_id, s AS strategy, {stable_id("ent", "head_name")} AS head_id, relation_id, {stable_id("ent", "tail_name")} AS tail_id, head_name || ' ' || relation_name || ' ' || tail_name AS evidence
FROM f, (SELECT unnest(['tot', 'open_ie']) AS s)"""
SQL["extracted_entities"] = f"""WITH {FACTS}, s AS (SELECT unnest(['tot', 'open_ie']) AS strategy)
SELECT head_id AS doc_id, strategy, {stable_id("ent", "head_name")} AS entity_id, head_name AS name, 'cls_party' AS type_id, 0.8::DOUBLE AS confidence FROM f, s
UNION ALL SELECT head_id, strategy, {stable_id("ent", "tail_name")}, tail_name, NULL, 0.5::DOUBLE FROM f, s"""
SQL["merged_entities"] = """WITH m AS (SELECT o_orderkey AS ord, 'm_' || o_orderkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, c_mktsegment AS type_id, o_orderpriority AS alias, o_orderstatus AS src, (o_orderkey % 10) / 10.0::DOUBLE AS confidence
  FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT lower(name) AS k, alias, min(ord) AS o FROM m GROUP BY 1, 2), s AS (SELECT lower(name) AS k, src, min(ord) AS o FROM m GROUP BY 1, 2),
aa AS (SELECT k, string_agg(alias, '|' ORDER BY o) AS aliases FROM a GROUP BY k), ss AS (SELECT k, string_agg(src, '|' ORDER BY o) AS sources FROM s GROUP BY k),
g AS (SELECT lower(name) AS k, arg_min(entity_id, ord) AS entity_id, arg_min(name, ord) AS name, arg_min(type_id, ord) AS type_id, round(max(confidence), 6) AS confidence FROM m GROUP BY 1)
SELECT entity_id, name, type_id, aliases, sources, confidence FROM g JOIN aa ON g.k = aa.k JOIN ss ON g.k = ss.k"""
SQL["merged_triples"] = f"""WITH {FACTS}, {SUPPLIES}, {pool("fs")}
SELECT arg_min(triple_id, ord) AS triple_id, head_id, relation_id, tail_id, arg_min(strategy, ord) AS strategy, arg_min(evidence, ord) AS evidence, round(max(confidence), 6) AS confidence FROM t GROUP BY head_id, relation_id, tail_id"""
SQL["canonicalised"] = """SELECT 't_m_' || o_orderkey AS triple_id, 'm_' || min(o_orderkey) OVER (PARTITION BY lower(c_name)) AS head_id, 'nowhere' AS tail_id FROM orders JOIN customer ON o_custkey = c_custkey"""
SQL["unioned_strategies"] = f"WITH {FACTS}, {SUPPLIES}, {pool('fs')} SELECT strategy, count(*) AS n, count(*) FILTER (evidence = '') AS blank FROM t GROUP BY strategy"
SQL["parsed_replies"] = """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 7 NOT IN (1, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS k, NOT (event_id % 3 = 0 OR event_id % 7 NOT IN (1, 2)) AS failed FROM events"""

# Verification

SQL["consensus"] = f"WITH {FACTS}, {SUPPLIES}, {pool('fs')} SELECT head_id, relation_id, tail_id, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies, count(DISTINCT strategy) AS n_strategies FROM t GROUP BY ALL"
SQL["consensus"] = SQL["consensus"].replace("GROUP BY ALL", "GROUP BY head_id, relation_id, tail_id")
SQL["source_resolution"] = f"WITH {NAMED} SELECT triple_id, source FROM nm"
SQL["evidence_scores"] = f"WITH {SCORED} SELECT triple_id, round(eb_complete, 6) AS eb_complete, round(eb_subject, 6) AS eb_subject, round(eb_object, 6) AS eb_object, round(eb_conciseness, 6) AS eb_conciseness, round(eb_total, 6) AS eb_total FROM sc"
SQL["grounding_scores"] = f"WITH {SCORED} SELECT triple_id, round(ec_subject, 6) AS ec_subject, round(ec_object, 6) AS ec_object, round(ec_coherence, 6) AS ec_coherence, round(ec_subject + ec_object + ec_coherence, 6) AS ec_total FROM sc"
SQL["cascade"] = f"""WITH {DECIDED} SELECT triple_id, filter_tag <> 'rejected' AS accepted, filter_tag, round(CASE filter_tag WHEN 'F2_explicit_evidence' THEN eb_total WHEN 'F3_soft_grounding' THEN ec_total / 2 END, 6) AS tier_score,
CASE WHEN filter_tag <> 'rejected' THEN NULL WHEN evidence <> '' THEN printf('E_B=%.3f < 0.900', eb_total) ELSE printf('E_C=%.3f < 0.750', ec_total) END AS rejected_reason FROM de"""
SQL["decision_counts"] = f"WITH {DECIDED} SELECT filter_tag, count(*) AS n FROM de GROUP BY filter_tag"
SQL["verified_snapshot"] = f"""WITH {DECIDED} SELECT 'triple' AS kind, triple_id AS id FROM de WHERE filter_tag <> 'rejected' UNION ALL SELECT 'entity', id FROM (SELECT head_id AS id FROM de WHERE filter_tag <> 'rejected' UNION SELECT tail_id FROM de WHERE filter_tag <> 'rejected')"""
SQL["deduplicated_facts"] = f"WITH {FACTS}, {SUPPLIES}, {pool('fs')} SELECT head_id, relation_id, tail_id, arg_min(triple_id, ord) AS first_id, arg_min(triple_id, ord) AS richest_id FROM t GROUP BY head_id, relation_id, tail_id"
SQL["checked_facts"] = f"""WITH {FACTS}, {SUPPLIES}, {pool("fs")}, w AS (SELECT triple_id, head_id, tail_id, CASE WHEN ord % 11 = 0 THEN 'rel_in' ELSE relation_id END AS relation_id FROM t WHERE length(evidence) >= 5 AND head_id <> tail_id)
SELECT triple_id, relation_id FROM w WHERE CASE relation_id WHEN 'rel_in' THEN head_id LIKE 'nat%' AND tail_id LIKE 'reg%' WHEN 'rel_based' THEN tail_id LIKE 'nat%' ELSE head_id LIKE 'sup%' AND tail_id LIKE 'par%' END"""

# Graphs and communities

EDGES = f"{FACTS}, {SUPPLIES}, e AS (SELECT least(head_id, tail_id) AS src, greatest(head_id, tail_id) AS dst, count(*) AS weight FROM fs GROUP BY 1, 2)"
MEMBERS = """
mb AS (SELECT head_id AS node, tail_id AS community FROM f WHERE relation_id = 'rel_in' UNION SELECT tail_id, tail_id FROM f WHERE relation_id = 'rel_in'
  UNION ALL SELECT a.head_id, b.tail_id FROM f a JOIN f b ON a.tail_id = b.head_id WHERE a.relation_id = 'rel_based' AND b.relation_id = 'rel_in' UNION ALL SELECT 'par_' || p_partkey, 'size_' || (p_size % 5) FROM part)"""
SQL["entity_graph"] = f"WITH {EDGES} SELECT * FROM e"
SQL["contracted_graph"] = f"WITH {EDGES}, {MEMBERS} SELECT least(a.community, b.community) AS src, greatest(a.community, b.community) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN mb a ON a.node = src JOIN mb b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2"
SQL["modularity"] = f"""WITH {EDGES}, {MEMBERS}, x AS (SELECT a.community AS ca, b.community AS cb FROM e JOIN mb a ON a.node = src JOIN mb b ON b.node = dst), m AS (SELECT count(*)::DOUBLE AS m FROM x),
c AS (SELECT c, sum(i) AS i, count(*) AS d FROM (SELECT ca AS c, (ca = cb)::INT AS i FROM x UNION ALL SELECT cb, (ca = cb)::INT FROM x) GROUP BY c) SELECT round(sum(i / (2 * m) - pow(d / (2 * m), 2)), 6) AS modularity FROM c, m"""
SQL["node_degrees"] = f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node"
SQL["connected_components"] = f"""WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS node FROM b),
r(start, node) AS (SELECT node, node FROM n WHERE node LIKE 'reg%' UNION SELECT r.start, b.dst FROM r JOIN b ON r.node = b.src),
l AS (SELECT a.start AS x, b.start AS y FROM r a JOIN r b ON a.node = b.node GROUP BY 1, 2), g(x, y) AS (SELECT x, y FROM l UNION SELECT g.x, l.y FROM g JOIN l ON g.y = l.x), t AS (SELECT x AS start, min(y) AS top FROM g GROUP BY x)
SELECT DISTINCT node, min(node) OVER (PARTITION BY top) AS component FROM r JOIN t ON r.start = t.start"""
SQL["nodes_within_two_hops"] = f"""WITH {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT 'reg_' || r_regionkey AS start FROM region),
h AS (SELECT start, start AS node, 0 AS d FROM s UNION ALL SELECT start, dst, 1 FROM s JOIN b ON start = src UNION ALL SELECT start, c.dst, 2 FROM s JOIN b ON start = b.src JOIN b c ON b.dst = c.src)
SELECT start, node, min(d)::BIGINT AS distance FROM h GROUP BY start, node"""
SQL["incident_triples"] = f"WITH {FACTS}, {SUPPLIES} SELECT head_id || ':' || relation_id || ':' || tail_id AS triple_id FROM fs WHERE head_id LIKE 'nat%' OR tail_id LIKE 'nat%'"
SQL["property_graph"] = f"""WITH {FACTS}, {SUPPLIES}, {ENTITIES}
SELECT 'class' AS kind, id, other FROM (VALUES ('cls_place', 'Place'), ('cls_region', 'Region'), ('cls_nation', 'Nation'), ('cls_party', 'Party'), ('cls_supplier', 'Supplier'), ('cls_customer', 'Customer'), ('cls_part', 'Part')) v(id, other)
UNION ALL SELECT 'relation', id, other FROM (VALUES ('rel_in', 'inRegion'), ('rel_based', 'basedIn'), ('rel_supplies', 'supplies')) v(id, other)
UNION ALL SELECT 'entity', entity_id, name FROM en UNION ALL SELECT 'instance_of', entity_id, type_id FROM en UNION ALL SELECT 'triple', head_id, tail_id FROM fs"""
GIVEN = """
ba AS (SELECT head_id AS entity_id, tail_id AS nation, head_name AS name FROM f WHERE relation_id = 'rel_based'), na AS (SELECT head_id AS nation, tail_id AS region FROM f WHERE relation_id = 'rel_in'),
cm AS (SELECT ba.nation AS community_id, 0 AS level, na.region AS parent_id, entity_id, name FROM ba JOIN na ON ba.nation = na.nation UNION ALL SELECT na.region, 1, NULL, entity_id, name FROM ba JOIN na ON ba.nation = na.nation)"""
SQL["community_summaries"] = f"""WITH {FACTS}, {GIVEN}, n AS (SELECT community_id, string_agg(name, ', ' ORDER BY entity_id) AS names, min(entity_id) AS first FROM cm GROUP BY community_id)
SELECT community_id, substr(substr(names, 1, 280) || '. ' || head_name || ' ' || relation_name || ' ' || tail_name, 1, 280) AS summary FROM n JOIN f ON f.head_id = first"""
SQL["hierarchy_walk"] = f"""WITH {FACTS}, {GIVEN}, c AS (SELECT DISTINCT community_id, level, parent_id FROM cm)
SELECT community_id, level::BIGINT AS level, CASE WHEN parent_id IS NULL THEN community_id ELSE parent_id || '/' || community_id END AS path, (1 - level)::BIGINT AS depth FROM c"""
SQL["community_members"] = f"WITH {FACTS}, {GIVEN} SELECT community_id, entity_id, name FROM cm"
SQL["level_sizes"] = f"WITH {FACTS}, {GIVEN} SELECT level::BIGINT AS level, count(DISTINCT community_id) AS communities, count(*) AS members FROM cm GROUP BY level"

# Retrieval, alignment, measures

SQL["lexical_top_k"] = f"""WITH w AS (SELECT p_brand, {words("min(p_type || ' ' || p_name)")} AS ws FROM part GROUP BY p_brand), x AS (SELECT p.p_brand, p_partkey, list_distinct(ws) AS a, list_distinct({words("p_name || ' ' || p_type")}) AS b FROM part p JOIN w ON p.p_brand = w.p_brand),
s AS (SELECT p_brand AS query_id, p_partkey, 0.5::DOUBLE * (len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))) + 0.25::DOUBLE AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS rank FROM s) SELECT query_id, p_partkey, round(score, 6) AS score, rank FROM r WHERE rank <= 3"""
SQL["bm25_scores"] = f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({words("text")})) AS term FROM benchmark), d AS (SELECT doc_id, {words("text")} AS w FROM documents), st AS (SELECT count(*)::DOUBLE AS docs, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, n, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM tf JOIN df ON tf.term = df.term JOIN q ON q.term = tf.term, st GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM s) SELECT query_id, doc_id, round(score, 4)::DOUBLE AS score FROM r WHERE k <= 3"""
SQL["overlapping_names"] = f"""WITH n AS (SELECT p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '') AS name, min(p_partkey) AS id FROM part GROUP BY 1), w AS (SELECT id, list_sort(list_distinct({words("name")})) AS w FROM n), k AS (SELECT w, min(id) AS id FROM w GROUP BY w),
x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS o FROM k a JOIN k b ON a.id < b.id)
SELECT a, b, round(o, 6) AS overlap FROM x WHERE o >= 0.8 UNION ALL SELECT k.id, w.id, 1.0::DOUBLE FROM w JOIN k ON w.w = k.w WHERE w.id <> k.id"""
SQL["alias_groups"] = "WITH p AS (SELECT 'p' || p_partkey AS entity_id, p_name FROM part) SELECT entity_id, min(entity_id) OVER (PARTITION BY p_name) AS \"group\" FROM p"
SQL["event_histogram"] = "SELECT event_type, count(value) AS count, round(sum(value), 2) AS total, count(*) FILTER (value <= 1) AS le_0, count(*) FILTER (value <= 5) AS le_1, count(*) FILTER (value <= 10) AS le_2, count(*) FILTER (value <= 50) AS le_3 FROM events GROUP BY event_type"
SQL["near_duplicate_facts"] = f"""WITH {FACTS}, {pool("f")}, w AS (SELECT triple_id AS id, relation_id AS g, list_sort(list_distinct({words("head_id || ' ' || tail_id || ' ' || evidence")})) AS w FROM t),
k AS (SELECT g, w, min(id) AS id FROM w GROUP BY g, w), x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS o FROM k a JOIN k b ON a.g = b.g AND a.id < b.id)
SELECT a, b, round(o, 6) AS overlap FROM x WHERE o >= 0.7 UNION ALL SELECT k.id, w.id, 1.0::DOUBLE FROM w JOIN k ON w.w = k.w AND w.g = k.g WHERE w.id <> k.id"""
SQL["similar_vectors"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, v FROM e
  UNION ALL SELECT -a.vec_id - 1, list_transform(range(1, len(a.v) + 1), lambda i: 0.9::DOUBLE * a.v[i] + 0.3::DOUBLE * b.v[i]) FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id < b.vec_id) SELECT a, b, round(c, 6) AS cosine FROM c WHERE c >= 0.85"""

# Beam search: trigram vectors as rows (key, bucket, weight), each stage's best by window.


def lexical(a: str, b: str) -> str:
    x, y = f"list_distinct({words(a)})", f"list_distinct({words(b)})"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"


def embedded(name: str, source: str) -> str:
    """CTEs that end in ``name`` (k, b, w): unit vectors of the rows (k, s) of ``source``."""
    return f"""{name}_p AS (SELECT k, '  ' || lower(s) || '  ' AS s FROM {source} WHERE s <> ''), {name}_g AS (SELECT k, substr(s, i, 3) AS tri FROM (SELECT k, s, unnest(range(1, length(s) - 1)) AS i FROM {name}_p)),
{name}_h AS (SELECT k, sha256(tri) AS h FROM {name}_g), {name}_w AS (SELECT k, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS b, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM {name}_h GROUP BY 1, 2),
{name} AS (SELECT k, b, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_w WHERE w <> 0)"""


def scored(name: str, rows: str, vectors: str) -> str:
    """CTEs that end in ``name``: ``rows`` (query_id, k, s, prior, ...) with their score."""
    return f"""{name}_c AS (SELECT r.query_id, r.k, sum(q.w * v.w) AS c FROM {rows} r JOIN qv q ON q.k = r.query_id JOIN {vectors} v ON v.k = r.k AND v.b = q.b GROUP BY 1, 2),
{name} AS (SELECT r.*, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(c, 0.0::DOUBLE))) + 0.4::DOUBLE * {lexical("qs.s", "r.s")})) + 0.5::DOUBLE * prior)), 9) AS score
  FROM {rows} r JOIN qs ON qs.k = r.query_id LEFT JOIN {name}_c c ON c.query_id = r.query_id AND c.k = r.k)"""


def best(name: str, rows: str, order: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS rank FROM {rows}) WHERE rank <= 3)"


BEAM = f"""{FACTS}, {SUPPLIES}, {GIVEN}, {ENTITIES},
su0 AS (SELECT community_id, string_agg(name, ', ' ORDER BY entity_id) AS names, min(entity_id) AS first FROM cm GROUP BY community_id),
su AS (SELECT community_id AS k, substr(substr(names, 1, 280) || '. ' || head_name || ' ' || relation_name || ' ' || tail_name, 1, 280) AS s FROM su0 JOIN f ON f.head_id = first),
co AS (SELECT DISTINCT community_id, level, parent_id, substr(community_id, 5)::INTEGER AS ord FROM cm),
qs AS (SELECT n_nationkey::BIGINT AS k, 'who is based in ' || n_name AS s FROM nation), {embedded("qv", "qs")}, {embedded("sv", "su")},
cx AS (SELECT community_id AS k, b, sum(w) AS w FROM (SELECT community_id, b, w * 0.6::DOUBLE AS w FROM co JOIN sv ON sv.k = parent_id UNION ALL SELECT community_id, b, w * CASE WHEN parent_id IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END FROM co JOIN sv ON sv.k = community_id) GROUP BY 1, 2),
cv AS (SELECT k, b, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM cx),
r1 AS (SELECT qs.k AS query_id, community_id AS k, su.s, ord, parent_id, 0.5::DOUBLE AS prior FROM qs, co JOIN su ON su.k = community_id WHERE level = 1), {scored("s1", "r1", "cv")}, {best("b1", "s1", "ord")},
r2 AS (SELECT b1.query_id, co.community_id AS k, su.s, co.ord, co.parent_id, b1.score AS prior, b1.rank AS up FROM b1 JOIN co ON co.parent_id = b1.k JOIN su ON su.k = co.community_id), {scored("s2", "r2", "cv")}, {best("b2", "s2", "up, ord")},
r3a AS (SELECT b2.query_id, ba.entity_id AS k, ba.name AS s, b2.score AS prior, row_number() OVER (PARTITION BY b2.query_id ORDER BY b2.rank, ba.entity_id) AS ord FROM b2 JOIN ba ON ba.nation = b2.k),
r3 AS (SELECT * FROM r3a WHERE ord <= 200), x3 AS (SELECT DISTINCT k, s FROM r3), {embedded("ev", "x3")}, {scored("s3", "r3", "ev")}, {best("b3", "s3", "ord")},
v AS (SELECT head_id || ':' || relation_id || ':' || tail_id AS k, head_id, relation_id, tail_id, head_name || ' ' || relation_name || ' ' || tail_name AS s, ord FROM fs),
r4a AS (SELECT r3.query_id, v.k, v.s, v.ord, head_id, relation_id, tail_id, max(prior) AS p, count(*) AS found FROM (SELECT k, s, ord, head_id, relation_id, tail_id, unnest([head_id, tail_id]) AS e FROM v) v JOIN r3 ON r3.k = v.e GROUP BY 1, 2, 3, 4, 5, 6, 7),
r4b AS (SELECT query_id, k, s, ord, head_id, relation_id, tail_id, CASE WHEN found < 2 THEN greatest(p, 0.3::DOUBLE) ELSE p END AS prior, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM r4a),
r4 AS (SELECT * FROM r4b WHERE n <= 300), x4 AS (SELECT DISTINCT k, s FROM r4), {embedded("tv", "x4")}, {scored("s4", "r4", "tv")}, {best("b4", "s4", "ord")},
hit AS (SELECT query_id, 1 AS stage, 'community' AS kind, k AS item_id, score, rank, k AS route, s AS label FROM b1 UNION ALL SELECT query_id, 2, 'community', k, score, rank, parent_id || '/' || k, s FROM b2
  UNION ALL SELECT query_id, 3, 'entity', k, score, rank, k, s FROM b3 UNION ALL SELECT query_id, 3, 'triple', k, score, rank, k, '(' || head_id || ', ' || relation_id || ', ' || tail_id || ') ' || s FROM b4)"""
SQL["beam_search"] = f"WITH {BEAM} SELECT query_id, stage, kind, item_id, round(score, 6) AS score, rank::INTEGER AS rank, route FROM hit"
SQL["beam_traces"] = f"WITH {BEAM} SELECT query_id, stage, kind, string_agg(item_id, '|' ORDER BY rank) AS kept, round(sum(round(score, 3)), 6) AS score_sum FROM hit GROUP BY query_id, stage, kind"
SQL["beam_reports"] = f"""WITH {BEAM}, l AS (SELECT query_id, CASE kind WHEN 'community' THEN stage WHEN 'entity' THEN 3 ELSE 4 END AS o, rank, printf('%s %.3f %s', kind, score, label) AS line FROM hit)
SELECT l.query_id, 'Query: ' || any_value(qs.s) || chr(10) || string_agg(line, chr(10) ORDER BY o, rank, line) AS report FROM l JOIN qs ON qs.k = l.query_id GROUP BY l.query_id"""

# What is stored, asked and derived

SQL["stored_documents"] = "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5 FROM documents WHERE trim(text, ' ') <> ''"
SQL["stored_graph"] = SQL["property_graph"]
SQL["stored_snapshot"] = f"WITH {FACTS}, {SUPPLIES}, {ENTITIES} SELECT type_id AS kind, count(*) AS n, 2 AS version FROM en GROUP BY type_id UNION ALL SELECT relation_id, count(*), 2 FROM fs GROUP BY relation_id"
SQL["cached_replies"] = """WITH r AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 1 WHEN p_type = 'LARGE' THEN 2 WHEN p_type = 'PROMO' THEN -1 WHEN contains('kind ' || p_type || ' of size ' || p_size, 'size 7') THEN -1 ELSE 4 END AS v FROM part)
SELECT p_partkey, v::BIGINT AS v, v = -1 AS failed, (SELECT count(*) FROM (SELECT DISTINCT p_type, p_size FROM part)) AS sent, 0::BIGINT AS sent_again FROM r"""
SQL["typed_edges"] = f"WITH {FACTS}, {SUPPLIES}, {pool('fs')} SELECT head_id AS src, tail_id AS dst, relation_id, count(*) AS weight, round(max(confidence), 6) AS confidence FROM t WHERE evidence <> '' AND confidence >= 0.6::DOUBLE GROUP BY 1, 2, 3"
SQL["tier_levels"] = f"""WITH {FACTS}, {SUPPLIES}, {pool("fs")}, w AS (SELECT triple_id, head_id, tail_id, confidence AS eb, confidence - 0.35::DOUBLE AS ec, length(evidence) >= 5 AND head_id <> tail_id AS a, CASE WHEN ord % 11 = 0 THEN 'rel_in' ELSE relation_id END AS r FROM t),
x AS (SELECT *, CASE r WHEN 'rel_in' THEN head_id LIKE 'nat%' AND tail_id LIKE 'reg%' WHEN 'rel_based' THEN tail_id LIKE 'nat%' ELSE head_id LIKE 'sup%' AND tail_id LIKE 'par%' END AS b, eb >= 0.55::DOUBLE AND ec >= 0.3::DOUBLE AND sqrt(eb * ec) >= 0.45::DOUBLE AS c FROM w)
SELECT triple_id, CASE WHEN NOT a THEN '' WHEN NOT b THEN 'syntactic' WHEN NOT c THEN 'syntactic>semantic' ELSE 'syntactic>semantic>evidential' END AS levels, a AND b AND c AS accepted, CASE WHEN NOT a THEN 'syntactic' WHEN NOT b THEN 'semantic' WHEN NOT c THEN 'evidential' END AS rejected_reason FROM x"""
SQL["evidential_facts"] = f"""WITH {FACTS}, {SUPPLIES}, {pool("fs")} SELECT triple_id, round(sqrt(confidence * (confidence - 0.35::DOUBLE)), 6) AS combined FROM t WHERE confidence >= 0.55::DOUBLE AND confidence - 0.35::DOUBLE >= 0.3::DOUBLE AND sqrt(confidence * (confidence - 0.35::DOUBLE)) >= 0.45::DOUBLE"""
STRATEGY_ROWS = "(VALUES " + ", ".join(f"('{s}', {TEMPERATURES[s]}::DOUBLE, '{ASKS[s]}')" for s in STRATEGIES) + ") s(strategy, temperature, ask)"
SQL["strategy_prompts"] = f"""SELECT doc_id, strategy, temperature, md5(ask || chr(10) || '{RULES}' || chr(10) || '- Server' || chr(10) || chr(10) || text) AS prompt_md5 FROM documents, {STRATEGY_ROWS} WHERE regexp_matches(text, '[^\\s\\x{{85}}\\p{{Z}}\\x{{1c}}-\\x{{1f}}]')"""
SQL["strategy_replies"] = f"""SELECT doc_id, strategy, CASE WHEN source = 'src3' THEN '' ELSE source || ' in ' || lang || ' at ' || temperature END AS raw, CASE WHEN source = 'src3' THEN 'RuntimeError: busy' ELSE '' END AS error FROM documents, {STRATEGY_ROWS} WHERE source IS NOT NULL AND lang IS NOT NULL"""
SQL["facts_between"] = f"WITH {FACTS}, {SUPPLIES} SELECT head_id || ':' || relation_id || ':' || tail_id AS triple_id FROM fs WHERE (head_id = 'sup_1' AND tail_id = 'par_1') OR (head_id = 'nat_3' AND tail_id = 'reg_1')"
SQL["fact_surfaces"] = f"WITH {FACTS}, {SUPPLIES}, {pool('fs')} SELECT triple_id, CASE WHEN evidence <> '' THEN evidence ELSE head_id || ' ' || relation_id || ' ' || tail_id END AS surface FROM t"
SQL["community_vectors"] = f"WITH {BEAM} SELECT k AS community_id, b::INTEGER AS bucket, round(w, 6) AS weight FROM cv WHERE abs(round(w, 6)) >= 0.00001"
SQL["community_roots_and_children"] = f"WITH {FACTS}, {GIVEN} SELECT DISTINCT community_id, CASE WHEN level = 1 THEN 'root' ELSE 'child' END AS kind FROM cm"
SQL["rule_violations"] = """WITH x AS (SELECT event_id, event_id % 5 = 0 AS n, value / 50 AS c, event_id % 3 = 2 AS s FROM events), y AS (SELECT event_id, concat_ws(',', CASE WHEN n THEN 'name' END, CASE WHEN c IS NULL OR c < 0 OR c > 1 THEN 'confidence' END, CASE WHEN s THEN 'strategy' END) AS broken FROM x)
SELECT * FROM y WHERE broken <> ''"""
SQL["mixed_ranking"] = """WITH k AS (SELECT p_brand AS q, p_partkey AS d, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) AS s FROM part WHERE p_partkey % 3 <> 1)
SELECT p_brand AS query_id, p_partkey AS doc_id, round(0.7::DOUBLE * CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0::DOUBLE ELSE 0 END + (1 - 0.7::DOUBLE) * coalesce(k.s, 0), 6) AS score FROM part LEFT JOIN k ON q = p_brand AND d = p_partkey"""
