"""The same results in SQL for DuckDB, written independently of the operators."""

from __future__ import annotations

from lookalike.operators.code_trees import (
    ASIDE,
    ASSIGNING,
    BEFORE_EXPRESSIONS,
    BINARY,
    CLASS_WORDS,
    CUTTING_OPERATORS,
    ESCAPED,
    GOES_ON,
    LITERAL_WORDS,
    NEVER_CALLED,
    TOKEN,
)
from lookalike.operators.trees import NODE_VALUES, OTHER_NODE_VALUE
from lookalike.plans.tables import BROKEN_BYTES, BROKEN_CODE, CODE_STATEMENTS

# --- building blocks: each is one or more named subqueries --------------------------

CASE_PAIRS = """
case_firsts AS (SELECT source, min(doc_id) AS doc1 FROM documents GROUP BY source),
case_pairs AS (
  SELECT f.doc1, d.doc_id AS doc2, d.source
  FROM documents d JOIN case_firsts f ON d.source = f.source WHERE d.doc_id <> f.doc1)"""

COPY_PAIRS = """
keyed AS (
  SELECT doc_id,
    list_max(list_transform(string_split(text, chr(10)), lambda x: {'n': length(x), 'line': x})).line AS line
  FROM documents),
copy_firsts AS (SELECT line, min(doc_id) AS doc1 FROM keyed GROUP BY line),
copy_pairs AS (
  SELECT f.doc1, k.doc_id AS doc2
  FROM keyed k JOIN copy_firsts f ON k.line = f.line WHERE k.doc_id <> f.doc1)"""

PAIRS = f"""{CASE_PAIRS},{COPY_PAIRS},
pairs AS (SELECT doc1, doc2 FROM case_pairs UNION SELECT doc1, doc2 FROM copy_pairs)"""

LABELLED = f"""{CASE_PAIRS},{COPY_PAIRS},
labelled AS (
  SELECT 'ir_plag' AS source_dataset, printf('c%02d', CAST(regexp_extract(source, '([0-9]+)', 1) AS INT)) AS case_id,
    doc1, doc2, quality AS label,
    CASE WHEN quality = 1 THEN 'level_' || (doc2 % 6 + 1) ELSE 'none' END AS plagiarism_level
  FROM case_pairs JOIN labels ON doc2 = doc_id
  UNION ALL
  SELECT 'conplag', printf('p%02d', doc1 % 20),
    doc1, doc2, quality, CASE WHEN quality = 1 THEN 'contest_level' ELSE 'none' END
  FROM copy_pairs JOIN labels ON doc2 = doc_id),
pairs AS (SELECT DISTINCT doc1, doc2 FROM labelled)"""

UNCOMMENTED = r"regexp_replace(regexp_replace({0}, '//[^\n]*\n', chr(10), 'g'), '(?s)/\*.*?\*/', '', 'g')"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def gram_subqueries(text: str) -> str:
    """``tf (doc_id, gram, tf)`` of all documents."""
    return f"""
word_lists AS (SELECT doc_id, {WORDS.format(text)} AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(w) AS gram FROM word_lists
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM word_lists
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM word_lists),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY doc_id, gram)"""


TFIDF = f"""{gram_subqueries(UNCOMMENTED.format("text"))},
pair_grams AS (
  SELECT doc1, doc2, gram, sum(x) AS x, sum(y) AS y FROM (
    SELECT doc1, doc2, gram, tf AS x, 0 AS y FROM pairs JOIN tf ON doc_id = doc1
    UNION ALL
    SELECT doc1, doc2, gram, 0, tf FROM pairs JOIN tf ON doc_id = doc2)
  GROUP BY doc1, doc2, gram),
weighted AS (
  SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM pair_grams),
cosines AS (
  SELECT doc1, doc2, sum(x * y * idf * idf) / (sqrt(sum(x * x * idf * idf)) * sqrt(sum(y * y * idf * idf))) AS cosine
  FROM weighted GROUP BY doc1, doc2 HAVING sum(x) > 0 AND sum(y) > 0),
tfidf AS (
  SELECT p.doc1, p.doc2, coalesce(cosine, 0) AS tfidf_similarity
  FROM pairs p LEFT JOIN cosines c ON p.doc1 = c.doc1 AND p.doc2 = c.doc2)"""

TEXT_NODES = rf"""
tree_lines AS (
  SELECT doc_id, number, line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, number)
  WHERE regexp_matches(line, '[\p{{L}}\p{{N}}_]')),
tree_sentences AS (
  SELECT doc_id, number, place, {WORDS.format("sentence")} AS w
  FROM tree_lines, unnest(regexp_extract_all(line, '[^.!?]+')) WITH ORDINALITY AS u(sentence, place)),
tree_words AS (
  SELECT doc_id, number, place, spot,
    CASE WHEN length(word) <= 3 THEN 'word_short' WHEN length(word) < 8 THEN 'word_middle' ELSE 'word_long' END AS kind,
    CASE WHEN length(word) <= 3 THEN 10 WHEN length(word) < 8 THEN 15 ELSE 20 END AS hash
  FROM tree_sentences, unnest(w) WITH ORDINALITY AS u(word, spot)),
sentence_nodes AS (
  SELECT doc_id, number, place, count(*) AS children, 50 + sum(hash) AS hash
  FROM tree_words GROUP BY doc_id, number, place),
line_nodes AS (
  SELECT doc_id, number, count(*) AS children, 100 + sum(hash) AS hash FROM sentence_nodes GROUP BY doc_id, number),
document_nodes AS (
  SELECT doc_id, count(*) AS children, 200 + sum(hash) AS hash FROM line_nodes GROUP BY doc_id),
placed_nodes AS (
  SELECT doc_id, 0 AS a, 0 AS b, 0 AS c, 'document' AS node_type, children, hash, 1 AS line_number FROM document_nodes
  UNION ALL SELECT doc_id, number, 0, 0, 'line', children, hash, number FROM line_nodes
  UNION ALL SELECT doc_id, number, place, 0, 'sentence', children, hash, number FROM sentence_nodes
  UNION ALL SELECT doc_id, number, place, spot, kind, 0, hash, number FROM tree_words),
nodes AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) - 1 AS INT) AS position,
    node_type, CAST(children AS INT) AS num_children, CAST(hash AS BIGINT) AS hash_value,
    CAST(line_number AS INT) AS line_number
  FROM placed_nodes)"""


ODD_TAGS = """chr(10) || '<my-tag><x:y' || chr(10) || 'a=''1''></X:Y>' || chr(10) || chr(10) || '<h1 /></my-tag>'"""


def tag_nodes(cutting: str = "false") -> str:
    """``nodes`` of the pages by comparing each element with all later ones of its page."""
    return rf"""
cleaned AS (
  SELECT page_id AS doc_id, regexp_replace(html || {ODD_TAGS},
    '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS html FROM pages),
spots AS (
  SELECT doc_id, seq, tag, string_split_regex(html, '</?[a-zA-Z][^>]*>')[seq] AS lead_in
  FROM cleaned, unnest(regexp_extract_all(html, '</?[a-zA-Z][^>]*>')) WITH ORDINALITY AS u(tag, seq)),
tags AS (
  SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][^\s/>]*)', 1)) AS node_type, starts_with(tag, '</') AS is_end,
    1 + sum(length(lead_in || tag) - length(replace(lead_in || tag, chr(10), ''))) OVER (
      PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
      - (length(tag) - length(replace(tag, chr(10), ''))) AS line_number
  FROM spots),
kinds AS (
  SELECT *, node_type IN ('p', 'b', 'br', 'meta', 'img', 'hr', 'input', 'link') OR suffix(tag, '/>') AS is_void
  FROM tags),
deep AS (
  SELECT *, sum(CASE WHEN is_end THEN -1 WHEN is_void THEN 0 ELSE 1 END) OVER (
      PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + CASE WHEN is_void THEN 1 ELSE 0 END AS depth
  FROM kinds WHERE NOT (is_end AND is_void)),
elements AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS position, depth, node_type, line_number,
    CASE node_type WHEN 'html' THEN 200 WHEN 'body' THEN 100 WHEN 'article' THEN 60 WHEN 'div' THEN 50
      WHEN 'nav' THEN 40 WHEN 'ul' THEN 30 WHEN 'li' THEN 20 WHEN 'p' THEN 15 WHEN 'a' THEN 10 ELSE 5 END AS base
  FROM deep WHERE NOT is_end),
ends AS (
  SELECT e.doc_id, e.position, e.depth, e.node_type, e.base, e.line_number,
    coalesce(min(l.position), 1000000000) AS stop
  FROM elements e LEFT JOIN elements l
    ON l.doc_id = e.doc_id AND l.position > e.position AND l.depth <= e.depth
  GROUP BY e.doc_id, e.position, e.depth, e.node_type, e.base, e.line_number),
hidden AS (
  SELECT o.doc_id, o.position AS root, x.position AS inner_position, bool_or(c.position IS NOT NULL) AS is_hidden
  FROM ends o
  JOIN elements x ON x.doc_id = o.doc_id AND x.position >= o.position AND x.position < o.stop
  LEFT JOIN ends c ON c.doc_id = o.doc_id AND ({cutting})
    AND c.position >= o.position AND c.position < x.position AND x.position < c.stop
  GROUP BY o.doc_id, o.position, x.position),
nodes AS (
  SELECT o.doc_id, CAST(o.position AS INT) AS position, o.node_type, CAST(o.depth AS INT) AS depth,
    CAST(o.line_number AS INT) AS line_number,
    CAST(count(*) FILTER (WHERE x.depth = o.depth + 1) AS INT) AS num_children,
    CAST(sum(CASE WHEN h.is_hidden THEN 0 ELSE x.base END) AS BIGINT) AS hash_value
  FROM ends o
  JOIN elements x ON x.doc_id = o.doc_id AND x.position >= o.position AND x.position < o.stop
  JOIN hidden h ON h.doc_id = o.doc_id AND h.root = o.position AND h.inner_position = x.position
  GROUP BY o.doc_id, o.position, o.node_type, o.depth, o.line_number)"""


HOST_PAIRS = """
hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
host_firsts AS (SELECT host, min(page_id) AS doc1 FROM hosts GROUP BY host),
pairs AS (
  SELECT f.doc1, h.page_id AS doc2 FROM hosts h JOIN host_firsts f ON h.host = f.host WHERE h.page_id <> f.doc1)"""


def match_subqueries(leaf_rule: str, ids: str) -> str:
    """``matches`` of ``pairs`` over ``nodes``: count the common copies of each node."""
    leaf = "sum(common)" if leaf_rule == "all" else "sum(common) FILTER (WHERE num_children > 0)"
    once = "0" if leaf_rule == "all" else "max(CASE WHEN num_children = 0 AND common > 0 THEN 1 ELSE 0 END)"
    return f"""
shape_counts AS (
  SELECT doc_id, num_children, hash_value, count(*) AS n FROM nodes GROUP BY doc_id, num_children, hash_value),
commons AS (
  SELECT doc1, doc2, a.num_children, least(a.n, b.n) AS common
  FROM pairs JOIN shape_counts a ON a.doc_id = doc1
  JOIN shape_counts b ON b.doc_id = doc2 AND b.num_children = a.num_children AND b.hash_value = a.hash_value),
common_sums AS (
  SELECT doc1, doc2, coalesce({leaf}, 0) + coalesce({once}, 0) AS common_nodes FROM commons GROUP BY doc1, doc2),
node_totals AS (SELECT i.id, count(n.doc_id) AS total FROM ({ids}) i LEFT JOIN nodes n ON n.doc_id = i.id GROUP BY i.id),
matches AS (
  SELECT p.doc1, p.doc2, CAST(coalesce(common_nodes, 0) AS BIGINT) AS similar_nodes,
    CAST(a.total AS BIGINT) AS nodes1, CAST(b.total AS BIGINT) AS nodes2,
    CASE WHEN a.total > 0 AND b.total > 0 THEN 2.0::DOUBLE * coalesce(common_nodes, 0) / (a.total + b.total) ELSE 0 END
      AS structure_similarity
  FROM pairs p JOIN node_totals a ON a.id = p.doc1 JOIN node_totals b ON b.id = p.doc2
  LEFT JOIN common_sums c ON c.doc1 = p.doc1 AND c.doc2 = p.doc2)"""


DOC_IDS = "SELECT doc_id AS id FROM documents"
PAGE_IDS = "SELECT page_id AS id FROM pages"

def compared_by(leaf_rule: str) -> str:
    return f"""{LABELLED},{TFIDF},{TEXT_NODES},{match_subqueries(leaf_rule, DOC_IDS)},
compared AS (
  SELECT *, tfidf_prediction = label AS tfidf_correct, structure_prediction = label AS structure_correct,
    tfidf_prediction = label AND structure_prediction = label AS both_correct,
    tfidf_prediction <> label AND structure_prediction <> label AS both_wrong
  FROM (
    SELECT l.*, t.tfidf_similarity, m.structure_similarity,
      CASE WHEN t.tfidf_similarity >= 0.45 THEN 1 ELSE 0 END AS tfidf_prediction,
      CASE WHEN m.structure_similarity >= 0.45::DOUBLE THEN 1 ELSE 0 END AS structure_prediction
    FROM labelled l JOIN tfidf t USING (doc1, doc2) JOIN matches m USING (doc1, doc2)))"""


COMPARED = compared_by("all")
COMPARED_FIELDS = """source_dataset, doc1, doc2, label, round(tfidf_similarity, 6) AS tfidf_similarity,
  round(structure_similarity, 6) AS structure_similarity, tfidf_prediction, structure_prediction,
  tfidf_correct, structure_correct, both_correct, both_wrong"""

SCORED = f"""{LABELLED},{TFIDF},
scored AS (
  SELECT l.*, round(t.tfidf_similarity, 6) AS score,
    CASE WHEN t.tfidf_similarity >= 0.45 THEN 1 ELSE 0 END AS prediction
  FROM labelled l JOIN tfidf t USING (doc1, doc2))"""

COUNTS = """
counts AS (
  SELECT count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn,
    count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn FROM scored)"""

SPLIT = f"""{LABELLED},
digests AS (
  SELECT *, md5(concat_ws('|', '42', source_dataset, CAST(doc1 AS VARCHAR), CAST(doc2 AS VARCHAR))) AS digest
  FROM labelled),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_dataset, label ORDER BY digest, source_dataset, doc1, doc2) AS rn,
    count(*) OVER (PARTITION BY source_dataset, label) AS n FROM digests),
split_rows AS (
  SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM ranked)"""

HEX = "printf('%08x', {0})"
FOLDERS = f"""
contest AS (
  SELECT *, CASE WHEN doc2 % 2 = 1 THEN {HEX.format("doc2")} || '_' || {HEX.format("doc1")}
    ELSE {HEX.format("doc1")} || '_' || {HEX.format("doc2")} END AS folder_name
  FROM copy_pairs)"""

MANIFEST = f"""{CASE_PAIRS},{COPY_PAIRS},{FOLDERS},
versions AS (
  SELECT c.doc1, c.doc2, CAST(regexp_extract(c.source, '([0-9]+)', 1) AS INT) AS case_number,
    CASE WHEN quality = 1 THEN doc2 % 6 + 1 ELSE 0 END AS level
  FROM case_pairs c JOIN labels l ON l.doc_id = c.doc2),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY case_number, level ORDER BY doc2) AS version_number FROM versions),
graded AS (
  SELECT CASE WHEN level = 0 THEN printf('c%02d_orig_np%02d', case_number, version_number)
      ELSE printf('c%02d_orig_L%d_', case_number, level) END AS folder_start,
    printf('c%02d', case_number) AS case_id, printf('case-%02d', case_number) AS case_orig, *
  FROM numbered),
manifest AS (
  SELECT CASE WHEN level = 0 THEN folder_start
      ELSE rtrim(folder_start, '_') || printf('v%02d', version_number) END AS folder_name,
    case_id, case_orig, 'original.java' AS file1, 'compared.java' AS file2,
    CASE WHEN level = 0 THEN 0 ELSE 1 END AS label,
    CASE WHEN level = 0 THEN 'none' ELSE 'level_' || level END AS plagiarism_level, 'ir_plag' AS source_dataset,
    CASE WHEN level = 0 THEN 'original_vs_nonplagiarized' ELSE 'original_vs_l' || level END AS comparison_type,
    case_number AS order1, level AS order2, doc2 AS order3, doc1, doc2
  FROM graded
  UNION ALL
  SELECT folder_name, printf('p%02d', doc1 % 20), 'problem-' || (doc1 % 20),
    split_part(folder_name, '_', 1) || '.java', split_part(folder_name, '_', 2) || '.java', quality,
    CASE WHEN quality = 1 THEN 'contest_level' ELSE 'none' END, 'conplag', 'contest_submission_pair',
    CAST('0x' || substr(md5(folder_name), 1, 8) AS BIGINT), 0, 0, doc1, doc2
  FROM contest JOIN labels ON doc_id = doc2)"""

MANIFEST_FIELDS = (
    "folder_name, case_id, case_orig, file1, file2, label, plagiarism_level, source_dataset, comparison_type"
)
GRADED_PATH = """'graded/' || case_orig || CASE WHEN level = 0 THEN '/non-plagiarized/'
    ELSE '/plagiarized/L' || level || '/' END || doc2 || '/' || doc2 || '.java'"""

KEY = "source_dataset, doc1, doc2"


def total_percent(part: str, whole: str = "count(*)") -> str:
    return f"round({part} * 100.0::DOUBLE / {whole}, 1)"


# --- one statement per query -----------------------------------------------------------

ORACLES: dict[str, str] = {
    "normalize_text": rf"""
SELECT page_id, trim(regexp_replace({UNCOMMENTED.format(
    "html || chr(10) || '// drop http://x.y' || chr(10) || 'keep /* a' || chr(10) || 'b */ tail /* open // end'"
    " || chr(10) || 'last // stays' || ' a' || chr(160) || 'b' || chr(8195) || ' c' || chr(8232) || chr(29)"
    " || chr(12288) || 'd' || chr(8203) || 'e' || chr(11) || chr(133)")},
  '[\t\n\x0b\x0c\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+',
  ' ', 'g'), ' ') AS normalized FROM pages""",
    "tokenize_counts": f"""
SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words
FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM documents)""",
    "ngram_tf": f"WITH {gram_subqueries('text')} SELECT doc_id, gram, tf FROM tf",
    "ngram_df": f"""WITH {gram_subqueries('text')}
SELECT gram, CAST(sum(tf) AS BIGINT) AS corpus_frequency, count(*) AS document_frequency FROM tf GROUP BY gram""",
    "version_numbers": f"""WITH {MANIFEST}
SELECT case_orig, CAST(level AS INT) AS level, doc2 AS version, version_number, {GRADED_PATH} AS path FROM graded""",
    "label_lookup": f"""WITH {CASE_PAIRS},{COPY_PAIRS},{FOLDERS}
SELECT folder_name, CASE WHEN quality IS NOT NULL THEN CAST(doc1 % 20 AS INT) END AS problem, quality AS verdict
FROM contest LEFT JOIN labels ON doc_id = doc2""",
    "label_missing": f"""WITH {CASE_PAIRS},{COPY_PAIRS},{FOLDERS}
SELECT folder_name FROM contest WHERE doc2 NOT IN (SELECT doc_id FROM labels)""",
    "union_manifest": f"WITH {MANIFEST} SELECT {MANIFEST_FIELDS} FROM manifest",
    "manifest_csv_roundtrip": f"WITH {MANIFEST} SELECT {MANIFEST_FIELDS} FROM manifest",
    "pair_ids": f"""WITH {MANIFEST}
SELECT printf('pair_%06d', row_number() OVER (
  ORDER BY source_dataset = 'conplag', order1, order2, order3, folder_name)) AS pair_id, folder_name FROM manifest""",
    "pair_resolve": f"""WITH {MANIFEST}
SELECT folder_name, folder_name AS folder,
  CASE WHEN source_dataset = 'ir_plag' THEN 'graded/' || case_orig || '/Original/' || doc1 || '.java'
    ELSE 'contest/' || folder_name || '/' || least(file1, file2) END AS path1,
  CASE WHEN source_dataset = 'conplag' THEN 'contest/' || folder_name || '/' || greatest(file1, file2)
    WHEN order2 = 0 THEN 'graded/' || case_orig || '/non-plagiarized/' || doc2 || '/' || doc2 || '.java'
    ELSE 'graded/' || case_orig || '/plagiarized/L' || order2 || '/' || doc2 || '/' || doc2 || '.java' END AS path2
FROM manifest""",
    "pair_verify": f"""WITH {MANIFEST}
SELECT folder_name, CASE WHEN source_dataset = 'ir_plag' THEN 'carpeta no existe'
  WHEN doc1 NOT IN (SELECT doc_id FROM labels) THEN 'archivos faltantes' END AS problem
FROM manifest""",
    "source_counts": f"""WITH {MANIFEST}
SELECT source_dataset, count(*) AS folders, count(*) AS with_two_files FROM manifest GROUP BY source_dataset""",
    "manifest_profile": f"""WITH {LABELLED},
profile AS (
  SELECT 'all' AS part, 'all' AS name, label FROM labelled
  UNION ALL SELECT 'source', source_dataset, label FROM labelled
  UNION ALL SELECT 'level', plagiarism_level, label FROM labelled WHERE label = 1)
SELECT part, name, count(*) AS pairs, count(*) FILTER (WHERE label = 1) AS positives,
  {total_percent("count(*) FILTER (WHERE label = 1)")} AS positive_pct
FROM profile GROUP BY part, name""",
    "seeded_shuffle": f"""WITH {SPLIT}
SELECT {KEY}, row_number() OVER (ORDER BY digest, {KEY}) AS shuffle_rank FROM digests""",
    "stratified_split": f"WITH {SPLIT} SELECT {KEY}, label, split FROM split_rows",
    "split_order": f"""WITH {SPLIT},
own AS (
  SELECT *, md5(concat_ws('|', CASE split WHEN 'train' THEN '42' WHEN 'validation' THEN '43' ELSE '44' END,
    source_dataset, CAST(doc1 AS VARCHAR), CAST(doc2 AS VARCHAR))) AS own_digest FROM split_rows)
SELECT {KEY}, split, row_number() OVER (PARTITION BY split ORDER BY own_digest, {KEY}) AS row_in_split FROM own""",
    "simple_split": f"""WITH {SPLIT},
overall AS (SELECT *, row_number() OVER (ORDER BY digest, {KEY}) AS place, count(*) OVER () AS size FROM digests)
SELECT {KEY}, CASE WHEN place <= floor(size * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM overall""",
    "split_profile": f"""WITH {SPLIT}
SELECT split, count(*) AS pairs,
  count(*) FILTER (WHERE label = 1) AS positives,
  {total_percent("count(*) FILTER (WHERE label = 1)")} AS positive_pct,
  count(*) FILTER (WHERE label <> 1) AS negatives,
  {total_percent("count(*) FILTER (WHERE label <> 1)")} AS negative_pct,
  count(*) FILTER (WHERE source_dataset = 'ir_plag') AS ir_plag,
  {total_percent("count(*) FILTER (WHERE source_dataset = 'ir_plag')")} AS ir_plag_pct,
  count(*) FILTER (WHERE source_dataset = 'conplag') AS conplag,
  {total_percent("count(*) FILTER (WHERE source_dataset = 'conplag')")} AS conplag_pct,
  count(DISTINCT case_id) AS cases
FROM split_rows GROUP BY split""",
    "split_levels": f"""WITH {SPLIT}
SELECT split, plagiarism_level, count(*) AS pairs FROM split_rows WHERE label = 1 GROUP BY split, plagiarism_level""",
    "split_shares": f"""WITH {SPLIT}
SELECT split, count(*) AS pairs, {total_percent("count(*)", "(SELECT count(*) FROM labelled)")} AS pairs_pct,
  (SELECT count(*) FROM labelled) AS total_pairs FROM split_rows GROUP BY split""",
    "split_partitioned_write": f"""WITH {SPLIT},
ends AS (SELECT split, doc1 AS doc_id FROM split_rows UNION SELECT split, doc2 FROM split_rows)
SELECT split, doc_id, length(text) AS length FROM ends JOIN documents USING (doc_id)""",
    "tfidf_pair_similarity": f"""WITH {PAIRS},{TFIDF}
SELECT doc1, doc2, round(tfidf_similarity, 6) AS tfidf_similarity FROM tfidf""",
    "tfidf_pair_decision": f"""WITH {PAIRS},{TFIDF}
SELECT doc1, doc2, CASE WHEN tfidf_similarity >= 0.45 THEN 1 ELSE 0 END AS tfidf_prediction FROM tfidf""",
    "text_tree_nodes": f"""WITH {TEXT_NODES}
SELECT doc_id, position, node_type, num_children, hash_value, line_number FROM nodes""",
    "tag_tree_nodes": f"""WITH {tag_nodes()}
SELECT doc_id, position, node_type, depth, num_children, hash_value, line_number FROM nodes""",
    "tag_tree_cut": f"""WITH {tag_nodes("c.node_type = 'ul'")} SELECT doc_id, position, hash_value FROM nodes""",
    "tag_tree_cut_some": f"""WITH {tag_nodes("c.node_type = 'ul' AND c.depth % 2 = 0")}
SELECT doc_id, position, hash_value FROM nodes""",
    "structural_match_count": f"""WITH {HOST_PAIRS},{tag_nodes()},{match_subqueries("once", PAGE_IDS)}
SELECT doc1, doc2, similar_nodes, nodes1, nodes2 FROM matches""",
    "structural_match_pairs": f"""WITH {HOST_PAIRS},{tag_nodes()},
turns AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, num_children, hash_value ORDER BY position) AS turn FROM nodes),
met AS (
  SELECT doc1, doc2, a.num_children, a.hash_value, a.position AS position1, b.position AS position2,
    row_number() OVER (PARTITION BY doc1, doc2, a.num_children ORDER BY a.hash_value, a.turn) AS place
  FROM pairs JOIN turns a ON a.doc_id = doc1
  JOIN turns b ON b.doc_id = doc2 AND b.num_children = a.num_children AND b.hash_value = a.hash_value AND b.turn = a.turn)
SELECT doc1, doc2, num_children, hash_value, position1, position2 FROM met WHERE num_children > 0 OR place = 1""",
    "structural_score": f"""WITH {HOST_PAIRS},{tag_nodes()},{match_subqueries("once", PAGE_IDS)}
SELECT doc1, doc2, round(structure_similarity, 6) AS structure_similarity,
  CASE WHEN structure_similarity >= 0.6::DOUBLE THEN 1 ELSE 0 END AS prediction FROM matches""",
    "structural_score_all_leaves": f"""WITH {HOST_PAIRS},{tag_nodes()},{match_subqueries("all", PAGE_IDS)}
SELECT doc1, doc2, round(structure_similarity, 6) AS structure_similarity FROM matches""",
    "text_structural_score": f"""WITH {PAIRS},{TEXT_NODES},{match_subqueries("once", DOC_IDS)}
SELECT doc1, doc2, similar_nodes, round(structure_similarity, 6) AS structure_similarity FROM matches""",
    "compare_methods": f"WITH {COMPARED} SELECT {COMPARED_FIELDS} FROM compared",
    "compare_methods_once": f"WITH {compared_by('once')} SELECT {COMPARED_FIELDS} FROM compared",
    "agreement": f"""WITH {COMPARED}
SELECT count(*) AS pairs,
  round(avg(CAST(tfidf_correct AS INT)), 6) AS tfidf_accuracy,
  round(avg(CAST(structure_correct AS INT)), 6) AS structure_accuracy,
  count(*) FILTER (WHERE both_correct) AS both_correct,
  round(avg(CAST(both_correct AS INT)), 6) AS both_correct_share,
  count(*) FILTER (WHERE both_wrong) AS both_wrong,
  round(avg(CAST(both_wrong AS INT)), 6) AS both_wrong_share
FROM compared""",
    "score_stats": f"""WITH {SCORED}
SELECT source_dataset, label, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS std, count(*) AS pairs
FROM scored GROUP BY source_dataset, label""",
    "label_means": f"""WITH {SCORED}
SELECT round(avg(score) FILTER (WHERE label = 1), 3) AS mean_positive,
  round(avg(score) FILTER (WHERE label = 0), 3) AS mean_negative FROM scored""",
    "confusion": f"""WITH {SCORED},
cells AS (
  SELECT * FROM (SELECT DISTINCT source_dataset FROM scored), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction))
SELECT c.source_dataset, c.label, c.prediction, count(s.label) AS pairs
FROM cells c LEFT JOIN scored s
  ON s.source_dataset = c.source_dataset AND s.label = c.label AND s.prediction = c.prediction
GROUP BY c.source_dataset, c.label, c.prediction""",
    "class_report": f"""WITH {SCORED},
classes AS (
  SELECT k.c, count(*) FILTER (WHERE label = k.c) AS support, count(*) FILTER (WHERE prediction = k.c) AS predicted,
    count(*) FILTER (WHERE label = k.c AND prediction = k.c) AS hits, count(*) AS total
  FROM scored, (VALUES (0), (1)) k(c) GROUP BY k.c),
rated AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM classes),
complete AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rated)
SELECT CASE c WHEN 0 THEN 'No Plagio' ELSE 'Plagio' END AS class, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f, 6) AS f1, support FROM complete
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / max(total), 6), max(total) FROM complete
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), max(total) FROM complete
UNION ALL SELECT 'weighted avg', round(sum(support * p) / max(total), 6), round(sum(support * r) / max(total), 6),
  round(sum(support * f) / max(total), 6), max(total) FROM complete""",
    "accuracy": f"""WITH {SCORED}
SELECT source_dataset, round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
  count(*) AS pairs FROM scored GROUP BY source_dataset""",
    "roc_auc": f"""WITH {SCORED},
ranks AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored),
sums AS (
  SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
    sum(r) FILTER (WHERE label = 1) AS rank_sum FROM ranks)
SELECT positives, negatives,
  round((rank_sum - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auc FROM sums""",
    "roc_curve": f"""WITH {SCORED},
steps AS (
  SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM scored GROUP BY score),
running AS (
  SELECT score, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, row_number() OVER down AS place,
    lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM steps WINDOW down AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score AS threshold, round(fp / all_neg, 6) AS fpr, round(tp / all_pos, 6) AS tpr FROM running
WHERE place = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT NULL, 0, 0""",
}

BY_MANIFEST = f"""{compared_by('once')},{MANIFEST.removeprefix(f"{CASE_PAIRS},{COPY_PAIRS},")},
by_manifest AS (
  SELECT m.folder_name AS folder, m.file1, m.file2, m.label, m.source_dataset AS dataset, similar_nodes,
    c.* EXCLUDE (source_dataset, case_id, doc1, doc2, label, plagiarism_level)
  FROM manifest m JOIN compared c USING (source_dataset, doc1, doc2) JOIN matches USING (doc1, doc2))"""
ORACLES["manifest_scores"] = f"""WITH {BY_MANIFEST}
SELECT folder, file1, file2, label, dataset, round(structure_similarity, 6) AS structure_score, similar_nodes,
  CASE WHEN structure_similarity >= 0.6::DOUBLE THEN 1 ELSE 0 END AS prediction FROM by_manifest"""
ORACLES["manifest_compare"] = f"""WITH {BY_MANIFEST}
SELECT folder, file1, file2, label, dataset, round(tfidf_similarity, 6) AS tfidf_similarity,
  round(structure_similarity, 6) AS structure_similarity, tfidf_prediction, structure_prediction,
  tfidf_correct, structure_correct, both_correct, both_wrong FROM by_manifest"""
ORACLES["predictions_roundtrip"] = f"""WITH {SCORED}
SELECT label AS TrueLabel, prediction AS Predicted, score AS Probability FROM scored"""

HYBRID = f"""{COMPARED},
weights AS (SELECT i / 10.0::DOUBLE AS weight FROM range(0, 11) r(i)),
decided AS (
  SELECT weight, label, CASE WHEN weight * tfidf_similarity + (1 - weight) * structure_similarity >= 0.45::DOUBLE
    THEN 1 ELSE 0 END AS prediction FROM compared, weights),
counts AS (
  SELECT weight, count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn,
    count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn FROM decided GROUP BY weight),
rated AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM counts),
grid AS (
  SELECT weight, tp, tn, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
    round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM rated)"""

ORACLES["hybrid_weights"] = f"""WITH {HYBRID}
SELECT weight, tp, tn, fp, fn, precision, recall, f1, accuracy FROM grid"""
ORACLES["hybrid_best"] = f"WITH {HYBRID} SELECT weight, f1 FROM grid ORDER BY f1 DESC, weight LIMIT 1"

ORACLES["corpus_tfidf_top"] = f"""WITH {gram_subqueries('text')},
vocabulary AS (
  SELECT gram FROM tf GROUP BY gram
  ORDER BY sum(tf) DESC, len(string_split(gram, ' ')), gram LIMIT 5000),
frequencies AS (SELECT gram, count(*) AS df FROM tf JOIN vocabulary USING (gram) GROUP BY gram),
raw AS (
  SELECT doc_id, gram, tf, df,
    tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w
  FROM tf JOIN frequencies USING (gram))
SELECT doc_id, gram, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


# --- classifier: the same regression solved in its dual form -----------------------------
#
# The minimum of the log losses' sum plus half the squared coefficients is a
# combination of the training rows, so the coefficients are ``sum(a_i x_i)``. One
# row of the recursion holds all ``a`` and the intercept; a step follows the
# gradient. K is the matrix of the rows' products.

LR_STEPS = 6000
LR = rf"""{SPLIT},
texts AS (
  SELECT row_number() OVER (ORDER BY source_dataset, doc1, doc2) AS id, s.source_dataset, s.doc1, s.doc2, label, split,
    regexp_extract_all(lower(a.text || ' [SEP] ' || b.text), '[\p{{L}}\p{{N}}_]+') AS w
  FROM split_rows s JOIN documents a ON a.doc_id = s.doc1 JOIN documents b ON b.doc_id = s.doc2),
text_grams AS (
  SELECT id, split, unnest(w) AS gram FROM texts
  UNION ALL
  SELECT id, split, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
  UNION ALL
  SELECT id, split, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM texts),
text_tf AS (SELECT id, split, gram, count(*) AS tf FROM text_grams GROUP BY id, split, gram),
terms AS (
  SELECT gram, count(*) AS df FROM text_tf WHERE split = 'train' GROUP BY gram
  ORDER BY sum(tf) DESC, len(string_split(gram, ' ')), gram LIMIT 5000),
raw_features AS (
  SELECT id, gram, tf * (ln((1 + (SELECT count(*) FROM texts WHERE split = 'train'))::DOUBLE / (1 + df)) + 1) AS v
  FROM text_tf JOIN terms USING (gram)),
features AS (SELECT id, gram, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM raw_features),
train AS (SELECT id, row_number() OVER (ORDER BY id) AS nth, label FROM texts WHERE split = 'train'),
products AS (
  SELECT x.id, t.nth, sum(x.v * y.v) AS k FROM features y JOIN train t ON t.id = y.id JOIN features x ON x.gram = y.gram
  GROUP BY x.id, t.nth),
kernel AS (
  SELECT i.id, list(coalesce(k, 0) ORDER BY t.nth) AS k
  FROM texts i CROSS JOIN train t LEFT JOIN products p ON p.id = i.id AND p.nth = t.nth GROUP BY i.id),
problem AS (
  SELECT (SELECT list(k ORDER BY nth) FROM kernel JOIN train USING (id)) AS m,
    (SELECT list(label::DOUBLE ORDER BY nth) FROM train) AS y, 1.9::DOUBLE / (count(*) / 4 + 1) AS pace FROM train),
RECURSIVE_PLACE
solved AS (SELECT a, b FROM steps ORDER BY step DESC LIMIT 1),
predicted AS (
  SELECT t.*, 1 / (1 + exp(-(list_dot_product(k, a) + b))) AS p FROM texts t JOIN kernel USING (id), solved)"""
LR_PENALIZED = LR.replace("list(coalesce(k, 0) ORDER BY t.nth)", "list(coalesce(k, 0) + 1 ORDER BY t.nth)").replace(
    "(count(*) / 4 + 1)", "(count(*) / 2 + 1)"
)
LR_SOLVER = (
    "RECURSIVE_PLACE",
    f"""steps(step, a, b) AS (
  SELECT 0, list_transform(y, lambda x: 0::DOUBLE), 0::DOUBLE FROM problem
  UNION ALL
  SELECT step + 1,
    list_transform(list_zip(a, gap), lambda z: z[1] - pace * (z[2] + z[1])), b - pace * list_sum(gap)
  FROM (
    SELECT step, a, b, pace,
      list_transform(list_zip(m, y), lambda r: 1 / (1 + exp(-(list_dot_product(r[1], a) + b))) - r[2]) AS gap
    FROM steps, problem WHERE step < {LR_STEPS})),""",
)
LR = LR.replace(*LR_SOLVER)
# A penalized intercept is a constant feature: the products grow by one, and no free intercept is left.
LR_PENALIZED = LR_PENALIZED.replace(*LR_SOLVER).replace("b - pace * list_sum(gap)", "b")
PREDICTION = "label AS TrueLabel, CAST(p > 0.5 AS INT) AS Predicted, round(p, 4) AS Probability"
ORACLES["lr_predictions"] = f"WITH RECURSIVE {LR} SELECT {KEY}, split, {PREDICTION} FROM predicted WHERE split <> 'train'"
ORACLES["lr_penalized_intercept"] = (
    f"WITH RECURSIVE {LR_PENALIZED} SELECT {KEY}, split, {PREDICTION} FROM predicted WHERE split <> 'train'"
)
ORACLES["model_roundtrip"] = f"WITH RECURSIVE {LR} SELECT {KEY}, {PREDICTION} FROM predicted WHERE split = 'test'"
ORACLES["feature_importance"] = f"""WITH RECURSIVE {LR},
coefficients AS (
  SELECT gram, sum(v * a[t.nth]) AS c FROM features JOIN train t USING (id), solved GROUP BY gram),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY sign(c) ORDER BY abs(c) DESC, gram) AS rank_in_sign
  FROM coefficients WHERE c <> 0)
SELECT gram AS feature, round(c, 3) AS coefficient, round(abs(c), 3) AS abs_coefficient, rank_in_sign
FROM ranks WHERE rank_in_sign <= 20"""
ORACLES["lr_summary"] = f"""WITH RECURSIVE {LR},
ranks AS (
  SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r
  FROM predicted WHERE split = 'test'),
area AS (
  SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg,
    sum(r) FILTER (WHERE label = 1) AS s FROM ranks)
SELECT 'Logistic Regression (TF-IDF n-grams)' AS "Método",
  (SELECT round(avg(CAST((p > 0.5) = (label = 1) AS INT)), 6) FROM predicted WHERE split = 'validation') AS Val_Accuracy,
  (SELECT round(avg(CAST((p > 0.5) = (label = 1) AS INT)), 6) FROM predicted WHERE split = 'test') AS Test_Accuracy,
  (SELECT round((s - pos * (pos + 1) / 2.0::DOUBLE) / nullif(pos * neg, 0), 6) FROM area) AS Test_AUC"""

# --- all similar pairs, by a plain join on shared grams --------------------------------


def shared_gram_join(wanted: str) -> str:
    """``cosines (doc1, doc2, cosine)`` of all pairs of ``tf`` that share a gram and are wanted."""
    return f"""
masses AS (SELECT doc_id, sum(tf * tf) AS mass FROM tf GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS doc1, b.doc_id AS doc2, sum(a.tf * a.tf) AS s1, sum(b.tf * b.tf) AS s2, sum(a.tf * b.tf) AS dot
  FROM tf a JOIN tf b ON a.gram = b.gram AND {wanted} GROUP BY 1, 2),
cosines AS (
  SELECT doc1, doc2, dot / sqrt(
    (s1 + pow(ln(1.5::DOUBLE) + 1, 2) * (m1.mass - s1)) * (s2 + pow(ln(1.5::DOUBLE) + 1, 2) * (m2.mass - s2))) AS cosine
  FROM met JOIN masses m1 ON m1.doc_id = doc1 JOIN masses m2 ON m2.doc_id = doc2)"""


CLASSES = f"""
sequences AS (
  SELECT doc_id, array_to_string({WORDS.format(UNCOMMENTED.format("text"))}, ' ') AS w
  FROM documents),
classes AS (
  SELECT doc_id, CASE WHEN coalesce(w, '') = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS first
  FROM sequences)"""
ORACLES["text_classes"] = f"WITH {CLASSES} SELECT doc_id, first FROM classes"
ORACLES["similar_documents"] = f"""WITH {CLASSES},
{gram_subqueries(UNCOMMENTED.format("text")).replace("FROM documents", "FROM documents SEMI JOIN (SELECT first AS doc_id FROM classes) USING (doc_id)")},
{shared_gram_join("a.doc_id < b.doc_id")}
SELECT doc1, doc2, round(cosine, 6) AS tfidf_similarity FROM cosines WHERE cosine >= 0.8"""
ORACLES["benchmark_matches"] = f"""WITH sides AS (
  SELECT -1 - item_id AS doc_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents),
{gram_subqueries(UNCOMMENTED.format("text")).replace("FROM documents", "FROM sides")},
{shared_gram_join("a.doc_id < 0 AND b.doc_id >= 0")}
SELECT -1 - doc1 AS item_id, doc2 AS doc_id, round(cosine, 6) AS tfidf_similarity FROM cosines WHERE cosine >= 0.45"""


# --- trees of source code, by intervals of tokens ---------------------------------------


def _sql_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _sql_statement(pattern: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"replace(replace({quoted}, '<w>', w[1]), '<n>', CAST(len(w) AS VARCHAR))"


CODE_TOKEN = TOKEN.replace("'", "''")
TYPE_END = "((regexp_matches({0}, '^[\\p{{L}}_$]') AND {0} NOT IN {1}) OR {0} IN (']', '>'))"
BEFORE = _sql_list(BEFORE_EXPRESSIONS)
NEVER = _sql_list(NEVER_CALLED)
WORD_START = "regexp_matches({0}, '^[\\p{{L}}_$]')"

NODE_BASES = "MAP {" + ", ".join(f"'{kind}': {value}" for kind, value in NODE_VALUES.items()) + "}"

CODE_NODES = f"""
code_sentences AS (
  SELECT doc_id, number, place, {WORDS.format("sentence")} AS w
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS l(line, number),
    unnest(regexp_extract_all(line, '[^.!?]+')) WITH ORDINALITY AS s(sentence, place)),
code_methods AS (
  SELECT doc_id, number, 'public int ' || arg_min(w[1], place) || '(int a, String b) {{' || chr(10) || string_agg(
      CASE {" ".join(f"WHEN len(w) % {len(CODE_STATEMENTS)} = {i} THEN {_sql_statement(p)}" for i, p in enumerate(CODE_STATEMENTS))} END,
      chr(10) ORDER BY place) || chr(10) || '}}' AS method
  FROM code_sentences WHERE len(w) > 0 GROUP BY doc_id, number),
code_files AS (
  SELECT d.doc_id, 'class D' || d.doc_id || ' {{' || chr(10) || coalesce(m.body, '') || chr(10)
    || CASE WHEN d.doc_id % {BROKEN_CODE[0]} = {BROKEN_CODE[1]} THEN '}}}}' ELSE '}}' END AS text
  FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(method, chr(10) ORDER BY number) AS body FROM code_methods GROUP BY doc_id) m
    ON d.doc_id = m.doc_id),
raw_tokens AS (
  SELECT doc_id, seq, token, gap FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{CODE_TOKEN}')) AS token,
      unnest(string_split_regex(text, '{CODE_TOKEN}')[:-2]) AS gap,
      unnest(range(len(regexp_extract_all(text, '{CODE_TOKEN}')))) AS seq
    FROM (SELECT doc_id, regexp_replace(text, '{ESCAPED}', '{ASIDE}', 'g') AS text FROM code_files))),
lined AS (
  SELECT doc_id, seq, token, 1 + sum(
      length(gap) - length(replace(gap, chr(10), '')) + length(token) - length(replace(token, chr(10), '')))
    OVER (PARTITION BY doc_id ORDER BY seq) - length(token) + length(replace(token, chr(10), '')) AS line
  FROM raw_tokens),
tokens AS (
  SELECT *, lag(token) OVER w AS p1, lag(token, 2) OVER w AS p2, lead(token) OVER w AS nx, lead(seq) OVER w AS nseq,
    sum(CASE WHEN token IN ('(', '[', '{{') THEN 1 WHEN token IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER w AS after
  FROM lined WHERE NOT regexp_matches(token, '^(//|/\\*)') WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
opened AS (SELECT doc_id, seq, token, after AS level, p1, p2 FROM tokens WHERE token IN ('(', '[', '{{')),
shut AS (SELECT doc_id, seq, token, after + 1 AS level, nx FROM tokens WHERE token IN (')', ']', '}}')),
brackets AS (
  SELECT o.doc_id, o.seq AS a, s.seq AS b, o.token, o.token || s.token AS pair, o.level, o.p1, o.p2
  FROM opened o ASOF LEFT JOIN shut s ON o.doc_id = s.doc_id AND o.level = s.level AND s.seq > o.seq),
broken AS (
  SELECT doc_id FROM tokens GROUP BY doc_id HAVING min(after) < 0 OR arg_max(after, seq) <> 0
  UNION SELECT doc_id FROM brackets WHERE pair NOT IN ('()', '[]', '{{}}')),
homes AS (
  SELECT t.*, coalesce(h.a, -1) AS home, h.b AS home_end, coalesce(h.token, '{{') AS home_token,
    coalesce(h.token = '(' AND {WORD_START.format("h.p1")} AND h.p1 NOT IN {NEVER} AND {TYPE_END.format("h.p2", BEFORE)}, false) AS in_header
  FROM (SELECT *, CASE WHEN token IN ('(', '[', '{{') THEN after - 1 ELSE after END AS own
        FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM broken)) t
  ASOF LEFT JOIN (SELECT * FROM brackets) h ON t.doc_id = h.doc_id AND t.own = h.level AND t.seq > h.a),
marked AS (
  SELECT *, home_token = '{{' AND (token = ';' OR (token = '}}' AND (nx IS NULL OR nx NOT IN {_sql_list(GOES_ON)}))) AS ends,
    {WORD_START.format("token")} AND {TYPE_END.format("p1", BEFORE)} AS named,
    token IN {_sql_list(BINARY)} AND (({WORD_START.format("p1")} AND p1 NOT IN {BEFORE}) OR regexp_matches(p1, '^["''0-9]') OR p1 IN (')', ']'))
      AND NOT (token = '<' AND coalesce(regexp_matches(nx, '^[\\p{{Lu}}>?]'), false))
      AND NOT (token = '>' AND (regexp_matches(p1, '^\\p{{Lu}}') OR p1 IN ('>', ']', '?'))) AS operates
  FROM homes),
parted AS (
  SELECT *, (count(*) FILTER (WHERE ends) OVER v) - CAST(ends AS INT) AS statement,
    (count(*) FILTER (WHERE ends OR token IN (',', ';')) OVER v) - CAST(ends OR token IN (',', ';') AS INT) AS stretch
  FROM marked WINDOW v AS (PARTITION BY doc_id, home ORDER BY seq)),
statements AS (
  SELECT doc_id, min(seq) FILTER (WHERE token <> ';') AS a,
    coalesce(max(seq) FILTER (WHERE ends), max(home_end) - 0.5, 1e9) AS b,
    CASE WHEN bool_or(token IN {_sql_list(CLASS_WORDS)}) THEN 'ClassDeclaration'
      WHEN arg_min(token, seq) FILTER (WHERE token <> ';') = 'if' THEN 'IfStatement'
      WHEN arg_min(token, seq) FILTER (WHERE token <> ';') = 'else' AND bool_or(token = 'if') THEN 'IfStatement'
      WHEN arg_min(token, seq) FILTER (WHERE token <> ';') = 'for' THEN 'ForStatement'
      WHEN arg_min(token, seq) FILTER (WHERE token <> ';') = 'while' THEN 'WhileStatement'
      WHEN bool_or(coalesce(token = '(' AND {WORD_START.format("p1")} AND p1 NOT IN {NEVER} AND {TYPE_END.format("p2", BEFORE)}, false)) THEN 'MethodDeclaration'
      WHEN bool_or(coalesce(named AND nx IN ('=', ';', ',', ':'), false)) THEN 'VariableDeclaration'
      WHEN bool_or(token IN {_sql_list(ASSIGNING)}) THEN 'Assignment' ELSE 'Statement' END AS kind
  FROM parted WHERE home_token = '{{' GROUP BY doc_id, home, statement HAVING bool_or(token <> ';')),
runs AS (
  SELECT doc_id, a, b, 0 AS layer, kind, false AS cut FROM statements
  UNION ALL
  SELECT t.doc_id, t.seq, k.b, 1, 'FunctionCall', false
  FROM parted t JOIN brackets k ON t.doc_id = k.doc_id AND k.token = '(' AND k.p1 = t.token
    AND k.a = t.nseq
  WHERE t.nx = '(' AND {WORD_START.format("t.token")} AND t.token NOT IN {NEVER} AND NOT coalesce({TYPE_END.format("t.p1", BEFORE)}, false)
  UNION ALL
  SELECT doc_id, seq, coalesce(min(seq) FILTER (WHERE ends OR token IN (',', ';')) OVER (PARTITION BY doc_id, home, stretch), home_end, 1e9),
    1, 'BinaryOperation', token IN {_sql_list(CUTTING_OPERATORS)}
  FROM parted QUALIFY operates),
leaves AS (
  SELECT doc_id, seq AS a, CASE WHEN regexp_matches(token, '^["''0-9]') OR token IN {_sql_list(LITERAL_WORDS)} THEN 'Literal'
      WHEN named AND nx IN (',', ')') AND in_header THEN 'Parameter' END AS kind
  FROM parted
  WHERE NOT coalesce(nx = '(' AND {WORD_START.format("token")} AND token NOT IN {NEVER} AND NOT coalesce({TYPE_END.format("p1", BEFORE)}, false), false)),
spans AS (
  SELECT doc_id, -1 AS a, 2e9 AS b, 0 AS layer, 'CompilationUnit' AS kind, false AS cut, 1 AS line
  FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM broken) GROUP BY doc_id
  UNION ALL SELECT r.doc_id, r.a, r.b, r.layer, r.kind, r.cut, t.line FROM runs r JOIN tokens t ON t.doc_id = r.doc_id AND t.seq = r.a
  UNION ALL SELECT l.doc_id, l.a, l.a, 1, l.kind, false, t.line
  FROM leaves l JOIN tokens t ON t.doc_id = l.doc_id AND t.seq = l.a WHERE l.kind IS NOT NULL),
valued AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, layer) - 1 AS position,
    coalesce({NODE_BASES}[kind], {OTHER_NODE_VALUE}) AS base
  FROM spans),
pairs_of_nodes AS (
  SELECT y.doc_id, y.position AS up, x.position AS down, x.base, y.cut
  FROM valued y JOIN valued x ON x.doc_id = y.doc_id AND x.position > y.position AND x.a <= y.b),
placed_nodes AS (
  SELECT v.doc_id, v.position, count(p.up) AS depth, count(p.up) FILTER (WHERE p.cut) AS cuts
  FROM valued v LEFT JOIN pairs_of_nodes p ON p.doc_id = v.doc_id AND p.down = v.position GROUP BY v.doc_id, v.position),
code_nodes AS (
  SELECT v.doc_id, CAST(v.position AS INT) AS position, any_value(v.kind) AS node_type, CAST(any_value(d.depth) AS INT) AS depth,
    CAST(count(p.down) FILTER (WHERE e.depth = d.depth + 1) AS INT) AS num_children,
    CAST(any_value(v.base) + CASE WHEN any_value(v.cut) THEN 0
      ELSE coalesce(sum(p.base) FILTER (WHERE e.cuts = d.cuts), 0) END AS BIGINT) AS hash_value,
    CAST(any_value(v.line) AS INT) AS line_number
  FROM valued v JOIN placed_nodes d ON d.doc_id = v.doc_id AND d.position = v.position
  LEFT JOIN pairs_of_nodes p ON p.doc_id = v.doc_id AND p.up = v.position
  LEFT JOIN placed_nodes e ON e.doc_id = v.doc_id AND e.position = p.down
  GROUP BY v.doc_id, v.position)"""
ORACLES["code_tree_nodes"] = f"""WITH {CODE_NODES}
SELECT doc_id, position, node_type, depth, num_children, hash_value, line_number FROM code_nodes"""
ORACLES["code_structural_score"] = f"""WITH {PAIRS},{CODE_NODES},
nodes AS (SELECT * FROM code_nodes),
{match_subqueries("once", DOC_IDS)}
SELECT doc1, doc2, similar_nodes, nodes1, nodes2, round(structure_similarity, 6) AS structure_similarity FROM matches"""


# --- ROC per group -------------------------------------------------------------------------

ORACLES["roc_auc_by_level"] = f"""WITH {SCORED},
placed AS (
  SELECT source_dataset, plagiarism_level, label, score FROM scored
  UNION ALL SELECT source_dataset, NULL, label, score FROM scored),
ranks AS (
  SELECT source_dataset, plagiarism_level, label, rank() OVER w
    + (count(*) OVER (PARTITION BY source_dataset, plagiarism_level, score) - 1) / 2.0::DOUBLE AS r
  FROM placed WINDOW w AS (PARTITION BY source_dataset, plagiarism_level ORDER BY score)),
sums AS (
  SELECT source_dataset, plagiarism_level, count(*) FILTER (WHERE label = 1) AS positives,
    count(*) FILTER (WHERE label = 0) AS negatives, sum(r) FILTER (WHERE label = 1) AS rank_sum
  FROM ranks GROUP BY ALL)
SELECT source_dataset, plagiarism_level, positives, negatives,
  round((rank_sum - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auc FROM sums"""
ORACLES["roc_curve_by_source"] = f"""WITH {SCORED},
steps AS (
  SELECT source_dataset, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM scored GROUP BY source_dataset, score),
running AS (
  SELECT source_dataset, score, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, row_number() OVER down AS place,
    lead(pos) OVER along AS next_pos, lead(neg) OVER along AS next_neg,
    sum(pos) OVER (PARTITION BY source_dataset) AS all_pos, sum(neg) OVER (PARTITION BY source_dataset) AS all_neg
  FROM steps WINDOW along AS (PARTITION BY source_dataset ORDER BY score DESC),
    down AS (PARTITION BY source_dataset ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT source_dataset, score AS threshold, round(fp / nullif(all_neg, 0), 6) AS fpr, round(tp / nullif(all_pos, 0), 6) AS tpr
FROM running WHERE place = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT source_dataset, NULL, CASE WHEN all_neg > 0 THEN 0 END, CASE WHEN all_pos > 0 THEN 0 END
FROM running WHERE place = 1"""


# --- files, lists and samples ----------------------------------------------------------------

ORACLES["file_scores"] = ORACLES["code_structural_score"].replace(
    "nodes AS (SELECT * FROM code_nodes)",
    f"nodes AS (SELECT * FROM code_nodes WHERE doc_id % {BROKEN_BYTES[0]} <> {BROKEN_BYTES[1]})",
)
ORACLES["file_rejects"] = f"""
SELECT doc_id, CASE WHEN doc_id % {BROKEN_BYTES[0]} = {BROKEN_BYTES[1]} THEN 'not UTF-8' ELSE 'no tree' END AS problem
FROM documents WHERE doc_id % {BROKEN_BYTES[0]} = {BROKEN_BYTES[1]} OR doc_id % {BROKEN_CODE[0]} = {BROKEN_CODE[1]}"""
ORACLES["problem_samples"] = f"""WITH verified AS ({ORACLES["pair_verify"]})
SELECT problem, CAST(nth AS INT) AS nth, folder_name FROM (
  SELECT problem, folder_name, row_number() OVER (PARTITION BY problem ORDER BY folder_name) AS nth
  FROM (SELECT DISTINCT problem, folder_name FROM verified WHERE problem IS NOT NULL))
WHERE nth <= 10"""
ORACLES["structural_match_lists"] = f"""WITH matched AS ({ORACLES["structural_match_pairs"]})
SELECT doc1, doc2, count(*) AS nodes, md5(string_agg(
    concat_ws(':', num_children, hash_value, position1, position2), ','
    ORDER BY num_children, hash_value, position1, position2)) AS digest
FROM matched GROUP BY doc1, doc2"""
ORACLES["training_texts"] = f"""WITH numbered_pairs AS ({ORACLES["pair_ids"]}),
texts_of_pairs AS (
  WITH {MANIFEST}
  SELECT m.folder_name, m.label, CASE WHEN m.source_dataset = 'conplag' AND m.doc2 % 2 = 1
      THEN b.text || ' [SEP] ' || a.text ELSE a.text || ' [SEP] ' || b.text END AS text
  FROM manifest m JOIN documents a ON a.doc_id = m.doc1 JOIN documents b ON b.doc_id = m.doc2)
SELECT pair_id, label, length(text) AS length, md5(text) AS digest
FROM numbered_pairs JOIN texts_of_pairs USING (folder_name)"""


# --- both similarities and the classifier ------------------------------------------------------


def out_of_fold(fold: int) -> str:
    """Probabilities of one fold's training rows by the regression of the other folds."""
    own = LR.replace(
        "FROM split_rows s JOIN",
        f"""FROM (
    SELECT * EXCLUDE (split), CASE WHEN split <> 'train' THEN 'none' WHEN place % 3 = {fold} THEN 'held' ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY digest, source_dataset, doc1, doc2) AS place
          FROM split_rows)) s JOIN""",
    )
    return f"SELECT * FROM (WITH RECURSIVE {own} SELECT {KEY}, label, p FROM predicted WHERE split = 'held')"


ORACLES["hybrid_three_way"] = f"""WITH {COMPARED},
out_of_fold AS ({" UNION ALL ".join(out_of_fold(fold) for fold in range(3))}),
points AS (
  SELECT a.w AS tfidf, b.w AS structure, 10 - a.w - b.w AS classifier
  FROM range(11) a(w), range(11) b(w) WHERE a.w + b.w <= 10),
decided AS (
  SELECT tfidf, structure, classifier, o.label,
    CAST((tfidf * tfidf_similarity + structure * structure_similarity + classifier * p) / 10 >= 0.45::DOUBLE AS INT) AS prediction
  FROM out_of_fold o JOIN compared c USING (source_dataset, doc1, doc2), points),
cells AS (
  SELECT tfidf, structure, classifier, count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn, count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn FROM decided GROUP BY ALL)
SELECT CAST(tfidf AS INT) AS tfidf, CAST(structure AS INT) AS structure, CAST(classifier AS INT) AS classifier, tp, tn, fp, fn,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy
FROM cells"""
