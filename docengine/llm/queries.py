"""The queries of the training-data operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, chat_format, collocations, decontaminate, language_id, merkle, mixing, ngram_join, quality_rules, substring_dedup, suffix_dedup, url_filters, warc
from docengine.llm.common import table

URL_RULES = (
    url_filters.Rule("block", "net/"), url_filters.Rule("allow", "example.net/en/"),
    url_filters.Rule("block", "example.com/de/"), url_filters.Rule("allow", "org/fr/"),
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file of that name, where the box keeps them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), tri AS (
  SELECT doc_id, ws, i, [ws[i], ws[i + 1], ws[i + 2]] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(table(spark, sf_dir, "documents")))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(list_aggregate(ws[i:i + 34], 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), word AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM d
), gone AS (
  SELECT word.doc_id, w, j,
    max(CASE WHEN dup.i IS NOT NULL THEN dup.i END) OVER (PARTITION BY word.doc_id ORDER BY j) AS last_start
  FROM word LEFT JOIN dup ON word.doc_id = dup.doc_id AND word.j = dup.i
), kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (j - last_start < 35) AS removed,
    string_agg(w, ' ' ORDER BY j) FILTER (last_start IS NULL OR j - last_start >= 35) AS text
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.read_back(chat_format.format_conversations(rows.unionByName(own))))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, 23 + length(role) + length(text)
    + length(role || text) - length(replace(role || text, '\', ''))
    + 2 * (length(regexp_replace(role, '</s>|<s>|\[/INST\]|\[INST\]|<<SYS>>|<</SYS>>', '\0@', 'g')) - length(role))
    + 2 * (length(regexp_replace(text, '</s>|<s>|\[/INST\]|\[INST\]|<<SYS>>|<</SYS>>', '\0@', 'g')) - length(text)) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND arg_max(role, (turn, role, text)) IN ('assistant', 'user') AS valid
FROM e GROUP BY conv_id
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN md5(list_aggregate(ws, 'string_agg', ' ')) ELSE md5(list_aggregate(ws[i:i + 2], 'string_agg', ' ')) END AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(table(spark, sf_dir, "documents")))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE doc_id > least),
edge AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM dup),
part AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edge),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM part GROUP BY doc_id, run),
gap AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_b FROM span),
kept AS (
  SELECT d.doc_id, count(run) AS n_spans, coalesce(sum(b - a), 0) AS n_removed, any_value(h) AS h, coalesce(max(b), 0) AS tail,
    coalesce(string_agg(substr(h, CAST(2 * from_b + 1 AS BIGINT), CAST(2 * (a - from_b) AS BIGINT)), '' ORDER BY run), '') AS heads
  FROM d LEFT JOIN gap ON d.doc_id = gap.doc_id GROUP BY d.doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
  sha256(unhex(heads || substr(h, CAST(2 * tail + 1 AS BIGINT)))) AS kept_sha256
FROM kept
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1)), lambda a, x: a || x) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
), f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= 100 AND k > 1),
held AS (
  SELECT lang, s, max(f) AS longer FROM (SELECT lang, f, g[i:i + m - 1] AS s FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m) WHERE m < k AND i + m - 1 <= k) GROUP BY ALL
), o AS (SELECT c.* FROM c LEFT JOIN held ON c.lang = held.lang AND c.g = s WHERE longer IS NULL OR 100 * longer < 100 * f),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM o),
sc AS (
  SELECT cut.lang, cut.g, cut.f AS a, n.n, x.f AS l, y.f AS r, j, (1000 * CAST(cut.f AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN n ON n.lang = cut.lang JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:j] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[j + 1:cut.k]
), b AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
q AS (SELECT *, list_aggregate(g, 'string_agg', ' ') AS phrase FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM q QUALIFY rank <= 2000
"""


#: Weights of the sources in order of their names, repeating.
MIX_WEIGHTS = (3, 1, 2)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.cycled_weights(docs, MIX_WEIGHTS)).documents()


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 3) AS BIGINT) AS bucket
  FROM documents
), s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, row_number() OVER (ORDER BY skey) AS no FROM s0),
s2 AS (SELECT *, [3, 1, 2][CAST((no - 1) % 3 + 1 AS INTEGER)] AS weight FROM s1),
s3 AS (
  SELECT *, 150 * (sum(source_size) OVER ()) - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    100 * sum(weight) OVER (ORDER BY source_size / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM s2
), lvl AS (SELECT num, den FROM s3 WHERE weight * num <= 2 * source_size * den ORDER BY source_size / weight, no LIMIT 1),
s4 AS (SELECT no, skey, source_size, least(CAST(2 * source_size AS DOUBLE), CAST(weight * (SELECT num FROM lvl) AS DOUBLE) / CAST((SELECT den FROM lvl) AS DOUBLE)) AS target, (source_size + 63) // 64 AS blocks FROM s2),
s AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2 * blocks, CAST(floor(blocks * target / source_size + 0.5) AS BIGINT)) END AS slots FROM s4),
r AS (SELECT *, CAST(sum(slots) OVER (ORDER BY no) - slots AS BIGINT) AS lo, CAST(sum(slots) OVER () AS BIGINT) AS total FROM s),
slot AS (SELECT slot, CAST('0x' || substr(md5('7|slot|' || slot), 1, 15) AS BIGINT) % (SELECT max(total) FROM r) AS u FROM (SELECT unnest(range(0, (SELECT max(total) FROM r))) AS slot)),
draw AS (SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS j FROM slot JOIN r ON u >= lo AND u < lo + slots),
have AS (SELECT r.no, slots, coalesce(c, 0) AS c FROM r LEFT JOIN (SELECT no, count(*) AS c FROM draw GROUP BY no) x ON x.no = r.no),
moved AS (SELECT row_number() OVER (ORDER BY draw.no, j) AS q FROM draw JOIN have ON have.no = draw.no WHERE j >= slots),
free AS (SELECT no, j, row_number() OVER (ORDER BY no, j) AS q FROM (SELECT no, unnest(range(c, slots)) AS j FROM have WHERE slots > c)),
pick AS (SELECT draw.no, j FROM draw JOIN have ON have.no = draw.no WHERE j < slots UNION ALL SELECT free.no, free.j FROM moved JOIN free ON free.q = moved.q),
e AS (SELECT no, blocks, unnest([0, 1]) AS epoch FROM s WHERE blocks > 0),
k AS (
  SELECT no, epoch, list_transform(range(1, 25), lambda x: {
    'at': CAST('0x' || substr(md5('7|at|' || no || '|' || epoch || '|' || x), 1, 15) AS BIGINT) % blocks,
    'a': CAST('0x' || substr(md5('7|a|' || no || '|' || epoch || '|' || x), 1, 15) AS BIGINT) % 2147483646 + 1,
    'b': CAST('0x' || substr(md5('7|b|' || no || '|' || epoch || '|' || x), 1, 15) AS BIGINT) % 2147483647}) AS keys
  FROM e
), steps AS (SELECT pick.no, j // blocks AS epoch, blocks, j % blocks AS x FROM pick JOIN s ON s.no = pick.no),
done AS (SELECT no, block, count(*) AS times FROM (
  SELECT steps.no, list_reduce(list_prepend({'at': x, 'a': 0, 'b': 0}, keys), lambda z, y: {'at':
    CASE WHEN (greatest(z.at, (y.at + blocks - z.at) % blocks) % 2147483647 * y.a + y.b) % 2147483647 % 2 = 1 THEN (y.at + blocks - z.at) % blocks ELSE z.at END, 'a': 0, 'b': 0}).at AS block
  FROM steps JOIN k ON k.no = steps.no AND k.epoch = steps.epoch) GROUP BY ALL),
placed AS (
  SELECT d.*, s.no, s.source_size, s.target, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY bucket, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN s ON s.skey = d.skey
), part AS (SELECT *, unnest(range(CAST(pos // 64 AS BIGINT), CAST((pos + size - 1) // 64 + 1 AS BIGINT))) AS block FROM placed WHERE size > 0),
taken AS (SELECT id, sum((least((part.block + 1) * 64, pos + size) - greatest(part.block * 64, pos)) * times) AS taken FROM part JOIN done ON done.no = part.no AND done.block = part.block GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken ON taken.id = placed.id
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")))
    return made.prove().withColumnRenamed("id", "doc_id")


def _h(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({p} AS VARCHAR))) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


#: One step of a CRC-32 over a bit: the next byte comes in at every eighth.
_CRC_BIT = "CASE WHEN t % 8 = 0 THEN xor(z, ascii(substr(s, CAST(t // 8 + 1 AS BIGINT), 1))) ELSE z END"

OP13_SQL = f"""
WITH RECURSIVE named AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
sevenths AS (
  SELECT doc_id FROM named WHERE xor(list_reduce(list_prepend(4294967295, range(0, 8 * length(s))), lambda z, t:
    CASE WHEN ({_CRC_BIT}) & 1 = 1 THEN xor(({_CRC_BIT}) >> 1, 3988292384) ELSE ({_CRC_BIT}) >> 1 END), 4294967295) % 7 = 0
), l AS (
  SELECT doc_id, lang, {_h("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_h("doc_id", "source", "lang", "n_chars + CAST(doc_id IN (SELECT doc_id FROM sevenths) AS INTEGER)", "text")} AS held
  FROM documents
), g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) AS n FROM l GROUP BY lang),
leaves AS (SELECT doc_id, leaf, held, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
up AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, any_value(level) + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, i // 2
), sub AS (SELECT tree, h FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM g) AS n, h FROM sub
  UNION ALL SELECT any_value(level) + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 2
), nodes AS (
  SELECT tree, level, i, n, h FROM up WHERE n > 1 UNION ALL SELECT NULL, level, i, n, h FROM top WHERE n > 1
), fold AS (
  SELECT doc_id, tree, i AS leaf_i, tree AS at_tree, 0 AS level, i, n, held AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.tree, leaf_i, CASE WHEN f.n = 1 THEN NULL ELSE at_tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, CASE WHEN f.n = 1 THEN f.tree ELSE f.i // 2 END, CASE WHEN f.n = 1 THEN (SELECT count(*) FROM g) ELSE (f.n + 1) // 2 END,
    CASE WHEN f.n = 1 THEN f.h WHEN f.i % 2 = 0 THEN sha256(f.h || coalesce(s.h, '')) ELSE sha256(s.h || f.h) END, proof || CASE WHEN f.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM fold f LEFT JOIN nodes s ON s.tree IS NOT DISTINCT FROM f.at_tree AND s.level = f.level AND s.i = xor(f.i, 1) AND f.n > 1 WHERE f.n > 1 OR f.at_tree IS NOT NULL
)
SELECT x.doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
FROM leaves x JOIN fold ON fold.tree = x.tree AND fold.leaf_i = x.i AND fold.n = 1 AND fold.at_tree IS NULL JOIN sub ON sub.tree = x.tree, top WHERE top.n = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_merkle": op13_merkle,
}
ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "op7_ngram_join": OP7_SQL, "op9_suffix_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op11_collocations": OP11_SQL, "op12_mixing": OP12_SQL, "op13_merkle": OP13_SQL}
