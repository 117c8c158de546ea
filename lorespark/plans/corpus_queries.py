"""Cleaning, passages, quality audits and language-model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, text as T
from ..operators import lm
from ..operators import quality as QA
from ..operators import windows as W
from . import sql as S

#: Merges that the reference learns.
MERGES = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines of one word and a stop become headings."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^([^\s.]+)\.$", "## $1").alias("text"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sectioned(spark, sf_dir).select("doc_id", F.concat(F.lit("[edit]\n# Top\n# Top\n\n\n\n"), F.col("text"), F.lit("\nCategory: x\n")).alias("text"))
    out = W.clean_lines(rows, "doc_id", "text")
    return out.select("doc_id", F.sha2("cleaned_text", 256).alias("text_hash"), "line_count")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.passages(_sectioned(spark, sf_dir), "doc_id", "text")
    return out.select("passage_id", "doc_id", "section_title", "passage_index", F.sha2("text", 256).alias("text_hash"), "character_start", "character_end")


def passage_spans_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sectioned(spark, sf_dir).withColumnRenamed("text", "whole")
    p = W.passages(docs, "doc_id", "whole").join(docs, "doc_id")
    return p.select("doc_id", "passage_index", T.valid_span("whole", "character_start", "character_end", "text").alias("valid"))


def small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("passage_id"), "text")
    out = W.small_chunks(d)
    return out.select("chunk_id", "parent_id", "chunk_index", F.sha2("text", 256).alias("text_hash"))


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("passage_id"), F.col("source").alias("title"), F.lit("Overview").alias("section_title"), "text")
    names = d.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("passage_id"), F.array("lang", "source").alias("names"), F.array("lang").alias("aliases"))
    out = None
    for strategy in ("original", "parent_child"):
        part = W.representations(rows, names, strategy).select(F.lit(strategy).alias("strategy"), "id", F.sha2("text", 256).alias("text_hash"), F.sha2("search_text", 256).alias("search_hash"))
        out = part if out is None else out.unionByName(part)
    return out


def lm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(T.search_tokens("text"), lambda t: F.length(t))
    out = W.lm_batches(_table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")), "doc_id", "ids", 64, 8)
    return out.select("doc_id", "batch", "chunk", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.ngram_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", 3)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct_ngrams"), F.sum("n").alias("ngrams"), F.max("n").alias("most"))


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents: which are memorised (over 30 % of trigrams)?"""
    out = W.ngram_overlap(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), ("item_id", "text"), ("doc_id", "text"), 3)
    return out.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), F.round("overlap", 6).alias("overlap"), (F.col("overlap") > 0.3).alias("memorised"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sentences(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.sha2("sentence", 256).alias("sentence_hash"), "start", "end")


def usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", QA.usable("text").alias("usable"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.splits(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


LICENCE = "CASE WHEN doc_id % 4 = 0 THEN 'CC-BY-4.0' WHEN doc_id % 4 = 1 THEN 'PUBLIC-DOMAIN' WHEN doc_id % 4 = 2 THEN 'ARR' END"


def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.word_count("text")).alias("words"), F.min("doc_id").alias("doc_id"))
    return QA.source_balance(d.select(F.col("source").alias("source_id"), F.expr(LICENCE).alias("licence"), "words"))


def licence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return QA.licence_audit(d.select("doc_id", F.expr(LICENCE).alias("licence"), QA.usable("text").alias("usable")))


def capped_training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", QA.capped_text("text", 200).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, l, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "nation"))
    few = c.filter("c_custkey % 50 <> 0")
    return QA.violations(
        QA.duplicate_ids(l.select("l_orderkey"), "l_orderkey", "unique order key").filter("rule IS NOT NULL"),
        QA.orphans(o, "o_custkey", few, "c_custkey", "order without customer", "o_orderkey"),
        QA.failing(c, "c_custkey", F.col("c_acctbal") > 0, "balance above zero"),
        QA.orphans(c, "c_nationkey", n, "n_nationkey", "customer without nation", "c_custkey"),
    )


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab, b = (_table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    none = d.join(lab, "doc_id", "left_anti").select(F.lit("no label").alias("audit"), F.col("doc_id").alias("id"))
    both = d.join(lab.filter("toxic = 1"), "doc_id", "left_semi").select(F.lit("toxic").alias("audit"), F.col("doc_id").alias("id"))
    odd = b.join(d, b["item_id"] == d["doc_id"], "left_anti").select(F.lit("no document").alias("audit"), F.col("item_id").alias("id"))
    return none.unionByName(both).unionByName(odd)


def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(_table(spark, sf_dir, "part").select(F.upper("p_name").alias("name")))
    return QA.duplicate_names(names)


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QA.row_counts({t: _table(spark, sf_dir, t) for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")})


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return QA.corpus_fingerprint(p.select(F.col("page_id").cast("string").alias("source_id"), F.col("url").alias("source_url"), F.lit("CC-BY-4.0").alias("licence"), F.lit("2024-01-01").alias("retrieval_timestamp"), F.col("html").alias("content"), F.lit("ok").alias("collection_status")))


def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of quality and toxicity by language of the labelled documents."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6).alias("toxic_rate_of_good"))


def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.char_vocab(_table(spark, sf_dir, "documents"), "text")


def char_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark")
    vocab = lm.char_vocab(_table(spark, sf_dir, "documents"), "text")
    return lm.char_encode(b, "item_id", "text", vocab).select("item_id", F.array_join("ids", " ").alias("ids"))


def bpe_word_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.word_freqs(_table(spark, sf_dir, "documents"), "text")


def bpe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pair_counts(lm.word_freqs(_table(spark, sf_dir, "documents"), "text"))


def _bpe(spark: SparkSession, sf_dir: str, merges: int) -> list[tuple[str, str]]:
    """Trained on the words of all documents, which stay on executors."""
    return lm.learn_bpe(lm.word_freqs(_table(spark, sf_dir, "documents"), "text", "doc_id"), merges)


def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_bpe(spark, sf_dir, MERGES))], "rank long, left string, right string")


def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.bpe_encode(_table(spark, sf_dir, "documents"), "doc_id", "text", _bpe(spark, sf_dir, MERGES))
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_hash"))


def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, and search tokens of a document per word."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))
    return d.select("doc_id", "chars", "words", F.round(F.try_divide("chars", "words"), 6).alias("chars_per_word"))


def _tokens(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").filter(which)
    return d.select("doc_id", F.posexplode(T.search_tokens("text")).alias("n", "token"))


def unigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.unigram_perplexity(_tokens(spark, sf_dir, "doc_id % 10 <> 0"), _tokens(spark, sf_dir, "doc_id % 10 = 0"), "token")
    return out.select(F.round("perplexity", 3).alias("perplexity"))


def bigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    out = lm.bigram_perplexity_of_texts(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), "text")
    return out.select(F.round("perplexity", 3).alias("perplexity"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = _table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "turn_no": F.row_number().over(w)})
    return c.filter("role = 'user'").select("conv_id", "turn", "next_role", T.word_count("text").alias("words"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables from region to lineitem, revenue at the end."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("s_suppkey").alias("suppliers"), F.countDistinct("o_orderkey").alias("orders"))


SECTIONED = r"(SELECT doc_id, regexp_replace(text, '(?m)^([^\s.]+)\.$', '## \1', 'g') AS text FROM documents)"
TILES = r"regexp_extract_all(text, '\s*\S+')"


def _windows(src: str, key: str, most: int, overlap: int, clamp: bool, whole: int = 0) -> str:
    size = f"least({most}, greatest(1, size0))" if clamp else "size0"
    return f"""t AS (SELECT {key}, {TILES} AS tiles, len({TILES}) AS n FROM {src}), c AS (SELECT *, greatest(1, ceil((n - {overlap}) / {most - overlap}::DOUBLE))::BIGINT AS chunks FROM t WHERE n > 0),
z AS (SELECT *, ceil((n + (chunks - 1) * {overlap}) / chunks::DOUBLE)::BIGINT AS size0 FROM c), s AS (SELECT *, CASE WHEN n <= {whole} THEN n ELSE {size} END AS size FROM z), g AS (SELECT *, greatest(1, size - {overlap}) AS stride FROM s),
i AS (SELECT *, unnest(range(0, CASE WHEN n <= size THEN 1 ELSE ceil((n - size) / stride::DOUBLE)::BIGINT + 1 END)) AS idx FROM g),
w AS (SELECT {key}, idx, array_to_string(tiles[1 : idx * stride], '') AS before, array_to_string(tiles[idx * stride + 1 : least(n, idx * stride + size)], '') AS body FROM i),
p AS (SELECT {key}, idx, regexp_replace(body, '^\\s+', '') AS text, (length(before) + length(body) - length(regexp_replace(body, '^\\s+', '')))::INT AS character_start, (length(before) + length(body))::INT AS character_end FROM w)"""


PASSAGES = rf"""WITH {_windows(SECTIONED, 'doc_id', 450, 45, True)},
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM {SECTIONED}),
hd AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM ln),
h AS (SELECT doc_id, at0, regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*$', 1) AS heading FROM hd WHERE regexp_matches(line, '^#{{1,6}}\s+(.+?)\s*$')),
x AS (SELECT p.*, coalesce((SELECT arg_max(heading, at0) FROM h WHERE h.doc_id = p.doc_id AND at0 <= character_start), 'Overview') AS section_title FROM p)"""
TRI = "list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
WS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"


def _grams(table: str, key: str) -> str:
    return f"(SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(CASE WHEN len(w) >= 3 THEN {TRI} ELSE [] END) AS g FROM (SELECT {key}, {WS} AS w FROM {table})) GROUP BY ALL)"


TOKENS = f"tk AS (SELECT doc_id, unnest({S.search_tokens('text')}) AS token, unnest(range(0, len({S.search_tokens('text')}))) AS n FROM documents), vv AS (SELECT count(DISTINCT token) AS v FROM tk)"
PIECES = r"regexp_extract_all(text, '[a-zA-Z'']+|[^a-zA-Z''\s\x0b\x1c-\x1f\x{85}\p{Z}]')"

QUERIES = {f.__name__: f for f in (
    clean_lines, passages, passage_spans_valid, small_chunks, representations, lm_batches, ngram_counts, ngram_overlap, sentences, usable_documents, splits, source_balance, licence_audit, capped_training_text, integrity_violations,
    coverage_audit, duplicate_names, counts_by_type, corpus_counts, corpus_fingerprint, label_rates, char_vocab, char_encode, bpe_word_freqs, bpe_pairs, bpe_train, bpe_encode, compression, unigram_perplexity, bigram_perplexity, turn_pairs, lineage,
)}

ORACLE_SQL = {
    "passages": f"{PASSAGES} SELECT {S.stable_id('pass', 'doc_id', 'idx', 'text')} AS passage_id, doc_id, section_title, idx::INT AS passage_index, sha256(text) AS text_hash, character_start, character_end FROM x",
    "passage_spans_valid": f"{PASSAGES} SELECT doc_id, idx::INT AS passage_index, true AS valid FROM x",
    "small_chunks": f"WITH {_windows('(SELECT doc_id::VARCHAR AS parent_id, text FROM documents)', 'parent_id', 220, 30, False, 220)} SELECT {S.stable_id('small', 'parent_id', 'idx', 'text', normalise=False)} AS chunk_id, parent_id, idx::INT AS chunk_index, sha256(text) AS text_hash FROM p",
    "representations": f"""WITH {_windows('(SELECT doc_id::VARCHAR AS parent_id, text FROM documents)', 'parent_id', 220, 30, False, 220)},
d AS (SELECT doc_id::VARCHAR AS id, text, source || chr(10) || 'Overview' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || array_to_string(list_sort(list_distinct([lang, source])), chr(10)) || chr(10) || lang ELSE '' END AS head FROM documents)
SELECT 'original' AS strategy, id, sha256(text) AS text_hash, sha256(CASE WHEN text = '' THEN head ELSE head || chr(10) || text END) AS search_hash FROM d
UNION ALL SELECT 'parent_child', {S.stable_id('small', 'parent_id', 'idx', 'p.text', normalise=False)}, sha256(d.text), sha256(head || chr(10) || p.text) FROM p JOIN d ON d.id = p.parent_id""",
    "lm_batches": f"""WITH t AS (SELECT doc_id, list_transform({S.search_tokens('text')}, lambda t: length(t)) AS ids FROM documents), c AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 64, 64)) AS s FROM t WHERE len(ids) > 64)
SELECT doc_id, (s // 64 // 8)::INT AS batch, (s // 64)::INT AS chunk, array_to_string(ids[s + 1 : s + 64], ' ') AS x, array_to_string(ids[s + 2 : s + 65], ' ') AS y FROM c""",
    "ngram_counts": f"SELECT doc_id, count(*) AS distinct_ngrams, sum(n)::BIGINT AS ngrams, max(n) AS most FROM {_grams('documents', 'doc_id')} GROUP BY doc_id",
    "ngram_overlap": f"""WITH a AS {_grams('benchmark', 'item_id')}, b AS {_grams('documents', 'doc_id')}, t AS (SELECT item_id, sum(n) AS total FROM a GROUP BY item_id),
s AS (SELECT item_id, doc_id, sum(least(a.n, b.n)) / any_value(total)::DOUBLE AS overlap FROM a JOIN b USING (g) JOIN t USING (item_id) GROUP BY ALL) SELECT item_id, doc_id, round(overlap, 6) AS overlap, overlap > 0.3 AS memorised FROM s""",
    "usable_documents": f"SELECT doc_id, {S.word_count('text')} >= 80 AND trim(text) <> '' AS usable FROM documents",
    "splits": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents), c AS (SELECT *, greatest(1, round_even(0.8 * n, 0)::BIGINT) AS t0, CASE WHEN n >= 3 THEN greatest(1, round_even(0.1 * n, 0)::BIGINT) ELSE 0 END AS v FROM r),
t AS (SELECT *, CASE WHEN n >= 3 AND t0 + v >= n THEN n - v - 1 ELSE t0 END AS t FROM c) SELECT doc_id, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'validation' ELSE 'test' END AS split FROM t""",
    "source_balance": f"""WITH s AS (SELECT source AS source_id, sum({S.word_count('text')})::BIGINT AS words_before, min(doc_id) AS doc_id FROM documents GROUP BY source), l AS (SELECT source_id, words_before, {LICENCE} AS licence FROM s),
e AS (SELECT *, coalesce(licence IN ('CC-BY-4.0', 'CC-BY-SA-4.0', 'OGL-AU', 'PUBLIC-DOMAIN'), false) AS training_eligible FROM l), a AS (SELECT *, CASE WHEN training_eligible THEN least(words_before, 6000) ELSE 0 END::BIGINT AS words_after FROM e)
SELECT source_id, licence, training_eligible, words_before, words_after, round(100.0::DOUBLE * words_before / sum(words_before) OVER (), 2) AS percent_before, round(100.0::DOUBLE * words_after / sum(words_after) OVER (), 2) AS percent_after, CASE WHEN NOT training_eligible THEN 'licence is unclear or incompatible with training' WHEN words_before > 6000 THEN 'capped at 6,000 words' ELSE 'included in full' END AS decision FROM a""",
    "licence_audit": f"SELECT *, CASE WHEN NOT usable THEN 'exclude_unusable' WHEN NOT coalesce(licence IN ('CC-BY-4.0', 'CC-BY-SA-4.0', 'OGL-AU', 'PUBLIC-DOMAIN'), false) THEN 'exclude_licence' ELSE 'include' END AS decision FROM (SELECT doc_id, {LICENCE} AS licence, {S.word_count('text')} >= 80 AND trim(text) <> '' AS usable FROM documents)",
    "capped_training_text": rf"WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).*?{S.WORD}') AS p FROM documents), t AS (SELECT doc_id, regexp_replace(CASE WHEN len(p) > 200 THEN array_to_string(p[1:200], '') ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM p) SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS text_hash FROM t",
    "integrity_violations": "SELECT 'unique order key' AS rule, l_orderkey::VARCHAR AS id FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'order without customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) UNION ALL SELECT 'balance above zero', c_custkey::VARCHAR FROM customer WHERE NOT c_acctbal > 0 UNION ALL SELECT 'customer without nation', c_custkey::VARCHAR FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "coverage_audit": "SELECT 'no label' AS audit, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'toxic', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'no document', item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)",
    "duplicate_names": f"WITH n AS (SELECT p_name AS name FROM part UNION SELECT upper(p_name) FROM part), k AS (SELECT name, regexp_replace({S.casefold('name')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM n) SELECT a.name AS name_a, b.name AS name_b FROM k a JOIN k b USING (k) WHERE length(k) >= 5 AND a.name < b.name",
    "counts_by_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "corpus_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")),
    "corpus_fingerprint": "SELECT page_id::VARCHAR AS source_id, url AS source_url, 'CC-BY-4.0' AS licence, '2024-01-01' AS retrieval_timestamp, strlen(html)::BIGINT AS file_size, sha256(html) AS content_hash, 'ok' AS collection_status FROM pages",
    "label_rates": "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality_rate, round(avg(toxic) FILTER (quality = 1), 6) AS toxic_rate_of_good FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "char_vocab": "SELECT c AS char, (row_number() OVER (ORDER BY c) + 3)::INT AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''",
    "char_encode": "WITH v AS (SELECT c, (row_number() OVER (ORDER BY c) + 3) AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents)), t AS (SELECT item_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS n FROM benchmark) SELECT item_id, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY n) AS ids FROM t LEFT JOIN v USING (c) GROUP BY item_id",
    "bpe_word_freqs": f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({PIECES}) AS w FROM documents) GROUP BY w",
    "bpe_pairs": f"WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest({PIECES}) AS w FROM documents) GROUP BY w), s AS (SELECT n, list_append(string_split(w, ''), '</w>') AS s FROM f), p AS (SELECT n, s, unnest(range(1, len(s))) AS i FROM s) SELECT s[i] AS \"left\", s[i + 1] AS \"right\", sum(n)::BIGINT AS n FROM p GROUP BY ALL",
    "compression": r"SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '\S+'))::BIGINT AS words, round(length(text) / nullif(len(regexp_extract_all(text, '\S+')), 0)::DOUBLE, 6) AS chars_per_word FROM documents",
    "unigram_perplexity": f"WITH {TOKENS}, c AS (SELECT token, count(*) AS c FROM tk WHERE doc_id % 10 <> 0 GROUP BY token), t AS (SELECT sum(c) AS tot FROM c) SELECT round(exp(-avg(ln((coalesce(c, 0) + 0.1::DOUBLE) / (tot + 0.1::DOUBLE * v)))), 3) AS perplexity FROM tk LEFT JOIN c USING (token), t, vv WHERE doc_id % 10 = 0",
    "bigram_perplexity": f"""WITH {TOKENS}, b AS (SELECT * FROM (SELECT doc_id, token AS l, lead(token) OVER (PARTITION BY doc_id ORDER BY n) AS r FROM tk) WHERE r IS NOT NULL), c1 AS (SELECT token AS l, count(*) AS c1 FROM tk WHERE doc_id % 10 <> 0 GROUP BY token), c2 AS (SELECT l, r, count(*) AS c2 FROM b WHERE doc_id % 10 <> 0 GROUP BY ALL)
SELECT round(exp(-avg(ln((coalesce(c2, 0) + 0.1::DOUBLE) / (coalesce(c1, 0) + 0.1::DOUBLE * v)))), 3) AS perplexity FROM b LEFT JOIN c2 USING (l, r) LEFT JOIN c1 USING (l), vv WHERE doc_id % 10 = 0""",
    "turn_pairs": f"SELECT conv_id, turn, next_role, {S.word_count('text')} AS words FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role FROM conversations) WHERE role = 'user'",
    "lineage": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY r_name",
}
