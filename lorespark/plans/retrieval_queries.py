"""Retrieval and its evaluation: benchmark texts ask, documents answer.

A question's gold documents are those that hold its text; questions without any are unanswerable. Questions
whose item_id is a multiple of four are the test split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import evaluate as E
from ..operators import retrieval as R
from ..session import checkpointed
from . import sql as S

P, Q = ("doc_id", "text"), ("item_id", "text")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return R.bm25_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), P, Q, k)


def _out(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_ranked(spark, sf_dir))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.tfidf_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), P, Q))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is a multiple of 20 asks, all answer."""
    e = _table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = R.dense_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), asked)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def hash_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_hashed(spark, sf_dir, 10))


def _hashed(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.hashed_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), P, Q, k)


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fuse(_ranked(spark, sf_dir, 50), _hashed(spark, sf_dir, 50))


def _fuse(sparse: DataFrame, hashed: DataFrame) -> DataFrame:
    return R.fuse(sparse.select("query_id", "id", "rank").unionByName(hashed.select("query_id", "id", "rank")))


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(R.top_k(_fused(spark, sf_dir), "query_id", "id", 10))


def rrf_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are a document's first two words, names its third, aliases its fourth."""
    word = lambda k: F.coalesce(F.get(F.split("text", r"\s+"), F.lit(k)), F.lit(""))
    passages = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", word(0), word(1)).alias("title"), F.array(word(2)).alias("names"), F.array(word(3)).alias("aliases"))
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = R.top_k(R.bonuses(_fused(spark, sf_dir), queries, passages), "query_id", "id", 10)
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "title_bonus", "entity_bonus", "alias_bonus")


def structured_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a question: its top documents in the source of the first of them."""
    ranked = checkpointed(_ranked(spark, sf_dir))  # read four times
    source = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    placed = ranked.join(source, "id")
    first = placed.filter("rank = 1 AND query_id % 3 <> 0").select("query_id", F.col("source").alias("want"))
    evidence = placed.join(first, "query_id").filter("source = want").select("query_id", "id")
    out = R.top_k(R.structured_rerank(ranked.select("query_id", "id", "score"), evidence), "query_id", "id", 10)
    return out.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"), "structured_bonus")


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = checkpointed(R.top_k(_fused(spark, sf_dir), "query_id", "id", 10).select("query_id", "id", "score"))  # read three times
    lexical = R.tfidf_of_pairs(fused, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), P, Q)
    return _out(R.top_k(R.lexical_rerank(fused, lexical, 0.5), "query_id", "id", 10))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's entity is the first word of its first document, its alias the second word."""
    d = _table(spark, sf_dir, "documents")
    first = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    word = lambda k: F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return first.select(F.col("source").alias("entity_id"), F.get(word(0), F.lit(0)).alias("name"), F.array_compact(F.array(F.get(word(0), F.lit(1)))).alias("aliases")).filter("name IS NOT NULL")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mentions(_questions(spark, sf_dir), _entities(spark, sf_dir)).select(F.col("query_id").alias("item_id"), "entity_id", "surface", F.col("position").cast("long").alias("position"))


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    out = R.expand_queries(q, R.mentions(q, _entities(spark, sf_dir)))
    return out.select(F.col("query_id").alias("item_id"), "transformed_query", F.array_join("expansions", "|").alias("expansions"), F.array_join("entity_ids", "|").alias("entity_ids"))


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each region by one hop from its nations."""
    nation = _table(spark, sf_dir, "nation")
    seeds = nation.select(F.col("n_regionkey").cast("long").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    edges = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("b"))
    return R.graph_evidence(seeds, edges)


def date_range_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority whose year lies in each range."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.year("o_orderdate").alias("start_year"), F.year("o_orderdate").alias("end_year"))
    ranges = spark.createDataFrame([(1, "1-URGENT", 1993, 1995), (2, "2-HIGH", 1996, 1996), (3, None, 1998, 2030)], "query_id long, type string, low int, high int")
    return E.in_date_range(o, ranges).select("query_id", "id")


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("suburb"), F.col("c_mktsegment").alias("address"))
    wanted = _table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("query_id"), F.lower("n_name").alias("place"))
    return E.in_place(places, wanted)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for each question, or none below the threshold of the development split."""
    trace = _traces(spark, sf_dir)
    limit = E.abstention_threshold(trace.filter("item_id % 4 <> 0").select("top_score", "answerable")).select("threshold")
    return E.answered(trace, limit, 5).select("item_id", F.round("top_score", 6).alias("top_score"), "abstained", F.array_join("evidence", ",").alias("evidence"), "badge")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    return E.containment(d, b, P, Q)


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    out = checkpointed(E.traces(_ranked(spark, sf_dir), _gold(spark, sf_dir), q))  # the threshold reads it too
    return out.withColumnRenamed("query_id", "item_id")


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir)
    limit = E.abstention_threshold(t.filter("item_id % 4 <> 0").select("top_score", "answerable")).select("threshold")
    return E.metrics(t.join(F.broadcast(limit)).withColumn("abstained", F.col("top_score") < F.col("threshold")))  # one row


def abstention_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.abstention_threshold(_traces(spark, sf_dir).filter("item_id % 4 <> 0").select("top_score", "answerable"))
    return out.select(F.round("threshold", 6).alias("threshold"), F.round("quality", 6).alias("quality"))


def success_and_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir)
    limit = E.abstention_threshold(t.filter("item_id % 4 <> 0").select("top_score", "answerable")).select("threshold")
    t = t.join(F.broadcast(limit)).withColumn("abstained", F.col("top_score") < F.col("threshold"))  # one row
    kind = F.element_at(F.array(*map(F.lit, ("alias", "date range", "location", "lexical"))), (F.col("item_id") % 4 + 1).cast("int"))
    rows = t.withColumns({"success": E.success(), "query_type": kind, "has_entities": F.col("item_id") % 3 == 0})
    return rows.select("item_id", "success", F.when(~F.col("success"), E.failure_category()).alias("failure_category"))


def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return success_and_failure(spark, sf_dir).groupBy("failure_category").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"))


def method_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods side by side on the development split, and which has the best MRR (ties to the later name)."""
    sparse, hashed = checkpointed(_ranked(spark, sf_dir, 50)), checkpointed(_hashed(spark, sf_dir, 50))
    runs = {"bm25": sparse.filter("rank <= 10"), "hashed": hashed.filter("rank <= 10"), "rrf": R.top_k(_fuse(sparse, hashed), "query_id", "id", 10)}
    q = _table(spark, sf_dir, "benchmark").filter("item_id % 4 <> 0").select(F.col("item_id").alias("query_id"))
    return E.compare(runs, checkpointed(_gold(spark, sf_dir)), q)  # read for each method


TOK = S.search_tokens("text")
BM25 = f"""tok AS (SELECT doc_id, unnest({TOK}) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, len({TOK}) AS l FROM documents), tot AS (SELECT count(*) AS n, avg(l) AS m FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT item_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))) AS score
  FROM post JOIN qt USING (term) JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY ALL),
bmr AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM bm)"""


def _hash_sql(table: str, key: str) -> str:
    return f"""(SELECT {key}, idx, v / CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY {key})) = 0 THEN 1 ELSE sqrt(sum(v * v) OVER (PARTITION BY {key})) END AS v FROM (SELECT {key}, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS idx,
  sum(CASE WHEN ('0x' || substr(sha256(term), 9, 2))::BIGINT % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM (SELECT {key}, unnest({TOK}) AS term FROM {table}) GROUP BY ALL))"""


HASHED = f"""hs AS (SELECT item_id, doc_id, sum(d.v * q.v) AS score FROM {_hash_sql('documents', 'doc_id')} d JOIN {_hash_sql('benchmark', 'item_id')} q USING (idx) GROUP BY ALL),
hsr AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM hs)"""
FUSED = f"""{BM25}, {HASHED}, fu AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT item_id, doc_id, rank FROM bmr WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM hsr WHERE rank <= 50) GROUP BY ALL),
fur AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM fu)"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _tf(table: str, key: str) -> str:
    return f"(SELECT {key}, term, 1 + ln(count(*)) AS w FROM (SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {key}, {WORDS} AS w FROM {table})) GROUP BY ALL)"


TFIDF = f"""td AS {_tf('documents', 'doc_id')}, tq AS {_tf('benchmark', 'item_id')}, nn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM td GROUP BY term), nn),
dw AS (SELECT doc_id, term, w * idf AS w FROM td JOIN idf USING (term)), qw AS (SELECT item_id, term, w * idf AS w FROM tq JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY ALL),
ti AS (SELECT item_id, doc_id, sum(dw.w * qw.w / qn) / any_value(dn) AS score FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL),
tir AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM ti)"""
TOP = "SELECT item_id, doc_id, rank, round(score, 6) AS score FROM {} WHERE rank <= 10"
GOLD = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"
TRACE = f"""{BM25}, {GOLD}, tr AS (SELECT item_id, coalesce(max(round(score, 9)) FILTER (rank <= 10), 0) AS top_score, item_id IN (SELECT item_id FROM gold) AS answerable, list(doc_id ORDER BY rank) FILTER (rank <= 10) AS ranked FROM benchmark LEFT JOIN bmr USING (item_id) GROUP BY item_id),
gl AS (SELECT item_id, list(doc_id) AS golds FROM gold GROUP BY item_id), dev AS (SELECT * FROM tr WHERE item_id % 4 <> 0),
cand AS (SELECT 0.0::DOUBLE AS t UNION SELECT DISTINCT top_score FROM dev),
sw AS (SELECT t, (coalesce(count(*) FILTER (answerable AND top_score >= t) / nullif(count(*) FILTER (answerable), 0)::DOUBLE, 1) + coalesce(count(*) FILTER (NOT answerable AND top_score < t) / nullif(count(*) FILTER (NOT answerable), 0)::DOUBLE, 1)) / 2 AS quality FROM cand, dev GROUP BY t),
th AS (SELECT t AS threshold, quality FROM sw ORDER BY round(quality, 9) DESC, t LIMIT 1),
ab AS (SELECT tr.*, golds, top_score < threshold AS abstained, threshold FROM tr LEFT JOIN gl USING (item_id), th)"""
HITS = """hit AS (SELECT {m} item_id, rank FROM {r} JOIN gold USING (item_id, doc_id) WHERE rank <= 10),
per AS (SELECT {m} item_id, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM hit GROUP BY ALL),
ideal AS (SELECT item_id, list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id))"""
SUCCESS = "CASE WHEN answerable THEN NOT abstained AND len(list_intersect(coalesce(golds, []), ranked[:5])) > 0 ELSE abstained END"
ENT = r"""ent AS (SELECT source AS entity_id, w[1] AS name, CASE WHEN len(w) > 1 THEN [w[2]] ELSE [] END AS aliases FROM (SELECT source, regexp_extract_all(arg_min(text, doc_id), '[\p{L}\p{N}_]+') AS w FROM documents GROUP BY source) WHERE len(w) > 0)"""

QUERIES = {f.__name__: f for f in (
    bm25_topk, tfidf_topk, dense_topk, hash_dense_topk, rrf, rrf_bonus, structured_rerank, lexical_rerank, entity_mentions, query_expansion, graph_neighbours, date_range_rows, place_rows,
    answers, gold_documents, ir_metrics, abstention_threshold, success_and_failure, failure_histogram, method_comparison,
)}

ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25} {TOP.format('bmr')}",
    "tfidf_topk": f"WITH {TFIDF} {TOP.format('tir')}",
    "hash_dense_topk": f"WITH {HASHED} {TOP.format('hsr')}",
    "rrf": f"WITH {FUSED} {TOP.format('fur')}",
    "dense_topk": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM n),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_dot_product(q.e, d.e) / (CASE WHEN q.l = 0 THEN 1 ELSE q.l END * CASE WHEN d.l = 0 THEN 1 ELSE d.l END) AS score FROM u q, u d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id))::INT AS rank FROM s) SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "rrf_bonus": rf"""WITH {FUSED}, w AS (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents),
p AS (SELECT doc_id, concat_ws(' ', coalesce(w[1], ''), coalesce(w[2], '')) AS title, coalesce(w[3], '') AS name, coalesce(w[4], '') AS alias FROM w),
b AS (SELECT item_id, doc_id, score, CASE WHEN title <> '' AND contains(lower(text), lower(title)) THEN 0.03::DOUBLE ELSE 0 END AS title_bonus,
 CASE WHEN name <> '' AND contains(' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ') THEN 0.01::DOUBLE ELSE 0 END AS entity_bonus,
 CASE WHEN alias <> '' AND contains(' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || regexp_replace(lower(alias), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ') THEN 0.02::DOUBLE ELSE 0 END AS alias_bonus FROM fu JOIN benchmark USING (item_id) JOIN p USING (doc_id)),
r AS (SELECT * REPLACE (score + title_bonus + entity_bonus + alias_bonus AS score) FROM b), k AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM r)
SELECT item_id, doc_id, rank, round(score, 6) AS score, title_bonus, entity_bonus, alias_bonus FROM k WHERE rank <= 10""",
    "structured_rerank": f"""WITH {BM25}, pl AS (SELECT item_id, doc_id, score, rank, source FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10), fi AS (SELECT item_id, source AS want FROM pl WHERE rank = 1 AND item_id % 3 <> 0),
x AS (SELECT item_id, doc_id, score + coalesce(CASE WHEN want IS NULL THEN NULL WHEN source = want THEN 0.05::DOUBLE ELSE 0 END, 0) AS score, CASE WHEN want IS NULL THEN NULL WHEN source = want THEN 0.05::DOUBLE ELSE 0 END AS structured_bonus FROM pl LEFT JOIN fi USING (item_id))
SELECT item_id, doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank, round(score, 6) AS score, structured_bonus FROM x""",
    "lexical_rerank": f"WITH {FUSED}, {TFIDF}, x AS (SELECT item_id, doc_id, fur.score + 0.5::DOUBLE * coalesce(ti.score, 0) AS score FROM fur LEFT JOIN ti USING (item_id, doc_id) WHERE rank <= 10) SELECT item_id, doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank, round(score, 6) AS score FROM x",
    "graph_neighbours": "SELECT n_regionkey::BIGINT AS query_id, 'n' || n_nationkey AS node FROM nation UNION SELECT n_regionkey::BIGINT, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "date_range_rows": "SELECT q AS query_id, o_orderkey AS id FROM orders JOIN (VALUES (1::BIGINT, '1-URGENT', 1993, 1995), (2, '2-HIGH', 1996, 1996), (3, NULL, 1998, 2030)) v(q, t, a, b) ON (t IS NULL OR t = o_orderpriority) AND year(o_orderdate) BETWEEN a AND b",
    "place_rows": "SELECT w.n_nationkey::BIGINT AS query_id, c_custkey AS id FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation w ON w.n_nationkey % 5 = 0 AND (contains(lower(c_name), lower(w.n_name)) OR contains(lower(n.n_name), lower(w.n_name)) OR contains(lower(c_mktsegment), lower(w.n_name)))",
    "gold_documents": f"WITH {GOLD} SELECT item_id, doc_id FROM gold",
    "answers": f"WITH {TRACE} SELECT item_id, round(top_score, 6) AS top_score, abstained, CASE WHEN abstained THEN '' ELSE coalesce(array_to_string(ranked[:5], ','), '') END AS evidence, CASE WHEN top_score >= 2 * threshold THEN 'High' WHEN top_score >= threshold THEN 'Moderate' ELSE 'Below threshold' END AS badge FROM ab",
    "abstention_threshold": f"WITH {TRACE} SELECT round(threshold, 6) AS threshold, round(quality, 6) AS quality FROM th",
    "ir_metrics": f"""WITH {TRACE}, {HITS.format(m='', r='bmr')}, a AS (SELECT ab.*, first, dcg, ideal FROM ab LEFT JOIN per USING (item_id) LEFT JOIN ideal USING (item_id))
SELECT count(*) AS query_count, round(avg((coalesce(first, 99) <= 1)::INT) FILTER (answerable), 6) AS recall_at_1, round(avg((coalesce(first, 99) <= 3)::INT) FILTER (answerable), 6) AS recall_at_3, round(avg((coalesce(first, 99) <= 5)::INT) FILTER (answerable), 6) AS recall_at_5, round(avg((coalesce(first, 99) <= 10)::INT) FILTER (answerable), 6) AS recall_at_10,
 round(avg(coalesce(1.0 / first, 0)) FILTER (answerable), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)) FILTER (answerable), 6) AS ndcg_at_10, round(coalesce(count(*) FILTER (abstained AND NOT answerable) / nullif(count(*) FILTER (abstained), 0)::DOUBLE, 0), 6) AS unanswerable_precision,
 round(coalesce(count(*) FILTER (abstained AND NOT answerable) / nullif(count(*) FILTER (NOT answerable), 0)::DOUBLE, 0), 6) AS unanswerable_recall, round(avg(abstained::INT), 6) AS zero_result_rate FROM a""",
    "success_and_failure": f"WITH {TRACE} SELECT item_id, {SUCCESS} AS success, CASE WHEN {SUCCESS} THEN NULL WHEN NOT answerable THEN 'insufficient_corpus_coverage' WHEN item_id % 4 = 0 THEN 'alias_mismatch' WHEN item_id % 4 = 1 THEN 'date_filter_failure' WHEN item_id % 4 = 2 THEN 'location_ambiguity' WHEN item_id % 3 = 0 THEN 'semantic_confusion' ELSE 'lexical_mismatch' END AS failure_category FROM ab",
    "method_comparison": f"""WITH {FUSED}, {GOLD}, al AS (SELECT 'bm25' AS method, item_id, doc_id, rank FROM bmr UNION ALL SELECT 'hashed', item_id, doc_id, rank FROM hsr UNION ALL SELECT 'rrf', item_id, doc_id, rank FROM fur),
{HITS.format(m='method,', r='al')}, mq AS (SELECT m AS method, item_id FROM (VALUES ('bm25'), ('hashed'), ('rrf')) v(m), (SELECT DISTINCT item_id FROM gold WHERE item_id % 4 <> 0)),
s AS (SELECT method, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS recall_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg_at_10 FROM mq LEFT JOIN per USING (method, item_id) LEFT JOIN ideal USING (item_id) GROUP BY method)
SELECT *, method = (SELECT method FROM s ORDER BY mrr DESC, method DESC LIMIT 1) AS is_best FROM s""",
}
ORACLE_SQL["failure_histogram"] = f"SELECT failure_category, count(*) AS n, count(*) FILTER (success) AS n_success FROM ({ORACLE_SQL['success_and_failure']}) GROUP BY 1"
