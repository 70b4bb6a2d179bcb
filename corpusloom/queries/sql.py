"""Pieces of the SQL that queries are held against."""

TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"


def tok(x: str) -> str:
    return TOKENS.format(x)


def bm25(queries: str, docs: str, k: int, name: str, keep: str = "true") -> str:
    """CTEs, the last called ``name`` (query_id, doc_id, score, rank): ``queries`` (query_id, text), ``docs`` (doc_id, text and what ``keep`` needs)."""
    return rf"""
{name}_q AS (SELECT DISTINCT query_id, unnest({tok('text')}) AS term FROM {queries}),
{name}_t AS (SELECT doc_id, ({keep}) AS keep, {tok('text')} AS t FROM {docs}),
{name}_n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {name}_t),
{name}_e AS (SELECT doc_id, keep, len(t) AS dl, unnest(t) AS term FROM {name}_t),
{name}_f AS (SELECT term, doc_id, keep, dl, count(*) AS tf FROM {name}_e WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean) AS mean FROM {name}_f, {name}_n GROUP BY term, n),
{name}_s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM {name}_f JOIN {name}_i USING (term) JOIN {name}_q USING (term) WHERE keep GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def cosine(queries: str, k: int, name: str, where: str = "true") -> str:
    """CTEs, the last called ``name`` (query_id, doc_id, score, rank): ``queries`` (query_id, embedding) against embeddings."""
    return f"""
{name}_s AS (SELECT query_id, vec_id AS doc_id, label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM {queries} q, embeddings e WHERE {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
VECTORS = "vectors AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"


def rrf(lists: list[str], k: int, name: str) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, doc_id, rank, {n} AS l FROM {x}" for n, x in enumerate(lists))
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(l)::BIGINT AS first_list FROM ({rows}) GROUP BY 1, 2)) WHERE rank <= {k})"""
