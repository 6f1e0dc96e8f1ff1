"""Full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.functions import words
from dayweave.operators import search

QUERIES = ["the and", "aux la", "Erstly on", "élle"]
PATTERN = r"[\p{L}\p{N}_.\-]+"
VIEWS["listed"] = f"SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{PATTERN}') AS terms FROM documents"
VIEWS["postings"] = "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM listed) GROUP BY 1, 2"


def docs(t: Tables):
    return t.raw("documents").select("doc_id", "text")


@query("tokenize", "SELECT doc_id, len(terms) AS n, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM listed")
def _(t: Tables):
    rows = docs(t).select("doc_id", words.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("terms"))


@query("build_index", "SELECT * FROM postings")
def _(t: Tables):
    return search.build_index(docs(t), stems=False).postings.select("term", "doc_id", "tf")


@query("build_index_stemmed")
def _(t: Tables):
    return search.build_index(docs(t)).postings.select("term", "doc_id", "tf")


@query(
    "search",
    f"""WITH asked AS (SELECT DISTINCT CAST(n AS INTEGER) AS query_no, unnest(regexp_extract_all(strip_accents(lower(text)), '{PATTERN}')) AS term FROM
    (SELECT unnest({QUERIES}) AS text, unnest(range({len(QUERIES)})) AS n)),
    df AS (SELECT term, greatest(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM postings GROUP BY 1),
    points AS (SELECT a.query_no, p.doc_id, sum(d.idf * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len(l.terms) / (SELECT avg(len(terms)) FROM listed)))) AS score, count(*) AS found
    FROM asked a JOIN postings p USING (term) JOIN df d USING (term) JOIN listed l ON l.doc_id = p.doc_id GROUP BY 1, 2)
    SELECT query_no, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc_id) AS rank FROM points s
    WHERE found = (SELECT count(*) FROM asked a WHERE a.query_no = s.query_no)) WHERE rank <= 20""",
)
def _(t: Tables):
    found = search.search(search.stored(search.build_index(docs(t), stems=False)), QUERIES, stems=False)
    return found.withColumn("score", F.round("score", 6))


@query(
    "search_changed",
    f"""WITH now AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 5 = 0 THEN 'the and aux la ' || doc_id ELSE text END)), '{PATTERN}') AS terms FROM documents WHERE doc_id % 7 > 0),
    held AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM now) GROUP BY 1, 2),
    asked AS (SELECT DISTINCT CAST(n AS INTEGER) AS query_no, unnest(regexp_extract_all(strip_accents(lower(text)), '{PATTERN}')) AS term FROM
    (SELECT unnest({QUERIES}) AS text, unnest(range({len(QUERIES)})) AS n)),
    df AS (SELECT term, greatest(ln(((SELECT count(*) FROM now) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM held GROUP BY 1),
    points AS (SELECT a.query_no, p.doc_id, sum(d.idf * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len(l.terms) / (SELECT avg(len(terms)) FROM now)))) AS score, count(*) AS found
    FROM asked a JOIN held p USING (term) JOIN df d USING (term) JOIN now l ON l.doc_id = p.doc_id GROUP BY 1, 2)
    SELECT query_no, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc_id) AS rank FROM points s
    WHERE found = (SELECT count(*) FROM asked a WHERE a.query_no = s.query_no)) WHERE rank <= 20""",
)
def _(t: Tables):
    changed = docs(t).where("doc_id % 5 = 0 and doc_id % 7 > 0").select("doc_id", F.concat(F.lit("the and aux la "), "doc_id").alias("text"))
    before = search.stored(search.build_index(docs(t), stems=False))
    after = search.change_index(before, changed, docs(t).where("doc_id % 7 = 0").select("doc_id"), stems=False)
    return search.search(after, QUERIES, stems=False).withColumn("score", F.round("score", 6))


@query("search_stemmed")
def _(t: Tables):
    return search.search(search.stored(search.build_index(docs(t))), ["running", "nations", "the"])


@query(
    "update_index",
    f"""SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 5 = 0 THEN 'Neue Fassung ' || doc_id ELSE text END)), '{PATTERN}')) AS term
    FROM documents WHERE doc_id % 7 > 0) GROUP BY 1, 2""",
)
def _(t: Tables):
    changed = docs(t).where("doc_id % 5 = 0 and doc_id % 7 > 0").select("doc_id", F.concat(F.lit("Neue Fassung "), "doc_id").alias("text"))
    deleted = docs(t).where("doc_id % 7 = 0").select("doc_id")
    before = search.stored(search.build_index(docs(t), stems=False))
    return search.change_index(before, changed, deleted, stems=False).postings.select("term", "doc_id", "tf")


VIEWS["entity_docs"] = "SELECT id * 10 + i AS doc_id, apps[i] AS text FROM obs, (SELECT unnest([1, 2]) AS i)"


@query("build_entity_index", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM entity_docs) GROUP BY 1, 2")
def _(t: Tables):
    rows = t.obs().select("id", F.posexplode("apps").alias("i", "text")).select((F.col("id") * 10 + F.col("i") + 1).alias("doc_id"), "text")
    return search.build_index(rows, stems=False).postings.select("term", "doc_id", "tf")
