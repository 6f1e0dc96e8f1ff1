"""Vector similarity, clusters and the global name vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayweave.catalog.base import VIEWS, Tables, query
from dayweave.functions.numbers import cosine
from dayweave.operators import names, vectors


def table(t: Tables):
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


VIEWS["vecs"] = "SELECT vec_id AS id, [x::DOUBLE FOR x IN embedding] AS v, label FROM embeddings"


@query("cosine", "SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vecs a JOIN vecs b ON b.id = a.id + 1")
def _(t: Tables):
    a, b = table(t), table(t).select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select("id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("similarity"))


@query(
    "similar_vectors",
    """SELECT v.id, CAST(n AS INTEGER) AS query_no, round(list_cosine_similarity(v.v, q), 6) AS similarity FROM vecs v, (SELECT n, [CASE WHEN i % 2 = n THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END FOR i IN range(64)] AS q
    FROM (SELECT unnest([0, 1]) AS n)) WHERE list_cosine_similarity(v.v, q) >= 0.1""",
)
def _(t: Tables):
    asked = [(n, [1.0 if i % 2 == n else 0.1 for i in range(64)]) for n in (0, 1)]
    return vectors.similar_vectors(table(t), asked, 0.1).withColumn("similarity", F.round("similarity", 6))


@query(
    "cosine_pairs",
    """SELECT a.label, a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM vecs a JOIN vecs b ON a.label = b.label AND a.id < b.id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.35""",
)
def _(t: Tables):
    return vectors.cosine_pairs(table(t), 0.35, ["label"]).withColumn("similarity", F.round("similarity", 6))


@query(
    "cluster_embeddings",
    """WITH RECURSIVE units AS (SELECT label, id, [x / sqrt(list_inner_product(v, v)) FOR x IN v] AS u FROM vecs),
    rounds AS (
      SELECT label, list({'ids': [id], 's': u} ORDER BY id) AS cs FROM units GROUP BY label
      UNION ALL
      SELECT label, list_append([c FOR c IN cs IF NOT list_has_any(c.ids, list_concat(p.x.ids, p.y.ids))],
        {'ids': list_concat(p.x.ids, p.y.ids), 's': [p.x.s[i] + p.y.s[i] FOR i IN range(1, len(p.x.s) + 1)]})
      FROM rounds JOIN (
        SELECT a.label, arg_max({'x': x, 'y': y}, list_inner_product(x.s, y.s) / (len(x.ids) * len(y.ids))) AS p
        FROM (SELECT label, unnest(cs) AS x FROM rounds) a JOIN (SELECT label, unnest(cs) AS y FROM rounds) b ON a.label = b.label AND x.ids[1] < y.ids[1]
        GROUP BY a.label HAVING max(list_inner_product(x.s, y.s) / (len(x.ids) * len(y.ids))) > 0.44) USING (label))
    SELECT label, unnest(c.ids) AS id, list_min(c.ids) AS cluster_id
    FROM (SELECT label, unnest(arg_min(cs, len(cs))) AS c FROM rounds GROUP BY label)""",
)
def _(t: Tables):
    return vectors.cluster_embeddings(table(t), 0.56, ["label"])


@query(
    "normalize_apps_global",
    """SELECT id, array_to_string(list_sort(list_distinct([CASE x WHEN 'chrome' THEN 'Google Chrome' WHEN 'Ghosty' THEN 'Ghostty' ELSE x END FOR x IN apps IF x <> 'a'])), '|') AS apps FROM obs""",
)
def _(t: Tables):
    return names.normalize_apps_global(t.obs().select("id", "apps")).select("id", F.array_join("apps", "|").alias("apps"))
