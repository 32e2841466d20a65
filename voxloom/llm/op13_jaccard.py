"""N-gram Jaccard join: groups of documents that share nearly all of their word shingles.

The method (size-banded tiles, hashed bitmaps whose bit counts bound the overlap, exact intersection of sorted arrays) is in :mod:`voxloom.llm.jaccard`. All links
between different sets count; copies are one set and are never paired.

Defined cases: a text of fewer words than a shingle has the whole sequence as its only shingle; a null or empty text or one of white space
has no shingle and is a component of its own; rows that repeat a doc_id get a row each, linked by their own
texts; a null doc_id keeps its row and never names a component unless the component has no other id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.jaccard import similar_sets
from voxloom.llm.shared import written

#: Words in a shingle, and the share of the union, in per cent, from which on two sets are linked.
SHINGLE, PERCENT = 3, 90


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows, sets = similar_sets(docs, shingle, percent)
    least = sets.where("m > 0").groupBy("label").agg(F.min("first").alias("least"))
    names = written(sets.where("m > 0").join(least, "label").select("id", F.col("least.doc_id").alias("component_id")), "names")
    linked = rows.where("m > 0").join(names, "id").select("doc_id", F.col("m").alias("n_shingles"), "component_id")
    return linked.unionAll(rows.where("m = 0").select("doc_id", F.col("m").alias("n_shingles"), F.col("doc_id").alias("component_id")))


SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS m, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.m) + any_value(b.m) AS m, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.m, b.m) >= 90 * greatest(a.m, b.m) GROUP BY ALL),
    l AS (SELECT a, b FROM p WHERE 100 * n >= 90 * (m - n) UNION ALL SELECT b, a FROM p WHERE 100 * n >= 90 * (m - n)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
