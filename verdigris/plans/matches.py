"""Sentences and items matched with what shares words with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences
from ..operators import overlap
from .registry import query, table
from .statements import CLAIMS_SQL, TEXTS_SQL, evidence, figures, statements

# Each supplier's items, with names and notes; every third has no third one.
ITEMS = [(1, "E-4-2", "재생에너지 사용", "전년 대비 재생에너지"), (2, "E-6-1", "폐기물 처리", "폐기물"), (3, "G-1-1", "친환경 기업", "선도적"), (4, "S-1-1", "보고서 목표", "")]
ITEMS_SQL = "items AS (SELECT DISTINCT corp, ord, code, name, note FROM f, (VALUES " + ", ".join(map(str, ITEMS)) + ") i(ord, code, name, note) WHERE ord <> 3 OR corp % 3 <> 0)"
# Each supplier's item with the words to look for in its evidence, and its figures as evidence with a text.
SEARCHES = [("E-4-2", ["E-4-2", "TJ"]), ("E-6-1", ["E-6-1", "톤"]), ("X-1", ["1994", "nothing"]), ("X-2", ["nothing at all"])]
NODES_SQL = "told AS (SELECT corp, period, node_id, code AS metric, code || ' in ' || period AS raw_text, unit, ord FROM nodes)"


def items(f):
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(c).alias("code"), F.lit(n).alias("name"), F.lit(t).alias("note")) for o, c, n, t in ITEMS])
    return f.select("corp").distinct().select("corp", F.explode(rows).alias("i")).select("corp", "i.*").where((F.col("ord") != 3) | (F.col("corp") % 3 != 0))


@query(rf"""WITH c AS (SELECT doc_id || ':' || i AS chunk_id, list_distinct(list_filter(regexp_split_to_array(line, '{overlap.BLANK}'), lambda x: x <> '')) AS w
        FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    s AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '{overlap.BLANK}'), lambda x: x <> ''))) AS word FROM benchmark),
    p AS (SELECT chunk_id, unnest(w) AS word FROM c),
    n AS (SELECT item_id, chunk_id, count(*)::INT AS overlap FROM s JOIN p USING (word) GROUP BY ALL)
    SELECT item_id, chunk_id, overlap, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, chunk_id DESC)::INT AS rank FROM n QUALIFY rank <= 3""")
def benchmark_line_overlap(spark, d):
    """The three lines of all documents that share most words with each benchmark text."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    chunks = lines.select(F.concat_ws(":", "doc_id", "i").alias("chunk_id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("sentence_id"), "text")
    return overlap.top_overlaps(asked, chunks).withColumnRenamed("sentence_id", "item_id")


@query(f"""WITH {CLAIMS_SQL}, {ITEMS_SQL},
    n AS (SELECT id, sentence, ord, code, len(list_filter(string_split(name, ' ') || string_split(note, ' '), lambda w: w <> '' AND contains(s, w))) AS n, (note <> '' AND contains(s, note)) OR (name <> '' AND contains(s, name)) AS named FROM sent JOIN items USING (corp))
    SELECT id, sentence, CASE WHEN max(n) > 0 THEN arg_max(code, n * 100 - ord) END AS code, coalesce(string_agg(code, ',' ORDER BY ord) FILTER (named), '') AS codes FROM n GROUP BY id, sentence""")
def sentence_items(spark, d):
    """The item that shares most words with each sentence, and the items that it names."""
    f = figures(spark, d)
    said = statements(f).select("id", "corp", F.posexplode(sentences.sentences(F.col("text"))).alias("sentence", "text"))
    both = overlap.named_items(overlap.likeliest_items(said, items(f), ["corp"]), items(f), ["corp"])
    return both.select("id", "sentence", "code", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {TEXTS_SQL}, {NODES_SQL}, k(code, words) AS (VALUES {", ".join(f"('{c}', {w})" for c, w in SEARCHES)}), i AS (SELECT DISTINCT corp, period, code, words FROM f, k)
    SELECT corp, period, code, coalesce(array_to_string(list_transform(list_sort(list({{'o': ord, 'n': node_id}}) FILTER (hit)), lambda x: x.n), ','), '') AS node_ids FROM
    (SELECT i.corp, i.period, i.code, t.ord, t.node_id, list_contains(words, metric) OR len(list_filter(words, lambda w: contains(metric || ' ' || raw_text || ' ' || coalesce(unit, ''), w))) > 0 AS hit FROM i LEFT JOIN told t USING (corp, period)) GROUP BY ALL""")
def item_evidence_nodes(spark, d):
    """The evidence of each supplier and year that an item's words find."""
    f = figures(spark, d)
    nodes = evidence(f)[0].select("corp", "period", "node_id", F.col("code").alias("metric"), F.concat_ws(" in ", "code", "period").alias("raw_text"), "unit", "ord")
    wanted = F.array(*[F.struct(F.lit(c).alias("code"), F.array(*map(F.lit, w)).alias("keywords")) for c, w in SEARCHES])
    asked = f.select("corp", "period", F.explode(wanted).alias("i")).select("corp", "period", "i.*")
    return overlap.item_nodes(asked, nodes, ["corp", "period"]).withColumn("node_ids", F.array_join("node_ids", ","))
