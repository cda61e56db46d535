"""Labels of parts resolved to codes, and personal data masked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import aliases
from ..operators.aliases import NOISE
from .registry import query, spread, table


def _normal_sql(x: str) -> str:
    text = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\([^)]*\\)', ' ', 'g'), '[^0-9a-z가-힣]+', '', 'g')"
    for token in NOISE:
        text = f"replace({text}, '{token}', '')"
    return text


# A part's name is an alias of its noun; adjectives alone belong to many nouns and so to none. Labels are names as
# they are, within longer text, misspelt, or unknown.
LABELS_SQL = f"""
    named AS (SELECT p_partkey AS id, p_brand AS doc, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 5 AS kind FROM part),
    labels AS (SELECT id, doc, CASE kind WHEN 0 THEN upper(p_name) || ' (kg)' WHEN 1 THEN 'total of ' || p_name || ' per year' WHEN 2 THEN a || 'x ' || b WHEN 3 THEN p_name || 's-' || substr(b, 1, 2) ELSE 'zq' || id END AS label FROM named),
    raw AS (SELECT p_name AS alias, b AS code, row_number() OVER (ORDER BY p_name) AS ord FROM (SELECT DISTINCT p_name, b FROM named) UNION ALL SELECT DISTINCT a, b, 1000000 FROM named),
    idx AS (SELECT alias, min(code) AS code, min(ord) AS ord FROM (SELECT {_normal_sql('alias')} AS alias, code, ord FROM raw) WHERE length(alias) >= 2 GROUP BY alias HAVING count(DISTINCT code) = 1),
    n AS (SELECT DISTINCT {_normal_sql('label')} AS norm FROM labels),
    held AS (SELECT norm, code FROM (SELECT norm, any_value(code) AS code, count(DISTINCT code) AS n, length(alias) AS size FROM n JOIN idx ON contains(norm, alias) WHERE norm NOT IN (SELECT alias FROM idx) GROUP BY norm, length(alias)) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY size DESC) = 1 AND n = 1),
    nb AS (SELECT norm, list_distinct(list_transform(range(1, length(norm)), lambda i: substr(norm, i, 2))) AS g FROM n WHERE length(norm) >= 2 AND norm NOT IN (SELECT alias FROM idx) AND norm NOT IN (SELECT norm FROM held)),
    ab AS (SELECT *, list_distinct(list_transform(range(1, length(alias)), lambda i: substr(alias, i, 2))) AS h FROM idx),
    sc AS (SELECT norm, code, ord, len(list_intersect(g, h))::DOUBLE / len(list_distinct(list_concat(g, h))) AS s FROM nb, ab WHERE len(list_intersect(g, h)) > 0),
    rk AS (SELECT norm, code, s, coalesce(lead(s) OVER (PARTITION BY norm ORDER BY s DESC, ord), 0) AS second, row_number() OVER (PARTITION BY norm ORDER BY s DESC, ord) AS k FROM sc),
    found AS (SELECT alias AS norm, code, 1.0::DOUBLE AS confidence, 'exact' AS method FROM idx UNION ALL SELECT norm, code, 0.9, 'exact' FROM held
              UNION ALL SELECT norm, CASE WHEN s >= 0.62 AND s - second >= 0.08 THEN code END, round(s, 3), CASE WHEN s >= 0.62 AND s - second >= 0.08 THEN 'fuzzy' ELSE 'none' END FROM rk WHERE k = 1),
    resolved AS (SELECT id, doc, label, code, coalesce(confidence, 0) AS confidence, coalesce(method, 'none') AS method FROM labels LEFT JOIN found ON norm = {_normal_sql('label')})"""


def resolved(spark, d):
    p = table(spark, d, "part").withColumns({"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2)), "kind": F.col("p_partkey") % 5})
    kind = F.col("kind")
    label = F.when(kind == 0, F.concat(F.upper("p_name"), F.lit(" (kg)"))).when(kind == 1, F.concat(F.lit("total of "), "p_name", F.lit(" per year"))).when(kind == 2, F.concat("a", F.lit("x "), "b"))
    label = label.when(kind == 3, F.concat("p_name", F.lit("s-"), F.substr("b", F.lit(1), F.lit(2)))).otherwise(F.concat(F.lit("zq"), "p_partkey"))
    names = p.select(F.col("p_name").alias("alias"), F.col("b").alias("code")).distinct()
    # The list's order is that of the names: a text that sorts as they do serves as their place.
    raw = names.select("alias", "code", F.col("alias").alias("ord")).unionByName(p.select(F.col("a").alias("alias"), F.col("b").alias("code"), F.lit("~").alias("ord")).distinct())
    return aliases.resolve(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), label.alias("label")), raw)


@query(f"WITH {LABELS_SQL} SELECT id, label, code, confidence, method FROM resolved")
def alias_resolution(spark, d):
    """Exact, contained and fuzzy labels, and those that stay open."""
    return resolved(spark, d).select("id", "label", "code", F.round("confidence", 3).alias("confidence"), "method")


@query(f"""WITH {LABELS_SQL},
    m AS (SELECT id, doc, CASE WHEN id % 7 = 0 THEN code END AS code, code AS wanted, method, confidence FROM resolved),
    w AS (SELECT id, row_number() OVER (PARTITION BY doc, wanted ORDER BY id) AS k FROM m WHERE code IS NULL AND wanted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m o WHERE o.doc = m.doc AND o.code = m.wanted))
    SELECT id, doc, CASE WHEN k = 1 THEN wanted ELSE code END AS code, CASE WHEN k = 1 AND method = 'fuzzy' THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence FROM m LEFT JOIN w USING (id)""")
def alias_backfill(spark, d):
    """Codes given to metrics without one, once a document."""
    m = resolved(spark, d).select("id", "doc", F.when(F.col("id") % 7 == 0, F.col("code")).alias("code"), F.col("code").alias("resolved"), "method", F.round("confidence", 3).alias("confidence"))
    return aliases.backfill(m, order="id").select("id", "doc", "code", "confidence")


@query("""SELECT c_custkey AS id, 'card [CARD], id [RRN], firm [BRN], call [PHONE] or [PHONE], mail [EMAIL], pay [ACCT] on 2024-01-31, part 12-34-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ', no ' || (c_custkey + 10000000000) AS text FROM customer""")
def pii_masked_records(spark, d):
    """Every kind of personal data in a record, next to dates, short groups and long numbers that stay."""
    k = F.col("c_custkey")
    pad = lambda n: F.lpad((k % 10 ** n).cast("string"), n, "0")
    text = F.concat(
        F.lit("card 1234-5678-9012-"), pad(4), F.lit(", id 900101-1"), pad(6), F.lit(", firm 123-45-"), pad(5), F.lit(", call 010-123-"), pad(4), F.lit(" or 02-1234-"), pad(4), F.lit(", mail a.b"), k, F.lit("@x-y.co.kr, pay 110-234-"), pad(6),
        F.lit(" on 2024-01-31, part 12-34-"), pad(2), F.lit(", no "), k + 10000000000,
    )
    # A few bytes a row make a long text, so rows and not bytes are dealt out.
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("id"), pii.masked(text).alias("text"))
