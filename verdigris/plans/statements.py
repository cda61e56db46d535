"""Statements of suppliers about their own figures, held against evidence: claims, axes of risk, grounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lexicon import FALLS, OVERCLAIMS, PERFECT, RISES, TOPICS, VAGUE
from ..functions.measures import risk_level
from ..functions.numbers import NUMBER, NUMBER_UNIT, UNIT_FAMILIES, UNIT_NAMES
from ..functions.sentences import sentences
from ..operators import claims, grounding, industry, retrieval, similarity
from .registry import query, table

# Each supplier's quantities by year are its figures; what it says of them is off by a twentieth for every step of its id modulo 5.
SERIES_SQL = "SELECT l_suppkey AS corp, CAST(year(l_shipdate) AS INT) AS period, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL"
BOAST = "선도적 친환경 기업으로 앞장서고 있다."
TEXTS_SQL = f"""
    f AS ({SERIES_SQL}),
    texts AS (SELECT corp * 10000 + period AS id, corp, '재생에너지 사용량은 ' || format('{{:,}}', q + (q * (corp % 5)) // 20) || ' TJ로 전년 대비 감소하였다. 폐기물 ' || format('{{:,}}', n) || ' 톤을 처리했다! '
              || CASE WHEN corp % 4 = 0 THEN '{BOAST}' ELSE '보고서 ' || period || '년.' END AS text FROM f),
    nodes AS (SELECT corp, 'E-4-2' AS code, 'n:' || corp || ':E-4-2:' || period AS node_id, q::DOUBLE AS value, 'TJ' AS unit, period, 1 AS ord FROM f
              UNION ALL SELECT corp, 'E-6-1', 'n:' || corp || ':E-6-1:' || period, n::DOUBLE, CASE WHEN corp % 3 = 0 THEN NULL WHEN corp % 3 = 1 THEN '톤' ELSE 'kg' END, period, 2 FROM f),
    edges AS (SELECT corp, 'n:' || corp || ':E-4-2:' || period AS target_id, round((q - lag(q) OVER w)::DOUBLE / abs(lag(q) OVER w) * 100, 3) AS yoy FROM f WINDOW w AS (PARTITION BY corp ORDER BY period) QUALIFY lag(q) OVER w IS NOT NULL
              UNION ALL SELECT corp, 'n:' || corp || ':E-6-10:' || period, CASE WHEN period % 2 = 0 THEN n::DOUBLE - 86 END FROM f WHERE corp % 3 = 0)"""
TOPIC_SQL = ", ".join(f"({i}, '{w}', '{c}')" for i, (w, _, c) in enumerate(TOPICS))
CLAIMS_SQL = rf"""{TEXTS_SQL},
    sent AS (SELECT id, corp, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sentence FROM (SELECT id, corp, string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM texts)),
    hits AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT id, corp, sentence, s, string_split_regex(s, '{claims.CLAIM}') AS p, regexp_extract_all(s, '{claims.CLAIM}', 0) AS h, regexp_extract_all(s, '{claims.CLAIM}', 1) AS nums, regexp_extract_all(s, '{claims.CLAIM}', 2) AS units FROM sent)),
    spans AS (SELECT id, corp, sentence, i - 1 AS nth, s, nums[i] || ' ' || units[i] AS claim, replace(nums[i], ',', '')::DOUBLE AS number, units[i] AS unit, length(array_to_string(list_transform(range(1, i), lambda j: p[j] || h[j]), '') || p[i]) AS b, length(h[i]) AS l FROM hits),
    near AS (SELECT id, corp, sentence, nth, s, claim, number, unit, right(substr(s, 1, b), 25) AS before, substr(s, b + l + 1, 25) AS after FROM spans),
    topics(t, w, code) AS (VALUES {TOPIC_SQL}),
    claims AS (SELECT id, any_value(corp) AS corp, sentence, nth, any_value(s) AS s, any_value(claim) AS claim, any_value(number) AS number, any_value(unit) AS unit,
        arg_min(code, CASE WHEN contains(before, w) THEN position(reverse(w) IN reverse(before)) * 100 + t WHEN contains(after, w) THEN 1000000 + position(w IN after) * 100 + t WHEN contains(s, w) THEN 2000000 + t END) AS code
        FROM near CROSS JOIN topics GROUP BY id, sentence, nth)"""


def figures(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("corp"), F.year("l_shipdate").alias("period")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))


def statements(f):
    said = F.col("q") + F.floor(F.col("q") * (F.col("corp") % 5) / 20)
    last = F.when(F.col("corp") % 4 == 0, BOAST).otherwise(F.concat(F.lit("보고서 "), "period", F.lit("년.")))
    text = F.concat(F.lit("재생에너지 사용량은 "), F.format_number(said, 0), F.lit(" TJ로 전년 대비 감소하였다. 폐기물 "), F.format_number("n", 0), F.lit(" 톤을 처리했다! "), last)
    return f.select((F.col("corp") * 10000 + F.col("period")).alias("id"), "corp", text.alias("text"))


def evidence(f):
    """(nodes, edges) of the figures."""

    def node(code, value, unit, order):
        name = F.concat_ws(":", F.lit("n"), "corp", F.lit(code), "period")
        return F.struct(F.lit(code).alias("code"), name.alias("node_id"), F.col(value).cast("double").alias("value"), unit.alias("unit"), F.lit(order).alias("ord"))

    before = F.lag("q").over(Window.partitionBy("corp").orderBy("period"))
    name = lambda code: F.concat_ws(":", F.lit("n"), "corp", F.lit(code), "period").alias("target_id")
    edges = f.select("corp", name("E-4-2"), F.round((F.col("q") - before) / F.abs(before) * 100, 3).alias("yoy")).where("yoy IS NOT NULL")
    # Edges of a code that holds another one's, every second without a change.
    edges = edges.unionByName(f.where("corp % 3 = 0").select("corp", name("E-6-10"), F.when(F.col("period") % 2 == 0, F.col("n").cast("double") - 86).alias("yoy")))
    waste = F.when(F.col("corp") % 3 == 1, "톤").when(F.col("corp") % 3 == 2, "kg")
    both = F.array(node("E-4-2", "q", F.lit("TJ"), 1), node("E-6-1", "n", waste, 2))
    return f.select("corp", "period", F.explode(both).alias("x")).select("corp", "x.code", "x.node_id", "x.value", "x.unit", "period", "x.ord"), edges


@query(f"WITH {CLAIMS_SQL} SELECT id, sentence, nth, claim, number, unit, code FROM claims")
def claims_with_topics(spark, d):
    return claims.numeric_claims(statements(figures(spark, d))).drop("text").withColumns({"sentence": F.col("sentence").cast("long"), "nth": F.col("nth").cast("long")})


CANON = "CASE lower(coalesce({u}, '')) WHEN '톤' THEN 'ton' ELSE lower(coalesce({u}, '')) END"
D1_SQL = f"""{CLAIMS_SQL},
    met AS (SELECT c.id, c.sentence, c.nth, any_value(c.number) AS number, arg_max({{'id': n.node_id, 'value': n.value}}, n.period * 10 - n.ord) AS node
            FROM claims c JOIN nodes n ON n.corp = c.corp AND n.code = c.code AND ({CANON.format(u='n.unit')} IN ('', {CANON.format(u='c.unit')})) GROUP BY ALL),
    d1 AS (SELECT id, sentence, round(least(1.0, coalesce(max(abs(number - node.value) / abs(node.value)), 0) / 0.15), 4) AS d1, list(node.id ORDER BY nth) AS nodes FROM met WHERE node.value <> 0 GROUP BY ALL)"""


@query(f"WITH {D1_SQL} SELECT id, sentence, d1, array_to_string(nodes, ',') AS nodes, CASE WHEN d1 < 0.25 THEN 'low' WHEN d1 < 0.5 THEN 'medium' ELSE 'high' END AS level FROM d1")
def claim_vs_evidence_asof(spark, d):
    """Each sentence's figures against the latest evidence of their code in units that compare."""
    f = figures(spark, d)
    texts, (nodes, _) = statements(f), evidence(f)
    made = claims.numeric_claims(texts).join(texts.select("id", "corp"), "id")
    scored = claims.numeric_axis(claims.with_evidence(made, nodes, ["corp"]), ["id", "sentence"]).where(F.size("nodes") > 0)
    return scored.select("id", F.col("sentence").cast("long").alias("sentence"), "d1", F.array_join("nodes", ",").alias("nodes"), risk_level(F.col("d1")).alias("level"))


# What each supplier's questions are looked up in: guidelines for all, texts of its industry, its own figures.
GUIDELINES = ["재생에너지 사용 비율을 연도별로 공시한다.", "폐기물 처리량은 톤으로 적고 재활용을 구분한다.", "이사회의 다양성과 출석률을 적는다.", "온실가스 배출량은 검증 기관의 확인을 받는다."]
INDUSTRIES = [(str(i), f"{i}{j}", text) for i in range(5) for j, text in enumerate([f"업종 {i}의 재생에너지 전환은 {i + 2} TJ를 넘는다.", f"업종 {i}에서는 폐기물 {i * 7} 톤이 나온다."]) if (i, j) != (3, 0)]
QUESTIONS = ("재생에너지 사용량, 폐기물 E-4-2", "폐기물 처리 톤")
CHANNELS_SQL = f"""
    docs AS (SELECT 'guideline' AS channel, 'all' AS scope, 'g' || i AS doc_id, t AS text, '' AS code, 'guideline' AS source FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(GUIDELINES))}) g(i, t)
        UNION ALL SELECT 'industry', s, 'i' || i, t, '', 'industry' FROM (VALUES {", ".join(map(str, INDUSTRIES))}) v(s, i, t)
        UNION ALL SELECT 'corp', corp::VARCHAR, node_id, '[' || code || '] ' || CASE WHEN code = 'E-4-2' THEN '재생에너지 사용량' ELSE '폐기물 처리' END || ' 수치: ' || value::BIGINT || ' ' || coalesce(unit, '') || ' ' || period || '년', code, CASE WHEN code = 'E-4-2' THEN 'dart_struct' ELSE 'snippet' END FROM nodes),
    wanted AS (SELECT corp AS query_id, CASE WHEN corp % 2 = 0 THEN '{QUESTIONS[0]}' ELSE '{QUESTIONS[1]}' END AS text, unnest(['guideline', 'industry', 'corp']) AS channel, unnest(['all', (corp % 5)::VARCHAR, corp::VARCHAR]) AS scope FROM (SELECT DISTINCT corp FROM f))"""
PAIRS_OF = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '') || list_filter(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)), lambda x: NOT regexp_full_match(x, '\s*'))"
BUCKET_SQL = "('0x' || substr(md5(term), 31, 2))::INT AS bucket"
HITS_SQL = f"""{CHANNELS_SQL},
    ct AS (SELECT channel, scope, doc_id, {PAIRS_OF.format(t='text')} AS w FROM docs),
    ctf AS (SELECT channel, scope, doc_id, n_terms, term, {BUCKET_SQL}, count(*) AS tf FROM (SELECT channel, scope, doc_id, len(w) AS n_terms, unnest(w) AS term FROM ct) GROUP BY ALL),
    cst AS (SELECT channel, scope, count(*) AS n_docs, avg(len(w)::DOUBLE) AS avg_terms FROM ct GROUP BY ALL),
    cdf AS (SELECT channel, scope, term, count(*) AS df FROM ctf GROUP BY ALL),
    aq AS (SELECT DISTINCT channel, scope, text FROM wanted),
    aqt AS (SELECT channel, scope, text, term, {BUCKET_SQL}, count(*) AS qtf FROM (SELECT channel, scope, text, unnest({PAIRS_OF.format(t='text')}) AS term FROM aq) GROUP BY ALL),
    sc AS (SELECT channel, scope, text, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / avg_terms))), 6) AS score FROM ctf JOIN aqt USING (channel, scope, term) JOIN cdf USING (channel, scope, term) JOIN cst USING (channel, scope) GROUP BY ALL),
    db AS (SELECT channel, scope, doc_id, bucket, sum(tf) AS n FROM ctf GROUP BY ALL), dn AS (SELECT channel, scope, doc_id, sqrt(sum(n * n)) AS norm FROM db GROUP BY ALL),
    qb AS (SELECT channel, scope, text, bucket, sum(qtf) AS n FROM aqt GROUP BY ALL), qn AS (SELECT channel, scope, text, sqrt(sum(n * n)) AS norm FROM qb GROUP BY ALL),
    cs AS (SELECT db.channel, db.scope, qb.text, db.doc_id, round(sum(db.n * qb.n) / any_value(dn.norm) / any_value(qn.norm), 6) AS score FROM db JOIN qb USING (channel, scope, bucket) JOIN dn ON dn.channel = db.channel AND dn.scope = db.scope AND dn.doc_id = db.doc_id JOIN qn ON qn.channel = db.channel AND qn.scope = db.scope AND qn.text = qb.text GROUP BY ALL),
    both_ AS (SELECT *, 0.55 AS weight FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY channel, scope, text ORDER BY score DESC, doc_id) <= 8 UNION ALL SELECT *, 0.45 FROM cs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY channel, scope, text ORDER BY score DESC, doc_id) <= 8),
    scaled AS (SELECT *, weight * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM both_ WINDOW w AS (PARTITION BY channel, scope, text, weight)),
    summed AS (SELECT channel, scope, text, doc_id, round(sum(s) + any_value(CASE WHEN code <> '' AND contains(scaled.text, code) THEN 0.35 ELSE 0 END + CASE WHEN source = 'dart_struct' THEN 0.05 ELSE 0 END), 4) AS score FROM scaled JOIN (SELECT channel, scope, doc_id, code, source FROM docs) USING (channel, scope, doc_id) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY channel, scope, text ORDER BY score DESC, doc_id) AS rank FROM summed QUALIFY rank <= 3),
    found AS (SELECT query_id, channel, doc_id, score::DOUBLE AS score, rank FROM wanted JOIN best USING (channel, scope, text))"""


def channel_docs(spark, f):
    """(channel, scope, doc_id, text, code, source) of all three channels."""
    own = evidence(f)[0]
    structured = F.col("code") == "E-4-2"
    text = F.concat(F.lit("["), "code", F.lit("] "), F.when(structured, "재생에너지 사용량").otherwise("폐기물 처리"), F.lit(" 수치: "), F.col("value").cast("long"), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(" "), "period", F.lit("년"))
    mine = own.select(F.lit("corp").alias("channel"), F.col("corp").cast("string").alias("scope"), F.col("node_id").alias("doc_id"), text.alias("text"), "code", F.when(structured, "dart_struct").otherwise("snippet").alias("source"))
    rows = [("guideline", "all", f"g{i}", t, "", "guideline") for i, t in enumerate(GUIDELINES)] + [("industry", s, f"i{i}", t, "", "industry") for s, i, t in INDUSTRIES]
    return mine.unionByName(spark.createDataFrame(rows, mine.schema))


def channel_hits(spark, f):
    """(docs, hits): hits are the three best of each channel for each supplier's question."""
    docs = channel_docs(spark, f)
    corp = F.col("corp")
    scopes = F.create_map(F.lit("guideline"), F.lit("all"), F.lit("industry"), (corp % 5).cast("string"), F.lit("corp"), corp.cast("string"))
    questions = f.select("corp").distinct().select(corp.alias("query_id"), F.when(corp % 2 == 0, QUESTIONS[0]).otherwise(QUESTIONS[1]).alias("text"), scopes.alias("scopes"))
    return docs, retrieval.channels(docs, questions, 3)


@query(f"WITH {TEXTS_SQL}, {HITS_SQL} SELECT * FROM found")
def three_channel_hits(spark, d):
    """Guidelines, industry texts and own figures retrieved for each supplier, a list a channel."""
    return channel_hits(spark, figures(spark, d))[1].withColumn("rank", F.col("rank").cast("long"))


# Cosines of hashed bags: of a, rows (id, key, text), to b, rows (key, chunk, text).
COSINE_SQL = """{n}_a AS (SELECT {id}, key, bucket, count(*) AS n FROM (SELECT {id}, key, ('0x' || substr(md5(term), 31, 2))::INT AS bucket FROM (SELECT {id}, key, unnest({pairs}) AS term FROM {a})) GROUP BY ALL),
    {n}_b AS (SELECT key, chunk, bucket, count(*) AS n FROM (SELECT key, chunk, ('0x' || substr(md5(term), 31, 2))::INT AS bucket FROM (SELECT key, chunk, unnest({pairs}) AS term FROM {b})) GROUP BY ALL),
    {n}_an AS (SELECT {id}, sqrt(sum(n * n)) AS an FROM {n}_a GROUP BY ALL), {n}_bn AS (SELECT key, chunk, sqrt(sum(n * n)) AS bn FROM {n}_b GROUP BY ALL),
    {n}_dot AS (SELECT {id}, x.key, chunk, sum(x.n * y.n) AS dot FROM {n}_a x JOIN {n}_b y USING (key, bucket) GROUP BY ALL),
    {n} AS (SELECT {id}, key, chunk, round(coalesce(dot / (an * bn), 0), 6) AS cosine FROM (SELECT DISTINCT {id}, key FROM {a}) JOIN {n}_bn USING (key) LEFT JOIN {n}_dot USING ({id}, key, chunk) LEFT JOIN {n}_an USING ({id}))"""
D3_SQL = f"""{HITS_SQL},
    vec_s AS (SELECT id, sentence, corp AS key, s AS text FROM sent), vec_t AS (SELECT query_id AS key, channel || doc_id AS chunk, docs.text FROM found JOIN docs USING (channel, doc_id)),
    {COSINE_SQL.format(n='vec', id='id, sentence', pairs=PAIRS_OF.format(t='text'), a='vec_s', b='vec_t')},
    sim AS (SELECT id, sentence, max(cosine) AS sim FROM vec GROUP BY ALL)"""


COUNT_VAGUE = " + ".join(f"contains(s, '{p}')::INT" for p in VAGUE)
SAYS = {k: "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")" for k, words in (("down", FALLS), ("up", RISES))}
RISK_SQL = f"""{D1_SQL}, {D3_SQL},
    e AS (SELECT corp, target_id, count(*) AS n, count(*) FILTER (yoy > 0) AS ups, count(*) FILTER (yoy < 0) AS downs FROM edges GROUP BY ALL),
    d5 AS (SELECT id, sentence, round(least(1.0, sum(CASE WHEN {SAYS['down']} THEN ups ELSE 0 END + CASE WHEN {SAYS['up']} THEN downs ELSE 0 END)::DOUBLE / sum(n) / 0.2), 4) AS d5 FROM (SELECT id, sentence, claims.s, e.n, ups, downs FROM claims JOIN e ON e.corp = claims.corp AND contains(e.target_id, claims.code)) GROUP BY id, sentence),
    axes AS (SELECT id, sentence, s, coalesce(d1, 0) AS d1, round(least(1.0, ({COUNT_VAGUE}) / 1.0), 4) AS d2, round(least(1.0, greatest(0.0, 0.35 - sim) / 0.35), 4) AS d3, coalesce(d5, 0) AS d5 FROM sent LEFT JOIN d1 USING (id, sentence) LEFT JOIN d5 USING (id, sentence) LEFT JOIN sim USING (id, sentence)),
    risks AS (SELECT *, round(0.40 * d1::DECIMAL(9, 4) + 0.25 * d2::DECIMAL(9, 4) + 0.25 * d3::DECIMAL(9, 4) + 0.10 * d5::DECIMAL(9, 4), 4)::DOUBLE AS risk FROM axes)"""
LEVEL = "CASE WHEN risk < 0.25 THEN 'low' WHEN risk < 0.5 THEN 'medium' ELSE 'high' END AS level"
TOP = "CASE greatest(d1, d2, d3::DOUBLE, d5) WHEN d1 THEN 'D1_numeric' WHEN d2 THEN 'D2_modifier' WHEN d3::DOUBLE THEN 'D3_semantic' ELSE 'D5_timeseries' END AS top_axis"


def risks(spark, d, registry=()):
    f = figures(spark, d)
    docs, hits = channel_hits(spark, f)
    texts = statements(f)
    chunks = hits.join(docs, ["channel", "doc_id"]).select(F.col("query_id").alias("corp"), "text")
    said = texts.select("id", "corp", F.posexplode(sentences(F.col("text"))).alias("sentence", "text"))
    near = similarity.retrieved_similarity(said, chunks, ["corp"], ["id", "sentence"])
    if not registry:
        return claims.sentence_risks(texts, *evidence(f), keys=["corp"], similarity=near)
    told = F.when(F.col("corp") % 4 == 2, "자동차 부품 제조업").when(F.col("corp") % 4 == 3, "Steel")
    texts = texts.withColumn("module", industry.module_of(F.when(F.col("corp") % 4 == 1, "chemicals").when(F.col("corp") % 8 == 7, "unknown"), told, registry))
    return claims.sentence_risks(texts, *evidence(f), keys=["corp"], similarity=near, module="module", registry=registry)


@query(f"WITH {RISK_SQL} SELECT id, sentence, d1, d2, d3::DOUBLE AS d3, d5, risk, {LEVEL}, {TOP} FROM risks")
def sentence_risk_vector(spark, d):
    return risks(spark, d).select("id", F.col("sentence").cast("long").alias("sentence"), "d1", "d2", "d3", "d5", "risk", "level", "top_axis")


@query(f"WITH {RISK_SQL} SELECT id, sentence, risk, {LEVEL}, {TOP} FROM risks QUALIFY row_number() OVER (PARTITION BY id ORDER BY risk DESC, sentence) = 1")
def worst_sentence(spark, d):
    return claims.worst_sentences(risks(spark, d)).select("id", F.col("sentence").cast("long").alias("sentence"), "risk", "level", "top_axis")


# Overrides of three industries: one is named, one told by an alias, one has terms that all have already.
REGISTRY = [
    industry.IndustryModule("automotive_parts", ("자동차부품", "Automotive"), {"vague": ("처리했다", "감소하였다", "선도적")}, {"weights": {"D2_modifier": 0.4, "D1_numeric": 0.25}}, {"d2_full": 4.0}),
    industry.IndustryModule("chemicals", ("화학",), {"vague": ("톤",)}), industry.IndustryModule("steel", ("steel", "철강"), {"vague": ("친환경",)}, {"weights": {"D5_timeseries": 0.35}}),
]
MODULE_SQL = "CASE WHEN corp % 4 = 1 THEN 'chemicals' WHEN corp % 8 = 7 THEN NULL WHEN corp % 4 = 2 THEN 'automotive_parts' WHEN corp % 4 = 3 THEN 'steel' END"
INDUSTRY_SQL = f"""{RISK_SQL},
    ind AS (SELECT id, sentence, module, d1, d3, d5, CASE module WHEN 'automotive_parts' THEN round(least(1.0, ({COUNT_VAGUE} + contains(s, '처리했다')::INT + contains(s, '감소하였다')::INT) / 4.0), 4) WHEN 'chemicals' THEN round(least(1.0, {COUNT_VAGUE} + contains(s, '톤')::INT), 4) ELSE d2 END AS d2 FROM axes JOIN (SELECT id, {MODULE_SQL} AS module FROM texts) USING (id)),
    irisks AS (SELECT *, round(CASE WHEN module = 'automotive_parts' THEN 0.25 ELSE 0.40 END * d1::DECIMAL(9, 4) + CASE WHEN module = 'automotive_parts' THEN 0.40 ELSE 0.25 END * d2::DECIMAL(9, 4) + 0.25 * d3::DECIMAL(9, 4) + CASE WHEN module = 'steel' THEN 0.35 ELSE 0.10 END * d5::DECIMAL(9, 4), 4)::DOUBLE AS risk FROM ind)"""


@query(f"WITH {INDUSTRY_SQL} SELECT id, sentence, d1, d2::DOUBLE AS d2, d3::DOUBLE AS d3, d5, risk, {LEVEL}, {TOP} FROM irisks")
def industry_risk_vector(spark, d):
    """Risk of sentences with the terms, weights and limits of their supplier's industry."""
    return risks(spark, d, REGISTRY).select("id", F.col("sentence").cast("long").alias("sentence"), "d1", "d2", "d3", "d5", "risk", "level", "top_axis")


CHECKED_SQL = f"""{CLAIMS_SQL},
    items AS (SELECT DISTINCT ON (corp, code) corp, code, value, unit FROM nodes ORDER BY corp, code, period DESC),
    checked AS (SELECT c.*, v.code AS has, CASE WHEN c.code IS NULL OR v.value IS NULL THEN 'unverifiable' WHEN coalesce(v.unit, '') <> '' AND lower(v.unit) <> lower(c.unit) THEN 'approximate'
        WHEN v.value = 0 OR abs(number - v.value) / abs(v.value) * 100 <= 10 THEN 'ok' ELSE 'mismatch' END AS verdict FROM claims c LEFT JOIN items v ON v.corp = c.corp AND v.code = c.code)"""


def checked(spark, d):
    f = figures(spark, d)
    texts, (nodes, _) = statements(f), evidence(f)
    items = nodes.groupBy("corp", "code").agg(F.max_by(F.struct("value", "unit"), "period").alias("x")).select("corp", "code", "x.value", "x.unit")
    return texts, claims.checked_claims(claims.numeric_claims(texts).join(texts.select("id", "corp"), "id"), items, ["corp"])


@query(f"WITH {CHECKED_SQL} SELECT coalesce(code, '-') AS code, verdict, count(*) AS n FROM checked GROUP BY ALL")
def claim_verdicts(spark, d):
    return checked(spark, d)[1].groupBy(F.coalesce("code", F.lit("-")).alias("code"), "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHECKED_SQL}, n AS (SELECT id, count(*) AS n, count(*) FILTER (verdict = 'mismatch') AS bad, count(*) FILTER (verdict = 'unverifiable') AS open FROM checked GROUP BY id),
    v AS (SELECT id, sum({COUNT_VAGUE}) AS vague FROM sent GROUP BY id), {CHANNELS_SQL},
    own_s AS (SELECT id, corp AS key, text FROM texts), own_t AS (SELECT scope::BIGINT AS key, doc_id AS chunk, text FROM docs WHERE channel = 'corp'), {COSINE_SQL.format(n='own', id='id', pairs=PAIRS_OF.format(t='text'), a='own_s', b='own_t')},
    whole AS (SELECT id, round(avg(cosine), 6) AS sim FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC) <= 5) GROUP BY id)
    SELECT id, round(100 * (0.45 * least(1.0, coalesce(bad, 0) / greatest(coalesce(n, 0), 1) * 2.0) + 0.10 * least(1.0, coalesce(open, 0) / greatest(coalesce(n, 0), 1)) + 0.25 * least(1.0, vague / 4.0) + 0.20 * greatest(0, 1 - sim))::DOUBLE, 1) AS risk FROM v JOIN whole USING (id) LEFT JOIN n USING (id)""")
def document_risk(spark, d):
    """Documents by mismatches, open claims, vague words, and their similarity to their supplier's own texts."""
    texts, verdicts = checked(spark, d)
    own = channel_docs(spark, figures(spark, d)).where("channel = 'corp'").select(F.col("scope").cast("long").alias("corp"), "text")
    return claims.document_risks(texts, verdicts, similarity.mean_similarity(texts, own, ["corp"]))


# Answers about customers, each line citing one record, and the records they cite.
ANSWERS_SQL = """
    answers AS (SELECT o_orderkey AS answer_id, '# 보고' || chr(10) || '전력 사용량은 ' || (o_custkey % 7) || ' MWh이다 [C-' || o_custkey || ']' || chr(10) || '인원은 ' || (o_custkey % 40 + o_orderkey % 2) || ' 명이다' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' [C-' || o_custkey || ']' END || chr(10)
                || '비용은 ' || (o_custkey % 7) || ',000 원으로 업계 1위 [C-' || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1000000 ELSE 0 END) || '] 2024' AS text FROM orders),
    chunks AS (SELECT 'C-' || c_custkey AS chunk_id, '전력 ' || (c_custkey % 7) * 1000 || ' kWh, 인원 ' || c_custkey % 40 || '명' || CASE WHEN c_custkey % 4 = 0 THEN ', 업계 1위' ELSE '' END AS text FROM customer)"""


def answers(spark, d):
    o, cited = F.col("o_orderkey"), F.concat(F.lit(" [C-"), "o_custkey", F.lit("]"))
    far = F.concat(F.lit(" [C-"), F.col("o_custkey") + F.when(o % 5 == 0, 1000000).otherwise(0), F.lit("] 2024"))
    text = F.concat(
        F.lit("# 보고\n전력 사용량은 "), F.col("o_custkey") % 7, F.lit(" MWh이다"), cited, F.lit("\n인원은 "), F.col("o_custkey") % 40 + o % 2, F.lit(" 명이다"), F.when(o % 3 == 0, "").otherwise(cited),
        F.lit("\n비용은 "), F.col("o_custkey") % 7, F.lit(",000 원으로 업계 1위"), far,
    )
    c = F.col("c_custkey")
    chunk = F.concat(F.lit("전력 "), c % 7 * 1000, F.lit(" kWh, 인원 "), c % 40, F.lit("명"), F.when(c % 4 == 0, ", 업계 1위").otherwise(""))
    return table(spark, d, "orders").select(o.alias("answer_id"), text.alias("text")), table(spark, d, "customer").select(F.concat(F.lit("C-"), c).alias("chunk_id"), chunk.alias("text"))


UNITS_SQL = ", ".join(f"('{raw}', '{name}', '{UNIT_FAMILIES.get(name, (name, 1))[0]}', {UNIT_FAMILIES.get(name, (name, 1.0))[1]})" for raw, name in UNIT_NAMES.items())
PHRASES_SQL = ", ".join(f"('{p}')" for p in OVERCLAIMS)
PAIRS_SQL = rf"SELECT {{key}}, j, num, replace(num, ',', '')::DOUBLE AS value, u.name AS unit, u.kind, replace(num, ',', '')::DOUBLE * u.factor AS base FROM (SELECT {{key}}, unnest(regexp_extract_all(t, '{NUMBER_UNIT}', 1)) AS num, unnest(regexp_extract_all(t, '{NUMBER_UNIT}', 2)) AS raw, generate_subscripts(regexp_extract_all(t, '{NUMBER_UNIT}', 1), 1) AS j FROM {{rel}}) x JOIN units u ON u.raw = lower(x.raw) WHERE regexp_full_match(num, '\d{{{{1,3}}}}(,\d{{{{3}}}})*(\.\d+)?|\d+(\.\d+)?([eE][+-]?\d+)?')".replace("{{{{", "{{").replace("}}}}", "}}")
SHOWN = "CASE WHEN {v} = floor({v}) THEN CAST({v} AS BIGINT)::VARCHAR ELSE {v}::VARCHAR END"
NEAR_SQL = "abs({a} - {b}) <= 0.01 * greatest(abs({a}), abs({b}))"
GROUNDING_SQL = rf"""{ANSWERS_SQL},
    units(raw, name, kind, factor) AS (VALUES {UNITS_SQL}), phrases(p) AS (VALUES {PHRASES_SQL}),
    l AS (SELECT answer_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM answers),
    c AS (SELECT answer_id, line, trim(regexp_replace(regexp_replace(raw, '\[[0-9A-Za-z가-힣._:-]+\]', '', 'g'), '\s{{2,}}', ' ', 'g')) AS t, regexp_extract_all(raw, '\[([0-9A-Za-z가-힣._:-]+)\]', 1) AS cited FROM l WHERE raw <> '' AND NOT raw LIKE '#%'),
    k AS (SELECT answer_id, line, chunk_id, chunks.text AS t FROM (SELECT DISTINCT answer_id, line, unnest(cited) AS chunk_id FROM c) JOIN chunks USING (chunk_id)),
    sp AS ({PAIRS_SQL.format(key='answer_id, line', rel='c WHERE len(cited) > 0')}),
    cp AS ({PAIRS_SQL.format(key='answer_id, line', rel='k')}),
    how AS (SELECT s.answer_id, s.line, s.j, any_value(s.value) AS value, any_value(s.unit) AS unit, coalesce(bool_or(q.kind = s.kind AND {NEAR_SQL.format(a='q.base', b='s.base')}), false) AS grounded,
            arg_min({SHOWN.format(v='q.value')} || ' ' || q.unit, q.j) FILTER (q.kind <> s.kind AND {NEAR_SQL.format(a='q.value', b='s.value')}) AS other
            FROM sp s LEFT JOIN cp q USING (answer_id, line) GROUP BY s.answer_id, s.line, s.j),
    g4 AS (SELECT answer_id, list(DISTINCT {SHOWN.format(v='value')} || ' ' || unit || ' ↔ ' || other) AS x FROM how WHERE NOT grounded AND other IS NOT NULL GROUP BY 1),
    nums AS (SELECT answer_id, line, replace(unnest(regexp_extract_all(t, '{NUMBER}')), ',', '') AS num FROM c WHERE len(cited) > 0),
    kv AS (SELECT answer_id, line, replace(unnest(regexp_extract_all(t, '{NUMBER}')), ',', '')::DOUBLE AS v FROM k),
    orphan AS (SELECT DISTINCT n.answer_id, n.num FROM nums n WHERE NOT (length(num) = 4 AND num BETWEEN '1900' AND '2100')
        AND NOT EXISTS (SELECT 1 FROM how h WHERE h.answer_id = n.answer_id AND h.line = n.line AND (h.grounded OR h.other IS NOT NULL) AND {SHOWN.format(v='h.value')} = n.num)
        AND NOT EXISTS (SELECT 1 FROM kv WHERE kv.answer_id = n.answer_id AND kv.line = n.line AND {NEAR_SQL.format(a='kv.v', b='n.num::DOUBLE')})),
    g2 AS (SELECT answer_id, list(num ORDER BY num) AS x FROM orphan GROUP BY 1),
    g5 AS (SELECT DISTINCT c.answer_id FROM c, phrases WHERE len(cited) > 0 AND contains(t, p) AND NOT EXISTS (SELECT 1 FROM k WHERE k.answer_id = c.answer_id AND k.line = c.line AND contains(k.t, p))),
    s AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (len(cited) = 0) AS uncited, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE k.answer_id = c.answer_id AND k.line = c.line)) AS supported FROM c WHERE length(t) >= 6 GROUP BY 1)
    SELECT answer_id, CASE WHEN uncited > 0 OR g2.x IS NOT NULL OR g4.x IS NOT NULL THEN 'ESCALATE' ELSE 'ACCEPT' END AS decision, uncited, coalesce(array_to_string(g2.x, ','), '') AS orphan_numbers,
        coalesce(array_to_string(list_sort(g4.x), ','), '') AS unit_mismatches, g5.answer_id IS NOT NULL AS overclaim, round(supported / claims, 4) AS faithfulness
    FROM s LEFT JOIN g2 USING (answer_id) LEFT JOIN g4 USING (answer_id) LEFT JOIN g5 ON g5.answer_id = s.answer_id"""


@query(f"WITH {GROUNDING_SQL}")
def answer_grounding(spark, d):
    """The grounding gate over answers that cite records: missing citations, orphan numbers, units, strong words."""
    g = grounding.grounding(*answers(spark, d))
    return g.select("answer_id", "decision", "uncited", F.array_join(F.array_sort("orphan_numbers"), ",").alias("orphan_numbers"), F.array_join(F.array_sort("unit_mismatches"), ",").alias("unit_mismatches"), (F.size("soft_flags") > 0).alias("overclaim"), "faithfulness")


AREAS = {"E": ["온실가스", "배출", "재생에너지", "폐기물", "용수", "환경", "에너지", "scope", "scope1", "scope2"], "S": ["정규직", "이직률", "여성", "산업재해", "재해율", "정보보호", "안전"]}
ASKED = [(1, "E", "재생에너지 사용량, 폐기물"), (2, "E", "감소 5 톤"), (3, "S", "이직률 현황"), (4, "E", "보고서 2001년, 선도적 친환경"), (5, "E", ""), (6, "E", "E-4-2 재생에너지 수치")]


@query()
def retrieval_cascade(spark, d):
    """Questions over all statements: keywords, then both methods, then variants of the question, until one is accepted.

    No SQL stands beside it; a test holds it against plain Python.
    """
    f = figures(spark, d)
    docs = statements(f).select(F.col("id").alias("doc_id"), "text", F.when(F.col("corp") % 2 == 0, "E-4-2").alias("code"), F.when(F.col("corp") % 3 == 0, "dart_struct").otherwise("snippet").alias("source"), (F.col("id") % 10000).cast("int").alias("report_year"))
    rows = [(i, text, AREAS[area]) for i, area, text in ASKED]
    found = retrieval.cascade(docs, spark.createDataFrame(rows, "query_id long, text string, area_terms array<string>"))
    return found.select("query_id", "tier", "decision", F.array_join("hard_fails", ",").alias("hard_fails"), F.array_join("soft_flags", ",").alias("soft_flags"), F.array_join("ids", ",").alias("ids"))
