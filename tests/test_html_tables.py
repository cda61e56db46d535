"""Tables in HTML: spans, entities, markup that doesn't end, odd spans, empty pages, and the gate on what is read."""

from pyspark.sql import functions as F

from verdigris.operators import tables
from verdigris.operators.layout import number_tokens
from verdigris.sources.htmltables import LISTS, html_tables

PAGES = [
    (1, '<TABLE><tr><th rowspan=2>a<i>b</i></th><th colspan="2">b &amp; c</th></tr><tr><td>1</td><td> 2 </td></tr><tr></tr><tr><td colspan=x>x</td></tr></TABLE><p><table><tr></tr></table><table></table><table><tr><td>q</td></tr></table>'),
    (2, None), (3, ""), (4, "no markup > at < all"), (5, "<table><tr><td>lost<td>kept</td></tr><tr><td>never closed"),
    (6, '<tr><th rowspan=3>a</th><td rowspan="-2">b</td></tr><tr><td colspan=2>c</td><td>d</td></tr><tr><td>e</td></tr>'),
    (7, "<script>'<table><tr><td>x</td></tr></table>'</script><!-- <td>y</td> --><table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table>"),
    (8, f'<table><tr><td rowspan="{10**12}" colspan="{10**12}">wide</td></tr></table>'),
]
WANT = {
    (1, 0, 0, 0, "ab", 2, 1, True), (1, 0, 0, 1, "b & c", 1, 2, True), (1, 0, 1, 1, "1", 1, 1, False), (1, 0, 1, 2, "2", 1, 1, False), (1, 0, 3, 0, "x", 1, 1, False), (1, 1, None, None, None, None, None, None), (1, 3, 0, 0, "q", 1, 1, False),
    (5, 0, 0, 0, "kept", 1, 1, False), (6, 0, 0, 0, "a", 3, 1, True), (6, 0, 0, 1, "b", 1, 1, False), (6, 0, 1, 1, "c", 1, 2, False), (6, 0, 1, 3, "d", 1, 1, False), (6, 0, 2, 1, "e", 1, 1, False),
    (7, 0, 0, 0, "inner", 1, 1, False), (8, 0, 0, 0, "wide", 65_534, 1_000, False),
}


def test_cells(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, html string, r string")
    got = html_tables(pages, "page_id").drop("confidence", "ord").collect()
    assert {tuple(r) for r in got} == WANT and len(got) == len(WANT)
    assert html_tables(pages.where("false"), "page_id").collect() == []


def test_lists(spark):
    pages = spark.createDataFrame([("a", "<ul><li>1</li><li><a href='x'>2</a></li></ul><ol><li>no</li></ol>")], "id string, body string")
    assert [(r.id, r.table, r.c, r.content) for r in html_tables(pages, "id", "body", LISTS).collect()] == [("a", 0, 0, "1"), ("a", 0, 1, "2")]


def test_gate(spark):
    """Years that go back, a total that is off, a short row, a table without cells, and one left empty once restored."""
    row = lambda *x: "<tr>" + "".join(f"<td>{v}</td>" for v in x) + "</tr>"
    good = row("구분 (kg)", 2021, 2022, 2023) + row("a", 1, 2, 3) + row("b", 4, 5, 6)
    pages = [(1, good + row("합계", 5, 7, 9)), (2, good.replace("2023", "2020") + row("합계", 5, 7, 9)), (3, good + row("합계", 5, 70, 9)), (4, good + row("c", 1, 2)), (5, row()), (6, row("", "", ""))]
    cells = html_tables(spark.createDataFrame([(i, f"<table>{t}</table>") for i, t in pages], "table_id long, html string"), "table_id")
    got = {r.table_id: (r.decision, r.hard, r.failed) for r in tables.table_gate(cells).collect()}
    assert got[1] == ("ACCEPT", 0, ["A3_header_presence"]) and got[5] == ("HUMAN", 1, ["TABLE_EMPTY"])
    assert "B4_year_order" in got[2][2] and "B1_total_consistency" in got[3][2] and got[4][:2] == ("ESCALATE", 1) and "A1_rectangularity" in got[4][2]
    tiers = {r.table_id: (r.tier0, r.tier1, r.resolved_tier) for r in tables.table_cascade(cells).collect()}
    assert tiers[1] == ("ACCEPT", "ACCEPT", 0) and tiers[5] == ("HUMAN", "HUMAN", None) and tiers[6][1:] == ("HUMAN", None)
    assert tables.table_gate(cells.where("false")).collect() == []


def test_long_number_token(spark):
    long = "1" + ",234" * 30_000
    assert [r[0] for r in spark.createDataFrame([(long,), ("128, 400 kg 7",)], "t string").select(number_tokens(F.col("t"))).collect()] == [[long.replace(",", "")], ["128400", "7"]]
