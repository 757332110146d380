"""Small documents with known results."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import chunking as C
from docflow.operators import segments as S
from docflow.operators.markdown import markdown_normalize

MANUAL = "# Bee Keeping\n\nWhat a hive needs.\n\n## Spring\n\n- clean the floor\n- weigh the combs\n"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def segs(spark, *rows):
    """Rows (type, content, heading_path) as one nested document."""
    data = [(0, [(f"seg-{i}", k, c, p, i, i, None, None, "md") for i, (k, c, p) in enumerate(rows)])]
    return spark.createDataFrame(
        data,
        "doc_id long, segments array<struct<segment_id:string,type:string,content:string,heading_path:string,"
        "start_order:int,end_order:int,heading_level:int,table_markdown:string,doc_type:string>>",
    )


def test_markdown_segments(spark):
    text = markdown_normalize(docs(spark, MANUAL))
    rows = S.segment_text(text).orderBy("segment_no").collect()
    assert [r.type for r in rows] == ["heading", "paragraph", "heading", "list"]
    assert rows[1].heading_path == "Bee Keeping"
    assert rows[3].heading_path == "Bee Keeping > Spring"
    assert rows[3].content == "- clean the floor\n- weigh the combs"


def test_markdown_keeps_headings_and_fences(spark):
    text = "# Kiln Log\n\nFire **slowly** and [vent](http://x).\n\n## Glazes\n\n```toml\ncone = 6\nhold = \"20m\"\n```\n\n3. a\n4. b\n"
    got = markdown_normalize(docs(spark, text)).first().text
    for part in ("# Kiln Log", "Fire slowly and vent.", "## Glazes", "```toml\ncone = 6\nhold = \"20m\"\n```", "3. a", "4. b"):
        assert part in got


def test_html(spark):
    html = """<!doctype html><html><head><title>x</title></head><body><h1>Orchard</h1><p>Apples &amp; more &#233; &lt;b&gt;</p>
    <ul><li>one</li><li>two<ul><li>in</li></ul></li></ul><ol><li>a<li>b</ol><pre>x  y
 z</pre><table><tr><th>Tree</th><th>Row</th></tr><tr><td>Pear|x</td><td>Third</td></tr><tr><td>only</td></tr></table>
    <div>a<div>b</div>c</div><p>first<p>second<script>var a = "<p>no</p>";</script></body></html>"""
    got = S.html_to_markdown(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text
    assert got == (
        "# Orchard\n\nApples & more é <b>\n\n- one\n- two in\n\n1. a\n2. b\n\n```\nx  y\n z\n```\n\n"
        "| Tree | Row |\n| --- | --- |\n| Pear\\|x | Third |\n| only |  |\n\na b c\n\nfirst\n\nsecond"
    )


def test_character_references(spark):
    rows = {
        "&amp;lt; &eacute;&#233;&#xE9; &copyx": "&lt; ééé ©x", "a&nbsp;b &bogus; R&D &": "a b &bogus; R&D &",
        "&#x110000;&#0;&#128512;": "\ufffd\ufffd\U0001f600", "&hellip;&Ouml;&frac12;&notin;": "…Ö½∉", "plain": "plain",
    }
    df = spark.createDataFrame(list(rows.items()), "a string, b string").select("b", S.decode_entities(F.col("a")).alias("got"))
    assert [r.got for r in df.collect()] == [r.b for r in df.collect()]


def test_marks_without_emphasis_stay(spark):
    text = "one*** two*** three ** four\n\n**bold *and* more** ***both*** a*b*c snake_case_name _it_ 2 * 3 * 4"
    got = markdown_normalize(docs(spark, text)).first().text
    assert got == "one*** two*** three ** four\n\nbold and more both abc snake_case_name it 2 * 3 * 4"


def test_paragraph_chunks_carry_headings(spark):
    text = (
        "# River Ferry\n\nThe ferry crosses every half hour while there is light, and the bell on the far bank calls "
        "it at other times of day.\n\n## Fares\n\nWalkers pay one coin, riders two, and a cart with its driver "
        "pays four on market days.\n"
    )
    rows = C.chunk_paragraph(docs(spark, text), 80, 1, 40).orderBy("chunk_index").collect()
    assert [r.heading_path for r in rows] == ["# River Ferry", "## Fares"]
    assert [r.heading_level for r in rows] == [1, 2]
    assert rows[0].segment_type == "paragraph"


def test_traits_of_code_and_table(spark):
    code = "# Greeting\n\n```python\nprint(\"good day\")\n```\n"
    table = "# Harvest\n\n| Fruit | Baskets |\n| --- | --- |\n| Plum | 20 |\n"
    a, b = C.chunk_paragraph(docs(spark, code, table), 200).orderBy("doc_id").collect()
    assert (a.segment_type, a.has_code_block) == ("code", True)
    assert (b.segment_type, b.has_table) == ("table", True)


def test_segments_are_boundaries(spark):
    table = "| Tide | Hour |\n| --- | --- |\n| High | Noon |"
    d = segs(spark, ("heading", "# Harbour", "Harbour"), ("paragraph", "Boats wait here for the water.", "Harbour"),
             ("heading", "## Tides", "Harbour > Tides"), ("table", table, "Harbour > Tides"))
    rows = C.chunk_segments(d, "paragraph", 120, 1, 20).orderBy("chunk_index").collect()
    assert [r.heading_path for r in rows] == ["Harbour", "Harbour > Tides"]
    assert rows[1].segment_type == "table"


def test_manual_sections_stay_apart(spark):
    d = segs(spark, ("heading", "# Oven", "Oven"), ("paragraph", "Stack dry wood at the back.", "Oven > Lighting"),
             ("paragraph", "Bake the small loaves first.", "Oven > Baking"))
    rows = C.chunk_segments(d, "manual", 200, 1, 10).orderBy("chunk_index").collect()
    assert [(r.heading_path, r.chunk_strategy) for r in rows] == [("Oven > Lighting", "manual"), ("Oven > Baking", "manual")]


def test_tables_are_isolated(spark):
    d = segs(spark, ("paragraph", "Rain of the last year.", "Weather"), ("table", "| Month | Days |", "Weather"),
             ("caption", "Table 1: Days with rain", "Weather"))
    rows = C.chunk_segments(d, "table", 200, 1, 10).orderBy("chunk_index").collect()
    assert [r.segment_type for r in rows] == ["paragraph", "table", "caption"]
    assert rows[1].chunk_strategy == "table"


def test_headings_only(spark):
    long = "# " + "x" * 100
    d = segs(spark, ("heading", "# A", "A"), ("heading", "## B", "A > B"))
    assert [r.content for r in C.chunk_segments(d).collect()] == ["# A\n\n## B"]
    d = segs(spark, ("heading", "# A", "A"), ("heading", long, "x"))
    assert [(r.content, r.heading_path) for r in C.chunk_segments(d).collect()] == [(long, "# A")]


def test_skipped_heading_levels(spark):
    blocks = spark.createDataFrame(
        [(1, i, lv, t) for i, (lv, t) in enumerate([(3, "a"), (1, "b"), (4, "c"), (2, "d"), (0, ""), (6, "e"), (2, "f")])],
        "doc_id long, block_no int, level int, title string",
    )
    got = [r.heading_path for r in S.heading_paths(blocks).orderBy("block_no").collect()]
    assert got == ["a", "b", "b > c", "b > d", "b > d", "b > d > e", "b > f"]


def test_blank_and_null_texts_have_no_chunks(spark):
    d = spark.createDataFrame([(1, "  \n "), (2, None), (3, "x")], "doc_id long, text string")
    for f in (C.chunk_fixed, C.chunk_paragraph, C.chunk_recursive, C.chunk_parent_child, C.chunk_pack):
        assert {r.doc_id for r in f(d).collect()} <= {3}
    assert C.chunk_fixed(d).where(F.col("doc_id") == 3).count() == 1
