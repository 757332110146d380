"""Page box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.catalog import base as B
from docflow.catalog.text import ws
from docflow.functions import structure as X
from docflow.operators import layout as L
from docflow.operators.ordered import groups_fit

col = F.col

BASE_SQL = f"""b AS ({B.BOXES_SQL}), fs AS (SELECT doc_id, font_size, row_number() OVER (PARTITION BY doc_id ORDER BY font_size) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE font_size > 0),
ba AS (SELECT doc_id, max(font_size) AS baseline FROM fs WHERE rn = n // 2 + 1 GROUP BY doc_id)"""

STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"
TYPE_SQL = f"""CASE WHEN length(t) = 0 THEN 'Text' WHEN regexp_matches(t, '{X.CAPTION_BOX}') THEN 'Caption' WHEN regexp_matches(t, '{X.TABLE_BOX}') THEN 'Table'
 WHEN regexp_matches(t, '{X.LIST_BOX}') THEN 'List' WHEN font_size / baseline >= 1.25 OR (bold AND font_size / baseline >= 1.1) THEN 'Title' ELSE 'Text' END"""


def marked_boxes(s, d):
    """Boxes with some captions, tables and list items among them."""
    b = B.boxes(s, d)
    text = (
        F.when(col("box_no") % 13 == 5, F.concat(F.lit("Table 1: "), col("text")))
        .when(col("box_no") % 13 == 6, F.concat(F.lit("a | b | "), col("text")))
        .when(col("box_no") % 13 == 9, F.concat(F.lit("- "), col("text")))
        .otherwise(col("text"))
    )
    return b.withColumn("text", text)


MARKED_SQL = f"""m AS (SELECT b.* EXCLUDE (text), CASE b.box_no % 13 WHEN 5 THEN concat('Table 1: ', text) WHEN 6 THEN concat('a | b | ', text) WHEN 9 THEN concat('- ', text) ELSE text END AS text FROM b),
ty AS (SELECT doc_id, page_num, box_no, x1, y1, x2, y2, font_size, bold, baseline, t, {TYPE_SQL} AS type FROM (SELECT m.*, baseline, {ws('m.text')} AS t FROM m JOIN ba ON ba.doc_id = m.doc_id))"""


def fits(s, d):
    """Boxes are lines of documents; no later group is larger than a document."""
    return groups_fit(B.boxes(s, d), ["doc_id"])


def page_table(s, d):
    return B.boxes(s, d).select("doc_id", "page_num").distinct().withColumn("page_width", F.lit(600.0))


def typed(s, d):
    return L.classify_boxes(marked_boxes(s, d)).select("doc_id", "box_no", "type", "baseline", "text")


def columned(s, d):
    return L.assign_columns(L.classify_boxes(marked_boxes(s, d)), page_table(s, d))


def columns(s, d):
    """Pages of one to four columns by turns; every ninth box is wider than its column."""
    count = F.pmod(col("doc_id") + col("page_num"), F.lit(4)) + 1
    center, half = 80 + 145 * (col("box_no") % count).cast("double"), F.when(col("box_no") % 9 == 4, 150.0).otherwise(60.0)
    b = L.classify_boxes(marked_boxes(s, d)).withColumn("x1", center - half).withColumn("x2", center + half)
    return L.assign_columns(b, page_table(s, d)).select("doc_id", "page_num", "box_no", "column_index", "span_columns")


COLUMNS_SQL = f"""WITH b AS ({B.BOXES_SQL}), c AS (SELECT doc_id, page_num, box_no, box_no % ((doc_id + page_num) % 4 + 1) AS place, box_no % 9 = 4 AS wide FROM b),
p AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_num ORDER BY place) - 1 AS r FROM c)
SELECT doc_id, page_num, box_no, CAST(r AS INTEGER) AS column_index, wide AND max(r) OVER (PARTITION BY doc_id, page_num) > 0 AS span_columns FROM p"""


def captions(s, d):
    """Captions in plain page order: one column, so the order is that of the lines."""
    one = L.classify_boxes(marked_boxes(s, d)).withColumn("column_index", F.lit(0))
    return L.attach_captions(one, fits(s, d)).select("doc_id", "box_no", "table_caption")


CAPTION_SQL = f"""WITH {BASE_SQL}, {MARKED_SQL}, c AS (SELECT *, CASE WHEN type = 'Caption' AND regexp_matches(lower(t), '^(table|表)') THEN t END AS cap FROM ty)
SELECT doc_id, box_no, CASE WHEN type = 'Table' THEN coalesce(lag(cap) OVER w, lead(cap) OVER w) END AS table_caption FROM c WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY y1, x1, box_no)"""


def shifted(s, d):
    """Second box set: every box, moved and stretched."""
    return B.boxes(s, d).select(
        "doc_id", "page_num", col("box_no").alias("region_no"), (col("x1") - 20).alias("x1"), (col("y1") + col("box_no") % 9).alias("y1"),
        (col("x2") + 300).alias("x2"), (col("y2") + col("box_no") % 9).alias("y2"),
        F.element_at(F.array(*[F.lit(x) for x in ("Title", "figure", "List", "equation")]), (col("box_no") % 4 + 1).cast("int")).alias("region_type"),
    )


PAIRS_SQL = f"""WITH b AS ({B.BOXES_SQL}), r AS (SELECT doc_id, page_num, box_no AS region_no, x1 - 20 AS x1, y1 + box_no % 9 AS y1, x2 + 300 AS x2, y2 + box_no % 9 AS y2,
 CASE box_no % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'figure' WHEN 2 THEN 'text' ELSE 'formula' END AS kind FROM b),
o AS (SELECT b.doc_id, b.page_num, b.box_no, r.region_no, r.kind, least(b.x2, r.x2) - greatest(b.x1, r.x1) AS w, least(b.y2, r.y2) - greatest(b.y1, r.y1) AS h,
 least((b.x2 - b.x1) * (b.y2 - b.y1), (r.x2 - r.x1) * (r.y2 - r.y1)) AS a FROM b JOIN r ON b.doc_id = r.doc_id AND b.page_num = r.page_num),
hit AS (SELECT * FROM o WHERE w > 0 AND h > 0 AND w * h / a > 0.5)
"""


def merged(s, d):
    """Left and right boxes of one line share their top edge here, so they join."""
    b = L.classify_boxes(marked_boxes(s, d))
    y = F.floor(col("box_no") / 2) * 14.0
    wide = b.withColumn("y1", y).withColumn("y2", y + 12.0).withColumn("x2", F.when(col("box_no") % 2 == 0, 305.0 + col("box_no") % 30).otherwise(col("x2")))
    return L.merge_horizontal(wide, fits(s, d)).select("doc_id", "page_num", "box_no", *L.BBOX, "font_size", "type", "text", "merged_boxes")


def vertical(s, d):
    return L.merge_vertical(columned(s, d).withColumn("merged_boxes", F.lit(1)), fits(s, d))


def vertical_shown(s, d):
    return vertical(s, d).select("doc_id", "page_num", "column_index", "box_no", *L.BBOX, "type", "text", "merged_boxes")


def downward(s, d):
    return L.concat_downward(vertical(s, d).withColumn("type", F.when(col("type") == "Title", "Text").otherwise(col("type"))), fits(s, d)).select(
        "doc_id", "page_num", "column_index", "box_no", *L.BBOX, "type", "merged_boxes", "y_gap", "x_delta", "font_delta", "same_column", "continuation",
    )


def _fold_sql(src: str, name: str, part: str, joins: str, x2: str, font: str) -> str:
    """Chains of the rows of ``src``, one step of the recursion per row of a page; state (x1, y1, x2 or y2, font) of the chain."""
    on = " AND ".join(f"q.{k} = f.{k}" for k in part.split(", "))
    return f"""{name}_q AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY y1, x1, box_no) AS n FROM {src}),
{name}_f AS (SELECT {part}, n, 1 AS chain, type, x1 AS cx, y1 AS cy, {x2} AS ce, font_size AS cf FROM {name}_q WHERE n = 1
  UNION ALL SELECT {", ".join("f." + k for k in part.split(", "))}, q.n, CASE WHEN j THEN chain ELSE chain + 1 END, q.type, CASE WHEN j THEN least(cx, x1) ELSE x1 END, CASE WHEN j THEN least(cy, y1) ELSE y1 END,
    CASE WHEN j THEN greatest(ce, {x2}) ELSE {x2} END, CASE WHEN j THEN {font} ELSE font_size END
  FROM {name}_f f JOIN {name}_q q ON {on} AND q.n = f.n + 1, LATERAL (SELECT q.type = f.type AND {joins} AS j) z),
{name} AS (SELECT {", ".join("q." + k for k in part.split(", "))}, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(box_no, q.n) AS box_no, any_value(q.type) AS type,
  {ws("string_agg(t, ' ' ORDER BY q.n)")} AS t, arg_min(font_size, q.n) AS font_size, max(font_size) AS largest, sum(merged)::INTEGER AS merged,
  arg_min(baseline, q.n) AS baseline FROM {name}_f f JOIN {name}_q q ON {on} AND q.n = f.n GROUP BY {", ".join("q." + k for k in part.split(", "))}, chain)"""


_LINE_JOIN = "abs(y1 - cy) <= greatest(cf, font_size) * 0.7::DOUBLE AND x1 - ce BETWEEN 0 AND greatest(18.0::DOUBLE, cf * 1.5::DOUBLE)"
_COLUMN_JOIN = "q.type IN ('Text', 'List') AND y1 - ce <= greatest(cf, font_size) * 1.6::DOUBLE"
_DOWN_JOIN = "q.type = 'Text' AND y1 - ce <= greatest(cf, font_size) * 1.8::DOUBLE AND abs(x1 - cx) <= greatest(24.0::DOUBLE, cf * 2.0::DOUBLE) AND abs(cf - font_size) <= 1.5::DOUBLE"
_IN_COLUMN = "doc_id, page_num, column_index"
# The boxes of a page lie in two columns by turns.
_TWO_COLUMNS = "ic AS (SELECT *, 1 AS merged, CAST(box_no % 2 AS INTEGER) AS column_index FROM ty)"
HORIZONTAL_SQL = f"""WITH RECURSIVE {BASE_SQL}, {MARKED_SQL}, hw AS (SELECT doc_id, page_num, box_no, x1, floor(box_no / 2) * 14.0::DOUBLE AS y1, CASE WHEN box_no % 2 = 0 THEN 305.0::DOUBLE + box_no % 30 ELSE x2 END AS x2,
  floor(box_no / 2) * 14.0::DOUBLE + 12 AS y2, font_size, baseline, type, t, 1 AS merged FROM ty),
{_fold_sql("hw", "ho", "doc_id, page_num", _LINE_JOIN, "x2", "greatest(cf, font_size)")}
SELECT doc_id, page_num, box_no, x1, y1, x2, y2, largest AS font_size, type, t AS text, merged AS merged_boxes FROM ho"""
VERTICAL_CTE = f"WITH RECURSIVE {BASE_SQL}, {MARKED_SQL}, {_TWO_COLUMNS}, {_fold_sql('ic', 've', _IN_COLUMN, _COLUMN_JOIN, 'y2', 'cf')}"
VERTICAL_SQL = VERTICAL_CTE + " SELECT doc_id, page_num, column_index, box_no, x1, y1, x2, y2, type, t AS text, merged AS merged_boxes FROM ve"
DOWNWARD_SQL = f"""{VERTICAL_CTE}, vt AS (SELECT * EXCLUDE (type), CASE WHEN type = 'Title' THEN 'Text' ELSE type END AS type FROM ve),
{_fold_sql("vt", "dn", _IN_COLUMN, _DOWN_JOIN, "y2", "cf")},
ab AS (SELECT *, lag(y2) OVER w AS ly, lag(x1) OVER w AS lx, lag(font_size) OVER w AS lf, lag(column_index) OVER w AS lc, lag(t) OVER w AS lt FROM dn
  WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY column_index, y1, x1, box_no))
SELECT doc_id, page_num, column_index, box_no, x1, y1, x2, y2, type, merged AS merged_boxes, y1 - ly AS y_gap, abs(x1 - lx) AS x_delta, abs(font_size - lf) AS font_delta,
  column_index = lc AS same_column, NOT regexp_matches(lt, '[。！？.!?;；:：]$') AND length(lt) > 0 AS continuation FROM ab"""


def half_columns(s, d):
    """Column index known by construction: odd boxes sit in the second column."""
    return marked_boxes(s, d).withColumn("column_index", (col("box_no") % 2).cast("int"))


def roles(s, d):
    text = (
        F.when(col("line_no") % 17 == 0, "Abstract").when(col("line_no") % 17 == 6, "References").when(col("line_no") % 17 == 12, col("line"))
        .when(col("line_no") % 5 == 1, F.concat(F.lit("[3] "), col("line"))).when(col("line_no") % 5 == 2, F.concat(F.lit("Figure 2 "), col("line"))).otherwise(col("line"))
    )
    kind = F.when((col("line_no") % 17).isin(0, 6, 12), "heading").when(col("line_no") % 5 == 2, "caption").otherwise("paragraph")
    return L.section_roles(B.lines(s, d).select("doc_id", col("line_no").alias("reading_order"), kind.alias("type"), text.alias("text"))).select(
        "doc_id", "reading_order", "section_role",
    )


ROLES_SQL = f"""WITH l AS ({B.LINES_SQL}), x AS (SELECT doc_id, line_no, CASE WHEN line_no % 17 IN (0, 6, 12) THEN 'heading' WHEN line_no % 5 = 2 THEN 'caption' ELSE 'paragraph' END AS type,
 CASE WHEN line_no % 17 = 0 THEN 'Abstract' WHEN line_no % 17 = 6 THEN 'References' WHEN line_no % 17 = 12 THEN line WHEN line_no % 5 = 1 THEN concat('[3] ', line) WHEN line_no % 5 = 2 THEN concat('Figure 2 ', line) ELSE line END AS text FROM l),
y AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN CASE WHEN regexp_matches(text, '{X.ABSTRACT_TITLE}') THEN 'abstract' WHEN regexp_matches(text, '{X.REFERENCES_TITLE}') THEN 'references' ELSE 'none' END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS role FROM x)
SELECT doc_id, line_no AS reading_order, CASE WHEN type = 'heading' THEN CASE WHEN role <> 'none' THEN concat(role, '_heading') END WHEN role = 'abstract' AND type = 'paragraph' THEN 'abstract'
 WHEN role = 'references' AND regexp_matches(text, '{X.REFERENCE_ENTRY.replace("'", "''")}') THEN 'reference_entry' WHEN type = 'caption' THEN 'figure_caption' END AS section_role FROM y"""


def levels(s, d):
    b = L.classify_boxes(marked_boxes(s, d))
    t = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("", "第3章 ", "1.2.3 ", "4、")]), (col("box_no") % 4 + 1).cast("int")), col("text"))
    return b.select(
        "doc_id", "box_no", X.title_level(t, col("font_size") + col("box_no") % 8, col("baseline"), "manual").cast("bigint").alias("manual"),
        X.title_level(t, col("font_size") + col("box_no") % 8, col("baseline"), "paper").cast("bigint").alias("paper"),
    )


LEVELS_SQL = f"""WITH {BASE_SQL}, {MARKED_SQL}, z AS (SELECT doc_id, box_no, (font_size + box_no % 8) / baseline AS r, trim(concat(CASE box_no % 4 WHEN 0 THEN '' WHEN 1 THEN '第3章 ' WHEN 2 THEN '1.2.3 ' ELSE '4、' END, t)) AS t FROM ty),
p AS (SELECT *, CAST(CASE WHEN r >= 1.6 THEN 1 WHEN r >= 1.4 THEN 2 ELSE 3 END AS BIGINT) AS paper FROM z)
SELECT doc_id, box_no, CASE WHEN regexp_matches(t, '{X.MANUAL_HEADING}') THEN CASE WHEN starts_with(t, '第') THEN 1 ELSE least(4, length(t) - length(replace(t, '.', '')) + 1) END ELSE paper END AS manual, paper FROM p"""


def segments(s, d):
    return L.layout_segments(marked_boxes(s, d), page_table(s, d), "paper").segments.select(
        "doc_id", "segment_id", "type", "content", "heading_path", "page_num", "column_index", "heading_level", "section_depth", "merged_boxes",
    )


def layout_pages(s, d):
    return L.layout_segments(marked_boxes(s, d), page_table(s, d), "manual").pages.select("doc_id", "page_num", "column_count", "blocks")


def figures(s, d):
    """A wide figure below line 20 of every page that has one."""
    b = B.boxes(s, d).where("box_no % 40 = 20")
    place = {"x1": 50.0, "y1": 600.0, "x2": 550.0, "y2": 700.0}
    return b.select("doc_id", "page_num", (col("box_no") + 1_000_000).alias("box_no"), *(F.lit(v).alias(k) for k, v in place.items()))


def figure_segments(s, d):
    return L.layout_segments(marked_boxes(s, d), page_table(s, d), "table", figures(s, d)).segments.select(
        "doc_id", "segment_id", "type", "content", "heading_path", "page_num", "column_index", "heading_level", "section_depth", "merged_boxes",
    )


def document_summary(s, d):
    return L.layout_segments(marked_boxes(s, d), page_table(s, d), "paper", figures(s, d)).documents


# From merged boxes to segments: reading order, levels, the heading stack.
_NO_FIGURES = _TWO_COLUMNS.replace("ic AS", "ib AS") + ", ic AS (SELECT * FROM ib)"
_FIGURES = _TWO_COLUMNS.replace("ic AS", "ib AS") + """, ic AS (SELECT doc_id, page_num, box_no, x1, y1, x2, y2, font_size, bold, baseline, t, type, merged, column_index FROM ib
  UNION ALL SELECT doc_id, page_num, box_no + 1000000, 50, 600, 550, 700, 0, false, NULL, '[Figure]', 'Figure', 1, 0 FROM b WHERE box_no % 40 = 20)"""


def _cands(source: str) -> str:
    return f"WITH RECURSIVE {BASE_SQL}, {MARKED_SQL}, {source}, {_fold_sql('ic', 've', _IN_COLUMN, _COLUMN_JOIN, 'y2', 'cf')}, {_fold_sql('ve', 'ca', _IN_COLUMN, _DOWN_JOIN, 'y2', 'cf')}"


def _segments_sql(source: str, kept: str = "true") -> str:
    return f"""{_cands(source)},
od AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, column_index, y1, x1, box_no) - 1 AS ro, CASE type WHEN 'Title' THEN 'heading' WHEN 'List' THEN 'list' WHEN 'Table' THEN 'table' WHEN 'Caption' THEN 'caption'
  WHEN 'Figure' THEN 'figure' ELSE 'paragraph' END AS kind FROM ca WHERE length(t) > 0),
lv AS (SELECT *, CASE WHEN kind <> 'heading' THEN 0 WHEN font_size / baseline >= 1.6::DOUBLE THEN 1 WHEN font_size / baseline >= 1.4::DOUBLE THEN 2 ELSE 3 END AS level FROM od),
st AS (SELECT doc_id, -1::BIGINT AS ro, CAST([] AS VARCHAR[]) AS stack FROM (SELECT DISTINCT doc_id FROM lv)
  UNION ALL SELECT st.doc_id, lv.ro, CASE WHEN level > 0 THEN list_append(stack[1:level - 1], t) ELSE stack END FROM st JOIN lv ON lv.doc_id = st.doc_id AND lv.ro = st.ro + 1),
sg AS (SELECT lv.*, stack FROM lv JOIN st ON st.doc_id = lv.doc_id AND st.ro = lv.ro WHERE {kept})"""


def _segment_rows(source: str, kept: str = "true") -> str:
    return _segments_sql(source, kept) + """ SELECT doc_id, concat('pdf-seg-', ro) AS segment_id, kind AS type, CASE WHEN level > 0 THEN concat(repeat('#', level), ' ', t) ELSE t END AS content,
  CASE WHEN len(stack) > 0 THEN array_to_string(stack, ' > ') END AS heading_path, page_num, column_index, CASE WHEN level > 0 THEN level END AS heading_level,
  CAST(CASE WHEN level > 0 THEN level WHEN len(stack) > 0 THEN len(stack) + 1 END AS INTEGER) AS section_depth, merged AS merged_boxes FROM sg"""


LAYOUT_PAGES_SQL = _cands(_NO_FIGURES) + """ SELECT p.doc_id, p.page_num, coalesce(CAST(max(column_index) + 1 AS INTEGER), 1) AS column_count, count(ca.doc_id) AS blocks
  FROM (SELECT DISTINCT doc_id, page_num FROM b) p LEFT JOIN ca ON ca.doc_id = p.doc_id AND ca.page_num = p.page_num GROUP BY ALL"""
LAYOUT_DOCUMENTS_SQL = _segments_sql(_FIGURES) + """ SELECT p.doc_id, p.page_count, p.detected_columns, s.n AS segment_count, 'paper' AS parse_strategy FROM
  (SELECT doc_id, count(*) AS page_count, max(c) AS detected_columns FROM (SELECT doc_id, page_num, CAST(max(column_index) + 1 AS INTEGER) AS c FROM ca GROUP BY ALL) GROUP BY doc_id) p
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM sg GROUP BY doc_id) s ON s.doc_id = p.doc_id"""


def sheets(s, d):
    """Cells of the lines as sheet rows."""
    return L.rows_to_html(B.lines(s, d).select(col("doc_id").alias("sheet"), col("line_no").alias("row_no"), F.split("line", " ").alias("cells")), 25)


ENTRIES: dict[str, B.Entry] = {
    "top_keywords": (
        lambda s, d: L.top_keywords(B.load(s, d, "documents")).select("doc_id", F.array_join("keywords", ",").alias("keywords")),
        rf"""WITH t AS (SELECT doc_id, lower(unnest(list_concat(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\-]{{2,}}'), regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,}}')))) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE NOT list_contains({STOPS_SQL}, w) GROUP BY ALL),
k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c QUALIFY r <= 6)
SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY r), '') AS keywords FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    ),
    "baseline_font_size": (
        lambda s, d: L.baseline_size(B.boxes(s, d)),
        f"WITH {BASE_SQL} SELECT doc_id, baseline FROM ba",
    ),
    "box_types": (typed, f"WITH {BASE_SQL}, {MARKED_SQL} SELECT doc_id, box_no, type, baseline, t AS text FROM ty"),
    "columns_by_gap": (
        lambda s, d: L.column_count_by_gap(B.boxes(s, d)),
        f"""WITH b AS ({B.BOXES_SQL}), e AS (SELECT DISTINCT doc_id, page_num, x1 FROM b), g AS (SELECT *, x1 - lag(x1) OVER (PARTITION BY doc_id, page_num ORDER BY x1) AS gap FROM e)
SELECT doc_id, page_num, CAST(least(3, 1 + sum(CASE WHEN gap > 50 THEN 1 ELSE 0 END)) AS INTEGER) AS column_count FROM g GROUP BY doc_id, page_num""",
    ),
    "page_columns": (columns, COLUMNS_SQL),
    "horizontal_merge": (merged, HORIZONTAL_SQL),
    "vertical_merge": (vertical_shown, VERTICAL_SQL),
    "downward_merge": (downward, DOWNWARD_SQL),
    "table_captions": (captions, CAPTION_SQL),
    "uncovered_boxes": (
        lambda s, d: L.uncovered_boxes(B.boxes(s, d), shifted(s, d)).select("doc_id", "page_num", "box_no"),
        PAIRS_SQL + "SELECT doc_id, page_num, box_no FROM b WHERE (doc_id, page_num, box_no) NOT IN (SELECT doc_id, page_num, box_no FROM hit)",
    ),
    "region_types": (
        lambda s, d: L.type_from_regions(B.boxes(s, d), shifted(s, d)).select("doc_id", "page_num", "box_no", "type"),
        PAIRS_SQL + """, f AS (SELECT doc_id, page_num, box_no, arg_min(kind, region_no) AS kind FROM hit GROUP BY ALL)
SELECT b.doc_id, b.page_num, b.box_no, coalesce(kind, 'text') AS type FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.page_num = b.page_num AND f.box_no = b.box_no""",
    ),
    "reading_order": (
        lambda s, d: L.reading_order(half_columns(s, d)).select("doc_id", "box_no", "reading_order"),
        rf"""WITH b AS ({B.BOXES_SQL}), m AS (SELECT *, CASE box_no % 13 WHEN 5 THEN concat('Table 1: ', text) WHEN 6 THEN concat('a | b | ', text) WHEN 9 THEN concat('- ', text) ELSE text END AS t FROM b)
SELECT doc_id, box_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, box_no % 2, y1, x1, box_no) - 1 AS reading_order FROM m WHERE regexp_matches(t, '[^\s\p{{Z}}]')""",
    ),
    "section_roles": (roles, ROLES_SQL),
    "title_levels": (levels, LEVELS_SQL),
    "layout_segments": (segments, _segment_rows(_NO_FIGURES)),
    "layout_figures": (figure_segments, _segment_rows(_FIGURES, "kind <> 'caption'")),
    "layout_documents": (document_summary, LAYOUT_DOCUMENTS_SQL),
    "layout_pages": (layout_pages, LAYOUT_PAGES_SQL),
    "plain_block_segments": (
        lambda s, d: L.blocks_to_segments(B.boxes(s, d)),
        f"""WITH b AS ({B.BOXES_SQL}), k AS (SELECT * FROM b WHERE length(trim(text)) > 0), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY box_no) AS st FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, st) - 1 AS start_order, CASE WHEN font_size >= 16 THEN 'heading' ELSE 'paragraph' END AS type, text AS content FROM p""",
    ),
    "sheet_html": (
        sheets,
        f"""WITH l AS ({B.LINES_SQL}), h AS (SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN 'th' ELSE 'td' END AS g, string_split(line, ' ') AS c FROM l),
r AS (SELECT doc_id, line_no, concat('<tr>', array_to_string(list_transform(c, lambda x: concat('<', g, '>', x, '</', g, '>')), ''), '</tr>') AS t FROM h),
p AS (SELECT doc_id, line_no // 25 AS part_no, string_agg(t, '' ORDER BY line_no) AS t FROM r GROUP BY ALL)
SELECT doc_id AS sheet, part_no, concat(CASE WHEN part_no = 0 THEN concat('<table data-sheet="', doc_id, '">') ELSE '' END, t, CASE WHEN part_no = max(part_no) OVER (PARTITION BY doc_id) THEN '</table>' ELSE '' END) AS html FROM p""",
    ),
}
