"""Blocks inside blocks, by hand from the block rules."""

from __future__ import annotations

import pytest

from docflow.operators.markdown import markdown_normalize

CASES = {
    "- a\n- b\n  - c\n    d\n\n  e\n- f\n\npara\nlazy": "- a\n\n\n- b\n\n- c\nd\n\n\n\ne\n\n\n- f\n\n\n\npara\nlazy",
    "> q1\nq2\n> - x\n>   y\n> - z\n\nafter": "q1\nq2\n\n- x\ny\n\n\n- z\n\n\n\nafter",
    "Title\n=====\ntext\n---\n\n***\n1. a\n2. b\n   ```py\n   code\n     more\n   ```\n3) c":
        "# Title\n\n## text\n\n1. a\n\n\n2. b\n\n```py\ncode\n  more\n```\n\n\n\n3. c",
    "    code\n\n    more\ntext": "```\ncode\n\nmore\n```\n\ntext",
    "~~~\n# no\n~~~\n# yes #\n<div>\nhid\n</div>\n\nend": "```\n# no\n```\n\n# yes\n\nend",
    "-\n- b\n\n  x": "- \n- b\n\nx",
    "-   a\n\n    para in a\n\n        code in a\n- b": "- a\n\npara in a\n\n```\ncode in a\n```\n\n\n- b",
    "[x]: http://a \"t\"\n[y][x] and [z] [X]": "y and [z] X",
    "a \\*b\\* `c  *d*` **e** &lt; ![alt](u \"t\") <http://x.y> <b>f</b>\\\ng": "a *b* `c  *d*` e < alt http://x.y f\ng",
    "text\n2. no\n1. yes": "text\n2. no\n\n1. yes",
    "1. a\n\n   > q\n   > - i\n2. b": "1. a\n\nq\n\n- i\n\n\n\n\n2. b",
    "- - x\n  - y\n- z": "- - x\n\n\n- y\n\n\n\n\n- z",
    "7. seven\n8. eight\n\n---\n\n* star\n+ plus": "7. seven\n\n\n8. eight\n\n\n\n- star\n\n\n\n- plus",
    "```\nopen to the end\n\n  kept": "```\nopen to the end\n\n  kept\n```",
    "> ```\n> in quote\nout": "```\nin quote\n```\n\nout",
    "#nohead\n####### seven\n# \n## b ##  ": "#nohead\n####### seven\n\n# \n\n## b",
    "one\n\n\n\ntwo  \nthree": "one\n\ntwo\nthree",
    "<!-- a\n\nb -->\nx": "x",
    "\tcode by tab\n\n- a\n\n\tpara in item": "```\ncode by tab\n```\n\n- a\n\npara in item",
    "see [a](b) [c]( <d e> 'f' ) [g[h]](i) [j]: k": "see a c g[h] [j]: k",
    "": "", " \n\t\n": "",
}


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_blocks(spark, newline):
    rows = [(i, t.replace("\n", newline)) for i, t in enumerate(CASES)] + [(len(CASES), None)]
    got = {r.doc_id: r.text for r in markdown_normalize(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert got[len(CASES)] is None


def test_deep_nesting(spark):
    """Two hundred quotes and a hundred lists inside each other."""
    deep = "> " * 200 + "x\n\n" + "".join("  " * i + "- l\n" for i in range(100))
    got = markdown_normalize(spark.createDataFrame([(1, deep)], "doc_id int, text string")).first().text
    assert got.startswith("x\n\n- l\n\n- l\n\n") and got.count("- l") == 100
