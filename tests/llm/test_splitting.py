import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm.splitting import STOPS, WS, split, split_texts, structure

SPACE = re.compile(f"[{WS}]")


def natural(text, at):
    return bool(SPACE.match(text[at]) or SPACE.match(text[at - 1])) or text[at - 1] in STOPS


def longest_stretch(text):
    return max((m.end() - m.start() for m in re.finditer(rf"[^{WS}{STOPS}]+[{STOPS}]?|[{STOPS}]", text)), default=0)


def check(text, limit, overlap):
    pieces, opened = split(text, limit, overlap)
    longest = longest_stretch(text)
    assert (opened > limit) == (longest > limit) and (opened == longest or opened <= limit)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for s, e, _ in pieces:
        assert 0 < e - s <= limit
    for (s, e, forced), (s2, e2, _) in zip(pieces, pieces[1:]):
        # at least the overlap, or what there is
        assert s2 <= max(0, e - overlap) and s2 >= e - overlap - (limit - overlap) // 4 and e2 > e
        assert s2 in (0, max(0, e - overlap)) or natural(text, s2) or "\u0301" in text
        if forced:
            assert "\u0301" in text or not natural(text, e)
        else:
            assert natural(text, e)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n。！ \u3000\u0301#-|<>/p", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces(text, limit, overlap):
    check(text, limit, overlap)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "- x y", "  - z", "1. q", "| a | b |", "```", "<div>", "</div>", "<p>one</p>", "", "some words. More of them.", "    deep line"]), max_size=30), st.integers(8, 60), st.integers(0, 7))
def test_structured_pieces(lines, limit, overlap):
    check("\n".join(lines), limit, overlap)


def cut(text, limit):
    return [text[s:e] for s, e, _ in split(text, limit, 0)[0]]


def test_sections_before_their_parts():
    one, two, three = ["alpha beta gamma. " * 3 + "\n" for _ in range(3)]
    text = "# A\n## A1\n" + one + "## A2\n" + two + "# B\n## B1\n" + three
    assert cut(text, 120) == ["# A\n## A1\n" + one, "## A2\n" + two, "# B\n## B1\n" + three]
    assert cut(text, 140) == ["# A\n## A1\n" + one + "## A2\n" + two, "# B\n## B1\n" + three]
    # a heading stands with what it heads
    assert cut("# T\n\n" + "word " * 30, 60)[0].startswith("# T\n\nword")


def test_lists_tables_fences_and_markup():
    items = "- one\n  - in one\n  - in one too\n- two\n  - in two\n"
    assert cut(items, 36) == ["- one\n  - in one\n  - in one too\n", "- two\n  - in two\n"]
    fence = "```\nx = 1\n\ny = 2\n```\n"
    assert fence in cut("Some words before it.\n" + fence + "Some words after it.\n", 30)
    table = "| a | b |\n| 1 | 2 |\n"
    assert table in cut("words and words.\n" + table + "words and words.\n", 25)
    markup = "<div>\n<p>one two</p>\n<p>three</p>\n</div>\n<div>\n<p>four</p>\n</div>\n"
    assert cut(markup, 50) == ["<div>\n<p>one two</p>\n<p>three</p>\n</div>\n", "<div>\n<p>four</p>\n</div>\n"]
    assert cut(markup.replace("\n", " "), 50) == [x.replace("\n", " ") for x in cut(markup, 50)]


def test_deep_nesting_does_not_recurse():
    deep = "".join(" " * i + "- x\n" for i in range(1500))
    assert "".join(cut(deep, 200)) == deep
    many = "<div>\n" * 5000
    assert "".join(cut(many, 40)) == many
    assert structure("#" * 7 + " x").kids[0].kind == "block"


def test_stretches():
    assert split("abc。de ？" * 3, 6, 0)[1] == 0
    assert split("a" * 9 + "\u200b" + "a", 10, 0)[1] == 11
    assert any(f for _, _, f in split("a" * 30, 10, 2)[0]) and not any(f for _, _, f in split("a b " * 30, 10, 2)[0])
    # a stretch that only the overlap makes too long is cut, and told apart
    assert split("b " * 10 + "a" * 10 + " b" * 9, 10, 2)[1] == 10


def test_overlap_begins_at_a_boundary():
    text = "words of some length follow each other here " * 20
    pieces, _ = split(text, 100, 17)
    assert all(s == 0 or text[s - 1] == " " for s, _, _ in pieces)
    marks = "e\u0301" * 200
    assert not any(marks[s] == "\u0301" for s, _, _ in split(marks, 30, 5)[0])


def test_long_text_is_linear():
    assert len(split("word " * 400_000, 1000, 100)[0]) > 2000
    assert len(split("x" * 1_000_000, 1000, 100)[0]) > 1000
    assert len(split("line\n" * 200_000, 1000, 100)[0]) > 1000


def test_rows(spark):
    rows = [(1, None, 10, 0), (2, "", 10, 0), (3, "a b c d e f g h", 5, 1), (4, "long " * 9, None, None), (5, "x" * 40, 8, 20)]
    df = spark.createDataFrame(rows, "k int, text string, m int, o int")
    got = {r["k"]: (None if r["pieces"] is None else len(r["pieces"]), r["opened"]) for r in split_texts(df, F.col("text"), F.col("m"), F.col("o"), {"k": F.col("k")}).collect()}
    assert got[1] == (None, None) and got[2] == (0, 0) and got[4] == (1, 0) and got[5][1] == 40 and got[5][0] > 30 and got[3][1] == 0
    assert split_texts(df.where("false"), F.col("text"), F.col("m"), F.col("o"), {"k": F.col("k")}).count() == 0
