"""Element tables of hand-written pages."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domweave.operators.dom import _Builder, elements, inner_html, parse_pages, text_of
from domweave.session import configure


def tree(source):
    doc, nodes = _Builder(source, True).run()
    return doc, [(n.tag, n.depth, doc[n.trim_start : n.trim_end]) for n in nodes], nodes


def tags(source):
    return [(t, d) for t, d, _ in tree(source)[1]]


def test_empty_page_still_has_its_three_elements():
    assert tags("") == [("html", 0), ("head", 1), ("body", 1)]


def test_fragment_goes_into_body():
    assert tags("<i>x</i>y") == [("html", 0), ("head", 1), ("body", 1), ("i", 2)]


@pytest.mark.parametrize(
    ("source", "inside_body"),
    [
        ("<p>a<p>b", [("p", 2), ("p", 2)]),
        ("<p>a<div>b</div>", [("p", 2), ("div", 2)]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", [("ul", 2), ("li", 3), ("li", 3), ("ul", 4), ("li", 5)]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("dl", 2), ("dt", 3), ("dd", 3), ("dt", 3)]),
        ("<select><option>1<option>2</select><b>", [("select", 2), ("option", 3), ("option", 3), ("b", 2)]),
        (
            "<table><tr><td>1<td>2<tr><th>3</table>",
            [("table", 2), ("tbody", 3), ("tr", 4), ("td", 5), ("td", 5), ("tr", 4), ("th", 5)],
        ),
        (
            "<table><tr><td><table><tr><td>x</td></tr></table></td><td>y",
            [("table", 2), ("tbody", 3), ("tr", 4), ("td", 5), ("table", 6), ("tbody", 7), ("tr", 8), ("td", 9), ("td", 5)],
        ),
        ("<br/><img src=a><hr>x", [("br", 2), ("img", 2), ("hr", 2)]),
        ("<div/>x<b>y</b>", [("div", 2), ("b", 3)]),
        ("<!-- <p>no</p> --><p>yes", [("p", 2)]),
        ("<span><div>a</span>b</div><i>", [("span", 2), ("div", 3), ("i", 3)]),
        ("</p>x", [("p", 2)]),
    ],
)
def test_implied_ends(source, inside_body):
    assert tags(source)[3:] == inside_body


def test_raw_text_is_not_markup():
    _, rows, _ = tree('<script>var a="</p><p>";</script><textarea><b>&amp;</textarea><title>t&lt;</title>')
    assert rows[2] == ("script", 2, 'var a="</p><p>";')
    assert [r for r in rows if r[0] in ("textarea", "title")] == [("textarea", 2, "<b>&"), ("title", 2, "t<")]
    assert not [r for r in rows if r[0] in ("b", "p")]


def test_attributes():
    _, _, nodes = tree("<A HREF=x CLASS='  a \t b ' id=one ID=two title=it's data-x>z</A><p title='a=\"<b>\"'>")
    a = nodes[3]
    assert (a.tag, a.id, a.classes) == ("a", "one", ["a", "b"])
    assert a.attrs == {"href": "x", "class": "  a \t b ", "id": "one", "title": "it's", "data-x": ""}
    assert nodes[4].attrs == {"title": 'a="<b>"'}


def test_entities():
    _, rows, nodes = tree('<a href="?a=1&copy=2&amp;b=3&lt;">&amp;&nbsp;&eacute;&#128512;&copy</a>')
    assert nodes[3].attrs["href"] == "?a=1&copy=2&b=3<"
    assert rows[3][2] == "& é😀©"


def test_texts_and_positions():
    source = "<div> one <b>two</b>\n three  </div>"
    doc, rows, nodes = tree(source)
    div, b = nodes[3], nodes[4]
    assert rows[3][2] == "one two\n three" and doc[div.text_start : div.text_end] == " one two\n three  "
    assert div.own_text == "one \n three" and b.own_text == "two"
    assert source[div.html_start : div.html_end] == " one <b>two</b>\n three  "
    assert (div.n_children, b.child_index, b.type_index, b.type_count, b.parent_tag) == (1, 0, 1, 1, "div")


def test_long_outer_blanks_are_trimmed():
    _, rows, _ = tree("<p>" + " \n" * 300 + "x" + "\t " * 300 + "</p>")
    assert rows[3][2] == "x"


def test_very_deep_and_very_long_pages_stay_cheap():
    doc, _, nodes = tree("<b>" * 20_000 + "x" + "<br>y" * 50_000)
    assert len(nodes) == 3 + 20_000 + 50_000 and doc == "x" + "y" * 50_000
    assert max(n.depth for n in nodes) == 20_002
    doc, _, nodes = tree("<div>" * 2_000 + "<p>x</p>" * 2_000 + "</i>" * 20_000)
    assert [n.depth for n in nodes][-2_000:] == [2_002] * 2_000 and nodes[2_002].n_children == 2_000
    assert all(n.n_children == 1 for n in nodes[3:2_002])


FRAGMENTS = st.lists(
    st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>",
                     "<b class=x>", "</b>", "<br>", " text ", "&amp;", "<script>", "</script>", "<", "<!--", "-->", "<a href='"]),
    max_size=40,
).map("".join)


@settings(max_examples=200, deadline=None)
@given(FRAGMENTS)
def test_numbering_is_consistent(source):
    doc, nodes = _Builder(source, True).run()
    by_id = {n.node_id: n for n in nodes}
    assert [n.node_id for n in nodes] == list(range(len(nodes)))
    for n in nodes:
        assert n.node_id <= n.last_id
        assert n.text_start <= n.trim_start <= n.trim_end <= n.text_end <= len(doc)
        if n.parent_id is None:
            assert n.depth == 0
        else:
            parent = by_id[n.parent_id]
            assert n.depth == parent.depth + 1 and parent.node_id < n.node_id <= n.last_id <= parent.last_id
            assert parent.text_start <= n.text_start and n.text_end <= parent.text_end
        children = [c for c in nodes if c.parent_id == n.node_id]
        assert n.n_children == len(children) and [c.child_index for c in children] == list(range(len(children)))


def test_bad_rows_do_not_fail_the_job(spark, monkeypatch):
    configure(spark)
    pages = spark.createDataFrame([(1, "<p>a"), (2, None)], "page_id long, html string")
    rows = elements(parse_pages(pages)).groupBy("page_id").agg(F.count("*").alias("n")).collect()
    assert {r["page_id"]: r["n"] for r in rows} == {1: 4, 2: 3}
    assert parse_pages(pages).where("parse_error IS NOT NULL").count() == 0


def test_script_text_can_be_left_out(spark):
    pages = spark.createDataFrame([(1, "<body>a<script>b</script>c")], "page_id long, html string")
    assert parse_pages(pages, script_text=False).first()["doc_text"] == "ac"
    assert parse_pages(pages).first()["doc_text"] == "abc"


def test_classes_are_cut_at_html_blanks_only(spark):
    pages = spark.createDataFrame([(1, '<p class=" a\tb\u00a0c\n">x</p>')], "page_id long, html string")
    from domweave.functions.selectors import css
    from domweave.operators.extract import matched_texts

    dom = parse_pages(pages)
    assert matched_texts(dom, css(".a")).first().texts == ["x"]
    assert matched_texts(dom, css(".b")).first().texts in (None, [])


@pytest.mark.parametrize("piece", ["<a ", "</a ", "<!-", '<a x="', '<a x=">" '])
def test_unclosed_tags_take_linear_time(piece):
    source = "<p>first</p>" + piece * (1_000_000 // len(piece))
    begin = time.perf_counter()
    doc, nodes = _Builder(source, True).run()
    assert time.perf_counter() - begin < 2
    assert doc.startswith("first") and [n.tag for n in nodes[:4]] == ["html", "head", "body", "p"]


def test_unclosed_tag_at_the_end_is_text():
    doc, nodes = _Builder("<p>one</p><b>two</b> <a href=", True).run()
    assert doc == "onetwo <a href=" and [n.tag for n in nodes] == ["html", "head", "body", "p", "b"]


def test_byte_ranges_of_wide_characters(spark):
    html = "<!-- é😀 --><div>  ä<b>€ 😀</b> ü\xa0</div><p>日本 <i>z</i></p>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = elements(parse_pages(pages), "page_id", "doc_text", "html").select(
        "tag", "text_length", text_of().alias("text"), text_of(raw=True).alias("raw"), inner_html().alias("inner")).collect()
    found = {r["tag"]: tuple(r)[1:] for r in rows}
    assert found["div"] == (9, "ä€ 😀 ü", "  ä€ 😀 ü\xa0", "  ä<b>€ 😀</b> ü\xa0")
    assert found["b"] == (3, "€ 😀", "€ 😀", "€ 😀")
    assert found["p"] == (4, "日本 z", "日本 z", "日本 <i>z</i>")
    assert found["i"] == (1, "z", "z", "z")


def test_few_elements_are_held_as_objects(spark, monkeypatch):
    """A batch of many pages is packed piece by piece, and stays in order."""
    import pyarrow as pa

    from domweave.operators import dom as module

    sizes, pack = [], module._element_array
    monkeypatch.setattr(module, "_element_array", lambda nodes: sizes.append(len(nodes)) or pack(nodes))
    pages = pa.array([None, ""] + [f"<p>{i}</p>" + "<i></i>" * 96 for i in range(500)])
    out = module._parser(True).func(pages)
    assert len(out) == len(pages) and sum(sizes) == 6 + 500 * 100 and max(sizes) < 11_000
    assert [o["doc_text"] for o in out.to_pylist()] == ["", ""] + [str(i) for i in range(500)]
    assert [len(o["nodes"]) for o in out.to_pylist()] == [3, 3] + [100] * 500
    assert len(module._parser(True).func(pa.array([], pa.string()))) == 0


def test_a_task_hands_pages_on_before_its_batch_ends():
    """The elements of a batch are never held together, whatever the number of its pages."""
    import pyarrow as pa

    from domweave.operators import dom as module

    pages = pa.array(["<ul>" + "<li>x" * 3000 + "</ul>", None, "<p>y"] * 8)
    read = []

    def batches():
        for _ in range(2):
            read.append(len(pages))
            yield pages

    out = module._stream_parser(True).func(batches())
    first = next(out)
    assert read == [24] and len(first) < 24 and sum(map(len, first.field("nodes").to_pylist())) < 2 * module.HELD_ELEMENTS
    rest = [first, *out]
    assert read == [24, 24] and len(rest) > 4
    assert pa.concat_arrays(rest).equals(pa.concat_arrays([module._parser(True).func(pages)] * 2))


def test_elements_written_alike_share_no_facts(spark):
    rows = spark.createDataFrame([(1, "</p></td><td class='a b'>1<td class='a b'>2<tr class='a b'>"), (2, "</div>"), (3, "</p>")], "page_id long, html string")
    found = {r["page_id"]: [(n["tag"], n["attrs"], n["classes"]) for n in r["nodes"]] for r in parse_pages(rows).collect()}
    assert [n for n in found[1] if n[1]] == [("td", {"class": "a b"}, ["a", "b"])] * 2 + [("tr", {"class": "a b"}, ["a", "b"])]
    assert [n[0] for n in found[2]] == ["html", "head", "body"] and [n[0] for n in found[3]] == ["html", "head", "body", "p"]
