"""Pages as they are shown: shadow trees, slots, frames and style sheets."""

import random

from maskwright.plans import page_queries
from maskwright.sources.html_tree import parse_tree
from maskwright.sources.pages import page_lines, parse_html, parse_page
from maskwright.sources.styles import Sheet, Styles, declarations, rules, selectors


def said(html):
    return [r["text"] for r in parse_html(html)]


def placed(html):
    return [(r["text"], r["semantic"], r["kind"], r["table_id"], r["col"]) for r in parse_html(html)]


def test_shadow_trees_and_slots():
    host = "<div><template shadowrootmode=open><p>in</p><slot name=a>none</slot><slot>{}</slot></template>{}</div>"
    assert said(host.format("fallback", "")) == ["in", "none", "fallback"]
    assert said(host.format("fallback", "<b slot=a>one</b>rest<i>two</i>")) == ["in", "one", "rest", "two"]
    # the first slot of a name has what is assigned; another name is shown nowhere
    assert said("<div><template shadowrootmode=open><slot></slot>|<slot>again</slot></template>x<b slot=z>lost</b></div>") == ["x", "|", "again"]
    # closed trees are read as well; where no shadow tree may be, the template stays one, and shows nothing
    assert said("<x-a><template shadowrootmode=closed>seen</template>no</x-a>") == ["seen"]
    assert said("<td><template shadowrootmode=open>no</template>yes</td>") == ["yes"] and said("<template>no</template>") == []
    # only the first template of a host counts, and slots outside of shadow trees show their own content
    assert said("<div><template shadowrootmode=open>1</template><template shadowrootmode=open>2</template></div><slot>own</slot>") == ["1", "own"]
    # trees within trees, and a slot that is itself assigned to another
    nested = "<div><template shadowrootmode=open><section><template shadowrootmode=open><slot></slot>!</template><slot></slot></section></template>deep</div>"
    assert said(nested) == ["deep", "!"]


def test_meaning_cells_and_blocks_across_shadow_borders():
    page = "<table><tr><th>H<th>I</tr><tr><td>a</td><td><x-c><template shadowrootmode=open><b>v</b></template></x-c></td></tr></table>"
    assert placed(page)[-1] == ("v", "data", "td", 0, 1)
    # assigned children are looked up from where they stand, not from where they are shown
    page = "<nav><x-c><template shadowrootmode=open><table><tr><td><slot></slot></td></tr></table></template>w</x-c></nav>"
    assert placed(page) == [("w", "label", "nav", None, None)]
    rows = parse_html("<div>a<x-c><template shadowrootmode=open><b>b</b><p>c</p></template></x-c>d</div>")
    assert [(r["text"], r["block_id"]) for r in rows] == [("a", 0), ("b", 0), ("c", 1), ("d", 0)]


def test_frames():
    page = '<td><iframe srcdoc="&lt;td&gt;x&lt;/td&gt;&lt;p&gt;y"></iframe></td>'
    assert placed(page) == [("x", "data", "td", None, None), ("y", None, None, None, None)]
    assert said('<iframe srcdoc="&lt;style&gt;p{display:none}&lt;/style&gt;&lt;p&gt;no"></iframe><p>yes') == ["yes"]
    opaque = parse_page('<iframe src=x width=40></iframe><iframe sandbox srcdoc=z></iframe><object></object><img height=2.5><iframe hidden src=x></iframe>').opaque
    assert [(o["tag"], o["w"], o["h"]) for o in opaque] == [("frame", 40.0, None), ("frame", None, None), ("frame", None, None), ("img", None, 2.5)]
    assert said('<iframe sandbox="allow-scripts allow-same-origin" srcdoc=z></iframe>') == ["z"]


def test_cells_are_counted_not_spanned():
    assert [(t, col) for t, _, _, _, col in placed("<table><tr><td colspan=3>a</td><td>b</td></tr></table>")] == [("a", 0), ("b", 1)]
    # roles are compared as they are written
    assert placed("<div role=Button>a</div><div role=button>b</div>") == [("a", None, None, None, None), ("b", "label", "button", None, None)]


def test_hidden_subtrees():
    assert said("<style>.a .b{display:none}</style><div class=a>x<p class=b>no<i>no</i></p></div><p class=b>y</p>") == ["x", "y"]
    # a hidden element takes its subtree along, whatever stands below
    assert said("<style>.h{visibility:hidden}.v{visibility:visible}</style><p class=h>no<b class=v>no</b></p><p style='opacity:0'>no</p><p style='opacity:.1'>yes</p>") == ["yes"]
    # an element without a box of its own is looked into
    assert said("<div style='display:contents;opacity:0'>a<p>b</p><p hidden>no</p></div>") == ["a", "b"]
    # the attribute hides by HTML's own sheet, which any rule overrides
    assert said("<p hidden>no</p><style>.on{display:block}</style><p hidden class=on>yes</p>") == ["yes"]
    assert said("<dialog>no</dialog><dialog open>yes</dialog><details>no<summary>sum</summary></details><details open>in</details><datalist><option>no</datalist>") == ["yes", "sum", "in"]
    assert said("<style media=print>p{display:none}</style><style>@media print{p{display:none}}@media (max-width:600px){p{display:none}}@media screen and (min-width:600px){i{display:none}}</style><p>a<i>no</i>") == ["a"]


def test_blocks_follow_display():
    block = lambda html: [(r["text"], r["block_id"]) for r in parse_html(html)]
    assert block("<style>b{display:block}div div{display:inline}</style><div>a<b>b</b><div>c</div></div>") == [("a", 0), ("b", 1), ("c", 0)]
    # floated, absolutely placed and flex children are blocks; those of an element without a box count for the one around it
    assert block("<p>a<i style='float:left'>b</i><i style='position:absolute'>c</i></p>") == [("a", 0), ("b", 1), ("c", 2)]
    assert block("<div style='display:flex'><i>a</i><u style='display:contents'><i>b</i></u></div>") == [("a", 0), ("b", 1)]


def test_which_declaration_wins():
    style = lambda css, body="<p id=i class='c d'>": Styles().declared(next(n for n in parse_tree(body).within() if n.tag == "p"), parse_tree(f"<style>{css}</style>")).get("display")
    assert style("p{display:a}p{display:b}") == "b" and style(".c{display:a}p{display:b}") == "a" and style("#i{display:a}.c.d{display:b}") == "a"
    assert style("p{display:a!important}#i{display:b}") == "a" and style("#i{display:a}", "<p id=i style='display:b'>") == "b"
    assert style("#i{display:a !important}", "<p id=i style='display:b'>") == "a" and style(":where(#i){display:a}p{display:b}") == "b"
    assert style(":not(.x){display:a}p{display:b}") == "a" and style("p:hover{display:a}p::before{display:a}") is None
    shadow = "<div class=o><template shadowrootmode=open><style>:host{display:a}:host(.o){visibility:b}::slotted(b){display:c}</style><slot></slot></template><b>t</b></div>"
    for css, want in (("", "a"), ("div{display:z}", "z")):
        tree = parse_tree(f"<style>{css}</style>{shadow}")
        styles, nodes = Styles(), {n.tag: n for n in tree.within()}
        assert styles.declared(nodes["div"], tree)["display"] == want and styles.declared(nodes["div"], tree)["visibility"] == "b"
        assert styles.declared(nodes["b"], tree)["display"] == "c"


def test_sheets():
    assert list(rules("a{display:none}/* b{display:none} */ @import 'x;y'; .c , d { color:red; display : BLOCK ; } @media screen{e{opacity:0}} @supports (x){f{display:none}} g{content:'}';float:left}")) == [
        ("a", {"display": (False, "none")}), (".c , d", {"display": (False, "block")}), ("e", {"opacity": (False, "0")}), ("g", {"float": (False, "left")}),
    ]
    assert declarations("display:none!important;display:block") == {"display": (True, "none")} and declarations("display;:x;;color:a") == {}
    assert list(rules("a{display:none")) == [("a", {"display": (False, "none")})] and list(rules("}{")) == []
    assert [s.specificity for s in selectors("#a .b c, *, a:not(#x), ::before, a[b=c]:first-child")] == [(1, 1, 1), (0, 0, 0), (1, 0, 1), (0, 0, 1), (0, 2, 1)]
    assert selectors("a >> b, a{, ..x") == []


def _plainly(selector, node, tags):
    """Chains of tags with combinators, by every element that may stand there."""
    last, *more = selector
    if node.tag != last:
        return False
    if not more:
        return True
    binds, rest = more[0], more[1:]
    above, p = [], node.parent
    while p is not None and p.is_element:
        above.append(p)
        p = p.parent
    beside = node.parent.elements()
    before = beside[: beside.index(node)]
    among = {" ": above, ">": above[:1], "~": before, "+": before[-1:]}[binds]
    return any(_plainly(rest, n, tags) for n in among)


def test_selectors_by_brute_force():
    rng = random.Random(9)
    tags = ["x-a", "x-b", "x-c"]
    for _ in range(60):
        html, depth = "", 0
        for _ in range(30):
            if depth and rng.random() < 0.45:
                html, depth = html + "</>", depth - 1
            else:
                html, depth = html + f"<{rng.choice(tags)}>", depth + 1
        open_, out = [], ""
        for piece in html.replace("<", "\n<").split("\n")[1:]:
            if piece == "</>":
                out += f"</{open_.pop()}>"
            else:
                open_.append(piece[1:-1])
                out += piece
        tree = parse_tree(out)
        chain = [rng.choice(tags)]
        for _ in range(rng.randrange(4)):
            chain += [rng.choice(" >~+"), rng.choice(tags)]
        text = "".join(c if c in tags else (c if c == " " else f" {c} ") for c in reversed(chain))
        sheet = Sheet(parse_tree(f"<style>{text}{{display:none}}</style>"))
        for node in tree.within():
            assert bool(list(sheet.matching(node))) == _plainly(chain, node, tags), (text, out)


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    broken = "<p>a<div>b</p></span><table><td>c<tr><td>d</table><li>e<li>f<select><option>g</b><textarea>"
    df = spark.createDataFrame([(1, deep), (2, broken), (3, None), (4, ""), (5, "<"), (6, "</p><!-- x --><![CDATA[y]]>")], "page_id long, html string")
    rows = page_lines(df, checks=True).collect()
    assert [r.text for r in rows if r.page_id == 1] == ["x"]
    assert [r.text for r in rows if r.page_id == 2][:6] == ["a", "b", "c", "d", "e", "f"]
    assert {r.page_id for r in rows} <= {1, 2, 5}


def test_expectations_of_a_page(spark):
    html = '<div data-check=mask>a<b data-check=keep>b</b></div>c<input data-check=mask value=d>'
    rows = page_lines(spark.createDataFrame([(1, html)], "page_id long, html string"), checks=True).collect()
    assert [(r.text, r.check) for r in rows] == [("a", "mask"), ("b", "keep"), ("c", None), ("d", "mask")]
    got = {r.check: (r.violations, r.n) for r in page_queries.page_coverage(spark, "/root/testdata/sf0.001").collect()}
    assert got["mask"][0] == 0 and got["mask"][1] == 400 and got["keep"][1] == 400
