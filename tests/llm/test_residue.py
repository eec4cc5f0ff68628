import pytest

from corpusloom.llm import residue

CASES = [
    ("Plain prose with x < 912 and y > 164, a == b, and $815 to $360.", set()),
    ("See note [868] and item #463 of the list. The R&D office; crates of 392 * 529 * 520, postage 5* then.", set()),
    ("The set {133, 879} and D:\\scans\\roll720 then /srv/scans/roll812, ledger_805_copy.", set()),
    ("- foo\n- bar\n\n1) one\n2) two\n\nyear | shelf | place\n1 | 2 | 3", set()),
    ("<p>One <b>two</b></p>", {"html"}),
    ("a&nbsp;b", {"html"}),
    ("<!-- note -->text", {"html"}),
    ("text<ref>Smith, ''Book'', 1920.</ref>", {"wiki"}),
    ("<nowiki>*</nowiki> x <nowiki>*</nowiki>", {"wiki"}),
    ("== Early Forest ==\nSome [[gate|gates]].", {"wiki"}),
    ("# ''curious'' inn\n# ''pale'' dam", {"wiki"}),
    ('{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}', {"wiki"}),
    ("| a | b |\n|---|--:|\n| x | 1 |", {"markdown"}),
    ("## Heading\n\n- **bold** item", {"markdown"}),
    ("~~~\nlet x = a == b;\n~~~", {"markdown"}),
    ("[33 acres](https://a.example/b) of land", {"markdown"}),
    ("Title\n=====\n\ntext", {"markdown"}),
    ("> quoted", {"markdown"}),
    ("- [x] done", {"markdown"}),
    ("\\section{A}\n\\begin{itemize}\n  \\item one\n\\end{itemize}", {"latex"}),
    ("for $E = \\alpha k^{3/2}$ and", {"latex"}),
    ("\\[ \\sqrt{p^2} \\]", {"latex"}),
    ("see \\cite{dock1902}.", {"latex"}),
    ("\\begin{tabular}{lr}\nplain & 70 \\\\\n\\end{tabular}", {"latex"}),
    ("<pre><code>if a &gt; 3 { [[x]] }</code></pre>", {"html"}),
    ("== Head ==\n\n$$ x^2 $$", {"wiki", "latex"}),
    ("", set()),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds(text, kinds):
    assert residue.scan(text).kinds == kinds
    assert residue.tree(text).kinds == kinds


def shape(text):
    found: dict = {}
    for block, line, kind, own, _ in residue.tree(text).runs:
        lines = found.setdefault(block, (kind, {}))[1]
        lines[line] = lines.get(line, "") + own
    return [(k, list(v.values()) if k in ("list", "table") else v[0]) for k, v in found.values()]


def test_blocks_keep_structure():
    assert shape("== Head ==\nSome '''bold''' [[a|words]].<ref>no</ref>\n\n* one\n* two") == [("heading", "Head"), ("paragraph", "Some bold words."), ("list", ["one", "two"])]
    assert shape("<h2 id='x'>Head</h2><p>a &amp; b</p><ul><li>one<li>two</ul>") == [("heading", "Head"), ("paragraph", "a & b"), ("list", ["one", "two"])]
    assert shape("# Head\n\n~~~\ncode  here\n~~~\n\n| a | b |\n|---|---|\n| 1 | 2 |") == [("heading", "Head"), ("code", "code  here"), ("table", ["a | b", "1 | 2"])]
    assert shape("\\section{Head}\nText \\emph{here} with $x^2$.\n\n\\[ y^2 \\]\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}") == [
        ("heading", "Head"),
        ("paragraph", "Text here with $x^2$."),
        ("formula", "\\[ y^2 \\]"),
        ("list", ["one", "two"]),
    ]
    assert shape("just\ntext\n\nmore") == [("paragraph", "just\ntext"), ("paragraph", "more")]
    long = "word " * 200_000
    assert shape(long) == [("paragraph", long.strip())]


def test_templates_go_and_rows_survive(spark):
    pages = [("s", k, "h", f"== Menu ==\n* home\n* about\n\nText number {k} of its own.\n\n* item {k}\n* about") for k in range(30)]
    pages += [("s", 100, None, "== Menu ==\n\nno host"), ("s", 101, "h", ""), ("s", None, "h", "x"), ("s", 102, "h", None), ("s", 103, "g", "<b>x</b>")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "src string, item_id bigint, host string, text string, markup string, marks int")
    assert {r["items"] for r in residue.templates(residue.parsed(df)).collect()} == {30}
    out = {r["item_id"]: r for r in residue.cleaned(df).collect()}
    assert len(out) == 33
    assert out[3]["text"] == "Text number 3 of its own.\n\n- item 3" and out[3]["removed"] == 5 and out[3]["markup"] == []
    assert out[100]["text"] == "# Menu\n\nno host" and out[101]["text"] == "" and out[103]["text"] == "x"
    few = {r["item_id"]: r["text"] for r in residue.cleaned(df, residue.ResidueConfig(max_broadcast=1)).collect()}
    assert few == {k: r["text"] for k, r in out.items()}
    kinds = {r["item_id"]: (r["kept"], r["template"]) for r in residue.markup(df).collect()}
    assert kinds[3] == ([], ["wiki"]) and kinds[100] == (["wiki"], []) and kinds[103] == (["html"], []) and kinds[101] == ([], [])
    assert residue.cleaned(df.limit(0)).count() == 0 == residue.markup(df.limit(0)).count()


def test_subtrees_of_elements_are_templates(spark):
    page = "<body><nav><ul><li><a href='/{k}'>Home page</a></li><li>Item {k}</li></ul></nav><div><span>Site header</span> own text {k}</div><p>Words <b>of</b> {k}.</p><footer>All <i>rights kept</i> here</footer></body>"
    df = spark.createDataFrame([("s", k, "h", page.replace("{k}", str(k))) for k in range(40)], "src string, item_id bigint, host string, text string")
    out = {r["item_id"]: r["text"] for r in residue.cleaned(df).collect()}
    assert out[7] == "- Item 7\n\nown text 7\n\nWords of 7."
    kinds = residue.markup(df).collect()
    assert all(r["kept"] == ["html"] == r["template"] for r in kinds)


def test_every_text_gives_a_tree():
    for text in ("</div></b>x<br/>y", "<p>a<p>b<li>c", "\x011\x02 \x0e5\x0f \x04", "<div>" * 3000 + "deep words" + "</div>" * 3000, "<table><tr><td>a<td>b", "line\n<b>two words</b> <i>x y</i>"):
        found = residue.tree(text)
        assert all(0 <= a <= z <= len(found.runs) for _, a, z, _ in found.nodes), text[:40]
    assert [r[3] for r in residue.tree("line\n<b>two words</b> <i>x y</i> z").runs] == ["line\n", "two words", " x y", " z"]
    assert residue.tree("for $x = " + "a + " * 200 + "b$ it").kinds == {"latex"}


def test_block_elements_stand_apart():
    for name in ("aside", "main", "form", "address", "details", "title", "label"):
        assert ("paragraph", "Subscribe to our letter") in shape(f"<p>The mill stood here.</p>Own words <{name}>Subscribe to our letter</{name}> and more."), name


def test_nested_templates_and_commands_are_unwrapped():
    deep = "{{lang|fr|" * 5 + "moulin" + "}}" * 5
    found = shape(f"'''Mill''' is [[old]] {deep} here.\n\n== Past ==\nText.")
    assert "moulin" in found[0][1] and "{" not in found[0][1]
    found = shape("\\section{Mill}\nAn \\textbf{\\emph{\\textit{\\textsc{\\texttt{old}}}}} mill \\cite{a}.")
    assert any("An old mill" in t for _, t in found) and not any("\\" in t for _, t in found)
