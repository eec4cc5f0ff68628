import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.config import PreviewConfig, TextConfig, XmlConfig
from corpusloom.errors import InvalidConfiguration, XmlError
from corpusloom.functions import evidence, matching, preview, textsplit, xmltok
from corpusloom.plans import engine

WS = textsplit.WHITE_SPACE


def read_all(data, element="page", limit=1 << 20):
    return [b for b, _ in xmltok.records(io.BytesIO(data).read, element, limit)]


def test_record_boundaries():
    assert read_all(b"<d><page><t>1</t></page> x <page/><page a='>'>2</page>") == [b"<page><t>1</t></page>", b"<page a='>'>2</page>"]
    assert read_all(b"<d><page>a<page>b</page></page></d>") == [b"<page>a<page>b</page></page>"]
    assert read_all(b"<d><page><!-- </page> --><![CDATA[</page>]]>&x;</page></d>") == [b"<page><!-- </page> --><![CDATA[</page>]]>&x;</page>"]
    assert read_all(b"<d><n:page>1</n:page><Page>2</Page></d>") == []
    with pytest.raises(InvalidConfiguration, match="inside record"):
        read_all(b"<d><page>1")
    with pytest.raises(InvalidConfiguration, match="max_record_bytes"):
        read_all(b"<page>12345</page>", limit=17)
    assert read_all(b"<page>12345</page>", limit=18)
    with pytest.raises(XmlError):
        read_all(b"<d><page><a></b></page></d>")


def test_small_reads_give_the_same_records(monkeypatch):
    data = b"<?xml version='1.0'?><d>" + b"".join(b"<page n='%d'>a &amp; b<![CDATA[<x>]]><!-- c --><e/></page>\n" % i for i in range(50)) + b"</d>"
    whole = read_all(data)
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(xmltok, "CHUNK", chunk)
        assert read_all(data) == whole
    assert len(whole) == 50


def test_configurations_are_checked():
    for make in (lambda: XmlConfig(""), lambda: XmlConfig("p", 0), lambda: TextConfig(0), lambda: PreviewConfig(0), lambda: PreviewConfig(max_children=0)):
        with pytest.raises(InvalidConfiguration):
            make()


def test_chunks_goldens():
    assert textsplit.chunks("one two three four five six", 12) == ["one two ", "three four ", "five six"]
    assert textsplit.chunks("extraordinary", 8) == ["extraordinary"]
    assert "".join(textsplit.chunks("alpha café delta", 8)) == "alpha café delta"


def model(text, target):
    """Cut after the last white space that ends within the target, else after the next."""
    out, start, data = [], 0, text
    while start < len(data):
        rest = data[start:]
        if len(rest.encode()) <= target:
            out.append(rest)
            break
        size, cut, end = 0, None, None
        for k, c in enumerate(rest):
            size += len(c.encode())
            if c in WS:
                if size <= target:
                    cut = k + 1
                elif cut is None:
                    end = k + 1
                    break
            if size > target and cut is not None:
                break
        cut = cut or end or len(rest)
        out.append(rest[:cut])
        start += cut
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "漢", " ", "　", "\n", "longerword"]), max_size=60).map("".join), st.integers(1, 30))
def test_chunks_equal_the_model(text, target):
    if text:
        assert textsplit.chunks(text, target) == model(text, target)


def test_paragraphs(spark):
    texts = ["a\nb\n\nc\n", "\n \na\r\n\r\nb", "", "x", "a\n\xa0\nb\n  ", "one\n\n\n\ntwo\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", textsplit.paragraphs_column("t").alias("p")).collect()
    for r in rows:
        assert r["p"] == list(textsplit.paragraphs(iter(io.StringIO(texts[r["i"]], newline="")))), texts[r["i"]]


def test_matcher_a_equals_the_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "A ", "b", " ", "_", "é", ".", "aa a"]) for _ in range(rng.randrange(12))) for _ in range(300)] + ["aa a a", "Straße ÉTÉ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for q in ("a", "a a", "aa", " b ", "É", "a.", "\\E", "(", "  ", "été"):
        got = {r["i"] for r in df.where(matching.contains_whole_words(df["t"], q)).collect()}
        assert got == {i for i, t in enumerate(texts) if matching.contains_whole_words_py(t, q)}, q
    assert not matching.contains_whole_words_py("aa a a", "a a")


def test_matcher_b():
    assert matching.first_match("A general-purpose tool", "general purpose") == (2, 17)
    assert matching.first_match("É", "é") is None
    assert matching.first_match("abc", "...") is None


def test_previews():
    p = lambda x, **k: preview.xml_preview(x, PreviewConfig(**({"stop_element": None} | k)))
    assert p(b"<a>x<maker><n>Alice</n><o>123</o></maker><b/>t<c>A&amp;B<![CDATA[<]]></c></a>") == [("maker", "Alice123"), ("b", ""), ("c", "AB<")]
    assert p(b"<a><x>1</x><title>t</title><y>2</y></a>", stop_element="title") == [("x", "1"), ("title", "t")]
    assert p(b"<a><x>1</x><y>2</y><z>3</z></a>", max_children=2) == [("x", "1"), ("y", "2")]
    assert p(b"<a><x>1234567</x><y>2</y></a>", target_bytes=8) == [("x", "1234567")]
    with pytest.raises(InvalidConfiguration):
        p(b"<a><x>1")
    assert preview.text_prefix("alpha βeta gamma delta", 7) == "alpha "


def test_whole_documents_and_pages_are_cleaned(spark, tmp_path):
    long = "ab & cd\ue000 e\ue001a " * 30 + "{{own|\n{{x}} <y> tail {{open"
    spark.createDataFrame([(1, long), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, parts in (("clean_documents", (long[:40], long[40:])), ("clean_pages", tuple(t.replace("& ", " ").replace(" <y> ", "  y ") for t in (long[:40], long[40:])))):
        whole = evidence.clean_wiki("{{Infobox}}" + parts[0] + "{{a|b}}{{c}}" + parts[1] + " == References == gone")
        assert len(whole) > 300
        assert dict(tuple(r) for r in engine.QUERIES[name](spark, str(tmp_path)).collect()) == {1: whole, 2: ""}, name


def test_templates_and_cleaning(spark):
    texts = ["a{{x}}{{y}}b {{q}}c{{d", " {{a{{b}} c}}", "x{{t}}", "{{t}}x", "é{{\n}}\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evidence.remove_templates_column("t").alias("x")).collect()
    for r in rows:
        assert r["x"] == evidence.remove_templates(texts[r["i"]])
    assert evidence.remove_templates(texts[0]) == "a b c{{d"
    page = b'<page><title>T</title><id>5</id><revision><id>6</id><text xml:space="preserve">Ada\\n wrote <ref>no</ref>it{{x}}.== References ==no</text></revision></page>'
    assert evidence.clean_xml(page) == "Ada wrote  it ."
    assert evidence.clean_xml(b"<a><b>A. B. Brenna</b><c>Tidal Charts</c><d>1870</d></a>") == "A. B. Brenna Tidal Charts 1870"
    assert evidence.clean_xml(b"<a><b>A&amp;B</b><ref>x</ref></a>") == "A B"
    assert evidence.clean_xml(b"") == ""


def test_windows():
    text = "before target alpha beta gamma target later"
    assert evidence.fragment(text.encode(), "target", 24, "txt") == "before target alpha beta"
    small, large = (evidence.fragment(text.encode(), "gamma", n, "txt") for n in (20, 40))
    assert small in large
    with pytest.raises(InvalidConfiguration, match="exceeds"):
        evidence.fragment(b"longword", "longword", 4, "txt")
    for q, n in (("  ", 9), ("a", 0)):
        with pytest.raises(InvalidConfiguration):
            evidence.fragment(b"a", q, n, "txt")


def window_model(text, start, end, budget):
    size = lambda a, b: len(text[a:b].encode())
    while True:
        grown = False
        if start > 0:
            c = start
            while c > 0 and text[c - 1] in WS:
                c -= 1
            while c > 0 and text[c - 1] not in WS:
                c -= 1
            if size(c, end) <= budget:
                start, grown = c, True
        if end < len(text):
            c = end
            while c < len(text) and text[c] in WS:
                c += 1
            while c < len(text) and text[c] not in WS:
                c += 1
            if size(start, c) <= budget:
                end, grown = c, True
        if not grown:
            return text[start:end]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "é", " ", "  ", "\n", "(x)"]), max_size=30).map("".join), st.integers(1, 40))
def test_window_equals_the_model(text, budget):
    found = matching.first_match(text, "a")
    if found:
        assert evidence.window(text, *found, max(budget, 1)) == window_model(text, *found, max(budget, 1))
