"""What counts as hidden on a page."""

import re

from tessera.llm.html_text import to_text


def test_only_the_attributes_themselves_hide():
    for attrs in ('title="the hidden gem of Rome"', 'class="nav hidden md:flex"', 'data-style="display:none"', "alt='a hidden b'", 'data-hidden="1"', 'style="background:url(x;display:none)"', "style=\"content:'; display:none'\"", 'style="/* display:none */ color:red"', 'style="display:none; display:block"'):
        assert to_text(f"a <span {attrs}>b</span> c") == "a b c", attrs
    for attrs in ("hidden", "HIDDEN", 'hidden=""', "title=x hidden", "hidden=until-found", "style=display:none", "style='color: red; DISPLAY : none'", 'style="display:none!important; display:block"', 'style="display&#58;none"'):
        assert to_text(f"a <span {attrs}>b</span> c") == "a c", attrs
    assert to_text('<dialog title="not open yet">a</dialog><dialog open>b</dialog>') == "b"
    assert to_text("<ol data-start=7><li>a</ol>") == "1. a" and to_text("<ol start='7'><li>a</ol>") == "7. a"


def test_visible_again_below_hidden():
    assert to_text('<div style="visibility:hidden">a<p>b</p><p style="visibility:visible">c <i>d</i></p></div>e') == "c d\n\ne"
    assert to_text('<table><tr style="visibility:collapse"><td>a<td>b<tr><td>c<td>d</table>') == "c | d"


def test_text_of_formulas_drawings_and_forms():
    assert to_text("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds") == "so x=1 holds"
    assert to_text("<svg><title>t</title><desc>d</desc><defs><text>e</text></defs><style>s</style><text>one</text><text>two</text></svg> end") == "one two end"
    assert to_text("<svg><title/><style/><text>one</text></svg> end") == "one end"
    assert to_text("<svg><foreignObject><desc>kept</desc></foreignObject></svg>") == "kept"
    assert to_text("a<textarea>\nb  c\n&lt;d</textarea>e") == "a\nb  c\n<d\ne"
    assert to_text("<p>pick<select><option>one<option selected>two<option>three</select>now</p>") == "pick two now"
    assert to_text("<select><option>one<option>two</select>") == "one"
    assert to_text("<select multiple><optgroup><option>one<option>two</optgroup></select>") == "one\ntwo"
    assert to_text('<p style="visibility:hidden">a<svg><text>b</text></svg></p>c') == "c"


def test_cells_over_rows_and_columns():
    assert to_text("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>") == "r | 1\n  | 2"
    assert to_text("<table><tr><th colspan=2>both<th>c<tr><td>a<td>b<td>3</table>") == "both |   | c\na | b | 3"
    assert to_text("<table><tr><td rowspan=0>all<td>x<tr><td>y<tr><td>z</table>") == "all | x\n    | y\n    | z"
    assert to_text("<table><tr><td colspan=1000>wide<td>x<tr><td>y<td colspan='0'>z</table>") == "wide |   | x\ny | z"
    assert to_text("<table><tr><td colspan=-3 rowspan=x>a<td>b</table>") == "a | b"


def shown_words(page):
    """Words outside tags, by another reader: the standard library's, with hidden subtrees left out."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        skip, out = [], []

        def handle_starttag(self, tag, attrs):
            named = dict(attrs)
            hides = tag in ("head", "script", "style", "template", "noscript", "title", "iframe", "object", "audio", "video", "canvas") or "hidden" in named or "display:none" in (named.get("style") or "").replace(" ", "")
            if (self.skip or hides) and tag not in ("br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"):
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    reader = Reader()
    reader.skip, reader.out = [], []
    reader.feed(page)
    reader.close()
    return "".join(" ".join(reader.out).split())


def test_all_pages_keep_every_visible_word_and_no_other():
    import pyarrow.parquet as pq

    off = []
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        got = re.sub(r"(?m)^\s*(?:- |\d+\. )| \| ?|^\| ", "", to_text(page or ""))
        marks = re.compile(r"[-|.\d\s]")
        if marks.sub("", got) != marks.sub("", shown_words(page or "")):
            off.append(page)
    assert not off, (len(off), off[0])
