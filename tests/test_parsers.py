"""The parsers alone: Markdown, Rust, C and terms, on re-worded cases of each rule."""

import pytest

from graphloom.functions import markdown
from graphloom.functions.source_code import symbols
from graphloom.functions.terms import Matcher


def names(path, text):
    return {("::".join(s[0]), s[1]) for s in symbols(path, text)}


def links(text):
    return [raw for raw, _, _ in markdown.read(text).links]


@pytest.mark.parametrize(
    ("text", "body"),
    [("---\na: b\n---\nrest", "rest"), ("no\n---\n", "no\n---\n"), ("---\nopen\n", "---\nopen\n"), ("---\r\na\r\n---\r\nx", "x"), ("----\nx\n---\n", "----\nx\n---\n"), ("---\n---", ""), ("", "")],
)
def test_frontmatter(text, body):
    assert text[markdown.body_start(text) :] == body


def test_headings_and_code():
    note = markdown.read("---\nt: [[no]]\n---\n# One `c` two\n\nSet\n===\n\n```\n# no\n```\n\n    # no\n> ## Quoted\n- # Item\n####### seven\n#nospace\n## \n### Shut ###\n")
    assert note.headings == ["One  two", "Set", "Quoted", "Item", "Shut"]


def test_links_and_code():
    assert links("[[a]] `[[b]]` [[c#h]]\n```\n[[d]]\n```\n[[e]]") == ["a", "c#h", "e"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("`[[` then [[eaten]] and [[kept]]", ["kept"]),
        ("[[ \n a \n ]] [[b\nc]] [[d]]", [" \n a \n ", "d"]),
        ("[[[a]] [[]] [[ ]]", ["[a"]),
        ("[[open", []),
    ],
)
def test_link_quirks(text, found):
    assert links(text) == found


def test_positions_count_code_points_and_utf16():
    text = "---\nx: y\n---\n\n用😀 [[n]]"
    note, lines = markdown.read(text), markdown.Lines(text)
    _, start, end = note.links[0]
    assert (lines.place(start), lines.place(end)) == ((4, 3), (4, 8))
    assert lines.utf16(start) == 4


def test_rust_rules():
    text = """
    pub struct P<T> { pub a: Vec<T>, b: u8 }
    struct U(u8);
    enum E { A, B { x: u8 } }
    trait Tr { type It; fn sig(&self); }
    mod m { fn f() { fn nested() {} } }
    impl<T> P<T> { fn new() -> Self { loop {} } }
    impl<T> Tr for x::P<T> { fn sig(&self) { let s = "fn no() {"; } }
    const C: u8 = 1; static mut S: u8 = 2; type A = u8; macro_rules! mm { () => { fn no() {} } }
    /* fn no() {} /* nested */ */ // fn no() {}
    """
    assert names("a.rs", text) == {
        ("P", "struct"), ("P::a", "field"), ("P::b", "field"), ("U", "struct"), ("E", "enum"), ("E::A", "variant"), ("E::B", "variant"), ("Tr", "trait"), ("Tr::sig", "method"),
        ("m", "module"), ("m::f", "function"), ("P::new", "method"), ("P::sig", "method"), ("C", "const"), ("S", "static"), ("A", "type"), ("mm", "macro"),
    }


def test_c_rules():
    text = """
    #define MAX 1
    #define F(x) \\
        (x)
    struct S { int a, *b; int (*skip)(void); };
    typedef struct { int no; } Anon;
    enum { NO }; enum K { RED, BLUE = 2 };
    static int g = 1; int h[2] = {1, 2}; int proto(void); char *odd(void);
    #ifdef X
    int add(int a) { int local = a; return local; }
    #endif
    """
    assert names("a.h", text) == {
        ("MAX", "macro"), ("F", "macro"), ("S", "struct"), ("S::a", "field"), ("S::b", "field"), ("Anon", "type"), ("K", "enum"), ("RED", "const"), ("BLUE", "const"),
        ("g", "static"), ("h", "variable"), ("odd", "variable"), ("add", "function"),
    }


@pytest.mark.parametrize("text", ["fn", "impl {", "struct S {", "}}}", "fn f(", '"', "r#\"", "/*", "enum E { A(", "'", "\\"])
def test_broken_sources_do_not_crash(text):
    symbols("a.rs", text)
    symbols("a.c", text)


def test_other_extensions_have_no_symbols():
    assert symbols("a.py", "fn f() {}") == [] and symbols("rs", "fn f() {}") == []


@pytest.mark.parametrize("lines", [0, 1, 7])
def test_shifted_lines_keep_symbols(lines):
    text = "struct A;\nimpl A {\n  fn go() {}\n}\n"
    before, after = symbols("a.rs", text), symbols("a.rs", "\n" * lines + text)
    assert [s[:2] for s in before] == [s[:2] for s in after]
    assert [s[4] + lines for s in before] == [s[4] for s in after]


def said(text, terms, path="n.md"):
    return [(k, text[a:b]) for k, a, b in Matcher(terms).find(text, markdown.read(text), path)]


def test_terms():
    terms = [(0, "状態", "glossary/a.md"), (1, "状態管理", "glossary/b.md"), (2, "LIN", "glossary/c.md")]
    assert said("状態と状態管理", terms) == [(0, "状態"), (1, "状態管理")]
    assert said("LINバス LINE xLIN LIN", terms) == [(2, "LIN"), (2, "LIN")]
    assert said("`LIN` [[LIN]] LIN", terms) == [(2, "LIN")]
    assert said("状態管理 LIN", terms, "glossary/b.md") == [(2, "LIN")]
    assert said("---\nt: LIN\n---\n# LIN", terms) == [(2, "LIN")]
    assert said("LIN", []) == []


@pytest.mark.parametrize(
    ("text", "headings"),
    [
        ("<div>\n# no\n</div>\n\n# yes", ["yes"]),
        ("<!-- one\n\n# no\n-->\n# yes", ["yes"]),
        ("<!-- one --> x\n# yes", ["yes"]),
        ("<script>\n\n# no\n</script>\n# yes", ["yes"]),
        ("<?php\n# no\n?>\n# yes", ["yes"]),
        ("<![CDATA[\n# no\n]]>\n# yes", ["yes"]),
        ("text\n<span>\n# yes", ["yes"]),
        ("<span class='a'>\n# no\n\n# yes", ["yes"]),
        ("text\n<p>\n# no\n\n# yes", ["yes"]),
        ("> <div>\n> # no\n\n# yes", ["yes"]),
        ("<b> and more\n# yes", ["yes"]),
        ("< div>\n# yes", ["yes"]),
    ],
)
def test_blocks_of_html_hold_no_headings(text, headings):
    assert markdown.read(text).headings == headings


def test_links_count_inside_html_but_code_does_not_hide_them():
    note = markdown.read("<div>\n`[[a]]` [[b]]\n</div>\n\n`[[c]]`")
    assert [raw for raw, _, _ in note.links] == ["a", "b"]


