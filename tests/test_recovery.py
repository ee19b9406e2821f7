"""Sources that are broken, deep or long; long lines of links."""

import time

import pytest

from graphloom.functions import markdown
from graphloom.functions.source_code import symbols


def names(path, text):
    return ["::".join(s[0]) for s in symbols(path, text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("fn a() {\n    if x {\n}\nfn b() {}\n", ["a", "b"]),
        ("impl A {\n    fn a(&self) {\n        if x {\n    }\n    fn b(&self) {}\n}\nfn c() {}\n", ["A::a", "A::b", "c"]),
        ("fn a(x: u8 {\n    y\n}\nstruct B { c: u8 }\n", ["a", "B", "B::c"]),
        ("struct S {\n    a: u8,\n    b: u8\nfn f() {}\n", ["S", "S::a", "S::b", "f"]),
        ("enum E {\n    A,\n    B\nimpl E {\n    fn g() {}\n}\n", ["E", "E::A", "E::B", "E::g"]),
        ("fn a() {}\n}\nfn b() {}\n", ["a", "b"]),
        ("mod m {\n    fn a() {}\n    fn b() {\n        x(\n    fn c() {}\n}\nfn d() {}\n", ["m", "m::a", "m::b", "m::c", "d"]),
        ("fn before() {}\nimpl T {\n    fn go(&self) {\n        let x = (1, [2;\n", ["before", "T::go"]),
        ("trait R {\n    fn t(&self);\n    fn u(&self) {\n}\nstruct A;\n", ["R", "R::t", "R::u", "A"]),
        ("lazy! {\n    fn no() {}\n}\nfn yes() {}\n", ["yes"]),
    ],
)
def test_rust_keeps_what_stands_around_a_fault(text, want):
    assert names("a.rs", text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("int a(void) {\n    if (x) {\n}\nint b(void) { return 1; }\n", ["a", "b"]),
        ("#ifdef X\nint f(int a) {\n#else\nint f(long a) {\n#endif\n    return 0;\n}\nint g;\n", ["f", "f", "g"]),
        ("struct S {\n    int a;\n    int b;\nint g(void) { return 1; }\n", ["S", "S::a", "S::b", "g"]),
        ("int a;\n}\nint b;\n", ["a", "b"]),
        ("MODULE(x)\nint f(void) { return 1; }\n", ["f"]),
        ("EXPORT(a, b)\nEXPORT(c)\nstatic int g;\n", ["g"]),
        ("int a(int x\n{\n    return x;\n}\nint b;\n", ["b"]),
        ('extern "C" {\nint f(void) { return 1; }\nint g;\n', ["f", "g"]),
    ],
)
def test_c_keeps_what_stands_around_a_fault(text, want):
    assert [n for n in names("a.c", text) if n in want] == want


def test_whole_sources_are_not_read_by_indent():
    text = "impl A {\nfn a(&self) {\nlet x = 1;\n}\n        fn b(&self) {}\n}\n    fn c() {}\n"
    assert names("a.rs", text) == ["A::a", "A::b", "c"]


@pytest.mark.parametrize(("path", "opening", "closing"), [("a.rs", "{", "}"), ("a.rs", "mod m {", "}"), ("a.rs", "impl A {", "}"), ("a.c", 'extern "C" {', "}"), ("a.c", "{", "}"), ("a.rs", "(", ")"), ("a.c", "(", ")")])
def test_deep_nesting(path, opening, closing):
    inner = "fn f() {}" if path == "a.rs" else "int f(void) { return 1; }"
    for depth in (3_000, 6_000):
        symbols(path, opening * depth + inner + closing * depth)
        symbols(path, opening * depth + inner)


def timed(f, text):
    began = time.perf_counter()
    f(text)
    return time.perf_counter() - began


@pytest.mark.parametrize("part", ["[[a]] ", "\\` ", "`a` ", "` `` ", "😀 [[b]] `", "[[", "> ", "- ", "*a* ", "<b> "])
def test_long_lines_take_time_in_proportion(part):
    def work(text):
        note, lines = markdown.read(text), markdown.Lines(text)
        for _, a, b in note.links:
            lines.utf16(a), lines.utf16(b)

    small, large = (min(timed(work, part * n) for _ in range(2)) for n in (5_000, 40_000))
    assert large < 40 * small + 0.5


def test_utf16_on_lines_of_wide_characters():
    text = "a😀b\n😀😀c\n" * 3
    lines = markdown.Lines(text)
    for k in range(len(text) + 1):
        start = text.rfind("\n", 0, k) + 1
        assert lines.utf16(k) == len(text[start:k].encode("utf-16-le")) // 2
