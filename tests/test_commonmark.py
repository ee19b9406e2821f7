"""Public CommonMark examples: which lines are headings, what their text is, and what is code.

A heading's text is what stands in it without code, raw HTML and line breaks. Whether something is code shows in a link
inside it, [[x]], which then is none.
"""

import pytest

from graphloom.functions import markdown

HEADINGS = [
    ("# foo\n## foo\n### foo\n#### foo\n##### foo\n###### foo", ["foo"] * 6), ("####### foo", []), ("#5 bolt\n\n#hashtag", []), ("#\tFoo", ["Foo"]), ("\\## foo", []),
    ("# foo *bar* \\*baz\\*", ["foo bar *baz*"]), ("#                  foo                     ", ["foo"]), (" ### foo\n  ## foo\n   # foo", ["foo"] * 3), ("    # foo", []), ("foo\n    # bar", []),
    ("## foo ##\n  ###   bar    ###", ["foo", "bar"]), ("# foo ##################################\n##### foo ##", ["foo", "foo"]), ("### foo ###     ", ["foo"]), ("### foo ### b", ["foo ### b"]), ("# foo#", ["foo#"]),
    ("### foo \\###\n## foo #\\##\n# foo \\#", ["foo ###", "foo ###", "foo #"]), ("****\n## foo\n****", ["foo"]), ("Foo bar\n# baz\nBar foo", ["baz"]), ("## \n#\n### ###", []),
    ("Foo *bar*\n=========\n\nFoo *bar*\n---------", ["Foo bar", "Foo bar"]), ("Foo *bar\nbaz*\n====", ["Foo barbaz"]), ("  Foo *bar\nbaz*\t\n====", ["Foo barbaz"]), ("Foo\n-------------------------\n\nFoo\n=", ["Foo", "Foo"]),
    ("   Foo\n---\n\n  Foo\n-----\n\n  Foo\n  ===", ["Foo"] * 3), ("    Foo\n    ---\n\n    Foo\n---", []), ("Foo\n   ----      ", ["Foo"]), ("Foo\n    ---", []), ("Foo\n= =\n\nFoo\n--- -", []), ("Foo  \n-----", ["Foo"]), ("Foo\\\n----", ["Foo\\"]),
    ('`Foo\n----\n`\n\n<a title="a lot\n---\nof dashes"/>', ["`Foo", '<a title="a lot']), ("> Foo\n---", []), ("> foo\nbar\n===", []), ("- Foo\n---", []), ("Foo\nBar\n---", ["FooBar"]), ("\n====", []), ("- foo\n-----", []), ("    foo\n---", []),
    ("> foo\n-----", []), ("\\> foo\n------", ["> foo"]), ("Foo\n\nbar\n---\nbaz", ["bar"]), ("Foo\nbar\n\n---\n\nbaz", []), ("Foo\nbar\n* * *\nbaz", []), ("Foo\nbar\n\\---\nbaz", []),
    ("> # Foo\n> bar\n> baz", ["Foo"]), ("># Foo\n>bar\n> baz", ["Foo"]), ("   > # Foo\n   > bar", ["Foo"]), ("    > # Foo", []), ("> # Foo\n> bar\nbaz", ["Foo"]), ("- # Foo\n- Bar\n  ---\n  baz", ["Foo", "Bar"]), ("1. - 2. foo\n\n       # x", ["x"]),
    ("[a]: b\n===\n", []), ("[foo]: /url\n===\n[foo]", []), ("[foo]: /url\nbar\n===\n[foo]", ["bar"]), ("# [Foo]\n[foo]: /url\n> bar", ["Foo"]), ("# [a][foo] [b]\n\n[foo]: /x", ["a [b]"]), ("Foo\n[bar]: /baz\n\n# [bar]", ["[bar]"]),
    ('[foo]: /url "title" ok\n\n# [foo]', ["[foo]"]), ("[foo]:\n/url\n\n# [foo]", ["foo"]), ("[foo]: /u1\n[foo]: /u2\n# [FOO]", ["FOO"]), ("> [foo]: /url\n\n# [foo]", ["foo"]), ("[foo]: <>\n\n# [foo]", ["foo"]), ("    [foo]: /url\n\n# [foo]", ["[foo]"]),
    ("***a** b*\n===", ["a b"]), ("# *foo bar*", ["foo bar"]), ("# a * foo bar*", ["a * foo bar*"]), ('# a*"foo"*', ['a*"foo"*']), ("# foo*bar*", ["foobar"]), ("# _foo bar_", ["foo bar"]), ("# _ foo bar_", ["_ foo bar_"]), ("# foo_bar_", ["foo_bar_"]), ('# aa_"bb"_cc', ['aa_"bb"_cc']),
    ("# foo-_(bar)_", ["foo-(bar)"]), ("# _foo*", ["_foo*"]), ("# *foo bar *", ["*foo bar *"]), ("# *(*foo)", ["*(*foo)"]), ("# *(*foo*)*", ["(foo)"]), ("# **foo*", ["*foo"]), ("# *foo**", ["foo*"]), ("# ***foo** bar*", ["foo bar"]), ("# *foo**bar**baz*", ["foobarbaz"]), ("# *foo**bar*", ["foo**bar"]),
    ("# foo ***", ["foo ***"]), ("# foo *\\**", ["foo *"]), ("# **foo*bar**", ["foo*bar"]), ("# *(**foo**)*", ["(foo)"]), ("# *foo [bar](/url)*", ["foo bar"]), ("# ****foo*", ["***foo"]), ("# foo******bar*********baz", ["foobar***baz"]), ("# **foo [bar](/url)**", ["foo bar"]), ("# *foo _bar* baz_", ["foo _bar baz_"]),
    ("# ![a *b*](/u) c", ["a b c"]), ("# <b>x</b> &amp; &copy; &nosuch; &#35; &#x22;", ['x & © &nosuch; # "']), ("# [a](b) [c] <http://d.e>", ["a [c] http://d.e"]), ('# [link](/uri "title") [l](<b c>) [](./t.md)', ["link l"]), ("# [link](/my uri)", ["[link](/my uri)"]), ("# [a [b](c) d](e)", ["[a b d](e)"]),
    ("# [link](foo(and(bar)))", ["link"]), ("# [foo `](x)` y", ["[foo  y"]), ("# a\\\\b \\a \\[c]", ["a\\b \\a [c]"]), ("# `` ` `` z", ["z"]),
]
HIDDEN = [
    "    [[x]]", "- foo\n\n      [[x]]", "    chunk1\n\n    [[x]]", "    chunk1\n      \n      [[x]]", "```\n[[x]]\n```", "~~~\n[[x]]\n```\n~~~", "``\n[[x]]\n``", "```\naaa\n~~~\n[[x]]\n```", "````\naaa\n```\n[[x]]\n``````", "```\n[[x]]", "   ```\n [[x]]\n   ```", "    ```\n    [[x]]\n    ```",
    "```\naaa\n    ```\n[[x]]", "~~~~~~\naaa\n~~~ ~~\n[[x]]", "~~~ aa ``` ~~~\n[[x]]\n~~~", "```\n``` aaa\n[[x]]\n```", "~~~~    ruby startline=3 $%@#$\ndef foo(x)\n[[x]]\n~~~~~~~", "`````\n\n```\n[[x]]", "> ```\n> [[x]]", "```\n\n  \n[[x]]\n```",
    "`[[x]]`", "`` foo ` [[x]] ``", "`a\n[[x]]`", '<a href="`">` [[x]] `', "<https://foo.bar.`baz>` [[x]] `", "`foo``[[x]]``", "\\``[[x]]`", "- a\n\n\n      [[x]]", "- a\n  > b\n  ```\n  [[x]]\n  ```\n- c", "-\n  ```\n  [[x]]\n  ```", "> - a\n>\n>       [[x]]",
    "\t[[x]]", "  \t[[x]]", "- foo\n\n\t\t[[x]]", ">\t\t[[x]]", "-\t\t[[x]]", "    foo\n\t[[x]]", "1.     [[x]]", "- foo\n\n  - bar\n\n        [[x]]", "> foo\n\n    [[x]]", "# Heading\n    [[x]]\nHeading\n------\n", "- a\n\n  ```\n  [[x]]\n\n\n  ```",
]
SHOWN = [
    "1.  foo\n\n    - [[x]]", "foo\n    [[x]]", "```\n\n```\n[[x]]", "> ```\n> aaa\n\n[[x]]", "``` ```\n[[x]]", "foo\n```\nbar\n```\n[[x]]", "``` aa ```\n[[x]]", "` `` ` [[x]]", "`foo\\`[[x]]`", "*foo`*` [[x]]", "[not a `link](/foo`) [[x]]", '`<a href="`">` [[x]]', "```foo`` [[x]]", "`foo [[x]]",
    "1. a\n\n   [[x]]", "-    a\n\n     [[x]]", "- \n\n  [[x]]", "  - foo\n\n\t[[x]]", " - foo\n   - bar\n\t - [[x]]", "> foo\n    - [[x]]", "- a\n    [[x]]", "-one\n\n    two\n[[x]]", "    chunk1\n[[x]]", "~~~\naaa\n~~~\n[[x]]", "> a\n[[x]]", "\\`[[x]]`", "`a`` [[x]]", "10) foo\n\n    [[x]]", "The number is\n14.  [[x]]",
    "* a\n*\n\n* [[x]]", "```\naaa\n  ```\n[[x]]", "   ```\naaa\n```\n[[x]]", "- foo\n\n\n  [[x]]", "- a\n - b\n  - c\n   - [[x]]", "> > deep\n[[x]]",
]


@pytest.mark.parametrize(("text", "headings"), HEADINGS)
def test_headings(text, headings):
    assert markdown.read(text).headings == headings


@pytest.mark.parametrize("text", HIDDEN)
def test_code(text):
    assert markdown.read(text).links == []


@pytest.mark.parametrize("text", SHOWN)
def test_no_code(text):
    assert [raw for raw, _, _ in markdown.read(text).links] == ["x"]


def test_ranges_of_code():
    text = "a\n\n    one\n\n    two\n\nb `c` d\n\n```x\ny\n```\n> ~~~\n> q\n"
    assert [text[a:b] for a, b in markdown.read(text).code] == ["one\n\n    two\n", "`c`", "```x\ny\n```", "~~~\n> q"]
