"""The text of a heading as a reader sees it: CommonMark's inline rules, with code and raw HTML left out."""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

TAG = (
    r"""<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?:(?!-->)[\s\S])*--|\?(?:(?!\?>)[\s\S])*\?|![A-Za-z][^>]*|!\[CDATA\[(?:(?!\]\]>)[\s\S])*\]\])>"""
)
AUTOLINK = r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>"
SPECIAL = re.compile(r"[\\`<&!\[\]*_\n]")
MARKUP = re.compile(TAG)
ADDRESS = re.compile(AUTOLINK)
ENTITY = re.compile(r"&(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*;))(?:;|(?<=;))")
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: A link's address may hold brackets in pairs, up to three deep.
_PLAIN = r"(?:\\.|[^\s\x00-\x1f()\\])*"
for _ in range(3):
    _PLAIN = rf"(?:\\[!-/:-@\[-`{{-~]|\\|[^\s\x00-\x1f()\\]|\({_PLAIN}\))*"
TARGET = re.compile(rf"""\(\s*(?:<(?:\\.|[^<>\\\n])*>|{_PLAIN})(?:\s+(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?\s*\)""")
LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){0,999})\]")
DEFINITION = re.compile(
    r"""\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*(?:<(?:\\.|[^<>\\\n])*>|[^\s<\x00-\x1f][^\s\x00-\x1f]*)(?:(?:[ \t]*\n[ \t]*|[ \t]+)(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))(?=[ \t]*(?:\n|\Z)))?[ \t]*(?:\n|\Z)"""
)


def label(text: str) -> str:
    return " ".join(text.split()).casefold()


class _Run:
    """A run of * or _ at ``node``: how many are left, and whether it may open or close."""

    __slots__ = ("char", "closes", "left", "node", "opens", "whole")

    def __init__(self, char: str, n: int, node: int, before: str, after: str):
        blank = lambda c: not c or c.isspace()
        mark = lambda c: bool(c) and (c in PUNCTUATION or unicodedata.category(c)[0] in "PS")
        left = not blank(after) and (not mark(after) or blank(before) or mark(before))
        right = not blank(before) and (not mark(before) or blank(after) or mark(after))
        self.char, self.left, self.whole, self.node = char, n, n, node
        self.opens = left and (char == "*" or not right or mark(before))
        self.closes = right and (char == "*" or not left or mark(after))


def _emphasis(runs: list[_Run], bottom: int) -> None:
    """Takes pairs out of the runs from ``bottom`` on, as CommonMark does; what is left of a run is text."""
    own = runs[bottom:]
    del runs[bottom:]
    floor: dict[tuple, int] = {}
    stack: list[_Run] = []  # runs that may still open
    for run in own:
        if run.closes:
            while run.left:
                key = (run.char, run.opens, run.whole % 3)
                k = len(stack) - 1
                while k >= floor.get(key, 0):
                    opener = stack[k]
                    odd = (opener.closes or run.opens) and (opener.whole + run.whole) % 3 == 0 and (opener.whole % 3 or run.whole % 3)
                    if opener.char == run.char and not odd:
                        break
                    k -= 1
                else:
                    floor[key] = len(stack)
                    break
                used = 2 if stack[k].left >= 2 and run.left >= 2 else 1
                stack[k].left -= used
                run.left -= used
                del stack[k + 1 :]
                if not stack[k].left:
                    stack.pop()
                floor = {c: min(n, len(stack)) for c, n in floor.items()}
        if run.left and run.opens:
            stack.append(run)


def plain(text: str, defined: set[str]) -> str:
    """What is left of inline text; ``defined`` are the labels of link definitions. Lines are joined without a break."""
    nodes: list[str] = []
    runs: list[_Run] = []
    brackets: list[list] = []  # node, first run, whether active, whether an image, place after it
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    at, size = 0, len(text)
    while at < size:
        m = SPECIAL.search(text, at)
        if m is None:
            nodes.append(text[at:])
            break
        if m.start() > at:
            nodes.append(text[at : m.start()])
        at, c = m.start(), m[0]
        if c == "\n":
            if nodes:
                nodes[-1] = nodes[-1].rstrip(" ")
            at += 1
            while at < size and text[at] in " \t":
                at += 1
        elif c == "\\":
            after = text[at + 1 : at + 2]
            nodes.append(after if after in PUNCTUATION else "" if after == "\n" else "\\")
            at += 2 if after and (after in PUNCTUATION or after == "\n") else 1
        elif c == "`":
            n = len(re.compile("`+").match(text, at)[0])
            places = ticks[n] if n in ticks else []
            while places and places[0] <= at:
                places.pop(0)
            if places:
                at = places[0] + n
            else:
                nodes.append("`" * n)
                at += n
        elif c == "<":
            if m := ADDRESS.match(text, at):
                nodes.append(m[0][1:-1])
            elif not (m := MARKUP.match(text, at)):
                nodes.append("<")
            at = m.end() if m else at + 1
        elif c == "&":
            m = ENTITY.match(text, at)
            said = "&"
            if m and m[3] and m[3] in html5:
                said = html5[m[3]]
            elif m and (m[1] or m[2]):
                code = int(m[1]) if m[1] else int(m[2], 16)
                said = chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
            else:
                m = None
            nodes.append(said)
            at = m.end() if m else at + 1
        elif c in "*_":
            n = 1
            while at + n < size and text[at + n] == c:
                n += 1
            runs.append(_Run(c, n, len(nodes), text[at - 1 : at], text[at + n : at + n + 1]))
            nodes.append(c * n)
            at += n
        elif c == "[" or text.startswith("![", at):
            image = c == "!"
            at += 1 + image
            brackets.append([len(nodes), len(runs), True, image, at])
            nodes.append("![" if image else "[")
        elif c == "]":
            at = _close(text, at, nodes, runs, brackets, defined)
        else:
            nodes.append(c)
            at += 1
    every = list(runs)
    _emphasis(runs, 0)
    for run in every:
        nodes[run.node] = run.char * run.left
    return "".join(nodes)


def _close(text: str, at: int, nodes: list[str], runs: list[_Run], brackets: list[list], defined: set[str]) -> int:
    """A closing bracket: the end of a link, whose marks go, or text. Gives the place after it."""
    if not brackets:
        nodes.append("]")
        return at + 1
    node, first, active, image, begun = brackets.pop()
    if not active:
        nodes.append("]")
        return at + 1
    end = None
    if m := TARGET.match(text, at + 1):
        end = m.end()
    else:
        m = LABEL.match(text, at + 1)
        own = label(m[1]) if m and m[1].strip() else label(text[begun:at])
        if own in defined:
            end = m.end() if m else at + 1
    if end is None:
        nodes.append("]")
        return at + 1
    nodes[node] = ""
    inner = runs[first:]
    _emphasis(runs, first)
    for run in inner:
        nodes[run.node] = run.char * run.left
    if not image:
        for b in brackets:
            if not b[3]:
                b[2] = False
    return end
