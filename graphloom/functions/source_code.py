"""Definitions in Rust and C sources, in plain Python.

A lexer blanks comments and literals out (places stay), then items are read with balanced brackets. Where
brackets do not balance, as while a file is being written, indentation says which one was left open: a line that
begins an item, or closes a bracket, further left than the line of an open bracket ends that bracket before it. So the
symbols before and after a fault are found. Nesting of any depth is read on a stack of its own.
Each definition is (path, kind, start, end, name start, name end), offsets in code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Symbol = tuple[tuple[str, ...], str, int, int, int, int]

RUST_HIDDEN = re.compile(
    r"""//[^\n]*|/\*|b?r(\#*)"(?:.|\n)*?"\1|b?c?"(?:\\(?:.|\n)|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"""
)
C_HIDDEN = re.compile(r"""//(?:\\\r?\n|[^\n])*|/\*(?:.|\n)*?(?:\*/|\Z)|(?:L|u8?|U)?"(?:\\(?:.|\n)|[^"\\\n])*"|(?:L|u8?|U)?'(?:\\(?:.|\n)|[^'\\\n])*'""")
NESTED = re.compile(r"/\*|\*/")
TOKEN = re.compile(r"(?:r\#)?[^\W\d]\w*|\d\w*|'[^\W\d]\w*|::|->|=>|[^\s\w]")
NAME = re.compile(r"(?:r\#)?[^\W\d]\w*\Z")
PAIRS = {"(": ")", "[": "]", "{": "}"}
CLOSERS = set(PAIRS.values())
#: Words, and the mark of an attribute, that begin an item of Rust on a line.
RUST_ITEMS = set("fn pub struct enum union impl trait mod const static type use macro_rules unsafe async extern #".split())


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, hidden: re.Pattern[str], nests: bool, keep: Callable[[str], bool] = lambda s: False) -> str:
    """The text with comments and literals blanked out; Rust's block comments nest."""
    out, at = [], 0
    while m := hidden.search(text, at):
        out.append(text[at : m.start()])
        end = m.end()
        if nests and m[0] == "/*":
            depth = 1
            while depth and (n := NESTED.search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            if depth:
                end = len(text)
        piece = text[m.start() : end]
        out.append(piece if keep(piece) else blank(piece))
        at = end
    out.append(text[at:])
    return "".join(out)


class Tokens:
    """Tokens with their places; ``begins`` says whether a token that comes first on its line begins an item."""

    def __init__(self, text: str, begins: Callable[[str, int], bool]):
        self.found = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.n = len(self.found)
        self.match = [self.n] * self.n  # of an opening bracket, its closing one, or the last token in it
        self.open: set[int] = set()  # brackets that nothing closes
        stack: list[int] = []
        for k, (t, _, _) in enumerate(self.found):
            if t in PAIRS:
                stack.append(k)
            elif t in CLOSERS:
                if not stack or PAIRS[self.found[stack[-1]][0]] != t:
                    break
                self.match[stack.pop()] = k
        else:
            if not stack:
                return
        self.recover(text, begins)

    def recover(self, text: str, begins: Callable[[str, int], bool]) -> None:
        self.match = [self.n] * self.n
        stack: list[tuple[int, int]] = []  # brackets, and the indent of their lines
        line_end, column = -1, 0

        def leave(k: int) -> None:
            self.match[stack[-1][0]] = k - 1
            self.open.add(stack.pop()[0])

        for k, (t, at, _) in enumerate(self.found):
            first = at > line_end
            if first:
                column = at - text.rfind("\n", 0, at) - 1
                line_end = text.find("\n", at)
                line_end = len(text) if line_end < 0 else line_end
                if begins(t, column):
                    while stack and stack[-1][1] >= column:
                        leave(k)
            if t in PAIRS:
                stack.append((k, column))
            elif t in CLOSERS:
                if first:
                    while stack and stack[-1][1] > column:
                        leave(k)
                    if stack and stack[-1][1] < column and t == "}":
                        continue  # one too many
                while stack and PAIRS[self.found[stack[-1][0]][0]] != t:
                    leave(k)
                if stack:
                    self.match[stack.pop()[0]] = k
        self.open.update(k for k, _ in stack)

    def inside(self, k: int, stop: int) -> int:
        """Where what bracket k holds ends."""
        return min(self.match[k] + (k in self.open), stop)

    def text(self, k: int) -> str:
        return self.found[k][0] if k < self.n else ""

    def start(self, k: int) -> int:
        return self.found[k][1]

    def end(self, k: int) -> int:
        return self.found[min(k, self.n - 1)][2]

    def named(self, k: int) -> bool:
        return bool(NAME.match(self.text(k)))

    def past(self, k: int) -> int:
        """After token k, and all that it brackets."""
        return self.match[k] + 1 if self.text(k) in PAIRS else k + 1

    def angle(self, k: int, stop: int) -> int:
        """After <...> at k, if it is there."""
        if self.text(k) != "<":
            return k
        depth = 0
        while k < stop:
            t = self.text(k)
            depth += (t == "<") - (t == ">")
            k = self.past(k)
            if not depth:
                break
        return k

    def until(self, k: int, stop: int, *ends: str) -> int:
        """The first of ``ends`` outside brackets, or ``stop``; not past a bracket that nothing closes."""
        while k < stop and self.text(k) not in ends:
            if k in self.open:
                return min(self.match[k], stop)
            k = self.past(k)
        return min(k, stop)

    def parts(self, k: int, stop: int) -> Iterator[tuple[int, int]]:
        """Ranges between commas outside brackets and <...>."""
        first = k
        while k < stop:
            if self.text(k) == ",":
                yield first, k
                first = k = k + 1
            elif self.text(k) == "<":
                k = max(k + 1, self.angle(k, stop))
            else:
                k = self.past(k)
        if first < stop:
            yield first, stop


class Rust:
    """Items of Rust: functions are methods right inside impl or trait; bodies are not looked into."""

    def __init__(self, text: str):
        self.out: list[Symbol] = []
        self.t = Tokens(masked(text, RUST_HIDDEN, nests=True), lambda t, _: t in RUST_ITEMS)
        self.inner: tuple | None = None
        frames = [(0, self.t.n, (), False, False)]  # token, end, scope, whether functions are methods, whether a trait's
        while frames:
            k, stop, scope, typed, trait = frames.pop()
            while k < stop:
                k = max(k + 1, self.item(k, stop, scope, typed, trait))
                if self.inner:
                    frames += [(k, stop, scope, typed, trait), self.inner]
                    self.inner = None
                    break

    def push(self, scope: tuple[str, ...], name: int, kind: str, first: int, last: int) -> None:
        t = self.t
        self.out.append(((*scope, t.text(name)), kind, t.start(first), t.end(last), t.start(name), t.end(name)))

    def attributes(self, k: int, stop: int) -> int:
        t = self.t
        while k < stop and t.text(k) == "#" and (t.text(k + 1) == "[" or t.text(k + 1) == "!" and t.text(k + 2) == "["):
            k = t.past(k + 1 + (t.text(k + 1) == "!"))
        return k

    def visibility(self, k: int) -> int:
        t = self.t
        if t.text(k) == "pub":
            k += 1
            if t.text(k) == "(" and t.text(k + 1) in ("crate", "self", "super", "in"):
                k = t.past(k)
        return k

    def item(self, k: int, stop: int, scope: tuple[str, ...], typed: bool, trait: bool) -> int:
        """Reads an item at k, and gives the token after it; what it holds, to be read next, goes to ``inner``."""
        t = self.t
        k = self.attributes(k, stop)
        first, k = k, self.visibility(k)
        j = k
        while t.text(j) in ("const", "async", "unsafe", "extern", "default", "safe") and j < stop:
            j += 1
        word = t.text(j)
        if word == "fn" and t.named(j + 1):
            end = t.until(j + 2, stop, "{", ";")
            self.push(scope, j + 1, "method" if typed else "function", first, t.match[end] if t.text(end) == "{" else end)
            return t.past(end)
        if word in ("trait", "impl", "mod"):
            k = j
        word = t.text(k)
        if word in ("struct", "union") and t.named(k + 1):
            end = t.until(t.angle(k + 2, stop), stop, "{", ";", "(")
            if t.text(end) == "(":
                end = t.until(end, stop, ";")
            last = t.match[end] if t.text(end) == "{" else end
            self.push(scope, k + 1, "struct", first, last)
            if t.text(end) == "{":
                self.members(end, (*scope, t.text(k + 1)), "field")
            return last + 1
        if word == "enum" and t.named(k + 1):
            end = t.until(t.angle(k + 2, stop), stop, "{", ";")
            self.push(scope, k + 1, "enum", first, t.match[end] if t.text(end) == "{" else end)
            if t.text(end) == "{":
                self.members(end, (*scope, t.text(k + 1)), "variant")
            return t.past(end)
        if word in ("const", "static", "type"):
            name = k + 1 + (t.text(k + 1) == "mut")
            end = t.until(name, stop, ";")
            if t.named(name) and t.text(name) != "_" and not (word == "type" and trait):
                self.push(scope, name, word, first, end)
            return end + 1
        if word == "macro_rules" and t.text(k + 1) == "!" and t.named(k + 2):
            last = t.match[k + 3] if t.text(k + 3) in PAIRS else k + 3
            self.push(scope, k + 2, "macro", first, last)
            return last + 1
        if word in ("trait", "mod") and t.named(k + 1):
            end = t.until(t.angle(k + 2, stop), stop, "{", ";")
            self.push(scope, k + 1, "trait" if word == "trait" else "module", first, t.match[end] if t.text(end) == "{" else end)
            if t.text(end) == "{":
                self.inner = (end + 1, t.inside(end, stop), (*scope, t.text(k + 1)), word == "trait", word == "trait")
            return t.past(end)
        if word == "impl":
            end = t.until(t.angle(k + 1, stop), stop, "{", ";")
            if t.text(end) == "{":
                self.inner = (end + 1, t.inside(end, stop), (*scope, self.implemented(t.angle(k + 1, stop), end)), True, False)
            return t.past(end)
        if t.named(k) and t.text(k + 1) == "!":  # a macro's tokens are no items
            return t.past(k + 2)
        if word == "use":
            return t.until(k, stop, ";") + 1
        if word == "{" or word == "(" or word == "[":
            self.inner = (k + 1, t.inside(k, stop), scope, typed, trait)
            return t.past(k)
        return k + 1

    def implemented(self, k: int, stop: int) -> str:
        """The base name of an impl's type: after ``for`` if there, without generics and leading path."""
        t, at = self.t, k
        while at < stop:
            if t.text(at) == "for" and t.text(at + 1) != "<":
                k = at + 1
            if t.text(at) == "where":
                stop = at
                break
            at = max(at + 1, t.angle(at, stop)) if t.text(at) == "<" else t.past(at)
        words = []
        for j in range(k, stop):
            if t.text(j) == "<":
                break
            words.append(t.text(j))
        if not words:
            return "<impl>"
        while words and words[0] in ("dyn", "mut", "&", "*", "const"):  # written before the name
            if len(words) > 1:
                return " ".join(words).replace("& ", "&")
            words = words[1:]
        return "".join(words).rsplit("::", 1)[-1].strip() or "<impl>"

    def members(self, opening: int, scope: tuple[str, ...], kind: str) -> None:
        t = self.t
        for a, b in t.parts(opening + 1, t.inside(opening, t.n)):
            a = self.attributes(a, b)
            name = self.visibility(a)
            if name < b and t.named(name) and (kind == "variant" or t.text(name + 1) == ":"):
                self.push(scope, name, kind, a, b - 1)


TAGS = {"struct": "struct", "union": "struct", "enum": "enum"}
DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\r?\n|[^\n])*", re.MULTILINE)
DEFINE = re.compile(r"[ \t]*#[ \t]*define[ \t]+([^\W\d]\w*)")
# Words of C's grammar that never name a declared thing.
C_WORDS = set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Noreturn _Static_assert _Thread_local".split())


class C:
    """Definitions of C at file level, of both branches of conditionals, and inside extern "C" {}."""

    def __init__(self, text: str):
        self.out: list[Symbol] = []
        self.linkage: list[int] = []
        code = masked(text, C_HIDDEN, nests=False, keep=lambda s: s == '"C"' or s == '"C++"')
        self.code = code
        for m in DIRECTIVE.finditer(code):
            if d := DEFINE.match(m[0]):
                start = m.start() + len(m[0]) - len(m[0].lstrip(" \t"))
                self.out.append(((d[1],), "macro", start, m.end(), m.start() + d.start(1), m.start() + d.end(1)))
        self.t = Tokens(DIRECTIVE.sub(lambda m: blank(m[0]), code), lambda t, column: column == 0 and bool(NAME.match(t)) and t not in ("else", "default", "case"))
        self.declarations(0, self.t.n)
        self.out.sort(key=lambda s: (s[2], s[4]))

    def push(self, path: tuple[str, ...], kind: str, name: int, first: int, last: int) -> None:
        t = self.t
        self.out.append((path, kind, t.start(first), t.end(last), t.start(name), t.end(name)))

    def declarations(self, k: int, stop: int) -> None:
        t, ends = self.t, []  # what follows the extern "C" {} that are being read ends there
        while k < stop or ends:
            if k >= stop:
                k, stop = ends.pop()
                continue
            if t.text(k) == ";" or t.text(k) in CLOSERS:
                k += 1
                continue
            if t.named(k) and t.text(k) not in C_WORDS and t.text(k + 1) == "(" and self.stands_alone(k, stop):
                k = t.past(k + 1)
                continue
            if t.text(k) == "extern" and t.text(k + 1) == '"':
                k += 2
                while k < stop and t.text(k) != '"':
                    k += 1
                k += 1
                if t.text(k) == "{":
                    ends.append((t.past(k), stop))
                    k, stop = k + 1, t.inside(k, stop)
                continue
            k = max(k + 1, self.declaration(k, stop))

    def stands_alone(self, k: int, stop: int) -> bool:
        """Whether NAME(...) is a macro's call without a semicolon: a declaration begins on a line after it."""
        t = self.t
        after = t.past(k + 1)
        if after >= stop or k + 1 in t.open or not t.named(after):
            return False
        between = self.code[t.end(after - 1) : t.start(after)]
        # Parameters declared after the brackets, as in old C, end before a body that has no head of its own.
        end = t.until(after, stop, "{", ";")
        return "\n" in between and not (t.text(end) == ";" and t.text(end + 1) == "{")

    def declaration(self, first: int, stop: int) -> int:
        t, k = self.t, first
        typedef = static = False
        tagged = call = None
        while k < stop:
            word = t.text(k)
            typedef |= word == "typedef"
            static |= word == "static"
            if word in TAGS and call is None:
                name = k + 1 if t.named(k + 1) and t.text(k + 1) not in C_WORDS else None
                body = k + 2 if name else k + 1
                if t.text(body) == "{":
                    tagged = tagged or (word, name, body, k)
                    k = t.past(body)
                    if body in t.open:  # what follows is another declaration
                        break
                else:
                    k = body
                continue
            if word == ";":
                break
            if word == "=":
                k = t.until(k, stop, ";", ",")
                continue
            if word == "{":
                if call is not None:
                    self.function(first, k, call)
                    return t.past(k)
                return t.past(k)
            if k in t.open:
                return t.past(k)
            if word == "(" and call is None and k > first:
                call = k
            k = t.past(k)
        last = min(k, stop - 1)
        if tagged:
            word, name, body, at = tagged
            if name:
                self.push((t.text(name),), TAGS[word], name, at, t.match[body])
                self.members(word, t.text(name), body)
        if tagged and tagged[2] in t.open:
            return k
        self.declarators(first, k, last, typedef, static, tagged)
        return k + 1

    def function(self, first: int, body: int, call: int) -> None:
        t = self.t
        name = call - 1
        if t.text(call + 1) in ("*", "(") or not t.named(name) or t.text(name) in C_WORDS:
            inner = [j for j in range(call + 1, min(t.match[call], body)) if t.named(j) and t.text(j) not in C_WORDS]
            name = inner[0] if inner else name
        if t.named(name) and t.text(name) not in C_WORDS:
            self.push((t.text(name),), "function", name, first, t.match[body])

    def members(self, word: str, tag: str, body: int) -> None:
        t, k, stop = self.t, body + 1, self.t.inside(body, self.t.n)
        if word == "enum":
            for a, b in t.parts(k, stop):
                if t.named(a):
                    self.push((t.text(a),), "const", a, a, b - 1)
            return
        while k < stop:
            end = t.until(k, stop, ";")
            if k < end:
                start = k
                while k < end and t.text(k) in TAGS:  # a nested type is not looked into
                    k += 1 + t.named(k + 1)
                    if t.text(k) == "{":
                        k = t.past(k)
                for n, (a, b) in enumerate(t.parts(k, end)):
                    name = self.plain_name(a, b, typed=n == 0 and k == start)
                    if name is not None:
                        self.push((tag, t.text(name)), "field", name, start, end)
            k = end + 1

    def plain_name(self, a: int, b: int, typed: bool) -> int | None:
        """The name of a declarator made of *, a name and [...] only; ``typed``: a type stands before it."""
        t, names, k = self.t, [], a
        while k < b:
            word = t.text(k)
            if word in (":", "="):
                break
            if word == "(":
                return None
            if t.named(k) and word not in C_WORDS:
                names.append(k)
            k = t.past(k)
        if typed and len(names) == 1 and not any(t.text(j) in C_WORDS for j in range(a, names[0])):
            return None
        return names[-1] if names else None

    def declarators(self, first: int, end: int, last: int, typedef: bool, static: bool, tagged) -> None:
        t = self.t
        start = t.past(tagged[2]) if tagged else first
        for n, (a, b) in enumerate(t.parts(start, end)):
            stars = [j for j in range(a, b) if t.text(j) == "*"]
            opening = next((j for j in range(a, b) if t.text(j) == "("), None)
            if opening is None:
                reference = not tagged and any(t.text(j) in TAGS for j in range(a, b))
                name = self.plain_name(a, b, typed=n == 0 and not tagged)
                if reference and name is not None and t.text(name - 1) in TAGS:
                    name = None
            else:
                inner = [j for j in range(opening + 1, min(t.match[opening], b)) if t.named(j) and t.text(j) not in C_WORDS]
                pointer = t.text(opening + 1) == "*"
                before = opening - 1
                name = inner[0] if pointer and inner and typedef else before if not pointer and t.named(before) and before >= a else None
                if not typedef and (pointer or not any(s < opening for s in stars)):
                    name = None  # a prototype, or a function pointer
            if name is None or t.text(name) in C_WORDS:
                continue
            self.push((t.text(name),), "type" if typedef else "static" if static else "variable", name, first, last)


def symbols(path: str, text: str) -> list[Symbol]:
    """By the file's extension: rs, c or h; none for other files."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")
    if not ext[0]:
        return []
    if ext[2] == "rs":
        return Rust(text).out
    return C(text).out if ext[2] in ("c", "h") else []
