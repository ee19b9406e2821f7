"""A workspace derived from the fixture tables, by expressions that Spark and DuckDB both read.

The documents table holds no links or headings, so each document becomes a note with links whose
targets follow from its id; every part and supplier becomes a Rust or C source; a few frequent words of
the texts become glossary notes, as do all parts, some suppliers and the words of the benchmark. Links dangle by what they name: a stem, heading, key or symbol that
nothing has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
FACE = "\U0001f600"


def s(x: str) -> str:
    return f"cast({x} as varchar(20))"


def joined(*parts: str) -> str:
    return " || ".join(parts)


NOTE_PATH = f"'docs/' || source || '/d' || {s('doc_id')} || '.md'"
#: Up to the line of links; the text may have several lines.
NOTE_HEAD = joined(
    f"CASE WHEN doc_id % 3 = 0 THEN '---' || {NL} || 'title: [[fm' || {s('doc_id')} || ']]' || {NL} || '---' || {NL} ELSE '' END",
    f"'# Doc ' || {s('doc_id')} || {NL} || {NL} || text || {NL} || {NL} || '## Links' || {NL} || {NL}",
)
#: What links of a note ask for, in their order; three on one line, two on the next but one.
LINKS = (
    f"'docs/src' || {s('(doc_id + 1) % 20')} || '/d' || {s('doc_id + 1')} || '.md'",
    f"'d' || {s('(doc_id * 7) % 1200')}",
    f"'docs/src' || {s('doc_id % 20')} || '/d' || {s('doc_id')} || '.md#' || CASE WHEN doc_id % 2 = 0 THEN 'Links' ELSE 'Gone' END",
    f"'src/p' || {s('doc_id % 300')} || '.rs@' || CASE doc_id % 9 WHEN 6 THEN 'K::A' WHEN 7 THEN 'm::g' WHEN 8 THEN 'P::n' ELSE 'T::f' || {s('doc_id % 5')} END",
    f"'csrc/s' || {s('doc_id % 12')} || '.c@S' || {s('doc_id % 12')} || '::a'",
)
#: Text before each link on its line; the face takes two UTF-16 units.
BEFORE = (
    f"CASE WHEN doc_id % 2 = 0 THEN '{FACE} See ' ELSE 'See ' END",
    "' and '",
    "' and '",
    "'Code '",
    "' and '",
)
linked = lambda k: f"{BEFORE[k]} || '[[' || {LINKS[k]} || ']]'"
NOTE_TEXT = joined(
    NOTE_HEAD,
    f"{joined(linked(0), linked(1), linked(2))} || '.' || {NL} || {NL}",
    f"{joined(linked(3), linked(4))} || '.' || {NL}",
    f"'At {FACE} the end, item' || {s('doc_id % 500')} || '.' || {NL}",
    f"CASE WHEN doc_id % 4 = 0 THEN '```' || {NL} || '[[decoy' || {s('doc_id')} || ']]' || {NL} || '```' || {NL} ELSE '' END",
    f"CASE WHEN doc_id % 5 = 0 THEN {NL} || '## Links' || {NL} ELSE '' END",
)
#: Lines of a note before that of its first three links.
FIRST_LINE = f"cast(length({NOTE_HEAD}) - length(replace({NOTE_HEAD}, {NL}, '')) as int)"
SHORT_PATH = f"'notes/d' || {s('doc_id')} || '.md'"
SHORT_TEXT = f"'# Note ' || {s('doc_id')} || {NL}"

RUST_LINES = """struct T {
    a: u8,
    b: Vec<u8>,
}
impl T {
    fn f0(&self) {}
    fn f1(&self) {}
    fn f2(&self) {}
    fn f3(&self) {}
}
enum K {
    A,
    B(u8),
}
trait R {
    fn t(&self);
    fn u(&self) {}
}
mod m {
    fn g() {}
    struct I(u8);
}
const C: u8 = 1;
static S: u8 = 2;
type N = u8;
macro_rules! q {
    () => {};
}
impl<X> P<X> {
    fn n() {}
}
fn top() {
    fn inner() {}
}"""
#: The symbols of those lines by the rules of the language: qualified name, kind, first line and column, last
#: line and end column, line and column of the name.
RUST_SYMBOLS = [
    ("T", "struct", 0, 0, 3, 1, 0, 7), ("T::a", "field", 1, 4, 1, 9, 1, 4), ("T::b", "field", 2, 4, 2, 14, 2, 4),
    *((f"T::f{k}", "method", 5 + k, 4, 5 + k, 19, 5 + k, 7) for k in range(4)),
    ("K", "enum", 10, 0, 13, 1, 10, 5), ("K::A", "variant", 11, 4, 11, 5, 11, 4), ("K::B", "variant", 12, 4, 12, 9, 12, 4),
    ("R", "trait", 14, 0, 17, 1, 14, 6), ("R::t", "method", 15, 4, 15, 16, 15, 7), ("R::u", "method", 16, 4, 16, 18, 16, 7),
    ("m", "module", 18, 0, 21, 1, 18, 4), ("m::g", "function", 19, 4, 19, 13, 19, 7), ("m::I", "struct", 20, 4, 20, 17, 20, 11),
    ("C", "const", 22, 0, 22, 16, 22, 6), ("S", "static", 23, 0, 23, 17, 23, 7), ("N", "type", 24, 0, 24, 12, 24, 5),
    ("q", "macro", 25, 0, 27, 1, 25, 13), ("P::n", "method", 29, 4, 29, 13, 29, 7), ("top", "function", 31, 0, 33, 1, 31, 3),
]
#: Every tenth source has a second T::f0.
RUST_AGAIN = ("T::f0", "method", 35, 4, 35, 19, 35, 7)
C_LINES = """#define M@ 1
#define F@(x) (x)
struct S@ {
    int a;
    char *b;
};
union U@ {
    int u;
};
typedef struct S@ Alias@;
enum E@ {
    RED@,
    BLUE@
};
static int g@;
int h@;
int proto@(void);
char *find@(void);
extern "C" {
int fn@(int x) {
    return x;
}
}
#ifdef X
int cond@(void) { return 1; }
#endif"""
#: As above; @ is the key, and a tuple (n, k) a column n plus k times the key's length.
C_SYMBOLS = [
    ("M@", "macro", 0, 0, 0, (11, 1), 0, 8), ("F@", "macro", 1, 0, 1, (16, 1), 1, 8),
    ("S@", "struct", 2, 0, 5, 1, 2, 7), ("S@::a", "field", 3, 4, 3, 10, 3, 8), ("S@::b", "field", 4, 4, 4, 12, 4, 10),
    ("U@", "struct", 6, 0, 8, 1, 6, 6), ("U@::u", "field", 7, 4, 7, 10, 7, 8), ("Alias@", "type", 9, 0, 9, (23, 2), 9, (17, 1)),
    ("E@", "enum", 10, 0, 13, 1, 10, 5), ("RED@", "const", 11, 4, 11, (7, 1), 11, 4), ("BLUE@", "const", 12, 4, 12, (8, 1), 12, 4),
    ("g@", "static", 14, 0, 14, (13, 1), 14, 11), ("h@", "variable", 15, 0, 15, (6, 1), 15, 4), ("find@", "variable", 17, 0, 17, (17, 1), 17, 6),
    ("fn@", "function", 19, 0, 21, 1, 19, 4), ("cond@", "function", 24, 0, 24, (28, 1), 24, 4),
]
RUST_PATH = f"'src/p' || {s('p_partkey')} || '.rs'"
C_PATH = f"'csrc/s' || {s('s_suppkey')} || '.c'"


def written(lines: str, key: str) -> str:
    """An expression for lines that hold a key at each @."""
    return joined(*(f"'{line}'".replace("@", f"' || {s(key)} || '") + f" || {NL}" for line in lines.split("\n")))


RUST_TEXT = f"{written(RUST_LINES, 'p_partkey')} || CASE WHEN p_partkey % 10 = 0 THEN 'impl Clone for T {{' || {NL} || '    fn f0(&self) {{}}' || {NL} || '}}' || {NL} ELSE '' END"
C_TEXT = written(C_LINES, "s_suppkey")

#: path, text. The longest term begins like a shorter one; one term has two notes.
GLOSSARY = [
    ("glossary/the.md", "# The article\n\nIt comes before nouns.\n"),
    ("glossary/the of.md", "\n\nTwo words in a row.\n"),
    ("glossary/der.md", "---\nkind: word\n---\n## German article\n"),
    ("glossary/que.md", "French que.\n"),
    ("glossary/de.md", "Of, in French and Spanish.\n"),
    ("glossary/sub/the.md", "# The article again\n"),
]
#: Selects of path and content for each part of the workspace; both engines run them as they are.
PARTS = {
    "notes": f"SELECT {NOTE_PATH} AS path, {NOTE_TEXT} AS content FROM documents",
    "short_notes": f"SELECT {SHORT_PATH} AS path, {SHORT_TEXT} AS content FROM documents WHERE doc_id % 20 = 0",
    "rust": f"SELECT {RUST_PATH} AS path, {RUST_TEXT} AS content FROM part",
    "c": f"SELECT {C_PATH} AS path, {C_TEXT} AS content FROM supplier",
}
#: Glossary notes: of every part, again of every third supplier's number, and of the longer words of the benchmark.
ITEMS = f"SELECT 'glossary/items/item' || {s('p_partkey')} || '.md' AS path, '# Item ' || {s('p_partkey')} || ': ' || p_name || {NL} AS content FROM part"
AGAIN = f"SELECT 'glossary/more/item' || {s('s_suppkey')} || '.md' AS path, {NL} || 'Supplied by ' || s_name || ', again.' || {NL} AS content FROM supplier WHERE s_suppkey % 3 = 0"
#: By the words' expression, in which alone the engines differ.
WORDS = f"SELECT 'glossary/words/' || w || '.md' AS path, '## ' || w || {NL} || 'A word of the benchmark.' || {NL} AS content FROM (SELECT DISTINCT {{}} AS w FROM benchmark) AS b"
PARTS |= {"items": ITEMS, "again": AGAIN, "words": WORDS.format("explode(regexp_extract_all(text, '(?<![A-Za-z0-9_])[a-z]{5,}(?![A-Za-z0-9_])', 0))")}
_units = lambda x: f"cast(length({x}) + CASE WHEN contains({x}, '{FACE}') THEN 1 ELSE 0 END as int)"
_line = lambda k: [linked(j) for j in (range(k) if k < 3 else range(3, k))]
#: path, ordinal, line, and columns of each link: in code points and in UTF-16 units.
LINK_PLACES = " UNION ALL ".join(
    f"SELECT {NOTE_PATH} AS path, {k} AS ordinal, {FIRST_LINE} + {0 if k < 3 else 2} AS line, cast(length({before}) as int) AS start_char, cast(length({after}) as int) AS end_char, {_units(before)} AS start_utf16, {_units(after)} AS end_utf16 FROM documents"
    for k in range(5)
    for before, after in [(joined(*_line(k), BEFORE[k]), joined(*_line(k), linked(k)))]
)
#: Places of a note that lookups ask for: in each link, at the end of one (outside), before them, and in a term.
PLACES = (
    f"SELECT path, line, start_utf16 + 3 AS \"character\" FROM ({LINK_PLACES}) UNION ALL SELECT path, line, end_utf16 FROM ({LINK_PLACES}) WHERE ordinal = 0"
    f" UNION ALL SELECT {NOTE_PATH}, {FIRST_LINE}, 0 FROM documents UNION ALL SELECT {NOTE_PATH}, {FIRST_LINE} + 3, 7 FROM documents"
)
#: Open buffers: every tenth note is being rewritten.
BUFFER_TEXT = f"'# Open' || {NL} || '[[nowhere]] [[' || {LINKS[0]} || ']]' || {NL}"
BUFFERS = f"SELECT {NOTE_PATH} AS path, {BUFFER_TEXT} AS text FROM documents WHERE doc_id % 10 = 0"
#: Two looks at the folder of notes: some come, some go, and of those that stay every eleventh is longer, every thirteenth newer.
LISTINGS = (
    f"SELECT {NOTE_PATH} AS path, cast(doc_id as bigint) AS modified, cast(n_chars as bigint) AS size FROM documents WHERE doc_id % 7 <> 0",
    f"SELECT {NOTE_PATH} AS path, cast(doc_id + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END as bigint) AS modified, cast(n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END as bigint) AS size FROM documents WHERE doc_id % 5 <> 0",
)
ROOT_URI = "file:///work/notes"


def select(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Rows of a query over the fixture tables."""
    for t in ("documents", "part", "supplier", "benchmark"):
        if f"FROM {t}" in query:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if t in ("part", "supplier"):  # a few bytes that become a source each, so a task's share of the table is too many of them
                rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
            rows.createOrReplaceTempView(f"derived_{t}")
            query = query.replace(f"FROM {t}", f"FROM derived_{t}")
    return spark.sql(query.replace('"character"', "`character`"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of every file of the workspace."""
    every = spark.createDataFrame(GLOSSARY, "path string, content string")
    for query in PARTS.values():
        every = every.unionByName(select(spark, sf_dir, query))
    return every


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, PLACES)


def buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, BUFFERS)
