"""Language identification by compression with one raw-content dictionary for each language.

Training texts of a language, joined up to ``dictionary_bytes``, become a zstandard raw-content
dictionary (in lower case, words only). A text is coded likewise, in pieces of ``piece_bytes`` with every
dictionary; the smallest sum of sizes names the language. The margin is 1 - smallest / second smallest; below ``least_margin`` the
operator rejects (``accepted`` is false) but still names its best guess.

Training is bounded (see Settings): of each language about ``sample_rows`` rows, drawn by id hash, and
of each drawn text a piece, at a place its hash gives, not the whole of it. Predictions code whole texts.

A text that is null or has no letter gets ``und``, margin and score 0; so does every text if no
language was learned. Rows are judged one by one; equal sizes go to the first language by name.
Other columns of the input are ignored by the models and passed on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

OTHER = re.compile(r"[\W\d_]+")
SCHEMA = "lang_pred string, score double, margin double, accepted boolean"
NAMES = ["lang_pred", "score", "margin", "accepted"]


def plain(text: str) -> bytes:
    """Lower-case words with single spaces: shouting, marks and tables say nothing of the language."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class Settings:
    dictionary_bytes: int = 96_000
    piece_bytes: int = 24_000
    #: Of held-out texts of sf0.1, 0.980 are right at level 3, 0.992 at 6 and at 9.
    level: int = 6
    least_margin: float = 0.02
    #: A margin of this or more scores 1.
    sure_margin: float = 0.1
    #: Bound on the training rows of a language, and on the characters of each that come to the driver.
    sample_rows: int = 400
    sample_chars: int = 20_000
    #: Languages that are learned at most, those with most rows: dirty labels are no languages.
    most_langs: int = 500


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def piece(data: bytes, size: int) -> bytes:
    """``size`` bytes of ``data`` at a place that its hash gives; all where there are no more."""
    at = zlib.crc32(data) % max(1, len(data) - size + 1)
    return data[at : at + size]


def train(rows: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """A dictionary for each lang of ``rows`` (doc_id, text, lang), from a bounded sample drawn by a hash of id and text.

    How many texts a language has decides the share that is drawn, and ``sample_rows`` of each come to the
    driver at most, however many there are and whatever their ids; copies are drawn once. A text longer than ``sample_chars`` gives a piece of that
    many at a hashed place. Each text drawn gives the dictionary an equal piece, again at a hashed place
    (whole texts where they are shorter), so openings that texts share do not fill it.
    """
    place = F.floor(common.uniform("text") * F.greatest(F.length("text") - settings.sample_chars + 1, F.lit(1))).cast("int") + 1
    usable = rows.select(F.substr("text", place, F.lit(settings.sample_chars)).alias("text"), "lang", common.uniform("doc_id", "text").alias("u")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    found = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.most_langs).collect()}
    if not found:
        return {}
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, settings.sample_rows / n)) for lang, n in found.items()], "lang string, share double")
    texts: dict[str, list[tuple[float, str]]] = {lang: [] for lang in found}
    drawn = usable.join(F.broadcast(shares), "lang").filter(F.col("u") <= F.col("share")).dropDuplicates(["lang", "u"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))  # about sample_rows rows of each
    for r in drawn.withColumn("k", place).filter(F.col("k") <= settings.sample_rows).select("text", "lang", "u").toLocalIterator():
        texts[r.lang].append((r.u, r.text))
    out = {}
    for lang, own in texts.items():
        own = sorted(set(own))
        if own:
            fair = max(200, settings.dictionary_bytes // len(own) + 1)  # so that no one text fills it
            out[lang] = b" ".join(piece(plain(t), fair) for _, t in own)[: settings.dictionary_bytes]
    return {k: v for k, v in out.items() if len(v) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings, self.coders = settings, []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=settings.level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=settings.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.coders or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, False
        data, step = plain(text), self.settings.piece_bytes
        pieces = [data[k : k + step] for k in range(0, len(data), step)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.coders)
        margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], min(1.0, margin / self.settings.sure_margin), margin, margin >= self.settings.least_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """``docs`` (text and others that are passed on) with the columns of SCHEMA."""
    mine = [c for c in docs.columns if c.lower() not in NAMES and c.lower() != "text"]

    def run(batches):
        classify = Classifier(dictionaries, settings)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in mine), *columns], [*mine, *NAMES])

    kept = docs.select(*[F.col(f"`{c}`") for c in mine], "text")
    return common.to_python(kept).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"), SCHEMA]))
