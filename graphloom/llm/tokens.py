"""Token ids as range-coded blocks: write every document's ids in order, read the files back.

``encode`` tokenizes whole texts, appends the end id, and writes three Parquet tables under one
path: ``freqs`` (the shared frequency table), ``shards`` (ids before each shard) and ``blocks``
(coded blocks of whole documents, see :mod:`graphloom.llm.rans`). ``decode`` reads them back.

Documents are in ascending doc_id order: null ids first, rows of one id by text hash, then text.
A null or empty text has the end id only. Repeated rows are coded each. An empty table gives an
empty file set. Other columns of the input are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, rans

TOKENIZER = "word_bpe_49k.json"
#: Ids of a block: a block closes with the document that reaches this.
BLOCK_IDS = 1 << 19
#: Pieces that a task keeps in each of two generations (under 50 MB each), and the longest that it keeps.
CACHE_WORDS = 300_000
CACHE_CHARS = 64
#: Pieces that are looked up together.
TOGETHER = 1 << 17
#: Letters that are composed, and have one lower case each.
PLAIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
LOW_WORD = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
MARKS = ".,;:!?#*$%&"
#: Texts of other characters than these are lower-cased piece by piece, where that is sure.
OTHER = re.compile("[^\t-\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: Python and the tokenizer differ about these being white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


class WordIds(dict):
    """Ids of white-space separated pieces, as bytes. The tokenizer never joins across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = {"<u2": "H", "<u4": "I"}[self.kind]
        self.wide = array(self.code).itemsize
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = splits_words_from_marks(self)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.piece(piece) if self.plain else self.whole(piece)
            if len(piece) > CACHE_CHARS:
                return found
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def forget(self) -> None:
        """Between tasks a Python worker keeps no pieces: idle ones would hold them through later stages."""
        self.clear()
        self.older = {}
        pa.default_memory_pool().release_unused()

    def piece(self, piece: str) -> bytes:
        """Words are looked up in lower case and apart from marks, so few reach the tokenizer."""
        word = piece.rstrip(MARKS)
        if not PLAIN_WORD.fullmatch(word):
            return self.whole(piece)
        low = word.lower()
        if low == piece:
            return self.of_model(low)
        return self[low] if word == piece else self[low] + self[piece[len(word) :]]

    def of_model(self, low: str) -> bytes:
        symbols = low if low.isascii() else codecs.charmap_decode(low.encode(), "strict", SYMBOLS)[0]
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def of(self, text: str) -> bytes:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Of all pieces those that differ are looked up, once for many texts."""
        spaced = [self.spaced(text) for text in texts]
        pieces = pc.ascii_split_whitespace(pa.array([x or "" for x in spaced], pa.large_string()))
        each, ids, sizes = pieces.flatten(), [], [np.zeros(1, np.int64)]
        for start in range(0, len(each), TOGETHER):
            part = each.slice(start, TOGETHER).dictionary_encode()
            found = self.of_pieces(part.dictionary)
            size = np.fromiter(map(len, found), np.int64, len(found)) // self.wide
            which = part.indices.to_numpy()
            n = size[which]
            at = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            ids.append(np.frombuffer(b"".join(found), self.kind)[at].tobytes())
            sizes.append(n)
        ends = (self.wide * np.cumsum(np.concatenate(sizes))[pieces.offsets.to_numpy()]).tolist()
        every = b"".join(ids)
        return [every[a:b] if x is not None else self.whole(text) for a, b, x, text in zip(ends[:-1], ends[1:], spaced, texts, strict=True)]

    def of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of each piece; plain words are parted from marks first, so fewer are looked up and kept."""
        if not self.plain:
            return list(map(self.__getitem__, strings(pieces)))
        words = pc.utf8_rtrim(pieces, MARKS)
        words = pc.if_else(pc.match_substring_regex(words, LOW_WORD), words, pieces).dictionary_encode()
        each = list(map(self.__getitem__, strings(words.dictionary)))
        found = [each[k] for k in words.indices.to_numpy().tolist()]
        marks = pc.subtract(pc.binary_length(pieces), pc.take(pc.binary_length(words.dictionary), words.indices)).to_numpy()
        marked = np.flatnonzero(marks)
        for k, piece, n in zip(marked.tolist(), strings(pieces.take(pa.array(marked))), marks[marked].tolist(), strict=True):
            found[k] += self[piece[-n:]]
        return found

    def spaced(self, text: str) -> str | None:
        """A text of the same ids that falls into pieces at ASCII white space, if that is sure."""
        if self.plain and not OTHER.search(text):
            low = text.lower()
            return text if any(s in low for s in self.special) else low
        return None if ODD_SPACE.search(text) else " ".join(text.split())


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write a byte that is no visible Latin-1 character as one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SYMBOLS = byte_symbols()
#: The same for every byte.
SYMBOLS = "".join(BYTE_SYMBOLS.get(b, chr(b)) for b in range(256))


def splits_words_from_marks(coder: WordIds) -> bool:
    """Whether this tokenizer gives plain words in lower case to its model, apart from marks, and lower-cases all else."""
    probes = ("Quarks", "Çà", "straßen", "Élèves", "a", "ÿ")
    odd = ("BY-NC's 4X", "(\"ÀÞ\")='RE_Z'", "X9.Y@Éa.DE|#ID")
    try:
        each = all(coder.of_model(w.lower()) == coder.whole(w) for w in probes)
        each = each and all(coder.whole(x) == coder.whole(x.lower()) for x in odd)
        return each and all(coder.whole(w + m) == coder.whole(w) + coder.whole(m) for w in (*probes, "4", "x9") for m in (".", ",", "###", "***", "!!?"))
    except Exception:  # another kind of tokenizer, whose model does not take these symbols
        return False


_CODERS: dict[str, WordIds] = {}


def tokenizer_file(name: str) -> str:
    """The file itself where ``name`` is one here, else that of the tokenizers installed on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ids(name: str) -> WordIds:
    """The coder of this process; each machine finds the file for itself."""
    if name not in _CODERS:
        _CODERS[name] = WordIds(tokenizer_file(name))
    return _CODERS[name]


def _tokenize(name: str, end_id: int, block_ids: int):
    def run(batches):
        coder, shard, number = word_ids(name), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.kind).tobytes()
        docs, lengths, parts, total, before = [], [], [], 0, 0

        def block():
            arrays = [[shard], [number], [before], [total], [docs], [lengths], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], ["shard", "block", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.of_all([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                docs.append(doc)
                lengths.append(len(ids) // coder.wide + 1)
                parts += (ids, end)
                total += lengths[-1]
                if total >= block_ids:
                    yield block()
                    number += 1
                    before += total
                    docs, lengths, parts, total = [], [], [], 0
        if docs:
            yield block()
        coder.forget()

    return run


def _count(kind: str):
    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                more = np.bincount(np.frombuffer(payload.as_buffer(), kind))
                if len(more) > len(counts):
                    counts, more = more.astype(np.int64), counts
                counts[: len(more)] += more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["token", "n"])

    return run


def _recode(change):
    """Replace each block's payload."""

    def run(batches):
        for batch in batches:
            payload = [change(x) for x in batch.column("payload")]
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(payload, pa.binary()))

    return run


def encode(docs: DataFrame, tokenizer: str, path: str, end_id: int, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of ``docs`` (doc_id, text) under ``path``; ``tokenizer`` names a tokenizers file."""
    spark = docs.sparkSession
    rows = common.to_python(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("h", F.xxhash64("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    raw = common.materialize(dealt.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, end_id, block_ids), BLOCKS), "token-ids")
    kind = word_ids(tokenizer).kind

    counted = raw.select("payload").mapInArrow(_count(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # a row for each id of the vocabulary at most
    counts = np.zeros(int(found.token.max()) + 1 if len(found) else 1, np.int64)
    counts[found.token.to_numpy(dtype=np.int64)] = found.n.to_numpy()
    freqs = rans.normalize(counts)
    # From Arrow: lists would start Python workers of their own, which stay.
    seen = np.flatnonzero(freqs)
    table = spark.createDataFrame(pa.table({"token": pa.array(seen, pa.int64()), "freq": pa.array(freqs[seen], pa.int64())}))
    table.coalesce(1).write.parquet(f"{path}/freqs")

    model = rans.Model(freqs)
    raw.mapInArrow(_recode(lambda x: model.encode(np.frombuffer(x.as_buffer(), kind))), BLOCKS).write.parquet(f"{path}/blocks")
    sums = sorted(raw.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row for each writing task
    base, starts = 0, []
    for row in sums:
        starts.append((row.shard, base))
        base += row.n
    shards = pa.table([pa.array([x[k] for x in starts], kind) for k, kind in enumerate((pa.int32(), pa.int64()))], ["shard", "base"])
    spark.createDataFrame(shards).coalesce(1).write.parquet(f"{path}/shards")
    common.discard(raw)
    return path


def _documents(freqs: np.ndarray, base: dict[int, int], want_ids: bool):
    def run(batches):
        model = rans.Model(freqs)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "block", "before", "doc_ids", "lengths")]
            for shard, block, before, docs, lengths, payload in zip(*cols, batch.column("payload"), strict=True):
                ids = model.decode(payload.as_buffer()).astype("<u4")
                ends = np.cumsum(lengths)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise rans.CorruptBlock(f"block {block} of shard {shard} has another length")
                starts = base[shard] + before + ends - np.array(lengths)
                each = [ids[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                out = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if want_ids:
                    out.append(pa.array(each, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def decode(spark: SparkSession, path: str, want_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    table = spark.read.schema("token long, freq long").parquet(f"{path}/freqs").toPandas()
    freqs = np.zeros(int(table.token.max()) + 1, np.int64)
    freqs[table.token.to_numpy()] = table.freq.to_numpy()
    base = {r.shard: r.base for r in spark.read.schema("shard int, base long").parquet(f"{path}/shards").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * want_ids
    return blocks.select("shard", "block", "before", "doc_ids", "lengths", "payload").mapInArrow(_documents(freqs, base, want_ids), schema)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` to the shared folder and return what the files say of each document."""
    spark = docs.sparkSession
    return decode(spark, encode(docs, tokenizer, common.scratch_path(spark, "tokens"), end_id))
