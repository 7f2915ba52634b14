"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has the whitespace marker behind another character, so merges never cross from one marked
word (a run of markers and what follows it) to the next. Each distinct marked word is therefore segmented once, in a
table that each task keeps, and the ids of a text are those of its words joined in order. The table holds at most
`max_entries` words and those of one batch; a full one is emptied, which costs time but changes no result. An entry is
two strings, the word and its ids; decoded texts are kept only of words that don't decode to themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, table

MARK = "▁"
#: Marked words have spaces for markers, which takes a byte a character in most scripts' words.
CHUNK = re.compile(" +[^ ]*")
MAX_ENTRIES = 300_000
#: Words longer than this are segmented anew each time, so that the table's size in bytes is bounded as well.
MAX_KEPT_CHARS = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Segmentations of distinct marked words: ids as text, and decoded texts that differ from the word."""

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_entries = max_entries
        self.known: dict[str, str] = {}
        self.altered: dict[str, str] = {}
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers")
        probe = "a  b "
        if self.model.decode(self.model.encode(probe)) != probe or self.model.encode(probe) != self.model.encode("a") + [i for w in ("  b", " ") for i in self._direct(w)]:
            raise ValueError("the model's normaliser changes white space")

    def _direct(self, word: str) -> list[int]:
        """word has spaces for markers and at least one in front; the library adds one marker itself."""
        return self.model.encode(word[1:]) if len(word) > 1 else [self.model.piece_to_id(MARK)]

    def add(self, words: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Segments words that the table lacks, all in one call; returns ids and altered texts of those too long to keep."""
        new = list(words)
        lone = self.model.piece_to_id(MARK)
        ids = [x or [lone] for x in self.model.encode([w[1:] for w in new], num_threads=1)]
        # decode() strips one leading space, so a marker goes in front
        texts = self.model.decode([[lone, *x] for x in ids], num_threads=1)
        passing: tuple[dict[str, str], dict[str, str]] = {}, {}
        for w, x, t in zip(new, ids, texts, strict=True):
            known, altered = (self.known, self.altered) if len(w) <= MAX_KEPT_CHARS else passing
            known[w] = ",".join(map(str, x))
            if t != w:
                altered[w] = t
        return passing

    def segmented(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids joined by commas and its decoded text, which has a marker's space in front."""
        split = [self.split(t) for t in texts]
        known, altered = self.known, self.altered
        if len(known) > self.max_entries:
            known.clear()
            altered.clear()
        long, long_altered = self.add(missing) if (missing := {w for words in split for w in words if w not in known}) else ({}, {})
        out = []
        for words in split:
            ids = ",".join([known[w] if w in known else long[w] for w in words] if long else [known[w] for w in words])
            if not altered.keys().isdisjoint(words) or not long_altered.keys().isdisjoint(words):
                words = [altered[w] if w in altered else long_altered.get(w, w) for w in words]
            out.append((ids, "".join(words)))
        return out

    def split(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in self.segmented(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids joined by commas, decoded text."""
        return [(ids.count(",") + 1 if ids else 0, ids, decoded.removeprefix(" ")) for ids, decoded in self.segmented(texts)]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text: (doc_id, ids array<int>, decoded string).

    Null and empty texts give no ids and an empty decoded text. Rows that repeat, whole or in their id, each give a row.
    """
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = known.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([x[2] for x in known.digests(texts)], pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without building the ids as arrays; else as encode()."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = known.digests(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
