"""Encoding of texts with a public byte-level BPE vocabulary.

The vocabulary file (ranks of byte strings) is written out as a sentencepiece BPE model: bytes become the printable
characters of the usual byte mapping, pieces are scored by negative rank, normalisation is the identity. Texts are cut
into pre-tokens, each pre-token is encoded by the model, and ids are the ranks. Pre-tokens repeat a lot, so each task
encodes a different one once. Nothing is trained and no vocabulary is part of this repository: its path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a task remembers at once.
REMEMBERED = 500_000


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it is one, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if plain else free))
        free += not plain
    return out


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(text)) for text, rank in (line.split() for line in lines if line.strip())]
    return [text for _, text in sorted(pairs)]


def model_bytes(ranks: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the id after the last is the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    letters = byte_characters()
    model = proto.ModelProto()
    for rank, text in enumerate(ranks):
        model.pieces.add(piece="".join(letters[b] for b in text), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = proto.TrainerSpec.BPE, len(model.pieces), len(ranks)
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.pieces))
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_characters()
        self.known: dict[str, list[int]] = {}

    def learn(self, pretokens: list[str]) -> None:
        """Encode the pre-tokens that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(pretokens).difference(self.known))
        if new:
            mapped = ["".join(map(self.letters.__getitem__, x.encode("utf-8", "surrogatepass"))) for x in new]
            self.known.update(zip(new, self.model.encode(mapped, num_threads=1)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null text."""
        pretokens = self.split(text) if text else []
        self.learn(pretokens)
        return list(chain.from_iterable(map(self.known.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row a document, whole texts; null and empty texts have an empty list. A narrow map, no shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            lists = [np.array(enc.encode(x), dtype=np.int32) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """keep and `tokens`, the number of ids of each text; 0 for null and empty texts."""
    schema = documents.select(*keep, F.lit(0).cast("long").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [len(enc.encode(x)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    return documents.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the inverse of encode_texts, by the pieces' bytes."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")
