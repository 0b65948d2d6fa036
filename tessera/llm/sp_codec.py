"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The ranks of a byte-level BPE vocabulary are written as a sentencepiece BPE model: each piece is
the token's bytes mapped to one printable character a byte, its score is the negative rank, and
normalisation is the identity. Sentencepiece then merges the adjacent pair of the highest score,
leftmost first, which is the lowest-rank rule of the vocabulary's own library. A pre-token that is
itself in the vocabulary is that one token, as in that library.

Null text is encoded as empty text. Any other columns are left alone; the result has only the
columns named below. One row comes out for each row in, repeated rows included.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import steps

UNKNOWN = "⁇"
#: A space beside other white space.
TOUCHING = re.compile(r" \s|[^\S ] ")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file (base64 token, rank); read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where Latin-1 prints it, else one after U+00FF."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of `ranks`; the piece of rank r has id r + 1, id 0 is unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0 to n-1")
    letters = byte_letters()
    model = pb.ModelProto()
    model.pieces.add(piece=UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(order):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type = pb.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = 0, -1, -1, -1
    trainer.unk_piece = UNKNOWN
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    made = model.SerializeToString()
    _check(made, order, letters)
    return made


def _check(model: bytes, order: list[bytes], letters: list[str]) -> None:
    """A pre-token in the vocabulary is one token; merging must lead to it, or ids would differ."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    coded = processor.encode(["".join(letters[b] for b in token) for token in order], num_threads=1)
    lost = [rank for rank, ids in enumerate(coded) if ids != [rank + 1]]
    if lost:
        raise ValueError(f"merges do not reach {len(lost)} tokens of the vocabulary, first {lost[0]}")


class Codec:
    """One worker's encoder and decoder.

    A text in which no space touches other white space is cut at its spaces: no pre-token crosses
    such a cut, so a piece's pre-tokens do not depend on its neighbours. Pieces, with or without
    their space, are looked up in bounded caches of (ids in decimal, decoded bytes); any other text
    is cut by the pattern itself. Pre-tokens that the caches miss are encoded in one call a step.
    """

    def __init__(self, model: bytes, pattern: str, cache_size: int = 250_000):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        byte = {ord(x): b for b, x in enumerate(letters)}
        self.letters = dict(enumerate(letters))
        n = self.processor.get_piece_size() - 1
        self.bytes = [bytes(map(byte.__getitem__, map(ord, self.processor.id_to_piece(i + 1)))) for i in range(n)]
        self.digits = [""] + [str(i) for i in range(n)]
        self.spaced: dict[str, tuple[str, bytes]] = {}
        self.plain: dict[str, tuple[str, bytes]] = {}
        self.cache_size = cache_size

    def _mapped(self, word: str) -> str:
        """The word's bytes as the model's letters; printable ASCII other than the space is its own."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.letters[32])
        return word.encode().decode("latin-1").translate(self.letters)

    def _coded(self, words: list[str]) -> list[tuple[str, bytes]]:
        digits, table = self.digits, self.bytes
        coded = self.processor.encode([self._mapped(w) for w in words], num_threads=1)
        return [(" ".join([digits[i] for i in ids]), b"".join([table[i - 1] for i in ids])) for ids in coded]

    def _learn(self, cache: dict, wanted: set[str], spaced: bool) -> None:
        missing = wanted.difference(cache)
        if not missing:
            return
        if len(cache) + len(missing) > self.cache_size:
            cache.clear()
            missing = wanted
        # a piece of letters, or a match of the pattern, is one pre-token
        single = [key for key in missing if not spaced or key.isalpha()]
        cache.update(zip(single, self._coded([" " + key for key in single] if spaced else single), strict=True))
        if spaced and len(single) < len(missing):
            words = {key: self.split(" " + key) for key in missing if not key.isalpha()}
            flat = list(dict.fromkeys(chain.from_iterable(words.values())))
            known = dict(zip(flat, self._coded(flat), strict=True))
            for key, parts in words.items():
                found = [known[w] for w in parts]
                cache[key] = (" ".join([x for x, _ in found]), b"".join([x for _, x in found]))

    def code(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each whole text its ids in decimal, joined by spaces, and the bytes they decode to."""
        cuts = []
        for text in texts:
            if text.endswith(" ") or TOUCHING.search(text):
                cuts.append((self.split(text), []))
            else:
                first, *rest = text.split(" ")
                cuts.append((self.split(first), rest))
        self._learn(self.plain, set(chain.from_iterable(x for x, _ in cuts)), False)
        self._learn(self.spaced, set(chain.from_iterable(x for _, x in cuts)), True)
        plain, spaced, out = self.plain, self.spaced, []
        for words, pieces in cuts:
            found = [plain[x] for x in words] + [spaced[x] for x in pieces]
            out.append((" ".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.code([text])[0][0].split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each row's n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (bytes
    decoded from the ids); with_ids adds the ids and the decoded bytes. A map without a shuffle."""
    context = df.sparkSession.sparkContext
    model = context.broadcast(serialise_model(ranks))  # bounded by the vocabulary file
    slim = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches hold no cycles, and scanning them costs more than encoding
        codec = Codec(model.value, pattern)
        for batch in steps(batches, "_text"):
            counts, shas, backs, kept, raws = [], [], [], [], []
            for spelled, raw in codec.code(batch.column(1).to_pylist()):
                counts.append(spelled.count(" ") + 1 if spelled else 0)
                shas.append(hashlib.sha256(spelled.encode()).hexdigest())
                backs.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    kept.append([int(x) for x in spelled.split()])
                    raws.append(raw)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(backs)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(kept, pa.list_(pa.int32())), pa.array(raws, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return slim.mapInArrow(run, fields)
