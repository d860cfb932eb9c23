"""SentencePiece encoding and decoding with the tokenizers library.

``read_model`` parses the model's protobuf; ``Codec`` makes tokenizers of it: the
normaliser with its character map and white-space rules, the word-start marker,
unigram scores or BPE merges, byte fallback, and the decoder. Texts are encoded in
batches of bounded size by several threads in each task. ``parity`` compares ids
with the sentencepiece library.

BPE: a model keeps pieces with scores and joins, of all neighbours that form a
piece, those of the best score; the merges rebuilt here are all pairs of pieces that
form a piece, by its score. Where no piece has the marker after another character,
texts are split before each run of markers first, which changes no id and lets the
library remember words. Where the normaliser does nothing but put markers for spaces, a
process encodes and decodes its words apart and remembers the ids of some, which changes no
id either; texts with a word that comes back changed are decoded whole.

Defined cases: a null text has null ids and no tokens; an empty text has none and
round-trips; a very long text is encoded whole, in a call of its own; the names of
control, unknown, unused and byte pieces in a text are ordinary text; repeated rows are
encoded row by row; an empty table gives an empty result; other columns are passed
through or ignored. A text round-trips if the decoded
text and the text are the same to the model's normaliser; with a normaliser that
changes nothing but spaces, they are the same but for literal marker characters.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
TOKENIZER_FOLDER = "/opt/tokenizers"
MARKER = "▁"
#: A word: a run of markers and what follows, or the start of a text without any.
WORD = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
THREADS = 2
#: Characters that one call of the encoder gets, unless a single text is longer.
BATCH_CHARS = 1_000_000
#: Words whose ids a process remembers.
KNOWN_WORDS = 300_000
#: Piece types and model types of the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message: int, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def read_model(data: bytes) -> dict:
    """pieces (text, score, type), model_type, byte_fallback, unk_id and the normaliser's rules."""
    pieces = []
    trainer, rules = {}, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            rules = dict(_fields(value))
    unknown = [k for k, p in enumerate(pieces) if p[2] == UNKNOWN]
    return {
        "pieces": pieces,
        "model_type": trainer.get(3, UNIGRAM),
        "byte_fallback": bool(trainer.get(35, 0)),
        "unk_id": unknown[0] if unknown else 0,
        "charsmap": rules.get(2, b""),
        "dummy_prefix": bool(rules.get(3, 1)),
        "squeeze": bool(rules.get(4, 1)),
        "escape": bool(rules.get(5, 1)),
    }


def _normalizer(model: dict):
    from tokenizers import Regex, normalizers

    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARKER if model["escape"] else " "
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(space))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARKER))
    return normalizers.Sequence(steps)


def _merges(pieces) -> list[tuple[str, str]]:
    known = {text for text, _, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted((p for p in pieces if p[2] == NORMAL and len(p[0]) > 1), key=lambda p: -p[1])
    return [(text[:k], text[k:]) for text, _, _ in ranked for k in range(1, len(text)) if text[:k] in known and text[k:] in known]


def _splits(pieces) -> bool:
    """Whether no piece has the marker after another character."""
    return not any(MARKER in text.lstrip(MARKER) for text, _, kind in pieces if kind in (NORMAL, USER_DEFINED))


def _by_words(model: dict) -> bool:
    """Whether the ids of a text are those of its words, one after another."""
    own = any(kind == USER_DEFINED for _, _, kind in model["pieces"])
    return model["model_type"] == BPE and model["escape"] and not (own or model["charsmap"] or model["squeeze"]) and _splits(model["pieces"]) and (MARKER, NORMAL) in {(text, kind) for text, _, kind in model["pieces"]}


def _tokenizer(own, model: dict):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, pre_tokenizers

    pieces = model["pieces"]
    tokenizer = Tokenizer(own)
    tokenizer.normalizer = _normalizer(model)
    if _splits(pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*"), "isolated")
    steps = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model["dummy_prefix"]:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    tokenizer.add_tokens([AddedToken(text, normalized=False) for text, _, kind in pieces if kind == USER_DEFINED])
    return tokenizer


class Codec:
    """Encodes and decodes lists of texts; made of strings and numbers, so it travels to the
    tasks as it is.

    A unigram lattice holds every piece of its vocabulary, so control, unknown, unused and
    byte pieces have no text there, and what no piece covers becomes bytes afterwards. The
    decoder has all names.
    """

    def __init__(self, data: bytes):
        from tokenizers import models

        model = read_model(data)
        pieces, self.unknown = model["pieces"], model["unk_id"]
        self.bytes: list[int] = []
        self.words, self.prefix = _by_words(model), model["dummy_prefix"]
        if model["model_type"] == BPE:
            names = {text: k for k, (text, _, _) in enumerate(pieces)}
            own = models.BPE(names, _merges(pieces), unk_token=pieces[self.unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"], cache_capacity=100_000)
            self.encoder = self.decoder = _tokenizer(own, model).to_str()
        elif model["model_type"] == UNIGRAM:
            lattice = [(text, score) if kind in (NORMAL, USER_DEFINED) else ("", 0.0) for text, score, kind in pieces]
            self.encoder = _tokenizer(models.Unigram(lattice, unk_id=self.unknown, byte_fallback=False), model).to_str()
            every = [(text, score) for text, score, _ in pieces]
            self.decoder = _tokenizer(models.Unigram(every, unk_id=self.unknown, byte_fallback=False), model).to_str()
            if model["byte_fallback"]:
                at = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == BYTE}
                self.bytes = [at[f"<0x{b:02X}>"] for b in range(256)]
        else:
            raise ValueError(f"model type {model['model_type']} is neither unigram nor BPE")

    def open(self, threads: int = THREADS) -> Codec:
        """Loads the tokenizers, which use so many threads, and remembers no words yet; only
        once a process, as its next tasks get this codec as it is left by the last."""
        if hasattr(self, "normalize"):
            return self
        os.environ.update(RAYON_NUM_THREADS=str(threads), TOKENIZERS_PARALLELISM="true")
        from tokenizers import Tokenizer

        if self.words:
            self._plain = self._decoder = Tokenizer.from_str(self.encoder)
            normalizer, self._plain.normalizer = self._plain.normalizer, None
            self._known: dict[str, bytes] = {}
            self._changed: set[str] = set()
        else:
            self._decoder = self._encoder if self.decoder == self.encoder else Tokenizer.from_str(self.decoder)
            normalizer = self._encoder.normalizer
        self.normalize = normalizer.normalize_str
        return self

    @cached_property
    def _encoder(self):
        """Of whole texts; not loaded where words are encoded apart."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.encoder)

    def _with_bytes(self, encoding) -> list[int]:
        out: list[int] = []
        for k, token in zip(encoding.ids, encoding.tokens, strict=True):
            out += [self.bytes[b] for b in token.encode()] if k == self.unknown else [k]
        return out

    def _by_word(self, texts: list[str]) -> tuple[list[list[str]], list[bytes]]:
        """The words of each text, and its ids as 32-bit numbers."""
        self._changed &= self._known.keys()
        split = [WORD.findall(((MARKER + t) if self.prefix and t else t).replace(" ", MARKER)) for t in texts]
        words = list({word for own in split for word in own if word not in self._known})
        ids = [e.ids for e in self._plain.encode_batch_fast(words, add_special_tokens=False)]
        self._known.update(zip(words, [array("i", x).tobytes() for x in ids], strict=True))
        # A decoder that strips the prefix strips it off a word, too.
        start = 1 if self.prefix else 0
        self._changed.update(w for w, back in zip(words, self.decode(ids), strict=True) if back != w[start:].replace(MARKER, " "))
        packed = [b"".join(map(self._known.__getitem__, own)) for own in split]
        # The first words to come are kept, and the frequent ones are among them.
        for _ in range(len(self._known) - KNOWN_WORDS):
            self._known.popitem()
        return split, packed

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as 32-bit numbers, and whether it round-trips."""
        if not self.words:
            ids = self.encode(texts)
            return [array("i", x).tobytes() for x in ids], self._round_trips(texts, ids)
        split, packed = self._by_word(texts)
        same = [self._changed.isdisjoint(own) for own in split] if self._changed else [True] * len(texts)
        # Words that come back changed say no more than that the text has to be decoded.
        if again := [k for k, fine in enumerate(same) if not fine]:
            part = self._round_trips([texts[k] for k in again], [array("i", packed[k]).tolist() for k in again])
            for k, fine in zip(again, part, strict=True):
                same[k] = fine
        return packed, same

    def _round_trips(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        return [b == t or self.normalize(b) == self.normalize(t) for b, t in zip(self.decode(ids), texts, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.words:
            return [array("i", x).tolist() for x in self._by_word(texts)[1]]
        ids = [e.ids for e in self._encoder.encode_batch_fast(texts, add_special_tokens=False)]
        if self.bytes and (lacking := [k for k, own in enumerate(ids) if self.unknown in own]):
            # The fast call keeps no strings, which the bytes are taken from.
            for k, encoding in zip(lacking, self._encoder.encode_batch([texts[k] for k in lacking], add_special_tokens=False), strict=True):
                ids[k] = self._with_bytes(encoding)
        return ids

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._decoder.decode_batch(ids, skip_special_tokens=False)


def model_bytes(name: str = MODEL, folder: str = TOKENIZER_FOLDER) -> bytes:
    """The model file, read where the driver runs; tasks get the built tokenizer."""
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of the texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)
    ours = Codec(data).open().encode(texts)
    return [k for k, (a, b) in enumerate(zip(ours, theirs, strict=True)) if a != b]


def _groups(texts: list[str]):
    """Slices of the list with at most BATCH_CHARS characters, or one text."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, data: bytes, threads: int = THREADS) -> DataFrame:
    """Adds ``ids`` (array<int>), ``n_tokens`` and ``round_trip`` to ``docs``, in place of
    columns of these names."""
    docs = docs.drop("ids", "n_tokens", "round_trip")
    made = docs.sparkSession.sparkContext.broadcast(Codec(data))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        import numpy as np

        codec = made.value.open(threads)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for start, end in _groups([t or "" for t in texts]):
                part = [t or "" for t in texts[start:end]]
                ids, same = codec.checked(part)
                null = np.array([t is None for t in texts[start:end]])
                sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                made_ids = pa.ListArray.from_arrays(offsets, flat)
                rest = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*rest.columns, made_ids, pa.array(sizes), pa.array(same, pa.bool_(), mask=null)], [*names, "ids", "n_tokens", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, data: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id, text of doc_id, ids; null ids give a null text."""
    made = tokens.sparkSession.sparkContext.broadcast(Codec(data))

    def run(batches):
        codec = made.value.open(threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    encoded = encode(docs, model_bytes())
    digest = F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<int>")), ","), 256)
    return encoded.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "round_trip")
