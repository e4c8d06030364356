"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read here field by field; from it the library's normaliser, metaspace mark, model (unigram
scores, or merges ranked by a BPE model's scores) and byte fallback are rebuilt. The driver reads the model once and
tasks get its bytes with the plan, so executors need no local file. Where a BPE model's words are encoded apart, each is
encoded once while its worker remembers it; other texts are encoded in batches by the library's own threads.
Every row is encoded by the sentencepiece library as well and compared (column `parity`).

Edge cases: null and empty texts have no ids and decode to an empty text; control strings such as `<s>` inside texts
are ordinary text; repeated rows are encoded alike; an empty table gives an empty result; other columns are passed on
by `encode` untouched unless they are called ids, decoded_ok or parity, which its own columns replace.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows encoded at once, and the share of rows (one in so many, by hash) that the parity column compares: all of them.
BATCH_ROWS, PARITY_EVERY = 256, 1
MARK = "▁"
#: A word and the marks before it, or marks at the end of a text.
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
#: Most words whose ids a worker remembers, and the most letters of one.
KNOWN_WORDS, KNOWN_LETTERS = 200_000, 40
#: Kinds of pieces in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; length-delimited values as bytes, fixed32 as 4 bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """What a model file says: pieces in id order, the algorithm, and how text is normalised."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    algorithm: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    suffix_mark: bool = False

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in proto_fields(data):
            if number == 1:
                got = dict(proto_fields(value))
                model.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number == 2:
                got = dict(proto_fields(value))
                model.algorithm, model.byte_fallback, model.suffix_mark = got.get(3, 1), bool(got.get(35, 0)), bool(got.get(24, 0))
            elif number == 3:
                got = dict(proto_fields(value))
                model.charsmap, model.dummy_prefix, model.squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        return model

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """A BPE model's merges: every way to make a normal piece of two, better-scored pieces first."""
    scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score in scores.items():
        parts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in scores and piece[k:] in scores]
        found += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in parts]
    return [(a, b) for *_, a, b in sorted(found)]


def words_apart(model: PieceModel) -> bool:
    """Whether each word with the marks before it is encoded by itself: no piece of a BPE model has a mark after another character, so nothing merges across the start of a run of marks."""
    return model.algorithm == 2 and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build_tokenizer(model: PieceModel):
    """The tokenizers library's tokenizer with the model's normaliser, vocabulary and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark:
        raise ValueError("models that put the mark after words are not supported")
    if model.algorithm == 2:
        merges = merges_of(model)
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges, unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.algorithm == 1:
        # Control and unused pieces are never matched in text, so they get names no text has. Byte pieces keep theirs for
        # the fallback and the least score of all, which leaves the unknown's penalty as it is.
        least = min(s for _, s, kind in model.pieces if kind in (NORMAL, USER))
        named = [(p if kind not in (CONTROL, UNUSED) else "\U0010ffff" + p, s if kind in (NORMAL, USER) else least) for p, s, kind in model.pieces]
        core = models.Unigram(named, model.unknown, model.byte_fallback)
    else:
        raise ValueError(f"algorithm {model.algorithm} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if words_apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    elif model.algorithm == 1 and model.byte_fallback:
        # A byte piece's name in a text is ordinary text: it is cut after its first character.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("<(?=0x[0-9A-F]{2}>)"), "merged_with_previous")
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


def piece_bytes(model: PieceModel) -> list[bytes]:
    """What each id stands for when decoded: a byte piece its byte, a control piece nothing, the unknown its sign."""
    out = []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind == UNKNOWN:
            out.append(" ⁇ ".encode())
        else:
            out.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
    return out


def decode_ids(table: list[bytes], ids: list[int], dummy_prefix: bool) -> str:
    """The text of a sequence of ids; bytes that are no UTF-8 become replacement signs."""
    text = b"".join([table[i] for i in ids])
    return (text[1:] if dummy_prefix and text[:1] == b" " else text).decode("utf-8", "replace")


def normalised(model: PieceModel, tokenizer, text: str) -> str:
    """The text that decoding its ids gives back."""
    if not model.charsmap and not model.squeeze and MARK not in text:
        return text
    out = tokenizer.normalizer.normalize_str(text).replace(MARK, " ") if text else ""
    return out[1:] if model.dummy_prefix and out[:1] == " " else out


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_words(tokenizer, texts: list[str], known: dict[str, list[int]], plain: bool = False) -> list[list[int]]:
    """Ids of texts whose words are encoded apart: each word once while `known` remembers it. `plain`: normalising only puts marks."""
    marked = (lambda x: MARK + x.replace(" ", MARK)) if plain else tokenizer.normalizer.normalize_str
    out = []
    for text in texts:
        ids: list[int] = []
        for word in re.findall(WORD, marked(text)) if text else ():
            got = known.get(word)
            if got is None:
                got = [x.id for x in tokenizer.model.tokenize(word)]
                if len(word) <= KNOWN_LETTERS:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[word] = got
            ids += got
        out.append(ids)
    return out


_BUILT: dict[int, tuple] = {}


def _tools(data: bytes, threads: int) -> tuple:
    """Model, tokenizer, piece table and ids of known words (None where words aren't encoded apart), built once in each worker."""
    key = zlib.crc32(data)
    if key not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true" if threads > 1 else "false", str(threads)
        model = PieceModel.parse(data)
        _BUILT[key] = (model, build_tokenizer(model), piece_bytes(model), {} if words_apart(model) else None)
    return _BUILT[key]


def encode(docs: DataFrame, model: bytes, threads: int = 2, parity_every: int = PARITY_EVERY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns of `docs`, then ids (array of int), decoded_ok (decoding gives the normalised text) and parity.

    parity is true or false for rows that the sentencepiece library encoded too: all, unless `parity_every` says fewer.
    """
    data, names = model, [c for c in docs.columns if c not in ("ids", "decoded_ok", "parity")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names] + ["ids array<int>", "decoded_ok boolean", "parity boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, tokenizer, table, known = _tools(data, threads)
        plain = built.dummy_prefix and not built.squeeze and not built.charsmap
        library = None
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                ids = encode_words(tokenizer, texts, known, plain) if known is not None else [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                normal = [normalised(built, tokenizer, x) for x in texts]
                fine = [decode_ids(table, i, built.dummy_prefix) == x for i, x in zip(ids, normal, strict=True)]
                parity: list[bool | None] = [None] * len(texts)
                if chosen := [k for k, flag in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if flag]:
                    if library is None:
                        import sentencepiece

                        library = sentencepiece.SentencePieceProcessor(model_proto=data)
                    for k in chosen:
                        parity[k] = library.encode(texts[k]) == ids[k]
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(fine, pa.bool_()), pa.array(parity, pa.bool_())], [*names, "ids", "decoded_ok", "parity"])

    compared = (F.pmod(F.xxhash64(F.col(key)), F.lit(parity_every)) == 0) if parity_every else F.lit(False)
    return docs.select(*names, compared.alias("_compared")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of the ids; null ids give an empty text."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name in names] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, _, table, _ = _tools(model, 1)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([decode_ids(table, x or [], built.dummy_prefix) for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], texts], [*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)
