"""Byte-level BPE through a sentencepiece model that is written straight from a rank vocabulary.

A rank file lists byte strings; a lower rank merges earlier. Each byte becomes one printable character, each string a
piece whose score is its negative rank, and the normaliser is the identity: sentencepiece then merges the best-scored
pair first, leftmost among equals, which is the order of the ranks. Texts are first cut by the vocabulary's pattern and
every cut is encoded by itself; a cut that is a vocabulary entry is that entry. Decoding maps ids to pieces and the
pieces' characters back to bytes.

Nothing is trained, and the vocabulary is read from the installed file given by its path on driver and executors.

Defined results. A null or empty text has no tokens; its bytes are empty. Repeated rows encode alike. Texts of any
length are encoded whole. Other columns are neither read nor touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolex.llm.words import give_back

RANKS = "byte_bpe_50k.tiktoken"
#: bytes that a worker's remembered words take, but for those of one group, and characters of a word that is remembered
REMEMBERED, LONGEST = 32 << 20, 64
#: bytes that a remembered word takes besides its own characters and ids
ENTRY = 180
#: bytes of text that are encoded together
GROUP = 1 << 20
Ids = tuple[int, ...]


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is printable and no space, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a string or message, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"ranks of {path} are not 0, 1, 2 ...")
    return [token for _, token in ranked]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary; the unknown piece, which no text reaches, comes last.

    Message fields (fixed by the format): model 1 pieces, 2 trainer, 3 normaliser; piece 1 text, 2 score, 3 type;
    trainer 3 model type (2: BPE), 40 to 43 special ids; normaliser 1 name, 3 dummy prefix, 4 and 5 white space.
    """
    letters = byte_characters()
    pieces = [
        field(1, "".join(letters[b] for b in token).encode()) + field(2, float(-rank)) for rank, token in enumerate(tokens)
    ]
    pieces.append(field(1, b"<unk>") + field(2, float(-len(tokens))) + field(3, 2))
    absent = (1 << 64) - 1
    trainer = field(3, 2) + field(40, len(tokens)) + field(41, absent) + field(42, absent) + field(43, absent)
    normaliser = field(1, b"identity") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(field(1, p) for p in pieces) + field(2, trainer) + field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        # the pattern's white space is that of Unicode; the regex module's \s has four control characters more
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))
        self.whole = {token: rank for rank, token in enumerate(tokens)}
        self.letters = byte_characters()
        back = {letter: b for b, letter in enumerate(self.letters)}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        # a lone space between other characters always opens a cut, so texts can be split there first
        self.odd_space = re.compile(r"\s | (?:\s|\Z)")
        # words in use and, until they are used again, those of the time before; ids are shared objects
        self.known: dict[str, Ids] = {}
        self.before: dict[str, Ids] = {}
        self.held = 0
        self.numbers = list(range(len(tokens)))
        self.names = [str(i) for i in self.numbers]

    def encode_cuts(self, cuts: list[str]) -> list[list[int]]:
        """The ids of each cut of the pattern."""
        data = [cut.encode() for cut in cuts]
        ids = [[self.whole[d]] if d in self.whole else None for d in data]
        rest = [k for k, found in enumerate(ids) if found is None]
        letters = self.letters
        for k, found in zip(rest, self.model.encode(["".join([letters[b] for b in data[k]]) for k in rest], num_threads=1), strict=True):
            ids[k] = found
        return ids

    def remember(self, found: dict[str, Ids]) -> None:
        """Keep the ids of words; those that were not used lately go when the room is full."""
        if any(len(word) > LONGEST for word in found):
            found = {word: ids for word, ids in found.items() if len(word) <= LONGEST}
        room = ENTRY * len(found) + sum(map(len, found)) + 8 * sum(map(len, found.values()))
        if self.held + room > REMEMBERED // 2:
            self.before, self.known, self.held = self.known, {}, 0
        self.known.update(found)
        self.held += room

    def ids_of(self, words: set[str]) -> dict[str, Ids]:
        """The ids of words, each as it stands after a space. New ones are encoded in one go."""
        known, before, shared = self.known, self.before, self.numbers.__getitem__
        missing = words.difference(known)
        found = {word: before[word] for word in missing.intersection(before)}
        new = list(missing.difference(before))
        cuts = [self.cut.findall(" " + word) for word in new]
        flat = self.encode_cuts(list(chain.from_iterable(cuts)))
        at = 0
        for word, own in zip(new, cuts, strict=True):
            n = len(own)
            ids = flat[at] if n == 1 else chain.from_iterable(flat[at : at + n])
            found[word] = tuple(map(shared, ids))
            at += n
        self.remember(found)
        found.update([(word, known[word]) for word in words.difference(missing)])
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        words, openings = [], []
        for text in texts:
            first, *rest = [text] if self.odd_space.search(text) else text.split(" ")
            openings.append(self.cut.findall(first))
            words.append(rest)
        known = self.ids_of(set(chain.from_iterable(words)))
        cuts = list(set(chain.from_iterable(openings)))
        opened, out = dict(zip(cuts, self.encode_cuts(cuts), strict=True)), []
        for opening, rest in zip(openings, words, strict=True):
            ids = list(chain.from_iterable([opened[cut] for cut in opening]))
            ids.extend(chain.from_iterable([known[word] for word in rest]))
            out.append(ids)
        return out

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


def groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole texts of about ``GROUP`` bytes; a longer text is a run of its own."""
    ends = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy().cumsum()
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(ends.searchsorted(before + GROUP, side="right")))
        yield batch.slice(at, to - at)
        at = to


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def arrow(values: tuple, kind: pa.DataType) -> pa.Array:
    """A column; a list column from one Arrow array per row."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    bounds = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.concat_arrays(values))


def encode_documents(
    documents: DataFrame, with_ids: bool = False, with_decoded: bool = False, path: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and its ``ids`` and ``decoded`` if asked for.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the bytes that the ids decode to.
    """
    path = path or public_tokenizers.path(RANKS)
    pattern = public_tokenizers.PATTERN
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_decoded]
    types = [None, pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids, *[pa.binary()] * with_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in groups(batch):
                rows = []
                for ids in own.encode([text or "" for text in part.column("text").to_pylist()]):
                    decoded, joined = own.decode(ids), own.joined(ids).encode()
                    row = (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, *([pa.array(ids, pa.int32())] if with_ids else []), *([decoded] if with_decoded else [])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(arrow(c, t) for c, t in zip(columns, types[1:], strict=True))], names
                )
        give_back()

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    return documents.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
