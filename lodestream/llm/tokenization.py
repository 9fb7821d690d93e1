"""Token ids of whole texts, with memos of words and of their parts.

``word_bpe_49k`` drops white space and never joins characters across it, so the
ids of a text are the ids of its words in order. A text of printable ASCII and
precomposed Latin letters needs no normalisation but lower case; the vocabulary's
own pattern cuts it into parts and the tokenizer's model encodes each part, once for
each Python worker as long as the memo holds it. Any other text is encoded word by
word with a memo of words; those of its words that aren't simple in that sense go
through the whole tokenizer. The result is that of
``Tokenizer.encode(text, add_special_tokens=False)``. Bytes that aren't UTF-8 count as
U+FFFD. Long texts are cut at white space, so that their parts aren't all held at once.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WORD_BPE = "word_bpe_49k.json"
#: Bytes that a worker's memo of words, and that of parts, may hold; beyond it the memo starts anew (results don't change).
MEMO_BYTES, PART_BYTES = 48 << 20, 96 << 20
#: What an entry takes beside its letters and ids.
ENTRY_BYTES = 180
#: Tokens in one Arrow batch that a task hands back.
BATCH_TOKENS = 1_000_000
#: Bytes of a text that are encoded at a time.
PIECE = 1 << 20

_LOWER, _WHITE = "a-zß-öø-ÿā-ž", " \t-\r"
_KINDS = "!-~À-ÖØ-öø-įĲ-ž"
_SIMPLE = re.compile(f"[{_KINDS}]+")
_SIMPLE_TEXT = re.compile(f"[{_KINDS}{_WHITE}]*")
_SPACE = re.compile(f"[{_WHITE}]".encode())
#: The tokenizer's own splitting pattern, for lower-cased words and texts of the simple kind (a fixed value).
_PARTS = re.compile(rf"[{_LOWER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_LOWER}0-9{_WHITE}]+")


def vocabulary_path(name: str = WORD_BPE) -> str:
    """Where the vocabulary file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer of a vocabulary file; a path is taken as it is."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.sep in name else vocabulary_path(name))


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def as_utf8(text: bytes) -> bytes:
    """A text with U+FFFD for what isn't UTF-8."""
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            return text.decode(errors="replace").encode()
    return text


class PartMemo(dict):
    """Maps a lower-cased part to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters, self.held = model.tokenize, _byte_letters(), 0

    def __missing__(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        ids = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        self.held += len(part) + len(ids) + ENTRY_BYTES
        if self.held > PART_BYTES:
            self.clear()
            self.held = 0
        self[part] = ids
        return ids


class WordMemo(dict):
    """Maps a word's UTF-8 bytes to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str = WORD_BPE):
        super().__init__()
        self.tokenizer = load(vocabulary)
        self.parts = PartMemo(self.tokenizer.model)
        self.held = 0

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self.held += len(word) + len(ids) + ENTRY_BYTES
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        self[word] = ids
        return ids

    def _piece(self, raw: bytes) -> bytes:
        text = raw.decode(errors="replace")
        if _SIMPLE_TEXT.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.__getitem__, raw.split()))

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text; of null and empty texts, none."""
        if not text or len(text) <= PIECE:
            return self._piece(text or b"")
        found, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            found.append(self._piece(text[at:end]))
            at = end
        return b"".join(found)


_MEMOS: dict[str, WordMemo] = {}


def memo(vocabulary: str) -> WordMemo:
    """This worker's memo; it outlives a task as the worker does."""
    if vocabulary not in _MEMOS:
        _MEMOS[vocabulary] = WordMemo(vocabulary)
    return _MEMOS[vocabulary]


def id_lists(parts: list[bytes]) -> pa.Array:
    """A list<int32> array of byte strings that hold 32-bit ids."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def crc32_of_lists(column: pa.Array) -> list[int]:
    """Unsigned crc32 of each list's ids as little-endian 32-bit integers."""
    ends = column.offsets.to_numpy()
    raw = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def digest(schema_of: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: replaces the column ``ids`` by ``ids_crc32``; ``schema_of`` names the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = pa.array(crc32_of_lists(b.column("ids")), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema_of), crc], names=[*schema_of, "ids_crc32"])

    return run
