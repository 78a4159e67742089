"""Token ids of whole texts by a given tokenizer file, at the price of its distinct words.

A word-level tokenizer (one whose pre-tokenizer never joins two whitespace-separated chunks) gives a chunk the same
ids wherever it stands. An Arrow batch is therefore cut at ASCII blanks and reduced to its distinct chunks. Plain Latin
chunks are lower-cased and cut into pieces as one array of bytes, and a distinct piece goes to the vocabulary model
directly; any other chunk, and every text under a tokenizer of another kind, goes through the library's full encoder.
Pieces are kept in two generations, so that those which come again outlive the ones that do not.
"""
from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import ramp, worker_cache

#: pieces that a generation of a worker's cache holds before the next one starts; bounds a worker's memory
CACHE_PIECES = 200_000
#: texts encoded at once; bounds the arrays beside the batch
TEXTS_AT_ONCE = 2048


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest
    follow from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Generations:
    """Values by text, at the price of the texts that two generations do not hold."""

    def __init__(self, made: Callable[[str], bytes]):
        self.made = made
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for text in texts:
            value = young.get(text)
            if value is None:
                value = old.get(text)
                young[text] = value = self.made(text) if value is None else value
            out.append(value)
        return out


#: what keeps a chunk from the short way: letters beyond the Latin blocks, the dotted capital I, marks of special tokens, and
#: the apostrophe, behind which a cut depends on the letters that follow
LONG_WAY = r"[^\x00-\x{24f}]|\x{130}|<\||'"
BLANK, LETTER, DIGIT, OTHER = range(4)


def _joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each value's ids start, how many they are, and all ids."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(values), np.uint32)


class WordEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = None
        steps = (made.get("normalizer") or {}).get("normalizers") or []
        cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and cut[0].get("behavior") == "Removed" and cut[0].get("invert"):
            self.pieces = regex.compile(cut[0]["pattern"]["Regex"])
            kind = lambda c: BLANK if regex.match(r"\s", c) else LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER
            self.kinds = np.array([kind(chr(i)) for i in range(0x3000)], np.uint8)  # Latin letters and their lower-case forms
        # ids as little-endian 32-bit integers
        self.known = Generations(self._piece)
        self.known_chunks = Generations(self._chunk)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """The worker's encoder for a file, built once."""
        made = worker_cache("encoders")
        if path not in made:
            made[path] = cls(path)
        return made[path]

    def _piece(self, piece: str) -> bytes:
        if self.kinds[ord(piece[0])] == BLANK:
            return b""
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if (chunk.isascii() or max(chunk) < "ɐ" and "İ" not in chunk) and "<|" not in chunk:
            return b"".join(self.known.of(self.pieces.findall(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def cut(self, chunks: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of lower-case chunks that need not go the long way, in a row, and the bounds of each chunk's pieces."""
        if not len(chunks):
            return chunks, np.zeros(1, np.int64)
        bounds = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1].astype(np.int64)
        raw = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds -= bounds[0]
        kind = self.kinds[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            code = (raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F
            three = raw[lead] >= 0xE0
            code[three] = (code[three] & 0x3FF) << 6 | raw[lead[three] + 2] & 0x3F
            kind[lead] = kind[lead + 1] = self.kinds[code]
            kind[lead[three] + 2] = self.kinds[code[three]]
        starts = (kind == DIGIT) & (raw & 0xC0 != 0x80)
        starts[1:] |= kind[1:] != kind[:-1]
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
        return pieces, np.searchsorted(at, bounds)

    def chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each chunk's ids start, how many they are, and all ids."""
        other = pc.match_substring_regex(chunks, LONG_WAY).to_numpy(zero_copy_only=False).astype(bool)
        pieces, bounds = self.cut(pc.utf8_lower(chunks.filter(pa.array(~other))))
        coded = pieces.dictionary_encode()
        starts, sizes, ids = _joined(self.known.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        at = coded.indices.to_numpy(zero_copy_only=False)
        of_piece = sizes[at] if len(at) else np.zeros(0, np.int64)
        plain = ids[ramp(starts[at], of_piece)] if len(at) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(of_piece)])[bounds]
        after, rest, whole = _joined(self.known_chunks.of(chunks.filter(pa.array(other)).to_pylist()))
        first, lengths = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        first[~other], lengths[~other] = ends[:-1], np.diff(ends)
        first[other], lengths[other] = after + len(plain), rest
        return first, lengths, np.concatenate([plain, whole])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token counts per text and all ids in a row; null counts as the empty text."""
        texts = pc.fill_null(texts, "")
        if self.pieces is None:
            made = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([len(x) for x in made], np.int64), np.fromiter(itertools.chain.from_iterable(made), np.uint32)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        starts, lengths, ids = self.chunks(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        of_word = lengths[at] if len(at) else np.zeros(0, np.int64)
        flat = ids[ramp(starts[at], of_word)] if len(at) else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(of_word)])
        bounds = before[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return np.diff(bounds), flat


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the end id, and where each text's ids start (one bound more than texts)."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(bounds[-1]), end_id, np.uint32)
    out[ramp(bounds[:-1], counts)] = ids
    return bounds, out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most TEXTS_AT_ONCE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)
