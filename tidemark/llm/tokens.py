"""Exact encoding with the tokenizers library, each distinct word once.

Both public vocabularies split a text before they merge, and no token spans the place before a
single space or newline that stands between two other characters. So a text is cut there, each
distinct chunk is encoded once by the library, and the ids are put together again. Texts with other
white space are cut only at the places that are surely safe. A tokenizer file of any other shape is
used as it is, text by text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .common import trim

#: Bytes of text that are encoded together, where batches are as large: the more, the more words they share.
SLICE = 8 << 20
TAIL = "".join(sorted(".,;:!?*#%&$()[]{}\"-_/\\@+=~^`"))
SAFE = re.compile(r"(?<=\S)(?= \S)")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return "any"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    parts = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if parts == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
        return "word"
    return "any"


class Encoder(dict):
    """Chunk -> ids as little-endian bytes; fills itself.

    Beyond `limit` chunks a new generation begins and takes over what is asked for again, so memory is
    bounded by two generations and frequent words stay.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok, self.kind, self.limit = Tokenizer.from_file(path), _kind(spec), limit
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model, self.letters = self.tok.model, _byte_letters()
        self.tokenize = self.model.tokenize
        self.lead = self.letters[ord(" ")] if self.kind == "byte" else ""
        self.wide = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.coded = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tok.get_vocab_size())]

    def piece(self, text: str) -> bytes:
        """ids of one pre-token; those are fewer than chunks, so they have a memory of their own."""
        out = self.pieces.get(text)
        if out is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            plain = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
            out = self.pieces[text] = b"".join([self.coded[t.id] for t in self.model.tokenize(plain)])
        return out

    def full(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.full(text), self.dtype).tobytes()

    def chunk(self, chunk: str, lead: str) -> bytes:
        """ids of a chunk without inner white space; lead: the space or newline before it, or nothing."""
        core = chunk.rstrip(TAIL)
        if "<" in chunk or core and not (core.isalpha() and (core.isascii() or max(core) < "Ā")):
            return self.whole(lead + chunk)
        tail = chunk[len(core) :]
        if lead == " " and tail and core:
            return self[core] + self.piece(tail)
        if self.kind == "word":
            return (self.piece(core.lower()) if core else b"") + (self.piece(tail) if tail else b"")
        if lead == "\n":
            return self.piece("\n") + (self.piece(core) if core else b"") + (self.piece(tail) if tail else b"")
        return self.piece(lead + core) + (self.piece(tail) if tail else b"") if core else self.piece(lead + tail)

    def plain(self, word: str) -> bytes:
        """ids of a word of Latin letters behind a space, which is one pre-token."""
        coded, low = self.coded, word if self.lead else word.lower()
        return b"".join([coded[t.id] for t in self.tokenize(self.lead + (low if low.isascii() else low.translate(self.wide)))])

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.get(chunk)
        if out is None:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) < "Ā"):
                out = self.plain(chunk)
            else:
                out = self.chunk(chunk[1:], "\n") if chunk[0] == "\n" else self.chunk(chunk, " ")
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the library's encode(text, add_special_tokens=False) gives them."""
        if not text:
            return b""
        if self.kind == "any":
            return self.whole(text)
        chunks = text.replace("\n", " \n").split(" ")
        if "" in chunks or "\n" in chunks or not text.replace("\n", "").isprintable():
            out = []
            for p in SAFE.split(text):
                rest = p[1:]
                out.append(self[rest] if p[0] == " " and rest and not rest[0].isspace() and rest.isprintable() and " " not in rest else self.whole(p))
            return b"".join(out)
        return self.chunk(chunks[0], "") + b"".join(map(self.__getitem__, chunks[1:]))

    def several(self, chunks: list[str], often: list[bool]) -> list[bytes]:
        """ids of distinct chunks behind spaces; remembered are words without their tails, and only those met often or again.

        Most distinct words of a corpus stand there once, and would push out those that come back.
        """
        out, get = [], self.get
        for chunk, many in zip(chunks, often, strict=True):
            ids = get(chunk)
            if ids is None:
                core = chunk if chunk.isalpha() else chunk.rstrip(TAIL)
                one_word = core.isalpha() and (core.isascii() or max(core) < "Ā")
                key = core if one_word else chunk
                ids = get(key)
                if ids is None:
                    ids = self.old.get(key)
                    again = ids is not None
                    if not again:
                        ids = self.plain(core) if one_word else self.chunk(chunk[1:], "\n") if chunk[0] == "\n" else self.chunk(chunk, " ")
                    if many or again:
                        if len(self) >= self.limit:
                            self.old = dict(self)
                            self.clear()
                        self[key] = ids
                if one_word and len(core) < len(chunk):
                    ids += self.piece(chunk[len(core) :])
            out.append(ids)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """encode of every text; what the texts share is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out, own, flat = [b""] * len(texts), [], []
        for k, text in enumerate(texts):
            spaced = text.replace("\n", " \n")
            if self.kind == "any" or not text or spaced[0] == " " or spaced[-1] in " \n" or "  " in spaced or "\n " in spaced or not text.replace("\n", "").isprintable():
                out[k] = self.encode(text)
            else:
                own.append(k)
                flat.append(spaced)
        if not own:
            return out
        split = pc.split_pattern(pa.array(flat, pa.large_string()), " ")
        del flat
        first, chunks = split.offsets.to_numpy(), split.values
        inner = np.ones(len(chunks), bool)
        inner[first[:-1]] = False
        heads = chunks.take(pa.array(first[:-1])).to_pylist()
        rest = chunks.filter(pa.array(inner)).dictionary_encode()
        at = np.empty(len(inner), np.int32)
        at[inner] = rest.indices.to_numpy()
        words = rest.dictionary.to_pylist()
        del split, chunks, rest
        coded = self.several(words, (np.bincount(at[inner], minlength=len(words)) > 1).tolist()) + [self.chunk(h, "") for h in heads]
        at[first[:-1]] = np.arange(len(words), len(coded), dtype=np.int32)
        ids = pa.array(coded, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        for k, a, b in zip(own, ends[:-1], ends[1:], strict=True):
            out[k] = bytes(raw[a:b])
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between its tasks."""
    return Encoder(path)


def release() -> None:
    """Give up a worker's encoders and hand free memory back; for tasks that hold much and encode nothing."""
    encoder.cache_clear()
    trim()
