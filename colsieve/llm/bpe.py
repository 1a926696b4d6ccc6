"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be bridged by a merge, so each
such pair is a certain cut: the fragments on its two sides are encoded independently and their
ids concatenated. White space and the library's own pre-tokenizer give the outer cuts, the
vocabulary gives the inner ones. Fragments repeat far more than texts do, so ids are memoised
at the levels word (raw, or a plain piece of one), pre-token of the library and fragment; all memos are bounded.
Many texts at once (`encode_all`) have each of their distinct words encoded once, and short plain
ones without a search for inner cuts, thousands in one call of native code: cuts never change ids.

Null text counts as empty (no ids). Special-token strings inside a text become special ids,
as in the library. Whole texts of any length are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.common import binary, held_over, map_batches, prepare

#: Most memory of a memo in a worker (an encoder's three share that of three), whose processes serve one operator after another.
MEMO_BYTES = 32 << 20
#: Marks the end of a word; no UTF-8 text holds this byte.
WORD_END = b"\xff"
#: Texts encoded together have this many bytes at most, longer ones go in slices of so many words; native code gets so many words a call, of so many bytes each.
GROUP_BYTES, SLICE_WORDS, CALL_WORDS, SHORT_BYTES = 4 << 20, 500_000, 20_000, 64


class _Memo(dict):
    """A memo of bounded memory (keys, values and about 100 bytes for an entry): a miss computes the value.

    When half is full, what it holds becomes the old half, from which values that are asked again return; the old half before is dropped.
    """

    def __init__(self, compute: Callable, most: int = MEMO_BYTES):
        super().__init__()
        self._compute, self._most, self._held, self._old = compute, most // 2, 0, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        size = 100 + sys.getsizeof(key) + sys.getsizeof(value) + (32 * len(value) if isinstance(value, tuple) else 0)
        if self._held + size > self._most:
            self._old = dict(self)
            self.clear()
            self._held = 0
        if size <= self._most:
            self[key] = value
            self._held += size
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for one `tokenizers` BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self._suffix = model.get("end_of_word_suffix") or ""
        self._to_byte = {symbol: byte for byte, symbol in byte_symbols().items()}
        # Where white space only separates, a space can mark the end of a word, so that native code splits words itself.
        space = byte_symbols()[ord(" ")]
        spaced = bool(self._suffix) and _is_word_shape(spec) and not any(space in t for t in model["vocab"] if len(_body(t, self._suffix)[0]) > 1)
        self._end = (b" " if spaced else WORD_END) if self._suffix else b""
        self._core = _core(model, self._suffix, self._to_byte, self._end)
        self._merge = self._core.encode_single_piece
        self._inside = inside_pairs(model["vocab"], self._suffix, self._to_byte)
        letters = range(ord("a"), ord("z") + 1)
        odd = {bytes([a]): bytes(b for b in letters if not self._inside[a << 8 | b]) for a in letters}
        self._odd_letters = re.compile(b"|".join(a + b"[" + b + b"]" for a, b in odd.items() if b) or rb"(?!)").search
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_re = re.compile("|".join(re.escape(s) for s in sorted(self._special, key=len, reverse=True))) if self._special else None
        self._special_lead = {s[:2].encode() for s in self._special}
        size = max([*model["vocab"].values(), *self._special.values()]) + 1
        self._token = [b""] * size
        for token, i in [*model["vocab"].items(), *self._special.items()]:
            self._token[i] = token.encode()
        # Words of Latin letters, digits and ASCII signs take a plain path; all others go through the library's own normalizer and pre-tokenizer.
        self._plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+") if _is_word_shape(spec) else None
        self._ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+") if self._plain is not None else None
        self._latin = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
        self._printable = re.compile(rb"[\x21-\x7e]+").fullmatch
        # For words of the plain path joined by line feeds, which end up as tokens of their own.
        line_end = model["vocab"].get(byte_symbols()[ord("\n")] + self._suffix)
        self._line_end = line_end if spaced else None
        self._lines = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f\n]+|\n").findall
        self._not_latin = re.compile(r"[^\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]").search
        self._fragments = _Memo(self._encode_fragment)
        # Pieces of plain words are words themselves and share their memo; the other one is for those of the library's pre-tokenizer.
        self._pretokens = _Memo(self._encode_pretoken, MEMO_BYTES // 4)
        self._words = _Memo(self._encode_word, MEMO_BYTES // 4 * 7)

    def cuts(self, piece: bytes) -> list[int]:
        """Forced boundaries inside a pre-token."""
        if piece.islower() and piece.isalpha() and not self._odd_letters(piece):
            return []
        inside = self._inside
        return [i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False), 1) if not inside[a << 8 | b]]

    def _encode_fragment(self, fragment: bytes) -> bytes:
        return array("I", self._merge(fragment)).tobytes()

    def _encode_pretoken(self, piece: bytes) -> bytes:
        cuts = self.cuts(piece)
        if not cuts:
            return self._encode_fragment(piece + self._end)
        edges = [0, *cuts]
        return b"".join([self._fragments[piece[a:b]] for a, b in zip(edges, cuts, strict=False)]) + self._fragments[piece[cuts[-1] :] + self._end]

    def _encode_word(self, word: bytes) -> bytes:
        if self._plain is not None:
            if word.isalpha():  # ASCII letters
                pieces = [word.lower()]
            elif word.isascii() and self._printable(word):
                pieces = self._ascii.findall(word.lower())
            elif self._latin(text := word.decode()):
                pieces = [text.lower().encode()] if text.isalpha() else [p.encode() for p in self._plain.findall(text.lower())]
            else:
                pieces = []
            if len(pieces) > 1:
                return b"".join([self._words[p] for p in pieces])
            if pieces:
                return self._encode_pretoken(word) if pieces[0] == word else self._words[pieces[0]]
        text, memo = word.decode(), self._pretokens
        t, to_byte = self.tokenizer, self._to_byte
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return b"".join([memo[bytes([to_byte[c] for c in p])] for p, _ in t.pre_tokenizer.pre_tokenize_str(text)])

    def _has_special(self, raw: bytes) -> bool:
        """Whether a special-token string may stand in a text."""
        return self._special_re is not None and any(lead in raw for lead in self._special_lead)

    def encode(self, raw: bytes | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not raw:
            return b""
        if self._has_special(raw):
            text, out, at = raw.decode(), [], 0
            for m in self._special_re.finditer(text):
                out += [self._encode_span(text[at : m.start()].encode()), np.array([self._special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._encode_span(text[at:].encode())])
        return self._encode_span(raw)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """What `encode` gives for each string of a column. Nothing but the memos is kept from one call to the next."""
        if self._line_end is None:
            return [self.encode(raw) for raw in binary(texts).to_pylist()]
        texts = texts.fill_null("")
        special = np.zeros(len(texts), bool)
        for lead in self._special_lead:
            special |= np.asarray(pc.match_substring(texts, lead.decode()), bool)
        out: list[bytes] = []
        start = held = 0
        for i, (size, odd) in enumerate(zip(pc.binary_length(texts).to_pylist(), special.tolist(), strict=True)):
            alone = odd or size > GROUP_BYTES
            if alone or held + size > GROUP_BYTES:
                out += self._encode_group(texts.slice(start, i - start))
                start, held = i, 0
            held += size
            if alone:
                raw = binary(texts.slice(i, 1))[0].as_py()
                out.append(self.encode(raw) if odd else self._encode_slices(raw.split()))
                start, held = i + 1, 0
        return out + self._encode_group(texts.slice(start))

    def _encode_slices(self, words: list[bytes]) -> bytes:
        return b"".join([self._encode_group(pa.array([b" ".join(words[i : i + SLICE_WORDS])], pa.string()))[0] for i in range(0, len(words), SLICE_WORDS)])

    def _encode_group(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        words = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = words.flatten().dictionary_encode()
        parts = [self._encode_words(coded.dictionary.slice(i, CALL_WORDS)) for i in range(0, len(coded.dictionary), CALL_WORDS)]
        ends = np.cumsum([0, *np.concatenate([counts for _, counts in parts])], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([values for values, _ in parts]))).take(coded.indices)
        at = (np.asarray(ids.offsets)[np.asarray(words.offsets) - words.offsets[0].as_py()] * 4).tolist()
        flat = np.asarray(ids.flatten()).tobytes()
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. Each piece of a plain word is one of the native code, ended by a space, and so is the line feed after a word."""
        text, other = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py(), {}
        if self._not_latin(text) or pc.max(pc.binary_length(words)).as_py() > SHORT_BYTES:
            lines = text.split("\n")
            for i, w in enumerate(lines):
                if w and (len(w) > SHORT_BYTES // 2 and len(w.encode()) > SHORT_BYTES or not self._latin(w)):
                    lines[i], other[i] = "", np.frombuffer(self._words[w.encode()], "<u4")
            text = "\n".join(lines)
        values = np.array(array("I", self._core.encode_ordinary(" ".join([*self._lines(text.lower()), "\n "]))), "<u4")
        ends = np.flatnonzero(values == self._line_end)
        counts = np.diff(ends, prepend=-1) - 1
        values = np.delete(values, ends)
        if other:
            at, sizes = np.array([*other]), np.array([len(x) for x in other.values()])
            values = np.insert(values, np.repeat(ends[at] - at, sizes), np.concatenate([*other.values()]))
            counts[at] = sizes
        return values, counts

    def _encode_span(self, raw: bytes) -> bytes:
        if self._plain is None:
            return self._encode_word(raw)
        words = raw.split()
        if sum(map(len, words)) + 64 * len(words) > 1 << 28:  # a huge text: bounded slices of its words
            return b"".join(b"".join(map(self._words.__getitem__, words[i : i + 100_000])) for i in range(0, len(words), 100_000))
        return b"".join(map(self._words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False)."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self._token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable, else a code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _body(token: str, suffix: str) -> tuple[str, bool]:
    ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
    return (token[: -len(suffix)], True) if ends else (token, False)


def inside_pairs(vocab: dict[str, int], suffix: str, to_byte: dict[str, int]) -> bytearray:
    """Which pairs of neighbouring bytes (first * 256 + second) occur inside some vocabulary token."""
    inside = bytearray(1 << 16)
    for token in vocab:
        body = bytes(to_byte[c] for c in _body(token, suffix)[0])
        for a, b in zip(body, body[1:], strict=False):
            inside[a << 8 | b] = 1
    return inside


def _core(model: dict, suffix: str, to_byte: dict[str, int], end: bytes):
    """The merge loop as native code: for one fragment, or for all pieces of a text that a space ends.

    Ids follow the order of merges (checked), so a token's id is its merge rank. A word's end is
    written as a byte that no word holds; the end form of each single byte has a lower id than
    any merge and is thus formed first.
    """
    import tiktoken

    vocab = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = [vocab[a + b] for a, b in merges]
    if order != sorted(order) or len(set(order)) != len(order) or (order and min(order) < len(vocab) - len(order)):
        raise ValueError("this vocabulary's ids don't follow its merges")
    ranks: dict[bytes, int] = {}
    for token, i in vocab.items():
        body, ends = _body(token, suffix)
        ranks[bytes(to_byte[c] for c in body) + (end if ends else b"")] = i
    return tiktoken.Encoding("forced_boundary", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})._core_bpe


def _is_word_shape(spec: dict) -> bool:
    """Whether white space always separates pre-tokens and is itself dropped, and case is folded."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    want = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return first.get("pattern", {}).get("Regex") == want and first.get("invert") is True and first.get("behavior") == "Removed" and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]


def encoder(path: str) -> ForcedBoundaryBPE:
    """The worker's encoder for a vocabulary file; it and its memos outlive a task, up to one that asks for none."""
    return held_over(f"encoder {path}", lambda: ForcedBoundaryBPE(path))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded when with_ids).

    One narrow pass: no shuffle, each Arrow batch is encoded and decoded on its own.
    """
    prepare(df.sparkSession)
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        n, a, b, ids_out, decoded_out = [], [], [], [], []
        for ids in bpe.encode_all(batch.column("__text")):
            decoded = bpe.decode(ids)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                ids_out.append(np.frombuffer(ids, "<u4").astype("i8").tolist())
                decoded_out.append(decoded.decode())
        out = [batch.column("__id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            out += [pa.array(ids_out, pa.list_(pa.int64())), pa.array(decoded_out)]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(out, names)

    return map_batches(df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), run, schema)
