"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary of byte strings is written in the library's terms by mapping every byte to a printable
character. Texts are cut by the tokenizer's pattern; every distinct match of a batch is encoded once by the
library and remembered, within a bound, so that frequent words cost a lookup. Decoding goes back through
the byte table; characters that are split over several tokens come out whole because bytes, not characters,
are joined.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

#: Matches remembered with their ids before the memory is emptied.
REMEMBERED = 400_000
#: Longer words, and longer runs of blanks, are left to the library whose merges stay fast on them.
LONG = 2048
BLANKS = re.compile(rf"\s{{{LONG}}}")
#: Characters that are cut and looked up at a time.
CHUNK = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: what is left before its own rank applies."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        merged = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        at = merged.index(min(merged))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Encoder:
    """A byte-level BPE vocabulary: text to ids and ids to bytes."""

    def __init__(self, tokenizer: Tokenizer, tokens: dict[int, bytes], pattern: str, special: dict[str, int]):
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer, self.pattern, self.special = tokenizer, regex.compile(pattern), special
        self.apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.table = np.array(self.tokens, object)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.known: dict[str, bytes] = {}
        self.second: tiktoken.Encoding | None = None

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> Encoder:
        """From a rank file: one base64 token and its rank a line. There are no special tokens."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        name = lambda raw: "".join(chars[b] for b in raw)
        merges = [tuple(map(name, _halves(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges)
        return cls(Tokenizer(model), {r: t for t, r in ranks.items()}, pattern, {})

    @classmethod
    def from_json(cls, path: str, pattern: str) -> Encoder:
        """From a tokenizers file with a byte-level BPE model; its special tokens are found in texts."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {x["content"]: x["id"] for x in held["added_tokens"] if x["special"]}
        tokens = {i: bytes(byte[c] for c in t) for t, i in held["model"]["vocab"].items() if t not in special}
        tokens |= {i: t.encode() for t, i in special.items()}
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return cls(tokenizer, tokens, pattern, special)

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        new = [m for m in set(matches) if m not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = list(set(matches))
            for m, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.known[m] = np.array(found.ids, "<u4").tobytes()
        return self.known

    def _plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for n, text in enumerate(texts):
            held.append(self.pattern.findall(text))
            size += len(text)
            if size >= CHUNK or n == len(texts) - 1:
                known = self._learn([m for found in held for m in found])
                out += [b"".join(map(known.__getitem__, found)) for found in held]
                held, size = [], 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit numbers."""
        if self.apart is None:
            return self._plain(texts)
        found = [self.apart.split(t) if any(s in t for s in self.special) else [t] for t in texts]
        plain = iter(self._plain([p for parts in found for p in parts[::2]]))
        return [b"".join(self.special[p].to_bytes(4, "little") if i % 2 else next(plain) for i, p in enumerate(parts)) for parts in found]

    @staticmethod
    def _long(text: str) -> bool:
        return len(text) >= LONG and (max(map(len, text.split()), default=0) >= LONG or BLANKS.search(text) is not None)

    def encode_quick(self, texts: list[str]) -> list[bytes]:
        """The ids of :meth:`encode`, by a second library over the same vocabulary that costs half the time."""
        if self.second is None:
            tokens = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special.values()}
            self.second = tiktoken.Encoding("own", pat_str=self.pattern.pattern, mergeable_ranks=tokens, special_tokens=self.special)
        return [self.encode([t])[0] if self._long(t) else self.second.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, joined; an id outside the vocabulary is an error."""
        return b"".join(self.table[ids].tolist())

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token; a token that holds part of a character covers it whole."""
        ends = self.lengths[ids].cumsum()
        starts = ends - self.lengths[ids]
        number = (np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80).cumsum() - 1
        return number[starts], number[ends - 1] + 1


_LOADED: dict[tuple[str, str], Encoder] = {}


def loaded(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, kept by the Python worker."""
    if (path, pattern) not in _LOADED:
        make = Encoder.from_json if path.endswith(".json") else Encoder.from_ranks
        _LOADED[path, pattern] = make(path, pattern)
    return _LOADED[path, pattern]


def _lists(raws: list[bytes], kind: pa.DataType = pa.int32()) -> pa.Array:
    """Id arrays of many texts as one Arrow list column, without a Python object per id."""
    ends = np.cumsum([0, *(len(r) // 4 for r in raws)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4"), kind))


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column as an array; a null text counts as empty. ``path`` must be on every node."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(loaded(path, pattern).encode(["" if t is None else t for t in texts.to_pylist()]))

    return encode(text)


def encoded_spans(text: Column, path: str, pattern: str) -> Column:
    """A struct of arrays ``(ids, starts, ends)``: ids and the characters every token covers."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        encoder, whole = loaded(path, pattern), texts.fillna("").tolist()
        ids = [np.frombuffer(raw, "<u4").astype(np.int64) for raw in encoder.encode(whole)]
        spans = [encoder.spans(t, i) for t, i in zip(whole, ids)]
        return pd.DataFrame({"ids": ids, "starts": [s for s, _ in spans], "ends": [e for _, e in spans]})

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of an id array; null for null. Cast to string where the ids cover whole characters."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        encoder = loaded(path, pattern)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in lists)])
        return pa.array([encoder.decode(flat[a:b]) if x.is_valid else None for a, b, x in zip(ends, ends[1:], lists)], pa.binary())

    return decode(ids)
