"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

``BpeModel`` reads a vocabulary file of the ``tokenizers`` format. A word of the text is encoded without replaying the
merges: an Aho-Corasick automaton gives the longest token at each byte, tokens are laid left to right, and a token is
accepted only if the merge rules would keep the border to the token before it (the pair-compatibility test below); else
the next shorter token is tried and, when there is none, the token before is taken back and that border marked as dead.
Each border is marked dead at most once, so a word takes time linear in its length. The result is the one that merging
pairs in rank order gives.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text into words before the merges (published with the vocabulary).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in each half of the cache (about 100 MB a half).
CACHED_WORDS = 500_000
CACHED_CHARS = 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: bytes that print stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _little(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class BpeModel:
    """Inner ids are ranks: 0-255 the bytes, then a token for each merge in order; ``public_id`` maps them to the ids of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if any(c not in vocab for c in alphabet):
            raise ValueError("the vocabulary has no token for some byte")
        spell = {c: i for i, c in enumerate(alphabet)}
        tokens = [bytes([b]) for b in range(256)]
        names = list(alphabet)
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, name = (spell[left], spell[right]), left + right
            if name in spell:
                raise ValueError(f"two merges make {name!r}")
            spell[name] = self.merged[pair] = len(tokens)
            self.halves.append(pair)
            tokens.append(tokens[pair[0]] + tokens[pair[1]])
            names.append(name)
        self.tokens = tokens
        self.public_id = [vocab[n] for n in names]
        by_bytes = {t: i for i, t in enumerate(tokens)}
        self.shorter = [next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1) for t in tokens]
        self.lengths = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.words = regex.compile(WORDS)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_at = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        size = max([*self.public_id, *self.added.values()]) + 1
        spelled = [b""] * size
        for name, i in vocab.items():
            spelled[i] = bytes(to_byte[c] for c in name)
        for i, t in zip(self.public_id, tokens):
            spelled[i] = t
        for content, i in self.added.items():
            spelled[i] = content.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in spelled], out=self.offsets[1:])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.packed = [int(i).to_bytes(4, "little") for i in self.public_id]
        self._ranked = None
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps a border between these neighbours: walk down both sides of the border, newest half first; a pair that some merge joins earlier than either side was made would have crossed it."""
        limit = len(self.tokens)
        merged, halves = self.merged, self.halves
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit, left = left, halves[left][1]
            else:
                if right < 256:
                    if left < 256:
                        return True
                    limit, left = left, halves[left][1]
                    continue
                limit, right = right + 1, halves[right][0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ranks of one word."""
        n, text = len(data), data.decode("latin-1")
        longest, lengths, shorter = [-1] * n, self.lengths, self.shorter
        for end, t in self.automaton.iter(text):  # ends rise, so the longest token at a start comes last
            longest[end + 1 - lengths[t]] = t
        if longest[0] >= 0 and lengths[longest[0]] == n:
            return [longest[0]]
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n or token >= 0:
            if at == n:
                break
            end = at + lengths[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:  # no token fits here: the border is dead, take back the token before it
                open_at[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token] if not open_at[at + lengths[token]] else token
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a word that the newer half of the cache lacks; when that is full it becomes the older half, so that frequent words stay."""
        packed = self._older.get(word)
        if packed is None:
            data, spelled = word.encode("utf-8", "surrogatepass"), self.packed
            packed = b"".join([spelled[t] for t in self.encode_bytes(data)])
        if len(word) <= CACHED_CHARS:
            if len(self._cache) >= CACHED_WORDS:
                self._older, self._cache = self._cache, {}
            self._cache[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        get = self._cache.get
        return b"".join([get(w) or self._word(w) for w in self.words.findall(text)])

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.added_at is None or not any(c in text for c in self.added):
            return self._plain(text)
        return b"".join(np.uint32(self.added[part]).astype("<u4").tobytes() if k % 2 else self._plain(part) for k, part in enumerate(self.added_at.split(text)) if part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def ranked(self, text: str) -> bytes:
        """As encode_packed(), by the ``tiktoken`` library on this vocabulary's ranks: the same ids (the tests compare them over all of Unicode), in less time where few words repeat."""
        if self._ranked is None:
            self._ranked = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=dict(zip(self.tokens, self.public_id)), special_tokens={})
        if self.added_at is None or not any(c in text for c in self.added):
            return _little(self._ranked.encode_ordinary(text))
        return b"".join(_little([self.added[part]] if k % 2 else self._ranked.encode_ordinary(part)) for k, part in enumerate(self.added_at.split(text)) if part)

    def decode_bytes(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        """The bytes of ids: each id's span of the spelled-out vocabulary, copied in blocks so that memory stays bounded."""
        out = []
        for k in range(0, len(ids), block):
            start, size = self.offsets[ids[k : k + block]], self.offsets[ids[k : k + block] + 1] - self.offsets[ids[k : k + block]]
            ends = np.cumsum(size)
            out.append(self.spelled[np.repeat(start - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int): the token ids of each whole text.

    A null text counts as empty and has no ids. Every row gives one row, repeated ids too. Other columns of ``df`` are
    not carried, whatever their names. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = model(path)
        for b in batches:
            packed = [bpe.encode_packed(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``text``: the text of each id list; null or empty lists give the empty text, bytes that are no UTF-8 give U+FFFD."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = model(path)
        for b in batches:
            ids = b.column(1)
            texts = [bpe.decode(np.asarray(ids[k].values)) if ids[k].is_valid and len(ids[k].values) else "" for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: digests of what encoding and then decoding give, in one pass, without carrying the ids between stages.

    Nulls and repeated rows as in encode(); an empty text has 0 tokens and the digests of the empty string.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = model(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = np.frombuffer(bpe.encode_packed(t or ""), "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
