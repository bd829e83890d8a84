"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that the worker has not met lie as byte symbols in one flat array. A round
finds the rank of each new neighbour pair by binary search over the sorted pair keys, takes the
lowest rank of each word, and merges that pair wherever it stands in its word; words without a
mergeable pair leave the array. Token ids of a batch are gathered from the words' ids, and
decoding gathers the tokens' bytes.

Defined results: null and empty texts have no tokens and decode to the empty text. The special
token's string inside a text is the special token, as the library takes it by default. Texts are
worked on whole; a single word of any length is one run of the array.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

#: Fixed: the pattern of this family of vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CHUNK_CHARS = 2_000_000   # texts that are encoded at once (one text at least)
CACHE_WORDS = 600_000     # words whose ids a worker keeps
LOW = 0x250               # texts of letters below this are split by a faster pattern of the same meaning
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def low_splitter() -> re.Pattern:
    """PATTERN for texts of letters below LOW, with the classes written out."""
    letters, numbers = ("".join(re.escape(chr(c)) for c in range(LOW) if unicodedata.category(chr(c))[0] == kind)
                        for kind in "LN")
    space = r"\t-\r \x85\xa0"
    return re.compile(rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letters}{numbers}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


class ByteBpe:
    """A byte-level BPE vocabulary read from its .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.base = size
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        token = [b""] * size
        for piece, i in vocab.items():
            token[i] = bytes(letters[c] for c in piece) if piece not in self.special else b""
        for content, i in self.special.items():
            token[i] = content.encode()
        self.token_starts = np.concatenate(([0], np.cumsum([len(t) for t in token])))
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.split_low, self.split_any = low_splitter().findall, regex.compile(PATTERN).findall
        self.high = re.compile(f"[^\0-{chr(LOW - 1)}]").search
        specials = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.at_special = regex.compile(f"({specials})").split if specials else None
        self._forget()

    def _forget(self) -> None:
        """Empty cache: words and, as one flat array with starts, their ids."""
        self.index: dict[str, int] = {}
        self.flat, self.starts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for word, i in self.special.items():
            self._keep([f"\0special:{word}"], np.array([i], np.int64), np.array([1]))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.index)
        self.index.update(zip(words, range(at, at + len(words))))
        self.starts.append(self.starts[-1][-1] + np.cumsum(sizes))
        self.flat.append(ids)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of ``words`` (none empty) and the number of tokens of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), NONE)  # of the pair that begins here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            if (low == NONE).any():
                stay = np.repeat(low != NONE, length)
                done_sym.append(sym[~stay])
                done_word.append(word[~stay])
                low, length = low[low != NONE], length[low != NONE]
                sym, word, rank = sym[stay], word[stay], rank[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            # of a run of overlapping hits (a a a) every second one merges, from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols stand afterwards
            sym, word, rank = sym[keep], word[keep], rank[keep]
            anew = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            pair = anew[anew < len(sym) - 1]
            rank[anew] = NONE
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self._rank(sym[pair], sym[pair + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.high(text) else self.split_low(text)

    def _words(self, text: str) -> list[str]:
        if not self.at_special or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.at_special(text):
            out += [f"\0special:{part}"] if part in self.special else self.split(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of ``texts`` and the number of tokens of each."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        each = [self._words(t) for t in texts]
        words = list(chain.from_iterable(each))
        spots = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(spots < 0)
        if len(unmet):
            late = [words[i] for i in unmet.tolist()]
            fresh = list(dict.fromkeys(late))
            self._keep(fresh, *self.merge([w.encode("utf-8", "surrogatepass") for w in fresh]))
            spots[unmet] = np.fromiter(map(self.index.__getitem__, late), np.int64, len(late))
        self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        ids, sizes = gather(self.flat[0], self.starts[0], spots)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(w) for w in each])))]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> str:
        flat, _ = gather(self.token_bytes, self.token_starts, ids)
        return flat.tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``which`` of ``flat`` (piece i lies from starts[i] to starts[i + 1]) one after
    another, and their sizes."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - sizes), sizes)
    return flat[spots], sizes


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of ``texts`` of about CHUNK_CHARS characters."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= CHUNK_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def add_tokens(docs: DataFrame, path: str, text_col: str = "text", ids: str | None = "ids",
               decoded: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` plus ``n_tokens`` and, as asked for, the token ids, the decoded text, and SHA-256
    digests of the ids (little-endian unsigned 32 bits) and of the decoded text. ``path`` is that
    of the vocabulary file on every executor. No shuffle."""
    new: dict[str, T.DataType] = {"n_tokens": T.LongType()}
    new |= {ids: T.ArrayType(T.IntegerType(), False)} if ids else {}
    new |= {decoded: T.StringType()} if decoded else {}
    new |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {}

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = vocabulary(path)
        out: dict[str, list] = {n: [] for n in new}
        for part in chunks(texts_of(b.column(0))):
            flat, sizes = bpe.encode(part)
            ends = np.cumsum(sizes)
            for a, z in zip((ends - sizes).tolist(), ends.tolist()):
                own = flat[a:z]
                out["n_tokens"].append(z - a)
                if ids:
                    out[ids].append(own.astype(np.int32))
                if decoded or digests:
                    back = bpe.decode(own)
                    if decoded:
                        out[decoded].append(back)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        schema = {"n_tokens": pa.int64(), ids: pa.list_(pa.field("element", pa.int32(), False))}
        return {n: pa.array(v, schema.get(n, pa.string())) for n, v in out.items()}

    return append_columns(docs, run, new, {"text": text_col})
