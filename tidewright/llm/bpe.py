"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts each text into chunks where its content says so, so that shared passages give equal chunks whatever stands before them.
A chunk's core reaches from its first to its last safe point and is encoded once for all texts of a task that share it (in a cache of bounded bytes). What
lies between two cores, the join, is encoded by itself as a first guess, and then repaired: it is encoded again together with the end of the core before
and the begin of the core after it, and where the ids don't agree on both sides, with wider and wider ones, at last with both cores as a whole, whose ids
then stand. A safe point lies between a printable ASCII character and the white space after it: no pre-token spans it, no pre-token after it looks back,
and the look-ahead of none before it reaches it. The ends that are encoded again begin and end at safe points, so agreement proves the joined ids right
wherever the chunks were cut.

Ids equal those of the tokenizers library. A merge list in rank order is also run by tiktoken, which is faster; texts with other than Latin letters, ASCII
and common punctuation, with a special token or of great length are left to the tokenizers library itself.

Defined cases: null is the empty text, which has no tokens. Bytes that aren't UTF-8 count as U+FFFD. Every row has its own result, repeated ones too.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .textsets import _BYTE, SLICE, powers, tidy

AVERAGE_BITS, REACH = 10, 24  # chunks of about 1 KB; bytes that the rolling hash looks back
CACHE_BYTES, LONGEST, CONTEXT = 16 << 20, 65_536, 16
#: Characters on which both libraries have the same classes.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")
_U = np.uint64


class Coder:
    """Encodes and decodes whole texts with one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        plain = {t: bytes(to_byte[c] for c in t) for t in vocab if all(c in to_byte for c in t)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: Added tokens that hold or take white space: a text with one of them is not cut.
        self.spaced = [t["content"].encode() for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t["content"] != "".join(t["content"].split())]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.piece = [b""] * size
        for t, b in plain.items():
            self.piece[vocab[t]] = b
        for t in spec.get("added_tokens", []):
            self.piece[t["id"]] = t["content"].encode()
        self.digits = [str(i) for i in range(size)]
        self.fast = self._tiktoken(spec, plain)
        self.length = [len(p) for p in self.piece]
        self.cache: dict[bytes, array] = {}
        self.held = 0

    def _tiktoken(self, spec: dict, plain: dict[str, bytes]):
        """The same merges in tiktoken, if ids are in the order of merges; else None."""
        vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor") or len(plain) != len(vocab):
            return None
        if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokenizer's public pattern
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: vocab[t] for t, b in plain.items()}, special_tokens={})

    def ids(self, part: bytes) -> list[int]:
        text = part.decode("utf-8", "replace")
        if self.fast is None or len(text) > LONGEST or any(s in text for s in self.special) or _OTHER.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def core(self, core: bytes) -> array:
        """The ids of a chunk's core, from the cache if a text of this task had it."""
        got = self.cache.get(core)
        if got is None:
            got = array("I", self.ids(core))
            if len(core) <= LONGEST:
                self.held += 300 + len(core) + 4 * len(got)
                if self.held > CACHE_BYTES:
                    self.cache.clear()
                    self.held = 0
                self.cache[core] = got
        return got

    def parts(self, text: bytes) -> list[tuple[bytes, bool]]:
        """The cores (True) and joins (False) of a text, in order."""
        cuts = chunk_cuts(text)
        if not len(cuts) or any(s in text for s in self.spaced):
            return [(text, True)] if text else []
        buf = np.frombuffer(text, np.uint8)
        solid, space = (buf[:-1] > 0x20) & (buf[:-1] < 0x7F), (buf[1:] == 0x20) | ((buf[1:] >= 0x09) & (buf[1:] <= 0x0D))
        safe = np.flatnonzero(solid & space) + 1
        edges = np.concatenate([[0], cuts, [len(text)]])
        low, high = np.searchsorted(safe, edges[:-1]), np.searchsorted(safe, edges[1:]) - 1
        out, at = [], 0
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if a < b:  # two safe points at least: a core of its own
                a, b = int(safe[a]), int(safe[b])
                if at < a:
                    out.append((text[at:a], False))
                out.append((text[a:b], True))
                at = b
        if at < len(text):
            out.append((text[at:], not out))
        return out

    def repaired(self, text: bytes) -> Iterator[tuple[bytes, array]]:
        """The parts of a text with their ids, joins repaired; the ids of all, one after another, are the text's."""
        parts = self.parts(text)
        left: tuple[bytes, array] | None = None
        k = 0
        while k < len(parts):
            part, is_core = parts[k]
            k += 1
            if is_core and left is None:
                left = part, self.core(part)
                continue
            if is_core:  # two cores that touch: an empty join
                part, k = b"", k - 1
            right = (parts[k][0], self.core(parts[k][0])) if k < len(parts) else (b"", array("I"))
            before, after = left or (b"", array("I"))
            ids, whole = self._join((before, after), part, right)
            if whole:  # the sides never agreed: all three parts are one
                left, k = (before + part + right[0], ids), k + 1
                continue
            if left is not None:
                yield left
            if part:
                yield part, ids
            left = right if right[0] else None
            k += 1
        if left is not None:
            yield left

    def _join(self, left: tuple[bytes, array], join: bytes, right: tuple[bytes, array]) -> tuple[array, bool]:
        """The ids of join between two parts, or those of all three (True) where the parts' own ids don't hold."""
        own = array("I", self.ids(join)) if join else array("I")
        reach = CONTEXT
        while True:
            a, a_ids = self._end(*left, reach)
            b, b_ids = self._begin(*right, reach)
            both = array("I", self.ids(a + join + b))
            if both == a_ids + own + b_ids:
                return own, False
            if len(a) == len(left[0]) and len(b) == len(right[0]):
                return both, True
            reach *= 4

    def _end(self, part: bytes, ids: array, reach: int) -> tuple[bytes, array]:
        """The last reach bytes of a part or some more, back to a safe point where its ids part too, and their ids."""
        at = len(part) - reach
        while at > 0:
            at = part.rfind(b" ", 0, at)
            if at <= 0:
                break
            if 0x20 < part[at - 1] < 0x7F:
                k, size = len(ids), len(part) - at
                while size > 0:
                    k -= 1
                    size -= self.length[ids[k]]
                if size == 0:
                    return part[at:], ids[k:]
        return part, ids

    def _begin(self, part: bytes, ids: array, reach: int) -> tuple[bytes, array]:
        """The first reach bytes of a part or some more, up to a safe point where its ids part too, and their ids."""
        at = reach - 1
        while 0 <= (at := part.find(b" ", at + 1)):
            if at and 0x20 < part[at - 1] < 0x7F:
                k, size = 0, at
                while size > 0:
                    size -= self.length[ids[k]]
                    k += 1
                if size == 0:
                    return part[:at], ids[:k]
        return part, ids

    def both_ways(self, text: bytes) -> tuple[int, str, str]:
        """n_tokens, and SHA-256 of the ids and of the decoded text."""
        n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for _, ids in self.repaired(text):
            ids_hash.update((("," if n else "") + ",".join([self.digits[i] for i in ids])).encode())
            text_hash.update(decoder.decode(b"".join([self.piece[i] for i in ids])).encode())
            n += len(ids)
        text_hash.update(decoder.decode(b"", True).encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.repaired(text.encode()) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.piece[i] for i in ids]).decode("utf-8", "replace")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def chunk_cuts(text: bytes) -> np.ndarray:
    """Where the hash of the REACH bytes before a character has AVERAGE_BITS zero bits on top."""
    n = len(text)
    if n <= REACH:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(text, np.uint8)
    up, down = powers()
    found = []
    for at in range(0, n - REACH, SLICE):
        part = buf[at : at + SLICE + REACH]
        total = np.cumsum(_BYTE[part] * up[: len(part)])
        window = (total[REACH:] - total[:-REACH]) * down[1 : len(part) - REACH + 1]
        window = (window ^ (window >> _U(31))) * _U(0x9E3779B97F4A7C15)
        found.append(np.flatnonzero(window >> _U(64 - AVERAGE_BITS) == 0) + at + REACH + 1)
    at = np.concatenate(found)
    at = at[at < n]
    return at[(buf[at] & 0xC0) != 0x80]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of docs."""
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for part in parts:
            rows = [own.both_ways(t.decode("utf-8", "replace").encode()) for t in part.column(1).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with one more column, token_ids: array<int>; a column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        own = coder(path)
        return pa.array([own.encode(t.decode("utf-8", "replace")) for t in text.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn("token_ids", ids(text_of().cast("binary")))
