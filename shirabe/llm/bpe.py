"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is halved, at whatever character that falls on, down to leaves of at most `LEAF_CHARS`. The leaves of all
texts of a slice are encoded side by side with its short texts: cut where the tokenizer's own pattern always cuts (a
single space between visible characters), each different piece encoded once, ids dealt back by position. Then
neighbours are joined bottom-up: a window around the join is encoded again and grows until both of its edges agree
exactly with what stands beside it. An edge of a window of text agrees where the pattern cuts whatever stands around it
and where both encodings begin a token. A piece that the pattern cuts nowhere is halved the same way, by bytes, down to
`LEAF_BYTES`; there an edge agrees where the two tokens that meet stay apart.

Defined results: null text is the empty text and has no ids; empty and very long texts, repeated rows, repeated
or null doc_ids and empty tables are encoded row by row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import text_slices, texts_of

#: Fixed value: how byte-level BPE cuts text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the pattern cuts whatever stands around: before white space behind a visible character, and where letters, digits
#: and other visible characters meet.
SAFE_CUT = r"""(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"""
#: The longest leaves of a text and of a piece, and the characters on both sides of a join that a window begins with.
LEAF_CHARS, LEAF_BYTES, WINDOW = 4096, 512, 64
#: Bytes of text whose different pieces are encoded together.
BPE_SLICE_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


def _check_file(spec: dict, path: str) -> None:
    """Refuse what this module would encode otherwise than the library."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError(f"ids do not follow the order of merges: {path}")


class Bpe:
    """A vocabulary file of the tokenizers library, read as bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        _check_file(spec, path)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = special
        self.split_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        size = max([*ranks.values(), *special.values()]) + 1
        table = [b""] * size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            table[i] = token
        self.tokens = table
        self.token_array = pa.array(table, pa.large_binary())
        self.opens = np.array([t[:1] == b" " for t in table])
        self.sizes = np.array([len(t) for t in table], np.int64)
        self._pair_ok: dict[tuple[int, int], bool] = {}
        self.cut, self.safe = regex.compile(PATTERN), regex.compile(SAFE_CUT)
        #: Without such a run no piece is longer than LEAF_BYTES (a code point has four bytes at most, a piece one blank more).
        self.run = re.compile(rf"\S{{{LEAF_BYTES // 4}}}|\s{{{LEAF_BYTES // 4}}}")
        #: Texts' and pieces' joins made so far, and the characters of text encoded again for them.
        self.text_joins = self.piece_joins = self.again = 0

    # one piece that the pattern does not cut

    def _whole(self, piece: bytes) -> list[int]:
        return self.core.encode_single_piece(piece) if piece else []

    def _agree(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes meet; BPE is exact where all neighbours do."""
        ok = self._pair_ok.get((a, b))
        if ok is None:
            if len(self._pair_ok) > 200_000:
                self._pair_ok.clear()
            ok = self._pair_ok[a, b] = self._whole(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes: encode a growing window again until both of its edges agree."""
        if not left or not right or self._agree(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            inner = self._whole(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._agree(left[i - 1], inner[0])) and (j == len(right) or self._agree(inner[-1], right[j])):
                return left[:i] + inner + right[j:]
            width *= 2

    def encode_long(self, piece: bytes) -> list[int]:
        """A piece of any length by tree concatenation; halves keep whole code points' bytes wherever they fall."""
        spans = [piece]
        while len(spans[0]) > LEAF_BYTES:
            spans = [half for s in spans for half in (s[: len(s) // 2], s[len(s) // 2 :]) if half]
        leaves = [self._whole(s) for s in spans]
        while len(leaves) > 1:
            self.piece_joins += len(leaves) // 2
            leaves = [self.join(leaves[i], leaves[i + 1] if i + 1 < len(leaves) else []) for i in range(0, len(leaves), 2)]
        return leaves[0]

    # a text by its halves

    def join_texts(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """The encoding of two neighbouring texts (text, ids), by a growing window around the join."""
        (a, ids_a), (b, ids_b) = left, right
        self.text_joins += 1
        text, ends_a, ends_b, width = a + b, None, None, WINDOW
        while True:
            # the last place in a, and the first in b, at least width away, where the pattern always cuts
            low, high = max(0, len(a) - width), min(len(b), width)
            start = max((m.start() for m in self.safe.finditer(text, max(0, low - width), low + 1)), default=0) if low else 0
            if not start and low > width:
                width *= 2
                continue
            m = self.safe.search(text, len(a) + high) if high < len(b) else None
            stop = m.start() if m else len(text)
            inner = self._plain(text[start:stop])
            ends_a = np.cumsum(self.sizes[ids_a]) if ends_a is None else ends_a
            ends_b = np.cumsum(self.sizes[ids_b]) if ends_b is None else ends_b
            i = self._token_at(ends_a, len(a[:start].encode()))
            j = self._token_at(ends_b, len(b[: stop - len(a)].encode()))
            self.again += stop - start
            if i is not None and j is not None:
                return text, np.concatenate([ids_a[:i], np.array(inner, np.uint32), ids_b[j:]])
            width *= 2

    @staticmethod
    def _token_at(ends: np.ndarray, at: int) -> int | None:
        """How many tokens end at a byte, if one does."""
        if not at:
            return 0
        i = int(np.searchsorted(ends, at))
        return i + 1 if i < len(ends) and ends[i] == at else None

    @staticmethod
    def halves(text: str) -> list[str]:
        """Leaves of a long text, in order; 2^k of them."""
        spans = [text]
        while len(spans[0]) > LEAF_CHARS:
            spans = [half for s in spans for half in (s[: len(s) // 2], s[len(s) // 2 :])]
        return spans

    # texts

    def encode_text(self, text: str) -> np.ndarray:
        """Any text, with special tokens' strings as their ids."""
        out: list[int] = []
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            out += self._halved(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return np.array(out + self._halved(text[at:]), np.uint32)

    def _halved(self, text: str) -> list[int]:
        """Text between special tokens' strings, by tree concatenation if it is long."""
        if len(text) <= LEAF_CHARS:
            return self._plain(text)
        parts = [(s, np.array(self._plain(s), np.uint32)) for s in self.halves(text)]
        while len(parts) > 1:
            parts = [self.join_texts(parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]
        return parts[0][1].tolist()

    def _plain(self, text: str) -> list[int]:
        """Text without special tokens' strings."""
        if len(text) <= LEAF_BYTES or not self.run.search(text):  # every piece is short
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.cut.finditer(text):
            out += self.encode_long(m[0].encode())
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and where each text's ids begin and end; long texts by tree concatenation."""
        long = pc.greater(pc.utf8_length(texts), LEAF_CHARS)
        for s in self.special:
            long = pc.and_not(long, pc.match_substring(texts, s))
        rows = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        if not len(rows):
            return self._encode_short(texts)
        spans = [self.halves(texts[int(i)].as_py()) for i in rows]
        count = np.ones(len(texts), np.int64)
        count[rows] = [len(x) for x in spans]
        first = np.cumsum(count) - count
        short = pa.concat_arrays([x for i, own in zip([-1, *rows[:-1].tolist()], range(len(rows)), strict=True) for x in (texts.slice(i + 1, int(rows[own]) - i - 1), pa.array(spans[own], pa.string()))] + [texts.slice(int(rows[-1]) + 1)])
        ids, ends = self._encode_short(short)
        out, total, at = [], np.diff(ends[np.concatenate([first, [len(short)]])]), 0
        for i, own in zip(rows.tolist(), spans, strict=True):
            f = int(first[i])
            parts = [(s, ids[ends[f + k] : ends[f + k + 1]]) for k, s in enumerate(own)]
            while len(parts) > 1:
                parts = [self.join_texts(parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]
            out += [ids[at : ends[f]], parts[0][1]]
            total[i], at = len(parts[0][1]), ends[f + len(own)]
        return np.concatenate([*out, ids[at:]]), np.concatenate([[0], np.cumsum(total)]).astype(np.int64)

    def _encode_short(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy().astype(np.int64)
        pieces = parts.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        coded = pieces.dictionary_encode()
        values, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        odd_value = np.asarray(pc.or_(pc.or_(pc.equal(values, ""), pc.match_substring_regex(values, r"^[\s\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{206f}\x{3000}\x{feff}]|[\s\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{206f}\x{3000}\x{feff}]$")), pc.greater(pc.binary_length(values), LEAF_BYTES)).to_numpy(zero_copy_only=False))
        for s in self.special:
            odd_value |= pc.match_substring(values, s).to_numpy(zero_copy_only=False)
        first = np.zeros(len(index), bool)
        first[ends[:-1][np.diff(ends) > 0]] = True
        odd_text = np.zeros(n, bool)
        if odd_value.any() and len(index):
            owner = np.repeat(np.arange(n), np.diff(ends))
            odd_text[owner[odd_value[index]]] = True
        # different pieces, each behind the space that stands before it in the text
        plain = np.flatnonzero(~odd_value)
        one = pa.concat_arrays([values.take(pa.array(plain)).cast(pa.string())])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one), " ")[0].as_py()
        ids = np.frombuffer(self.core.encode_to_tiktoken_buffer(" " + joined, set()), np.uint32) if len(one) else np.zeros(0, np.uint32)
        begins = np.concatenate([np.flatnonzero(self.opens[ids]), [len(ids)]])
        if len(begins) != len(one) + 1:  # should a piece be cut inside, each text goes by itself
            each = [self.encode_text(t) for t in texts.to_pylist()]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int64)
        begin, length = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        begin[plain], length[plain] = begins[:-1], np.diff(begins)
        # a text's first piece has no space before it; odd texts go by themselves
        own: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd_text):
            own[int(i)] = self.encode_text(texts[int(i)].as_py())
        heads = np.flatnonzero(first & ~odd_value[index]) if len(index) else np.zeros(0, np.int64)
        head_ids = [self.core.encode_ordinary(x) for x in pieces.take(pa.array(heads)).to_pylist()]
        pool = [ids, *(np.array(x, np.uint32) for x in head_ids)]
        at = len(ids) + np.concatenate([[0], np.cumsum([len(x) for x in head_ids], dtype=np.int64)]).astype(np.int64)
        b, w = begin[index], length[index]
        b[heads], w[heads] = at[:-1], np.diff(at)
        if own:
            w[odd_text[np.repeat(np.arange(n), np.diff(ends))]] = 0
            rows = sorted(own)
            # an odd text's ids stand at its first piece (every text has one at least, the empty one too)
            at2 = at[-1] + np.concatenate([[0], np.cumsum([len(own[i]) for i in rows], dtype=np.int64)]).astype(np.int64)
            pool += [own[i] for i in rows]
            b[ends[rows]], w[ends[rows]] = at2[:-1], np.diff(at2)
        flat = np.concatenate(pool)
        total = np.concatenate([[0], np.cumsum(w)]).astype(np.int64)
        out = flat[np.arange(total[-1]) + np.repeat(b - total[:-1], w)]
        return out, total[ends]

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's bytes; bytes that are not UTF-8 become U+FFFD as in the library."""
        joined = self.token_array.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1]
        data = memoryview(joined.buffers()[2]) if len(ids) and joined.buffers()[2] is not None else memoryview(b"")
        out = []
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            raw = bytes(data[at[a] : at[z]]) if len(ids) else b""
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in text_slices(batches, max_bytes=BPE_SLICE_BYTES):
            ids, ends = bpe.encode_column(texts_of(part))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each list of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in batches:
            lists = [x or [] for x in part.column("ids").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.record_batch([part.column("doc_id"), pa.array([x.decode() for x in bpe.decode_column(flat, ends)], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in text_slices(batches, max_bytes=BPE_SLICE_BYTES):
            ids, ends = bpe.encode_column(texts_of(part))
            little = ids.astype("<u4", copy=False)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(little[a:z]).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decode_column(ids, ends)], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
