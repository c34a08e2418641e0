"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A byte-level model works on characters that stand for bytes: ``byte_alphabet``
maps each of the 256 byte values to a printable character and back. A file of
ranks becomes a tokenizers model here: a token's merges are all its splits into
two tokens, in rank order. A ``tokenizers`` JSON file is used as it is.

Texts are split by the public pattern and each match is encoded by itself, so
equal matches have equal ids. Each worker therefore keeps the ids of recent
matches in a table of bounded size (two generations of ``CACHE_WORDS``), and the
library encodes only what the table lacks. Splitting uses ``re`` with classes
built from the Unicode data of this Python; a text with an unassigned code point
goes through the library's own splitter as a whole.

Decoding maps ids to bytes by the reversed alphabet. A character may be split
over tokens: ``decode_pieces`` holds its bytes back until the last one arrives,
and ``offsets`` gives both tokens the same character.

Defined cases: null text is encoded as the empty text, with no ids. Rows keep
their doc_id, null or repeated. Special tokens' strings are ordinary text. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, on_workers, text_of

CACHE_WORDS = 250_000
LONG_WORD = 64  # longer matches are not kept in the table


def byte_alphabet() -> list[str]:
    """The printable character of each byte value: itself where printable in Latin-1, else the next code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


@lru_cache(1)
def split_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """The public split pattern for texts of the basic plane and for others, each with a search for what it can't split.

    ``re`` tests a class of the basic plane in one step, but goes through the
    ranges beyond it one by one.
    """
    spaces = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    out: list[re.Pattern] = []
    for top in (0xFFFF, sys.maxunicode):
        groups: dict[str, list[list[int]]] = {"L": [], "N": [], "C": []}
        for c in range(top + 1):
            kind = unicodedata.category(chr(c))
            key = kind[0] if kind[0] in "LN" else "C" if kind in ("Cn", "Cs") else None
            if key:
                runs = groups[key]
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        cls = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in groups.items()}
        letters, digits = cls["L"], cls["N"]
        out.append(re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"))
        out.append(re.compile(f"[{cls['C']}]" if top == sys.maxunicode else f"[{cls['C']}\U00010000-\U0010ffff]"))
    return tuple(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers model with the ids and merges that the ranks define."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_alphabet()
    show = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(show[t[:i]], show[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={show[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok


class Codec:
    """One vocabulary: text to ids and back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.tok = Tokenizer.from_file(path)
        else:
            import public_tokenizers

            self.tok = tokenizer_from_ranks(load_ranks(path), public_tokenizers.PATTERN)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        chars = byte_alphabet()
        self.show = {b: chars[b] for b in range(256)}
        back = {c: b for b, c in enumerate(chars)}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.lengths = np.asarray([len(b) for b in self.bytes_of], np.int64)
        self.basic, self.not_basic, self.full, self.unknown = split_patterns()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            mapped = word.encode().decode("latin-1").translate(self.show)
            found = np.asarray([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(word) <= LONG_WORD:
            if len(self.new) >= CACHE_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        split = self.basic
        if not text.isascii() and self.not_basic.search(text):
            if self.unknown.search(text):
                return self._whole(text)
            split = self.full
        words = split.findall(text)
        parts = list(map(self.new.get, words))
        if None in parts:
            word = self._word
            parts = [word(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_pieces(self, ids) -> list[str]:
        """Text of each token; a token that ends inside a character gives it to the token that completes it."""
        import codecs

        feed = codecs.getincrementaldecoder("utf-8")("replace")
        out = [feed.decode(self.bytes_of[i]) for i in ids]
        rest = feed.decode(b"", final=True)
        if rest and out:
            out[-1] += rest
        return out

    def spans(self, ids) -> tuple[np.ndarray, np.ndarray, int]:
        """(starts, ends, split): code point range of each token, and how many token ends lie inside a character. Tokens that share a split character share its position."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
        raw = np.frombuffer(self.decode_bytes(ids.tolist()), dtype=np.uint8)
        inside = (raw & 0xC0) == 0x80
        char = np.cumsum(~inside) - 1  # character that each byte belongs to
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate([[0], ends[:-1]])
        return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32), int(inside[ends[:-1]].sum())

    def offsets(self, ids) -> list[tuple[int, int]]:
        starts, ends, _ = self.spans(ids)
        return list(zip(starts.tolist(), ends.tolist(), strict=True))

    def decode(self, ids) -> str:
        """The text: bytes are joined before they are read as UTF-8, so split characters come together; what is no UTF-8 becomes the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, with_offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, offsets array<struct<start,end>>]) of every whole text."""
    arrow_rows(docs.sparkSession)
    on_workers(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + ([("offsets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if with_offsets else []))

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if with_offsets:
                cols.append(pa.array([[{"start": a, "end": b} for a, b in c.offsets(x)] for x in ids], kind.field(2).type))
            yield pa.RecordBatch.from_arrays(cols, schema=kind)

    more = ", offsets array<struct<start:int,end:int>>" if with_offsets else ""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, f"doc_id long, ids array<int>{more}")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text, bytes that are no UTF-8 the replacement character."""
    arrow_rows(encoded.sparkSession)
    on_workers(encoded.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=kind)

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, offsets_sha256: encode every text, decode its ids and place them in the text, in one pass.

    n_split counts token ends inside a character; offsets_sha256 is of the starts, then the ends, as little-endian 32-bit numbers.
    """
    arrow_rows(docs.sparkSession)
    on_workers(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64()), ("offsets_sha256", pa.string())])

    def run(batches):
        c = codec(path)
        decimal = [b"%d" % i for i in range(len(c.bytes_of))]
        for batch in batches:
            n, ids_hex, out_hex, split, where = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                out_hex.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                starts, ends, inside = c.spans(ids)
                split.append(inside)
                where.append(hashlib.sha256(starts.astype("<i4").tobytes() + ends.astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(out_hex, pa.string()), pa.array(split, pa.int64()), pa.array(where, pa.string())], schema=kind)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, offsets_sha256 string")
