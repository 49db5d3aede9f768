"""Byte-level BPE: encoding by batched merge rounds, decoding by table, as DataFrame columns."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.words import blocks

#: Fixed pattern of the byte-level pre-tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same classes spelled out for texts whose characters all lie below U+0100.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PIECES_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_NONE = np.iinfo(np.int32).max


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBpe:
    """One vocabulary: pair table sorted for binary search, token bytes laid end to end.

    Added tokens of the file are found in the text first and become their own id, as the
    tokenizers library does. ``held`` pieces are remembered at most, then the memory starts anew.
    """

    def __init__(self, spec: dict, held: int = 200_000):
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.base = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        known = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        known |= {i: content.encode() for content, i in added.items()}
        pieces = [known.get(i, b"") for i in range(max(known) + 1)]
        self.ends = np.cumsum([len(p) for p in pieces])
        self.lengths = np.array([len(p) for p in pieces])
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        self.held = held

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of every non-empty word.

        The symbols of all words lie in one array. Each round finds every word's lowest-ranked pair
        and joins all its places at once; ranks are looked up again only beside the joins. Words
        with nothing left to join leave the array.
        """
        sizes = np.array([len(w) for w in words])
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        out: list[bytes] = [b""] * len(words)
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(symbols)))
            done = best == _NONE
            if done.any():
                flat, which = symbols.astype("<u4").tobytes(), np.flatnonzero(done)
                for word, start, size in zip(owner[first[which]].tolist(), first[which].tolist(), width[which].tolist(), strict=True):
                    out[word] = flat[4 * start : 4 * (start + size)]
                keep = np.repeat(~done, width)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                best, width = best[~done], width[~done]
                if not len(symbols):
                    break
            join = rank == np.repeat(best, width)
            at = np.flatnonzero(join)
            if (np.diff(at) == 1).any():  # in "aaa" the left pair goes first
                run = np.flatnonzero(np.append(True, np.diff(at) != 1))
                offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[offset % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            touched = np.unique(np.append(moved, moved[moved > 0] - 1))
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._rank(symbols[touched], symbols[touched + 1])
        return out

    def _tools(self):
        if not hasattr(self, "_pieces"):
            self._pieces, self._latin = regex.compile(PIECES), re.compile(PIECES_LATIN)
            inside = sorted(self.added, key=len, reverse=True)
            self._inside = regex.compile("(" + "|".join(map(regex.escape, inside)) + ")") if inside else None
            self._seen: dict[str, bytes] = {}
        return self._inside, self._seen

    def _cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._pieces.findall(text)
        return self._latin.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Every text's ids, 4 little-endian bytes each."""
        inside, seen = self._tools()
        cut = []
        for text in texts:
            if inside is not None and any(content in text for content in self.added):
                parts = []
                for part in inside.split(text):
                    parts.extend([part] if part in self.added else self._cut(part))
                cut.append(parts)
            else:
                cut.append(self._cut(text))
        if len(seen) > self.held:
            seen.clear()
        seen.update(self.added)
        new = list({piece for parts in cut for piece in parts if piece not in seen})
        if new:
            seen.update(zip(new, self.merge([piece.encode() for piece in new]), strict=True))
        return [b"".join(map(seen.__getitem__, parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of 4-byte ids; bytes that are no UTF-8 become replacement characters."""
        which = np.frombuffer(ids, "<u4")
        sizes = self.lengths[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[which] - ends, sizes)
        return self.pool[at].tobytes().decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    """A byte-level BPE file of the tokenizers library; truncation and padding are not used."""
    with open(path, encoding="utf-8") as file:
        return ByteBpe(json.load(file))


def with_tokens(docs: DataFrame, bpe: ByteBpe, text: str = "text", ids: str | None = None, decoded: str | None = None, lossless: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and, where named, the ids (array<int>), the decoded text, and whether it is the text.

    With ``digests`` also ``ids_sha256`` and ``decoded_sha256``. A null or empty text has no tokens.
    Rows keep all their columns and stay on their partition; a column of a name that is added is
    replaced. Whole texts are encoded and given back a block of about a megabyte at a time; the
    vocabulary travels as one broadcast of a few MB.
    """
    added = [("n_tokens", T.LongType(), pa.int64(), lambda m, x, t: len(x) // 4)]
    added += [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda m, x, t: np.frombuffer(x, "<i4"))] if ids else []
    added += [(decoded, T.StringType(), pa.string(), lambda m, x, t: m.decode(x))] if decoded else []
    added += [(lossless, T.BooleanType(), pa.bool_(), lambda m, x, t: m.decode(x) == t)] if lossless else []
    if digests:
        added += [("ids_sha256", T.StringType(), pa.string(), lambda m, x, t: hashlib.sha256(x).hexdigest())]
        added += [("decoded_sha256", T.StringType(), pa.string(), lambda m, x, t: hashlib.sha256(m.decode(x).encode()).hexdigest())]
    names = {name.lower() for name, *_ in added}
    rest = [c for c in docs.columns if c.lower() not in names or c == text]
    source = docs.select(*[docs[f"`{c}`"] for c in rest])
    kept = [c for c in rest if c.lower() not in names]
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, *_ in added])
    at, fields = rest.index(text), [f.name for f in schema]
    keep_at = [rest.index(c) for c in kept]
    makers = [(kind, make) for _, _, kind, make in added]
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(at).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for a, b in blocks(offsets):
                texts = column.slice(a, b - a).to_pylist()
                coded = model.encode(texts)
                new = [pa.array([make(model, x, t) for x, t in zip(coded, texts, strict=True)], kind) for kind, make in makers]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in keep_at] + new, names=fields)

    return source.mapInArrow(run, schema)
