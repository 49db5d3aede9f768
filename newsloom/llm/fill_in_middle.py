"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` bytes, each with the number of units
(lines), characters and bytes before it. A cut after u units needs one frame only: the counts say which.
What is to be hashed or written is streamed frame by frame in the order of its sections, so that no more
than a frame of a long text is uncompressed at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.words import blocks

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
_LEVEL = 1
_FRAMES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("units", "chars", "bytes")] + [T.StructField("data", T.BinaryType())]))
_FRAME_TYPE = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
STORED = [T.StructField("units", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("frames", _FRAMES)]


class Frames:
    """Compressed frames of one text with the line ends, characters and bytes before each."""

    def __init__(self, data: list[bytes], units: list[int], chars: list[int], starts: list[int]):
        self.data, self.units, self.chars, self.starts = data, units, chars, starts
        self._read = zstandard.ZstdDecompressor()
        self._at, self._piece = -1, b""

    @classmethod
    def pack(cls, parts: Iterable[bytes], frame: int = FRAME) -> Frames:
        """Frames of the parts laid end to end; a frame ends between characters and may always hold one."""
        frame = max(frame, 4)
        packer = zstandard.ZstdCompressor(level=_LEVEL)
        out, held, units, chars, start = cls([], [], [], []), bytearray(), 0, 0, 0

        def flush(size: int) -> None:
            nonlocal units, chars, start
            piece = bytes(held[:size])
            del held[:size]
            out.data.append(packer.compress(piece))
            out.units.append(units)
            out.chars.append(chars)
            out.starts.append(start)
            units, chars, start = units + piece.count(b"\n"), chars + len(piece.decode()), start + size

        for part in parts:
            held += part
            while len(held) > frame:
                size = frame
                while held[size] & 0xC0 == 0x80:
                    size -= 1
                flush(size)
        if held:
            flush(len(held))
        out.end = (units, chars, start)
        return out

    def piece(self, k: int) -> bytes:
        if k != self._at:
            self._at, self._piece = k, self._read.decompress(self.data[k])
        return self._piece

    def cut(self, units: int) -> tuple[int | None, int | None]:
        """(bytes, characters) before the end of the first ``units`` line ends; (None, None) if there are fewer."""
        if not units:
            return 0, 0
        k = bisect_left(self.units, units) - 1
        piece = self.piece(k)
        ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
        if units - self.units[k] > len(ends):
            return None, None
        at = int(ends[units - self.units[k] - 1]) + 1
        return self.starts[k] + at, self.chars[k] + len(piece[:at].decode())

    def between(self, start: int, stop: int | None) -> Iterator[bytes]:
        """The bytes from ``start`` up to ``stop`` (None: the end), a frame at a time."""
        for k in range(max(0, bisect_right(self.starts, start) - 1), len(self.data)):
            first = self.starts[k]
            if stop is not None and first >= stop:
                return
            part = self.piece(k)[max(0, start - first) : None if stop is None else stop - first]
            if part:
                yield part

    def find(self, mark: bytes, start: int) -> int:
        """Where ``mark`` first begins at or after ``start``, across frames; -1 if nowhere."""
        carry, at = b"", start
        for part in self.between(start, None):
            window = carry + part
            found = window.find(mark)
            if found >= 0:
                return at - len(carry) + found
            at += len(part)
            carry = window[-(len(mark) - 1) :]
        return -1


def stored(docs: DataFrame, text: str = "text", marks: tuple[str, ...] = MARKS, frame: int = FRAME) -> DataFrame:
    """``docs`` with ``text`` replaced by ``units``, ``marked`` and ``frames``.

    Units are lines ``[^\\n]*\\n|[^\\n]+``; ``marked`` says whether the text contains one of ``marks``. A
    null text is an empty one: no unit, no frame. Other columns stay, unless they have the name of a new
    one, in any case of letters. Rows are not moved.
    """
    names = {f.name for f in STORED}
    kept = [c for c in docs.columns if c != text and c.lower() not in names]
    source = docs.select(*[docs[f"`{c}`"] for c in kept], docs[f"`{text}`"])
    schema = T.StructType([source.schema[c] for c in kept] + STORED)

    def run(batches):
        for batch in batches:
            column = batch.column(len(kept)).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            for a, b in blocks(offsets):
                units, marked, ends, parts = [], [], [0], []
                for value in column.slice(a, b - a).to_pylist():
                    packed = Frames.pack([value.encode()], frame)
                    units.append(packed.end[0] + (value != "" and value[-1] != "\n"))
                    marked.append(any(m in value for m in marks))
                    parts += zip(packed.units, packed.chars, packed.starts, packed.data, strict=True)
                    ends.append(len(parts))
                columns = [pa.array([p[k] for p in parts], f.type) for k, f in enumerate(_FRAME_TYPE)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_FRAME_TYPE)))
                rest = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(units, pa.int64()), pa.array(marked), lists], names=schema.names)

    return source.mapInArrow(run, schema)


def draws(ident: object, seed: int) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of ``seed:ident``."""
    digits = hashlib.sha256(f"{seed}:{ident}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(text: Frames, form: str, first: int | None, second: int | None) -> Iterator[bytes]:
    """The output in order: marks and the sections that the two cuts (in bytes) leave."""
    prefix = lambda: text.between(0, first)
    suffix = lambda: text.between(second, None) if second is not None else iter(())
    middle = lambda: text.between(first, second) if first is not None else iter(())
    if form == "plain":
        yield from text.between(0, None)
        return
    order = [(PREFIX, prefix), (SUFFIX, suffix)] if form == "psm" else [(SUFFIX, suffix), (PREFIX, prefix)]
    for mark, section in [*order, (MIDDLE, middle)]:
        yield mark.encode()
        yield from section()


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text again, from the output and its form alone: the marks are looked up and the sections streamed."""
    if form == "plain":
        yield from output.between(0, None)
        return
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    one = output.find(first.encode(), 0)
    two = output.find(second.encode(), one)
    size = len(PREFIX)
    sections = [(size, one), (one + size, two), (two + size, None)]
    order = (0, 2, 1) if form == "psm" else (1, 2, 0)
    for k in order:
        yield from output.between(*sections[k])


def _digest(parts: Iterable[bytes]) -> str:
    sha = hashlib.sha256()
    for part in parts:
        sha.update(part)
    return sha.hexdigest()


def fill_in_middle(store: DataFrame, ident: str = "doc_id", seed: int = 7, percent: int = 100, spm: int = 50, frame: int = FRAME, output: str | None = None, digests: bool = False) -> DataFrame:
    """(the store's other columns, n, form, prefix_chars, middle_chars[, output][, output_sha256, restored_sha256]).

    The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the
    larger, the suffix is the rest. A text stays plain if it is empty, holds a mark, has no id, or if
    h3 % 100 >= ``percent``; otherwise it is suffix-prefix-middle if h4 % 100 < ``spm``, else
    prefix-suffix-middle. Rows of one id are cut alike. The output is packed into frames of its own and the
    text is rebuilt from these, so ``restored_sha256`` proves the round trip. Columns of the store that
    have the name of a new one give way. Rows are not moved.
    """
    added = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64())]
    added += [(output, T.StringType(), pa.string())] if output else []
    added += [(name, T.StringType(), pa.string()) for name in ("output_sha256", "restored_sha256")] if digests else []
    names = {name.lower() for name, *_ in added} - {ident.lower()} | {f.name for f in STORED}
    kept = [c for c in store.columns if c.lower() not in names]
    inputs = list(dict.fromkeys([*kept, ident])) + [f.name for f in STORED]
    source = store.select(*[store[f"`{c}`"] for c in inputs])
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(name, kind) for name, kind, _ in added])
    id_at, keep_at = inputs.index(ident), [inputs.index(c) for c in kept]

    def one(key: object, units: int, marked: bool, text: Frames) -> list:
        h1, h2, h3, h4 = draws(key, seed)
        form, sizes, cuts = "plain", (None, None), (None, None)
        if units and not marked and key is not None and h3 % 100 < percent:
            form = "spm" if h4 % 100 < spm else "psm"
            at = [text.cut(u) for u in sorted((h1 % (units + 1), h2 % (units + 1)))]
            cuts = tuple(b for b, _ in at)
            whole = None if all(c is not None for _, c in at) else text.chars[-1] + len(text.piece(len(text.data) - 1).decode())
            chars = [whole if c is None else c for _, c in at]
            sizes = (chars[0], chars[1] - chars[0])
        out = [units, form, *sizes]
        if output or digests:
            packed = Frames.pack(arranged(text, form, *cuts), frame)
            out += [b"".join(packed.between(0, None)).decode()] if output else []
            out += [_digest(packed.between(0, None)), _digest(restored(packed, form))] if digests else []
        return out

    def run(batches):
        for batch in batches:
            keys = batch.column(id_at).to_pylist()
            units, marked, lists = (batch.column(len(inputs) - 3 + k) for k in range(3))
            ends = lists.offsets.to_pylist()
            values = lists.values
            before = [values.field(k).to_pylist() for k in range(3)]
            data = values.field(3)
            rows = []
            for row, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                text = Frames(data.slice(a, b - a).to_pylist(), *(x[a:b] for x in before))
                rows.append(one(keys[row], units[row].as_py(), marked[row].as_py(), text))
            new = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep_at] + new, names=schema.names)

    return source.mapInArrow(run, schema)
