"""Token ids of all documents in Arrow stream files with fixed-size-list batches.

Rows are dealt into ranges of ascending id, each range becomes one file, and its ids fill sequences of one
length without a gap; only the last sequence of a file is padded, as its mask says. Since every sequence has the
same length, sequence ``i`` is found by arithmetic and read without a copy from the mapped file.

Files go to the shared folder through pyarrow's file systems. A file's name carries the task attempt, and only
names that reach the manifest count, so a lost or repeated task leaves the result as it is.

Defined results: a null or empty text is its end id alone; rows with the same id follow each other in order of a
hash of their texts; null ids come first; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from .common import column_of, let_go, slices

#: Ids a sequence, sequences a batch, bytes of text a file (about; a longer text is not split).
SEQUENCE, BATCH, FILE_BYTES = 2048, 128, 24 << 20
#: Units whose ids a worker remembers, and the longest such unit.
REMEMBERED, LONGEST = 500_000, 64
#: Rows and bytes of text encoded at a time: the more, the fewer units are looked up again.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20

# White space as the tokenizer's pattern sees it. A unit is what the pattern never cuts across.
_WHITE = "\t-\r \x85\xa0  -     　"
_UNITS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


# The ASCII part of that white space by byte, and its other characters.
_WHITE_BYTES = np.array([9 <= b <= 13 or b == 32 for b in range(256)])
#: 1 for ASCII symbols, 2 for letters, 3 for digits, 0 for what is none of them.
_KINDS = np.array([0 if not 32 < b < 127 else 2 if chr(b).isalpha() else 3 if chr(b).isdigit() else 1 for b in range(256)], np.uint8)
_ODD = [chr(c) for c in range(128, 0x3001) if re.match(f"[{_WHITE}]", chr(c))]

# Bytes that byte-level vocabularies show as themselves, and the end of the Latin letters taken alone.
_PLAIN = frozenset(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))
_LATIN_END = "\u0250"


class UnitEncoder:
    """Byte-level encoding of whole texts by the tokenizers library; units seen before are not encoded again.

    The texts of a call are cut into units at once and each distinct unit is looked up once. Units without a line break
    are encoded many at a time, one a line: the pattern keeps the line break between two of them apart from both. A
    tokenizer with another pattern encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        state = json.loads(self.library.to_str())
        before = state["pre_tokenizer"] or {}
        self.parted = state["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        # the model takes the bytes of a unit in the character form of its vocabulary
        plain = [b for b in range(256) if chr(b) in _PLAIN]
        others = (b for b in range(256) if chr(b) not in _PLAIN)
        self.forms = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
        del self.forms[ord("\n")]
        self.model = self.library.model if self._letters_alone() else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return array("HI"[self.type.itemsize // 4], ids).tobytes()

    def _words(self, units: list[str]) -> list[list[int]]:
        """Ids of units of letters with at most a space before them, which the pattern keeps as one."""
        forms = "\n".join(units).encode().decode("latin-1").translate(self.forms).split("\n")
        return [[t.id for t in tokens] for tokens in map(self.model.tokenize, forms)]

    def _letters_alone(self) -> bool:
        """Whether the model's own call gives what the whole library gives for letters."""
        self.model, words = self.library.model, ["a", " the", " Größe", "été", " ñandúÿ", " İĀ"]
        return self._words(words) == list(map(self._ids, words))

    def _packed(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, remembered or new."""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, units))
        fresh = [u for u, ids in zip(units, found) if ids is None]
        new = {u: self.older[u] for u in fresh if u in self.older}
        letters, others = [], []
        for u in fresh:
            if u not in new:
                alone = self.model is not None and u.removeprefix(" ").isalpha() and (u.isascii() or max(u) < _LATIN_END)
                (letters if alone else others).append(u)
        if letters:
            new.update(zip(letters, map(self._pack, self._words(letters))))
        lines = [u for u in others if "\n" not in u and not u.isspace()] if self.line is not None else []
        ids = np.array(self._ids("\n".join(lines)), self.type) if lines else np.zeros(0, self.type)
        cuts = np.flatnonzero(ids == self.line).tolist()
        if lines and len(cuts) == len(lines) - 1:
            packed, width, begin = ids.tobytes(), self.type.itemsize, 0
            for u, end in zip(lines, [*cuts, len(ids)]):
                new[u] = packed[begin * width : end * width]
                begin = end + 1
        for u in others:
            if u not in new:
                new[u] = self._pack(self._ids(u))
        self.known.update((u, ids) for u, ids in new.items() if len(u) <= LONGEST)
        return [ids or new[u] for u, ids in zip(units, found)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.zeros(0, self.type)] * len(texts)
        plain, odd = [], []
        for k, t in enumerate(texts):
            if not self.parted or any(s in t for s in self.special):
                out[k] = np.array(self._ids(t), self.type)
            elif t:
                (plain if t.isascii() or not any(c in t for c in _ODD) else odd).append(k)
        for places, split in ((plain, units_by_bytes), (odd, units_by_pattern)):
            if places:
                for k, ids in zip(places, self._joined(*split([texts[k] for k in places]))):
                    out[k] = ids
        return out

    def _joined(self, units: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that have so many of the units each; every distinct unit is looked up once."""
        coded = units.dictionary_encode()
        found = self._packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, ids = joined.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(joined) + 1]
        ids = np.frombuffer(ids, self.type, ends[-1] // self.type.itemsize)
        cuts = ends[np.cumsum(counts)[:-1]] // self.type.itemsize
        return np.split(ids, cuts)


def units_by_pattern(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts, one text after another, and how many each has."""
    split = [_UNITS.findall(t) for t in texts]
    return pa.array(chain.from_iterable(split), pa.large_string()), np.array([len(u) for u in split])


def units_by_bytes(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """As :func:`units_by_pattern`, for texts (none empty) whose white space is ASCII: where a unit begins is told by a
    byte and its neighbours. The pattern also parts ASCII letters, and digits, from any other such character that follows."""
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    white = _WHITE_BYTES[data]
    after_white, to_solid = np.zeros(len(data), bool), np.zeros(len(data), bool)
    after_white[1:], to_solid[:-1] = white[:-1], ~white[1:]
    after_white &= ~first[:-1]
    to_solid &= ~first[1:]
    after_space = after_white.copy()
    after_space[1:] &= data[:-1] == ord(" ")
    # white space begins a unit at the start of a run and, if a word follows, with the run's last character; a word does
    # unless a space before it belongs to it
    first[:-1] |= np.where(white, ~after_white | to_solid, after_white & ~after_space)
    kind = _KINDS[data]
    first[1:-1] |= (kind[:-1] > 1) & (kind[1:] > 0) & (kind[1:] != kind[:-1])
    begins = np.flatnonzero(first)
    units = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data)])
    return units, np.diff(np.searchsorted(begins, [*starts, len(data)]))


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


class _Writer:
    """Packs ids into sequences of one length and writes them in batches."""

    def __init__(self, path: str, kind: np.dtype, length: int):
        self.fs, self.path = pa.fs.FileSystem.from_uri(path)
        self.length, self.kind, self.held, self.count, self.total = length, kind, [], 0, 0
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = self.fs.open_output_stream(self.path)
        self.file = pa.ipc.new_file(self.stream, self.schema)

    def add(self, ids: np.ndarray) -> int:
        """Where the ids begin in the file."""
        begin = self.total
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.length * BATCH:
            flat = np.concatenate(self.held)
            whole = len(flat) // (self.length * BATCH) * self.length * BATCH
            for at in range(0, whole, self.length * BATCH):
                self._batch(flat[at : at + self.length * BATCH], self.length * BATCH)
            self.held, self.count = [flat[whole:]], len(flat) - whole
        return begin

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.count:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.file.close()
        self.stream.close()


class TokenFile:
    """Random access to the sequences of a file and to runs of ids."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(name) if local else fs.open_input_file(name))
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray] | None = None

    def _flat(self, batch: int, column: str) -> pa.Array:
        return self.file.get_batch(batch).column(column).flatten()

    def _ids(self, batch: int) -> np.ndarray:
        if self.last is None or self.last[0] != batch:
            self.last = batch, self._flat(batch, "ids").to_numpy(zero_copy_only=True)
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; the ids are a view of the file."""
        batch, at = divmod(i, BATCH)
        cut = slice(at * self.length, (at + 1) * self.length)
        return self._ids(batch)[cut], self._flat(batch, "mask").to_numpy(zero_copy_only=False)[cut]

    def run(self, begin: int, count: int) -> np.ndarray:
        """``count`` ids from position ``begin``, through as many batches as they take."""
        size, parts = self.length * BATCH, []
        while count > 0:
            batch, at = divmod(begin, size)
            part = self._ids(batch)[at : at + count]
            parts.append(part)
            begin, count = begin + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


@dataclass
class TokenTable:
    """Manifest: (id, file, at, start, n_tokens) for every row; ``at`` within the file, ``start`` over all."""

    folder: str
    manifest: DataFrame


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    length: int = SEQUENCE,
    file_bytes: int = FILE_BYTES,
) -> TokenTable:
    """Write the ids of all texts, ``end_id`` after each, to a new folder below the shared one."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, local = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(local, recursive=True)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    # the hash lets rows that share an id fall into several files, as their order by text does not matter to readers
    ordered = (
        rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    )
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = unit_encoder(tokenizer)
        where = TaskContext.get()
        path = f"{folder}/part-{where.partitionId():06d}-{where.taskAttemptId()}.arrow"
        end = np.array([end_id], encoder.type)
        writer = None
        for batch in batches:
            for part in slices(batch, "text", PIECE_ROWS, PIECE_BYTES):
                if writer is None:
                    writer = _Writer(path, encoder.type, length)
                texts = [t or "" for t in column_of(part, "text").to_pylist()]
                encoded = encoder.encode(texts)
                begins = []
                for ids in encoded:
                    begins.append(writer.add(ids))
                    writer.add(end)
                n = part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": column_of(part, "id"),
                        "part": pa.array([where.partitionId()] * n, pa.int32()),
                        "file": pa.array([path] * n, pa.string()),
                        "at": pa.array(begins, pa.int64()),
                        "n_tokens": pa.array([len(x) + 1 for x in encoded], pa.int64()),
                    }
                )
        if writer is not None:
            writer.close()
        let_go()

    written = cut_lineage(
        ordered.mapInArrow(run, f"id {kind}, part int, file string, at bigint, n_tokens bigint"), "manifest"
    )
    # one row a file
    totals = written.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    manifest = written.join(starts, "file").select(
        F.col("id").alias(id_col), "file", "at", (F.col("before") + F.col("at")).alias("start"), "n_tokens"
    )
    return TokenTable(folder, manifest)


def token_checksums(table: TokenTable, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for every row, from its ids as read back from the files."""
    kind = table.manifest.schema[id_col].dataType.simpleString()

    def run(batches):
        path, file = None, None
        for batch in batches:
            columns = {n: column_of(batch, n) for n in batch.schema.names}
            sums = []
            for name, at, n in zip(columns["file"].to_pylist(), columns["at"].to_pylist(), columns["n_tokens"].to_pylist()):
                if name != path:
                    path, file = name, TokenFile(name)
                sums.append(zlib.crc32(file.run(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: columns[id_col],
                    "start": columns["start"],
                    "n_tokens": columns["n_tokens"],
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            )

    by_file = table.manifest.repartition("file").sortWithinPartitions("file", "at")
    return by_file.mapInArrow(run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
