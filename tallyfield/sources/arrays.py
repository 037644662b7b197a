"""JSON files that are one array or one object each, read by many tasks.

Such a file may be one line of any length, so lines cannot split it. It is read in pieces that end with ``}``, which
the text source finds from any offset, and the pieces of a task are gathered into chunks of bounded size. A chunk's
tokens depend on whether it begins inside a string, so each chunk is summarised for every state that it may begin in:
the state that it ends in and by how much it changes the depth. Going through the summaries of a file, one small row a
chunk, tells how every chunk begins. Then each chunk gives the objects that lie in it, and those that end in a later
chunk are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Bytes of text in a chunk, about: a piece is not cut.
CHUNK = 1 << 20
#: Where a chunk may begin: outside strings, inside one, inside one behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*|[{}\[\]]', re.DOTALL)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)


#: White space and the mark of the byte order.
_BLANK = re.compile(rb"(?:[ \t\r\n]|\xef\xbb\xbf)*")


def _after(text: bytes, at: int) -> tuple[int, int]:
    """(where the text goes on, state) behind the inner part of a string that ends at ``at``."""
    if at == len(text):
        return at, INSIDE
    return (at + 1, OUTSIDE) if text[at : at + 1] == b'"' else (len(text), ESCAPED)


def brackets(text: bytes, state: int) -> Iterator[tuple[int, int]]:
    """(place, +1 or -1) of every bracket outside strings; at last (length, state at the end)."""
    at = 0
    if state != OUTSIDE and text:
        at = 1 if state == ESCAPED else 0
        at, state = _after(text, _REST.match(text, at).end())
    while state == OUTSIDE:
        found = _TOKEN.search(text, at)
        if found is None:
            break
        if text[found.start()] == 34:
            at, state = _after(text, found.end())
        else:
            at = found.end()
            yield found.start(), 1 if text[found.start()] in b"{[" else -1
    yield len(text), state


#: What each byte does to the depth outside strings.
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_QUOTE, _BACKSLASH = b'"\\'


class Lexed:
    """The brackets and quotes of a text, found at once; the state at the beginning tells which of them count.

    A backslash outside strings escapes nothing. A text where that matters for a state is lexed token by token for it.
    """

    def __init__(self, text: bytes):
        self.text, code = text, np.frombuffer(text, np.uint8)
        step = _STEP[code]
        self.at = np.flatnonzero(step)
        self.step = step[self.at].astype(np.int64)
        quotes, escaped = np.flatnonzero(code == _QUOTE), np.zeros(0, np.int64)
        if b"\\" in text:
            # an odd run of backslashes before a quote escapes it
            plain = np.append(-1, np.flatnonzero(code != _BACKSLASH))
            odd = (quotes - 1 - plain[np.searchsorted(plain, quotes) - 1]) % 2 == 1
            quotes, escaped = quotes[~odd], quotes[odd]
        self.inner = np.searchsorted(quotes, self.at) & 1
        self.flips = len(quotes) & 1
        places = np.searchsorted(quotes, escaped) & 1
        self.escapes = [bool((places == 0).any()), bool((places == 1).any())]

    def brackets(self, state: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, +1 or -1 of each, state at the end) as :func:`brackets` gives them."""
        begins = int(state != OUTSIDE)
        if state == ESCAPED and self.text[:1] in (b'"', b"\\", b"") or self.text[-1:] == b"\\" or self.escapes[begins]:
            *steps, (_, end) = brackets(self.text, state)
            pairs = np.array(steps, np.int64).reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1], end
        counted = self.inner == begins
        return self.at[counted], self.step[counted], INSIDE if begins ^ self.flips else OUTSIDE


def summary(text: bytes) -> list[int]:
    """State at the end and change of depth, for each state at the beginning."""
    out, lexed = [], Lexed(text)
    for state in (OUTSIDE, INSIDE, ESCAPED):
        if state == ESCAPED and text[:1] not in (b'"', b"\\", b""):
            out += out[2:4]
            continue
        _, steps, end = lexed.brackets(state)
        out += [end, int(steps.sum())]
    return out


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, text, first, ends): chunks of each file in order of block and number, with the first
    character and the summaries of each."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def gather(batches):
        place, held, size, number = None, [], 0, 0

        def flush():
            text = b"".join(held)
            return pa.RecordBatch.from_pydict(
                {
                    "file": [place[0]],
                    "block": [place[1]],
                    "number": pa.array([number], pa.int32()),
                    "text": pa.array([text], pa.binary()),
                    "first": [text[_BLANK.match(text).end() :][:1].decode("utf-8", "replace")],
                    "ends": pa.array([summary(text)], pa.list_(pa.int32())),
                }
            )

        for batch in batches:
            files, blocks, values = batch.columns
            # what the pieces end with comes back, and their texts then follow each other
            texts = pc.binary_join_element_wise(values.cast(pa.large_binary()), pa.scalar(b"}", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2])
            codes, places = files.dictionary_encode().indices.to_numpy(), blocks.to_numpy()
            turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(places) != 0)) + 1
            for low, high in zip([0, *turns.tolist()], [*turns.tolist(), len(codes)]):
                own = files[low].as_py(), int(places[low])
                while low < high:
                    if own != place or size >= CHUNK:
                        if held:
                            yield flush()
                        number = number + 1 if own == place else 0
                        place, held, size = own, [], 0
                    # up to the piece that fills the chunk
                    upto = min(high, int(np.searchsorted(ends, ends[low] + CHUNK - size)))
                    held.append(bytes(data[ends[low] : ends[upto]]))
                    size, low = size + len(held[-1]), upto
        if held:
            yield flush()

    return cut_lineage(pieces.mapInArrow(gather, "file string, block bigint, number int, text binary, first string, ends array<int>"), "chunks")


def _beginnings(chunks: DataFrame) -> DataFrame:
    """(file, block, number, place, state, depth, base): how every chunk begins, and the depth at which objects lie."""

    def follow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["number"]))
        state = depth = 0
        base = None
        out = {k: [] for k in ("file", "block", "number", "place", "state", "depth", "base")}
        for place, r in enumerate(rows):
            if base is None and r["first"]:
                base = 1 if r["first"] == "[" else 0
            for k, v in zip(out, (r["file"], r["block"], r["number"], place, state, depth, base or 0)):
                out[k].append(v)
            state, change = r["ends"][2 * state : 2 * state + 2]
            depth += change
        kinds = (pa.string(), pa.int64(), *[pa.int32()] * 5)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    light = chunks.select("file", "block", "number", "ends", "first")
    return light.groupBy("file").applyInArrow(follow, "file string, block bigint, number int, place int, state int, depth int, base int")


def object_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every object that a file's array holds, or that stands in the file by itself."""
    chunks = _chunks(spark, path)
    begun = cut_lineage(_beginnings(chunks), "beginnings")
    met = chunks.drop("ends", "first").join(begun, ["file", "block", "number"]).select("file", "place", "state", "depth", "base", "text")

    def cut(batches):
        for batch in batches:
            out = {"file": [], "place": [], "kind": [], "text": []}
            for r in batch.to_pylist():
                for kind, text in _objects(r["text"], r["state"], r["depth"], r["base"]):
                    for k, v in zip(out, (r["file"], r["place"], kind, text)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict({"file": pa.array(out["file"], pa.string()), "place": pa.array(out["place"], pa.int32()), "kind": pa.array(out["kind"], pa.string()), "text": pa.array(out["text"], pa.binary())})

    parts = cut_lineage(met.mapInArrow(cut, "file string, place int, kind string, text binary"), "objects")

    def join(table: pa.Table) -> pa.Table:
        """Objects over several chunks of a file, their parts in order; a part of one is the whole of its chunk or its end."""
        texts, held = [], None
        for r in sorted(table.to_pylist(), key=lambda r: (r["place"], r["kind"] == "tail")):
            if r["kind"] == "tail":
                held = [r["text"]]
            elif held is not None:
                held.append(r["text"])
                if r["kind"] == "head":
                    texts.append(b"".join(held).decode("utf-8", "replace"))
                    held = None
        return pa.table({"value": pa.array(texts, pa.string())})

    whole = parts.where("kind = 'whole'").select(F.decode("text", "UTF-8").alias("value"))
    # an object's parts meet under the chunk where it begins, so a file's objects are spread over tasks
    tails = parts.where("kind = 'tail'").select("file", F.col("place").alias("of"))
    spans = begun.select("file", "place").join(_owners(begun, tails), ["file", "place"])
    broken = parts.where("kind <> 'whole'").join(spans, ["file", "place"]).select("file", "place", "kind", "text", "of")
    own = broken.select("file", "place", "kind", "text", F.when(F.col("kind") == "tail", F.col("place")).otherwise(F.col("of")).alias("of"))
    return whole.union(own.groupBy("file", "of").applyInArrow(join, "value string"))


def _owners(begun: DataFrame, tails: DataFrame) -> DataFrame:
    """(file, place, of): for every chunk the last one before it that an object is left open by."""

    def follow(left: pa.Table, right: pa.Table) -> pa.Table:
        opened = set(right["of"].to_pylist())
        last, out = None, {"file": [], "place": [], "of": []}
        for place in sorted(left["place"].to_pylist()):
            for k, v in zip(out, (left["file"][0].as_py(), place, last)):
                out[k].append(v)
            if place in opened:
                last = place
        return pa.table({"file": pa.array(out["file"], pa.string()), "place": pa.array(out["place"], pa.int32()), "of": pa.array(out["of"], pa.int32())})

    # one small row a chunk
    return begun.select("file", "place").groupBy("file").cogroup(tails.select(F.col("file").alias("of_file"), "of").groupBy("of_file")).applyInArrow(follow, "file string, place int, of int")


def _objects(text: bytes, state: int, depth: int, base: int) -> Iterator[tuple[str, bytes]]:
    """(kind, text) of the objects at the depth: ``whole``, the ``head`` that ends one begun before, the ``tail`` that
    begins one, or a ``part`` that does neither."""
    begin = 0 if depth > base else None
    before = begin is not None
    places, steps, _ = Lexed(text).brackets(state)
    depths = depth + np.cumsum(steps)
    # only what opens or closes at the depth matters
    here = np.flatnonzero(depths == base + (steps > 0))
    for at, step in zip(places[here].tolist(), steps[here].tolist()):
        if step > 0 and begin is None:
            begin = at if text[at : at + 1] == b"{" else None
        elif step < 0 and begin is not None:
            yield ("head" if before else "whole"), text[begin : at + 1]
            begin, before = None, False
    if begin is not None:
        yield ("part" if before else "tail"), text[begin:]


def read_json_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row per object of JSON files that are one array or object each; missing fields are null, as is all of an
    object that does not fit the schema."""
    return object_texts(spark, path).select(F.from_json("value", schema).alias("_o")).select("_o.*")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Each part file is one array on one line."""

    def lay(batches):
        mark = "["
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"value": [mark + ",".join(batch.column(0).to_pylist())]})
                mark = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(lay, "value string")
    # no break between what a task writes: the file is one line
    lines.write.mode("overwrite").option("lineSep", " ").text(path)
