"""Arrow helpers shared by the text operators.

Every operator selects the columns it needs by name and ignores the rest, so extra columns, whatever their
names, change nothing. Functions run in Python workers on record batches; nothing is kept between batches
except tables of fixed size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage

#: Rows and bytes of text handled at a time inside a task.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20

SPACES = b" \t\n\x0b\x0c\r"


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not this C library

    def _trim(_: int) -> None:
        pass


def let_go() -> None:
    """Give back what Arrow and the C library hold without use, at the end of a task: its worker is kept for others."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(
    batch: pa.RecordBatch, text: str | None = None, rows: int | None = None, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each of at most SLICE_ROWS rows and about SLICE_BYTES of text (or one longer row), unless other
    bounds are given."""
    rows, size = rows or SLICE_ROWS, size or SLICE_BYTES
    if text is None:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(False)
    begin = total = 0
    for at, n in enumerate(lengths):
        if at > begin and (total + n > size or at - begin >= rows):
            yield batch.slice(begin, at - begin)
            begin, total = at, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_text(
    df: DataFrame,
    text: str,
    schema: str,
    work: Callable[[pa.RecordBatch, list[bytes]], dict],
    *passed: str,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply ``work(part, texts)`` to parts of the rows; it returns columns by name in the given schema.

    ``passed`` names the columns that go along with the text. Texts arrive as UTF-8; a null text is empty. ``after``
    is called at the end of a task, to let go of what the worker need not keep.
    """
    struct = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = as_bytes(part.column(part.schema.get_field_index(text)))
                columns = work(part, texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
                )
        if after is not None:
            after()
        let_go()

    return df.select(*dict.fromkeys([*passed, text])).mapInArrow(run, struct)


def replace_text(df: DataFrame, work: Callable[[list[bytes]], list[bytes]], text: str = "text", length: str = "n_chars") -> DataFrame:
    """All columns as they were, with ``text`` rewritten and ``length``, if there, set to its code points.

    A null text stays null and is not given to ``work``.
    """
    struct = df.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(text)
                raw = part.column(at).cast(pa.binary()).to_pylist()
                done = iter(work([x for x in raw if x is not None]))
                new = [None if x is None else next(done) for x in raw]
                columns = list(part.columns)
                columns[at] = pa.array(new, pa.binary()).cast(part.schema.field(at).type)
                if (n := part.schema.get_field_index(length)) >= 0:
                    counts = [old if x is None else code_points(x) for x, old in zip(new, columns[n].to_pylist())]
                    columns[n] = pa.array(counts, part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        let_go()

    return df.mapInArrow(run, struct)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column_of(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` words given their hashes; one hash of all words if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i])
    return out


#: Ids at most that are sent to every task to leave rows out; more are joined through a shuffle.
SENT_IDS = 1 << 20


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes not to meet a column, in any case of letters."""
    used, mark = {c.lower() for c in taken}, "__"
    while any((mark + n).lower() in used for n in names):
        mark += "_"
    return [mark + n for n in names]


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not in ``ids`` (one column; null meets null). The ids are counted: up to SENT_IDS of them
    are broadcast, so that the texts stay where they are."""
    (name,) = free_names(df.columns, "gone")
    gone = cut_lineage(ids.toDF(name).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return df.join(side, df[id_col].eqNullSafe(side[name]), "left_anti")
