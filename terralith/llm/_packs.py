"""Documents in packs: a table with a few rows of a few MB for many documents.

Jobs that give numbers back to texts in several rounds work on packs: a pack and what is sent to it meet by its name, and
what it sends is one row for each target instead of one for each word.

``exchange`` takes what packs send to hash or range parts and brings the answers back.  The parts grow with the packs, so a row
for each pack and part would be a number that grows with the square of the input.  Beyond FAN parts a pack sends one bundle to
each of FAN groups of parts; bundles of some FAN packs meet in a cell, which sends one bundle to each part of its group; answers
go back by the same two steps.  No step makes more than FAN rows for a pack (or the root of the parts, beyond FAN * FAN of them).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import written
from ._text import column_bytes

LAST = (1 << 63) - 1  # stands for a missing id

ROW = "pack string, kind int, part int, blob binary"
FAN = 1024  # rows that a pack sends at most
BUNDLE = -1  # the kind of a ROW whose blob holds ROWs
_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], decompressed_size=n, asbytes=True) if n else b""


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["pack", "kind", "part", "blob"])


def packs(docs: DataFrame, id_col: str, text: str, size: int = 1 << 22) -> DataFrame:
    """ROW of kind 0: ids and offsets (blob of part 0) and bytes (part 1) of consecutive documents of a task."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        bufs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held, made, task = 0, 0, TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            i, b, n = np.concatenate(ids), np.concatenate(bufs).tobytes(), np.concatenate(sizes)
            head = np.concatenate([i, n]).astype(np.int64).tobytes()
            nonlocal made
            made += 1
            name = f"{task}-{made}"  # the table of packs is written once, so names stay
            return rows_of([(name, 0, 0, squeeze(head)), (name, 0, 1, squeeze(b))])

        for batch in batches:
            buf, offs = column_bytes(batch.column("text"))
            doc = np.array([LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            at = 0
            while at < len(doc):
                end = min(len(doc), max(at + 1, int(np.searchsorted(offs, offs[at] + size - held, "right")) - 1), at + 20_000)
                ids.append(doc[at:end])
                bufs.append(buf[offs[at] : offs[end]].copy())
                sizes.append(np.diff(offs[at : end + 1]))
                held += int(offs[end] - offs[at])
                at = end
                if held >= size - 65_536 or sum(map(len, ids)) >= 20_000:
                    yield row()
                    ids, bufs, sizes, held = [], [], [], 0
        if ids:
            yield row()

    return source.mapInArrow(run, ROW)


def opened(rows: dict[tuple[int, int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a pack."""
    head = np.frombuffer(expand(rows[0, 0]), np.int64)
    n = len(head) // 2
    return head[:n], np.frombuffer(expand(rows[0, 1]), np.uint8), np.concatenate([[0], np.cumsum(head[n:])])


def by_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[tuple[int, int], bytes]]]:
    """Packs from ROWs of kind 0 as they stand in the table: two rows each, one after the other."""
    open_: dict[str, dict[tuple[int, int], bytes]] = {}
    for batch in batches:
        for name, kind, part, blob in zip(*(batch.column(k).to_pylist() for k in ("pack", "kind", "part", "blob")), strict=True):
            got = open_.setdefault(name, {})
            got[kind, part] = blob
            if len(got) == 2:
                yield name, open_.pop(name)


def bundled(pieces: list[tuple]) -> bytes:
    return rows_of(pieces).serialize().to_pybytes()


def pieces_of(blob: bytes) -> list[tuple]:
    return tuples(pa.ipc.read_record_batch(pa.py_buffer(blob), rows_of([]).schema))


def tuples(rows: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(rows.column(k).to_pylist() for k in ("pack", "kind", "part", "blob")), strict=True))


def groups_of(parts: int, fan: int) -> int:
    """Parts in a group: 1 where packs send to the parts themselves."""
    return -(-parts // max(fan, math.isqrt(parts - 1) + 1))


def outgoing(name: str, rows: list[tuple], parts: int, fan: int = FAN) -> pa.RecordBatch:
    """What the pack ``name`` sends to parts 0 to ``parts`` - 1, for ``exchange``."""
    width = groups_of(parts, fan)
    if width == 1:
        return rows_of(rows)
    groups = defaultdict(list)
    for row in rows:
        groups[row[2] // width].append(row)
    return rows_of([(name, BUNDLE, g, bundled(some)) for g, some in groups.items()])


def received(got: pa.Table) -> tuple[str, dict[tuple[int, int], bytes]]:
    """Name of a pack, and blobs by kind and part, from the pack's rows and what was sent to it."""
    rows = {}
    for _, kind, part, blob in tuples(got):
        rows.update({(k, p): b for _, k, p, b in pieces_of(blob)} if kind == BUNDLE else {(kind, part): blob})
    return got.column("pack")[0].as_py(), rows


def exchange(rows: DataFrame, meet: Callable[[pa.Table], pa.Table], by: list[str], parts: int, fan: int = FAN, scratch: list[DataFrame] | None = None) -> DataFrame:
    """ROWs that ``meet`` gives for the ROWs of each group by ``by`` (part, or kind and part), for ``received``.

    ``rows`` come from ``outgoing``.  ``meet`` answers to packs that it was sent something by, and may give rows without a name.
    ``scratch`` gets the table that stands between the steps, which can go once the result is written.
    """
    width = groups_of(parts, fan)
    if width == 1:
        return rows.groupBy(*by).applyInArrow(meet, ROW)
    blocks = 4 * width  # there is a part for each four packs, so a cell gets about as much as a pack holds
    kinds = "kind" in by

    def onward(got: pa.Table) -> pa.Table:
        cell, to = "", defaultdict(list)
        for name, _, group, blob in tuples(got):
            cell = min(cell, f"{group}/{name}") if cell else f"{group}/{name}"
            for row in pieces_of(blob):
                to[row[1] if kinds else BUNDLE, row[2]].append(row)
        return pa.Table.from_batches([rows_of([(cell, k, p, bundled(some)) for (k, p), some in to.items()])])

    def met(got: pa.Table) -> pa.Table:
        cell_of, every, back, out = {}, [], defaultdict(list), []
        for cell, _, _, blob in tuples(got):
            some = pieces_of(blob)
            every += some
            cell_of.update((row[0], cell) for row in some)
        for row in tuples(meet(pa.Table.from_batches([rows_of(every)]))):
            if row[0]:
                back[cell_of[row[0]]].append(row)
            else:
                out.append(row)
        part = every[0][2]
        return pa.Table.from_batches([rows_of(out + [(cell, BUNDLE, part, bundled(some)) for cell, some in back.items()])])

    def home(got: pa.Table) -> pa.Table:
        to, group = defaultdict(list), int(got.column("pack")[0].as_py().split("/")[0])
        for _, _, _, blob in tuples(got):
            for row in pieces_of(blob):
                to[row[0]].append(row)
        return pa.Table.from_batches([rows_of([(name, BUNDLE, group, bundled(some)) for name, some in to.items()])])

    block = F.pmod(F.xxhash64("pack"), F.lit(blocks)).alias("block")
    answers = rows.groupBy("part", block).applyInArrow(onward, ROW).groupBy(*by).applyInArrow(met, ROW)
    kept = written(answers, "answers")  # read twice: rows without a name, and those on their way back
    if scratch is not None:
        scratch.append(kept)
    return kept.where("pack = ''").unionByName(kept.where("pack <> ''").groupBy("pack").applyInArrow(home, ROW))
