"""Joins of term counts with a term table of any size, packed by blocks of texts.

A row for each term of each text, shuffled to its term and back to its text, moves many times the text. Here the texts of one
task are a block: each distinct term of a block is asked for once, by bucket of its checksum, the numbers that the table
has for it come back, and the block's texts, which hold short numbers in place of terms, meet them; all of it compressed. Terms travel whole, so
nothing rests on hashes, and a term of every text costs one row per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classgauge.session import input_bytes, sweep, written

TASK_BYTES = 4 << 20  # of files, for each task that cuts texts
BUCKET_BYTES = 8 << 20  # of files and of the table, for each bucket of terms
UNKNOWN = 1 << 56  # what Spark says of rows that it can't size
PAIRS = 1 << 20  # entries that travel or come out at once
BLOCK_TERMS, BLOCK_ROWS = 3 << 18, 1 << 16  # words and rows of a block that is cut from rows
PIECE = 1 << 16

# Of a block: key columns of each text, each entry's text, its count, and its row of numbers or terms.
Finish = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, "pa.Array | None"], pa.Table]


def task_parts(df: DataFrame, bytes_each: int = TASK_BYTES) -> int:
    """One part for each ``bytes_each`` of the files that ``df`` reads, and no fewer than the session's shuffle partitions."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if size >= UNKNOWN else max(least, -(-size // bytes_each))


def _squeezed(values: np.ndarray | bytes) -> bytes:
    data = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _plain(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _joined(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(_plain(cell), kind) for cell in column.to_pylist()]


def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _term_list(cell: bytes) -> pa.Array:
    return pa.array(_plain(cell).split(b"\0"), pa.binary()).cast(pa.string())


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _packed(names: list[str], n_buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        block = str(TaskContext.get().partitionId())
        code = np.zeros(len(rows), np.int64)
        for n in names:
            found = _whole(rows[n]).dictionary_encode(null_encoding="encode")
            code = code * max(1, len(found.dictionary)) + found.indices.to_numpy(zero_copy_only=False)
        _, first, text = np.unique(code, return_index=True, return_inverse=True)
        has = np.flatnonzero(rows["term"].is_valid().to_numpy())
        found = _whole(rows["term"].take(pa.array(has))).dictionary_encode()
        terms = found.dictionary
        bucket = np.fromiter((zlib.crc32(t) % n_buckets for t in terms.cast(pa.binary()).to_pylist()), np.int32, len(terms))
        order = pc.sort_indices(pa.table({"b": bucket, "t": terms}), [("b", "ascending"), ("t", "ascending")]).to_numpy()
        place = np.empty(len(terms), np.int32)
        place[order] = np.arange(len(terms), dtype=np.int32)
        own, text = place[found.indices.to_numpy(zero_copy_only=False)], text[has]
        by_text = np.lexsort((own, text))
        own = own[by_text]
        tf = rows["tf"].to_numpy()[has][by_text].astype(np.int32)
        ends = _bounds(np.bincount(text, minlength=len(first)))
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PAIRS, "right")) - 1)
            spans = [slice(ends[i], ends[i + 1]) for i in range(at, to)]
            cells = {"block": pa.array([block] * (to - at)), "own": pa.array([_squeezed(np.diff(own[s], prepend=np.int32(0))) for s in spans]), "tf": pa.array([_squeezed(tf[s]) for s in spans])}
            cells |= {f"key_{i}": _whole(rows[n].take(pa.array(first[at:to]))) for i, n in enumerate(names)}
            yield _row_batch(cells, to - at, schema)
            at = to
        terms, bucket = terms.take(pa.array(order)), bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(bucket)]):
            asked = _squeezed(b"\0".join(terms.slice(lo, hi - lo).cast(pa.binary()).to_pylist()))  # no term holds this character
            yield _row_batch({"block": pa.array([block]), "bucket": pa.array([bucket[lo]], pa.int32()), "terms": pa.array([asked])}, 1, schema)

    return run


def _row_batch(cells: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    columns = [cells[f.name].cast(f.type) if f.name in cells else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _answered(columns: list[str], width: int, with_terms: bool):
    """What the table has for a bucket's terms: of each asked term whether it is there, and of those the numbers."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not len(table):  # a bucket whose terms the table lacks
            table = pa.table([pa.array([], pa.string()), *[pa.array([], pa.float64())] * width], ["term", *map(str, range(width))])
            return answers(asked, table, table.column_names[1:])
        return answers(asked, table, columns)

    def answers(asked: pa.Table, table: pa.Table, columns: list[str]) -> pa.Table:
        numbers = [np.array(_whole(table[c]).flatten()).reshape(len(table), -1) if pa.types.is_list(table[c].type) else table[c].to_numpy()[:, None] for c in columns]
        values, held = np.hstack(numbers).astype(np.float64), _whole(table["term"])
        cells: list[tuple] = []
        for cell in asked["terms"].to_pylist():
            flat = _term_list(cell)
            at = pc.index_in(flat, value_set=held)
            known = at.is_valid()
            answer = _squeezed(known.to_numpy(zero_copy_only=False)), _squeezed(values[at.drop_null().to_numpy()].T)
            cells.append((*answer, flat.filter(known)) if with_terms else answer)
        columns_out = [asked["block"], asked["bucket"], *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))]
        names = ["block", "bucket", "known", "numbers"]
        if with_terms:
            columns_out.append(pa.array([_squeezed(b"\0".join(c[2].cast(pa.binary()).to_pylist())) for c in cells], pa.binary()))
            names.append("terms")
        return pa.table(columns_out, names)

    return run


def _finished(names: list[str], width: int, with_terms: bool, finish: Finish):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.take(pc.sort_indices(answers["bucket"]))
        known = _flat(_joined(answers["known"], bool), bool)
        numbers = np.concatenate([n.reshape(width, -1).T for n in _joined(answers["numbers"], np.float64)] or [np.zeros((0, width))])
        terms = None
        if with_terms:
            filled = [c for c, n in zip(answers["terms"].to_pylist(), _joined(answers["known"], bool)) if n.any()]
            terms = pa.concat_arrays([_term_list(c) for c in filled] or [pa.array([], pa.string())])
        place = np.where(known, np.cumsum(known) - 1, -1)
        steps = _joined(texts["own"], np.int32)
        sizes = np.array([len(x) for x in steps], np.int64)
        own, tf = _flat([np.cumsum(x) for x in steps], np.int64).astype(np.int64), _flat(_joined(texts["tf"], np.int32), np.int32)
        text = np.repeat(np.arange(len(texts)), sizes)
        at = place[own]
        hit = at >= 0
        at = at[hit]
        keys = pa.table([texts[f"key_{i}"] for i in range(len(names))], names)
        return finish(keys, text[hit], tf[hit].astype(np.float64), numbers[at], None if terms is None else terms.take(pa.array(at)))

    return run


def joined_blocks(
    counts: DataFrame, table: DataFrame, columns: list[str], width: int, n_bytes: int, finish: Finish, ddl: str, with_terms: bool = False
) -> DataFrame:
    """``finish`` over every block of (key.., term, tf) joined with (term, columns..), as rows of ``ddl``.

    The counts of a key must be in one partition, as ``term_counts`` leaves them; a block is a partition. ``width`` is how many numbers ``columns`` hold, arrays
    counted in full; ``n_bytes`` what the table takes. Terms that the table lacks fall away; a text without any stays.
    """
    names = [c for c in counts.columns if c not in ("term", "tf")]
    types = dict(counts.dtypes)
    n_buckets = max(task_parts(counts, BUCKET_BYTES), -(-n_bytes // BUCKET_BYTES))
    keys = [F.col(n).alias(f"key_{i}") for i, n in enumerate(names)]
    empty = counts.sparkSession.createDataFrame([], ", ".join(f"key_{i} {types[n]}" for i, n in enumerate(names))).toArrow().schema
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("terms", pa.binary()), ("own", pa.binary()), ("tf", pa.binary()), *empty])
    out = "block string, bucket int, terms binary, own binary, tf binary, " + ", ".join(f"key_{i} {types[n]}" for i, n in enumerate(names))
    places = [f"key_{i}" for i in range(len(names))]
    packed = counts.select(*keys, "term", F.col("tf").cast("long").alias("tf")).mapInArrow(_renamed(_packed(names, n_buckets, schema), places, names), out)
    packed = written(packed, "blocks")
    asked = packed.where("bucket IS NOT NULL").select("block", "bucket", "terms")
    texts = packed.where("bucket IS NULL").select("block", "own", "tf", *places)
    held = table.select(F.pmod(F.crc32(F.col("term")), F.lit(n_buckets)).cast("int").alias("bucket"), "term", *columns)
    answers = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(
        _answered(columns, width, with_terms), "block string, bucket int, known binary, numbers binary" + ", terms binary" * with_terms
    )
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finished(names, width, with_terms, finish), ddl)


def _renamed(run, places: list[str], names: list[str]):
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = dict(zip(places, names))
        return run(b.rename_columns([new.get(c, c) for c in b.schema.names]) for b in batches)

    return renamed


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, their lowest bytes first, then the next: small ones take few bytes."""
    return _squeezed(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _wide(cell: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(cell), np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in blocks of about BLOCK_TERMS terms and at most BLOCK_ROWS rows; a row is never divided."""
    held, n_terms, n_rows = [], 0, 0
    for batch in batches:
        ends = _bounds(pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + BLOCK_TERMS - n_terms, "right")) - 1
            to = min(max(at + 1, to), at + BLOCK_ROWS - n_rows, batch.num_rows)
            held.append(batch.slice(at, to - at))
            n_terms, n_rows, at = n_terms + int(ends[to] - ends[at]), n_rows + to - at, to
            if n_terms >= BLOCK_TERMS or n_rows >= BLOCK_ROWS or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n_terms, n_rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _packed_rows(n_buckets: int, schema: pa.Schema):
    """Of each block of rows: one row with its texts and the kept columns, and one for each bucket with the distinct terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, rows in enumerate(_cut(batches)):
            yield from block(f"{part}-{i}", rows)

    def block(name: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = _whole(rows["terms"])
        found = lists.flatten().dictionary_encode()
        terms = found.dictionary
        spans = (terms.slice(i, PIECE).cast(pa.binary()).to_pylist() for i in range(0, len(terms), PIECE))  # few Python strings at a time
        bucket = np.fromiter((zlib.crc32(t) % n_buckets for span in spans for t in span), np.int32, len(terms))
        order = pc.sort_indices(pa.table({"b": bucket, "t": terms}), [("b", "ascending"), ("t", "ascending")]).to_numpy()
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        text = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        pairs, tf = np.unique(text * max(1, len(terms)) + place[found.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        text, own = pairs // max(1, len(terms)), pairs % max(1, len(terms))
        sink, kept = pa.BufferOutputStream(), rows.drop_columns(["terms"]).append_column("terms", lists.is_valid())
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(kept.combine_chunks())
        cells = [_narrow(np.diff(own, prepend=0)), _narrow(tf), _narrow(np.bincount(text, minlength=len(rows))), sink.getvalue().to_pybytes()]
        del rows, lists, found, kept, sink, pairs, text, own, tf, place
        yield _row_batch({"block": pa.array([name]), **{c: pa.array([x]) for c, x in zip(("own", "tf", "sizes", "kept"), cells)}}, 1, schema)
        terms, bucket = terms.take(pa.array(order)), bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(bucket)]):
            asked = _squeezed(b"\0".join(terms.slice(lo, hi - lo).cast(pa.binary()).to_pylist()))
            yield _row_batch({"block": pa.array([name]), "bucket": pa.array([bucket[lo]], pa.int32()), "terms": pa.array([asked])}, 1, schema)

    return run


def _finished_rows(width: int, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], names: list[str]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known, numbers = np.zeros(0, bool), np.zeros((0, width))
        if len(answers):
            answers = answers.take(pc.sort_indices(answers["bucket"]))
            known = _flat(_joined(answers["known"], bool), bool)
            numbers = np.concatenate([n.reshape(width, -1).T for n in _joined(answers["numbers"], np.float64)])
        own, tf, sizes = (_wide(texts[c][0].as_py()) for c in ("own", "tf", "sizes"))
        kept = pa.ipc.open_stream(texts["kept"][0].as_py()).read_all()
        at = np.where(known, np.cumsum(known) - 1, -1)[np.cumsum(own)]
        hit = at >= 0
        has_text = kept["terms"].to_numpy()
        rows = kept.drop_columns(["terms"]).rename_columns(names)
        return finish(rows, np.repeat(np.arange(len(sizes)), sizes)[hit], tf[hit].astype(np.float64), numbers[at[hit]], has_text)

    return run


def joined_rows(
    rows: DataFrame, terms: Column, table: DataFrame, columns: list[str], width: int, n_bytes: int, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """``finish`` over blocks of rows whose lists of ``terms`` are joined with (term, columns..), as rows of ``schema``.

    Each row is a text of its own and keeps its columns, whatever they hold: nothing is dealt by key, counted by Spark or joined back. ``finish`` gets
    the rows, each entry's row, its count and its numbers, and which rows have a list at all. Tables and numbers are as in ``joined_blocks``.
    With ``keep`` only those columns travel. ``packed`` of what is returned may be forgotten once that is written.
    """
    names = rows.columns if keep is None else keep
    n_buckets = max(task_parts(rows, BUCKET_BYTES), -(-n_bytes // BUCKET_BYTES))
    places = [f"key_{i}" for i in range(len(names))]
    kept = rows.select(*[F.col(c).alias(p) for c, p in zip(names, places)], terms.alias("terms"))
    kinds = {"block": pa.string(), "bucket": pa.int32(), "terms": pa.binary(), "own": pa.binary(), "tf": pa.binary(), "sizes": pa.binary(), "kept": pa.binary()}
    out = "block string, bucket int, terms binary, own binary, tf binary, sizes binary, kept binary"
    packed = written(kept.mapInArrow(_packed_rows(n_buckets, pa.schema(kinds)), out), "blocks")
    sweep(rows.sparkSession)
    asked = packed.where("bucket IS NOT NULL").select("block", "bucket", "terms")
    texts = packed.where("bucket IS NULL").select("block", "own", "tf", "sizes", "kept")
    held = table.select(F.pmod(F.crc32(F.col("term")), F.lit(n_buckets)).cast("int").alias("bucket"), "term", *columns)
    answers = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_answered(columns, width, False), "block string, bucket int, known binary, numbers binary")
    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finished_rows(width, finish, names), schema)
    out.packed = packed
    return out


def unit_weights(keys: pa.Table, key: str, text: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear tf times idf, each key's entries of length 1."""
    raw = (1.0 + np.log(tf)) * idf
    group = _whole(keys[key]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[text]
    return raw / np.sqrt(np.bincount(group, raw * raw, group.max(initial=0) + 1))[group]


def row_weights(row: np.ndarray, n: int, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The same for entries of ``n`` rows that are texts of their own."""
    raw = (1.0 + np.log(tf)) * idf
    return raw / np.sqrt(np.bincount(row, raw * raw, n))[row]
