"""Chunks worked on as a whole: tokens come in the order of chunk and position, and a chunk's are all in one task.

Arrays of a lot of chunks take the place of a shuffle of tokens. A lot has LOT tokens and what the last chunk has beyond;
chunks have at most WHOLE, so a worker holds some 100 bytes for each of WHOLE + LOT tokens. Where tokens are those of plain
texts, the texts come as they are, one row each with url, chunk_id, doc_seq and start, and are split here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import LOWER, UPPER
from lexloom.operators.shingles import slices, text_words

WHOLE, LOT, ROWS = 6_000_000, 1 << 20, 1 << 15


_LOW = np.arange(256, dtype=np.uint8)
_LOW[list(UPPER.encode())] = list(LOWER.encode())
TOKEN = {"chunk_id": "long", "key": "string", "type": "string", "doc_seq": "long", "pos": "long"}


def _word_counts(texts: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([n for _, _, n in slices(texts)] or [np.empty(0, np.int64)]), pa.int64())


def word_count(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.arrow_udf(_word_counts, "long")(text)


def text_tokens(texts: pa.RecordBatch) -> pa.RecordBatch:
    """The tokens of texts, in order: lower-case words, the end, the own url (a null one's key is null)."""
    text, url = (texts.column(c) for c in ("text", "url"))
    marked = pc.binary_join_element_wise(text, "%", pc.binary_join_element_wise("##", url, "", null_handling="replace"), " ", null_handling="replace")
    data, edges, sizes = text_words(marked)
    n, last = len(edges) - 1, np.cumsum(sizes) - 1
    kind = np.full(n, ord("b"), np.uint8)
    kind[last], kind[last - 1] = ord("u"), ord("e")
    strings, width = (pa.string(), np.int32) if edges[-1] < 1 << 31 else (pa.large_string(), np.int64)
    key = pa.Array.from_buffers(strings, n, [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(_LOW[data])])
    if url.null_count:
        named = np.ones(n, bool)
        named[last] = url.is_valid().to_numpy(zero_copy_only=False)
        key = pc.if_else(pa.array(named), key, None)
    chunk, seq, start = (texts.column(c).to_numpy() for c in ("chunk_id", "doc_seq", "start"))
    types = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32)), pa.py_buffer(kind)])
    pos = np.arange(n) + np.repeat(start - last - 1 + sizes, sizes)
    return pa.RecordBatch.from_pydict({"chunk_id": np.repeat(chunk, sizes), "key": key, "type": types, "doc_seq": np.repeat(seq, sizes), "pos": pos, "end": kind == ord("e")})


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole chunks."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk_id").to_numpy()
        cuts = np.flatnonzero(np.diff(chunk)) + 1
        cut = int(cuts[-1]) if len(cuts) else 0 if chunk[0] != last else None  # where the last chunk of the batch begins
        if cut is not None and n + cut >= LOT:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n, last = n + batch.num_rows, chunk[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Lot:
    """Tokens of a lot by chunk and key, in the order of their positions."""

    def __init__(self, table: pa.Table):
        self.table, n = table, table.num_rows
        coded = table["key"].combine_chunks().dictionary_encode("encode")  # null is a key too
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        self.codes, self.keys = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
        self.chunk = self._numbers("chunk_id")
        group = np.cumsum(np.diff(self.chunk, prepend=self.chunk[:1]) != 0) * len(self.keys) + self.codes
        bits = n.bit_length()
        if int(group.max()).bit_length() + bits < 63:  # sorting numbers is faster than sorting their places
            both = np.sort((group << bits) | np.arange(n))
            self.order, group = both & ((1 << bits) - 1), both >> bits
        else:
            self.order = np.argsort(group, kind="stable")
            group = group[self.order]
        self.first = np.flatnonzero(np.diff(group, prepend=-1))  # of each list
        self.sizes = np.diff(np.append(self.first, n))

    def _numbers(self, name: str) -> np.ndarray:
        return self.table[name].combine_chunks().to_numpy(zero_copy_only=False)

    def sorted(self, name: str) -> np.ndarray:
        return self._numbers(name)[self.order]

    def heads(self) -> dict:
        """chunk_id and key of every list."""
        at = self.order[self.first]
        return {"chunk_id": self.chunk[at], "key": self.keys.take(pa.array(self.codes[at]))}

    def stats(self) -> dict:
        docs = self.sorted("doc_seq")
        new = np.diff(docs, prepend=-1) != 0
        new[self.first] = True
        count = np.add.reduceat(new, self.first, dtype=np.int64)
        kind = self.table["type"].combine_chunks().take(pa.array(self.order[self.first]))
        return self.heads() | {"type": kind, "use_count": self.sizes, "doc_count": count, "reference_doc_count": count + (docs[self.first] > 0)}

    def deltas(self) -> np.ndarray:
        pos = self.sorted("pos")
        out = np.diff(pos, prepend=0)
        out[self.first] = pos[self.first]
        return out

    def seeks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether it has a seek row, and that row's index and location."""
        pos, number = self.sorted("pos"), np.repeat(np.arange(len(self.first)), self.sizes)
        index = np.arange(len(pos)) - self.first[number]
        far = number * (1 << 32)  # lists' minima cannot meet
        least = np.minimum.accumulate(np.frexp((pos + 1).astype(np.float64))[1] - index - far) + far  # frexp: bits of a number
        full = np.minimum(index + 1, least + index)
        before = np.roll(full, 1)
        before[self.first] = 0
        return full > before, index, pos + 1


def _stats(lot: Lot) -> dict:
    return lot.stats()


def _posts(lot: Lot, as_text: bool = False) -> dict:
    edges = pa.array(np.append(lot.first, len(lot.order)), pa.int32())
    asked, index, location = lot.seeks()
    n_seek = pa.array(np.append(0, np.cumsum(np.add.reduceat(asked, lot.first, dtype=np.int64))), pa.int32())
    seek, deltas_ = [pa.array(index[asked]), pa.array(location[asked])], pa.array(lot.deltas())
    if as_text:
        joined = lambda at, values: pc.binary_join(pa.ListArray.from_arrays(at, values), ",")
        pairs = pc.binary_join_element_wise(*(x.cast(pa.string()) for x in seek), ":")
        return lot.stats() | {"deltas": joined(edges, deltas_.cast(pa.string())), "seek": joined(n_seek, pairs)}
    return lot.stats() | {"deltas": pa.ListArray.from_arrays(edges, deltas_), "seek": pa.ListArray.from_arrays(n_seek, pa.StructArray.from_arrays(seek, ["index", "location"]))}


def _seek(lot: Lot) -> dict:
    asked, index, location = lot.seeks()
    at = lot.order[asked]
    return {"chunk_id": lot.chunk[at], "key": lot.keys.take(pa.array(lot.codes[at])), "index": index[asked], "location": location[asked]}


def _tokens(lot: Lot, *columns: str) -> dict:
    rows = lot.table.select([c for c in columns if c != "key"]).take(pa.array(lot.order))
    return {c: lot.keys.take(pa.array(lot.codes[lot.order])) if c == "key" else rows[c].combine_chunks() for c in columns} | {"delta": lot.deltas()}


def _mapped(df: DataFrame, columns: list[str], f: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """f's rows of every lot of df: tokens, of which the columns are sent, or texts."""
    texts = "text" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = (text_tokens(b).select([*columns]) for b in batches if b.num_rows) if texts else batches
        for table in lots(tokens):
            out = pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in f(table).items()})
            for k in range(0, out.num_rows, ROWS):
                yield out.slice(k, ROWS)

    return (df if texts else df.select(*columns)).mapInArrow(run, schema)


STATS = "chunk_id long, key string, type string, use_count long, doc_count long, reference_doc_count long"


def posting_stats(tokens: DataFrame) -> DataFrame:
    return _mapped(tokens, ["chunk_id", "key", "type", "doc_seq"], lambda t: _stats(Lot(t)), STATS)


def postings(tokens: DataFrame, as_text: bool = False) -> DataFrame:
    """With as_text deltas joined by commas, and seek's index:location likewise."""
    lists = "deltas string, seek string" if as_text else "deltas array<long>, seek array<struct<index:long,location:long>>"
    return _mapped(tokens, ["chunk_id", "key", "type", "doc_seq", "pos"], lambda t: _posts(Lot(t), as_text), f"{STATS}, {lists}")


def deltas(tokens: DataFrame, *columns: str) -> DataFrame:
    """The columns, chunk_id, key and pos among them, and delta."""
    kinds = TOKEN | dict(tokens.dtypes)
    return _mapped(tokens, [*columns], lambda t: _tokens(Lot(t), *columns), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", delta long")


def seek_rows(tokens: DataFrame) -> DataFrame:
    return _mapped(tokens, ["chunk_id", "key", "pos"], lambda t: _seek(Lot(t)), "chunk_id long, key string, index long, location long")


def _ends(table: pa.Table) -> dict:
    chunk, pos, docs = (table[c].combine_chunks().to_numpy() for c in ("chunk_id", "pos", "doc_seq"))
    ends = np.flatnonzero(table["end"].combine_chunks().to_numpy(zero_copy_only=False))
    at = np.append(ends, len(pos))[np.searchsorted(ends, np.arange(len(pos)))]
    found = (at < len(pos)) & (np.append(chunk, -1)[at] == chunk)
    return {"chunk_id": chunk, "pos": pos, "doc_seq": pa.array(np.append(docs, -1)[at], mask=~found)}


def document_of_all(tokens: DataFrame) -> DataFrame:
    """chunk_id, pos, doc_seq of every token. tokens: chunk_id, pos, doc_seq and end, whether it ends its document."""
    return _mapped(tokens, ["chunk_id", "pos", "doc_seq", "end"], _ends, "chunk_id long, pos long, doc_seq long")
