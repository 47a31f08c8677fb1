"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding.

Encoding. A task cuts its texts into pre-tokens and gathers texts into blocks
of about ``BLOCK_CHARS`` characters. Each block sends its distinct words to
``buckets`` hash buckets of the global vocabulary (one row a block and bucket,
so a word that every text holds is one entry a block, never a hot key) and, in
the same exchange, one row with the positions to the block: for each text the
places of its words in the block's list. A bucket encodes each of its distinct
words once and sends the ids to the blocks, which put them together by
position. Packing the rows a block and bucket, instead of one row a word, is
what keeps the shuffle near the input's size.

Decoding looks every id up in the token-byte table: the vocabulary file, whose
size is fixed and checked, is broadcast. ``encode(decoded=...)`` decodes in the task that
puts the ids together: ``decode`` behind it would be a second Python worker beside each of that stage's.

The rank file's path is a parameter, read once on the driver. ``docs`` must
give the same rows in the same order when a lost task is read again (files, a
written table or a checkpoint), as blocks are numbered by task and place.

Edge cases: a null text is empty (no ids); repeated rows and repeated or null
ids give one row each; very long texts are cut into slices only to bound the
word lists, at pre-token ends; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructField, StructType

from opinio.llm.common import small_batches

BLOCK_CHARS = 1 << 22
_BATCH_BYTES = 4 << 20
_SLICE = 1 << 18
MAX_VOCABULARY_BYTES = 64 << 20
_CACHED_WORDS = 1 << 18
#: Fixed by the pattern: endings that an apostrophe takes along.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file (its size is checked)."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is larger than the broadcast bound")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@cache
def _kinds() -> np.ndarray:
    """Code point -> letter, number, white space or other."""
    import regex
    at = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    text, kinds = at.tobytes().decode("utf-32-le"), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kinds[at[m.start():m.end()]] = kind
    return kinds


def pretoken_starts(text: str) -> np.ndarray:
    """Where the pre-tokens of ``public_tokenizers.PATTERN`` start; they cover the text."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    # the last white space before a run stands alone, or goes with the run if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:])
    start[last] = True
    blank = last[codes[last] == 32]
    start[blank + 1] = False
    # an apostrophe that starts a run takes a contraction's ending along
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[(quote + 1 < n)]
    for q in quote[kinds[np.minimum(quote + 1, n - 1)] == _LETTER].tolist():
        for end in CONTRACTIONS:
            if text.startswith(end, q + 1):
                start[q + 1] = False
                if q + 1 + len(end) < n and kinds[q + 1 + len(end)] == _LETTER:
                    start[q + 1 + len(end)] = True
                break
    return np.flatnonzero(start)


def pretokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in order, in slices."""
    bounds = np.append(pretoken_starts(text), len(text))
    for i in range(0, len(bounds) - 1, _SLICE):
        ends = bounds[i:i + _SLICE + 1].tolist()
        yield [text[a:b] for a, b in zip(ends[:-1], ends[1:])]


_PARTS = "via bigint, block bigint, bucket int, words binary, places binary, texts binary"
_TYPES = {"via": pa.int64(), "block": pa.int64(), "bucket": pa.int32(), "words": pa.binary(), "places": pa.binary(),
          "texts": pa.binary()}
_IDS = "via bigint, bucket int, ids binary"


def _press(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpress(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], decompressed_size=size, asbytes=True) if size else b""


def _pack(items: list[bytes]) -> bytes:
    """Lengths (uint32) then bytes, compressed."""
    lens = np.fromiter(map(len, items), np.uint32, len(items))
    return _press(np.uint32(len(items)).tobytes() + lens.tobytes() + b"".join(items))


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = _unpress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4), raw[4 + 4 * n:]


def _blocks(buckets: int, key_type: pa.DataType):
    """Task: (key, text) batches -> block rows."""
    def emit(number: int, keys: list, places: list[np.ndarray], seen: dict[str, int]) -> pa.RecordBatch:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32 | number
        words = [w.encode("utf-8", "surrogatepass") for w in seen]
        of = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
        sizes = np.array([len(p) for p in places], np.uint32)
        whole = np.concatenate(places)
        # frequent words first within a bucket; a word's place is its rank there times
        # the buckets plus its bucket, so frequent words get small numbers, which compress
        order = np.lexsort((-np.bincount(whole, minlength=len(words)), of))
        held, number_of = [], np.empty(len(words), np.uint32)
        for bucket, lo, hi in _runs(of[order]):
            number_of[order[lo:hi]] = np.arange(hi - lo) * buckets + bucket
            held.append((bucket, [words[i] for i in order[lo:hi]]))
        planes = number_of[whole].view(np.uint8).reshape(-1, 4).T.tobytes()
        packed_places = _press(sizes.tobytes() + planes)
        rows = [(-1 - b, block, b, _pack(ws), None, None) for b, ws in held]
        sink = pa.BufferOutputStream()
        table = pa.record_batch([pa.array(keys, key_type)], names=["key"])
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        rows.append((block, block, -1, None, packed_places, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.values())], list(_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chars, keys, places = 0, 0, [], []
        seen: dict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                keys.append(key.as_py())
                parts = [np.fromiter(map(seen.__getitem__, ws), np.uint32, len(ws)) for ws in pretokens(text)]
                places.append(np.concatenate(parts) if parts else np.empty(0, np.uint32))
                chars += len(text) + 64
                if chars >= BLOCK_CHARS:
                    yield emit(number, keys, places, seen)
                    number, chars, keys, places = number + 1, 0, [], []
                    seen.clear()
        if keys:
            yield emit(number, keys, places, seen)

    return run


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cuts.tolist(), len(values)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            yield int(values[lo]), lo, hi


def _encode_buckets(shared):
    """Task: rows of whole buckets -> the ids of each row's words; a word is
    encoded once (again only after the bounded cache was emptied)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        # a word goes through the merges whole, so the pattern is any text
        merges = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        for batch in batches:
            blocks, of, out = [], [], []
            for block, bucket, row in zip(*(batch.column(c) for c in ("block", "bucket", "words"))):
                if not row.is_valid:
                    continue
                lens, raw = _unpack(row.as_py())
                ends = np.cumsum(lens)
                got = []
                for a, b in zip((ends - lens).tolist(), ends.tolist()):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(merges.encode_ordinary(word.decode()), "<u4").tobytes()
                    got.append(ids)
                blocks.append(block.as_py())
                of.append(bucket.as_py())
                out.append(_pack(got))
                if len(known) > _CACHED_WORDS:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(of, pa.int32()), pa.array(out, pa.binary())],
                                             ["via", "bucket", "ids"])

    return run


def _reassemble(buckets: int, key_type: pa.DataType, shared=None):
    """One block: its positions and its words' ids by bucket -> one row a text, decoded too by
    the token-byte table ``shared``."""
    schema = pa.schema([("key", key_type), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    if shared is not None:
        schema = schema.append(pa.field("decoded", pa.binary()))

    def run(held: pa.Table, encoded: pa.Table) -> pa.Table:
        if not held.num_rows or held.column("places")[0].as_py() is None:  # the words of a bucket
            return schema.empty_table()
        head, places = held.column("texts")[0].as_py(), held.column("places")[0].as_py()
        counts, raws, base, size = [], [], np.zeros(buckets, np.int64), 0
        for bucket, ids in zip(encoded.column("bucket").to_pylist(), encoded.column("ids").to_pylist()):
            n, raw = _unpack(ids)
            base[bucket] = size
            size += len(n)
            counts.append(n // 4)
            raws.append(raw)
        keys = pa.ipc.open_stream(head).read_all().column("key").combine_chunks()
        raw = _unpress(places)
        sizes = np.frombuffer(raw, np.uint32, len(keys))
        planes = np.frombuffer(raw, np.uint8, offset=4 * len(keys)).reshape(4, -1)
        ids = np.frombuffer(b"".join(raws), "<u4")
        count = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        first = np.cumsum(count) - count
        out, tokens, lo = [], [], 0
        for n in sizes.tolist():
            number = np.ascontiguousarray(planes[:, lo:lo + n].T).view(np.uint32).ravel().astype(np.int64)
            lo += n
            words = base[number % buckets] + number // buckets
            c = count[words]
            total = int(c.sum())
            at = np.repeat(first[words] - (np.cumsum(c) - c), c) + np.arange(total)
            out.append(ids[at].tobytes())
            tokens.append(total)
        columns = [keys, pa.array(tokens, pa.int64()), pa.array(out, pa.binary())]
        if shared is not None:
            columns.append(pa.array([_bytes_of(packed, shared.value) for packed in out], pa.binary()))
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
           buckets: int | None = None, decoded: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids binary): the ids of each whole text as
    little-endian unsigned 32-bit integers. ``decoded`` adds a column of that name as
    ``decode`` does."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * partitions
    key = docs.schema[id_col].dataType
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    key_type = to_arrow_type(key)
    parts = small_batches(docs).select(id_col, text_col).mapInArrow(_blocks(buckets, key_type), _PARTS)
    # one exchange for both: words go to their bucket, positions to their block, where they wait for the ids
    dealt = parts.repartition(partitions, "via")
    encoded = dealt.mapInArrow(_encode_buckets(shared), _IDS)
    fields, table = f"key {key.simpleString()}, n_tokens bigint, ids binary", None
    if decoded is not None:
        fields, table = f"{fields}, decoded binary", spark.sparkContext.broadcast(_token_bytes(ranks_path))
    out = (dealt.groupBy("via").cogroup(encoded.groupBy("via")).applyInArrow(_reassemble(buckets, key_type, table), fields)
           .withColumnRenamed("key", id_col))
    return out if decoded is None else out.withColumnRenamed("decoded", decoded)


def _token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each token, by rank."""
    ranks = load_ranks(ranks_path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _bytes_of(packed: bytes | None, table: list[bytes]) -> bytes | None:
    return None if packed is None else b"".join(map(table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``out``: the bytes of its packed ids, by the
    token-byte table (null ids stay null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(_token_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo, size, done = batch.column(ids_col), 0, 0, []
            for i, packed in enumerate(ids, 1):
                packed = packed.as_py()
                done.append(_bytes_of(packed, shared.value))
                size += len(packed or b"")
                if size >= _BATCH_BYTES or i == len(ids):
                    part = batch.slice(lo, i - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], [*part.schema.names, out])
                    lo, size, done = i, 0, []

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, BinaryType())]))
