"""Token ids in files: tokenizer, static range coder, and the way back.

Ids go through a static range asymmetric numeral system.  One frequency table,
counted over all documents, serves every file.  A block holds whole documents and
is coded on its own: ``LANES`` states take the ids in turn (lane = position modulo
LANES) and share one stream of 32-bit words.  A block carries the states and the
stream position at checkpoints, so its parts can be decoded in parallel, and a
checksum.  Blocks are rows of a Parquet table, so files are committed by Spark and
can lie in any store Spark reads; the frequency table lies beside them.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.textscan import trim
from citeloom.session import materialize, shared_path

TOKENIZER = "byte_bpe_50k.json"
#: Appended to each document.
END_ID = 0

LANES = 2048
#: Frequencies add up to 2**PRECISION; states lie in [2**31, 2**63).
PRECISION = 20
_LOW = np.uint64(1 << 31)
#: Steps (LANES ids each) between two checkpoints.
CHECKPOINT = 128
#: A block is closed at so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 19
#: Bytes of text that are encoded together.
TOGETHER = 16 << 20
#: Bytes of pre-tokens whose ids a worker remembers.
REMEMBERED = 24 << 20
#: Characters the model reads at a time.
CHUNK = 2000

#: Letters of the commonest scripts, and what a plain piece of text holds: these, ASCII
#: but control characters and the apostrophe, and single line ends between them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΆΈ-ΊΌΎ-ΡΣ-ώЀ-ҁҊ-ԯא-תؠ-يぁ-ゖァ-ヺ一-龥가-힣"
_PLAIN = f"^[!-&(-@\\[-`{{-~{LETTERS}]+(?:\n[!-&(-@\\[-`{{-~{LETTERS}]+)*$"
#: Classes of a plain piece's bytes: punctuation, letters, digits, line end, the space before it.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x0A] = 3
_SPACE = 4
_CLASS[0x20] = _SPACE
#: A byte no text holds; it stands after each pre-token the model reads.
_END = 0xFF


def _byte_characters() -> np.ndarray:
    """The character by which a byte-level model reads each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u2")
    out[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    out[hidden] = 0x100 + np.arange(len(hidden))
    return out


_CHARACTERS = _byte_characters()


def _separable(path: str) -> bool:
    """Whether text is cut by the usual byte-level pattern, and the byte that no text
    holds is a token that merges with nothing."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    cut, model = read.get("pre_tokenizer") or {}, read["model"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    if read.get("normalizer") or model.get("type") != "BPE" or model.get("dropout"):
        return False
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return False
    sign = chr(_CHARACTERS[_END])
    return sign in model["vocab"] and not any(sign in part for m in model["merges"] for part in m)


class Encoder:
    """Ids of texts by the tokenizer, which encodes equal pieces of a column once
    and remembers pre-tokens.

    Texts are cut before every space that is followed by anything but white space.
    The tokenizer's own pattern never joins text across such a place, so the ids
    of the pieces, one after the other, are those of the text.  Texts that hold an
    added token, which may reach over such places, are encoded as a whole.

    The pattern cuts plain pieces into pre-tokens wherever the class of the characters
    changes.  A sign that merges with nothing is put between new pre-tokens, so that the
    tokenizer's model reads many of them as one.  Other pieces go through the whole
    tokenizer, as all texts do if its file names another pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        border = self.tokenizer.encode("\n\n", add_special_tokens=False).ids
        self.separable = len(border) == 1 and _separable(path)
        if self.separable:
            (self.border,) = border
            self.model = Tokenizer(self.tokenizer.model)
            self.end = self.tokenizer.token_to_id(chr(_CHARACTERS[_END]))
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _read(self, tokens: pa.Array) -> pa.Array:
        """Ids of pre-tokens by the model."""
        if not len(tokens):
            return pa.array([], pa.large_binary())
        data, at = _bytes(tokens)
        marked = np.insert(data, at[1:], np.uint8(_END))
        text = _CHARACTERS[marked].tobytes().decode("utf-16-le")
        stops = at[1:] + np.arange(1, len(at))
        cuts = stops[np.diff(stops // CHUNK, append=-1) != 0].tolist()
        chunks = [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        read = array("H")
        for some in self.model.encode_batch_fast(chunks, add_special_tokens=False):
            read.fromlist(some.ids)
        ids = np.frombuffer(read, np.uint16)
        ends = np.flatnonzero(ids == self.end)
        return _binary(ids[ids != self.end], 2 * np.append(0, ends - np.arange(len(ends))))

    def _learn(self, tokens: pa.Array) -> pa.Array:
        """Ids of distinct pre-tokens, which are remembered."""
        found = pc.index_in(tokens, value_set=self.known)
        new = tokens.filter(found.is_null())
        ids = pa.concat_arrays([self.ids, self._read(new)])
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        at[at < 0] = len(self.known) + np.arange(len(new))
        own = ids.take(pa.array(at))
        if self.known.nbytes + new.nbytes <= REMEMBERED:
            self.known, self.ids = pa.concat_arrays([self.known, new]), ids
        else:  # begin again with those of this column
            kept = len(tokens) if tokens.nbytes <= REMEMBERED else 0
            self.known, self.ids = pa.concat_arrays([tokens.slice(0, kept)]), pa.concat_arrays([own.slice(0, kept)])
        return own

    def _plain(self, pieces: pa.Array, spaced: np.ndarray) -> pa.Array:
        """Ids of plain pieces, of those that are ``spaced`` with a space before them."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        data, at = _bytes(pieces)
        data = np.insert(data, at[:-1][spaced], np.uint8(0x20))
        at = at + np.append(0, np.cumsum(spaced))
        kind = _CLASS[data]
        change = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        change[at[1:-1] - 1] = True
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, at[-1:]])
        tokens = _binary(data, cuts, pa.large_string()).dictionary_encode()
        data, ends = _bytes(self._learn(tokens.dictionary).take(tokens.indices))
        return _binary(data, ends[np.searchsorted(cuts, at)])

    def _other(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space and do not begin with white space."""
        ids: list[bytes] = [b""] * len(pieces)
        together = []
        for i, p in enumerate(pieces):
            if p[-1] < "!" or p[-1].isspace() or "\n\n" in p:
                ids[i] = self.whole(" " + p)
            else:
                together.append(i)
        if together:
            # An empty line between two pieces is one token that no piece holds.
            text = " " + "\n\n ".join([pieces[i] for i in together])
            read = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.append(np.flatnonzero(read == self.border), len(read))
            blob, at = read.tobytes(), 0
            for i, end in zip(together, (2 * ends).tolist(), strict=True):
                ids[i] = blob[at:end]
                at = end + 2
        return ids

    def _pieces(self, pieces: pa.Array, firsts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of pieces that follow a space and of those that begin a text, each one's
        place among them, and which pieces begin with white space."""
        n = len(pieces)
        both = pa.concat_arrays([pieces, firsts])
        plain = pc.match_substring_regex(both, _PLAIN).to_numpy(zero_copy_only=False)
        chosen, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = both.take(pa.array(rest)).to_pylist()
        unsafe = np.zeros(len(both), bool)
        others, whole = [], [b""] * len(rest)
        for k, (i, p) in enumerate(zip(rest.tolist(), texts, strict=True)):
            if i >= n:
                whole[k] = self.whole(p)
            elif not p or p[0] < "!" or p[0].isspace():
                unsafe[i] = True
            else:
                others.append(k)
        for k, ids in zip(others, self._other([texts[k] for k in others]), strict=True):
            whole[k] = ids
        ids = self._plain(both.take(pa.array(chosen)), chosen < n)
        ids = pa.concat_arrays([ids, pa.array(whole, pa.large_binary())])
        place = np.empty(len(both), np.int32)
        place[chosen], place[rest] = np.arange(len(chosen)), len(chosen) + np.arange(len(rest))
        return ids, place, unsafe

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after the other, and the number of each text's."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if not self.separable:
            parts = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), np.uint16), np.array([len(p) // 2 for p in parts])
        added = np.zeros(len(texts), bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuttable = pc.if_else(pa.array(added), "", texts) if added.any() else texts
        lists = pc.split_pattern(cuttable.cast(pa.large_string()), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds -= bounds[0]
        coded = values.dictionary_encode()
        # A text's first piece has no space before it and is an entry of its own.
        firsts = values.take(pa.array(bounds[:-1]))
        at = coded.indices.to_numpy().astype(np.int32)
        at[bounds[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        ids, place, unsafe = self._pieces(coded.dictionary, firsts)
        data, ends = _bytes(ids.take(pa.array(place[at])))
        out = data.view(np.uint16)
        counts = np.diff(ends[bounds]) // 2
        if unsafe.any():
            added[np.searchsorted(bounds, np.flatnonzero(unsafe[at]), "right") - 1] = True
        if added.any():
            out, counts = self._mended(texts, out, counts, np.flatnonzero(added))
        return out, counts

    def _mended(self, texts, ids, counts, rows):
        """Encode some texts as a whole."""
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in rows.tolist():
            parts[i] = np.frombuffer(self.whole(texts[i].as_py()), np.uint16)
        return np.concatenate(parts), np.array([len(x) for x in parts])


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of large strings or binaries, and the ends of its values after 0."""
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
    held = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def _binary(data: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Values that lie one after the other, given their ends after 0."""
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(kind or pa.large_binary(), len(ends) - 1, buffers)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Encoder(path)


def _groups(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Consecutive texts of about ``size`` bytes together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)), at + 1)
        yield texts.slice(at, to - at)
        at = to


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def tokenised(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids, counts``: ids as 16-bit integers with the end id.  A task's last
    row has no ids but the task's counts of all 65536 ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(tokenizer))
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text").fill_null("")
            blobs: list[bytes] = []
            for some in _groups(texts, TOGETHER):
                ids, sizes = encoder.column(some)
                ends = np.cumsum(sizes)
                out = np.insert(ids, ends, np.uint16(end_id))  # the end id after each text
                counts += np.bincount(out, minlength=1 << 16)
                stop = 2 * (ends + np.arange(1, len(ends) + 1))
                blob = out.tobytes()
                blobs += [blob[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], schema=_IDS
            )
            del blobs
            trim()
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                schema=_IDS,
            )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column("counts"):
            total += np.frombuffer(blob.as_py(), np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Coder frequencies of the 65536 ids: at most one number per id."""
    found = tokens.filter("counts IS NOT NULL").select("counts").mapInArrow(_summed, "id long, n long")
    rows = found.groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return scaled(counts)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies with the sum 2**PRECISION, at least 1 where there is a count."""
    total = 1 << PRECISION
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint64)
    share = counts.astype(np.float64) / counts.sum()
    freq = np.where(used, 1 + np.floor(share * (total - int(used.sum()))), 0).astype(np.int64)
    freq[int(freq.argmax())] += total - int(freq.sum())
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """Code a block: header, checkpoints, stream."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    words = 0
    shift, full = np.uint64(PRECISION), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        own = ids[step * LANES : (step + 1) * LANES]
        x = state[: len(own)]
        f, c = freq[own], start[own]
        over = x >= f << np.uint64(63 - PRECISION)
        out = x[over]
        chunks.append((out & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        words += len(out)
        x = np.where(over, x >> full, x)
        high = x // f
        state[: len(own)] = (high << shift) + (x - high * f) + c
        if step % CHECKPOINT == 0:
            marks.append((words, state.copy()))
    # The decoder runs forward: chunks and checkpoints in the opposite order.
    stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    places = np.array([words - w for w, _ in marks[::-1]], np.int64)
    states = np.concatenate([s for _, s in marks[::-1]]) if marks else np.zeros(0, np.uint64)
    head = np.array([n, len(places), words], np.int64)
    return head.tobytes() + places.tobytes() + states.tobytes() + stream.tobytes()


def decode_block(blob: bytes, freq: np.ndarray, start: np.ndarray, slots: np.ndarray, part: int | None = None) -> np.ndarray:
    """The ids of a block, or those from one checkpoint to the next."""
    n, k, words = np.frombuffer(blob, np.int64, 3)
    places = np.frombuffer(blob, np.int64, k, 24)
    states = np.frombuffer(blob, np.uint64, k * LANES, 24 + 8 * k).reshape(k, LANES)
    stream = np.frombuffer(blob, np.uint32, words, 24 + 8 * k + 8 * k * LANES).astype(np.uint64)
    steps = -(-int(n) // LANES)
    begin, stop = (0, steps) if part is None else (part * CHECKPOINT, min(steps, (part + 1) * CHECKPOINT))
    if begin >= stop:
        return np.zeros(0, np.uint16)
    mark = begin // CHECKPOINT
    state, at = states[mark].copy(), int(places[mark])
    out = np.zeros(min(int(n), stop * LANES) - begin * LANES, np.uint16)
    shift, mask, full = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), np.uint64(32)
    for step in range(begin, stop):
        size = min(LANES, int(n) - step * LANES)
        x = state[:size]
        slot = x & mask
        own = slots[slot]
        out[(step - begin) * LANES : (step - begin) * LANES + size] = own
        x = freq[own] * (x >> shift) + slot - start[own]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << full) | stream[at : at + len(low)]
        at += len(low)
        state[:size] = x
    return out


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, their running sums, and the id of every slot."""
    ends = np.cumsum(freq)
    return freq, ends - freq, np.repeat(np.arange(len(freq)).astype(np.uint16), freq.astype(np.int64))


_BLOCK_DDL = "file int, block int, docs array<long>, sizes array<long>, n_tokens long, crc long, payload binary"
_BLOCK = pa.schema(
    [
        ("file", pa.int32()),
        ("block", pa.int32()),
        ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("n_tokens", pa.int64()),
        ("crc", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _blocks(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        f, start, _ = tables(freq)
        file, block = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload = encode_block(ids, f, start)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([file], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([zlib.crc32(payload)], pa.int64()),
                    pa.array([payload], pa.binary()),
                ],
                schema=_BLOCK,
            )

        for batch in batches:
            for key, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(key)
                parts.append(np.frombuffer(blob.as_py(), np.uint16))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    block, docs, parts, held = block + 1, [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
) -> str:
    """Write all documents' ids below ``path`` in ascending key order.

    Null texts count as empty, null keys come first, rows of one key are ordered by
    their ids.  Other columns are ignored; an empty table gives empty files.
    """
    tokens = materialize(tokenised(docs, key, text, tokenizer, end_id), "token-ids")
    freq = frequencies(tokens)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, int(n)) for i, n in enumerate(freq) if n], "id int, freq long")
    table.coalesce(1).write.parquet(f"{path}/frequencies")
    tie = F.xxhash64("ids")
    ordered = (
        tokens.filter("ids IS NOT NULL")
        .select("doc_id", "ids", tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    blocks = ordered.select("doc_id", "ids").mapInArrow(_blocks(freq), _BLOCK_DDL)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def stored_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    freq = np.zeros(1 << 16, np.uint64)
    for r in spark.read.parquet(f"{path}/frequencies").collect():
        freq[r["id"]] = r["freq"]
    return freq


_READ = pa.schema(
    [("file", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()),
     ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


def decoded(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32[, ids]``.

    A block whose checksum does not hold raises an error.
    """
    freq = stored_frequencies(spark, path)
    stored = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, start, slots = tables(freq)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["crc"]:
                    raise ValueError(f"checksum of block {row['block']} of file {row['file']}")
                got = decode_block(row["payload"], f, start, slots).astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * k, pa.int32()),
                        pa.array([row["block"]] * k, pa.int32()),
                        pa.array(row["docs"], pa.int64()),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array([zlib.crc32(got[a:b].tobytes()) for a, b in spans], pa.int64()),
                        pa.array([got[a:b].tobytes() if ids else None for a, b in spans], pa.binary()),
                    ],
                    schema=_READ,
                )

    rows = stored.select("file", "block", "docs", "sizes", "crc", "payload").mapInArrow(
        run, "file int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long, ids binary"
    )
    # Two short sums: over the files, and over the blocks of each file.
    from pyspark.sql import Window

    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    over_files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = totals.select("file", F.coalesce(F.sum("n").over(over_files), F.lit(0)).alias("file_start"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.select("file", "block", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)).alias("block_start"))
        .join(files, "file")
        .select("file", "block", (F.col("file_start") + F.col("block_start")).alias("base"))
    )
    return rows.join(starts, ["file", "block"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else [])
    )


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all documents to the shared folder and read them back."""
    spark = docs.sparkSession
    return decoded(spark, write_tokens(docs, shared_path(spark, "tokens"), key, text))
