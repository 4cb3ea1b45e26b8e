"""Token-ID output: independent zstandard frames, a trailing seek table, per-frame checksums.

One frame holds the little-endian uint32 ids of one document, so a reader decompresses only
the documents asked for. After the documents comes one frame with the JSON list of doc_ids,
then the seek table as a skippable frame: per frame its compressed size, content size and the
low 32 bits of the content's XXH64, then frame count, descriptor and magic number.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import durable, shared_folder, shuffle_partitions

END_ID = 1
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Pieces that went the whole way that a worker keeps ids of, beside those of one call; a table only saves time.
_CACHE_WORDS = 120_000
#: Bytes of text that are encoded at once, and one text more: more takes memory, fewer repeat more words.
CALL_BYTES = 8 << 20
#: A shard holds about so many bytes of text and rows at most: its seek table and ids are in memory.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 1 << 20
#: Rows of one batch of the reader.
READ_ROWS = 8_192


class FrameWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.table, self.doc_ids = out, bytearray(), []
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table += struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self._frame(ids)

    def finish(self) -> None:
        self._frame(json.dumps(self.doc_ids).encode())
        size = len(self.table) + 9
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, size) + bytes(self.table))
        self.out.write(struct.pack("<IBI", len(self.table) // 12, CHECKSUM_FLAG, SEEKABLE_MAGIC))


class FrameReader:
    """Random access over a seekable file object of known size."""

    def __init__(self, src, size: int):
        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        src.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        src.seek(size - 17 - 12 * frames)
        head = struct.unpack("<II", src.read(8))
        if head != (SKIPPABLE_MAGIC, 12 * frames + 9):
            raise ValueError("seek table and its frame disagree")
        self.entries = np.frombuffer(src.read(12 * frames), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.doc_ids = json.loads(self.frame(frames - 1))

    def frame(self, i: int) -> bytes:
        packed, raw, check = (int(x) for x in self.entries[i])
        self.src.seek(int(self.starts[i]))
        data = self.zstd.decompress(self.src.read(packed), max_output_size=max(raw, 1))
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for i, doc_id in enumerate(self.doc_ids):
            yield doc_id, self.frame(i)


def _open(uri: str, mode: str):
    """Any store that Arrow's file systems reach (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def _byte_letters() -> dict[int, str]:
    """The library's byte-level alphabet, by its rule: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


# What the tokenizer file must say for pieces to be encoded on their own.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_pieces(config: dict) -> bool:
    """Whether the normaliser and the splitter of a tokenizer are those that the shortcuts know, and
    its model ends each pre-token with a token that says so, whatever the letters."""
    normal, split = config.get("normalizer") or {}, (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    patterns = split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True and split[0].get("behavior") == "Removed"
    letters = split[-1].get("type") == "ByteLevel" and not split[-1].get("add_prefix_space") and not split[-1].get("use_regex")
    model = config.get("model") or {}
    end, vocab = model.get("end_of_word_suffix"), model.get("vocab") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
    ends = plain and bool(end) and all(x in vocab and x + end in vocab for x in _byte_letters().values())
    return normal.get("normalizers") == _NORMALIZERS and len(split) == 2 and patterns and letters and ends and not config.get("post_processor")


#: Precomposed Latin letters that one letter each is the lower case of; closing marks.
_LATIN = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and c != 0x130)
_MARKS = ".,!?;:*&%$#)|"
#: Words of one call of the library; texts whose ids are put in place at once.
_CALL_WORDS, _CALL_TEXTS = 2_000, 256


@cache
def make_encoder(tokenizer_path: str, cache_words: int = _CACHE_WORDS):
    """Texts, a list or an Arrow array, -> ids as bytes. A tokenizer of another normaliser, splitter or
    model than the shortcuts know takes the library's whole way for every text. In this one white
    space never lies inside a token, so each distinct blank-separated piece of a call is encoded
    once and Arrow puts its ids wherever the piece stands. Of a piece of precomposed Latin letters
    and closing marks the letters go straight to the library's model, as its normaliser and splitter
    do nothing there but lower the letters and part the marks: many words at once, told apart by
    the tokens that end a word. Marks and any other piece take the library's whole way, and a bounded
    table serves their repeats. A worker's tasks share one encoder."""
    import os

    import pyarrow as pa
    import pyarrow.compute as pc

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold memory
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    tk = Tokenizer.from_file(tokenizer_path)
    config = json.loads(tk.to_str())
    end = struct.pack("<I", END_ID)

    def whole(texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (tk.encode(t, add_special_tokens=False).ids for t in texts)]

    if not _by_pieces(config):
        return lambda texts: [raw + end for raw in whole([t or "" for t in (texts if isinstance(texts, list) else texts.to_pylist())])]

    vocab, suffix = config["model"]["vocab"], config["model"]["end_of_word_suffix"]
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    letters = {b: x for b, x in _byte_letters().items() if b != ord(" ")}
    model = Tokenizer(tk.model)
    model.pre_tokenizer = CharDelimiterSplit(" ")
    latin = f"^[{_LATIN}]+[{_MARKS}]*$"
    del config, vocab

    def direct(words: pa.Array) -> pa.Array:
        """Ids of lower-case words by the model alone."""
        ids, ends, size = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 0
        for a in range(0, len(words), _CALL_WORDS):
            some = words.slice(a, _CALL_WORDS)
            text = " ".join(some.to_pylist())
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(letters)
            got = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(last[got]) + 1
            if len(cuts) != len(some):
                raise ValueError("the model did not end each word with a token that says so")
            ids.append(got)
            ends.append(size + cuts)
            size += len(got)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(4 * np.concatenate(ends)), pa.py_buffer(np.concatenate(ids))])

    known: dict[str, bytes] = {}

    def served(words: list[str]) -> pa.Array:
        """Ids by the whole way. Beyond `cache_words` the table keeps those of this call only."""
        got = {w: known[w] if w in known else whole([w])[0] for w in words}
        if len(known) + len(got) > cache_words:
            known.clear()
        known.update(got)
        return pa.array(got.values(), pa.large_binary())

    def encode(texts) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        del split
        words = coded.dictionary
        plain = pc.match_substring_regex(words, latin)
        some = words.filter(plain)
        cores, marks = (x.dictionary_encode() for x in (pc.utf8_lower(pc.utf8_rtrim(some, _MARKS)), pc.utf8_ltrim(some, _LATIN)))
        ids = pc.binary_join_element_wise(direct(cores.dictionary).take(cores.indices), served(marks.dictionary.to_pylist()).take(marks.indices), pa.scalar(b"", pa.large_binary()))
        ids = pa.concat_arrays([ids, served(words.filter(pc.invert(plain)).to_pylist())])
        del words, some, cores, marks
        plain, indices, out = plain.to_numpy(zero_copy_only=False), coded.indices, []
        place = np.empty(len(plain), np.int32)
        place[plain], place[~plain] = np.split(np.arange(len(plain), dtype=np.int32), [plain.sum()])
        place = pa.array(place)
        for a in range(0, len(texts), _CALL_TEXTS):
            at = starts[a : a + _CALL_TEXTS + 1]
            some = ids.take(place.take(indices.slice(at[0], at[-1] - at[0])))
            at = np.frombuffer(some.buffers()[1], np.int64)[at - at[0]].tolist()
            raw = memoryview(some.buffers()[2] or b"")
            out += [b"".join((raw[i:j], end)) for i, j in zip(at, at[1:])]
        return out

    return encode


def _pieces(batch, most_bytes: int):
    """Slices of an Arrow batch with bounded text."""
    import pyarrow.compute as pc

    ids, texts = batch.column(0), batch.column(1)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // most_bytes)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if a < b:
            yield ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a)


def _in_order(docs: DataFrame, shards: int | None) -> DataFrame:
    """The documents by doc_id in as many ranges as their bytes and rows ask for.

    The head of the text and a hash, which follow doc_id in the order, part rows of one id."""
    keyed = docs.select("doc_id", "text", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_text_hash"))
    if shards is None:
        size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
        shards = max(shuffle_partitions(docs.sparkSession), -(-size // SHARD_BYTES), -(-rows // SHARD_ROWS))
    return keyed.repartitionByRange(shards, "doc_id", "_head", "_text_hash").sortWithinPartitions("doc_id", "_head", "_text_hash", "text").select("doc_id", "text")


def write_token_frames(docs: DataFrame, folder: str, tokenizer_path: str, shards: int | None = None, as_they_come: bool = False, cache_words: int = _CACHE_WORDS, call_bytes: int = CALL_BYTES) -> DataFrame:
    """Write the documents in ascending doc_id order as shard files under `folder`.

    With `as_they_come` the partitions of `docs` are the shards and their order stays, so that
    a mix that was shuffled and written needs no second sort.

    Returns the manifest (shard, path, n_docs, n_tokens, size), held durably: it is the commit.
    Each attempt writes a file of its own, so a retried task cannot harm what a manifest names.
    Null text is empty; a long text is one frame; null doc_id comes first; rows with equal
    doc_id follow the first 64 characters of their text, then its hash; an empty table gives
    no shard. Columns other than doc_id and text are ignored.
    """
    ordered = docs.select("doc_id", "text") if as_they_come else _in_order(docs, shards)

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.idz"
        encode = out = writer = None
        tokens = 0
        for batch in batches:
            for ids, texts in _pieces(batch, call_bytes):
                if out is None:
                    encode, out = make_encoder(tokenizer_path, cache_words), _open(path, "w")
                    writer = FrameWriter(out)
                for doc_id, raw in zip(ids, encode(texts), strict=True):
                    writer.add(doc_id, raw)
                    tokens += len(raw) // 4
        if out is not None:
            writer.finish()
            size = out.tell()
            out.close()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": path, "n_docs": len(writer.doc_ids), "n_tokens": tokens, "size": size}])

    return durable(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, size long"))


def read_token_frames(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, frame."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    n = shuffle_partitions(spark)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = placed.repartitionById(n, (F.col("shard") % n).cast("int"))

    def read(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "frame"]
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"], "r") as src:
                    at, rows = row["first"], []
                    for k, (doc_id, raw) in enumerate(FrameReader(src, row["size"]).documents()):
                        rows.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), row["shard"], k))
                        at += len(raw) // 4
                        if len(rows) == READ_ROWS or k + 1 == row["n_docs"]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                            rows = []

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, frame long")


def token_frames(docs: DataFrame, tokenizer_path: str, as_they_come: bool = False, cache_words: int = _CACHE_WORDS, call_bytes: int = CALL_BYTES) -> DataFrame:
    """Write `docs` to the shared folder and read the files back."""
    folder = shared_folder(docs.sparkSession, "token-frames")
    return read_token_frames(write_token_frames(docs, folder, tokenizer_path, as_they_come=as_they_come, cache_words=cache_words, call_bytes=call_bytes))
