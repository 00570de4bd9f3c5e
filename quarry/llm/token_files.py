"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A corpus becomes shards. Shard ``k`` holds the documents of the k-th range of ``doc_id`` and is
three files in one folder:

    ``k.ids``      token ids, end to end, little-endian unsigned (16 or 32 bits)
    ``k.offsets``  n + 1 unsigned 64-bit offsets, in tokens, of its n documents
    ``k.docs``     n signed 64-bit document ids (null: the smallest value)

and one row of the manifest (shard, n_docs, n_tokens). The place of a shard in the whole corpus,
``base_doc`` and ``base_token``, is the prefix sum of the manifest in shard order, so no task needs
to know what another one wrote. A task writes under a name of its own and renames at its end: a
task that is run again, after a lost executor, replaces whole files by equal ones.

Nulls: a null text is an empty document; a null id sorts first. Repeated ids keep a row each, in
order of their text. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import filesystem, only, scratch_path, slices, table, written

NULL_ID = np.iinfo(np.int64).min
CACHE_UNITS = 900_000

_state: dict = {}


def units(text: str) -> list[str]:
    """Cut before each space that a non-space follows: the pre-tokeniser always cuts there, so the
    parts can be encoded apart from each other."""
    first, *rest = text.split(" ")
    out = [first]
    for part in rest:
        if part and not part[0].isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out if out[0] else out[1:]


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit once while it stays cached.

    Most texts have single spaces and line ends between their words; their words are looked up
    without their space. Of byte-level vocabularies, a new word of Latin letters, with signs
    behind it perhaps, is one pre-token (or two), which goes straight to the library's merges; all
    else goes through its whole pipeline. Other texts are cut by ``units``.
    """

    SIGNS = string.punctuation

    def __init__(self, tokenizer_path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = dtype
        self.words: dict[str, bytes] = {}  # of " " + word, or of the key itself if it starts with a line end
        self.literal: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.symbols = {b: chr(256 + i) for i, b in enumerate(moved)}  # bytes that have no sign of their own
        form = str(self.tokenizer.pre_tokenizer)
        self.bytewise = "ByteLevel(add_prefix_space=False" in form and "use_regex=True" in form and self.tokenizer.normalizer is None
        self.signs: dict[str, bytes] = {"": b""}

    def _signs(self, signs: str) -> bytes:
        if signs not in self.signs:
            self.signs[signs] = self._merged(signs)
        return self.signs[signs]

    def _merged(self, symbols: str) -> bytes:
        return array("H" if self.dtype == "<u2" else "I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()

    def _learn(self, known: dict[str, bytes], new: set[str], whole) -> None:
        """Add the ids of ``whole(key)`` for each key; ``new`` keys have no space in front if they
        are words."""
        rest = []
        for key in new:
            word = key.rstrip(self.SIGNS)
            if self.bytewise and known is self.words and word.isalpha() and (word.isascii() or max(word) < "ɐ"):
                symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
                known[key] = self._merged("Ġ" + symbols) + self._signs(key[len(word) :])
            else:
                rest.append(key)
        for key, e in zip(rest, self.tokenizer.encode_batch_fast([whole(k) for k in rest], add_special_tokens=False)):
            known[key] = np.array(e.ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        parts, plain, words, literal = [], [], set(), set()
        for text in texts:
            if text and " ".join(text.split()) == text.replace("\n", " "):
                part = text.replace("\n", " \n").split(" ")
                words.update(part[1:])
                literal.add(part[0])
                plain.append(True)
            else:
                part = units(text)
                literal.update(part)
                plain.append(False)
            parts.append(part)
        if len(self.words) + len(self.literal) > CACHE_UNITS:
            self.words.clear()
            self.literal.clear()
        self._learn(self.words, words.difference(self.words), lambda w: w if w[0] == "\n" else " " + w)
        self._learn(self.literal, literal.difference(self.literal), lambda u: u)
        word, unit = self.words.__getitem__, self.literal.__getitem__
        return [unit(p[0]) + b"".join(map(word, p[1:])) if simple else b"".join(map(unit, p)) for p, simple in zip(parts, plain)]


def _encoder(path: str, dtype: str) -> UnitEncoder:
    if _state.get("key") != (path, dtype):
        _state.update(key=(path, dtype), encoder=UnitEncoder(path, dtype))
    return _state["encoder"]


def _put(store, source: str, target: str) -> None:
    """Rename; some stores don't rename onto a file that an earlier try has left."""
    if store.get_file_info(target).type != pafs.FileType.NotFound:
        store.delete_file(target)
    store.move(source, target)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, bits: int = 16) -> DataFrame:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each, write shards in ascending doc_id
    order and return the manifest (shard, n_docs, n_tokens, base_doc, base_token)."""
    dtype = f"<u{bits // 8}"
    end = np.array([end_id], dtype=dtype).tobytes()

    def write(batches):
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = filesystem(folder)
        encoder = None
        counts, ids, temporary = [], [], f"{root}/{shard}.{attempt}.tmp"
        out = None
        for batch in slices(batches):
            if out is None:
                store.create_dir(root)
                out, encoder = store.open_output_stream(temporary), _encoder(tokenizer_path, dtype)
            for coded in encoder.encode(batch.column(1).fill_null("").to_pylist()):
                out.write(coded + end)
                counts.append(len(coded) // (bits // 8) + 1)
            ids.append(np.asarray(batch.column(0).fill_null(NULL_ID), dtype="<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        for name, data in ((f"{shard}.offsets", offsets.tobytes()), (f"{shard}.docs", np.concatenate(ids).tobytes())):
            with store.open_output_stream(f"{root}/{name}.{attempt}.tmp") as f:
                f.write(data)
            _put(store, f"{root}/{name}.{attempt}.tmp", f"{root}/{name}")
        _put(store, temporary, f"{root}/{shard}.ids")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [len(counts)], "n_tokens": [int(offsets[-1])]})

    shards = (
        only(docs, doc_id="long", text="string")
        # very many rows of one id, or of none, are split by the beginnings of their texts
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(write, "shard int, n_docs long, n_tokens long")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return written(shards, "manifest").withColumns(
        {"base_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)), "base_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))}
    )


def open_ids(folder: str, shard: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and document ids of a shard: memory-mapped where the folder is a mounted one,
    else read."""
    store, root = filesystem(folder)

    def load(name: str, dtype: str) -> np.ndarray:
        if store.type_name == "local":
            return np.memmap(f"{root}/{shard}.{name}", dtype=dtype, mode="r")
        with store.open_input_file(f"{root}/{shard}.{name}") as f:
            return np.frombuffer(f.read(), dtype=dtype)

    return load("ids", f"<u{bits // 8}"), load("offsets", "<u8"), load("docs", "<i8")


def read_token_files(manifest: DataFrame, folder: str, bits: int = 16) -> DataFrame:
    """One row per document, from the files: doc_id, position, start, n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = open_ids(folder, row["shard"], bits)
                at = offsets.astype(np.int64)
                for a in range(0, len(docs), 2000):
                    b = min(a + 2000, len(docs))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs[a:b].astype(np.int64), pa.int64(), mask=docs[a:b] == NULL_ID),
                            "position": pa.array(np.arange(a, b) + row["base_doc"], pa.int64()),
                            "start": pa.array(at[a:b] + row["base_token"], pa.int64()),
                            "n_tokens": pa.array(np.diff(at[a : b + 1]), pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, "doc_id long, position long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)
