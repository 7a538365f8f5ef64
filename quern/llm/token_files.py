"""Token ids as binary files with Elias-Fano boundaries.

Documents are range-partitioned and sorted by id; each task encodes its range and streams one file:
the ids of all its documents, one after the other, as little-endian numbers of 16 or 32 bits (by the
vocabulary's size); then two Elias-Fano sequences, where each document starts and the rising doc_ids;
then a footer. Select on the first one gives any document's place without a table of 64-bit offsets.
A manifest names the files in order with the ids before each. Files are written under a task's own
name and then moved, so a task that runs twice leaves one whole file.

A text's ids are those of its units (a word with the white space before it) in order, since the
tokenizer never joins a word to white space after it; each distinct unit is encoded once and kept.

Defined results:
* null or empty text: the end id alone. Special strings inside texts become their ids, as the library does it.
* order: ascending doc_id, null ids first; rows of one id by the XXH64 of their text. Every row is written.
* an empty table gives a manifest without files. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import resident, sliced, tokenizer_path
from quern.llm.elias_fano import EliasFano
from quern.session import shared_dir

MAGIC = b"QUERNTK1"
#: Fixed value: what Unicode calls white space, as the split pattern's \s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
AFTER = ".,;:!?#$%&*|"
LETTER_LAST = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
UP_TO_TAIL = f"(?s)^.*[^{re.escape(AFTER)}]"
READ = 1 << 22  # ids of up to 1024 documents read at once; longer ones are read one by one
SPACES = {*"\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))}
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class UnitIds(dict):
    """unit -> its ids as bytes; at most ``memory`` units are kept, of 64 characters at most each.

    A unit that ends in a letter and then marks is put together from both parts: letters and marks
    are never one pre-token. Others are split by the file's own pre-tokenizer and merged by its model.
    """

    def __init__(self, path: str, end: int = 0, memory: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.split, self.merge = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        # byte-level models name a byte by its character, and hidden bytes by those from 256 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.names = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.space = chr(self.names[32])
        sample = " \xc0\xadb\xff"
        named = [x for x, _ in self.split(sample)]
        if self.tokenizer.normalizer is not None or len(self.split("a b!\n\n x")) != 5 or "".join(named) != self._named(sample):
            raise ValueError(f"{path}: not a byte-level tokenizer that takes words with the space before them")
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.end = array(self.code, [end]).tobytes()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def encoded(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _named(self, unit: str) -> str:
        return unit.encode().decode("latin-1").translate(self.names)

    def _merged(self, unit: str) -> list[int]:
        word = unit[1:] if unit[:1] == " " else unit
        if word.isalpha() and max(word) < "\u0250":  # letters alone: one pre-token
            named = unit.replace(" ", self.space) if unit.isascii() else self._named(unit)
            return [t.id for t in self.merge(named)]
        return [t.id for piece, _ in self.split(unit) for t in self.merge(piece)]

    def __missing__(self, unit: str) -> bytes:
        parts = UNIT.findall(unit)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        body = unit.rstrip(AFTER)
        if len(body) < len(unit) and body[-1:].isalpha() and body[-1] < "\u0250":
            return self[body] + self[unit[len(body) :]]
        ids = array(self.code, self._merged(unit)).tobytes()
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > self.memory:
            self.clear()
        if any(x in text for x in self.special):
            return self.encoded(text) + self.end
        found = (m.group() for m in UNIT.finditer(text)) if len(text) > 1 << 20 else UNIT.findall(text)
        return b"".join(map(self.__getitem__, found)) + self.end

    def of_batch(self, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these texts one after the other, and how many each text has.

        Arrow splits texts at spaces and words at the marks they end in; each distinct word of the
        batch is looked up once and ids are gathered by word. Texts that are long, hold special
        strings or have other white space beside a space go alone.
        """
        if len(self) > self.memory:
            self.clear()
        alone = np.asarray(pc.utf8_length(own)) > 1 << 20
        for x in self.special:
            alone |= np.asarray(pc.match_substring(own, x))
        parts = pc.split_pattern(pc.if_else(pa.array(alone), "", own), " ")
        starts, ends, words = parts.offsets.to_numpy()[:-1], parts.offsets.to_numpy()[1:], parts.flatten().dictionary_encode()
        codes, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        odd = np.asarray(pc.or_(pc.not_equal(pc.utf8_trim(words, characters="".join(SPACES)), words), pc.equal(words, "")))
        alone |= np.add.reduceat(odd[codes], starts) > 0
        bodies = pc.utf8_rtrim(words, characters=AFTER)
        cut = pc.match_substring_regex(bodies, LETTER_LAST)
        tails = pc.if_else(cut, pc.replace_substring_regex(words, UP_TO_TAIL, ""), "").dictionary_encode()
        bodies = pc.if_else(cut, bodies, words).dictionary_encode()
        heads = pc.if_else(pa.array(alone), "", words.take(pa.array(codes[starts]))).to_pylist()
        for i in np.flatnonzero(alone).tolist():
            heads[i] = own[i].as_py()
        ids = [self[" " + x] for x in bodies.dictionary.to_pylist()]
        ids += map(self.__getitem__, tails.dictionary.to_pylist())
        first = len(ids)
        ids += [self.of(x)[: -len(self.end)] if a else self[x] for x, a in zip(heads, alone.tolist(), strict=True)]
        ids += [b"", self.end]
        # every word as the codes of its body and its tail, a text's first word as its head's, then the end
        nothing, stop = len(ids) - 2, len(ids) - 1
        body, tail = (np.asarray(x.indices)[codes] for x in (bodies, tails))
        both = np.stack([body, tail + len(bodies.dictionary)], axis=1)
        both[np.repeat(alone, ends - starts)] = nothing
        both[starts, 0], both[starts, 1] = first + np.arange(len(own)), nothing
        codes = np.insert(both.ravel(), 2 * ends, stop)
        flat = np.frombuffer(b"".join(ids), self.code)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        each = lengths[codes]
        before = np.cumsum(each)
        places = (np.cumsum(lengths) - lengths)[codes] - before + each
        out = flat[np.repeat(places, each) + np.arange(before[-1])]
        return out, np.add.reduceat(each, 2 * starts + np.arange(len(own)))


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class Writer:
    """One file: ids as they come, then the sequences and the footer."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, root = filesystem(folder)
        self.path, self.draft = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out, self.width = self.fs.open_output_stream(self.draft), width
        self.out.write(MAGIC)
        self.starts, self.docs, self.nulls, self.ids = array("q", [0]), array("q"), 0, 0

    def add(self, docs: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The next documents: their doc_ids (null ones before all others), all their ids, how many each has."""
        self.out.write(ids.astype(f"<u{self.width}", copy=False).tobytes())
        self.starts.frombytes((self.ids + np.cumsum(lengths)).astype(np.int64).tobytes())
        self.ids += len(ids)
        self.nulls += docs.null_count
        self.docs.frombytes(docs.drop_null().to_numpy().tobytes())

    def close(self) -> None:
        footer = {"width": self.width, "ids": self.ids, "nulls": self.nulls}
        for name, values in (("starts", self.starts), ("docs", self.docs)):
            packed = EliasFano.of(np.frombuffer(values, np.int64))
            data = packed.dump()
            footer[name] = packed.header() | {"bytes": len(data)}
            self.out.write(data)
        tail = json.dumps(footer).encode()
        self.out.write(tail + len(tail).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)


class Reader:
    """One file; holds its two packed sequences, reads ids as they are asked for."""

    def __init__(self, folder: str, name: str):
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        end = self._at(size - 12, 12)
        if self._at(0, 8) != MAGIC or end[4:] != MAGIC:
            raise ValueError(f"{name}: not a whole token file")
        tail = int.from_bytes(end[:4], "little")
        self.footer = json.loads(self._at(size - 12 - tail, tail))
        self.width, at = self.footer["width"], 8 + self.footer["ids"] * self.footer["width"]
        self.starts = EliasFano.load(self.footer["starts"], self._at(at, self.footer["starts"]["bytes"]))
        at += self.footer["starts"]["bytes"]
        self.docs = EliasFano.load(self.footer["docs"], self._at(at, self.footer["docs"]["bytes"]))

    def _at(self, place: int, size: int) -> bytes:
        return self.file.read_at(size, place)

    def __len__(self) -> int:
        return self.starts.n - 1

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = self.footer["nulls"]
        own = self.docs.select(np.arange(max(first, nulls), last) - nulls).tolist() if last > nulls else []
        return [None] * max(0, min(nulls, last) - first) + own

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids at these places of the file."""
        return np.frombuffer(self._at(8 + start * self.width, (end - start) * self.width), f"<u{self.width}")

    def document(self, rank: int) -> np.ndarray:
        """The ids of the document at this rank, its end id included."""
        return self.ids(*self.starts.select(np.array([rank, rank + 1])).tolist())

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the file and ids of every document."""
        for at in range(0, len(self), 1024):
            last = min(at + 1024, len(self))
            starts = self.starts.select(np.arange(at, last + 1)).tolist()
            first = starts[0]
            few = self.ids(first, starts[-1]) if starts[-1] - first <= READ else None
            for doc, start, end in zip(self.doc_ids(at, last), starts[:-1], starts[1:], strict=True):
                yield doc, start, self.ids(start, end) if few is None else few[start - first : end - first]

    def close(self) -> None:
        self.file.close()


def of_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, or of one row."""
    total = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = 0) -> str:
    """Writes every row's ids to files in ``folder`` (a URI that driver and executors share); returns the folder.

    The driver gets a row a file.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    if folder is None:
        folder = f"{shared_dir(spark)}/quern-tokens-{uuid.uuid4().hex}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    # equal rows are apart by their place in the input, so that one id may fill many files
    order = ["doc_id", "tie", "place"]
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in sliced(batches):
            if out is None:
                number = TaskContext.get().partitionId()
                units = resident(("token-files", path), lambda: UnitIds(path, end))
                name = f"ids-{number:07d}.bin"
                out = Writer(folder, name, np.dtype(units.code).itemsize)
            for part in of_bytes(batch):
                out.add(part.column("doc_id"), *units.of_batch(part.column("text")))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "file": [name], "docs": [len(out.starts) - 1], "ids": [out.ids]})

    files = ranges.mapInArrow(write, "number long, file string, docs long, ids long").collect()
    manifest, before = [], 0
    for r in sorted(files):
        manifest.append({"file": r.file, "docs": r.docs, "ids": r.ids, "before": before})
        before += r.ids
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"tokenizer": os.path.basename(path), "end": end, "files": manifest}).encode())
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, a file a task, from the files alone."""
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], kind)
    named = spark.sparkContext.parallelize([(x["file"], x["before"]) for x in files], len(files))

    def rows(own):
        for name, before in own:
            file = Reader(folder, name)
            for doc, start, ids in file:
                yield doc, before + start, len(ids), zlib.crc32(ids.astype("<u4"))
            file.close()

    return spark.createDataFrame(named.mapPartitions(rows), kind, verifySchema=False)
