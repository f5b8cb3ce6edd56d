"""Helpers that the operators share: workers' import path, stored tables, words, cached tokenizers."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from payrisk.session import scratch_path, written

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

Batches = Iterator[pa.RecordBatch]

# White space beyond ASCII, as UTF-8 bytes, and the first bytes of these. Fixed values of the Unicode White_Space property.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_FIRST = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
# A run of other characters with one space before it, or white space up to the last of its run.
SPACED_CHUNK = re.compile(rb" ?\S+|\s+(?!\S)|\s+")
# White space that is more than a single space or line end; and the byte that separates chunks.
OTHER_SPACE = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\f", b"\v", b"\0")

# Distinct chunks whose ids a worker keeps; beyond it starts afresh.
CACHED_CHUNKS = 900_000


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and rows stay as they are."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(stored: DataFrame) -> None:
    """Deletes the files of a table that ``store`` wrote, once nothing will read them again."""
    spark = stored.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = {name.rpartition("/")[0].rpartition("/")[2] for name in stored.inputFiles()}
    for folder in [w for w in written() if w.rpartition("/")[2] in folders]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def over_batches(df: DataFrame, step: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` for a step that yields record batches."""
    ready(df.sparkSession)
    return df.mapInArrow(step, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def chunks_of(rows: int, size: int) -> Iterator[slice]:
    for start in range(0, rows, size):
        yield slice(start, min(start + size, rows))


def crossing_free_chunks(text: bytes, word_level: bool) -> list[bytes]:
    """Cuts a text where no token of the two public BPE files can cross.

    The word-level file drops white space; the byte-level file joins one space to
    what follows and keeps longer runs together. Wider white space than ASCII
    stays inside a chunk of the first, and keeps a text of the second whole.
    """
    if word_level:
        # All is lower-cased later; before that, a combining mark may join a letter of one case only.
        return text.split() if b"\xcc" in text or b"\xcd" in text else text.lower().split()
    if any(map(text.__contains__, WIDE_FIRST)) and WIDE_SPACE.search(text):
        return [text]
    if not text or text[0] in b" \n" or text[-1] in b" \n" or any(map(text.__contains__, OTHER_SPACE)):
        return SPACED_CHUNK.findall(text)
    # Only single spaces and line ends: a space goes with what follows, a line end stands alone.
    return text.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0")


# Letters of which every version of Unicode says the same, alone or with plain marks behind them: no rule of either
# file splits the letters, or joins them with the marks.
PLAIN_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# ASCII marks that end a plain word; an apostrophe may begin a piece of its own.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def byte_characters() -> dict[int, str]:
    """Characters that byte-level vocabularies write for bytes: the visible ones of Latin-1, and from 256 on for the rest."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class KnownChunks(dict[bytes, bytes]):
    """Ids of chunks; those of a chunk that is not there are worked out when it is looked up."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        return self.learn(chunk)


class CachedTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit integers, with the ids of chunks kept.

    Strings that name special tokens are ordinary text. Chunks not seen before go to the
    library: plain words straight to its model, the others through all its steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.word_level = self.library.normalizer is not None
        self.characters = byte_characters()
        self.known = KnownChunks(self.learn)

    def _ids(self, piece: bytes) -> bytes:
        """Of letters, with a space before them or not, or of marks: what the library's other steps leave whole."""
        text = piece.decode()
        if self.word_level:
            text = text.lower()
        if text.isascii():
            text = text.replace(" ", self.characters[32])
        else:
            text = text.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, chunk: bytes) -> bytes:
        """Ids of a chunk that is not known, kept from now on."""
        known = self.known
        if len(known) > CACHED_CHUNKS:
            known.clear()
        word = chunk.rstrip(MARKS)
        if not (word.isalpha() or (word[:1] == b" " and word[1:].isalpha())):  # ASCII letters
            if chunk.isascii() or not (m := PLAIN_WORD.fullmatch(chunk.decode())):
                found = self.library.encode_batch_fast([chunk.decode()], add_special_tokens=False)
                known[chunk] = ids = array("I", found[0].ids).tobytes()
                return ids
            word = m.group(1).encode()
        ids = known.get(word)
        if ids is None:
            known[word] = ids = self._ids(word)
        if len(word) != len(chunk):
            marks = chunk[len(word) :]
            end = known.get(marks)
            if end is None:
                known[marks] = end = self._ids(marks)
            known[chunk] = ids = ids + end
        return ids

    def encode(self, text: bytes | None) -> bytes:
        # One look-up a chunk: with many chunks known, it is the memory they lie in that takes the time.
        return b"".join(map(self.known.__getitem__, crossing_free_chunks(text or b"", self.word_level)))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> CachedTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return CachedTokenizer(path)


def as_records(docs: DataFrame) -> DataFrame:
    """Two columns, ``doc`` with all columns of ``docs`` and ``text``: no name that an operator adds can clash."""
    return docs.select(F.struct("*").alias("doc"), docs["text"].cast("string").alias("text"))


def with_record(docs: DataFrame, added: str) -> StructType:
    """Schema of ``doc`` followed by the added columns."""
    return StructType([StructField("doc", docs.schema, False), *StructType.fromDDL(added)])


def documents_from(records: DataFrame, names: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns ``names`` out of ``doc``, with ``text`` where it changed; a column ``n_chars`` follows it."""

    def column(name: str) -> Column:
        own = F.col(f"doc.`{name}`")
        if name == "text":
            return F.when(changed, text).otherwise(own).alias(name)
        if name == "n_chars":
            return F.when(changed, F.length(text).cast("bigint")).otherwise(own).alias(name)
        return own.alias(name)

    return records.select(*[column(n) for n in names])
