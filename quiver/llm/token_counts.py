"""Token counts: batch encoding inside Arrow functions that return lengths only.

A text is split at ASCII white space, where no token of a tokenizer that drops white space can cross, so that the
pieces' lengths add up to the text's. A long piece (Japanese, base64, code without blanks) is split further where the
tokenizer's pattern always ends a word: beside an ASCII digit, or between a letter and a mark. Pieces that the worker
hasn't met are encoded together, in batches of about the same number of bytes; known pieces' lengths come from a
bounded memo. Only a long run of letters, or of marks, is one call however long it is.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; repeated rows count alike.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quiver.llm.common import map_batches, texts_of


#: Characters of a piece that is split further, and of its parts, about.
LONG, PART = 1 << 15, 1 << 13

#: Where a word ends under a pattern of letter runs, single digits and runs of other marks. Both characters are ones that
#: neither compose with others nor stand in a special string on the two sides of such a place.
ENDS = re.compile(
    r"""(?<=[0-9])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9.,;:()\[\]{}=+*/_#%&!?"@$^~`\\-])|(?<=[ぁ-ゖァ-ヺ一-鿿])(?=[、。，！？])"""
)


def parts(piece: bytes) -> list[bytes]:
    """A piece, or, if it is long, parts of it that are encoded each on their own."""
    if len(piece) <= LONG:
        return [piece]
    text, out, at = piece.decode("utf-8"), [], 0
    while found := ENDS.search(text, at + PART):
        out.append(text[at : found.start()].encode("utf-8"))
        at = found.start()
    return [*out, text[at:].encode("utf-8")]


def byte_batches(pieces: Iterable[bytes], n_bytes: int) -> Iterator[list[str]]:
    """Batches of about ``n_bytes``; a larger piece is a batch by itself."""
    batch: list[str] = []
    size = 0
    for piece in pieces:
        if batch and size + len(piece) > n_bytes:
            yield batch
            batch, size = [], 0
        batch.append(piece.decode("utf-8"))
        size += len(piece)
    if batch:
        yield batch


class LengthEncoder:
    """Lengths in tokens of whole texts under a ``tokenizers`` file that drops white space."""

    def __init__(self, path: str, batch_bytes: int = 1 << 18, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch_bytes, self.memo = batch_bytes, memo
        self.known: dict[bytes, int] = {}

    def learn(self, pieces: set[bytes]) -> None:
        pieces -= self.known.keys()
        for batch in byte_batches(sorted(pieces), self.batch_bytes):
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            self.known.update((x.encode("utf-8"), len(y)) for x, y in zip(batch, found, strict=True))

    def lengths(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each text."""
        raw = [(t or "").encode("utf-8") for t in texts]
        words = [x.split() for x in raw]
        words = [[y for x in w for y in parts(x)] if any(len(x) > LONG for x in w) else w for w in words]
        if len(self.known) > self.memo:
            self.known.clear()
        self.learn(set().union(*words))
        count = self.known.__getitem__
        return [len(x) for x in raw], [sum(map(count, x)) for x in words]


_encoders: dict[str, LengthEncoder] = {}


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoders.get(path) or _encoders.setdefault(path, LengthEncoder(path))
        n_bytes, n_tokens = encoder.lengths(texts_of(batch))
        columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n > limit for n in n_tokens], pa.bool_())], schema.names)

    return map_batches(documents.select("doc_id", "text"), run, schema)
