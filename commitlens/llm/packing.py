"""Sequence packing by power-of-two decomposition.

Each document's ids (its end mark included) are cut into pieces whose lengths
are the powers of two of its binary form: as many pieces of ``max_len`` as fit,
then one piece for each bit of the rest, longest first. A piece is a sequence of
its own, so no sequence crosses documents and none is padded. Pieces of equal
length belong to one bucket, from which batches of one shape are drawn.

Edge cases: a null or empty text has the end mark alone (one piece of length 1);
rows that repeat are packed each on its own, ties between them left as they are read; a null doc_id stays null; a very long text
is many pieces of ``max_len``; an empty table gives no pieces. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import per_batch

#: Fixed values of the vocabulary: its marker's text and id, and the id that ends a document.
MARKER, MARKER_ID, END_ID = "<|endoftext|>", 50256, 1
MAX_LEN = 2048
#: Runs longer than this go to the library whose matcher doesn't backtrack over them.
LONG_RUN = re.compile(r"\s{2000}|\S{20000}")

PIECE = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long"


def encoder(vocabulary: str, ranks: str, pattern: str) -> Callable[[str], list[int]]:
    """Text to ids of ``vocabulary`` (a tokenizers file).

    ``ranks`` holds the same vocabulary for a faster library. The two give the
    same ids (the tests compare them); texts with very long runs of one kind are
    left to the first, which is linear in them.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    plain: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if LONG_RUN.search(text):
            plain[:] = plain or [Tokenizer.from_file(vocabulary)]
            return plain[0].encode(text, add_special_tokens=False).ids
        first, *rest = text.split(MARKER)
        ids = fast.encode_ordinary(first)
        for part in rest:
            ids.append(MARKER_ID)
            ids += fast.encode_ordinary(part)
        return ids

    return encode


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """The piece lengths of ``n`` ids, longest first; ``max_len`` is a power of two."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def decompose(docs: DataFrame, files: tuple[str, str, str] | None = None, max_len: int = MAX_LEN, keep_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place, bucket (log2 of its length), ids, digest and sequence.

    ``sequence_id`` is unique, and the same for the same input files and splits.
    Nothing is shuffled. ``keep_ids=False`` leaves the ids out.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    vocabulary, ranks, pattern = files or default_files()

    def make() -> Callable:
        import numpy as np

        encode = encoder(vocabulary, ranks, pattern)

        def rows(columns: list[list]) -> Iterator[tuple]:
            for doc_id, text in zip(*columns, strict=True):
                ids = encode(text or "")
                ids.append(END_ID)
                data = np.array(ids, dtype="<u4")
                start = 0
                for length in binary_lengths(len(ids), max_len):
                    piece = data[start : start + length]
                    row = (doc_id, start, length, length.bit_length() - 1, zlib.crc32(piece), len(ids))
                    yield (*row, piece.tolist()) if keep_ids else row
                    start += length

        return rows

    pieces = per_batch(docs.select("doc_id", "text"), make, PIECE + (", ids array<int>" if keep_ids else ""))
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences with their ids, a folder for each length: a reader of one bucket gets rectangular batches."""
    pieces.write.partitionBy("bucket").parquet(path)
