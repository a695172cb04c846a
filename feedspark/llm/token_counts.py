"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries, cut texts are grouped into batches of about
the same number of bytes, each batch goes through the library in one call, and
only the lengths leave the task.

Safe boundary of the sentencepiece model: before a space that follows a
non-space character.  The library writes a space as its word mark, puts one
mark in front of every text it is given, and no piece of the vocabulary holds
a mark after another character; so no merge crosses such a place, and the part
behind it, given without that one space, gets the mark back.  A model for
which this does not hold is not cut at all (``cuttable``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import text_or_empty

BATCH_BYTES = 1 << 18                      # about so many bytes go to the library at once
PIECE_BYTES = 1 << 14                      # a longer text is cut into pieces of about this size
_MARK = "▁"


def cuttable(path: str) -> bool:
    """Whether the model's vocabulary and normalizer allow cuts before a space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    plain = (not model.normalizer_spec.precompiled_charsmap and model.normalizer_spec.add_dummy_prefix
             and model.normalizer_spec.escape_whitespaces and not model.normalizer_spec.remove_extra_whitespaces
             and not model.trainer_spec.treat_whitespace_as_suffix)
    return plain and not any(_MARK in p.piece.lstrip(_MARK) for p in model.pieces)


@lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path), cuttable(path)


@lru_cache(maxsize=2)
def _tokenizers(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def cut(text: str, size: int = PIECE_BYTES) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut only before a space behind a non-space; that space is left out."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and text[end - 1] in (" ", _MARK):
            end = text.find(" ", end + 1)
        if end < 0 or end + 1 == len(text):  # a space at the very end is a token of its own
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def batches(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of about ``most`` bytes together (a larger item is a run of its own)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of each text, without begin, end or added special tokens."""
    if path.endswith(".json"):             # no cuts: such a vocabulary may join characters across any of them
        tok, pieces, owner = _tokenizers(path), texts, list(range(len(texts)))
        encode = lambda part: [len(e.ids) for e in tok.encode_batch_fast(part, add_special_tokens=False)]
    else:
        sp, safe = _sentencepiece(path)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for piece in cut(t) if safe else (t,):
                pieces.append(piece)
                owner.append(i)
        encode = lambda part: [len(e) for e in sp.encode(part, num_threads=1)]
    total = np.zeros(len(texts), np.int64)
    for a, b in batches([len(p.encode("utf-8")) for p in pieces]):
        np.add.at(total, owner[a:b], encode(pieces[a:b]))
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, map only.

    Null texts count as empty (no bytes, no tokens); repeated rows come back
    as they came; an empty table gives no rows; other columns are not read.
    """
    @F.pandas_udf("bigint")
    def n_tokens(batches_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches_:
            yield pd.Series(count_tokens(texts.tolist(), path))

    body = text_or_empty(text)
    x = docs.select("doc_id", F.octet_length(body).cast("bigint").alias("n_bytes"), n_tokens(body).alias("n_tokens"))
    return x.withColumn("over_limit", F.col("n_tokens") > limit)
