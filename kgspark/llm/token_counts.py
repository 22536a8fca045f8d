"""Token counts by overlap resynchronisation.

A text of up to `chunk` characters is encoded at once. A longer one is encoded in chunks that overlap; two
neighbours are spliced at a place where both start a token and where a token must start whatever stands
before it, so that the sum is what the whole text would give. Where the overlap has no such place it is
doubled, in the end up to the whole of the text read so far.

The proof of a place: pre-tokenisation of byte-level BPE cuts before a space that follows a character which
is no white space and precedes one that is none, for no alternative of its pattern runs over such a space;
merges do not pass that cut, and special strings of the vocabulary hold no space. The vocabulary's file is checked
for all of that; with one of another kind, long texts are encoded whole.

Null text: 0 bytes, 0 tokens. Rows come back as they are, repeated ones and null ids too; nothing depends on their order, so there
are no ties. Empty table: no rows. Very long texts: memory follows a chunk's tokens, and the longest stretch without a place to cut.
Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm._words import pieces

CHUNK, OVERLAP, LIMIT = 32_768, 256, 1024


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, provable(json.loads(tokenizer.to_str()))


def provable(parts: dict) -> bool:
    """Whether a tokenizer is of the kind that the proof is about."""
    before, model = parts.get("pre_tokenizer") or {}, parts["model"]
    cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not model.get("dropout") and not parts.get("normalizer")
    return bool(cut and plain) and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in parts["added_tokens"])


def stable(text: str, at: int) -> bool:
    """A token starts at `at`, whatever stands before and after."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def splice(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of text. encode gives the offsets (start, end) of a string's tokens."""
    start, end = 0, min(len(text), chunk)
    starts = np.array([a for a, _ in encode(text[:end])], np.int64)  # places in text
    total, wide = 0, overlap
    while end < len(text):
        begin = max(start, end - wide)
        if begin == start:  # no place in the whole chunk: a longer one
            end = min(len(text), end + (end - start))
            starts, wide = np.array([a for a, _ in encode(text[start:end])], np.int64) + start, overlap
            continue
        to = min(len(text), begin + chunk + wide)
        after = np.array([a for a, _ in encode(text[begin:to])], np.int64) + begin
        both = np.intersect1d(starts[starts > begin], after)
        place = next((int(p) for p in both[::-1] if p < end - 1 and stable(text, p)), None)
        if place is None:
            wide *= 2
            continue
        total += int(np.searchsorted(starts, place))
        start, end, starts, wide = place, to, after[np.searchsorted(after, place) :], overlap
    return total + len(starts)


def token_counts(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of each row. vocabulary: a tokenizers .json of byte-level BPE, there on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, splices = load(vocabulary)
        for b in pieces(batches, "text", 1 << 20):
            texts = [x or "" for x in b.column("text").to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk or not splices]
            counts[short] = [len(e) for e in tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)]
            for i, x in enumerate(texts):
                if len(x) > chunk and splices:
                    counts[i] = splice(x, lambda t: tokenizer.encode(t, add_special_tokens=False).offsets, chunk, overlap)
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), sizes, pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from kgspark.llm._spark import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
