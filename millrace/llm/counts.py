"""Token counts by a public tokenizer: whole texts go to its batch encoder, in batches of equal bytes, and only lengths come back."""

from __future__ import annotations

import os

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, id_text, text_steps

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text in a batch, and characters beyond which a text is encoded in parts, each ending at a safe boundary.
BATCH_BYTES = 1 << 18
LONG_TEXT = 1 << 17
COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def safe_parts(text: str, longest: int = LONG_TEXT) -> list[str]:
    """The text cut before spaces or line feeds into parts of about `longest` characters; a part without any stays whole.

    Such a cut is safe for a vocabulary that drops white space: no token, no special string and no composed character goes over it.
    """
    parts, i = [], 0
    while len(text) - i > longest:
        ends = [j for j in (text.find(" ", i + longest), text.find("\n", i + longest)) if j >= 0]
        if not ends:
            break
        parts.append(text[i : min(ends)])
        i = min(ends)
    return [*parts, text[i:]]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, for a tokenizer file whose vocabulary drops white space.

    Only lengths leave the workers. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null doc_id is
    kept as null; an empty table gives no rows. Texts of any length are counted whole; long ones are encoded part by part. Columns
    other than doc_id and text are ignored.
    """

    def run(batches):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        for batch in batches:
            for step in text_steps(batch, limit=BATCH_BYTES):
                texts = step.column("text").to_pylist()
                cut = [safe_parts(t) for t in texts]
                lengths = iter([len(e) for e in tokenizer.encode_batch_fast([p for parts in cut for p in parts], add_special_tokens=False)])
                n = [sum(next(lengths) for _ in parts) for parts in cut]
                yield pa.RecordBatch.from_arrays([step.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return id_text(docs).mapInArrow(run, COUNTED)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("*", (F.col("n_tokens") > 2048).alias("over_limit"))
