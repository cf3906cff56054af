"""Token counts: Arrow batches in, lengths out.

Texts are read in batches of about equal bytes. A text longer than a batch is cut at
safe boundaries, where a white-space run begins, and its parts' lengths are summed, so
no batch holds more than one part beyond its size. Ids never leave the worker.

Defined results: a null text counts as empty (no bytes, no tokens); equal texts and
repeated rows are counted each; a null id stays null; an empty table gives an empty
table. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import encoder

BATCH_BYTES = 1 << 20


def batches_of(texts: list[str], sizes: list[int], slices, most: int) -> Iterator[list[tuple[int, str]]]:
    """(row, part) lists of about ``most`` bytes each."""
    batch, held = [], 0
    for row, (text, size) in enumerate(zip(texts, sizes)):
        for part in slices(text, most) if size > most else (text,):
            # Characters are at least a byte and at most four.
            n = size if part is text else len(part)
            if batch and held + n > most:
                yield batch
                batch, held = [], 0
            batch.append((row, part))
            held += n
    if batch:
        yield batch


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; ``tokenizer`` is a vocabulary file of the tokenizers library."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = rows.select(F.col(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            totals = [0] * batch.num_rows
            for part in batches_of(batch.column(1).to_pylist(), sizes, enc.slices, batch_bytes):
                for (row, _), n in zip(part, enc.lengths([t for _, t in part])):
                    totals[row] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())],
                [id_col, "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(count, schema)
