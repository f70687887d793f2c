"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out_column, materialize, text_frame

#: Bytes of text that a fit takes, unless told otherwise.
FIT_BYTES = 48 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, most_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[str], np.ndarray]:
    """Whole texts and 0/1 labels of at most ``rows`` labelled rows that aren't held out, of ``most_bytes`` bytes at most.

    Rows are chosen by a hash of the identifier, identifiers before texts; in that order a text is passed over if it would go over the bytes. So no more than
    ``rows`` identifiers are broadcast and no more than ``most_bytes`` collected.
    Rows without identifier or label are left out; of rows that repeat an identifier the least text counts, and the greatest label.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out_column(id_col))
    told = told.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = text_frame(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.first("label").alias("label"))
    found = materialize(found, "labelled")
    sizes = found.select("doc_id", F.octet_length("body").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    picked, filled = [], 0
    for r in sizes:
        if filled + r.n <= most_bytes:
            filled += r.n
            picked.append((r.doc_id,))
    if len(picked) < len(sizes):
        few = docs.sparkSession.createDataFrame(picked, "doc_id long")
        pdf = found.join(F.broadcast(few), "doc_id").toPandas()
    else:
        pdf = found.toPandas()
    discard(found)
    pdf = pdf.sort_values("doc_id")
    return [b.decode("utf-8", "replace") for b in map(bytes, pdf["body"])], pdf["label"].to_numpy(np.int64)
