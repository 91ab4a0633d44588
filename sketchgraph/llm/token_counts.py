"""Token counts: each distinct pre-token is counted once and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, write_table
from .tokens import PieceWords, PreTokens, tokenizer_path
from .vocab import count_units, document_units, hot_units, rare_sums, with_row_ids


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id long, text).

    ``path`` is a ``tokenizers`` file; tokens are those of its encoding without added special tokens, truncation or
    padding, special strings in texts being read as the library reads them. A null or empty text has 0 bytes and tokens.
    Repeated rows give a row each, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    path = path or tokenizer_path()

    def split():
        return PieceWords(path)

    def make():
        pre = PreTokens(path)
        return lambda rows: ((unit, n_all, len(pre.ids(unit.decode()))) for unit, n_all in rows)

    schema = pa.schema([("unit", pa.binary()), ("n_all", pa.int64()), ("n_tokens", pa.int64())])
    table = write_table(map_rows(count_units(docs, split).select("unit", "n_all"), make, schema, "unit binary, n_all long, n_tokens long", 65536), "pieces")
    values: dict[int, tuple] = {}  # pieces of one length share theirs
    hot = {u: values.setdefault(n, (n,)) for u, _, n in hot_units(table)}
    rows = rare_sums(document_units(with_row_ids(docs), split, hot, 1, "token-docs"), table, [F.col("n_tokens")])
    n_tokens = F.col("v0").cast("long")
    return rows.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
