"""Vector sources (parquet embeddings, numeric CSV, packed table columns)."""

from tmaps.sources.vectors import (load_vectors, read_csv_vectors, write_csv_vectors,
                                   pack_vectors, row_index, table)

__all__ = ["load_vectors", "read_csv_vectors", "write_csv_vectors", "pack_vectors",
           "row_index", "table"]
