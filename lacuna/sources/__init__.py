from .files import (
    ingest_images,
    read_decoded_images,
    read_features,
    read_images,
    read_log_blocks,
    read_lookup,
    split_lookup,
    write_images,
)
from .sinks import Staging, as_it_is, persisted, save_external, staged, staging_folder, write_parquet
from .tables import entities, history, links, pages, wiki_filter

__all__ = [
    "Staging",
    "as_it_is",
    "entities",
    "history",
    "ingest_images",
    "links",
    "pages",
    "persisted",
    "read_decoded_images",
    "read_features",
    "read_images",
    "read_log_blocks",
    "read_lookup",
    "save_external",
    "split_lookup",
    "staged",
    "staging_folder",
    "wiki_filter",
    "write_images",
    "write_parquet",
]
