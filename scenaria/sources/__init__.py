from scenaria.sources.files import (
    export_indexed,
    publish,
    published,
    read_published,
    read_csv_na_tokens,
    read_csv_skip_preamble,
    read_sheet_table,
    with_row_index,
    with_source_order,
    write_table,
)

__all__ = [
    "read_csv_na_tokens", "read_csv_skip_preamble", "read_sheet_table", "with_source_order",
    "with_row_index", "export_indexed", "write_table", "publish", "published", "read_published",
]
