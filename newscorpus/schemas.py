"""Schemas of the tables that pass between jobs."""

LEDGER = "section_key string, completed boolean, n_links bigint, updated_at timestamp_ntz"
SOURCE = "url string, category string, scraped_date timestamp_ntz"
MANIFEST = (
    "section_key string, month string, level bigint, file_name string, n_articles bigint, "
    "n_bytes bigint, size_mib double, first_date timestamp_ntz, last_date timestamp_ntz"
)
