"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from skein.llm import ann, contamination, license_scan, mixing, near, quotes, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quote_links": quotes.op3_quote_links,
    "op4_near_duplicates": near.op4_near_duplicates,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_nearest": ann.op8_nearest,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_contamination": contamination.op10_contamination,
}
ORACLES = {
    "op4_near_duplicates": near.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_contamination": contamination.OP10_SQL,
}
