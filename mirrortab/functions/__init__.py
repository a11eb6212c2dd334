"""Column expressions: repeatable randomness, numeric helpers, text clean-up."""

from mirrortab.functions.numeric import (
    inverse_normal_cdf,
    metric,
    normal_cdf,
    try_double,
    xlog2,
)
from mirrortab.functions.random import gaussian01, hash_bucket, row_hash, uniform01
from mirrortab.functions.text import (
    clean_decoded_text,
    format_cell,
    format_float,
    first_number,
    slug,
)

__all__ = [
    "clean_decoded_text",
    "first_number",
    "format_cell",
    "format_float",
    "gaussian01",
    "hash_bucket",
    "inverse_normal_cdf",
    "metric",
    "normal_cdf",
    "row_hash",
    "slug",
    "try_double",
    "uniform01",
    "xlog2",
]
