"""Column expressions shared by the operators."""

from minekit.functions.columns import (
    bucket_of,
    duration_bin,
    hash32,
    number_from_text,
    whole_number,
    word_array,
)

__all__ = [
    "bucket_of",
    "duration_bin",
    "hash32",
    "number_from_text",
    "whole_number",
    "word_array",
]
