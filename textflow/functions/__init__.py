"""Column -> Column expressions."""

from .arrays import (pad_slots, parse_vector, take_items, to_vector,
                     vector_entries, vector_items)
from .text import (ascii_only, clean_punct, fix_misspellings, mask_numbers,
                   to_label, trim_text, words_of)

__all__ = [
    "ascii_only", "clean_punct", "fix_misspellings", "mask_numbers", "to_label",
    "trim_text", "words_of", "pad_slots", "parse_vector", "take_items",
    "to_vector", "vector_entries", "vector_items",
]
