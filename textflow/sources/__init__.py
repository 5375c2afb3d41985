"""Sources and sinks."""

from .corpus import (CORPUS, as_labelled, lexicon_from_text, read_corpus,
                     read_features, read_lexicon, rename_positional,
                     write_features)

__all__ = ["CORPUS", "as_labelled", "lexicon_from_text", "read_corpus",
           "read_features", "read_lexicon", "rename_positional", "write_features"]
