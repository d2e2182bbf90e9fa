"""Token counts of texts with a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Folder with the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabulary splits text before merging (a fixed value of the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The same vocabulary on a text that is one piece.
ONE_PIECE = r"(?s).+"


@lru_cache(4)
def _encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# The characters that the pattern counts as white space.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern's matcher runs out of stack in runs of about a million blanks; those of more than this are cut out for it.
LONG_BLANKS = 100_000


@lru_cache(4)
def _blank_runs(least: int) -> re.Pattern:
    return re.compile(f"[{_WHITE}]{{{least},}}")


def token_count(encoding, text: str, long_blanks: int = LONG_BLANKS) -> int:
    """Number of tokens of a text of any length, exactly as for the text in one piece.

    A run of blanks is one piece for the merges, but for its last blank where a word follows: the pattern leaves
    that to the word. So a long run is merged on its own, and the text before and after it is counted apart.
    """
    n, at = 0, 0
    for run in _blank_runs(long_blanks).finditer(text) if len(text) >= long_blanks else ():
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(_encoding(encoding.name, ONE_PIECE).encode_ordinary(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def count_tokens(text: Column | str, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> Column:
    """Number of tokens of a whole text; null has 0, an empty text has 0."""
    path = os.path.join(folder, vocabulary)

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(path)
        for b in batches:
            yield pa.array([token_count(encoding, t) if t else 0 for t in b.to_pylist()], pa.int64())

    return counts(F.col(text) if isinstance(text, str) else text)
