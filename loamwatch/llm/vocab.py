"""Public tokenizer files: where they are, and what is loaded once in each Python worker."""

from __future__ import annotations

import os
from functools import lru_cache


def default_path(name: str) -> str:
    """Where the installed package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizers-library tokenizer, one thread a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def added_strings(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes out of a text before it splits it."""
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def ranked(path: str):
    """A tiktoken encoding from a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def pieces(path: str):
    """A sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
