"""Parameters that the queries and the pipeline share."""

from __future__ import annotations

# A caller with real data passes a secret key of its own.
PSEUDONYM_KEY = b"spindlewatch example key"


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
