"""Declarative feature spec: which fields exist, how each becomes model input, and where it lands."""

from clickloom.spec.model import (
    Continuous,
    Cross,
    HashBucket,
    Identity,
    ModelSpec,
    Vocab,
    embedding_width,
)

__all__ = ["Continuous", "Cross", "HashBucket", "Identity", "ModelSpec", "Vocab", "embedding_width"]
