"""CRAM inputs: which reference a file would be decoded with. Decoding itself is not implemented."""

from __future__ import annotations

import os
from dataclasses import dataclass

from readloom.errors import ReadloomError, unimplemented
from readloom.sources.files import read_prefix

POLICIES = ("strict", "allow-embedded", "allow-cache", "auto-conservative")


@dataclass(frozen=True)
class CramReference:
    """A FASTA with its index, or None where the file's own reference is to serve."""

    fasta: str | None
    policy: str


def resolve_reference(path: str, reference: str | None = None, policy: str = "strict", cache: str | None = None) -> CramReference:
    """The reference that a policy allows. An explicit FASTA comes before any policy and needs a ``.fai`` next to it; strict asks for one; the cache isn't implemented."""
    if policy not in POLICIES:
        raise ReadloomError("invalid_argument", f"no such policy: {policy}")
    if read_prefix(path, 4) != b"CRAM":
        raise ReadloomError("not_cram", path)
    if reference is not None:
        if not os.path.exists(reference):
            raise ReadloomError("missing_reference", reference)
        if not os.path.exists(f"{reference}.fai"):
            raise ReadloomError("missing_reference_index", f"{reference}.fai")
        return CramReference(reference, policy)
    if policy == "allow-cache" or (policy == "auto-conservative" and cache is not None):
        raise unimplemented("the reference cache")
    if policy == "strict":
        raise ReadloomError("missing_reference", f"{path} needs a reference under policy strict")
    return CramReference(None, policy)


def read_cram(path: str, **options):
    resolve_reference(path, **options)
    raise unimplemented("CRAM decoding")
