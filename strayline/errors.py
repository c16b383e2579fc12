"""Errors of the engine. Bad arguments are ValueErrors, bad states are RuntimeErrors."""

from __future__ import annotations


class NotReadyError(RuntimeError):
    """The model has seen too little for this question."""


class OutOfBoundsError(RuntimeError):
    """An index names no dimension of the model."""
