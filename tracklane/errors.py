"""Errors, by what a caller can do about them: bad audio, a missing model or runtime, a failing backend."""

from __future__ import annotations


class AudioError(ValueError):
    """The audio can't be read, or nothing here can decode it."""


class AudioEmpty(AudioError):
    def __init__(self, path: str):
        super().__init__(f"{path or 'the input'}: nothing to hear, no track gave any samples")


class ModelNotFound(OSError):
    def __init__(self, name: str, path: str, message: str):
        super().__init__(f"{path} can't serve as model {name!r}: {message}")


class DownloadError(OSError):
    def __init__(self, name: str, message: str):
        super().__init__(f"model {name!r} didn't arrive: {message}")


class RuntimeMissing(OSError):
    """A shared library that a backend needs isn't there, or can't be loaded."""


class BackendError(RuntimeError):
    """A scoring, recognition or speaker backend failed or isn't registered."""
