"""Audio containers: what a decoder has to provide, and how its packets become one signal.

WAV is read by ``tracklane.sources.audio``. For other containers a program registers an opener by file extension; it is
sent to the executors with the scan. The rules here are the same for all: the first track with audio counts, packets of
other tracks are passed over, a packet that can't be decoded leaves silence of its own length, so that what follows keeps
its time, and anything else that goes wrong is an error, never a shorter signal.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from fractions import Fraction
from typing import Protocol

import numpy as np

from tracklane.errors import AudioEmpty, AudioError
from tracklane.operators.signal import mixed_down

log = logging.getLogger(__name__)


class CorruptPacket(Exception):
    """Raised by ``Container.decode`` for a packet whose content is broken."""


@dataclass(frozen=True)
class Track:
    id: int
    audio: bool
    sample_rate: int | None = None
    #: Seconds of a tick, in which packets tell their length; None: a tick is a sample frame.
    tick: Fraction | None = None


@dataclass(frozen=True)
class Packet:
    track_id: int
    ticks: int
    data: bytes = b""


class Container(Protocol):
    tracks: list[Track]

    def packets(self) -> Iterable[Packet]:
        """In order up to a clean end; an error in reading, an early end too, is raised."""

    def decode(self, packet: Packet) -> tuple[np.ndarray, int]:
        """Interleaved samples in -1..1, and the number of channels; CorruptPacket if the content is broken."""


Opener = Callable[[bytes, str], Container]
_openers: dict[str, Opener] = {}


def register_container(extension: str, opener: Opener | None) -> None:
    """``opener(content, path)`` for files with the extension (without a dot, any case); None takes it back."""
    if opener is None:
        _openers.pop(extension.lower(), None)
    else:
        _openers[extension.lower()] = opener


def openers() -> dict[str, Opener]:
    return dict(_openers)


def read(container: Container, path: str = "") -> tuple[int, np.ndarray]:
    """Sample rate and mono samples of the container's first audio track."""
    track = next((t for t in container.tracks if t.audio), None)
    if track is None:
        raise AudioEmpty(path)
    if not track.sample_rate:
        raise AudioError(f"{path}: the audio track doesn't tell its sample rate")
    frames_of_tick = Fraction(1) if track.tick is None else track.tick * track.sample_rate
    parts = []
    try:
        for packet in container.packets():
            if packet.track_id != track.id:
                continue
            try:
                parts.append(mixed_down(*container.decode(packet)))
            except CorruptPacket as e:
                silence = int(packet.ticks * frames_of_tick + Fraction(1, 2))
                log.warning("%s: a broken packet became %d samples of silence: %s", path, silence, e)
                parts.append(np.zeros(silence, np.float32))
    except AudioError:
        raise
    except Exception as e:
        raise AudioError(f"{path}: reading stopped: {e or type(e).__name__}") from e
    samples = np.concatenate(parts) if parts else np.zeros(0, np.float32)
    if not len(samples):
        raise AudioEmpty(path)
    return track.sample_rate, samples
