"""Activity regions of an unbounded stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklane.params import RegionParams, ms_to_samples

#: Open region's start, silence's start (-1: none), next frame's number.
_STATE = "opened long, quiet long, next long"
_OUT = "file_id string, start_sample long, end_sample long"


def region_stream(frames: DataFrame, params: RegionParams) -> DataFrame:
    """(file_id, start_sample, end_sample) of raw regions of a stream (file_id, frame, p), as they close.

    The state of a file is three numbers. Frames of a file come in order; within a batch they are sorted, and frames
    from before the last one seen are late and dropped. A region that is open stays in the state.
    """
    step, least = params.frame_samples, ms_to_samples(params.min_silence_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, quiet, expected = state.get if state.exists else (-1, -1, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("frame")
        for frame, p in zip(rows["frame"], rows["p"], strict=True):
            if frame < expected:
                continue
            expected = int(frame) + 1
            if p >= params.threshold:
                opened, quiet = (frame * step if opened < 0 else opened), -1
            elif p < params.neg_threshold and opened >= 0:
                quiet = frame * step if quiet < 0 else quiet
                if (frame + 1) * step - quiet >= least:
                    out.append((key[0], opened, quiet))
                    opened = quiet = -1
        state.update((int(opened), int(quiet), expected))
        if out:
            yield pd.DataFrame(out, columns=["file_id", "start_sample", "end_sample"])

    named = frames.selectExpr("cast(file_id AS string) AS file_id", "frame", "p")
    return named.groupBy("file_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
