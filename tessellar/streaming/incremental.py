"""Files that arrive as a stream of parts, decoded as their pictures become complete.

The input is a streaming frame with a row a part: stream_id, seq (from 0, without gaps), data and last. Parts may come in any order
within and across batches; state holds parts that came early, and the file's own state. There is no event time: a stream ends with
its last part. Each picture is a row; a file that turns out to be wrong gives one row with its status, and nothing more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessellar.codecs import vp8
from tessellar.codecs.stream import Stream
from tessellar.options import Options
from tessellar.status import INTERNAL, OK, CodecError

PICTURE = "stream_id string, frame_no int, status string, format string, width int, height int, duration int, timestamp long, planes array<binary>"
COLUMNS = ["stream_id", "frame_no", "status", "format", "width", "height", "duration", "timestamp", "planes"]


def advance(stream: Stream, parts: list[tuple[bytes, bool]]) -> Iterator[tuple]:
    """Rows (without the id) that these parts complete."""
    try:
        for data, last in parts:
            stream.append(data)
            if last:
                stream.end()
        for d in stream.pictures():
            yield d.frame_no, OK, d.picture.fmt, d.picture.width, d.picture.height, d.duration, d.timestamp, d.picture.planes
    except CodecError as e:
        yield stream.given, e.status, None, None, None, None, None, None
    except Exception as e:
        stream.failed = INTERNAL, str(e)
        yield stream.given, INTERNAL, None, None, None, None, None, None


def decode_stream(parts: DataFrame, options: Options | None = None, tables: vp8.Tables | None = None) -> DataFrame:
    """parts: stream_id string, seq int, data binary, last boolean. PICTURE rows, in append mode."""
    options = (options or Options()).check()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, stream, due, over = pickle.loads(state.get[0]) if state.exists else ({}, Stream(options, tables), 0, False)
        for f in frames:
            for seq, data, last in zip(f["seq"], f["data"], f["last"], strict=True):
                if seq >= due:  # a part that comes again is left out
                    waiting[int(seq)] = (bytes(data) if data is not None else b"", bool(last))
        ready = []
        while due in waiting:
            ready.append(waiting.pop(due))
            due += 1
        rows = [] if over or not ready else list(advance(stream, ready))
        over = over or stream.failed is not None or stream.ended
        if over:  # nothing of a file that has ended is needed
            waiting, stream = {}, None
        state.update((pickle.dumps((waiting, stream, due, over)),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=COLUMNS)

    return parts.groupBy("stream_id").applyInPandasWithState(run, PICTURE, "state binary", "append", GroupStateTimeout.NoTimeout)
