"""Animations: frames with a disposal, drawn one after another on a canvas.

The canvas is state that runs from frame to frame, so an image is the unit of
work: its frames are sorted and streamed, and only one canvas (and the one to go
back to) is held. Frames that are all kept need no state: a window finds the last
drawn pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What becomes of a frame when the next one is drawn.
NONE, KEEP, BACKGROUND, PREVIOUS = 0, 1, 2, 3


def last_drawn(frames: DataFrame) -> DataFrame:
    """image_id, y, x, idx: the last index drawn on each place, all frames kept."""
    last = Window.partitionBy("image_id", "y", "x").orderBy(F.desc("frame_no"))
    return frames.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("image_id", "y", "x", "idx")


def final_canvas(frames: DataFrame) -> DataFrame:
    """image_id, y, x, idx of the canvas once the last frame is drawn; what is
    transparent has no row. A frame is one row: x, y, idx and disposal."""
    state = "image_id long, y int, x int, idx int"

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("idx", pa.int32())])
        image, canvas, undo = None, {}, None

        def done():
            at = sorted(canvas)
            return pa.RecordBatch.from_arrays([pa.array([image] * len(at), pa.int64()), pa.array([y for y, _ in at], pa.int32()), pa.array([x for _, x in at], pa.int32()), pa.array([canvas[p] for p in at], pa.int32())], schema=schema)

        for b in batches:
            for i, y, x, idx, disposal in zip(*(b.column(c).to_pylist() for c in ("image_id", "y", "x", "idx", "disposal"))):
                if i != image:
                    if canvas:
                        yield done()
                    image, canvas, undo = i, {}, None
                if undo is not None:  # the frame before leaves
                    place, old = undo
                    if old is None:
                        canvas.pop(place, None)
                    else:
                        canvas[place] = old
                undo = ((y, x), canvas.get((y, x)) if disposal == PREVIOUS else None) if disposal in (BACKGROUND, PREVIOUS) else None
                canvas[(y, x)] = idx
        if canvas:
            yield done()

    dealt = frames.repartition("image_id").sortWithinPartitions("image_id", "frame_no")
    return dealt.mapInArrow(run, state)


def canvas_by_windows(frames: DataFrame) -> DataFrame:
    """As final_canvas, without state: every place is on its own, as a frame
    has one pixel. A frame that leaves before the end shows what the last frame
    that stays on its place drew, unless one that clears the place came later."""
    last = frames.groupBy("image_id").agg(F.max("frame_no").alias("end"))
    all_ = frames.join(last, "image_id")
    gone = (F.col("disposal") == PREVIOUS) & (F.col("frame_no") < F.col("end"))
    left = all_.filter(~gone)
    best = left.groupBy("image_id", "y", "x").agg(F.max(F.struct("frame_no", "disposal", "idx", "end")).alias("m"))
    shown = (F.col("m.disposal") != BACKGROUND) | (F.col("m.frame_no") == F.col("m.end"))
    return best.filter(shown).select("image_id", "y", "x", F.col("m.idx").alias("idx"))
