"""python -m spotflow [options] [input]: detections of a TIFF or ETS video, linked."""

from __future__ import annotations

import argparse


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    line = argparse.ArgumentParser(prog="spotflow")
    line.add_argument("input", nargs="?", default="video.tif", help="a .tif, .tiff or .ets file")
    line.add_argument("--debug", action="store_true", help="show the centres of every pixel instead of detections")
    line.add_argument("--filter", action="store_true", help="suppress close pairs")
    line.add_argument("--characterize", action="store_true")
    line.add_argument("--processed-cpu", action="store_true", help="character from processed frames")
    line.add_argument("--diameter", type=int, default=9)
    line.add_argument("--minmass", type=float, default=800.0)
    line.add_argument("--separation", type=int, default=10)
    line.add_argument("--search-range", type=float, default=9.0)
    line.add_argument("--out", help="folder for the result as Parquet; without it the first rows are shown")
    return line.parse_args(args)


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators import frames as fr
    from .params import TrackingParams
    from .plans.pipeline import batch
    from .sources.tables import read_frames

    own = parsed(args)
    spark = SparkSession.builder.appName("spotflow").getOrCreate()
    frames = read_frames(spark, own.input, 0)
    params = {"minmass": own.minmass, "separation": own.separation, "filter_close": own.filter, "characterize": own.characterize, "cpu_processed": own.processed_cpu}
    found = fr.stages(frames, TrackingParams(own.diameter, **params))["centres"] if own.debug else batch(frames, own.diameter, search_range=own.search_range, **params)
    if own.out:
        found.write.mode("overwrite").parquet(own.out)
    else:
        found.show()


if __name__ == "__main__":
    main()
