import os

import containers as K
from slidemill.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_slides_are_converted_as_they_arrive(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    K.tiff(f"{src}/a.tif", [K.picture(64, 48)])
    K.write(f"{src}/note.txt", b"not a slide")
    arrivals.convert_arrivals(spark, src, out, state, once=True).awaitTermination()
    assert os.listdir(out) == ["a.svs"]
    first = os.stat(f"{out}/a.svs").st_mtime_ns
    K.tiff(f"{src}/b.tif", [K.picture(32, 32)])
    arrivals.convert_arrivals(spark, src, out, state, once=True).awaitTermination()
    assert sorted(os.listdir(out)) == ["a.svs", "b.svs"] and os.stat(f"{out}/a.svs").st_mtime_ns == first


def test_windows_cover_all_events(spark):
    out = arrivals.run_once(arrivals.windowed_counts(arrivals.event_stream(spark, SF)), "w")
    assert out.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_arrivals_of_one_stem(spark, tmp_path):
    """Slides of one stem in several folders, in one trigger and in later ones, each get an output of their own."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    K.tiff(f"{src}/one/s.tif", [K.picture(32, 32)])
    K.tiff(f"{src}/two/s.tif", [K.picture(48, 32)])
    arrivals.convert_arrivals(spark, src, out, state, once=True).awaitTermination()
    assert sorted(os.listdir(out)) == ["s.svs", "s_2.svs"]
    K.tiff(f"{src}/three/s.tif", [K.picture(64, 32)])
    arrivals.convert_arrivals(spark, src, out, state, once=True).awaitTermination()
    assert sorted(os.listdir(out)) == ["s.svs", "s_2.svs", "s_3.svs"]
