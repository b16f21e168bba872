"""Queries of container metadata, bytes, layouts and batches, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from slidemill.functions import bytes as B
from slidemill.functions import text as T
from slidemill.operators import batch, geometry, layout, lookup
from slidemill.plans import relations as R
from slidemill.session import ship_package
from slidemill.sources.formats import registry as formats


def slide_info(spark, sf_dir):
    """Pyramid and embedded images of each slide in words."""
    kinds = F.filter(F.array(F.when(F.col("kinds") > 0, "label"), F.when(F.col("kinds") > 1, "macro"), F.when(F.col("kinds") > 2, "macro_other")), lambda k: k.isNotNull())
    names = R.slides(spark, sf_dir).select("slide_id", "width", "height", F.coalesce(F.nullif(F.array_join(kinds, ", "), F.lit("")), F.lit("none")).alias("associated"))
    return names.join(T.pyramid_summary(R.levels(spark, sf_dir)), "slide_id")


def _formats(spark):
    """The format dimension: a row for each extension, a fixed dozen."""
    return spark.createDataFrame(formats.FORMATS, "ord long, extension string, label string, reader string")


def format_dispatch(spark, sf_dir):
    """Files with their reader by extension; null for what isn't supported."""
    f = R.files(spark, sf_dir).withColumn("extension", T.extension(F.col("path")))
    return f.join(F.broadcast(_formats(spark).drop("ord")), "extension", "left").select("file_id", "path", "extension", "label", "reader", F.col("reader").isNotNull().alias("supported"))


def label_dedupe(spark, sf_dir):
    """Distinct labels, in the order first seen, with their files."""
    labels = _formats(spark)
    n = format_dispatch(spark, sf_dir).where("supported").groupBy("label").agg(F.count("*").alias("files"))
    first = labels.groupBy("label").agg(F.min("ord").alias("ord")).join(n, "label", "left")
    return first.select("label", (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("place"), F.coalesce("files", F.lit(0)).alias("files"))


def mpp_from(spark, sf_dir):
    rows = R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", F.when(F.col("x") % 13 == 0, None).otherwise((F.col("y") - 100) / 8.0).alias("resolution"), (F.col("x") % 4 + 1).alias("unit"))
    return rows.select("slide_id", "level", "ordinal", T.mpp_from(F.col("resolution"), F.col("unit")).alias("mpp"))


def mean_mpp(spark, sf_dir):
    """The mean of a slide's positive candidates."""
    rows = R.tiles(spark, sf_dir).select("slide_id", (F.col("level") * 0.25 - 0.5).alias("mpp"))
    return rows.groupBy("slide_id").agg(F.avg(F.when(F.col("mpp") > 0, F.col("mpp"))).alias("mpp"))


def labeled_number(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("|AppMag = ")).when(F.col("p_partkey") % 3 == 1, F.lit(" Objective Power=")).otherwise(F.lit(" mag ")), F.when(F.col("p_partkey") % 5 == 0, "-").otherwise(""), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, ".5.1").otherwise("|x"))
    return p.select("p_partkey", T.labelled_number(text, "objective power", "appmag").alias("app_mag"))


def ini_map(spark, sf_dir):
    return T.ini_values(R.ini_lines(spark, sf_dir))


def first_parse(spark, sf_dir):
    """The first candidate that parses as a number, with its default and clamp."""
    p = R.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("x"))).otherwise(F.col("p_size").cast("string")).alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).alias("b"))
    found = T.first_parse("long", F.col("a"), F.col("b"), F.col("p_type"))
    return p.select("p_partkey", found.alias("value"), F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(found, F.lit(75)) * 3)).alias("quality"))


def classify_page(spark, sf_dir):
    p = R.table(spark, sf_dir, "part")
    text = F.concat(F.col("p_type"), F.element_at(F.array(*map(F.lit, [" Label", " MACRO label", " macro", " a Thumbnail", ""])), (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select("p_partkey", T.page_kind(text, F.when(F.col("p_size") % 4 == 0, 1).otherwise(F.col("p_size") * 2).cast("long")).alias("kind"))


def aperio_description(spark, sf_dir):
    s = R.slides(spark, sf_dir)
    return s.select("slide_id", T.description(F.col("width"), F.col("height"), F.lit(256), F.lit(256), F.lit(75), F.col("app_mag"), F.col("mpp")).alias("description"))


def find_all_marker(spark, sf_dir):
    """Places of a marker in each page's bytes, overlapping ones included."""
    ship_package(spark)
    found = R.table(spark, sf_dir, "pages").select("page_id", F.explode(B.find_all(F.encode("html", "UTF-8"), b"<p>")).alias("at"))
    return found.select("page_id", "at")


def decode_xml_text(spark, sf_dir):
    """Sections that hold text as it is, in Base64 with breaks, or in UTF-16 under Base64."""
    d = R.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<Name value='"), F.col("p_name"), F.lit("'/>")).alias("xml"))
    plain, wide = F.encode("xml", "UTF-8"), F.encode("xml", "UTF-16LE")
    d = d.withColumn("x", F.regexp_replace(F.when(F.col("p_partkey") % 3 == 1, F.base64(plain)).otherwise(F.base64(wide)), "[\r\n]", ""))
    stored = F.encode(F.concat(F.lit(" "), F.substring("x", 1, 20), F.lit("\r\n"), F.expr("substring(x, 21)")), "UTF-8")
    return d.select("p_partkey", B.xml_text(F.when(F.col("p_partkey") % 3 == 0, plain).otherwise(stored)).alias("xml"))


def little_endian_fields(spark, sf_dir):
    """A packed record read from each document's bytes; null where it is cut short."""
    ship_package(spark)
    rows = R.table(spark, sf_dir, "documents").select("doc_id", F.encode(F.regexp_replace("text", "[^ -~]", "?"), "UTF-8").alias("b"))
    return B.little_endian(rows, "b", np.dtype([("id", "<u2"), ("x", "<u4"), ("y", "<i4")]), 2)


def _spliced(t):
    """Header, body and trailer as one tile, and a header's frame size rewritten in place."""
    head = F.lit(b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x00\x00\x00")
    size = F.unhex(F.concat(F.lpad(F.hex("h"), 4, "0"), F.lpad(F.hex("w"), 4, "0")))
    patched = F.overlay(head, size, F.lit(8))
    body = F.encode(F.col("length").cast("string"), "UTF-8")
    return t.select("slide_id", "level", "ordinal", F.hex(B.splice(patched, body, F.lit(b"\xff\xd9"))).alias("tile"), B.begins_image(patched).alias("image"))


def splice_bytes(spark, sf_dir):
    """The tiles of every level, each as one image."""
    return _spliced(R.tiles(spark, sf_dir))


#: The same by its former name.
def splice_bytes_all(spark, sf_dir):
    """``splice_bytes``."""
    return splice_bytes(spark, sf_dir)


def merge_tables(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit(b"")).when(F.col("p_partkey") % 4 == 1, F.lit(b"\xff\xd8\xff\xdb\x01\xff\xd9")).otherwise(F.lit(b"\xff\xd8\xff\xc4\x02")).alias("t"), F.concat(F.when(F.col("p_size") % 2 == 0, F.lit(b"\xff\xd8")).otherwise(F.lit(b"")), F.encode("p_brand", "UTF-8"), F.when(F.col("p_size") % 3 == 0, F.lit(b"\xff\xd9")).otherwise(F.lit(b""))).alias("s"))
    return p.select("p_partkey", F.hex(B.merge_tables(F.col("t"), F.col("s"))).alias("merged"))


def tiff_fields(spark, sf_dir):
    """Which field payloads stand in their entry, classic and big."""
    t = R.tiles(spark, sf_dir).select("slide_id", "level", "ordinal", (F.col("x") % 20).alias("kind"), (F.col("y") % 10).alias("n"))
    size = B.item_size(F.col("kind"))
    return t.select("slide_id", "level", "ordinal", size.cast("long").alias("item_size"), B.inline(F.col("kind"), F.col("n")).alias("inline_classic"), B.inline(F.col("kind"), F.col("n"), True).alias("inline_big"))


def nonhier_recordno(spark, sf_dir):
    """Record numbers count the values of all earlier layers."""
    layers = R.tiles(spark, sf_dir).groupBy("slide_id", "level").agg(F.count("*").alias("values"))
    base = lookup.running_offsets(layers, ["slide_id"], ["level"], length="values")
    return base.withColumn("value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("values") - 1))).select("slide_id", "level", "value", (F.col("offset") + F.col("value")).alias("recordno"))


def descriptor_table(spark, sf_dir):
    """Descriptors up to the first whose index offset is zero; whether their ids rise."""
    t = R.tiles(spark, sf_dir).where("ordinal = 0").select("slide_id", "level", F.when(F.col("x") % 5 == 0, 0).otherwise(F.col("length")).alias("index_offset"), (F.col("level") + F.col("y") % 3).alias("id"))
    order = Window.partitionBy("slide_id").orderBy("level")
    ended = F.max(F.when(F.col("index_offset") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rising = F.coalesce(F.col("id") > F.lag("id").over(order), F.lit(True))
    return t.withColumn("ended", ended).where("ended = 0").select("slide_id", "level", "id", "index_offset", rising.alias("rising"))


def associated_classify(spark, sf_dir):
    """Of up to three embedded images the smallest is the label and the largest the macro."""
    t = R.tiles(spark, sf_dir).where("level = 0").select("slide_id", "ordinal", "w", "h").where("ordinal < 3")
    area, per = F.col("w") * F.col("h"), Window.partitionBy("slide_id")
    rank, n = F.row_number().over(per.orderBy(area, "ordinal")), F.count("*").over(per)
    return t.withColumns({"rank": rank, "n": n}).where("rank = 1 OR rank = n").select("slide_id", "ordinal", F.when(F.col("rank") == 1, "label").otherwise("macro").alias("kind"))


def quality_estimate(spark, sf_dir):
    """The quality of 1 to 100 whose scaled standard table is nearest to a slide's, the lower of equals."""
    table = layout.LUMINANCE
    scale = lambda q: F.when(q < 50, F.expr("5000 div q")).otherwise(200 - q * 2)
    s = R.slides(spark, sf_dir).select("slide_id", (F.col("slide_id") % 100 + 1).alias("q"))
    scaled = lambda v: F.greatest(F.lit(1), F.least(F.lit(255), F.expr(f"({v} * s + 50) div 100")))
    own = s.withColumn("s", scale(F.col("q"))).select("slide_id", F.array(*[scaled(v) + (F.col("slide_id") % 3 if i == 5 else 0) for i, v in enumerate(table)]).alias("own"))
    each = spark.range(1, 101).withColumnRenamed("id", "q").withColumn("s", scale(F.col("q"))).select("q", F.array(*[scaled(v) for v in table]).alias("std"))
    # A hundred fixed candidates for each distinct table: slides share at most 300 of them (100 qualities, 3 shifts of an entry).
    candidates = each.agg(F.array_sort(F.collect_list(F.struct("q", "std"))).alias("all"))
    distance = lambda c: F.aggregate(F.zip_with(c["std"], F.col("own"), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda x, y: x + y)
    scored = own.select("own").distinct().crossJoin(F.broadcast(candidates)).select("own", F.array_min(F.transform("all", lambda c: F.struct(distance(c).alias("d"), c["q"].alias("q")))).alias("best"))
    # Named, since by its estimates, which take an array for one entry, Spark would broadcast the slides' side.
    return own.join(F.broadcast(scored), "own").select("slide_id", F.col("best.q").alias("quality"), F.col("best.d").alias("distance"))


def bigtiff_switch(spark, sf_dir):
    """Whether an output needs 64-bit offsets, by source bytes or by pixels."""
    total = R.tiles(spark, sf_dir).groupBy("slide_id").agg((F.sum("length") * 40000).alias("bytes"))
    pixels = R.slides(spark, sf_dir).select("slide_id", (F.col("width") * F.col("height") * 60).alias("raw"))
    return total.join(pixels, "slide_id").select("slide_id", (F.col("bytes") >= 3500000000).alias("by_bytes"), ((F.col("raw") >= 3500000000) | (F.col("bytes") >= 3500000000)).alias("by_either"))


def tiff_layout(spark, sf_dir):
    """Directory offsets of each page of an output, known before anything is written."""
    return layout.page_offsets(R.levels(spark, sf_dir).select("slide_id", "level", F.col("width"), F.col("height"), (F.col("cols") * F.col("rows")).alias("tiles"), (F.col("cols") * F.col("rows") * 1000 + F.col("width")).alias("payload")))


def batch_outputs(spark, sf_dir):
    """Output paths in one folder, numbered where names repeat."""
    f = R.files(spark, sf_dir)
    return batch.numbered_outputs(f.withColumn("output", batch.output_path(F.col("path"), "/out")), "output", "file_id").select("file_id", "output", "unique")


def batch_outputs_cascading(spark, sf_dir):
    """The same where numbered names themselves collide."""
    ship_package(spark)
    f = R.files(spark, sf_dir)
    name = F.concat(F.lit("/out/s"), (F.col("file_id") % 50).cast("string"), F.when(F.col("file_id") % 7 == 0, "_2").otherwise(""), F.lit(".svs"))
    return batch.reserved_outputs(f.withColumn("output", name), "output", "file_id")


def _queue(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ["Waiting", "Running", "Done", "Failed", "Cancelled"])), (F.col("event_id") % 5 + 1).cast("int"))
    return R.table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("item"), state.alias("state"))


def queue_status(spark, sf_dir):
    """Items by their latest state."""
    return batch.latest_states(_queue(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("items"), F.sum("n_events").alias("n_events"))


def queue_add(spark, sf_dir):
    """What adding paths to a queue does to each."""
    queue = batch.latest_states(_queue(spark, sf_dir)).select(F.concat(F.lit("k"), (F.col("item") % 400).cast("string")).alias("key"), "state").groupBy("key").agg(F.min("state").alias("state"))
    f = format_dispatch(spark, sf_dir)
    paths = f.select(F.col("file_id").alias("ord"), F.concat(F.lit("k"), (F.col("file_id") % 700).cast("string")).alias("key"), "supported")
    return batch.add_paths(queue, paths)


def drop_paths(spark, sf_dir):
    """Supported paths of a drop, each once without regard to case, in the order given."""
    f = format_dispatch(spark, sf_dir).where("supported")
    return f.groupBy(F.lower("path").alias("key")).agg(F.min("file_id").alias("file_id"), F.count("*").alias("given")).select("key", "file_id", "given")


def bench_speedup(spark, sf_dir):
    runs = R.files(spark, sf_dir).select((F.col("file_id") % 50).alias("case"), F.when(F.col("file_id") % 2 == 0, "baseline").otherwise("current").alias("method"), (F.col("length") % 1000 / 8).alias("seconds"), (F.col("length") % 10 != 0).alias("ok"))
    return batch.speedups(runs.withColumn("case", F.expr("case div 2")))


def resolution_rational(spark, sf_dir):
    """Resolutions in thousandths, as they are stored."""
    lv = R.levels(spark, sf_dir).join(R.slides(spark, sf_dir).select("slide_id", "mpp"), "slide_id")
    value = F.lit(10000.0) / F.col("mpp") / F.pow(F.lit(2.0), F.col("level"))
    return lv.select("slide_id", "level", F.round(F.greatest(value, F.lit(0.0)) * 1000).cast("long").alias("numerator"))


QUERIES = [slide_info, format_dispatch, label_dedupe, mpp_from, mean_mpp, labeled_number, ini_map, first_parse, classify_page, aperio_description, find_all_marker, decode_xml_text, little_endian_fields, splice_bytes, splice_bytes_all, merge_tables, tiff_fields, nonhier_recordno, descriptor_table, associated_classify, quality_estimate, bigtiff_switch, tiff_layout, batch_outputs, batch_outputs_cascading, queue_status, queue_add, drop_paths, bench_speedup, resolution_rational]

_FORMATS = "formats AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{e}', '{n}', '{r}')" for o, e, n, r in formats.FORMATS) + ") AS v(ord, extension, label, reader))"
_DISPATCH = f"{_FORMATS}, e AS (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS extension FROM files), disp AS (SELECT file_id, path, extension, label, reader, reader IS NOT NULL AS supported FROM e LEFT JOIN formats USING (extension))"
_QUEUE = "q AS (SELECT event_id, ts, user_id AS item, (['Waiting', 'Running', 'Done', 'Failed', 'Cancelled'])[event_id % 5 + 1] AS state FROM events), latest AS (SELECT item, arg_max(state, (ts, event_id)) AS state, count(*) AS n_events FROM q GROUP BY item)"
_STD = "[" + ", ".join(map(str, layout.LUMINANCE)) + "]"

SQL = {
    "slide_info": R.sql(
        "levels",
        """, p AS (SELECT slide_id, string_agg(printf('L%d=%dx%d (%dx%d tiles)', level, width, height, cols, rows), ', ' ORDER BY level) AS pyramid FROM levels GROUP BY slide_id)
SELECT slide_id, width, height, CASE kinds WHEN 0 THEN 'none' WHEN 1 THEN 'label' WHEN 2 THEN 'label, macro' ELSE 'label, macro, macro_other' END AS associated, pyramid FROM slides JOIN p USING (slide_id)""",
    ),
    "format_dispatch": R.sql("files", f", {_DISPATCH} SELECT * FROM disp"),
    "label_dedupe": R.sql("files", f", {_DISPATCH}, f AS (SELECT label, min(ord) AS ord FROM formats GROUP BY label), n AS (SELECT label, count(*) AS files FROM disp WHERE supported GROUP BY label) SELECT label, row_number() OVER (ORDER BY ord) - 1 AS place, coalesce(files, 0) AS files FROM f LEFT JOIN n USING (label)"),
    "mpp_from": R.sql(
        "tiles",
        """, r AS (SELECT slide_id, level, ordinal, CASE WHEN x % 13 = 0 THEN NULL ELSE (y - 100) / CAST(8 AS DOUBLE) END AS v, x % 4 + 1 AS unit FROM tiles)
SELECT slide_id, level, ordinal, CASE WHEN v > 0 AND unit = 3 THEN 10000 / v WHEN v > 0 AND unit = 2 THEN 25400 / v END AS mpp FROM r""",
    ),
    "mean_mpp": R.sql("tiles", " SELECT slide_id, avg(CAST(level * 0.25 - 0.5 AS DOUBLE)) FILTER (level * 0.25 - 0.5 > 0) AS mpp FROM tiles GROUP BY slide_id"),
    "labeled_number": r"""WITH t AS (SELECT p_partkey, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN '|AppMag = ' WHEN 1 THEN ' Objective Power=' ELSE ' mag ' END || CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE '' END || p_size || CASE WHEN p_partkey % 7 = 0 THEN '.5.1' ELSE '|x' END) AS t FROM part),
n AS (SELECT p_partkey, try_cast(regexp_extract(t, 'objective power[ \t\r\n\f=:|]*([0-9.+-]+)', 1) AS DOUBLE) AS a, try_cast(regexp_extract(t, 'appmag[ \t\r\n\f=:|]*([0-9.+-]+)', 1) AS DOUBLE) AS b FROM t)
SELECT p_partkey, coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END) AS app_mag FROM n""",
    "ini_map": R.sql(
        "ini",
        """, t AS (SELECT file, line, trim(text) AS t FROM ini),
s AS (SELECT *, coalesce(last_value(CASE WHEN t LIKE '[%]' THEN lower(substr(t, 2, length(t) - 2)) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING), '') AS section FROM t),
k AS (SELECT file, line, section || '.' || lower(trim(split_part(t, '=', 1))) AS key, trim(substr(t, instr(t, '=') + 1)) AS value FROM s WHERE NOT t LIKE '[%]' AND t LIKE '%=%')
SELECT file, key, arg_max(value, line) AS value FROM k GROUP BY file, key""",
    ),
    "first_parse": """WITH c AS (SELECT p_partkey, coalesce(try_cast(CASE WHEN p_partkey % 2 = 0 THEN p_size || 'x' ELSE CAST(p_size AS VARCHAR) END AS BIGINT), CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END, try_cast(p_type AS BIGINT)) AS value FROM part)
SELECT p_partkey, value, greatest(1, least(100, coalesce(value, 75) * 3)) AS quality FROM c""",
    "classify_page": """WITH t AS (SELECT p_partkey, p_size, lower(p_type || ([' Label', ' MACRO label', ' macro', ' a Thumbnail', ''])[p_partkey % 5 + 1]) AS t FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN contains(t, 'label') THEN 'label' WHEN contains(t, 'macro') THEN 'macro' WHEN contains(t, 'thumbnail') THEN 'thumbnail' END AS kind FROM t""",
    "aperio_description": R.sql("slides", f" SELECT slide_id, '{T.VERSION}' || chr(10) || printf('%dx%d [0,0 %dx%d] (256x256) JPEG/RGB Q=75|AppMag = %d|MPP = %.6f', width, height, width, height, app_mag, mpp) AS description FROM slides"),
    "find_all_marker": "WITH b AS (SELECT page_id, hex(encode(html)) AS h FROM pages), i AS (SELECT page_id, h, unnest(generate_series(0, length(h) // 2 - 3)) AS \"at\" FROM b WHERE length(h) >= 6) SELECT page_id, \"at\" FROM i WHERE substr(h, \"at\" * 2 + 1, 6) = '3C703E'",
    "decode_xml_text": "SELECT p_partkey, '<Name value=''' || p_name || '''/>' AS xml FROM part",
    "little_endian_fields": r"""WITH h AS (SELECT doc_id, hex(encode(regexp_replace(text, '[^ -~]', '?', 'g'))) AS h FROM documents),
b AS (SELECT doc_id, length(h) >= 24 AS ok, list_transform(range(2, 12), lambda i: CAST('0x' || substr(h || '000000000000000000000000', i * 2 + 1, 2) AS BIGINT)) AS b FROM h)
SELECT doc_id, CASE WHEN ok THEN b[1] + b[2] * 256 END AS id, CASE WHEN ok THEN b[3] + b[4] * 256 + b[5] * 65536 + b[6] * 16777216 END AS x, CASE WHEN ok THEN b[7] + b[8] * 256 + b[9] * 65536 + b[10] * 16777216 - CASE WHEN b[10] >= 128 THEN 4294967296 ELSE 0 END END AS y FROM b""",
    "splice_bytes": R.sql("tiles", " SELECT slide_id, level, ordinal, 'FFD8FFC0001108' || lpad(printf('%X', h), 4, '0') || lpad(printf('%X', w), 4, '0') || hex(encode(CAST(length AS VARCHAR))) || 'FFD9' AS tile, true AS image FROM tiles"),
    "merge_tables": """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'FFD8FFDB01' ELSE 'FFD8FFC402' END AS t, CASE WHEN p_size % 2 = 0 THEN 'FFD8' ELSE '' END AS a, hex(encode(p_brand)) AS b, CASE WHEN p_size % 3 = 0 THEN 'FFD9' ELSE '' END AS c FROM part)
SELECT p_partkey, CASE WHEN t = '' THEN a || b || c ELSE t || b || 'FFD9' END AS merged FROM p""",
    "tiff_fields": R.sql(
        "tiles",
        """, f AS (SELECT slide_id, level, ordinal, y % 10 AS n, CAST(CASE WHEN x % 20 IN (1, 2, 6, 7) THEN 1 WHEN x % 20 IN (3, 8) THEN 2 WHEN x % 20 IN (4, 9, 11) THEN 4 WHEN x % 20 IN (5, 10, 12, 16, 17, 18) THEN 8 END AS BIGINT) AS item_size FROM tiles)
SELECT slide_id, level, ordinal, item_size, item_size * n <= 4 AS inline_classic, item_size * n <= 8 AS inline_big FROM f""",
    ),
    "nonhier_recordno": R.sql(
        "tiles",
        """, c AS (SELECT slide_id, level, count(*) AS n FROM tiles GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY slide_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c)
SELECT slide_id, level, value, CAST(base + value AS BIGINT) AS recordno FROM b, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS value)""",
    ),
    "descriptor_table": R.sql(
        "tiles",
        """, t AS (SELECT slide_id, level, CASE WHEN x % 5 = 0 THEN 0 ELSE length END AS index_offset, level + y % 3 AS id FROM tiles WHERE ordinal = 0),
w AS (SELECT *, max(CASE WHEN index_offset = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY level ROWS UNBOUNDED PRECEDING) AS ended, coalesce(id > lag(id) OVER (PARTITION BY slide_id ORDER BY level), true) AS rising FROM t)
SELECT slide_id, level, id, index_offset, rising FROM w WHERE ended = 0""",
    ),
    "associated_classify": R.sql(
        "tiles",
        """, r AS (SELECT slide_id, ordinal, row_number() OVER (PARTITION BY slide_id ORDER BY w * h, ordinal) AS k, count(*) OVER (PARTITION BY slide_id) AS n FROM tiles WHERE level = 0 AND ordinal < 3)
SELECT slide_id, ordinal, CASE WHEN k = 1 THEN 'label' ELSE 'macro' END AS kind FROM r WHERE k = 1 OR k = n""",
    ),
    "quality_estimate": R.sql(
        "slides",
        f""", c AS (SELECT q, list_transform({_STD}, lambda v: greatest(1, least(255, (v * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - q * 2 END + 50) // 100))) AS std FROM generate_series(1, 100) g(q)),
o AS (SELECT slide_id, list_transform(std, lambda v, i: v + CASE WHEN i = 6 THEN slide_id % 3 ELSE 0 END) AS own FROM slides JOIN c ON q = slide_id % 100 + 1),
s AS (SELECT slide_id, q, list_sum(list_transform(list_zip(std, own), lambda z: abs(z[1] - z[2]))) AS d FROM o, c)
SELECT slide_id, CAST(arg_min(q, (d, q)) AS BIGINT) AS quality, CAST(min(d) AS BIGINT) AS distance FROM s GROUP BY slide_id""",
    ),
    "bigtiff_switch": R.sql("tiles slides", ", t AS (SELECT slide_id, sum(length) * 40000 AS bytes FROM tiles GROUP BY slide_id) SELECT slide_id, bytes >= 3500000000 AS by_bytes, bytes >= 3500000000 OR width * height * 60 >= 3500000000 AS by_either FROM t JOIN slides USING (slide_id)"),
    "tiff_layout": R.sql(
        "levels",
        """, p AS (SELECT slide_id, level, cols * rows AS tiles, cols * rows * 1000 + width AS payload, length(printf('%dx%d', width, height)) AS d FROM levels),
s AS (SELECT *, 2 + 21 * 12 + 4 AS ifd_size FROM p),
a AS (SELECT *, 8 + tiles * 8 + 80 + d AS extra FROM s),
o AS (SELECT *, 8 + coalesce(sum((payload + ifd_size + extra + 3) // 4 * 4) OVER (PARTITION BY slide_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM a)
SELECT slide_id, level, CAST(start AS BIGINT) AS start, CAST((start + payload + 1) // 2 * 2 AS BIGINT) AS ifd_at, CAST(lead((start + payload + 1) // 2 * 2, 1, 0) OVER (PARTITION BY slide_id ORDER BY level) AS BIGINT) AS next_ifd FROM o""",
    ),
    "batch_outputs": R.sql(
        "files",
        r""", o AS (SELECT file_id, '/out/' || regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(.)\.[^.]*$', '\1') || '.svs' AS output FROM files),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(output) ORDER BY file_id) AS k FROM o)
SELECT file_id, output, CASE WHEN k = 1 THEN output ELSE regexp_replace(output, '\.[^./]*$', '') || '_' || k || '.svs' END AS "unique" FROM k""",
    ),
    # Row by row within each root: the first of the name and its numbered forms that no earlier row has.
    "batch_outputs_cascading": "WITH RECURSIVE " + R.SQL["files"] + """,
o AS (SELECT file_id AS ord, '/out/s' || (file_id % 50) || CASE WHEN file_id % 7 = 0 THEN '_2' ELSE '' END AS stem, file_id % 50 AS root, row_number() OVER (PARTITION BY file_id % 50 ORDER BY file_id) AS i FROM files),
r AS (SELECT root, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, '' AS stem, '' AS pick, CAST([] AS VARCHAR[]) AS taken FROM o GROUP BY root
 UNION ALL SELECT root, i, ord, stem, pick, list_append(taken, pick) FROM (
  SELECT o.root, o.i, o.ord, o.stem, r.taken, list_filter(list_prepend(o.stem || '.svs', list_transform(range(2, o.i + 2), lambda n: o.stem || '_' || n || '.svs')), lambda x: NOT list_contains(r.taken, x))[1] AS pick FROM r JOIN o ON o.root = r.root AND o.i = r.i + 1))
SELECT ord, stem || '.svs' AS output, pick AS "unique" FROM r WHERE i > 0""",
    "queue_status": f"WITH {_QUEUE} SELECT state, count(*) AS items, CAST(sum(n_events) AS BIGINT) AS n_events FROM latest GROUP BY state",
    "queue_add": R.sql(
        "files",
        f""", {_DISPATCH}, {_QUEUE}, queue AS (SELECT 'k' || (item % 400) AS key, min(state) AS state FROM latest GROUP BY ALL),
p AS (SELECT file_id AS ord, 'k' || (file_id % 700) AS key, supported FROM disp),
s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS k FROM p WHERE supported)
SELECT ord, key, CASE WHEN k > 1 THEN 'duplicate' WHEN state IS NULL THEN 'added' WHEN state = 'Waiting' THEN 'duplicate' ELSE 'refreshed' END AS action FROM s LEFT JOIN queue USING (key)
UNION ALL SELECT ord, key, 'ignored' FROM p WHERE NOT supported""",
    ),
    "drop_paths": R.sql("files", f", {_DISPATCH} SELECT lower(path) AS key, min(file_id) AS file_id, count(*) AS given FROM disp WHERE supported GROUP BY 1"),
    "bench_speedup": R.sql(
        "files",
        """, r AS (SELECT (file_id % 50) // 2 AS c, file_id % 2 = 0 AS b, (length % 1000) / CAST(8 AS DOUBLE) AS s, length % 10 <> 0 AS ok FROM files),
g AS (SELECT c AS "case", min(s) FILTER (b AND ok) AS baseline, min(s) FILTER (NOT b AND ok) AS current FROM r GROUP BY c)
SELECT *, CASE WHEN current <> 0 THEN baseline / current END AS speedup FROM g""",
    ),
    "resolution_rational": R.sql("levels", " SELECT slide_id, level, CAST(round(greatest(CAST(10000 AS DOUBLE) / s.mpp / pow(CAST(2 AS DOUBLE), level), 0) * 1000) AS BIGINT) AS numerator FROM levels JOIN slides s USING (slide_id)"),
}
SQL["splice_bytes_all"] = SQL["splice_bytes"]
