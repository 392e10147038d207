"""Readers of the formats around the gate and of label datasets; every one returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import running
from ..operators.telemetry import parse_log

CAMERA = "struct<file_path:string,roi:array<int>,id:int,direction:string,sleep_time:double>"
ITEM = "struct<transcription:string,points:array<array<double>>,score:string>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file; Spark's own columns, so any store that it can read will do."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """One row per camera of a JSON object of objects; keyed by direction, as ids repeat."""
    whole = spark.read.text(path, wholetext=True)
    one = whole.select(F.explode(F.from_json("value", f"map<string,{CAMERA}>")).alias("camera_key", "c"))
    return one.select("camera_key", "c.*")


def read_size_types(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """code, description, length, height, group; file rows win over overrides, later ones over earlier."""
    schema = "code string, description string, length string, height string, `group` string"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE").withColumn("rank", F.monotonically_increasing_id())
    extra = spark.createDataFrame([(k, v, None, None, None, -1) for k, v in (overrides or {}).items()], schema + ", rank long")
    last = rows.unionByName(extra).groupBy("code").agg(F.max_by(F.struct("description", F.col("length").try_cast("double").alias("length"), F.col("height").try_cast("double").alias("height"), "group"), "rank").alias("r"))
    return last.select("code", "r.*")


def read_owners(spark: SparkSession, path: str) -> DataFrame:
    """Four-letter owner codes that end in U, with what else their rows say."""
    rows = spark.read.csv(path, header=False)
    return rows.filter(F.col("_c0").rlike("^[A-Z]{3}U$")).withColumnRenamed("_c0", "owner")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """fragment, rank, candidate of ragged lines."""
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = _lines(spark, path).select(parts.alias("p")).filter(F.size("p") > 1)
    return rows.select(F.col("p")[0].alias("fragment"), F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("rank", "candidate")).filter("candidate <> ''")


def read_app_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``time - name - level - message`` logs; other lines belong to the record before them.

    Files are split as usual: lines are in order of their block and their place in it, and records are
    counted in two levels over blocks, so a file of any size is many tasks. Records never span files.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), F.regexp_replace("value", "\r$", "").alias("line")
    )
    marked = parse_log(raw).withColumnRenamed("logger", "name").withColumnRenamed("message", "said")
    record = running(marked, "file", "block", ["no"], sums={"record": F.col("level").isNotNull().cast("int")})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "no", F.when(F.col("level").isNotNull(), F.col("said")).otherwise(F.col("line")).alias("t")))), lambda x: F.coalesce(x["t"], F.lit(""))), "\n")
    return record.filter("record > 0").groupBy("file", "record").agg(F.min("ts").alias("ts"), F.max("name").alias("name"), F.max("level").alias("level"), F.regexp_replace(text, r"\s+$", "").alias("message"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Free lines with the first number of seconds they name, if any."""
    return _lines(spark, path).withColumn("seconds", F.nullif(F.regexp_extract("line", r"([0-9]+\.[0-9]+) ?s", 1), F.lit("")).try_cast("double"))


GPU = ["timestamp", "name", "pci", "driver", "pstate", "pcie_max", "pcie_now", "temperature", "gpu", "memory", "total", "free"]


def read_gpu_csv(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns; values that are no numbers become NaN; used memory and its share are derived."""
    rows = spark.read.csv(path, header=False, schema=", ".join(f"{c} string" for c in GPU), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(float("nan")))
    out = rows.withColumns({c: number(c) for c in ("temperature", "gpu", "memory", "total", "free")})
    return out.withColumns({"used": F.col("total") - F.col("free"), "ratio": F.round((F.col("total") - F.col("free")) / F.col("total"), 3)})


def read_ocr_labels(spark: SparkSession, path: str) -> DataFrame:
    """image, transcription, points, score of lines: path, tab or four spaces, JSON items."""
    split = F.split("line", "\t|    ", 2)
    rows = _lines(spark, path).select(split[0].alias("image"), F.from_json(split[1], f"array<{ITEM}>").alias("items"))
    return rows.select("image", F.posexplode("items").alias("item", "i")).select("image", "item", "i.*")


def read_evaluation(spark: SparkSession, path: str, truth: bool) -> DataFrame:
    """file, quad of eight numbers, ignore, text of tab-separated lines; short lines are left out."""
    p = F.split("line", "\t")
    rows = _lines(spark, path).withColumn("p", p).filter(F.size("p") >= (9 if truth else 8))
    quad = F.transform(F.slice("p", 1, 8), lambda x: x.try_cast("double"))
    text = F.when(F.size("p") > (9 if truth else 8), F.element_at("p", -1)).otherwise("")
    return rows.select("file", quad.alias("quad"), (F.col("p")[8] == "1").alias("ignore") if truth else F.lit(False).alias("ignore"), text.alias("text"))


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.try_cast("double"))


def read_det_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, line, cls and box; polygons of more than five numbers give their bounding box and points."""
    rows = _lines(spark, path).filter(F.trim("line") != "").withColumn("n", _numbers(F.col("line")))
    rest = F.slice("n", F.lit(2), F.size("n") - 1)
    xs, ys = F.filter(rest, lambda x, i: i % 2 == 0), F.filter(rest, lambda x, i: i % 2 == 1)
    polygon = F.size("n") > 6
    low, high = lambda v: F.array_min(v), lambda v: F.array_max(v)
    mid = lambda v: (F.array_min(v) + F.array_max(v)) / 2
    return rows.select(
        "file", "line", F.col("n")[0].cast("int").alias("cls"), F.when(polygon, mid(xs)).otherwise(F.get("n", F.lit(1))).alias("xc"), F.when(polygon, mid(ys)).otherwise(F.get("n", F.lit(2))).alias("yc"),
        F.when(polygon, high(xs) - low(xs)).otherwise(F.get("n", F.lit(3))).alias("w"), F.when(polygon, high(ys) - low(ys)).otherwise(F.get("n", F.lit(4))).alias("h"),
        F.when(polygon, F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("points"),
    )


def read_landmark_labels(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of class zero and four or five points of thirteen columns; -1 is a missing point."""
    rows = _lines(spark, path).filter(F.trim("line") != "").withColumn("n", _numbers(F.col("line"))).filter(F.size("n") == 13)
    point = lambda i: F.when((F.col("n")[i] >= 0) & (F.col("n")[i + 1] >= 0), F.struct(F.col("n")[i].alias("x"), F.col("n")[i + 1].alias("y")))
    return rows.select("file", F.col("n")[0].cast("int").alias("cls"), *[F.col("n")[i + 1].alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))], F.array(*[point(i) for i in (5, 7, 9, 11)]).alias("landmarks"))


def import_voc(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Normalized boxes of VOC XML files; difficult and unknown objects are left out; the centre is one pixel less."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"filename string, size struct<width:double,height:double>, object array<struct<name:string,difficult:int,bndbox:{box}>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    o = rows.select("filename", "size", F.explode("object").alias("o")).filter((F.col("o.difficult") != 1) & F.col("o.name").isin(names))
    b, w, h = "o.bndbox.", F.col("size.width"), F.col("size.height")
    return o.select(
        F.col("filename").alias("image"), (F.array_position(F.array(*map(F.lit, names)), F.col("o.name")) - 1).cast("int").alias("cls"),
        (((F.col(b + "xmin") + F.col(b + "xmax")) / 2 - 1) / w).alias("xc"), (((F.col(b + "ymin") + F.col(b + "ymax")) / 2 - 1) / h).alias("yc"),
        ((F.col(b + "xmax") - F.col(b + "xmin")) / w).alias("w"), ((F.col(b + "ymax") - F.col(b + "ymin")) / h).alias("h"),
    )


def _normalized(x1: Column, y1: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [((x1 + w / 2) / width).alias("xc"), ((y1 + h / 2) / height).alias("yc"), (w / width).alias("w"), (h / height).alias("h")]


def import_visdrone(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """Boxes of VisDrone files (left, top, width, height, score, class, ...); sizes has image, width, height.

    An image's name is that of its file, or of a folder ``image=<name>`` that the file lies in.
    """
    rows = _lines(spark, path).withColumn("n", F.transform(F.split("line", ","), lambda x: x.try_cast("double"))).filter(F.col("n")[4] != 0)
    named = rows.withColumn("image", F.coalesce(F.nullif(F.regexp_extract("file", r"/image=([^/]*)/[^/]*$", 1), F.lit("")), F.regexp_extract("file", r"([^/]*)\.txt$", 1))).join(sizes.withColumnsRenamed({"width": "__w", "height": "__h"}), "image")
    n = F.col("n")
    return named.select("image", (n[5] - 1).cast("int").alias("cls"), *_normalized(n[0], n[1], n[2], n[3], F.col("__w"), F.col("__h")))


def import_coco(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of COCO-style JSON files without crowds, clipped and normalized; classes by order of category id in their file."""
    schema = "images array<struct<id:long,file_name:string,width:double,height:double>>, categories array<struct<id:long,name:string>>, annotations array<struct<image_id:long,category_id:long,iscrowd:int,bbox:array<double>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("file"))
    images = doc.select("file", F.explode("images").alias("i")).select("file", "i.*")
    order = doc.select("file", F.posexplode(F.array_sort("categories")).alias("cls", "c")).select("file", "cls", F.col("c.id").alias("category_id"), "c.name")
    boxes = doc.select("file", F.explode("annotations").alias("a")).select("file", "a.*").filter(F.coalesce("iscrowd", F.lit(0)) == 0)
    b = boxes.join(images.withColumnRenamed("id", "image_id"), ["file", "image_id"]).join(order, ["file", "category_id"])
    clip = lambda v, m: F.least(F.greatest(v, F.lit(0.0)), m)
    x1, y1 = clip(F.col("bbox")[0], F.col("width")), clip(F.col("bbox")[1], F.col("height"))
    x2, y2 = clip(F.col("bbox")[0] + F.col("bbox")[2], F.col("width")), clip(F.col("bbox")[1] + F.col("bbox")[3], F.col("height"))
    return b.select(F.col("file_name").alias("image"), "cls", "name", *_normalized(x1, y1, x2 - x1, y2 - y1, F.col("width"), F.col("height")))


def import_geojson(spark: SparkSession, path: str, classes: dict[int, int], sizes: DataFrame) -> DataFrame:
    """Boxes of features with ``bounds_imcoords``; classes are remapped, unknown ones left out."""
    schema = "features array<struct<properties:struct<bounds_imcoords:string,image_id:string,type_id:int>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features.properties").alias("p")).select("p.*")
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    b = f.withColumn("b", F.transform(F.split("bounds_imcoords", ","), lambda x: x.try_cast("int"))).withColumn("cls", F.try_element_at(table, F.col("type_id")))
    good = b.filter(F.col("cls").isNotNull() & (F.size("b") == 4)).withColumnRenamed("image_id", "image").join(sizes.withColumnsRenamed({"width": "__w", "height": "__h"}), "image")
    c = [F.col("b")[i].cast("double") for i in range(4)]
    return good.select("image", "cls", *_normalized(c[0], c[1], c[2] - c[0], c[3] - c[1], F.col("__w"), F.col("__h")))


def import_pixel_csv(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of one class of lines image, x1, y1, x2, y2, class, width, height."""
    rows = spark.read.csv(path, schema="image string, x1 double, y1 double, x2 double, y2 double, name string, width double, height double")
    return rows.select("image", F.lit(0).alias("cls"), *_normalized(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("width"), F.col("height")))


def read_evolve(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV with blanks around names and values."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = rows.toDF(*[c.strip() for c in rows.columns])
    return named.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in named.columns])


def read_table_dataset(spark: SparkSession, path: str, most: int) -> DataFrame:
    """JSON lines whose structure has one to ``most`` tokens."""
    schema = "filename string, html struct<structure:struct<tokens:array<string>>,cells:array<struct<tokens:array<string>,bbox:array<double>>>>"
    return spark.read.schema(schema).json(path).filter(F.size("html.structure.tokens").between(1, most))


def index_shards(df: DataFrame, shard: str, order: str) -> DataFrame:
    """Rows numbered from 1 in each shard."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(shard).orderBy(order)))


def image_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Images by extension with their size and time, in order of path; contents are not read. No image is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    found = files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp|tif|tiff|rgb|gif|webp)$"))
    if found.isEmpty():
        raise ValueError(f"no images in {path}")
    return found.orderBy("path")
