"""Segmentation sets by name: where their files lie, which labels count for nothing, and the rows that they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.dedup import remap_categories
from .readers import listing, panoptic


@dataclass(frozen=True)
class ImageSet:
    """A split's folders under the sets' root, its files' endings and the label to be ignored."""

    name: str
    images: str
    labels: str
    image_ext: str = "jpg"
    label_ext: str = "png"
    ignore: int = 255


def sets(prepared: str = "prepared") -> list[ImageSet]:
    """The sets' splits, folders as the sets are published; `prepared` ends the names of folders whose files a preparing step has written."""
    out = []
    for split, folder in (("train", "training"), ("val", "validation")):
        out.append(ImageSet(f"ade20k_sem_seg_{split}", f"ADEChallengeData2016/images/{folder}", f"ADEChallengeData2016/annotations_{prepared}/{folder}"))
        out.append(ImageSet(f"ade20k_full_sem_seg_{split}", f"ADE20K_2021_17_01/images_{prepared}/{folder}", f"ADE20K_2021_17_01/annotations_{prepared}/{folder}", label_ext="tif", ignore=65535))
        out.append(ImageSet(f"mapillary_vistas_sem_seg_{split}", f"mapillary_vistas/{folder}/images", f"mapillary_vistas/{folder}/labels", ignore=65))
    for split in ("train", "test"):
        out.append(ImageSet(f"coco_2017_{split}_stuff_10k_sem_seg", f"coco/coco_stuff_10k/images_{prepared}/{split}", f"coco/coco_stuff_10k/annotations_{prepared}/{split}"))
    return out


def image_set(name: str, prepared: str = "prepared") -> ImageSet:
    found = [s for s in sets(prepared) if s.name == name]
    if not found:
        raise KeyError(f"no set {name}; there are {[s.name for s in sets()]}")
    return found[0]


def _stems(spark: SparkSession, folder: str, ext: str, path: str) -> DataFrame:
    """(stem, path): a file's path under the folder without its ending."""
    d = listing(spark, folder, f"*.{ext}")
    below = F.element_at(F.split("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/"), -1)
    return d.select(F.regexp_replace(below, r"\.[^.]*$", "").alias("stem"), F.col("path").alias(path))


def pairs(spark: SparkSession, root: str, which: ImageSet) -> DataFrame:
    """(stem, image, label, ignore) of the images that have a label file of the same name."""
    images = _stems(spark, f"{root}/{which.images}", which.image_ext, "image")
    labels = _stems(spark, f"{root}/{which.labels}", which.label_ext, "label")
    return images.join(labels, "stem").withColumn("ignore", F.lit(which.ignore))


def panoptic_rows(annotations: DataFrame, image_folder: str, mask_folder: str, semantic_folder: str, things: DataFrame, stuff: DataFrame) -> DataFrame:
    """(image_id, image, mask, semantic, id, category_id, isthing), a row for each segment: categories become contiguous, things first, and say what they are.

    things and stuff are (key, id): the set's own number and the contiguous one.
    """
    d = panoptic(annotations, image_folder, mask_folder).withColumn("semantic", F.concat(F.lit(semantic_folder + "/"), F.element_at(F.split("mask", "/"), -1)))
    s = d.select("image_id", "image", "mask", "semantic", F.explode("segments_info").alias("s"))
    s = s.select("image_id", "image", "mask", "semantic", F.col("s.id").alias("id"), F.col("s.category_id").alias("key"))
    return remap_categories(s, things, stuff, "key").drop("key")


@dataclass(frozen=True)
class AnnotatedSet:
    """A split whose annotations are one JSON file: images, the file, and for panoptic sets the folders of masks and of semantic maps."""

    name: str
    images: str
    annotations: str
    masks: str | None = None
    semantic: str | None = None


def annotated_sets(prepared: str = "prepared") -> list[AnnotatedSet]:
    """Instance and panoptic splits, folders and files as the sets are published."""
    out, base = [], "ADEChallengeData2016"
    for split, folder in (("train", "training"), ("val", "validation")):
        out.append(AnnotatedSet(f"ade20k_instance_{split}", f"{base}/images/{folder}", f"{base}/ade20k_instance_{split}.json"))
        out.append(AnnotatedSet(f"ade20k_panoptic_{split}", f"{base}/images/{folder}", f"{base}/ade20k_panoptic_{split}.json", f"{base}/ade20k_panoptic_{split}", f"{base}/annotations_{prepared}/{folder}"))
        out.append(AnnotatedSet(f"mapillary_vistas_panoptic_{split}", f"mapillary_vistas/{folder}/images", f"mapillary_vistas/{folder}/panoptic/panoptic_2018.json", f"mapillary_vistas/{folder}/panoptic", f"mapillary_vistas/{folder}/labels"))
    return out


def annotated_set(name: str, prepared: str = "prepared") -> AnnotatedSet:
    found = [s for s in annotated_sets(prepared) if s.name == name]
    if not found:
        raise KeyError(f"no set {name}; there are {[s.name for s in annotated_sets()]}")
    return found[0]


_JSON = "categories array<struct<id:int,name:string,isthing:int>>, images array<struct<id:string,file_name:string,height:int,width:int>>, annotations array<struct<id:long,image_id:string,category_id:int,bbox:array<double>,iscrowd:int>>"


def class_list(annotations: DataFrame, things_only: bool = False) -> DataFrame:
    """(key, name, isthing, label): the file's own classes, numbered from 0 in the order of their keys, things alone or all (S17). As many as a set has classes."""
    c = annotations.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("key"), F.col("c.name").alias("name"), (F.coalesce("c.isthing", F.lit(1)) == 1).alias("isthing")).distinct()
    c = c.where("isthing") if things_only else c
    return c.withColumn("label", (F.row_number().over(W.orderBy("key", "name")) - 1).cast("int"))


def instances(spark: SparkSession, root: str, which: AnnotatedSet) -> DataFrame:
    """(image_id, image, id, label, name, x, y, w, h, crowd), a row for each instance of the set's annotation file whose class and image are in it."""
    a = spark.read.schema(_JSON).json(f"{root}/{which.annotations}", multiLine=True)
    images = a.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.concat(F.lit(f"{which.images}/"), "i.file_name").alias("image"))
    rows = a.select(F.explode("annotations").alias("s")).select("s.*")
    d = rows.join(F.broadcast(class_list(a)), F.col("category_id") == F.col("key")).join(images, "image_id")  # a row a class
    box = [F.get("bbox", k).alias(c) for k, c in enumerate("xywh")]
    return d.select("image_id", "image", "id", "label", "name", *box, (F.coalesce("iscrowd", F.lit(0)) == 1).alias("crowd"))
